"""Noise curves, photon transfer and nightly summaries on the driver's tables, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import noise as N
from seriesforge.plans.base import query
from seriesforge.plans.surface import rounded
from seriesforge.sources.tables import read_table

STARS = """WITH r AS (SELECT l_suppkey, l_extendedprice / 1000 - l_tax AS c, pow(0.01 + l_discount, 2) + pow(0.005, 2) AS v FROM lineitem), m AS (SELECT l_suppkey, sum(c / v) / sum(1 / v) AS mean FROM r GROUP BY 1),
            s AS (SELECT l_suppkey, count(*) AS n, any_value(mean) AS mean, sqrt(avg(pow(c - mean, 2))) AS rms, CASE WHEN count(*) > 1 THEN sum(pow(c - mean, 2) / v) / (count(*) - 1) END AS chi2nu FROM r JOIN m USING (l_suppkey) GROUP BY 1)"""


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("mag"), (F.col("l_discount") + 0.01).alias("sigma"), F.col("l_tax").alias("zero"))
    return N.star_stats(rows, ["l_suppkey"], "mag", "sigma", "zero")


@query(STARS + " SELECT l_suppkey, n, round(mean, 6) AS mean, round(rms, 6) AS rms, round(chi2nu, 3) AS chi2nu FROM s")
def star_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select("l_suppkey", "n", *rounded({c: F.col(c) for c in ("mean", "rms")}), F.round("chi2nu", 3).alias("chi2nu"))


@query(STARS + """, ok AS (SELECT rms, mean / 3 AS p, pow(mean / 3 / rms, 2) AS a, pow(rms, -2) AS b FROM s WHERE rms > 0 AND mean > 0), k AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a) AS sa, sum(b) AS sb FROM ok)
            SELECT (SELECT round(sqrt(quantile_cont(chi2nu, 0.5)), 6) FROM s) AS inflation, (SELECT round(quantile_cont(rms, 0.5) FILTER (abs(mean - 36) <= 2), 6) FROM s) AS precision_36, (SELECT count(*) FILTER (abs(mean - 36) <= 2) FROM s) AS n_36,
            round(sqrt(greatest((aa * sb - ab * sa) / (aa * bb - ab * ab), 0)), 4) AS floor, round(greatest((bb * sa - ab * sb) / (aa * bb - ab * ab), 0), 4) AS k, n FROM k""")
def noise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, count = N.precision_at("mean", "rms", 36.0, 2.0)
    floor = N.noise_floor("rms", F.col("mean") / 3)
    return stars(spark, sf_dir).agg(F.round(N.inflation_factor("chi2nu"), 6).alias("inflation"), F.round(at, 6).alias("precision_36"), count.alias("n_36"), *[F.round(floor[c], 4).alias(c) for c in ("floor", "k")], floor["n"].alias("n"))


CURVE = """WITH c AS (SELECT l_returnflag, (floor(l_quantity / 4) + 0.5) * 4 AS centre, count(*) AS n, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) AS median FROM lineitem GROUP BY 1, 2)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.noise_curve(read_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 4.0)


@query(CURVE + " SELECT l_returnflag, round(median, 4) AS floor, centre, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY median, centre) AS r FROM c WHERE n >= 5) WHERE r = 1")
def noise_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.plateau(curve(spark, sf_dir), ["l_returnflag"]).withColumn("floor", F.round("floor", 4))


@query(CURVE + """, b AS (SELECT l_returnflag, min(median) AS baseline, min_by(centre, (median, centre)) AS low_at, max(centre) AS last FROM c WHERE n >= 15 GROUP BY 1), o AS (SELECT *, coalesce(n >= 15 AND median > 2 * baseline, FALSE) AS is_over FROM c JOIN b USING (l_returnflag)),
            r AS (SELECT *, count(*) FILTER (is_over) OVER (PARTITION BY l_returnflag ORDER BY centre ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 AS begun FROM o)
            SELECT l_returnflag, round(any_value(baseline), 4) AS baseline, coalesce(min(centre) FILTER (begun AND centre > low_at), min(centre) FILTER (is_over AND centre > low_at AND centre = last)) AS threshold FROM r GROUP BY 1""")
def degradation_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.degradation(curve(spark, sf_dir), ["l_returnflag"], 2.0).withColumn("baseline", F.round("baseline", 4))


@query("""WITH p AS (SELECT l_linestatus, l_quantity AS level, avg(l_extendedprice) / 1000 AS variance, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT l_linestatus, count(*) AS n, sum(sqrt(n) * level) / sum(sqrt(n)) AS xm, sum(sqrt(n) * variance) / sum(sqrt(n)) AS ym,
            sum(sqrt(n) * level * level) / sum(sqrt(n)) AS x2, sum(sqrt(n) * level * variance) / sum(sqrt(n)) AS xy FROM p GROUP BY 1), s AS (SELECT *, (xy - xm * ym) / (x2 - xm * xm) AS slope FROM w)
            SELECT l_linestatus, n, round(1 / slope, 4) AS gain, round(sqrt(greatest(ym - slope * xm, 0)), 4) AS read_noise, round(sqrt(greatest(ym - slope * xm, 0)) / slope, 4) AS read_noise_e FROM s WHERE slope > 0 AND n >= 3""")
def photon_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read_table(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.col("l_quantity").alias("level")).agg((F.avg("l_extendedprice") / 1000).alias("variance"), F.count(F.lit(1)).alias("n_pix"))
    fit = N.photon_transfer("level", "variance", "n_pix")
    return points.groupBy("l_linestatus").agg(fit["n"].alias("n"), *[F.round(fit[c], 4).alias(c) for c in ("gain", "read_noise", "read_noise_e")]).where("gain is not null")


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS exposure, l_extendedprice AS level, l_quantity + 100 * l_tax AS variance FROM lineitem), o AS (SELECT l_returnflag, exposure, min(level) AS low FROM r GROUP BY 1, 2),
            f AS (SELECT l_returnflag, exposure, quantile_cont(CAST(variance AS DOUBLE), 0.5) AS floor FROM r JOIN o USING (l_returnflag, exposure) WHERE level <= 1.05 * low GROUP BY 1, 2),
            e AS (SELECT l_returnflag, min(exposure) AS t0, min_by(floor, exposure) AS v0, max(exposure) AS t1, max_by(floor, exposure) AS v1 FROM f GROUP BY 1)
            SELECT l_returnflag, round(sqrt(v0), 6) AS read_noise, round(CASE WHEN v1 > v0 AND v0 > 0 AND t1 > t0 THEN (v1 - v0) * t0 / (t1 - t0) / v0 END, 6) AS dark_share FROM e""")
def dark_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").withColumn("variance", F.col("l_quantity") + 100 * F.col("l_tax"))
    out = N.dark_noise(N.dark_floor(rows, ["l_returnflag"], "l_quantity", "l_extendedprice", "variance"), ["l_returnflag"])
    return out.select("l_returnflag", *rounded({c: F.col(c) for c in ("read_noise", "dark_share")}))


LADDER = """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), x AS (SELECT user_id, m, i // m AS bin, avg(value) AS mean, count(*) AS n FROM o, (SELECT unnest([1, 2, 4, 8]) AS m) GROUP BY 1, 2, 3 HAVING count(*) = m),
            d AS (SELECT user_id, m, mean - lag(mean) OVER (PARTITION BY user_id, m ORDER BY bin) AS d FROM x), l AS (SELECT user_id, m, sqrt(avg(d * d) / 2) AS a FROM d GROUP BY 1, 2 HAVING count(*) >= 4)"""


@query(LADDER + """ SELECT user_id, CASE WHEN count(*) >= 3 THEN round(regr_slope(log10(a), log10(m)), 6) END AS slope, CASE WHEN count(*) >= 2 THEN round(max_by(a, m) FILTER (m <= 5) / (min_by(a, m) * sqrt(min(m) / CAST(max(m) FILTER (m <= 5) AS DOUBLE))), 6) END AS factor,
            CASE WHEN count(*) >= 2 THEN CAST(max(m) FILTER (m <= 5) AS DOUBLE) END AS tau_used FROM l WHERE a > 0 GROUP BY 1""")
def red_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesforge.operators.series import allan_ladder

    ladder = allan_ladder(read_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value", [1, 2, 4, 8])
    red = N.red_noise("m", "deviation", 5.0)
    return ladder.groupBy("user_id").agg(F.round(N.allan_slope("m", "deviation"), 6).alias("slope"), F.round(red["factor"], 6).alias("factor"), red["tau_used"].alias("tau_used"))


@query("""WITH n AS (SELECT CAST(ts AS DATE) AS night, quantile_cont(value, 0.5) FILTER (event_type = 'purchase') - quantile_cont(value, 0.5) FILTER (event_type IN ('click', 'view')) AS d FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY 1),
            m AS (SELECT quantile_cont(d, 0.5) AS med FROM n) SELECT count(d) AS n, round(any_value(med), 6) AS median, round(1.4826 * quantile_cont(abs(d - med), 0.5), 6) AS mad_sigma FROM n, m WHERE d IS NOT NULL""")
def band_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("night", F.col("ts").cast("date")).withColumn("all", F.lit(1))
    return N.band_offset(e, ["all"], "night", "event_type", "value", "purchase", ["click", "view"]).select("n", *rounded({c: F.col(c) for c in ("median", "mad_sigma")}))


NIGHTS = "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS night, quantile_cont(value, 0.5) AS mag FROM events GROUP BY 1, 2)"


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("night")).agg(N.median("value").alias("mag"))


@query(NIGHTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mag DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e)
            SELECT user_id, CASE WHEN any_value(n) >= 5 THEN round(quantile_cont(mag, 0.5) FILTER (r <= greatest(round_even(n * 0.2, 0), 1)), 6) END AS baseline FROM r GROUP BY 1""")
def quiescent_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.quiescent_baseline(nights(spark, sf_dir), ["user_id"], "mag", 0.2).withColumn("baseline", F.round("baseline", 6))


@query(NIGHTS + """, p AS (SELECT user_id, min(mag) AS peak, min_by(night, (mag, night)) AS peak_night FROM e GROUP BY 1), f AS (SELECT e.*, peak_night, max(CASE WHEN mag > peak + 10 AND night < peak_night THEN night END) OVER w AS a, min(CASE WHEN mag > peak + 10 AND night > peak_night THEN night END) OVER w AS b FROM e JOIN p USING (user_id) WINDOW w AS (PARTITION BY user_id))
            SELECT user_id, CAST(any_value(peak_night) AS VARCHAR) AS peak_night, CAST(min(night) AS VARCHAR) AS start, CAST(max(night) AS VARCHAR) AS stop, CAST(max(night) - min(night) + 1 AS BIGINT) AS days FROM f WHERE (a IS NULL OR night > a) AND (b IS NULL OR night < b) GROUP BY 1""")
def plateau_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.plateau_span(nights(spark, sf_dir), ["user_id"], "night", "mag", 10.0)
    return out.select("user_id", *[F.col(c).cast("string").alias(c) for c in ("peak_night", "start", "stop")], F.col("days").cast("long").alias("days"))


@query("""WITH n AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS night FROM events), g AS (SELECT user_id, night - lag(night) OVER (PARTITION BY user_id ORDER BY night) AS gap FROM n), m AS (SELECT user_id, count(*) AS n_nights, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_gap FROM g GROUP BY 1)
            SELECT user_id, count(*) AS n, round(min(value), 4) AS first, round(max(value), 4) AS last, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS bands, any_value(n_nights) AS n_nights, any_value(median_gap) AS median_gap FROM events JOIN m USING (user_id) GROUP BY 1""")
def record_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("night", F.col("ts").cast("date"))
    return N.coverage(e, ["user_id"], "value", "night", "event_type").withColumn("first", F.round("first", 4)).withColumn("last", F.round("last", 4))


@query("""WITH c AS (SELECT user_id, event_type, avg(value) AS sf FROM events GROUP BY 1, 2), m AS (SELECT event_type, quantile_cont(sf, 0.5) AS med FROM c GROUP BY 1)
            SELECT event_type, count(*) AS n, round(any_value(med), 6) AS median, CASE WHEN count(*) >= 2 THEN round(sqrt(pi() / 2) * 1.4826 * quantile_cont(abs(sf - med), 0.5) / sqrt(count(*)), 6) END AS error FROM c JOIN m USING (event_type) GROUP BY 1""")
def median_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("sf"))
    return N.median_floor(curves, ["event_type"], "sf").select("event_type", "n", *rounded({c: F.col(c) for c in ("median", "error")}))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS pending, round(CASE WHEN count(*) FILTER (o_orderstatus <> 'O') >= 200 THEN quantile_cont(o_totalprice / 10000, 0.5) FILTER (o_orderstatus <> 'O') WHEN o_orderpriority = '1-URGENT' THEN 4.5 ELSE 6.0 END, 6) AS median_s FROM orders GROUP BY 1""")
def pending_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(spark, sf_dir)[0].withColumn("median_s", F.round("median_s", 6))


@query("""SELECT round(sum(pending * median_s) / 8, 3) AS eta_s FROM (SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, CASE WHEN count(*) FILTER (o_orderstatus <> 'O') >= 200 THEN quantile_cont(o_totalprice / 10000, 0.5) FILTER (o_orderstatus <> 'O') WHEN o_orderpriority = '1-URGENT' THEN 4.5 ELSE 6.0 END AS median_s FROM orders GROUP BY o_orderpriority)""")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(spark, sf_dir)[1].withColumn("eta_s", F.round("eta_s", 3))


def pending(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read_table(spark, sf_dir, "orders").withColumn("s", F.col("o_totalprice") / 10000)
    return N.remaining_seconds(orders, "o_orderpriority", F.col("o_orderstatus") == "O", "s", {"1-URGENT": 4.5}, 8, 200)


@query("""SELECT user_id, count(*) FILTER (p < -0.1) AS n_before, count(*) FILTER (p > 0.1) AS n_after, round(max(s), 6) AS most FROM (SELECT user_id, value / 50 - 1 AS p, sqrt(pow(value / 100, 2) + coalesce(pow(CASE WHEN event_type = 'click' THEN NULL ELSE 0.02 END, 2), 0) + 0.0001) AS s FROM events) GROUP BY 1""")
def two_sided_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("s", N.total_sigma(F.col("value") / 100, F.when(F.col("event_type") != "click", F.lit(0.02)), 0.01))
    before, after = N.two_sided(F.col("value") / 50 - 1, 0.1)
    return e.groupBy("user_id").agg(before.alias("n_before"), after.alias("n_after"), F.round(F.max("s"), 6).alias("most"))
