"""Robust statistics, intervals, tests, series and periods on the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import robust as R
from seriesforge.operators import series as T
from seriesforge.plans.base import query, timed
from seriesforge.sources.tables import read_table

NIGHT = "CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT)"


@query("""WITH m AS (SELECT l_returnflag AS flag, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) AS med FROM lineitem GROUP BY 1)
            SELECT flag, count(*) AS n, round(any_value(med), 4) AS median, round(1.4826 * quantile_cont(abs(l_extendedprice - med), 0.5), 4) AS mad_sigma FROM lineitem JOIN m ON flag = l_returnflag GROUP BY flag""")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = R.median_and_mad(li, ["flag"], "l_extendedprice")
    return out.select("flag", "n", F.round("median", 4).alias("median"), F.round("mad_sigma", 4).alias("mad_sigma"))


@query("""SELECT user_id, CASE WHEN count(value) >= 5 THEN round(quantile_cont(CAST(value AS DOUBLE), 0.95) - quantile_cont(CAST(value AS DOUBLE), 0.05), 6) END AS amplitude, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1""")
def percentile_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.round(R.percentile_amplitude("value"), 6).alias("amplitude"), F.round(R.rms("value"), 6).alias("rms"))


@query("""WITH m AS (SELECT event_type, quantile_cont(CAST(value AS DOUBLE), 0.5) AS med FROM events GROUP BY 1), s AS (SELECT e.event_type, any_value(med) AS med, 1.4826 * quantile_cont(abs(value - med), 0.5) AS s FROM events e JOIN m USING (event_type) GROUP BY 1)
            SELECT event_type, count(*) AS n, count(*) FILTER (abs(value - med) <= 2 * s) AS n_kept, round(avg(value) FILTER (abs(value - med) <= 2 * s), 6) AS mean, round(stddev_samp(value) FILTER (abs(value - med) <= 2 * s), 6) AS sd FROM events JOIN s USING (event_type) GROUP BY 1""")
def clipped_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.clipped_stats(read_table(spark, sf_dir, "events"), ["event_type"], "value", 2.0)
    return out.select("event_type", "n", "n_kept", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""SELECT l_linestatus, CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS median FROM lineitem GROUP BY 1, 2""")
def binned_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.binned_median(read_table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice", 5.0).withColumn("median", F.round("median", 4))


@query("""WITH b AS (SELECT value, length(props) AS y, CASE WHEN value >= 0 AND value < 20 THEN 0 WHEN value >= 20 AND value < 60 THEN 1 WHEN value >= 60 AND value < 200 THEN 2 WHEN value >= 200 AND value < 400 THEN 3 WHEN value >= 400 AND value < 1e9 THEN 4 END AS bin FROM events),
            f AS (SELECT max(bin) AS last FROM (SELECT bin FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 50))
            SELECT CAST(least(bin, coalesce(last + 1, 0)) AS INTEGER) AS bin, count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS median FROM b, f WHERE bin IS NOT NULL GROUP BY 1""")
def pooled_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.pooled_tail_median(read_table(spark, sf_dir, "events").withColumn("y", F.col("value")), "value", "y", [0.0, 20.0, 60.0, 200.0, 400.0, 1e9], 50)
    return out.withColumn("median", F.round("median", 6))


@query("""WITH c AS (SELECT source, count(*) AS n, sum(toxic) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), w AS (SELECT source, n, CAST(k AS BIGINT) AS k, k / CAST(n AS DOUBLE) AS p, 3.8414588206941254 AS z2, 1.959963984540054 AS z FROM c)
            SELECT source, n, k, round(greatest(((p + z2 / (2 * n)) - z * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 0), 6) AS low, round(least(((p + z2 / (2 * n)) + z * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 1), 6) AS high FROM w""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, d = read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents").select("doc_id", "source")
    c = lab.join(d, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    low, high = R.wilson("k", "n")
    return c.select("source", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""SELECT n1, n2, round((k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z FROM (
            SELECT CAST(sum(quality) AS DOUBLE) AS n1, CAST(sum(1 - quality) AS DOUBLE) AS n2, CAST(sum(quality * toxic) AS DOUBLE) AS k1, CAST(sum((1 - quality) * toxic) AS DOUBLE) AS k2 FROM labels)""")
def proportion_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    c = read_table(spark, sf_dir, "labels").agg(F.sum(q).cast("double").alias("n1"), F.sum(1 - q).cast("double").alias("n2"), F.sum(q * t).cast("double").alias("k1"), F.sum((1 - q) * t).cast("double").alias("k2"))
    return c.select("n1", "n2", F.round(R.two_proportion_z("k1", "n1", "k2", "n2"), 6).alias("z"))


@query("""WITH x AS (SELECT n_chars AS v, quality = 1 AS a FROM labels JOIN documents USING (doc_id)), r AS (SELECT a, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) AS rk, count(*) OVER (PARTITION BY v) AS t FROM x),
            s AS (SELECT CAST(count(*) FILTER (a) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS n2, CAST(sum(rk) FILTER (a) AS DOUBLE) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r)
            SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s""")
def rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    x = read_table(spark, sf_dir, "labels").join(d, "doc_id")
    return R.mann_whitney(x, "n_chars", F.col("quality") == 1).select("n1", "n2", F.round("u", 4).alias("u"), F.round("z", 6).alias("z"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1""")
def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = R.line_fit("l_quantity", "l_extendedprice")
    return read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(fit["slope"], 4).alias("slope"), F.round(fit["intercept"], 3).alias("intercept"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"))


@query("""SELECT l_suppkey, round(sum(l_extendedprice / pow(l_quantity, 2)) / sum(1 / pow(l_quantity, 2)), 4) AS mean, round(sqrt(1 / sum(1 / pow(l_quantity, 2))), 6) AS error FROM lineitem GROUP BY 1""")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(R.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("mean"), F.round(R.weighted_mean_error("l_quantity"), 6).alias("error"))


@query("""WITH s AS (SELECT lang, n_chars // 500 AS t, count(*) FILTER (source <> 'src0') AS events, count(*) AS leaving FROM documents GROUP BY 1, 2), r AS (SELECT *, sum(leaving) OVER (PARTITION BY lang ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM s)
            SELECT lang, t, CAST(at_risk AS BIGINT) AS at_risk, events, round(CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events = at_risk THEN 0 ELSE ln(1 - events / CAST(at_risk AS DOUBLE)) END) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY lang ORDER BY t)""")
def product_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").withColumn("t", F.floor(F.col("n_chars") / 500))
    return R.kaplan_meier(d, ["lang"], "t", F.col("source") != "src0").withColumn("survival", F.round("survival", 6))


@query("""WITH sp AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), h AS (SELECT event_type, least(CAST(floor((value - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM events JOIN sp USING (event_type) WHERE hi > lo GROUP BY 1, 2),
            m AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 64 AS mid FROM h), c AS (SELECT *, sum(n) OVER w AS w0, sum(n * mid) OVER w AS s0, sum(n) OVER (PARTITION BY event_type) AS nn, sum(n * mid) OVER (PARTITION BY event_type) AS ss FROM m WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
            s AS (SELECT event_type, lo + (bin + 1) * (hi - lo) / 64 AS edge, round(w0 * (nn - w0) * pow(s0 / w0 - (ss - s0) / (nn - w0), 2), 6) AS score, bin FROM c WHERE nn > w0)
            SELECT event_type, round(edge, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, bin) AS r FROM s) WHERE r = 1""")
def two_state_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.otsu(read_table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("threshold", F.round("threshold", 6))


@query("""SELECT user_id, round((atan2(s, c) / (2 * pi())) - floor(atan2(s, c) / (2 * pi())), 6) AS mean_phase, round(sqrt(-2 * ln(sqrt(s * s + c * c))) / (2 * pi()), 6) AS spread FROM (
            SELECT user_id, avg(sin(2 * pi() * p)) AS s, avg(cos(2 * pi() * p)) AS c FROM (SELECT user_id, epoch_us(ts) / 86400000000.0 - floor(epoch_us(ts) / 86400000000.0) AS p FROM events) GROUP BY 1)""")
def phase_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed(read_table(spark, sf_dir, "events")).withColumn("p", F.col("t") / 86400 - F.floor(F.col("t") / 86400))
    mean, spread = R.circular_mean("p")
    return e.groupBy("user_id").agg(F.round(mean, 6).alias("mean_phase"), F.round(spread, 6).alias("spread"))


@query("""SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN toxic = 1 THEN CASE WHEN n_chars < threshold THEN 1.0 ELSE 0 END END), 6) AS bad_rate, round(avg(CASE WHEN toxic = 0 THEN CASE WHEN n_chars < threshold THEN 1.0 ELSE 0 END END), 6) AS good_rate
            FROM labels JOIN documents USING (doc_id), (SELECT unnest([200.0, 500.0, 1000.0, 3000.0]) AS threshold) GROUP BY 1""")
def roc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = R.roc(x, "n_chars", F.col("toxic") == 1, [200.0, 500.0, 1000.0, 3000.0])
    return out.select("threshold", F.round("bad_rate", 6).alias("bad_rate"), F.round("good_rate", 6).alias("good_rate"))


@query("""SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2""")
def additive_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of two halves of the rows, merged."""
    e = read_table(spark, sf_dir, "events")
    half = lambda p: R.value_histogram(e.where(p), ["event_type"], "value", 10.0)
    return R.merge_histograms(half("event_id % 2 = 0"), half("event_id % 2 = 1"))


BLOCKS = """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 36000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS block FROM g)"""


@query(BLOCKS + " SELECT user_id, CAST(block AS BIGINT) AS block, count(*) AS n, round(min(t), 3) AS start, round(max(t), 3) AS stop, round(max(t) - min(t), 3) AS span FROM b GROUP BY 1, 2")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.block_stats(T.sessions(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", 36000.0, "event_id"), ["user_id"], "t")
    return out.select("user_id", "block", "n", *[F.round(c, 3).alias(c) for c in ("start", "stop", "span")])


@query(BLOCKS + " SELECT user_id, n, round(start, 3) AS start, round(stop, 3) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, block) AS r FROM (SELECT user_id, block, count(*) AS n, min(t) AS start, max(t) AS stop FROM b GROUP BY 1, 2)) WHERE r = 1")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.longest_run(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", 36000.0, "event_id")
    return out.select("user_id", "n", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), f AS (SELECT user_id, count(*) AS n, max(t) - min(t) AS baseline, quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) AS median_gap FROM g GROUP BY 1)
            SELECT user_id, any_value(n) AS n, round(any_value(baseline), 3) AS baseline, round(any_value(median_gap), 3) AS median_gap, round(avg(CASE WHEN gap > 0 THEN CASE WHEN gap BETWEEN 0.5 * median_gap AND 3 * median_gap THEN 1.0 ELSE 0 END END), 6) AS in_band FROM g JOIN f USING (user_id) GROUP BY user_id""")
def cadence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.cadence(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "event_id")
    return out.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("baseline", "median_gap")], F.round("in_band", 6).alias("in_band"))


@query("""SELECT event_id, round(r, 6) AS running, round(value / nullif(r, 0), 6) AS ratio, coalesce(value / nullif(r, 0) < 0.3, false) AS veto FROM (SELECT event_id, value, quantile_cont(CAST(value AS DOUBLE), 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS r FROM events)""")
def running_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.relative_veto(T.running_median(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "event_id", "value", 3), "value", "running", 0.3)
    return out.select("event_id", F.round("running", 6).alias("running"), F.round("ratio", 6).alias("ratio"), "veto")


@query("""SELECT event_id, round(value - quantile_cont(CAST(value AS DOUBLE), 0.5) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING), 6) AS detrended FROM events""")
def range_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.running_median_range(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "value", 86400.0)
    return out.select("event_id", F.round(F.col("value") - F.col("running"), 6).alias("detrended"))


@query(f"""SELECT event_id, round(CASE WHEN count(*) OVER w >= 2 THEN value - avg(value) OVER w END, 6) AS residual FROM events WINDOW w AS (PARTITION BY user_id, {NIGHT})""")
def nightly_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed(read_table(spark, sf_dir, "events")).withColumn("night", F.floor(F.col("t") / 86400))
    return T.without_block_means(e, ["user_id", "night"], "value").select("event_id", F.round("residual", 6).alias("residual"))


@query("""SELECT event_id, round(abs(CASE WHEN hb IS NOT NULL AND hf IS NOT NULL THEN (hb * hb * xf + (hf * hf - hb * hb) * value - hf * hf * xb) / nullif(hb * hf * (hb + hf), 0) ELSE coalesce((xf - value) / nullif(hf, 0), (value - xb) / nullif(hb, 0)) END), 8) AS rate FROM (
            SELECT event_id, value, t - lag(t) OVER w AS hb, lead(t) OVER w - t AS hf, lag(value) OVER w AS xb, lead(value) OVER w AS xf FROM (SELECT *, epoch_us(ts) / 1e6 AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rate_of_change(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "event_id", "value").select("event_id", F.round("rate", 8).alias("rate"))


@query("""WITH o AS (SELECT event_id, user_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a.event_id, b.value AS rolled FROM o a JOIN o b ON a.user_id = b.user_id AND a.i = (b.i + 5) % b.n""")
def rolled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cyclic_shift(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "event_id", "value", 5).select("event_id", "rolled")


@query("""WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), x AS (SELECT user_id, m, i // m AS bin, avg(value) AS mean, count(*) AS n FROM o, (SELECT unnest([1, 2, 4, 8]) AS m) GROUP BY 1, 2, 3 HAVING count(*) = m),
            d AS (SELECT user_id, m, mean - lag(mean) OVER (PARTITION BY user_id, m ORDER BY bin) AS d FROM x) SELECT user_id, m, count(*) AS bins, round(sqrt(avg(d * d) / 2), 6) AS deviation FROM d GROUP BY 1, 2 HAVING count(*) >= 4""")
def allan_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.allan_ladder(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "event_id", "value", [1, 2, 4, 8]).withColumn("deviation", F.round("deviation", 6))


@query("""WITH e AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t FROM events), p AS (SELECT a.user_id, b.t - a.t AS lag, b.value - a.value AS d FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.t - a.t < 200000)
            SELECT user_id, CAST(CASE WHEN lag < 10000 THEN 0 WHEN lag < 50000 THEN 1 ELSE 2 END AS INTEGER) AS lag_bin, count(*) AS pairs, round(sqrt(avg(d * d) / 2), 6) AS sf FROM p WHERE lag >= 1 GROUP BY 1, 2 HAVING count(*) >= 10""")
def structure_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.structure_function(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "value", [1.0, 10000.0, 50000.0, 200000.0]).withColumn("sf", F.round("sf", 6))


@query("""WITH i AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events WHERE value > 50), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 172800 THEN 1 ELSE 0 END AS new FROM i), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS block FROM g)
            SELECT user_id, round(min(t), 3) AS start, round(max(t), 3) AS stop, count(*) AS n, max(value) AS peak, round(max_by(t, (value, -event_id)), 3) AS peak_at FROM b GROUP BY user_id, block""")
def outburst_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.episodes(timed(read_table(spark, sf_dir, "events")), ["user_id"], "t", "event_id", "value", F.col("value") > 50, 172800.0)
    return out.select("user_id", *[F.round(c, 3).alias(c) for c in ("start", "stop")], "n", "peak", F.round("peak_at", 3).alias("peak_at"))


@query("""SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END), 6) AS naive, round(avg(CASE WHEN value > 10 THEN CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END END), 6) AS aware FROM events GROUP BY 1""")
def duty_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.duty_cycle(read_table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "purchase", F.col("value") > 10)
    return out.select("user_id", F.round("naive", 6).alias("naive"), F.round("aware", 6).alias("aware"))


DAYS = "SELECT event_type, value, epoch_us(ts) / 86400000000.0 - 19723 AS x FROM events"
GRID = "(SELECT k, 0.5 + k * (2.0 / 39) AS f FROM (SELECT unnest(range(40)) AS k))"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(read_table(spark, sf_dir, "events")).withColumn("x", F.col("t") / 86400 - 19723)


@query(f"""SELECT event_type, CAST(k AS INTEGER) AS k, round(any_value(f), 6) AS f, round((pow(sum(cos(2 * pi() * f * x)), 2) + pow(sum(sin(2 * pi() * f * x)), 2)) / pow(count(*), 2), 6) AS power FROM ({DAYS}), {GRID} GROUP BY 1, 2""")
def window_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.spectral_window(days(spark, sf_dir), ["event_type"], "x", 0.5, 2.5, 40)
    return out.select("event_type", "k", F.round("f", 6).alias("f"), F.round("power", 6).alias("power"))


PERIODOGRAM = f"""p AS (SELECT event_type, k, any_value(f) AS f, avg(value) AS y, avg(cos(2 * pi() * f * x)) AS c, avg(sin(2 * pi() * f * x)) AS s, avg(value * value) AS yy, avg(value * cos(2 * pi() * f * x)) AS yc, avg(value * sin(2 * pi() * f * x)) AS ys,
            avg(pow(cos(2 * pi() * f * x), 2)) AS cc, avg(cos(2 * pi() * f * x) * sin(2 * pi() * f * x)) AS cs FROM ({DAYS}), {GRID} GROUP BY 1, 2),
            q AS (SELECT event_type, k, f, yy - y * y AS yy, yc - y * c AS yc, ys - y * s AS ys, cc - c * c AS cc, cs - c * s AS cs, 1 - cc - s * s AS ss FROM p), r AS (SELECT event_type, k, f, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) AS power FROM q)"""


@query(f"WITH {PERIODOGRAM} SELECT event_type, CAST(k AS INTEGER) AS k, round(f, 6) AS f, round(power, 6) AS power FROM r")
def least_squares_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.periodogram(days(spark, sf_dir), ["event_type"], "x", "value", None, 0.5, 2.5, 40)
    return out.select("event_type", "k", F.round("f", 6).alias("f"), F.round("power", 6).alias("power"))


@query(f"""WITH {PERIODOGRAM}, b AS (SELECT event_type, max_by(k, (power, -k)) AS k0 FROM r GROUP BY 1), n AS (SELECT r.event_type, max(CASE WHEN k = k0 - 1 THEN power END) AS l, max(CASE WHEN k = k0 THEN power END) AS m, max(CASE WHEN k = k0 + 1 THEN power END) AS h, max(CASE WHEN k = k0 THEN f END) AS f0 FROM r JOIN b USING (event_type) GROUP BY 1)
            SELECT event_type, round(f0 + coalesce(CASE WHEN l - 2 * m + h < 0 THEN 0.5 * (l - h) / (l - 2 * m + h) END, 0) * (2.0 / 39), 5) AS f, round(m, 6) AS power FROM n""")
def refined_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = T.periodogram(days(spark, sf_dir), ["event_type"], "x", "value", None, 0.5, 2.5, 40)
    return T.refine_peak(grid, ["event_type"], 2.0 / 39).select("event_type", F.round("f", 5).alias("f"), F.round("power", 6).alias("power"))


@query(f"""WITH b AS (SELECT event_type, f, floor((x * f - floor(x * f)) * 10) AS bin, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM ({DAYS}), (SELECT unnest([1.0, 1.37, 2.0]) AS f) GROUP BY 1, 2, 3)
            SELECT event_type, CAST(f AS DOUBLE) AS f, round((sum(q - s * s / n) / (sum(n) - count(*))) / ((sum(q) - pow(sum(s), 2) / sum(n)) / (sum(n) - 1)), 6) AS theta FROM b GROUP BY 1, 2""")
def phase_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dispersion_theta(days(spark, sf_dir), ["event_type"], "x", "value", [1.0, 1.37, 2.0]).withColumn("theta", F.round("theta", 6))


@query("""WITH a AS (SELECT l_linestatus AS s, l_returnflag AS f, l_shipmonth AS m, x FROM (SELECT l_linestatus, l_returnflag, month(l_shipdate) AS l_shipmonth, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2, 3)), r1 AS (SELECT *, x - avg(x) OVER (PARTITION BY s || f) AS y FROM a)
            SELECT s || f AS cell, CAST(m AS INTEGER) AS m, round(y - avg(y) OVER (PARTITION BY m), 4) AS residual FROM r1""")
def two_way_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("cell"), F.month("l_shipdate").alias("m")).agg(F.avg("l_extendedprice").alias("x"))
    return T.two_way_residual(a, "cell", "m", "x", 1).select("cell", "m", F.round("residual", 4).alias("residual"))
