"""Periods and thresholds by nights, comparison stars and ensembles on the driver's tables, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import ensemble as E
from seriesforge.operators import joins as J
from seriesforge.operators import periods as P
from seriesforge.plans.base import query
from seriesforge.plans.fits import days
from seriesforge.sources.tables import checkpointed, read_table

ROWS = "r AS (SELECT event_type, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS night, epoch_us(ts) / 86400000000.0 - 19723 AS x, CAST(value AS DOUBLE) AS y, 1 / pow(1 + event_id % 3, 2) AS w FROM events)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = days(spark, sf_dir).withColumn("night", F.floor(F.col("t") / 86400))
    return e.select("event_type", "night", "x", F.col("value").cast("double").alias("y"), (1 / (1 + F.col("event_id") % 3) ** 2).alias("w"))


def nights_sql(low: float, high: float, n: int) -> str:
    """CTEs r, g (rows at each frequency) and s (the projected sums of each night)."""
    sums = {"yy": "y * y", "yc": "y * c", "ys": "y * s", "cc": "c * c", "cs": "c * s", "ss": "s * s"}
    parts = ", ".join(f"sum(w * {e}) - sum(w * {e[0]}) * sum(w * {e[4]}) / sum(w) AS {k}" for k, e in sums.items())
    return f"""{ROWS}, g AS (SELECT event_type, night, k, y, w, cos(2 * pi() * f * x) AS c, sin(2 * pi() * f * x) AS s FROM r, (SELECT k, {low} + k * ({high} - {low}) / {n - 1} AS f FROM (SELECT unnest(range({n})) AS k))),
            s AS (SELECT event_type, night, k, count(*) AS n, {parts} FROM g GROUP BY 1, 2, 3)"""


def power_sql(keys: str, source: str, low: float, high: float, n: int, times: str = "1") -> str:
    """CTE p: keys, k, f, power, amplitude."""
    total = ", ".join(f"sum({times} * {c}) AS {c}" for c in P.SUMS)
    return f"""t AS (SELECT {keys}, k, {total} FROM {source} GROUP BY ALL), d AS (SELECT *, cc * ss - cs * cs AS det FROM t WHERE cc * ss - cs * cs > 1e-12 * (cc + ss) * (cc + ss)),
            p AS (SELECT {keys}, k, {low} + k * ({high} - {low}) / {n - 1} AS f, least(greatest((yc * (yc * ss - ys * cs) + ys * (ys * cc - yc * cs)) / det / yy, 0), 1) AS power, sqrt(pow((yc * ss - ys * cs) / det, 2) + pow((ys * cc - yc * cs) / det, 2)) AS amplitude FROM d)"""


@query(f"WITH {nights_sql(1.2, 2.8, 33)}, {power_sql('event_type', 's', 1.2, 2.8, 33)} SELECT event_type, CAST(k AS INTEGER) AS k, round(f, 6) AS f, round(power, 6) AS power, round(amplitude, 4) AS amplitude FROM p")
def night_projected_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = P.night_sums(rows(spark, sf_dir), ["event_type"], "night", "x", "y", "w", 1.2, 2.8, 33)
    out = P.power_of(sums, ["event_type"], 1.2, 2.8, 33)
    return out.select("event_type", "k", *[F.round(c, d).alias(c) for c, d in (("f", 6), ("power", 6), ("amplitude", 4))])


def draws_sql(source: str, key: str, unit: str, replicates: int) -> str:
    """CTE m: key, unit, rep, times."""
    return f"""u AS (SELECT {key}, {unit}, row_number() OVER (PARTITION BY {key} ORDER BY {unit}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT DISTINCT {key}, {unit} FROM {source})),
            w AS (SELECT {key}, rep, CAST('0x' || substr(md5('0|' || {key} || '|' || rep || '|' || i), 1, 8) AS BIGINT) % n AS i FROM u, (SELECT unnest(range({replicates})) AS rep)),
            m AS (SELECT w.{key}, u.{unit}, rep, count(*) AS times FROM w JOIN u ON w.{key} = u.{key} AND w.i = u.i GROUP BY 1, 2, 3)"""


@query(f"""WITH {nights_sql(1.2, 2.8, 17)}, {draws_sql('s', 'event_type', 'night', 20)}, x AS (SELECT s.*, rep, times FROM s JOIN m USING (event_type, night)), {power_sql('event_type, rep', 'x', 1.2, 2.8, 17, 'times')},
            b AS (SELECT event_type, rep, max_by(k, (power, -k)) AS k0 FROM p GROUP BY 1, 2), v AS (SELECT p.event_type, p.rep, max(CASE WHEN k = k0 - 1 THEN power END) AS l, max(CASE WHEN k = k0 THEN power END) AS c, max(CASE WHEN k = k0 + 1 THEN power END) AS h, max(CASE WHEN k = k0 THEN f END) AS f0 FROM p JOIN b USING (event_type, rep) GROUP BY 1, 2),
            z AS (SELECT event_type, 1 / (f0 + coalesce(CASE WHEN l - 2 * c + h < 0 THEN 0.5 * (l - h) / (l - 2 * c + h) END, 0) * 0.1) AS period FROM v)
            SELECT event_type, count(*) AS replicates, round(quantile_cont(period, 0.5), 5) AS period, round(stddev_samp(period), 5) AS sigma FROM z GROUP BY 1""")
def night_bootstrap_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = checkpointed(P.night_sums(rows(spark, sf_dir), ["event_type"], "night", "x", "y", "w", 1.2, 2.8, 17))
    out = P.bootstrapped_period(sums, ["event_type"], "night", 1.2, 2.8, 17, 20)
    return out.select("event_type", "replicates", F.round("period", 5).alias("period"), F.round("sigma", 5).alias("sigma"))


@query(f"""WITH q AS (SELECT l_returnflag, l_suppkey, sum(l_quantity * l_extendedprice) AS a, sum(l_quantity * l_quantity) AS b FROM lineitem GROUP BY 1, 2), {draws_sql('q', 'l_returnflag', 'l_suppkey', 40)},
            e AS (SELECT l_returnflag, rep, sum(times * a) / sum(times * b) AS r FROM q JOIN m USING (l_returnflag, l_suppkey) GROUP BY 1, 2), h AS (SELECT l_returnflag, count(*) AS units, sum(a) / sum(b) AS ratio FROM q GROUP BY 1)
            SELECT l_returnflag, any_value(units) AS units, round(any_value(ratio), 4) AS ratio, round(CASE WHEN any_value(units) >= 12 THEN stddev_samp(r) END, 4) AS sigma FROM e JOIN h USING (l_returnflag) GROUP BY 1""")
def bootstrap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-parameter fit of price to quantity by flag, with whole suppliers drawn anew."""
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    out = P.bootstrapped_ratio(read_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", q * p, q * q, 40)
    return out.select("l_returnflag", "units", F.round("ratio", 4).alias("ratio"), F.round("sigma", 4).alias("sigma"))


@query(f"""WITH r AS (SELECT event_type, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS night, value FROM events), o AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM r GROUP BY 1), q AS (SELECT event_type, night, least(CAST(floor((value - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin, count(*) AS cnt, any_value(lo) AS lo, any_value(hi) AS hi FROM r JOIN o USING (event_type) GROUP BY 1, 2, 3), {draws_sql('r', 'event_type', 'night', 20)},
            h AS (SELECT event_type, rep, bin, sum(cnt * times) AS c, any_value(lo) AS lo, any_value(hi) AS hi FROM q JOIN m USING (event_type, night) GROUP BY 1, 2, 3),
            s AS (SELECT *, CAST(sum(c) OVER u AS DOUBLE) AS w0, CAST(sum(c) OVER g AS DOUBLE) AS w, CAST(sum(c * bin) OVER u AS DOUBLE) AS s0, CAST(sum(c * bin) OVER g AS DOUBLE) AS st, lead(bin) OVER u AS nxt FROM h WINDOW u AS (PARTITION BY event_type, rep ORDER BY bin), g AS (PARTITION BY event_type, rep)),
            k AS (SELECT event_type, rep, bin, lo + ((bin + nxt + 1) / 2) * (hi - lo) / 64 AS cut, round(pow(s0 * (w - w0) - (st - s0) * w0, 2) / (w0 * (w - w0)), 6) AS score FROM s WHERE w0 < w),
            b AS (SELECT event_type, rep, max_by(cut, (score, -bin)) AS cut FROM k GROUP BY 1, 2) SELECT event_type, count(*) AS replicates, round(avg(cut), 5) AS threshold, round(stddev_samp(cut), 5) AS sigma FROM b GROUP BY 1""")
def bootstrap_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.bootstrapped_threshold(rows(spark, sf_dir), ["event_type"], "night", "y", 20)
    return out.select("event_type", "replicates", F.round("threshold", 5).alias("threshold"), F.round("sigma", 5).alias("sigma"))


@query(f"WITH {ROWS} SELECT event_type, o AS \"order\", round(pow(avg(cos(2 * pi() * o * x)), 2) + pow(avg(sin(2 * pi() * o * x)), 2), 8) AS fraction FROM r, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS o) GROUP BY 1, 2")
def alias_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.alias_fractions(rows(spark, sf_dir), ["event_type"], "x").withColumn("fraction", F.round("fraction", 8))


@query(f"""WITH {nights_sql(1.2, 2.8, 33)}, {power_sql('event_type', 's', 1.2, 2.8, 33)}, b AS (SELECT event_type, max_by(k, (power, -k)) AS k0, max_by(f, (power, -k)) AS f0, max(power) AS top FROM p GROUP BY 1),
            e AS (SELECT event_type, any_value(f0) AS f, coalesce(max(CASE WHEN power < top / 2 AND k < k0 THEN k END) + 1, min(k)) AS l, coalesce(min(CASE WHEN power < top / 2 AND k > k0 THEN k END) - 1, max(k)) AS r FROM p JOIN b USING (event_type) GROUP BY 1)
            SELECT event_type, round(f, 6) AS f, round((r - l) * 0.05 / 2, 6) AS half_width FROM e""")
def peak_half_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = P.night_sums(rows(spark, sf_dir), ["event_type"], "night", "x", "y", "w", 1.2, 2.8, 33)
    out = P.half_widths(P.power_of(sums, ["event_type"], 1.2, 2.8, 33), ["event_type"])
    return out.select("event_type", F.round("f", 6).alias("f"), F.round("half_width", 6).alias("half_width"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    return li.groupBy("l_returnflag", (F.col("l_suppkey") % 50).alias("star"), F.month("l_shipdate").alias("frame")).agg(F.avg(-2.5 * F.log10("l_extendedprice")).alias("mag"), (1.0857 / F.sqrt(F.count(F.lit(1)))).alias("sigma"))


@query()
def ensemble_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds until nothing moves; held against numpy in the tests."""
    return E.ensembles(cells(spark, sf_dir), "l_returnflag", "star", "frame", "mag", "sigma")


@query()
def comparison_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruning to a fixed point; held against a matrix version in the tests."""
    return E.comparison_stars(cells(spark, sf_dir), "l_returnflag", "star", "frame", "mag", "sigma", is_target=F.col("star") == 0)


@query("""WITH r AS (SELECT l_linestatus, l_suppkey % 30 AS star, month(l_shipdate) * 100 + l_orderkey % 9 AS frame, CAST(l_quantity AS DOUBLE) AS y FROM lineitem), f AS (SELECT l_linestatus, count(DISTINCT frame) AS nf FROM r GROUP BY 1), c AS (SELECT l_linestatus, star FROM r JOIN f USING (l_linestatus) GROUP BY 1, 2 HAVING count(DISTINCT frame) >= 0.8 * any_value(nf)),
            m AS (SELECT l_linestatus, star, quantile_cont(y, 0.5) AS m FROM r JOIN c USING (l_linestatus, star) WHERE y > 0 GROUP BY 1, 2), s AS (SELECT l_linestatus, frame, sum(y) AS a, sum(m) AS b, count(*) AS n FROM r JOIN m USING (l_linestatus, star) WHERE y > 0 GROUP BY 1, 2)
            SELECT l_linestatus, frame, round(a / b, 6) AS ratio, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_linestatus, frame FROM r) LEFT JOIN s USING (l_linestatus, frame)""")
def ensemble_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_suppkey") % 30).alias("star"), (F.month("l_shipdate") * 100 + F.col("l_orderkey") % 9).alias("frame"), F.col("l_quantity").cast("double").alias("y"))
    return E.flux_ratio(li, ["l_linestatus"], "star", "frame", "y").withColumn("ratio", F.round("ratio", 6))


@query()
def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one pairs within each label, of what a cell join finds."""
    from seriesforge.plans.catalog import angles

    a = angles(spark, sf_dir)
    left, right = a.where("vec_id % 2 = 0"), a.where("vec_id % 2 = 1").select(F.col("vec_id").alias("other"), F.col("label").alias("label2"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return J.greedy_pairs(J.plane_join(left, right, "ra", "dec", "ra2", "dec2", 1.0).where("label = label2"), "label", "vec_id", "other", "dist")
