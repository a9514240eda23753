"""Least-squares fits on the driver's tables. The SQL writes the same sums out, round by round where a fit iterates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import fitting as L
from seriesforge.plans.base import query, timed
from seriesforge.plans.surface import rounded
from seriesforge.sources.tables import read_table

CLIPPED = "CASE WHEN abs(d - med) <= 4.0 * mad OR mad <= 0 THEN 1.0 ELSE 0.0 END"
HUBER = "CASE WHEN coalesce(mad, 0) <= 0 OR abs(d) <= 1.345 * mad THEN 1.0 ELSE 1.345 * mad / abs(d) END"


def lines_sql(rows: str, rounds: int, weight: str, intercept: bool = True, first: str = "") -> str:
    """CTEs r0 (key, x, y, w0, w), then f0 .. of each round: key, n, sw, mx, my, b, sxx, rss."""
    out = [first + f"r0 AS (SELECT *, w AS w0 FROM ({rows}))"]
    centre = "sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my" if intercept else "0.0 AS mx, 0.0 AS my"
    for p in range(rounds + 1):
        out.append(f"m{p} AS (SELECT key, {centre} FROM r{p} WHERE w > 0 GROUP BY 1)")
        out.append(f"""f{p} AS (SELECT key, n, sw, mx, my, sxy / sxx AS b, sxx, syy - sxy * sxy / sxx AS rss FROM (SELECT r.key, count(*) AS n, sum(w) AS sw, any_value(mx) AS mx, any_value(my) AS my,
            sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (y - my) * (y - my)) AS syy FROM r{p} r JOIN m{p} m ON r.key IS NOT DISTINCT FROM m.key WHERE w > 0 GROUP BY 1))""")
        if p < rounds:
            out.append(f"d{p} AS (SELECT r.key, x, y, w0, y - (my + b * (x - mx)) AS d FROM r{p} r JOIN f{p} f ON r.key IS NOT DISTINCT FROM f.key)")
            out.append(f"q{p} AS (SELECT key, quantile_cont(d, 0.5) AS med FROM d{p} GROUP BY 1)")
            out.append(f"s{p} AS (SELECT d.key, any_value(med) AS med, 1.4826 * quantile_cont(abs(d - med), 0.5) AS mad FROM d{p} d JOIN q{p} q ON d.key IS NOT DISTINCT FROM q.key GROUP BY 1)")
            out.append(f"r{p + 1} AS (SELECT d.key, x, y, w0, w0 * {weight} AS w FROM d{p} d JOIN s{p} s ON d.key IS NOT DISTINCT FROM s.key)")
    return "WITH " + ",\n".join(out)


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS c0, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz,
            var_pop(l_extendedprice) AS zz, max(l_quantity) - min(l_quantity) AS sx, max(l_discount) - min(l_discount) AS sy FROM lineitem GROUP BY 1), b AS (SELECT *, xx * yy - xy * xy AS det, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS cx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS cy FROM s),
            e AS (SELECT *, zz - cx * xz - cy * yz AS ms FROM b), f AS (SELECT *, sqrt(ms * n / (n - 3) * yy / det / n) AS cx_err, sqrt(ms * n / (n - 3) * xx / det / n) AS cy_err FROM e)
            SELECT l_returnflag, n, round(c0, 4) AS c0, round(cx, 4) AS cx, round(cy, 2) AS cy, round(cx_err, 6) AS cx_err, round(cy_err, 3) AS cy_err, round(sqrt(ms), 4) AS rms, round(abs(cx) * sx + abs(cy) * sy, 2) AS swing, round(greatest(abs(cx) / cx_err, abs(cy) / cy_err), 2) AS significance, greatest(abs(cx) / cx_err, abs(cy) / cy_err) >= 3 AS significant FROM f""")
def plane_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.plane_fit(read_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice")
    digits = {"c0": 4, "cx": 4, "cy": 2, "cx_err": 6, "cy_err": 3, "rms": 4, "swing": 2, "significance": 2}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


PAIRS = "SELECT l_linestatus, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount * 100 AS DOUBLE) AS y, l_extendedprice / 1000.0 AS u, CAST(l_tax * 100 AS DOUBLE) AS v FROM lineitem"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("double") / 1000
    return read_table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y"), price.alias("u"), (F.col("l_tax") * 100).cast("double").alias("v"))


@query(f"""WITH s AS (SELECT l_linestatus, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, var_pop(u) AS uu, var_pop(v) AS vv FROM ({PAIRS}) GROUP BY 1),
            b AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS d, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS e FROM s)
            SELECT l_linestatus, n, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx - b * my, 5) AS c, round(d, 6) AS d, round(e, 6) AS e, round(mv - d * mx - e * my, 5) AS f, round(sqrt(uu - a * xu - b * yu + vv - d * xv - e * yv), 6) AS rms FROM b""")
def affine_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.affine_fit(pairs(spark, sf_dir), ["l_linestatus"], "x", "y", "u", "v")
    return out.withColumns({c: F.round(c, 5 if c in "cf" else 6) for c in ("a", "b", "c", "d", "e", "f", "rms")})


@query(f"""WITH s AS (SELECT l_linestatus, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) + var_pop(y) AS s, var_pop(u) + var_pop(v) AS t, covar_pop(x, u) + covar_pop(y, v) AS p, covar_pop(x, v) - covar_pop(y, u) AS q FROM ({PAIRS}) GROUP BY 1), b AS (SELECT *, p / s AS a, q / s AS b FROM s)
            SELECT l_linestatus, n, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx + b * my, 5) AS tx, round(mv - b * mx - a * my, 5) AS ty, round(sqrt(a * a + b * b), 6) AS scale, round(degrees(atan2(b, a)), 5) AS rotation_deg, round(sqrt(t - (a * a + b * b) * s), 6) AS rms FROM b""")
def similarity_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.similarity_fit(pairs(spark, sf_dir), ["l_linestatus"], "x", "y", "u", "v")
    return out.withColumns({c: F.round(c, 5 if c in ("tx", "ty", "rotation_deg") else 6) for c in ("a", "b", "tx", "ty", "scale", "rotation_deg", "rms")})


@query(lines_sql("SELECT l_returnflag AS key, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000.0 - l_tax AS y, 1 / pow(0.5 + l_discount, 2) AS w FROM lineitem", 2, CLIPPED)
       + """, h AS (SELECT key, quantile_cont(x, 0.5) AS x_ref FROM r0 GROUP BY 1)
            SELECT f.key AS l_returnflag, n, round(my + b * (x_ref - mx), 5) AS a, round(sqrt(1 / sw + (x_ref - mx) * (x_ref - mx) / sxx) * sqrt(greatest(rss / (n - 2), 1)), 6) AS a_err, round(b, 6) AS b, round(sqrt(1 / sxx) * sqrt(greatest(rss / (n - 2), 1)), 7) AS b_err, x_ref, round(rss / (n - 2), 4) AS chi2nu FROM f2 f JOIN h USING (key)""")  # fmt: skip
def transform_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_tax").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") / 1000).alias("b"), "l_quantity", (F.col("l_discount") + 0.5).cast("double").alias("sigma"))
    out = L.transform_fit(rows, ["l_returnflag"], "a", "b", "l_quantity", F.col("sigma"))
    return out.withColumns({c: F.round(c, d) for c, d in {"a": 5, "a_err": 6, "b": 6, "b_err": 7, "chi2nu": 4}.items()})


CELLS = "SELECT l_returnflag AS key, l_suppkey % 40 AS star, month(l_shipdate) AS frame, avg(l_extendedprice) / 1000 AS y, 1 / pow(0.5 + avg(l_discount), 2) AS w, avg(l_quantity) AS c, avg(l_tax) AS a FROM lineitem GROUP BY 1, 2, 3"


def sweeps_sql(sweeps: int) -> str:
    """CTE z: key, x, y, w with x less the effects of star and frame, made in turns."""
    out = [f"g AS ({CELLS})", "h AS (SELECT key, count(*) AS all_n, quantile_cont(c, 0.5) AS c0, quantile_cont(a, 0.5) AS a0 FROM g GROUP BY 1)", "p AS (SELECT key, star, frame, (c - c0) * (a - a0) AS x, y, w FROM g JOIN h USING (key))", "b0 AS (SELECT DISTINCT key, frame, 0.0 AS e FROM p)"]
    for i in range(sweeps):
        out.append(f"a{i + 1} AS (SELECT key, star, avg(x - e) AS e FROM p JOIN b{i} USING (key, frame) GROUP BY 1, 2)")
        out.append(f"b{i + 1} AS (SELECT key, frame, avg(x - e) AS e FROM p JOIN a{i + 1} USING (key, star) GROUP BY 1, 2)")
    out.append(f"z AS (SELECT p.key, x - a.e - b.e AS x, y, w FROM p JOIN a{sweeps} a USING (key, star) JOIN b{sweeps} b USING (key, frame))")
    return ",\n".join(out) + ",\n"


@query(lines_sql("SELECT * FROM z", 2, CLIPPED, intercept=False, first=sweeps_sql(4))
       + """ SELECT key AS l_returnflag, n, all_n - n AS n_clipped, round(b, 4) AS kpp, round(sqrt(1 / sxx) * sqrt(greatest(rss / (n - 1), 1)), 4) AS kpp_err, round(rss / (n - 1), 3) AS chi2nu, round(c0, 6) AS colour_ref, round(a0, 6) AS airmass_ref, round(b / (sqrt(1 / sxx) * sqrt(greatest(rss / (n - 1), 1))), 4) AS t_stat,
            abs(b / (sqrt(1 / sxx) * sqrt(greatest(rss / (n - 1), 1)))) >= 3 AS significant, round(1000 * 3 * sqrt(1 / sxx) * sqrt(greatest(rss / (n - 1), 1)) * 1.5 / 2 * 0.5 / 2, 0) AS bound_mmag FROM f2 JOIN h USING (key)""")  # fmt: skip
def colour_extinctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    avg = lambda c: F.avg(F.col(c).cast("double"))
    cells = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_suppkey") % 40).alias("star"), F.month("l_shipdate").alias("frame")).agg((avg("l_extendedprice") / 1000).alias("y"), (avg("l_discount") + 0.5).alias("sigma"), avg("l_quantity").alias("c"), avg("l_tax").alias("a"))
    out = L.colour_extinction(cells, ["l_returnflag"], "y", "sigma", "c", "a", "star", "frame").withColumn("bound_mmag", F.round(L.bound_mmag("kpp_err", F.lit(1.5), F.lit(0.5)), 0))
    return out.withColumns({c: F.round(c, d) for c, d in {"kpp": 4, "kpp_err": 4, "chi2nu": 3, "colour_ref": 6, "airmass_ref": 6, "t_stat": 4}.items()})


DAYS = "SELECT user_id AS key, epoch_us(ts) / 86400000000.0 - 19723 AS x, CAST(value AS DOUBLE) AS y, 1.0 AS w FROM events"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(read_table(spark, sf_dir, "events")).withColumn("x", F.col("t") / 86400 - 19723)


@query(lines_sql(f"SELECT * FROM ({DAYS}) QUALIFY count(*) OVER (PARTITION BY key) >= 3", 5, HUBER) + " SELECT key AS user_id, n, round(b, 6) AS slope, round(my - b * mx, 5) AS intercept FROM f5")
def robust_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huber lines by user, five rounds of weights."""
    out = L.robust_lines(days(spark, sf_dir), "user_id", "x", "value", 5).where("n >= 3")
    return out.select("user_id", "n", *rounded({"slope": F.col("slope")}), F.round("intercept", 5).alias("intercept"))


@query()
def harmonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four regressors by user; held against numpy's least squares in the tests."""
    return L.harmonic_fits(days(spark, sf_dir), "user_id", "x", "value", 1.0)
