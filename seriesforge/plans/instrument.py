"""Frame pairs, pile-ups, ladders, offsets and sky ranges on the driver's tables, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import instrument as I
from seriesforge.plans.base import query
from seriesforge.plans.catalog import ANGLES, angles
from seriesforge.sources.tables import read_table

PAIRS = "SELECT l_linestatus AS k, l_extendedprice / 100.0 + l_quantity AS a, l_extendedprice / 100.0 + l_quantity + (l_discount - 0.05) * 20 + l_tax + CASE WHEN l_orderkey % 50 = 0 THEN 60 ELSE 0 END AS b FROM lineitem"


def clipped_sql(keys: str, source: str) -> str:
    """CTE v: keys, var, n of differences d after two rounds."""
    return f"""m1 AS (SELECT {keys}, quantile_cont(d, 0.5) AS m FROM {source} GROUP BY ALL), s1 AS (SELECT {keys}, any_value(m) AS m, 4 * 1.4826 * quantile_cont(abs(d - m), 0.5) AS s FROM {source} JOIN m1 USING ({keys}) GROUP BY {keys}), k1 AS (SELECT {keys}, d FROM {source} JOIN s1 USING ({keys}) WHERE s = 0 OR abs(d - m) <= s),
            m2 AS (SELECT {keys}, quantile_cont(d, 0.5) AS m FROM k1 GROUP BY ALL), s2 AS (SELECT {keys}, any_value(m) AS m, 4 * 1.4826 * quantile_cont(abs(d - m), 0.5) AS s FROM k1 JOIN m2 USING ({keys}) GROUP BY {keys}), v AS (SELECT {keys}, var_samp(d) / 2 AS var, count(*) AS n FROM k1 JOIN s2 USING ({keys}) WHERE s = 0 OR abs(d - m) <= s GROUP BY {keys})"""


@query(f"""WITH p AS (SELECT k, (a + b) / 2 AS mean, a - b AS d FROM ({PAIRS})), q AS (SELECT k, quantile_cont(mean, 0.01) AS lo, quantile_cont(mean, 0.999) AS hi FROM p GROUP BY 1),
            r AS (SELECT k, mean, d, CAST(floor(ln(mean / lo) / ln(hi / lo) * 12) AS INTEGER) + 1 AS bin FROM p JOIN q USING (k) WHERE mean >= lo AND mean < hi), l AS (SELECT k, bin, quantile_cont(mean, 0.5) AS level FROM r GROUP BY 1, 2 HAVING count(*) >= 40), x AS (SELECT k, bin, d FROM r JOIN l USING (k, bin)), {clipped_sql('k, bin', 'x')}
            SELECT k, bin, round(level, 5) AS level, round(var, 6) AS var, n AS n_pix FROM v JOIN l USING (k, bin) WHERE n >= 40""")
def pair_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("l_extendedprice").cast("double") / 100 + F.col("l_quantity")
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k"), base.alias("a"), (base + (F.col("l_discount") - 0.05) * 20 + F.col("l_tax") + F.when(F.col("l_orderkey") % 50 == 0, 60).otherwise(0)).alias("b"))
    return I.pair_points(rows, ["k"], "a", "b", 12, 40).select("k", "bin", F.round("level", 5).alias("level"), F.round("var", 6).alias("var"), "n_pix")


HIST = "SELECT l_returnflag, CASE WHEN l_quantity >= 45 THEN 3526 ELSE 3000 + CAST(l_quantity AS BIGINT) * 4 + l_linenumber END AS level, CASE WHEN l_quantity >= 45 THEN 4000 ELSE 30 END AS c FROM lineitem UNION ALL SELECT 'F' AS l_returnflag, 600 + CAST(l_quantity AS BIGINT), 500 FROM lineitem"


@query(f"""WITH h AS (SELECT l_returnflag, level AS a, CAST(sum(c) AS BIGINT) AS n FROM ({HIST}) GROUP BY 1, 2), t AS (SELECT l_returnflag, max(a) AS top FROM h WHERE n >= 1000 GROUP BY 1 HAVING max(a) >= 500), p AS (SELECT l_returnflag, any_value(top) AS top, max_by(a, (n, -a)) FILTER (a BETWEEN greatest(0, top - 159) AND top) AS clip, max(n) FILTER (a BETWEEN greatest(0, top - 159) AND top) AS spike, coalesce(sum(n) FILTER (a > top), 0) AS above FROM h JOIN t USING (l_returnflag) GROUP BY 1),
            v AS (SELECT l_returnflag, any_value(clip) AS clip, any_value(spike) AS spike, any_value(above) AS above, CASE WHEN count(*) < any_value(clip) - greatest(0, any_value(clip) - 300) + 1 THEN 0.0 ELSE CAST(min(n) AS DOUBLE) END AS tail FROM h JOIN p USING (l_returnflag) WHERE a BETWEEN greatest(0, clip - 300) AND clip GROUP BY 1)
            SELECT l_returnflag, clip, spike AS spike_count, tail AS tail_level, round(spike / greatest(tail, 1), 6) AS ratio FROM v WHERE spike / greatest(tail, 1) >= 10 AND above <= spike""")
def level_piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, q = read_table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    rows = li.select("l_returnflag", F.when(q >= 45, 3526).otherwise(3000 + q * 4 + F.col("l_linenumber")).cast("long").alias("level"), F.when(q >= 45, 4000).otherwise(30).alias("c"))
    rows = rows.unionByName(li.select(F.lit("F").alias("l_returnflag"), (600 + q).alias("level"), F.lit(500).alias("c")))
    return I.find_clip(rows, ["l_returnflag"], "level", "c").withColumn("ratio", F.round("ratio", 6))


GROUPS = "SELECT o_custkey % 40 AS night, o_orderpriority AS mode, o_orderkey % 6 AS exposure, count(*) AS frames, avg(o_totalprice) AS flux FROM orders GROUP BY 1, 2, 3"


def exposure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("night"), F.col("o_orderpriority").alias("mode"), (F.col("o_orderkey") % 6).alias("exposure"))
    return o.agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("o_totalprice").cast("double")).alias("flux"))


@query(f"""SELECT night, mode, array_to_string(list_sort(list(exposure)), ' ') AS rungs, count(*) AS n_rungs, CAST(sum(frames) AS BIGINT) AS n_frames FROM ({GROUPS}) WHERE exposure > 0 AND frames >= 2 GROUP BY 1, 2 HAVING count(*) >= 3""")
def exposure_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.ladders(exposure_groups(spark, sf_dir), ["night", "mode"], "exposure", "frames")
    return out.withColumn("rungs", F.array_join(F.transform("rungs", lambda x: x.cast("long").cast("string")), " "))


@query(f"""WITH g AS (SELECT night, mode, CAST(exposure AS DOUBLE) AS exposure, flux, flux / exposure AS rate FROM ({GROUPS}) WHERE exposure > 0), k AS (SELECT night, mode, quantile_cont(rate, 0.5) AS k, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND quantile_cont(rate, 0.5) > 0), r AS (SELECT g.*, k, n, 100 * (flux / (k * exposure) - 1) AS pct FROM g JOIN k USING (night, mode))
            SELECT night, mode, exposure, round(k, 2) AS rate, round(pct, 5) AS residual_pct, round(max(abs(pct)) OVER (PARTITION BY night, mode), 5) AS max_residual_pct, n AS n_rungs FROM r""")
def ladder_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.fit_ladders(exposure_groups(spark, sf_dir), ["night", "mode"], "exposure", "flux")
    return out.withColumns({"rate": F.round("rate", 2), "residual_pct": F.round("residual_pct", 5), "max_residual_pct": F.round("max_residual_pct", 5)})


@query(f"""SELECT night, mode, exposure, CAST(s - 1 AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY frames DESC, night, exposure) AS s FROM ({GROUPS})) WHERE s <= 20""")
def fair_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fair_order(exposure_groups(spark, sf_dir), "mode", [F.col("frames").desc(), F.col("night"), F.col("exposure")], 20).select("night", "mode", "exposure", "slot")


@query(f"""WITH a AS ({ANGLES}), l AS (SELECT label, ra AS x, dec AS y FROM a), r AS (SELECT label, ra + 0.37 + label * 0.01 AS u, dec - 0.21 AS v FROM a WHERE vec_id % 4 <> 0), n AS (SELECT label, na, nb FROM (SELECT label, count(*) AS na FROM l GROUP BY 1) JOIN (SELECT label, count(*) AS nb FROM r GROUP BY 1) USING (label) WHERE na >= 3 AND nb >= 3),
            p AS (SELECT label, u - x AS dx, v - y AS dy FROM l JOIN r USING (label) WHERE abs(u - x) <= 1.5 AND abs(v - y) <= 1.5), c AS (SELECT label, floor(dx / 0.1) AS i, floor(dy / 0.1) AS j, count(*) AS votes, avg(dx) AS cx, avg(dy) AS cy FROM p GROUP BY 1, 2, 3), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY votes DESC, i, j) AS o FROM c) JOIN n USING (label) WHERE o = 1 AND votes >= greatest(8, 0.15 * least(na, nb)))
            SELECT label, any_value(votes) AS votes, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy FROM p JOIN b USING (label) WHERE abs(dx - cx) <= 0.1 AND abs(dy - cy) <= 0.1 GROUP BY 1""")
def offset_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = angles(spark, sf_dir)
    right = a.where("vec_id % 4 <> 0").select("label", (F.col("ra") + 0.37 + F.col("label") * 0.01).alias("ra"), (F.col("dec") - 0.21).alias("dec"))
    return I.vote_offsets(a, right, ["label"], "ra", "dec", 1.5, 0.1).select("label", "votes", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


def cell_sql(bits: int) -> str:
    return " | ".join(f"(((x >> {i}) & 1) << {2 * i}) | (((y >> {i}) & 1) << {2 * i + 1})" for i in range(bits))


CELLS = f"SELECT vec_id, ({cell_sql(10)}) * 64 + vec_id % 64 AS id FROM (SELECT vec_id, CAST(floor(ra / 360 * 1024) AS BIGINT) AS x, CAST(floor((dec + 90) / 180 * 1024) AS BIGINT) AS y FROM ({ANGLES}))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.floor(F.col("ra") / 360 * 1024), F.floor((F.col("dec") + 90) / 180 * 1024)
    return angles(spark, sf_dir).select("vec_id", "ra", "dec", (I.interleaved(x, y, 10) * 64 + F.col("vec_id") % 64).alias("id"))


@query(f"""WITH c AS (SELECT DISTINCT id >> 8 AS c FROM ({CELLS}) JOIN ({ANGLES}) USING (vec_id) WHERE abs(ra - 100) <= 4 AND abs(dec) <= 4), g AS (SELECT c, c - row_number() OVER (ORDER BY c) AS g FROM c) SELECT min(c) << 8 AS first, ((max(c) + 1) << 8) - 1 AS last FROM g GROUP BY g""")
def cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of cells that the sources of a field lie in."""
    return I.cell_ranges(cells(spark, sf_dir).where("abs(ra - 100) <= 4 AND abs(dec) <= 4"), "id", 8)
