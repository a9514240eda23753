"""Lines of spectra on the driver's embeddings, each taken as one, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import spectra as S
from seriesforge.plans.base import query
from seriesforge.sources.tables import checkpointed, read_table

ROWS = """e AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS x, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings), c AS (SELECT vec_id, x, f - quantile_cont(f, 0.5) OVER (PARTITION BY vec_id ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS r FROM e),
            m AS (SELECT vec_id, quantile_cont(r, 0.5) AS m FROM c GROUP BY 1), n AS (SELECT vec_id, greatest(1.4826 * quantile_cont(abs(r - m), 0.5), 1e-9) AS noise FROM c JOIN m USING (vec_id) GROUP BY 1), r AS (SELECT c.vec_id, x, r, noise FROM c JOIN n USING (vec_id))"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "f"))
    return checkpointed(S.residuals(e, ["vec_id"], "x", "f", 15))


@query(f"""WITH {ROWS}, t AS (SELECT vec_id, max(r) AS h, max_by(x, (r, -x)) AS i, any_value(noise) AS noise FROM r GROUP BY 1 HAVING max(r) >= 2 * any_value(noise) AND max(r) > 0), s AS (SELECT r.vec_id, any_value(h) AS h, any_value(t.noise) AS noise, coalesce(max(CASE WHEN r <= h / 2 AND x < i THEN x END) + 1, min(x)) AS lo, coalesce(min(CASE WHEN r <= h / 2 AND x > i THEN x END) - 1, max(x)) AS hi FROM r JOIN t USING (vec_id) GROUP BY 1)
            SELECT vec_id, round(sum(r * x) / sum(r), 6) AS x, round(any_value(h / s.noise), 5) AS snr, any_value(hi - lo + 1) AS width_px FROM r JOIN s USING (vec_id) WHERE x BETWEEN lo AND hi AND hi - lo + 1 BETWEEN 1 AND 6 GROUP BY 1""")
def emission_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.emission_peaks(rows(spark, sf_dir), ["vec_id"], 2.0, (1, 6))
    return out.select("vec_id", F.round("x", 6).alias("x"), F.round("snr", 5).alias("snr"), "width_px")


DIPS = f"""{ROWS}, l AS (SELECT *, coalesce(CAST(x - lag(x) OVER (PARTITION BY vec_id ORDER BY x) > 2 AS INTEGER), 0) AS new FROM r WHERE r < -1.2 * noise), g AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM l), d AS (SELECT vec_id, run, min_by(x, (r, x)) AS i, -min(r) AS d, any_value(noise) AS noise FROM g GROUP BY 1, 2 HAVING count(*) >= 2),
            w AS (SELECT d.vec_id, run, i AS x, d.d / d.noise AS snr, coalesce(min(CASE WHEN r >= -d.d / 2 AND x > i THEN x END) - 1, max(x)) - coalesce(max(CASE WHEN r >= -d.d / 2 AND x < i THEN x END) + 1, min(x)) + 1 AS width_px FROM r JOIN d USING (vec_id) GROUP BY d.vec_id, run, i, d.d, d.noise)"""


@query(f"WITH {DIPS} SELECT vec_id, x, round(snr, 5) AS snr, width_px FROM w")
def absorption_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dips(rows(spark, sf_dir), ["vec_id"], 1.2, 2, 2).withColumn("snr", F.round("snr", 5))


@query(f"""WITH {DIPS}, p AS (SELECT vec_id, max_by(x, (r, -x)) AS p FROM r GROUP BY 1), q AS (SELECT vec_id, b.x AS x_b, b.snr AS snr_b, a.x AS x_a, a.snr AS snr_a, 1030.9 / nullif(a.x - p, 0) AS a_per_px, (a.x - p) / nullif(CAST(b.x - p AS DOUBLE), 0) AS ratio, (a.x - p) * (b.x - p) AS same FROM p JOIN w b USING (vec_id) JOIN w a USING (vec_id)),
            o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY snr_b + snr_a DESC, snr_b DESC, x_b, x_a) AS o FROM q WHERE same > 0 AND ratio BETWEEN 1030.9 / 304.4 * 0.6 AND 1030.9 / 304.4 * 1.4 AND abs(a_per_px) BETWEEN 3 AND 3000)
            SELECT vec_id, x_b, round(snr_b, 5) AS snr_b, x_a, round(snr_a, 5) AS snr_a, round(a_per_px, 8) AS a_per_px FROM o WHERE o = 1""")
def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    tops = r.groupBy("vec_id").agg(F.max_by("x", F.struct("residual", -F.col("x"))).alias("x"))
    out = S.anchor_pairs(tops, S.dips(r, ["vec_id"], 1.2, 2, 2), ["vec_id"], 6562.8, 6867.2, 7593.7, 0.4, (3.0, 3000.0))
    return out.withColumns({"snr_b": F.round("snr_b", 5), "snr_a": F.round("snr_a", 5), "a_per_px": F.round("a_per_px", 8)})
