"""Names of targets made of the parts' words, their keys and alias groups, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions import names as N
from seriesforge.operators import aliases as A
from seriesforge.plans.base import query
from seriesforge.sources.tables import read_table

#: A raw name of each document: its first two words as they stand, with what observers add to names.
RAW = """concat(CASE doc_id % 5 WHEN 0 THEN '* ' WHEN 1 THEN 'V*  ' WHEN 2 THEN 'mjcMay01 ' ELSE '' END, coalesce(array_join(slice(split(text, '[\\\\s]+'), 1, 2), CASE WHEN doc_id % 3 = 0 THEN '_' ELSE '  ' END), ''), CASE doc_id % 7 WHEN 0 THEN ' lrg 0-25s' WHEN 1 THEN ' 0p1s g 2' WHEN 2 THEN '-y-series' WHEN 3 THEN ' Lyrae' WHEN 4 THEN ' 5' ELSE '' END)"""
SQL_RAW = """concat(CASE doc_id % 5 WHEN 0 THEN '* ' WHEN 1 THEN 'V*  ' WHEN 2 THEN 'mjcMay01 ' ELSE '' END, coalesce(CASE WHEN doc_id % 3 = 0 THEN array_to_string(string_split_regex(text, '[\\s]+')[1:2], '_') ELSE array_to_string(string_split_regex(text, '[\\s]+')[1:2], '  ') END, ''), CASE doc_id % 7 WHEN 0 THEN ' lrg 0-25s' WHEN 1 THEN ' 0p1s g 2' WHEN 2 THEN '-y-series' WHEN 3 THEN ' Lyrae' WHEN 4 THEN ' 5' ELSE '' END)"""
TAIL = N.TAIL
STEPS = rf"""s0 AS (SELECT doc_id, {SQL_RAW} AS t0 FROM documents), s1 AS (SELECT *, trim(regexp_replace(t0, '\s+', ' ', 'g')) AS t1 FROM s0), s2 AS (SELECT *, regexp_replace(t1, '(?i)^(?:\*\s+|v\*\s+)', '') AS t2 FROM s1),
            s3 AS (SELECT *, regexp_replace(t2, '^[a-z]{{2,4}}(?:{'|'.join(N.MONTHS)})\d{{2}} ', '') AS t3 FROM s2), s4 AS (SELECT *, regexp_replace(t3, '(?i)[-_\s][a-z][-_\s]series\s*$', '') AS t4 FROM s3),
            s5 AS (SELECT *, CASE WHEN regexp_matches(regexp_extract(t4, '{TAIL}', 2), '(?i) {N.EXPOSURE}(?: |$)') THEN regexp_extract(t4, '{TAIL}', 1) ELSE t4 END AS t5 FROM s4), s6 AS (SELECT *, regexp_replace(t5, '(?i)(^| )lyrae$', '\1lyr') AS t6 FROM s5),
            s7 AS (SELECT *, lower(t6) AS t7 FROM s6), s8 AS (SELECT *, replace(replace(regexp_replace(t7, '-([a-z])', '\1', 'g'), '_', ''), ' ', '') AS t8 FROM s7)"""


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.expr(RAW).alias("raw"))


@query(f"""WITH {STEPS} SELECT doc_id, t8 AS key, t6 AS cleaned, concat_ws(',', CASE WHEN t0 <> t1 THEN 'whitespace' END, CASE WHEN t1 <> t2 THEN 'prefix_junk' END, CASE WHEN t2 <> t3 THEN 'observer_prefix' END, CASE WHEN t3 <> t4 THEN 'series_suffix' END, CASE WHEN t4 <> t5 THEN 'exposure_tokens' END,
            CASE WHEN t5 <> t6 THEN 'genitive' END, CASE WHEN t6 <> t7 THEN 'casefold' END, CASE WHEN t7 <> t8 THEN 'separators' END) AS rules FROM s8""")
def target_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raw_names(spark, sf_dir).select("doc_id", N.normalised_target("raw").alias("n"))
    return out.select("doc_id", "n.key", "n.cleaned", F.concat_ws(",", "n.rules").alias("rules"))


ALIASES = "SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_custkey // 2 AS VARCHAR) AS \"to\", c_acctbal AS b FROM customer WHERE c_custkey > 1 AND c_custkey % 5 <> 0"


@query(f"""WITH RECURSIVE a AS ({ALIASES}), p AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_nationkey * 10.0 AS ra, c_acctbal / 1000 AS dec FROM customer), c AS (SELECT a.key, a."to", degrees(2 * asin(sqrt(least(1, pow(sin(radians(q.dec - p.dec) / 2), 2) + cos(radians(p.dec)) * cos(radians(q.dec)) * pow(sin(radians(q.ra - p.ra) / 2), 2))))) AS sep FROM a JOIN p ON p.key = a.key LEFT JOIN p q ON q.key = a."to"),
            ok AS (SELECT key, "to" FROM c WHERE sep IS NULL OR sep <= 60), w AS (SELECT key, "to", 1 AS n FROM ok UNION ALL SELECT w.key, ok."to", n + 1 FROM w JOIN ok ON ok.key = w."to"), e AS (SELECT key, max_by("to", n) AS e FROM w GROUP BY 1),
            r AS (SELECT p.key AS raw, coalesce(e.e, p.key) AS key, CAST(p.key AS BIGINT) % 9 AS n FROM p LEFT JOIN e ON e.key = p.key), d AS (SELECT key, min_by(raw, (-n, raw)) AS display FROM r GROUP BY 1) SELECT raw, r.key, n, display FROM r JOIN d USING (key)""")
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of customers' aliases that a wide cone confirms."""
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    aliases = c.where("c_custkey > 1 AND c_custkey % 5 <> 0").select(key.alias("key"), F.expr("CAST(c_custkey div 2 AS STRING)").alias("to"))
    places = c.select(key.alias("key"), (F.col("c_nationkey") * 10.0).alias("ra"), (F.col("c_acctbal") / 1000).cast("double").alias("dec"))
    accepted = A.confirmed(aliases, places, 60.0).where("accepted")
    return A.alias_groups(c.select(key.alias("raw"), key.alias("key"), (F.col("c_custkey") % 9).cast("long").alias("n")), accepted)
