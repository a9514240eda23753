"""Readers of text tables, table maintenance, queues, graphs of stages and sky matches on the driver's tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions import scalars as S
from seriesforge.operators import joins as J
from seriesforge.operators import robust as R
from seriesforge.operators import workflow as W
from seriesforge.plans.base import micros, query
from seriesforge.plans.catalog import ANGLES, angles
from seriesforge.sources import text as X
from seriesforge.sources.tables import TableSet, read_table, shared_dir

c = F.col

CARDS = "concat(CASE WHEN o_orderkey % 3 = 0 THEN concat(rpad('ZIMAGE  =                    T / compressed', 80, ' '), rpad(concat('ZNAXIS1 = ', CAST(o_orderkey AS VARCHAR(20))), 80, ' '), rpad('ZNAXIS2 = 512', 80, ' ')) ELSE '' END, rpad(concat('NAXIS1  = ', CAST(o_custkey AS VARCHAR(20)), ' / length'), 80, ' '), rpad(concat('NAXIS2  = ', CASE WHEN o_orderkey % 5 = 0 THEN 'junk' ELSE '256' END), 80, ' '), rpad('COMMENT no value here', 80, ' '), rpad(concat('OBJECT  = ''it''''s ', o_orderstatus, '  '' / name'), 80, ' '), rpad('END', 80, ' '), rpad('OBJECT2 = 1', 80, ' '))"


@query("""SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS compressed, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey > 0 THEN CAST(o_orderkey AS INTEGER) END WHEN o_orderkey % 5 <> 0 AND o_custkey > 0 THEN CAST(o_custkey AS INTEGER) END AS naxis1, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey > 0 THEN 512 END WHEN o_orderkey % 5 <> 0 AND o_custkey > 0 THEN 256 END AS naxis2,
            'it''s ' || o_orderstatus AS object, NULL::VARCHAR AS behind_end, CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 3 END AS cards FROM orders""")
def header_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width header cards written from the orders and read again."""
    d = read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr(CARDS).alias("block")).withColumn("found", X.cards("block"))
    x, y = X.geometry("found")
    return d.select(F.col("o_orderkey").alias("id"), X.is_compressed("found").alias("compressed"), x.alias("naxis1"), y.alias("naxis2"), X.card("found", "OBJECT").alias("object"), X.card("found", "OBJECT2").alias("behind_end"), F.size("found").alias("cards"))


@query("""SELECT event_id, round(CAST(value AS DOUBLE), 6) AS mag, CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_type END AS band, CASE WHEN event_id % 11 = 0 THEN 'flag=2' ELSE '' END AS note FROM events WHERE event_id % 7 <> 0""")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited lines written from the events and read again: lines without a number go, flagged ones stay with a note."""
    e = read_table(spark, sf_dir, "events")
    line = F.concat_ws("@@@", c("event_id").cast("string"), F.when(c("event_id") % 7 == 0, "<15.2").otherwise(c("value").cast("string")), F.when(c("event_id") % 4 == 1, " ").otherwise(c("event_type")), F.when(c("event_id") % 11 == 0, "2").otherwise("0"))
    rows = e.select(X.fields(line, "@@@", ["id", "mag", "band", "flag"]).alias("f")).select("f.*")
    return X.measured(rows, "mag", "flag").select(c("id").cast("long").alias("event_id"), F.round("mag", 6).alias("mag"), "band", "note")


@query("""SELECT event_id, round(CAST(value AS DOUBLE), 6) AS mag, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 10 / 100.0 END AS err, event_type AS band, event_type = 'click' OR (event_type <> 'click' AND event_id % 13 = 0) AS is_own, event_id % 3 = 1 AS is_limit FROM events WHERE event_id % 17 <> 5 AND event_id % 19 <> 3""")
def observation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows of an observers' database: own rows by code or comment, limits, rows without a number left out."""
    e = read_table(spark, sf_dir, "events")
    i = c("event_id")
    rows = e.select(
        F.when(i % 17 == 5, "NaN").otherwise(i.cast("string")).alias("JD"), F.when(i % 19 == 3, "inf").otherwise(c("value").cast("string")).alias("mag"), F.when(i % 9 == 0, "-").otherwise((i % 10 / 100).cast("string")).alias("uncert"), c("event_type").alias("band"),
        F.when(c("event_type") == "click", " own1 ").otherwise("X").alias("by"), F.when(i % 13 == 0, "taken at Site A, robotic").otherwise(F.lit(None)).alias("comment"), (i % 3).cast("string").alias("fainterThan"),
    )
    out = X.observations(rows, ["OWN1"], ["site a"])
    return out.select(c("jd").cast("long").alias("event_id"), F.round("mag", 6).alias("mag"), "err", "band", "is_own", "is_limit")


@query(f"""WITH a AS ({ANGLES}), p AS (SELECT a.vec_id, b.vec_id AS other, degrees(2 * asin(sqrt(least(1, pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) AS sep FROM a JOIN a b ON a.vec_id < b.vec_id)
            SELECT vec_id, other, round(sep, 6) AS sep FROM p WHERE sep <= 0.5""")
def cone_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within half a degree on the sphere."""
    a = angles(spark, sf_dir)
    b = a.select(c("vec_id").alias("other"), c("ra").alias("ra2"), c("dec").alias("dec2"))
    return J.cone_join(a, b, "ra", "dec", "ra2", "dec2", 0.5).where("vec_id < other").select("vec_id", "other", F.round("sep", 6).alias("sep"))


@query("""WITH q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'done' ELSE 'pending' END AS status, c_nationkey AS rank FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS id, 'pending' AS status, c_nationkey AS rank FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT id FROM q)), u AS (SELECT * FROM q UNION ALL SELECT * FROM n)
            SELECT id, status, rank, row_number() OVER (ORDER BY rank, id) AS place FROM u WHERE status = 'pending' ORDER BY rank, id LIMIT 500""")
def queue_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows put into a queue that has some already, and its next 500 pending rows; the chunk is what its limit makes it."""
    from pyspark.sql import Window

    t = read_table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 4 == 0, "done").otherwise("pending").alias("status"), c("c_nationkey").alias("rank"), "c_acctbal")
    queue = W.enqueue(t.where("id % 2 = 0").drop("c_acctbal"), t.where("c_acctbal > 0").withColumn("status", F.lit("pending")).drop("c_acctbal"), ["id"])
    return W.next_chunk(queue, ["rank", "id"], 500).withColumn("place", F.row_number().over(Window.orderBy("rank", "id")).cast("long"))


STAGES = "SELECT n_nationkey AS node, (n_nationkey - 1) // 2 AS parent, n_nationkey % 4 AS code, n_nationkey % 3 AS content FROM nation"


@query(f"""WITH RECURSIVE s AS ({STAGES}), l(node, level) AS (SELECT node, 0 FROM s WHERE node = 0 UNION ALL SELECT s.node, l.level + 1 FROM s JOIN l ON s.parent = l.node AND s.node > 0), v AS (SELECT node, CASE WHEN node % 5 = 0 THEN 'MISSING' WHEN code <> 1 THEN 'REDEFINED' WHEN content <> 0 THEN 'STALE' ELSE 'FRESH' END AS verdict FROM s)
            SELECT CAST(node AS INTEGER) AS stage, verdict, CAST(level AS INTEGER) AS level, CASE WHEN verdict <> 'FRESH' THEN CAST(row_number() OVER (PARTITION BY verdict <> 'FRESH' ORDER BY level, node) AS INTEGER) END AS position FROM v JOIN l USING (node)""")
def stage_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of stages: levels, freshness verdicts from recorded and current contents, and the order of what is to run again."""
    n = read_table(spark, sf_dir, "nation").select(c("n_nationkey").alias("node"))
    edges = n.where("node > 0").select(F.floor((c("node") - 1) / 2).cast("int").alias("src"), c("node").alias("dst"))
    stages = n.select(c("node").alias("stage"), F.when(c("node") % 4 == 1, "v1").otherwise("v2").alias("code"))
    recorded = n.where("node % 5 <> 0").select(c("node").alias("stage"), F.lit("v1").alias("recorded_code"), F.lit("0").alias("recorded_content"))
    current = n.select(c("node").alias("stage"), (c("node") % 3).cast("string").alias("content"))
    states, depth = W.verdicts(stages, recorded, current), W.levels(n, edges)
    return states.join(depth.withColumnRenamed("node", "stage"), "stage").join(W.rerun_plan(states, depth), "stage", "left").select("stage", "verdict", "level", "position")


@query("""WITH t AS (SELECT c_custkey AS task, CASE WHEN c_acctbal > 3000 THEN 'done' WHEN c_acctbal > 0 THEN 'open' ELSE 'redo' END AS status, c_nationkey AS rank FROM customer), n AS (SELECT c_custkey AS task, CAST(c_custkey // 2 AS BIGINT) AS need FROM customer UNION ALL SELECT c_custkey, CAST(c_custkey // 3 AS BIGINT) FROM customer),
            w AS (SELECT n.task, list_sort(list_distinct(list(n.need))) AS missing FROM n JOIN t ON t.task = n.task AND t.status <> 'done' LEFT JOIN t d ON d.task = n.need AND d.status = 'done' WHERE d.task IS NULL GROUP BY 1)
            SELECT t.task, t.status, coalesce(array_to_string(w.missing, ','), '') AS missing, w.task IS NULL AND t.status <> 'done' AS ready FROM t LEFT JOIN w USING (task)""")
def task_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks with the needs that are not done, and those that could start."""
    t = read_table(spark, sf_dir, "customer").select(c("c_custkey").alias("task"), F.when(c("c_acctbal") > 3000, "done").when(c("c_acctbal") > 0, "open").otherwise("redo").alias("status"))
    needs = t.select("task", F.explode(F.array(F.floor(c("task") / 2), F.floor(c("task") / 3))).alias("need"))
    waits = W.unmet(t, needs, ["done"])
    return t.join(waits, "task", "left").select("task", "status", F.coalesce(F.array_join(F.transform("missing", lambda x: x.cast("string")), ","), F.lit("")).alias("missing"), (c("missing").isNull() & (c("status") != "done")).alias("ready"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, round(c_acctbal * 2, 2) AS twice FROM customer WHERE NOT (c_acctbal < 0)""")
def table_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table created, rows deleted, rows updated, a column added, renamed; read back."""
    tables = TableSet(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", protected=("customer",))
    tables.create("draft", read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))
    tables.delete("draft", "c_acctbal < 0")
    tables.update("draft", "c_nationkey = 3", {"c_mktsegment": "'MOVED'"})
    tables.add_column("draft", "twice", "double", "round(c_acctbal * 2, 2)")
    tables.rename("draft", "accounts")
    return tables.read("accounts").select("c_custkey", "c_mktsegment", "twice")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50""")
def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a report: rows 51 to 150."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(100)


@query("""WITH s AS (SELECT lang, n_chars // 500 AS t, count(*) FILTER (source <> 'src0') AS events, count(*) AS leaving FROM documents GROUP BY 1, 2), r AS (SELECT *, sum(leaving) OVER (PARTITION BY lang ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM s),
            k AS (SELECT lang, t, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events = at_risk THEN 0 ELSE ln(1 - events / CAST(at_risk AS DOUBLE)) END) OVER w) END AS survival FROM r WINDOW w AS (PARTITION BY lang ORDER BY t)) SELECT lang, min(t) FILTER (survival <= 0.5) AS median FROM k GROUP BY 1""")
def median_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time at which half are gone, censored rows counted as at risk until they leave."""
    d = read_table(spark, sf_dir, "documents").withColumn("t", F.floor(F.col("n_chars") / 500))
    return R.survival_median(R.kaplan_meier(d, ["lang"], "t", F.col("source") != "src0"), ["lang"], "t")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 86400000000.0 - 19723 AS x, value FROM events), k AS (SELECT user_id, x, round(x / 0.37) AS cycle, value, (x / 0.37) - floor(x / 0.37) AS phase FROM e)
            SELECT user_id, count(*) AS n, round(regr_slope(x, cycle), 6) AS period, round(regr_intercept(x, cycle), 6) AS epoch, round(count(DISTINCT floor(phase * 20)) / 20.0, 6) AS coverage FROM k GROUP BY 1""")
def linear_ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times against cycle numbers by user: period, epoch, and the share of 20 phase bins that were observed."""
    x = (micros("ts") / 86400000000.0 - 19723).alias("x")
    k = read_table(spark, sf_dir, "events").select("user_id", x).withColumn("cycle", F.bround(c("x") / 0.37)).withColumn("phase", S.phase_of("x", 0.0, 0.37))
    fit = R.line_fit("cycle", "x")
    return k.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(fit["slope"], 6).alias("period"), F.round(fit["intercept"], 6).alias("epoch"), F.round(R.phase_coverage("phase", 20), 6).alias("coverage"))
