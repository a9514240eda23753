"""Deduplication, name rules, flags, matching and claims on the relational tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions import scalars as S
from seriesforge.operators import joins as J
from seriesforge.operators import workflow as W
from seriesforge.operators.dedup import canonical_rows
from seriesforge.plans.base import micros, query, seconds
from seriesforge.sources.tables import read_table


@query("""SELECT doc_id, source, lang, group_size FROM (
            SELECT *, count(*) OVER (PARTITION BY text) AS group_size,
                   row_number() OVER (PARTITION BY text ORDER BY CASE source WHEN 'src0' THEN 2 WHEN 'src1' THEN 1 ELSE 0 END, doc_id) AS n
            FROM documents) WHERE n = 1""")
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stand for their group of equal texts: best source first, then the least id."""
    docs = read_table(spark, sf_dir, "documents")
    rank = F.when(F.col("source") == "src0", 2).when(F.col("source") == "src1", 1).otherwise(0)
    return canonical_rows(docs, [F.sha2("text", 256)], [rank, F.col("doc_id")], ["doc_id", "source", "lang"])


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 9000 THEN 'rich' END,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN c_nationkey % 5 = 0 THEN 'home' END) AS flags FROM customer""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read_table(spark, sf_dir, "customer").select("c_custkey", S.flags({"negative": c("c_acctbal") < 0, "rich": c("c_acctbal") > 9000, "building": c("c_mktsegment") == "BUILDING", "home": c("c_nationkey") % 5 == 0}).alias("flags"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c_acctbal IS NULL THEN 'no value' WHEN c_acctbal < 0 THEN 'negative'
            WHEN c_acctbal < 1000 THEN 'low' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' ELSE 'kept' END AS reason FROM customer) GROUP BY reason""")
def rejection_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row charged to its first failing reason."""
    c = F.col
    reason = S.first_reason({"no value": c("c_acctbal").isNull(), "negative": c("c_acctbal") < 0, "low": c("c_acctbal") < 1000, "segment": c("c_mktsegment") == "MACHINERY"}, "kept")
    return read_table(spark, sf_dir, "customer").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(upper(p_name), '[\s_\-#]+', ' ', 'g')), '( (\d+(\.\d+)?S|\d+X\d+(\.\d+)?S?))+$', '') AS name_key,
            CASE p_type WHEN 'BRASS' THEN 0 WHEN 'STEEL' THEN 1 ELSE 2 END AS rank,
            concat_ws('|', coalesce(p_brand, '∅'), coalesce(CAST(p_size AS VARCHAR), '∅')) AS config FROM part""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", S.normalise_name("p_name").alias("name_key"), S.rank_of("p_type", ["BRASS", "STEEL"]).alias("rank"), S.config_key([F.col("p_brand"), F.col("p_size")]).alias("config"))


@query("""SELECT name_key, display, n FROM (
            SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY n DESC, length(display), display DESC) AS r FROM (
                SELECT lower(c_mktsegment) AS name_key, c_mktsegment || '-' || CAST(c_nationkey % 3 AS VARCHAR) AS display, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE r = 1""")
def display_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that most rows of an entity carry; ties go to the shorter, then the lexicographically greater one."""
    named = read_table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("name_key"), F.concat_ws("-", "c_mktsegment", (F.col("c_nationkey") % 3).cast("string")).alias("display")).agg(F.count(F.lit(1)).alias("n"))
    return named.groupBy("name_key").agg(F.max_by(F.struct("display", "n"), F.struct("n", -F.length("display"), "display")).alias("m")).select("name_key", "m.display", "m.n")


@query("""SELECT page_id, lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, split_part(url, '://', 1) AS scheme,
            nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page, contains(url, '#') AS has_fragment,
            regexp_extract(html, '<title>([^<]*)', 1) AS title, length(html) AS html_chars FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-structured text to columns."""
    rest = F.element_at(F.split("url", "://", 2), 2)
    return read_table(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.element_at(F.split(rest, "/"), 1)).alias("host"), F.element_at(F.split("url", "://"), 1).alias("scheme"),
        F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit("")).alias("page"), F.contains("url", F.lit("#")).alias("has_fragment"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.length("html").cast("long").alias("html_chars"),
    )


@query("""SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS with_k, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS sum_k FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


@query("""SELECT event_id, epoch_us(ts) / 86400000000.0 + 2440587.5 AS jd, epoch_us(ts) / 86400000000.0 + 40587.0 AS mjd,
            CAST(DATE '1970-01-01' + CAST(floor(epoch_us(ts) / 86400000000.0 + 2440587.5 - 2440587.5 - 0.7917) AS INTEGER) AS DATE) AS night FROM events""")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = micros("ts") / 86400000000.0
    return read_table(spark, sf_dir, "events").select("event_id", (days + 2440587.5).alias("jd"), (days + 40587.0).alias("mjd"), S.night_label(days + S.UNIX_EPOCH_JD).alias("night"))


@query("""SELECT event_id, round((x / 0.37) - floor(x / 0.37), 6) AS phase, CAST(floor(x / 0.37) AS BIGINT) AS cycle, round((x / 0.37) - floor(x / 0.37 + 0.5), 6) AS folded,
            round((x - floor(x / 0.37 + 0.5) * 0.37) * 86400, 3) AS oc_s FROM (SELECT event_id, epoch_us(ts) / 86400000000.0 - 19723.25 AS x FROM events)""")
def phase_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "events").select("event_id", (micros("ts") / 86400000000.0 - 19723.25).alias("x"))
    return x.select("event_id", F.round(S.phase_of("x", 0.0, 0.37), 6).alias("phase"), S.cycle_number("x", 0.0, 0.37).alias("cycle"), F.round(S.fold_phase("x", 0.0, 0.37), 6).alias("folded"), F.round(S.observed_minus_computed_s("x", 0.0, 0.37), 3).alias("oc_s"))


ANGLES = "SELECT vec_id, label, 90 + 60 * CAST(embedding[1] AS DOUBLE) AS ra, 40 * CAST(embedding[2] AS DOUBLE) AS dec FROM embeddings"


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (90 + 60 * F.col("embedding")[0].cast("double")).alias("ra"), (40 * F.col("embedding")[1].cast("double")).alias("dec"))


@query(f"""SELECT vec_id, round(degrees(2 * asin(sqrt(least(1, pow(sin(radians(20 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(20)) * pow(sin(radians(100 - ra) / 2), 2))))), 6) AS sep,
            round(degrees(cos(radians(dec)) * sin(radians(ra - 100)) / c), 6) AS xi, round(degrees((cos(radians(20)) * sin(radians(dec)) - sin(radians(20)) * cos(radians(dec)) * cos(radians(ra - 100))) / c), 6) AS eta
            FROM (SELECT *, sin(radians(20)) * sin(radians(dec)) + cos(radians(20)) * cos(radians(dec)) * cos(radians(ra - 100)) AS c FROM ({ANGLES})) WHERE c > 0""")
def sky_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    xi, eta = S.tangent_project("ra", "dec", 100.0, 20.0)
    d = angles(spark, sf_dir)
    return d.select("vec_id", F.round(S.separation_deg("ra", "dec", F.lit(100.0), F.lit(20.0)), 6).alias("sep"), F.round(xi, 6).alias("xi"), F.round(eta, 6).alias("eta")).where("xi is not null")


@query(f"""WITH a AS ({ANGLES}), p AS (SELECT a.vec_id, b.vec_id AS other, sqrt(pow(a.ra - b.ra, 2) + pow(a.dec - b.dec, 2)) AS dist FROM a JOIN a b ON a.vec_id <> b.vec_id
            AND abs(a.ra - b.ra) <= 0.5 AND abs(a.dec - b.dec) <= 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS n FROM p WHERE dist <= 0.5)
            SELECT vec_id, max(CASE WHEN n = 1 THEN other END) AS nearest, round(max(CASE WHEN n = 1 THEN dist END), 6) AS dist1, round(max(CASE WHEN n = 2 THEN dist END), 6) AS dist2 FROM r GROUP BY vec_id""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest and second distance within a tolerance, by a join on square cells."""
    a = angles(spark, sf_dir)
    b = a.select(F.col("vec_id").alias("other"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    pairs = J.plane_join(a, b, "ra", "dec", "ra2", "dec2", 0.5).where("vec_id <> other")
    return J.nearest_two(pairs, "vec_id", ["other"], "other").select("vec_id", "nearest", F.round("dist1", 6).alias("dist1"), F.round("dist2", 6).alias("dist2"))


@query("""SELECT a.p_partkey AS part_a, b.p_partkey AS part_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 0.5""")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("part_a"), "p_brand", F.col("p_retailprice").alias("x"))
    b = p.select(F.col("p_partkey").alias("part_b"), "p_brand", F.col("p_retailprice").alias("y"))
    return J.range_join(a, b, "x", "y", 0.5, ["p_brand"]).where("part_a < part_b").select("part_a", "part_b")


ASOF = """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), l AS (SELECT * FROM e WHERE event_type = 'click'), r AS (SELECT user_id, t, min(event_id) AS id FROM e WHERE event_type = 'error' GROUP BY 1, 2)"""


@query(ASOF + """ SELECT event_id, id AS partner, round(gap, 6) AS gap FROM (SELECT l.event_id, r.id, abs(l.t - r.t) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t) NULLS LAST, r.t) AS n
            FROM l LEFT JOIN r ON l.user_id = r.user_id) WHERE n = 1""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("t"))
    left, right = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'error'").drop("event_type")
    out = J.asof(left, right, ["user_id"], "t", "t", ["event_id"])
    return out.select("event_id", F.col("r_event_id").alias("partner"), F.round(F.abs(F.col("t") - F.col("r_t")), 6).alias("gap"))


@query(ASOF + """ SELECT l.event_id, (SELECT max_by(r.id, r.t) FROM r WHERE r.user_id = l.user_id AND r.t < l.t) AS before_id, (SELECT min_by(r.id, r.t) FROM r WHERE r.user_id = l.user_id AND r.t > l.t) AS after_id FROM l""")
def asof_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows strictly before and after in time."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("t"))
    left, right = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'error'").drop("event_type")
    b = J.asof(left, right, ["user_id"], "t", "t", ["event_id"], "backward", strict=True).select("event_id", "user_id", "t", F.col("r_event_id").alias("before_id"))
    return J.asof(b, right, ["user_id"], "t", "t", ["event_id"], "forward", strict=True).select("event_id", "before_id", F.col("r_event_id").alias("after_id"))


@query("""WITH k AS (SELECT doc_id, md5(text) AS exact, md5(lower(trim(text))) AS norm, md5(concat_ws('|', lang, source, n_chars)) AS kin FROM documents),
            o AS (SELECT a.doc_id, 0 AS i, 'exact' AS rung, min(b.doc_id) AS partner FROM k a JOIN k b ON a.exact = b.exact AND b.doc_id < a.doc_id GROUP BY 1
            UNION ALL SELECT a.doc_id, 1, 'normalised', min(b.doc_id) FROM k a JOIN k b ON a.norm = b.norm AND b.doc_id < a.doc_id GROUP BY 1
            UNION ALL SELECT a.doc_id, 2, 'columns', min(b.doc_id) FROM k a JOIN k b ON a.kin = b.kin AND b.doc_id < a.doc_id GROUP BY 1)
            SELECT k.doc_id, coalesce(x.rung, 'orphan') AS rung, x.partner FROM k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o) x ON k.doc_id = x.doc_id AND x.n = 1""")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rung that finds an earlier document: the same text, the same normalised text, the same language, source and length."""
    d = read_table(spark, sf_dir, "documents")
    keys = {"exact": F.md5("text"), "normalised": F.md5(F.lower(F.trim("text"))), "columns": F.md5(F.concat_ws("|", "lang", "source", "n_chars"))}

    def rung(key) -> DataFrame:
        own = d.select("doc_id", key.alias("k"))
        first = own.groupBy("k").agg(F.min("doc_id").alias("partner"))
        return own.join(first, "k").where("partner < doc_id").select("doc_id", "partner")

    return J.ladder(d, "doc_id", [(n, rung(k)) for n, k in keys.items()])


@query("""SELECT o.o_orderpriority AS claim_key, count(*) AS n_orders, 300 AS claimed, count(*) - 300 AS diff, CASE WHEN count(*) = 300 THEN 'HOLDS' ELSE 'VIOLATED' END AS status FROM orders o GROUP BY 1""")
def claims_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("claim_key"))
    return J.reconcile(o.groupBy("claim_key").agg(F.count(F.lit(1)).alias("n_orders")), o.distinct().withColumn("claimed", F.lit(300)), ["claim_key"], "n_orders", "claimed")


@query("""WITH c AS (SELECT n.n_name, count(*) FILTER (o.o_orderstatus = 'F') AS f, count(*) FILTER (o.o_orderstatus = 'P') AS p, count(*) FILTER (o.o_totalprice > 300000) AS large
            FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1), l AS (
            SELECT n_name, 'f' AS need, f AS n FROM c UNION ALL SELECT n_name, 'p', p FROM c UNION ALL SELECT n_name, 'large', large FROM c)
            SELECT n_name, need, n, CASE WHEN n >= 40 THEN 'ok' WHEN n > 0 THEN 'partial' ELSE 'missing' END AS status FROM l""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, o = (read_table(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return J.coverage(joined, ["n_name"], {"f": F.col("o_orderstatus") == "F", "p": F.col("o_orderstatus") == "P", "large": F.col("o_totalprice") > 300000}, 40)


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
            SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'appeared' WHEN b.k IS NULL THEN 'destroyed' WHEN a.n <> b.n THEN 'content' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def keyed_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    count = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return J.keyed_diff(count(o.where("o_orderstatus <> 'F'")), count(o.where("o_orderpriority <> '1-URGENT'")), ["k"], ["n"])


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS large, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS idle FROM customer""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    seen = o.groupBy("o_custkey").agg(F.max(F.col("o_totalprice") > 200000).alias("large"))
    return c.join(seen, c.c_custkey == seen.o_custkey, "left").select("c_custkey", F.coalesce("large", F.lit(False)).alias("large"), F.col("o_custkey").isNull().alias("idle"))


@query("""SELECT doc_id, (CAST('0x' || substr(sha256('hold|' || source || '|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0) < 0.2 AS held FROM documents""")
def hash_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return W.holdout(d, [F.col("source"), F.col("doc_id")], 0.2, "hold").select("doc_id", "held")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1|' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 25""")
def stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.stratified_sample(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 25, "s1").select("doc_id", "lang")


@query("""SELECT source, CASE WHEN CAST(substr(source, 4) AS INTEGER) < 5 THEN CAST(substr(source, 4) AS BIGINT) + 100 ELSE 104 + row_number() OVER (PARTITION BY CAST(substr(source, 4) AS INTEGER) < 5 ORDER BY source) END AS source_id FROM (SELECT DISTINCT source FROM documents)""")
def pinned_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogate ids that never move: five sources have theirs already, the others get the next ones."""
    known = spark.range(5).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), (F.col("id") + 100).alias("source_id"))
    return W.pinned_ids(read_table(spark, sf_dir, "documents"), known, "source", "source_id")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], F.col("turn"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X" FROM orders GROUP BY 1""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return W.status_counts(q, ["o_orderpriority"], ["F", "O", "P", "X"])


@query("""WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM orders), r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'odd' END AS s FROM orders)
            SELECT q.o_orderkey, CASE WHEN (status = 'pending' AND s IN ('done', 'failed')) OR (status IN ('done', 'failed') AND s = 'pending') THEN s ELSE status END AS status FROM q JOIN r USING (o_orderkey)""")
def queue_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    queue = o.withColumn("status", F.when(F.col("o_orderkey") % 3 == 0, "done").otherwise("pending"))
    k = F.col("o_orderkey") % 4
    return W.transition(queue, o.withColumn("status", F.when(k == 0, "done").when(k == 1, "failed").when(k == 2, "pending").otherwise("odd")), "o_orderkey", ["done", "failed"])


@query("""WITH old AS (SELECT c_custkey, c_acctbal FROM customer), new AS (SELECT o_custkey AS c_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS c_acctbal FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
            SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    rows = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    return W.upsert(table, rows, ["c_custkey"], F.struct("o_orderdate", "o_orderkey"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS src, CAST(user_id * 2 AS BIGINT) AS dst FROM events WHERE user_id > 0 UNION SELECT DISTINCT CAST(user_id AS BIGINT), CAST(user_id * 2 + 1 AS BIGINT) FROM events WHERE user_id > 0),
            c(node) AS (SELECT CAST(3 AS BIGINT) UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c""")
def staleness_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything downstream of a node."""
    u = read_table(spark, sf_dir, "events").where("user_id > 0").select(F.col("user_id").cast("long").alias("src")).distinct()
    edges = u.select("src", F.explode(F.array(F.col("src") * 2, F.col("src") * 2 + 1)).alias("dst"))
    return W.closure(edges, spark.range(3, 4).select(F.col("id").alias("node")))


@query("""SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-' ||
            CAST(sum(CAST(CAST('0x' || substr(h, 17, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST(CAST('0x' || substr(h, 25, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS content FROM (
            SELECT sha256(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || length(o_orderstatus) || ':' || o_orderstatus || length(o_orderpriority) || ':' || o_orderpriority) AS h FROM orders)""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.fingerprint(read_table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
            FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
            JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 3""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c, o = (read_table(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("orders >= 3")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's group limit keeps k rows for each key before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read_table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice", F.col("n").cast("long").alias("n"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1""")
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.countDistinct("o_orderstatus").alias("states"))


@query("""SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS level, round(o_totalprice / 1000) * 1000 AS price_bin, CASE WHEN o_totalprice BETWEEN 100000 AND 200000 THEN 'mid' WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS band,
            CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 1 ELSE 0 END AS hot, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS state FROM orders""")
def scalar_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), (F.round(c("o_totalprice") / 1000) * 1000).alias("price_bin"),
        F.when(c("o_totalprice").between(100000, 200000), "mid").when(c("o_totalprice") < 100000, "low").otherwise("high").alias("band"),
        F.when(c("o_orderpriority").like("%URGENT%") | c("o_orderpriority").like("%HIGH%"), 1).otherwise(0).alias("hot"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("pending")).alias("state"),
    )
