"""What each filter of a chain takes, alone and in every order, by lattice-edge aggregation.

Whether a document fails a filter does not depend on the others, so a document is a set of failed filters. The sets are
counted first, part by part (32 sets for five filters); each count then goes to the edges (set of filters applied already,
next filter) of the subset lattice, 80 of them, and an order of the filters is a path of five edges. The 600 steps of the
120 orders read the aggregated edges by a join, never the documents.

Nulls: a null text is an empty one; a null part counts as the empty string; a row with a null doc_id is no copy of another
and none of it, and has no labels. Repeated rows (same doc_id) count each, and none of them is a copy of the other. Several
labels of a document count as 1 if any of them is 1. An empty table gives no rows. Whole texts, of any length. Other columns
are not read, whatever their names. Texts are compared by their SHA-256 digests.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import hot_join, read_table, stored, text_or_empty

SPACE = r"\x20\x09-\x0D"
#: The filters of the query in the order of their bits: too few words, repeated words, capitals, symbols, copies.
FILTERS = "ABCDE"


def failed_by_text(text: Column, words: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3) -> Column:
    """Bits 0 to 3: the filters that a text fails by itself; words is the array of its words, shares are per cent."""
    n, chars = F.size(words), F.length(text)
    capitals = chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bits = (n < least_words, 100 * F.size(F.array_distinct(words)) < least_distinct * n, 100 * capitals > most_capitals * chars, text.rlike(r"[#$%&*|]"))
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no white space."""
    bare = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def with_copies(rows: DataFrame, key: str, digest: str, bit: int, mask: str) -> DataFrame:
    """rows (stored) with `bit` added to the mask of each row whose digest a smaller key has too."""
    first = rows.groupBy(digest).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    several = stored(first.where("_n > 1"), "filter-copies")
    copied = hot_join(rows, several, [digest], "_n", [key]).where(F.col(key) > F.col("_first"))
    # A copy leaves its mask and enters another, so only copies are joined; the counts are signed.
    move = F.explode(F.array(F.struct(F.lit(-1).alias("n"), F.col(mask).alias("m")), F.struct(F.lit(1).alias("n"), (F.col(mask) + bit).alias("m")))).alias("_e")
    moved = copied.select("*", move).withColumn(mask, F.col("_e.m")).withColumn("n", F.col("_e.n")).drop("_e", "_first")
    return rows.withColumn("n", F.lit(1)).unionByName(moved)


def signatures(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, mask, good, toxic, n: how many documents of the part fail just the filters of the mask."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id"), part.alias("part"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    small = stored(rows.select("doc_id", "part", failed_by_text(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-rows")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(f) == 1).cast("int")), F.lit(0)).alias(c) for c, f in (("good", "quality"), ("toxic", "toxic"))])
    marked = small.where("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    unknown = small.where("doc_id is null").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    counted = with_copies(stored(marked.unionByName(unknown), "filter-marked"), "doc_id", "digest", 1 << 4, "mask")
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(counts: DataFrame, filters: int) -> DataFrame:
    """part, applied, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost for each edge of the lattice."""
    pairs = [(s, 1 << f) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in pairs])).alias("e")
    met = counts.select("part", "mask", "good", "toxic", "n", edge).select("*", "e.applied", "e.bit")
    mask, applied, bit = F.col("mask"), F.col("applied"), F.col("bit")
    fails, before = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(applied) != 0
    kept, removed = ~fails & ~before, fails & ~before
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long").alias(name)
    return met.groupBy("part", "applied", "bit").agg(
        total(kept, "kept"), total(removed, "removed"), total(fails & before, "redundant"), total(mask == bit, "unique_fails"),
        total(removed & (F.col("good") == 1), "good_lost"), total(removed & (F.col("toxic") == 1), "toxic_lost"),
    )


def paths(edges: DataFrame, filters: str) -> DataFrame:
    """Each order of the filters as a path of edges: part, filter_order, step, the edge's counts, and shapley, the filter's removed over all orders."""
    steps = [("".join(o), k + 1, sum(1 << filters.index(c) for c in o[:k]), 1 << filters.index(o[k])) for o in permutations(filters) for k in range(len(o))]
    walked = edges.join(F.broadcast(edges.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, bit int")), ["applied", "bit"])
    over_all = walked.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return walked.join(over_all, ["part", "bit"]).drop("applied", "bit")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    counts = signatures(docs, labels, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    edges = stored(lattice_edges(counts, len(FILTERS)), "filter-edges")
    return paths(edges, FILTERS).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS again FROM d),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(again AS INTEGER) AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(left(filter_order, step - 1), g.letter) > 0) AS applied
        FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step), f WHERE f.letter = filter_order[step]),
r AS (SELECT part, filter_order, step, any_value(bit) AS bit, sum(n) FILTER (mask & (applied | bit) = 0) AS kept, sum(n) FILTER (mask & applied = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (mask & applied > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(n) FILTER (mask & applied = 0 AND mask & bit > 0 AND good = 1) AS good_lost, sum(n) FILTER (mask & applied = 0 AND mask & bit > 0 AND toxic = 1) AS toxic_lost
        FROM c, (SELECT filter_order, step, bit, CAST(applied AS INTEGER) AS applied FROM s) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
    CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
