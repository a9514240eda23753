"""Line deduplication within an edit bound, by a deletion-neighbourhood join.

Of the lines of at least `min_chars` code points, one goes if an earlier one, by (doc_id, line number), equals it or
differs from it by at most `edits` inserted, deleted or replaced code points. All is exact:

1. Lines are digested and grouped, so that a distinct line is handled once, however often it occurs.
2. Lines that share no part with another distinct line are done. For one edit, a line of length n cut into m parts of
   g = n // m leaves, for each part, a key: what stands before and after that part; two lines within one edit share such
   a key for any m, if the shorter length sets g. Lines that share one for m = 2, and then for m = 16, go on, with the part
   in which the difference must lie. For more edits, of edits + 1 parts of the shorter line one stands in the other line,
   moved by at most `edits`.
3. Those lines emit the whole deletion neighbourhood as hashed keys: up to `edits` code points are left out or marked as
   open, in all ways. Two lines are within the bound exactly if they share a variant in which the marks (replacements) and
   what either lost (deletions, insertions) are no more than it. So minima of ranks for each key, by how many code points were
   lost, find the earliest partner without listing pairs.
4. The pairs found are verified by Spark's levenshtein().

Joins in which one line, part or variant may have a great share of all rows deal it over several tasks (hot_join).

Nulls: null and empty texts have no lines; an empty table gives none. Rows with a null doc_id have no rank; they are neither
compared nor changed. Rows that share a doc_id (repeated rows) have equal ranks, so equal lines of theirs at the same number
stay. Lines shorter than min_chars stay, but exact repeats of those that have `exact_chars` and are not blank go, where that is
given; they have no keys, for within the bound short lines would meet by chance. Lines may be of any length: a document's lines
are held at once, and so are the variants of one line, n of them for one edit and about (2 n)^edits for more.
Extra columns, whatever their names, are kept by remove_lines and not read.
"""

from collections.abc import Iterator
from itertools import combinations, product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import free_name, hot_join, read_table, stored, with_marks

#: White space; a line of nothing else is blank.
BLANK = " \t\v\f\r"
LINE = "doc_id long, line_no int, d1 long, d2 long, keys array<long>"


def signed(x: int) -> int:
    return x - (1 << 63)


def part_keys(line: str, m: int) -> Iterator[tuple[int, int, int]]:
    """Key, and where the part that it leaves out begins and ends. Lengths n and n - 1 set the size of a part."""
    n = len(line)
    for g in {n // m, (n - 1) // m}:
        if g:
            for i in range(m):
                a, b = i * g, n - (m - 1 - i) * g
                yield signed(xxhash.xxh64_intdigest(f"{m} {g} {i} {line[:a]}\n{line[b:]}")), a, b


def piece_keys(line: str, edits: int) -> set[int]:
    """Keys of which two lines within so many edits share one: parts of the shorter one, wherever they may stand in the longer one."""
    n, out = len(line), set()
    for short in range(max(edits + 1, n - edits), n + 1):
        bounds = [short * i // (edits + 1) for i in range(edits + 2)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for move in range(-edits, edits + 1):
                if 0 <= a + move and b + move <= n:
                    out.add(signed(xxhash.xxh64_intdigest(f"{short} {i} {line[a + move : b + move]}")))
    return out


def variants(line: str, places: list[int], edits: int) -> Iterator[tuple[str, int, int]]:
    """Variant, number of marks, number of code points lost, for up to so many edits at those places. A mark is a line end."""
    yield line, 0, 0
    for t in range(1, edits + 1):
        for at in combinations(places, t):
            for marks in product((False, True), repeat=t):
                out, begin = [], 0
                for q, mark in zip(at, marks):
                    out += [line[begin:q], "\n"] if mark else [line[begin:q]]
                    begin = q + 1
                yield "".join(out) + line[begin:], sum(marks), t - sum(marks)


def lines_of(docs: DataFrame, min_chars: int, exact_chars: int | None = None, edits: int = 1, rows: int = 500) -> DataFrame:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["doc_id", "line_no", "d1", "d2", "keys"]
    line_keys = (lambda line: [k for k, _, _ in part_keys(line, 2)]) if edits == 1 else (lambda line: list(piece_keys(line, edits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part, out = batch.slice(at, rows), [[] for _ in names]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for no, line in enumerate(text.split("\n")):
                        near = len(line) >= min_chars
                        if near or (exact_chars is not None and len(line) >= exact_chars and line.strip(BLANK)):
                            d = xxhash.xxh3_128_intdigest(line)
                            for column, value in zip(out, (doc, no, signed(d >> 64), signed(d & (1 << 64) - 1), line_keys(line) if near else [])):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''").mapInArrow(run, LINE)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of (key, d1, d2, ...) whose key has at least two distinct lines d1, d2."""
    line = F.struct("d1", "d2")
    several = keyed.groupBy("key").agg(F.min(line).alias("a"), F.max(line).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("key", "n")
    return hot_join(keyed, stored(several, "keys"), ["key"], "n", ["d1", "d2"])


def neighbourhood(lines: DataFrame, edits: int) -> DataFrame:
    """lines: d1, d2, doc_id, line_no, line, parts (where the differences must lie). Gives key, marks, lost and the line's d1, d2 and rank.

    A run of equal code points gives the same line whichever is lost; each place still has its own mark.
    """
    names = ["key", "marks", "lost", "d1", "d2", "doc_id", "line_no"]
    kinds = (pa.int64(), pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out: list[list] = [[] for _ in names]
                for r in batch.slice(at, 100).to_pylist():
                    places = sorted({q for p in r["parts"] for q in range(p["a"], p["b"])})
                    seen = {(signed(xxhash.xxh64_intdigest(v)), marks, lost) for v, marks, lost in variants(r["line"], places, edits)}
                    for key, marks, lost in seen:
                        for column, value in zip(out, (key, marks, lost, r["d1"], r["d2"], r["doc_id"], r["line_no"])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    return lines.select("d1", "d2", "doc_id", "line_no", "line", "parts").mapInArrow(run, "key long, marks byte, lost byte, d1 long, d2 long, doc_id long, line_no int")


def candidate_lines(docs: DataFrame, first: DataFrame, parts: int, edits: int) -> DataFrame:
    """d1, d2, doc_id, line_no, line, parts: the distinct lines that share a key with another one, and where they may differ."""
    halves = shared_keys(first.select("d1", "d2", F.explode("keys").alias("key")))
    wanted = first.select("d1", "d2", "doc_id", "line_no").join(halves.select("d1", "d2").distinct(), ["d1", "d2"])
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "d1", "d2")).alias("want"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of each document, with their keys for `parts`. Of rows with the same doc_id, the digest says which one it is."""
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: dict[str, list] = {k: [] for k in ("d1", "d2", "doc_id", "line_no", "line", "keyed")}
                for r in batch.slice(at, 200).to_pylist():
                    lines = r["text"].split("\n")
                    for w in r["want"]:
                        if w["line_no"] >= len(lines):
                            continue
                        line = lines[w["line_no"]]
                        d = xxhash.xxh3_128_intdigest(line)
                        if (signed(d >> 64), signed(d & (1 << 64) - 1)) == (w["d1"], w["d2"]):
                            for k, v in (("d1", w["d1"]), ("d2", w["d2"]), ("doc_id", r["doc_id"]), ("line_no", w["line_no"]), ("line", line)):
                                out[k].append(v)
                            out["keyed"].append([{"key": k, "a": a, "b": b} for k, a, b in part_keys(line, parts)] if edits == 1 else [{"key": 0, "a": 0, "b": len(line)}])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    schema = "d1 long, d2 long, doc_id long, line_no int, line string, keyed array<struct<key: long, a: int, b: int>>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''")
    lines = stored(source.join(per_doc, "doc_id").mapInArrow(texts, schema), "lines")
    if edits > 1:
        return lines.withColumnRenamed("keyed", "parts")
    shared = shared_keys(lines.select("d1", "d2", F.explode("keyed").alias("k")).select("d1", "d2", F.col("k.key").alias("key"), "k.a", "k.b"))
    where = shared.groupBy("d1", "d2").agg(F.collect_set(F.struct("a", "b")).alias("parts"))
    return lines.drop("keyed").join(where, ["d1", "d2"])


def near_earlier(candidates: DataFrame, edits: int) -> DataFrame:
    """d1, d2, near (doc_id, line_no), edits: for each line the earliest one within the bound, if that is earlier than itself."""
    candidates = stored(candidates, "near")
    found = neighbourhood(candidates, edits)
    rank, line = F.struct("doc_id", "line_no"), F.struct("d1", "d2")
    ranks = [F.min(F.when(F.col("lost") == k, rank)).alias(f"r{k}") for k in range(edits + 1)]
    least = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("a"), F.max(line).alias("b"), *ranks).where("a <> b").drop("a", "b")
    met = hot_join(found, stored(least, "least"), ["key"], "n", ["d1", "d2"])
    # A partner's losses, the own ones and the marks stay within the bound together.
    offers = [F.when(F.col("marks") + F.col("lost") + k <= edits, F.col(f"r{k}")) for k in range(edits + 1)]
    best = met.select("d1", "d2", rank.alias("rank"), F.array_min(F.filter(F.array(*offers), lambda x: x.isNotNull())).alias("near"))
    earliest = stored(best.where("near < rank").groupBy("d1", "d2").agg(F.min("near").alias("near")), "pairs")
    own = candidates.select("d1", "d2", F.col("line").alias("x"))
    times = stored(earliest.groupBy("near").agg(F.count(F.lit(1)).alias("n")), "partners")
    # Rows that share a doc_id can have different lines of one rank; the one within the bound is the partner.
    other = candidates.select(rank.alias("near"), F.col("line").alias("y")).groupBy("near").agg(F.collect_set("y").alias("ys")).join(times, "near")
    met = hot_join(earliest.join(own, ["d1", "d2"]), stored(other, "others"), ["near"], "n", ["d1", "d2"])
    apart = F.array_min(F.filter(F.transform("ys", lambda y: F.levenshtein("x", y, edits)), lambda e: e > 0))
    return met.select("d1", "d2", "near", apart.cast("int").alias("edits")).where("edits is not null")


def repeated_lines(docs: DataFrame, min_chars: int = 20, parts: int = 16, exact_chars: int | None = None, edits: int = 1) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, edits: each line that goes, and the earliest line within the bound."""
    if edits < 1 or min_chars < 2 * edits + 1:
        raise ValueError("min_chars is 2 * edits + 1 at least: below, parts of a line can be empty")
    parts = max(2, min(parts, min_chars - 1))
    lines = stored(lines_of(docs, min_chars, exact_chars, edits), "line")
    rank = F.struct("doc_id", "line_no")
    grouped = lines.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line_no", "keys")).alias("f"), F.max(rank).alias("last"), F.count(F.lit(1)).alias("n"))
    first = stored(grouped.select("d1", "d2", "f.doc_id", "f.line_no", "f.keys", "last", "n"), "first")
    near = near_earlier(candidate_lines(docs, first.where(F.size("keys") > 0), parts, edits), edits)
    keep = first.select("d1", "d2", "n", rank.alias("own"), "last").join(near, ["d1", "d2"], "left").where("near is not null or own <> last").drop("last")
    met = hot_join(lines.drop("keys"), stored(keep, "keep"), ["d1", "d2"], "n", ["doc_id", "line_no"])
    gone = met.withColumn("keep", F.coalesce("near", "own")).where(rank != F.col("keep"))
    return gone.select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), F.coalesce("edits", F.lit(0)).alias("edits"))


def remove_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without those lines. A document that loses all lines but blank ones goes; texts that lose nothing stay as they are."""
    mark = free_name(docs, "_gone")
    numbers = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias(mark)).withColumnRenamed("doc_id", f"{mark}id")
    joined = with_marks(docs, numbers, f"{mark}id", mark)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column("text").to_pylist()
                stays = [True] * len(texts)
                for i, numbers in enumerate(part.column(mark).to_pylist()):
                    if numbers and texts[i] is not None:
                        numbers = set(numbers)
                        texts[i] = "\n".join(x for no, x in enumerate(texts[i].split("\n")) if no not in numbers)
                        stays[i] = bool(texts[i].strip(BLANK + "\n"))
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays))

    return joined.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line by its exact repeats, lines of 20 code points or more within one edit as well."""
    return repeated_lines(read_table(spark, sf_dir, "documents"), exact_chars=1)


#: The whole deletion neighbourhood of every distinct line, without the keys that make it short.
ORACLE_SQL = r"""
WITH line AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
    FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
kept AS (SELECT * FROM line WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]')),
uniq AS (SELECT line, min((doc_id, line_no)) AS own FROM kept GROUP BY line),
place AS (SELECT line, own, unnest(range(1, length(line) + 1)) AS q FROM uniq WHERE length(line) >= 20),
less AS (SELECT line, own, q, md5(substring(line, 1, q - 1) || substring(line, q + 1)) AS v FROM place),
replaced AS (SELECT v, q, min(own) AS best FROM less GROUP BY v, q HAVING count(*) > 1),
near AS (
    SELECT l.line, r.best FROM less l JOIN replaced r ON l.v = r.v AND l.q = r.q WHERE r.best < l.own
    UNION ALL
    SELECT l.line, u.own FROM less l JOIN uniq u ON l.v = md5(u.line) WHERE u.own < l.own AND length(u.line) >= 20
    UNION ALL
    SELECT u.line, l.own FROM less l JOIN uniq u ON l.v = md5(u.line) WHERE l.own < u.own AND length(u.line) >= 20),
best AS (SELECT line, min(best) AS best FROM near GROUP BY line),
done AS (
    SELECT k.doc_id, k.line_no, coalesce(b.best, u.own) AS keep, CASE WHEN b.best IS NULL THEN 0 ELSE 1 END AS edits
    FROM kept k JOIN uniq u USING (line) LEFT JOIN best b USING (line))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(keep[1] AS BIGINT) AS keep_doc_id, CAST(keep[2] AS INTEGER) AS keep_line_no, edits
FROM done WHERE (doc_id, line_no) <> keep
"""
