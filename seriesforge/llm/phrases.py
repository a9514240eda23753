"""Phrases whose words occur together more often than their parts would have it: count-min sketches, an exact second pass, scores.

1. `sketch` hashes every phrase of 1 to 4 words of every text to one cell in each row of a count-min sketch. A cell stops
   counting at `least`, as nothing else is asked of it. The sketch has about as many cells as there are characters / 4, so it
   grows with the corpus; it is merged block by block (2 ** 24 cells at most) in Spark and exists nowhere as a whole. What comes out is
   one bit a cell, whether it reached `least`. Beyond `most_bits` cells these bits are folded by OR, so what is broadcast for
   the second pass has a fixed bound (two rows of 32 MB); folding, like a collision, only lets more phrases through.
2. `frequent` reads the texts again and counts exactly, as strings, the phrases whose cells are set in every row. An estimate
   is never below the count, so no frequent phrase is lost; the others are dropped by their exact counts.
3. `scored` cuts each candidate of two words and more at each place, `kept` drops those that a longer phrase explains, `ranked`
   takes the best of each language.

Nulls: a null text is an empty one, a null lang is `und`; doc_id is not read, so repeated rows count each. An empty table
gives no rows. Texts of any length are taken whole, in pieces of whole words. Other columns are not read. Ties are resolved
by the counts and then by the bytes of the phrase.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesforge.llm.common import hot_join, read_table, stored, text_or_empty

LONGEST = 4
ROWS = 2
#: Within a text: 0 for a byte of a word, 1 between words of one piece, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


class Words:
    """The words of some texts: the number of each in `names`, its group (the language's number), and how many words follow in its piece."""

    def __init__(self, texts: list[bytes], groups: np.ndarray):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind = KIND[raw]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        data = LOWER[raw[inside]]
        offsets = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(data)) if len(starts) else np.zeros(1, np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.word, self.names = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.group = groups[np.searchsorted(np.cumsum(size), starts, side="right")]
        breaks = np.cumsum(kind == 2, dtype=np.int64)
        piece = breaks[starts] if len(starts) else np.zeros(0, np.int64)
        n = len(starts)
        last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), n - 1) if n else np.zeros(0, np.int64)
        self.follow = last[np.searchsorted(last, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)

    def at(self, n: int) -> np.ndarray:
        """Where phrases of n words begin."""
        return np.flatnonzero(self.follow >= n - 1)

    def hashes(self, names: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: where phrases begin and their hashes, which depend on the language and the words alone."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names], U)
        base = np.array([xxhash.xxh3_64_intdigest(g, seed=1) for g in names], U)
        h = base[self.group]
        for n in range(1, LONGEST + 1):
            at = self.at(n)
            nxt = np.zeros(len(self.word), U)
            nxt[at] = mixed(h[at] + ODD[0] * own[self.word[at + n - 1]])
            h = nxt
            yield n, at, h[at]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * ODD[1]
    return x ^ (x >> U(29))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(h + U((row + 1) * int(ODD[0]) % 2**64)) >> U(64 - bits)


def portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], np.ndarray, list[str]]]:
    """Texts of about `most` bytes together, with the number of each one's language among the names. Longer texts are cut between pieces."""
    texts, groups, names, size = [], [], {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_py()
            for part in pieces(data, most):
                texts.append(part)
                groups.append(names.setdefault(lang, len(names)))
                size += len(part)
                if size >= most:
                    yield texts, np.array(groups), list(names)
                    texts, groups, names, size = [], [], {}, 0
    if texts:
        yield texts, np.array(groups), list(names)


def pieces(data: bytes, most: int) -> Iterator[bytes]:
    """The text itself, or parts of it that end where a piece does, if it is longer than `most`. A part without any such place is whole."""
    at = 0
    while len(data) - at > most:
        ends = [k for k in (data.find(bytes([c]), at + most) for c in np.flatnonzero(KIND == 2)) if k >= 0]
        if not ends:
            break
        yield data[at : min(ends)]
        at = min(ends)
    yield data[at:]


def rows_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).cast("binary").alias("text"))


def packed(offsets: np.ndarray) -> bytes:
    """Sorted offsets of a block, as compressed steps."""
    steps = np.diff(offsets.astype("<i4"), prepend=np.int32(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel(), dtype=np.int64)


def block_bits(bits: int) -> int:
    """Cells of a block: a 64th of the sketch, 2 ** 24 at most. So there are 64 blocks, and more only where a task could not hold one."""
    return max(6, min(24, bits - 6))


def sketch(rows: DataFrame, least: int, bits: int, portion: int) -> DataFrame:
    """row, block, set: one bit for each cell of the merged sketch that counted `least` or more phrases."""
    width = block_bits(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, groups, names in portions(batches, portion):
            h = np.concatenate([x for _, _, x in Words(texts, groups).hashes(names)])
            for row in range(ROWS):
                c = np.sort(cells(h, row, bits))
                # A cell keeps at most `least` of a portion.
                c = c[~np.concatenate([np.zeros(min(least, len(c)), bool), c[least:] == c[: len(c) - least]])] if len(c) > least else c
                block = (c >> U(width)).astype(np.int64)
                at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(c) else np.zeros(0, int)
                parts = np.split((c & U((1 << width) - 1)).astype(np.int32), at[1:]) if len(c) else []
                for lo in range(0, len(at), 1000):
                    own = at[lo : lo + 1000]
                    yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(own), row), pa.int32()), "block": block[own], "cells": pa.array([packed(o) for o in parts[lo : lo + 1000]], pa.binary())})

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(1 << width, np.uint32)
        for blob in parts["cells"]:
            offsets = unpacked(blob.as_py())
            at = np.flatnonzero(np.concatenate([[True], offsets[1:] != offsets[:-1]]))
            total[offsets[at]] += np.diff(np.append(at, len(offsets))).astype(np.uint32)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": [key[1].as_py()], "set": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    counted = rows.mapInArrow(count, "row int, block long, cells binary")
    return counted.groupBy("row", "block").applyInArrow(merge, "row int, block long, set binary")


def folded(blocks: DataFrame, bits: int, most_bits: int) -> list[np.ndarray]:
    """The rows of the sketch as bits, at most 2 ** most_bits each: blocks that fall together are joined by OR in Spark."""
    width, step = 1 << min(bits, most_bits), 1 << block_bits(bits)

    def either(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "fold": [key[1]], "set": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts["set"]]).tobytes()]})

    small = blocks.withColumn("fold", F.col("block") % (width // step))
    if bits > most_bits:
        small = small.groupBy("row", "fold").applyInPandas(either, "row int, fold long, set binary")
    out = [np.zeros(width // 8, np.uint8) for _ in range(ROWS)]
    for r in small.select("row", "fold", "set").toLocalIterator():
        out[r["row"]][r["fold"] * (step // 8) : (r["fold"] + 1) * (step // 8)] = np.frombuffer(r["set"], np.uint8)
    return out


def frequent(rows: DataFrame, least: int = 30, most_bits: int = 28, portion: int = 4_000_000) -> DataFrame:
    """lang, phrase, f: all phrases of 1 to 4 words with their exact counts, where these reach `least`; and for each lang a row without phrase, whose f counts its words."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(16, math.ceil(math.log2(max(1, chars / 4))))
    shared = rows.sparkSession.sparkContext.broadcast(folded(stored(sketch(rows, least, bits, portion), "phrase-sketch"), bits, most_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, fold = shared.value, U((1 << min(bits, most_bits)) - 1)
        for texts, groups, names in portions(batches, portion):
            words = Words(texts, groups)
            number = np.bincount(words.group, minlength=len(names))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(names), "phrase": pa.nulls(len(names), pa.string()), "f": number.astype(np.int64)})
            # Equal phrases get equal numbers, exactly: a phrase is the number of its beginning and its last word.
            ids = words.group
            own = np.array(words.names, object)
            text = np.array([], object)
            for n, at, h in words.hashes(names):
                may = np.ones(len(at), bool)
                for row, bitmap in enumerate(maps):
                    c = cells(h[may], row, bits) & fold
                    may[may] = bitmap[c >> U(3)] >> (U(7) - (c & U(7))).astype(np.uint8) & 1 == 1
                at = at[may]
                if n > 1:
                    at = at[ids[at] >= 0]
                key = ids[at].astype(np.int64) * len(own) + words.word[at + n - 1]
                distinct, where, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                last = own[words.word[at[where] + n - 1]]
                group = words.group[at[where]]
                text = last if n == 1 else text[ids[at[where]]] + b" " + last
                ids = np.full(len(words.word), -1, np.int64)
                ids[at] = inverse
                for lo in range(0, len(distinct), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(np.array(names, object)[group[part]]), "phrase": pa.array(text[part], pa.binary()).cast(pa.string()), "f": times[part].astype(np.int64)})

    return rows.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of each phrase of two words and more, at its lowest-scoring cut. counts is stored and holds each part of a phrase in it."""
    word = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size(word) - 1)).alias("k")
    cuts = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.size(word).alias("words"), F.col("f").alias("a"), cut)
    cuts = cuts.withColumn("_first", F.expr("substring_index(phrase, ' ', k)")).withColumn("_rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = stored(cuts, "phrase-cuts")
    parts = cuts.select("lang", F.explode(F.array("_first", "_rest")).alias("part")).groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    found = stored(parts.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "phrase-parts")
    with_first = hot_join(cuts, found.withColumnsRenamed({"part": "_first", "f": "l"}), ["lang", "_first"], "uses", ["phrase"])
    both = hot_join(with_first, found.withColumnsRenamed({"part": "_rest", "f": "r"}), ["lang", "_rest"], "uses", ["phrase"])
    exact = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(8,0))) div (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)")
    best = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def kept(candidates: DataFrame, share: int = 80) -> DataFrame:
    """candidates (stored) without those whose words stand side by side in a longer one that occurs at least `share` per cent as often."""
    word = F.split("phrase", " ")
    begins = lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))
    longer = candidates.where("words > 2").withColumn("w", word)
    inner = longer.select("lang", "a", F.explode(F.array_distinct(F.concat(begins(2), F.when(F.col("words") > 3, begins(3)).otherwise(F.array().cast("array<string>"))))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    return joined.where(F.expr(f"_most IS NULL OR 100 * CAST(_most AS DECIMAL(20,0)) < {share} * CAST(a AS DECIMAL(20,0))")).drop("_most")


def ranked(rows: DataFrame, most: int, deal: int = 64) -> DataFrame:
    """The first `most` rows of each lang with their rank: first of each of `deal` shares, then of all that is left."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    w = lambda *by: Window.partitionBy("lang", *by).orderBy(*order)
    shares = rows.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(deal)))
    some = shares.withColumn("_r", F.row_number().over(w("_deal"))).where(F.col("_r") <= most).drop("_deal", "_r")
    return some.withColumn("rank", F.row_number().over(w())).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2000, most_bits: int = 28, portion: int = 4_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counts = stored(frequent(rows_of(docs), least, most_bits, portion), "phrase-counts")
    candidates = stored(scored(counts.where("phrase is not null")), "phrase-scores")
    n = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked(kept(candidates, share), most).join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(flatten([[array_to_string(w[i : i + n - 1], ' ') for i in range(1, len(w) - n + 2)] for n in range(1, 5)])) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
k AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (CAST(k.a AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS score FROM k
        JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 :], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, a, unnest(flatten([[array_to_string(w[i : i + n - 1], ' ') for i in range(1, len(w) - n + 2)] for n in range(2, len(w))])) AS phrase FROM c WHERE len(w) > 2),
m AS (SELECT lang, phrase, max(a) AS most FROM i GROUP BY 1, 2),
r AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
