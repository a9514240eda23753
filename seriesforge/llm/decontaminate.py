"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters has an error budget k = n * rate. Cut into k + 1 pieces, at least one piece stands
unchanged in any text within k edits. So the pieces are searched exactly in every whole document (one
Aho-Corasick pass), and around each hit Myers' bit-parallel distance decides whether the whole item is there.

Items of under `fuzzy_chars` normalised characters have no error budget: they are searched exactly, as whole words (in
scripts without spaces, as they stand), for within errors short items would meet by chance.

Texts and items are compared in lower case, with each run of other characters than letters and digits as one space. The
items are the stated query set: they are taken in blocks of at most `block_chars` characters, and only one block at a
time is sent to the executors. Each block is one scan of the documents.

Nulls: null or empty texts match nothing; null items, items without letters and digits, and items without an id are not
searched; a null doc_id stays null in the result. Empty tables give no hits. Texts of any length are taken whole. Of several
matches of an item in a document the one with fewest edits is returned, the first one met of equal ones; items with equal
texts are all returned. Repeated rows give repeated rows. Extra columns, whatever their names, are not read, and kept by keep_clean.
"""

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import read_table

OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def lone(c: str) -> bool:
    """Characters of scripts that are written without spaces."""
    return "\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff"


def stands_alone(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] of a normalised text is made of whole words."""
    before = a == 0 or text[a - 1] == " " or lone(text[a - 1]) or lone(text[a])
    return before and (b == len(text) or text[b] == " " or lone(text[b]) or lone(text[b - 1]))


def myers(pattern: str, peq: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any part of the text, and where such a part ends (the first one)."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best, end = score, i
            if not best:
                break
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, fuzzy_chars: int):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            k = int(len(text) * rate) if len(text) >= fuzzy_chars else 0
            peq: dict[str, int] = {}
            for i, c in enumerate(text):
                peq[c] = peq.get(c, 0) | 1 << i
            edges = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(edges, edges[1:]):
                places.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, text, k, peq if len(text) >= fuzzy_chars else None))
        self.found = ahocorasick.Automaton()
        for piece, where in places.items():
            self.found.add_word(piece, (len(piece), where))
        self.found.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, edits, and the end and window start of the best match of each item in a normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (n, where) in self.found.iter(text):
            for item, at in where:
                item_id, whole, k, peq = self.items[item]
                if best.get(item, (1,))[0] == 0:
                    continue
                origin = end - n + 1 - at
                if peq is None:
                    if stands_alone(text, origin, origin + n):
                        best[item] = 0, origin + n, origin
                    continue
                a, b = max(0, origin - k), min(len(text), origin + len(whole) + k)
                if b - a < len(whole) - k or any(x <= a and b <= y for x, y in tried.get(item, ())):
                    continue
                tried.setdefault(item, []).append((a, b))
                if len(tried[item]) > 64:
                    tried[item] = tried[item][-32:]
                window = text[a:b]
                at_once = window.find(whole)
                edits, stop = (0, at_once + len(whole)) if at_once >= 0 else myers(whole, peq, window)
                if edits <= k and (item not in best or edits < best[item][0]):
                    best[item] = edits, a + stop, a
        return [(self.items[i][0], edits, stop, a) for i, (edits, stop, a) in best.items()]


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks whose size is known before they come to the driver."""
    usable = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = usable.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(2 * total / block_chars))
    for i in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        yield sorted({(r["item_id"], t) for r in rows if (t := normal(r["text"]))})


_last: dict[str, Matcher] = {}


def matcher(name: str, items: list[tuple[int, str]], rate: float, fuzzy_chars: int) -> Matcher:
    """One matcher for each Python worker and block: Spark gives a worker many tasks."""
    if name not in _last:
        _last.clear()
        _last[name] = Matcher(items, rate, fuzzy_chars)
    return _last[name]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, fuzzy_chars: int = 40, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, edits, stop (of the match in the normalised text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    out = None
    for items in item_blocks(benchmark, block_chars):
        sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            own = matcher(name, sent.value, rate, fuzzy_chars) if sent.value else None
            for batch in batches:
                for at in range(0, batch.num_rows if own else 0, 500):
                    part = batch.slice(at, 500)
                    rows = [(doc, *hit[:3]) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for hit in own.search(normal(text))]
                    columns = list(zip(*rows)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "edits", "stop"])

        hits = texts.mapInArrow(run, "doc_id long, item_id long, edits int, stop int")
        out = hits if out is None else out.unionByName(hits)
    return out


def keep_clean(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs without those that hold an item; rows with a null doc_id stay."""
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
