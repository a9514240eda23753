"""Line, sentence and stretch hashing: the earliest occurrence of a unit stays, the others are cut out, offsets kept.

Units are lines that are not blank, sentences of `min_sentence_words` words inside a line, and stretches: a line is cut
after each word whose hash (with the next word) is the least of `reach` words to either side, so that a passage is cut alike
wherever it stands, and what a line repeats of a longer one is found as well; stretches have more than `reach` words.
A character of a script without spaces (Chinese, Japanese, Thai and others of such kind) counts as a word.

Units are normalised (lower case, one space between words) and digested to 128 bits, whatever their kind. Digests are
grouped over the whole corpus; rank is (doc_id, start). A unit inside another one that goes is not listed again. A digest
with a great share of all units is dealt over several tasks.

Nulls: a null or empty text has no units, and an empty table gives none; rows with a null doc_id have no rank, so they are
neither compared nor changed. Rows that share a doc_id (repeated rows) have equal ranks, so what they repeat of each other
at the same offset stays. Texts of any length are taken whole; a document's own units are held at once. Extra columns,
whatever their names, are kept by remove_units and not read; one called `kept` is replaced.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import free_name, hot_join, read_table, stored, with_marks

#: Scripts that are written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Chinese characters.
LONE = "฀-໿ༀ-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
WORD = re.compile(f"[{LONE}]|[^\\s{LONE}]+")
KINDS = ("line", "sentence", "stretch")
UNIT = "doc_id long, start int, stop int, kind byte, d1 long, d2 long"
#: Characters that are read at once, so that the arrays over them stay in a processor's cache; one text is never divided.
BUFFER = 1 << 17

#: Of each code point below 65,536; the others belong to words.
CLASS = np.zeros(1 << 16, np.uint8)
IN_SPACE, IN_LONE, IN_STOP, IN_WIDE_STOP = 1, 2, 3, 4
CLASS[[c for c in range(1 << 16) if chr(c).isspace()]] = IN_SPACE
for _first, _last in re.findall("(.)-(.)", LONE):
    CLASS[ord(_first) : ord(_last) + 1] = IN_LONE
CLASS[[ord(c) for c in ".!?"]], CLASS[[ord(c) for c in "。！？"]] = IN_STOP, IN_WIDE_STOP


def lowered(text: str) -> str:
    """Each word in lower case. A sigma's form depends on what follows, so there the words are taken one by one."""
    return WORD.sub(lambda m: m[0].lower(), text) if "Σ" in text else text.lower()


def cuts_of(c: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """Numbers of the words that a cut follows: local minima of the hashes of two neighbouring words. c, line: of each word."""
    if len(c) < 2 * reach + 2:
        return np.empty(0, np.int64)
    h = (c[:-1] * np.uint64(0x9E3779B1) + c[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)
    least = h[: len(h) - reach + 1]
    for i in range(1, reach):
        least = np.minimum(least, h[i : len(h) - reach + 1 + i])
    own = h[reach : len(h) - reach]
    # Of equal ones none is a cut: where words repeat, no place stands out.
    lowest = (own < least[: len(own)]) & (own < least[reach + 1 :])
    return np.flatnonzero(lowest & (line[: len(own)] == line[2 * reach + 1 :])) + reach


def units_of(texts: list[str], min_sentence_words: int, reach: int) -> tuple[np.ndarray, ...]:
    """Number of the text, start, stop, number of the kind and the halves of the digest of each unit. All texts are taken as one row of characters."""
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    chars = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32)
    kind = CLASS[np.minimum(chars, np.uint32(0xFFFF))]
    space, lone = kind == IN_SPACE, kind == IN_LONE
    apart = space | lone  # no word goes on from here
    first = np.flatnonzero(~space & (lone | np.concatenate([[True], apart[:-1]])))
    stop = np.flatnonzero(~space & (lone | np.concatenate([apart[1:], [True]]))) + 1
    n = len(first)
    if not n:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int8, np.int64, np.int64))
    breaks = np.flatnonzero(chars == 10)
    at_line = np.searchsorted(breaks, first)
    lines = np.flatnonzero(np.concatenate([[True], at_line[1:] != at_line[:-1]]))  # the first word of each line that is not blank
    after = np.append(lines[1:], n)
    line = np.repeat(np.arange(len(lines)), after - lines)

    # The words in lower case with one space between them.
    low = "".join(lowered(t) + "\n" for t in texts)
    raw = low.encode()
    data = np.frombuffer(raw, np.uint8)
    a, b = first, stop
    if len(low) != len(chars):  # a dotted capital I becomes two characters
        more = np.cumsum(chars == 0x130)
        a, b = a + more[a] - (chars[a] == 0x130), b + more[b - 1]
    if len(raw) != len(low):
        place = np.flatnonzero((data & 0xC0) != 0x80)
        a, b = place[a], place[b]
    length = b - a
    to = np.cumsum(length + 1) - (length + 1)
    joined = data[np.repeat(a - to, length + 1) + np.arange(to[-1] + length[-1] + 1)]
    joined[to + length] = 32
    words = joined.tobytes()

    edge = np.zeros(n + 1, bool)
    edge[lines] = True
    ends = np.flatnonzero((kind[:-1] == IN_STOP) & space[1:] & (chars[1:] != 10) | (kind[:-1] == IN_WIDE_STOP)) + 1
    edge[np.searchsorted(first, ends)] = True
    s = np.flatnonzero(edge[:n])
    e = np.append(s[1:], n)
    own = (e - s >= min_sentence_words) & (e - s < (after - lines)[line[s]])
    cuts = cuts_of(np.fromiter(map(zlib.crc32, words[:-1].split(b" ")), np.uint64, n), line, reach)
    edge[:] = False
    edge[cuts + 1], edge[lines[line[cuts]]] = True, True
    p = np.flatnonzero(edge[:n])
    q = np.minimum(np.append(p[1:], n), after[line[p]])

    i, j = np.concatenate([lines, s[own], p]), np.concatenate([after, e[own], q])
    before = np.concatenate([[0], breaks + 1])[at_line[lines]]
    start, end = np.concatenate([before, first[s[own]], first[p]]), np.concatenate([breaks[at_line[lines]], stop[e[own] - 1], stop[q - 1]])
    digest = xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join([digest(words[x:y]) for x, y in zip(to[i].tolist(), (to[j - 1] + length[j - 1]).tolist())]), ">u8").astype(np.uint64).reshape(-1, 2)
    d = (d ^ np.uint64(1 << 63)).view(np.int64)
    of = np.searchsorted(begin, start, "right") - 1
    number = np.repeat(np.arange(3, dtype=np.int8), [len(lines), len(s[own]), len(p)])
    return of, (start - begin[of]).astype(np.int32), (end - begin[of]).astype(np.int32), number, np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1])


def units(docs: DataFrame, min_sentence_words: int, reach: int) -> DataFrame:
    names = ["doc_id", "start", "stop", "kind", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, size = batch.column("doc_id").to_numpy(), [], 0
            for k, text in enumerate(batch.column("text")):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BUFFER or k == batch.num_rows - 1:
                    of, *columns = units_of(texts, min_sentence_words, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[of + (k + 1 - len(texts))], *columns)], names)
                    texts, size = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''").mapInArrow(run, UNIT)


def outermost(spans: list[dict]) -> list[dict]:
    """Spans that lie in no other one; of equal ones the first kind stays."""
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"], s["kind"])):
        if s["stop"] > end:
            out.append(s)
            end = s["stop"]
    return out


def repeated_units(docs: DataFrame, min_sentence_words: int = 8, reach: int = 6) -> DataFrame:
    """doc_id, start, stop, kind, keep_doc_id, keep_start: each unit that goes, and the earliest one that stays for it."""
    found = stored(units(docs, min_sentence_words, reach), "units")
    rank = F.struct("doc_id", "start")
    first = found.groupBy("d1", "d2").agg(F.min(rank).alias("keep"), F.max(rank).alias("last"), F.count(F.lit(1)).alias("n")).where("keep <> last").select("d1", "d2", "keep", "n")
    gone = hot_join(found, stored(first, "repeated"), ["d1", "d2"], "n", ["doc_id", "start"]).where("struct(doc_id, start) <> keep")
    # The spans of one document come together; their number is bounded by its length.
    per_doc = gone.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "kind", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"))).alias("spans"))
    names = ["start", "stop", "kind", "keep_doc_id", "keep_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = [(r["doc_id"], s) for r in batch.slice(at, 200).to_pylist() for s in outermost(r["spans"])]
                columns = [pa.array([d for d, _ in rows], pa.int64())]
                columns += [pa.array([KINDS[s[c]] if c == "kind" else s[c] for _, s in rows], pa.string() if c == "kind" else pa.int64() if c == "keep_doc_id" else pa.int32()) for c in names]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    return per_doc.mapInArrow(run, "doc_id long, start int, stop int, kind string, keep_doc_id long, keep_start int")


def remove_units(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with their text cut, and `kept`: the pieces that stay as (start, stop) of the original text."""
    rest = docs.drop("kept").withColumn("text", F.col("text").cast("string"))
    mark = free_name(docs, "_spans")
    spans = gone.groupBy(F.col("doc_id").alias(f"{mark}id")).agg(F.collect_set(F.struct("start", "stop")).alias(mark))
    joined = with_marks(rest, spans, f"{mark}id", mark)
    names, kept_type = rest.columns, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, kept = part.column("text").to_pylist(), []
                for i, cut in enumerate(part.column(mark).to_pylist()):
                    text, own, end = texts[i] or "", [], 0
                    for a, b in sorted((s["start"], s["stop"]) for s in cut or ()):
                        a, b = min(a, len(text)), min(b, len(text))
                        if a > end:
                            own.append({"start": end, "stop": a})
                        end = max(end, b)
                    if end < len(text):
                        own.append({"start": end, "stop": len(text)})
                    if texts[i] is not None:
                        texts[i] = "".join(text[s["start"] : s["stop"]] for s in own)
                    kept.append(own if texts[i] is not None else None)
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, kept_type)], [*names, "kept"])

    schema = rest.withColumn("kept", F.lit(None).cast("array<struct<start: int, stop: int>>")).schema
    return joined.mapInArrow(run, schema)


def op3_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(read_table(spark, sf_dir, "documents"))
