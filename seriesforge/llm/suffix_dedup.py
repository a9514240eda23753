"""Removing every byte covered by a string of `width` bytes that also starts earlier, by suffix arrays built in linear grouping.

Which strings can repeat: of the grams of `gram` bytes in a window of `width` bytes, the one with the least hash
(the leftmost of equal ones) is the window's anchor. Equal windows have equal anchors at equal offsets, so
windows are compared only under the same anchor (hashes are compared by their upper 40 bits). Windows with the same anchor occurrence are one context: a
start, a count of windows and the bytes they cover. Anchors whose gram occurs once in the corpus are done after
one count; for the others

- contexts that occur again as they are go whole, but for the earliest occurrence, and
- different contexts of one gram are cut to what each has in common with another one; those that are equal then go whole, but for the
  earliest, and the others are cut anew. What still differs is put into a suffix array; equal windows stand side by side
  there, and all but the earliest go.

The suffix array comes from groups of suffixes with equal Lyndon prefixes. Groups are processed from the
greatest down: each suffix of a group points to its previous smaller suffix, and the suffixes pointed to move to
a new group behind their own, by how often they were pointed to. Then the groups' order is emitted in one pass
along the same pointers. No suffix is renamed and nothing recurs; time is linear but for small sorts.

A gram with more than `most` different contexts is not put into one task. A window has more than half of what it has
beyond the gram to one side of it, so the gram grows to that side, its contexts are dealt anew by the longer gram, and
those whose longer gram occurs once are done. After two such rounds the windows of what is still too many are digested
(128 bits) and grouped over the cluster: a window that stands in more than `most` different contexts has no order of suffixes that
one task could hold. Long texts are read in pieces that overlap by a window; the windows stay the same. A gram, context or
window with a great share of all rows is dealt over several tasks.

Nulls: a null text is an empty one. A null doc_id ranks after all others and comes back as null. Rows that share a
doc_id are documents of their own, in the order of a checksum of their text; equal rows are the same
document and get the same result. An empty table gives an empty one. Extra columns, whatever their names, are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import hot_join, read_table, stored, text_or_empty

LAST = (1 << 63) - 1
PIECE = 1 << 20
#: Bytes that are read at once, so that the arrays over them stay in a processor's cache.
BUFFER = 1 << 16
#: Bits of a place in what is read at once.
PLACE = 24


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes. The last number must be less than all others."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    group, size, start_of_end, members = [0] * n, [0] * n, [0] * n, [None] * n
    at = 0
    for c in sorted(first):
        own = first[c]
        for i in own:
            group[i] = at
        size[at], members[at], start_of_end[at + len(own) - 1] = len(own), own, at
        at += len(own)
    smaller = [-1] * n
    end = n - 1
    while end >= 0:
        g = start_of_end[end]
        times: dict[int, int] = {}
        for i in members[g]:
            if group[i] == g:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
        members[g] = None
        if times:
            most = max(times.values())
            if most == 1:
                levels = [list(times)]
            else:
                by: dict[int, list[int]] = {}
                for j, k in times.items():
                    by.setdefault(k, []).append(j)
                levels = [by[k] for k in sorted(by, reverse=True)]
            for level in levels:
                moved: dict[int, list[int]] = {}
                for j in level:
                    moved.setdefault(group[j], []).append(j)
                for v, own in moved.items():
                    left = size[v] - len(own)
                    if not left:
                        continue  # the whole group moves, to where it is
                    own.sort()
                    new = v + left
                    size[v], size[new], members[new] = left, len(own), own
                    start_of_end[new + len(own) - 1], start_of_end[new - 1] = new, v
                    for j in own:
                        group[j] = new
        end = g - 1
    order, placed, front = [0] * n, [False] * n, list(range(n))
    order[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = smaller[j]
    return order


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
ODD = 0xD6E8FEB86659FD93


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each start of a gram; gram is a power of two."""
    h, width, factor = BYTES[data], 1, ODD
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor & (1 << 64) - 1, 2 * width
    return mixed(h)


def anchors(data: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """data: texts one behind the other, ends: where each ends. Gives hash, place of the anchor, first window and number of windows."""
    none = tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(data) < width:
        return none
    if len(data) >> PLACE:
        raise ValueError(f"{len(data)} bytes at once")
    h = gram_hashes(data, gram)
    span = width - gram + 1
    # The upper bits of the hash, then the place: the least is the leftmost of those with the least upper bits.
    least, w = h >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * w <= span:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < span:
        least = np.minimum(least[: -(span - w)], least[span - w :])
    place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(data) + 1, np.int32)  # windows inside one text
    fits = ends - starts >= width
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, ends[fits] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[: len(place)]))
    if not len(at):
        return none
    own = place[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    counts = np.diff(np.append(new, len(at)))
    a = own[new].astype(np.int64)
    return h[a], a, at[new], counts


def pieces(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Buffers of about BUFFER bytes, or one piece of a text: data, ends, and for each stretch its text's number and where it begins in it."""
    held, ends, of, n = [], [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - width + 1), PIECE):
            part = text[a : a + PIECE + width - 1]
            held.append(part)
            n += len(part)
            ends.append(n)
            of.append((k, a))
            if n >= BUFFER:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(ends), of
                held, ends, of, n = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(ends), of


def scanned(docs: DataFrame, width: int, gram: int, whole: bool) -> DataFrame:
    """h of each anchor; with `whole` also doc, v, p (first window), n (windows), off (of the anchor) and c (digest of the context)."""
    names = ["h"] + ["doc", "v", "p", "n", "off", "c"] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                doc, v = part.column("doc").to_numpy(), part.column("v").to_numpy()
                for data, ends, of in pieces(texts, width):
                    h, a, p, n = anchors(data, ends, width, gram)
                    columns = [pa.array(h.view(np.int64))]
                    if whole:
                        stretch = np.searchsorted(ends, p, "right")
                        text_of, begin = np.array([k for k, _ in of])[stretch], np.array([b for _, b in of])[stretch]
                        start = np.concatenate([[0], ends[:-1]])[stretch]
                        raw, digest = data.tobytes(), xxhash.xxh64_intdigest
                        c = np.array([digest(raw[x:y]) for x, y in zip(p.tolist(), (p + n + (width - 1)).tolist())], np.uint64)
                        columns += [pa.array(x) for x in (doc[text_of], v[text_of], (p - start + begin).astype(np.int32), n.astype(np.int32), (a - p).astype(np.int32), c.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, "h long" + ", doc long, v long, p int, n int, off int, c long" * whole)


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def reach(sides: list[bytes]) -> list[int]:
    """How far each agrees with the one that agrees with it longest."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for x, y in zip(order, order[1:]):
        k = common(sides[x], sides[y])
        out[x], out[y] = max(out[x], k), max(out[y], k)
    return out


def repeated_windows(texts: list[tuple[bytes, tuple[int, int, int]]], width: int) -> Iterator[tuple[int, int, int]]:
    """texts with the rank (doc, v, place) of their first byte: the ranks of all windows that equal one of lesser rank."""
    joined: list[int] = []
    owner: list[tuple[int, int]] = []
    for k, (text, _) in enumerate(texts):
        joined += [b + 2 for b in text]
        joined.append(1)
        owner += [(k, i) for i in range(len(text) + 1)]
    joined.append(0)
    owner.append((-1, 0))
    run: list[tuple[int, int, int]] = []
    last = None
    for s in suffix_array(joined):
        k, i = owner[s]
        window = texts[k][0][i : i + width] if k >= 0 else b""
        if len(window) < width:
            continue
        doc, v, p = texts[k][1]
        if window != last:
            if len(run) > 1:
                least = min(run)
                yield from (r for r in run if r != least)
            run, last = [], window
        run.append((doc, v, p + i))
    if len(run) > 1:
        least = min(run)
        yield from (r for r in run if r != least)


def told_apart(held: list[tuple], width: int, rounds: int = 8) -> tuple[list[tuple], list[tuple]]:
    """held: doc, v, p, off, text of one gram's contexts. Gives doc, v, p, e of those that go whole, and what has to be sorted, cut.

    What of a context can repeat reaches as far as it agrees with another one on both sides of the gram. Of contexts that are equal when
    cut so, each window of a later one repeats the earliest one's at the same place, and that one decides for the rest alike. A gram
    left with one context has no repeats: windows of one context have their anchor at different offsets.
    """
    gone: list[tuple] = []
    for _ in range(rounds):
        left, right = reach([r[4][: r[3]][::-1] for r in held]), reach([r[4][r[3] :] for r in held])
        earliest: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for (doc, v, p, off, text), x, y in zip(held, left, right):
            if x + y >= width:
                key, rank = (x, text[off - x : off + y]), (doc, v, p + off - x)
                least = earliest.setdefault(key, rank)
                if least != rank:
                    earliest[key], (doc, v, p) = min(least, rank), max(least, rank)
                    gone.append((doc, v, p, p + x + y))
        size = len(held)
        held = [(*rank, x, text) for (x, text), rank in earliest.items()]
        if len(held) < 2:
            return gone, []
        if len(held) == size:
            break
    return gone, held


def sorted_contexts(contexts: DataFrame, width: int, batch_bytes: int = 60_000) -> DataFrame:
    """contexts: h, doc, v, p, off, bytes. Gives doc, v, p, e: stretches of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[bytes, tuple[int, int, int]]] = []
        whole: list[tuple[int, int, int, int]] = []
        held: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal size, held
            gone, rest = told_apart(held, width)
            whole.extend(gone)
            waiting.extend((text, (doc, v, p)) for doc, v, p, _, text in rest)
            size += sum(len(r[4]) for r in rest) + 8 * len(gone)
            held = []

        def flush() -> pa.RecordBatch:
            nonlocal waiting, whole, size
            spans: list[list[int]] = [list(x) for x in whole]
            found = sorted(set(repeated_windows(waiting, width))) if waiting else []
            waiting, whole, size = [], [], 0
            last = [None] * 4
            for doc, v, p in found:
                if last[:2] == [doc, v] and last[3] >= p:
                    last[3] = p + width
                else:
                    last = [doc, v, p, p + width]
                    spans.append(last)
            columns = list(zip(*spans)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "v", "p", "e"])

        last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "doc", "v", "p", "off", "bytes")]
            for h, *row in zip(*columns):
                if h != last and held:
                    close()
                    if size >= batch_bytes:
                        yield flush()
                held.append(tuple(row))
                last = h
        if held:
            close()
        yield flush()

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, v long, p int, e int")


def narrowed(contexts: DataFrame, width: int) -> DataFrame:
    """contexts: doc, v, p, off, g (length of the gram), bytes. Each becomes up to two, with the windows that reach far enough to the
    left of the gram and the others; h is the digest of the longer gram."""
    names = ["h", "doc", "v", "p", "off", "g", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in names]
                for r in batch.slice(at, 500).to_pylist():
                    text, off, g = r["bytes"], r["off"], r["g"]
                    left = (width - g) // 2
                    right = width - g - left + 1
                    sides = []
                    if off >= left:
                        sides.append((0, text[: off - left + width], off - left, g + left))
                    begin = max(0, off - left + 1)
                    if len(text) - begin >= width:
                        sides.append((begin, text[begin:], off - begin, g + right))
                    for shift, part, o, n in sides:
                        gram = part[o : o + n]
                        for column, value in zip(out, (xxhash.xxh64_intdigest(gram, n) - (1 << 63), r["doc"], r["v"], r["p"] + shift, o, n, part)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    found = stored(contexts.select("doc", "v", "p", "off", "g", "bytes").mapInArrow(run, "h long, doc long, v long, p int, off int, g int, bytes binary"), "narrowed")
    several = found.groupBy("h").agg(F.count(F.lit(1)).alias("u")).where("u > 1")
    return hot_join(found, stored(several.withColumn("k", F.col("u")), "grams"), ["h"], "k", ["doc", "v", "p"])


def grouped_windows(contexts: DataFrame, width: int) -> DataFrame:
    """The same for grams with very many contexts: a row for each window, grouped by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = [[] for _ in range(5)]
                for r in batch.slice(at, 200).to_pylist():
                    text = r["bytes"]
                    for i in range(len(text) - width + 1):
                        d = xxhash.xxh3_128_intdigest(text[i : i + width])
                        for column, value in zip(out, (r["doc"], r["v"], r["p"] + i, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc", "v", "p", "w1", "w2"])

    windows = contexts.mapInArrow(run, "doc long, v long, p int, w1 long, w2 long")
    rank = F.struct("doc", "v", "p")
    several = windows.groupBy("w1", "w2").agg(F.min(rank).alias("least"), F.max(rank).alias("most"), F.count(F.lit(1)).alias("k")).where("least <> most").drop("most")
    return hot_join(windows, stored(several, "windows"), ["w1", "w2"], "k", ["doc", "v", "p"]).where(rank != F.col("least")).select("doc", "v", "p", (F.col("p") + width).alias("e"))


def repeated_spans(docs: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """docs: doc, v, text. Gives doc, v, p, e: overlapping stretches of bytes that go."""
    several = stored(scanned(docs, width, gram, False).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "grams")
    found = stored(hot_join(scanned(docs, width, gram, True), several, ["h"], "k", ["doc", "v", "p"]), "anchors")
    rank = F.struct("doc", "v", "p")
    contexts = stored(found.groupBy("h", "c", "off", "n").agg(F.min(rank).alias("least"), F.max(rank).alias("most"), F.count(F.lit(1)).alias("k")), "contexts")
    copies = stored(contexts.where("least <> most").select("h", "c", "off", "n", "least", "k"), "copies")
    again = hot_join(found, copies, ["h", "c", "off", "n"], "k", ["doc", "v", "p"]).where(rank != F.col("least")).select("doc", "v", "p", (F.col("p") + F.col("n") + (width - 1)).alias("e"))
    mixed_grams = stored(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("u")).where("u > 1").withColumn("of", F.col("u")), "mixed")
    wanted = hot_join(contexts, mixed_grams, ["h"], "of", ["off", "n", "c"]).select("h", "u", "off", "n", "least.doc", "least.v", "least.p")
    per_doc = wanted.groupBy("doc", "v").agg(F.collect_list(F.struct("h", "u", "off", "n", "p")).alias("want"))
    names = ["h", "u", "doc", "v", "p", "off", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: list[list] = [[] for _ in names]
                for r in batch.slice(at, 200).to_pylist():
                    raw = r["text"].encode()
                    for w in r["want"]:
                        for column, value in zip(out, (w["h"], w["u"], r["doc"], r["v"], w["p"], w["off"], raw[w["p"] : w["p"] + w["n"] + width - 1])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names)

    texts = stored(docs.join(per_doc, ["doc", "v"]).mapInArrow(cut, "h long, u long, doc long, v long, p int, off int, bytes binary"), "bytes").withColumn("g", F.lit(gram))
    few = None
    for _ in range(2):
        small = texts.where(F.col("u") <= most).select("h", "doc", "v", "p", "off", "bytes")
        few = small if few is None else few.unionByName(small)
        texts = narrowed(texts.where(F.col("u") > most), width)
    few = few.unionByName(texts.where(F.col("u") <= most).select("h", "doc", "v", "p", "off", "bytes"))
    many = texts.where(F.col("u") > most).select("doc", "v", "p", "bytes")
    return again.unionByName(sorted_contexts(few, width)).unionByName(grouped_windows(many, width))


def merged(spans: pa.ListArray) -> tuple[list[int], list[int], list[int]]:
    """spans: a list of (p, e) for each text. Gives where each text's stretches begin among all, and their begins and ends in order; those that
    overlap or touch are one."""
    flat, of = pc.list_flatten(spans), pc.list_parent_indices(spans).to_numpy().astype(np.int64)
    own = of << 32
    p, e = (own + pc.struct_field(flat, [i]).to_numpy() for i in (0, 1))
    order = np.argsort(p, kind="stable")
    p, e, of = p[order], np.maximum.accumulate(e[order]), of[order]
    new = np.flatnonzero(np.concatenate([[True], p[1:] > e[:-1]])[: len(p)])
    first = np.searchsorted(of[new], np.arange(len(spans) + 1))
    last = np.append(new[1:], len(p))[: len(new)] - 1
    low = (1 << 32) - 1
    return first.tolist(), (p[new] & low).tolist(), (e[last] & low).tolist()


def cut_documents(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, as binary)."""
    per_doc = spans.groupBy("doc", "v").agg(F.collect_set(F.struct("p", "e")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[] for _ in names]
                first, begin, end = merged(part.column("spans"))
                for k, (doc, text) in enumerate(zip(part.column("doc").to_pylist(), part.column("text").to_pylist())):
                    raw, kept, stop, runs = text.encode(), [], 0, first[k + 1] - first[k]
                    for i in range(first[k], first[k + 1]):
                        kept.append(raw[stop : begin[i]])
                        stop = end[i]
                    kept.append(raw[stop:])
                    left = b"".join(kept)
                    for column, value in zip(out, (doc, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), left)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    return docs.join(per_doc, ["doc", "v"], "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = 32, most: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    if width < 2 * gram:
        raise ValueError("a window holds two grams at least")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_or_empty().alias("text")).withColumn("v", F.crc32("text"))
    return cut_documents(source, repeated_spans(source, width, gram, most)).select(F.nullif(F.col("doc"), F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
