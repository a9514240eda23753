"""Context-tree weighting over bytes, learned from a corpus by Spark, and the code length of every text under it.

A byte is eight binary decisions. Each decision has its own tree of contexts, the up to `depth` bytes before the byte; each
node estimates its bit by Krichevsky and Trofimov from its two counts, and a node's weighted probability of what it saw is half
its own estimate and half the product of its children's. Sums of logarithms make that additive, so the tree is built by levels:

1. `bundles` reads the texts in bundles of about `bundle_bytes` and packs each bundle's distinct byte strings of depth + 1
   bytes with their training counts, and its distinct words with theirs (these for the base score), dealt over shards by a hash.
   There are as many shards as bundles, so a shard holds about as much as a bundle at any size of the corpus.
2. `distinct_strings` adds the counts up shard by shard. A string is in a shard once for each bundle that has it.
3. `top_levels` deals the distinct strings by the last three bytes of their contexts, so that each task has whole subtrees; it
   builds their nodes from the deepest up to depth three and sums what they found to the levels above. Contexts that agree in
   three bytes have at most 256 ** (depth - 2) strings between them, however large the corpus is.
4. `string_values` gives each distinct string its probability: mixed from the deepest node to the root, where a node weighs its
   own estimate against its children's by what both made of the training bytes.
5. `answers` hands these back shard by shard to the bundles, `scored` adds them up text by text.

Tables that grow with the corpus are only grouped by keys, packed, and each is written. Broadcast are the levels above three: at
most 65,793 contexts of 255 nodes whatever the input (24 bytes each; some 30,000 nodes on text).

The text that is modelled is the canonical form of the tokens: A-Z in lower case, each word followed by one space, and a line
feed as the end. It stands for the sequence of tokens, no more and no less, so its probability can be compared with that of
any model of these tokens. Contexts before the start of a text are zero bytes.

Nulls: a null text is an empty one (its end alone is scored); a row with a null doc_id is held out. Repeated rows are scored
each. Empty tables give no rows; without training texts each bit has the probability one half. Texts of any length are taken
whole. Other columns are not read, whatever their names.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import dropped, read_table, stored, text_or_empty

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
#: Contexts that agree in so many last bytes are one group; the levels above are broadcast.
SHARED = 3
U = np.uint64


def held_out(doc_id: str = "doc_id", parts: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(True))


# ---- bundles of texts


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts in lower case, each followed by a space; the words' ends; the texts' numbers of bytes."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = IS_SPACE[raw]
    ends = space.copy()
    ends[0:1] = False
    ends[1:] &= ~space[:-1]
    keep = ~space | ends
    out = LOWER[raw[keep]]
    out[ends[keep]] = 32
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return out, np.flatnonzero(ends[keep]) + 1, np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64)


def words_in(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct words, and these, with their space."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def strings_of(data: np.ndarray, lengths: np.ndarray, depth: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the string of each byte of the canonical texts with their end (its context, last byte first, then the byte
    itself, as one number) and the number of the text. Longer texts come in pieces."""
    starts = np.cumsum(lengths) - lengths
    first = 0
    while first < len(lengths):
        last = first + 1
        while last < len(lengths) and starts[last] + lengths[last] - starts[first] < most:
            last += 1
        own = lengths[first:last]
        size = own + 1 + depth
        begins = np.cumsum(size) - size
        doc = np.repeat(np.arange(last - first), own)
        out = np.zeros(int(size.sum()), np.uint8)
        out[np.arange(len(doc)) + np.repeat(begins + depth - (np.cumsum(own) - own), own)] = data[starts[first] : starts[first] + own.sum()]
        out[begins + size - 1] = 10
        real = np.ones(len(out), bool)
        real[(begins[:, None] + np.arange(depth)).ravel()] = False
        text = np.repeat(np.arange(first, last), size)
        for lo in range(depth, len(out), most):
            hi = min(len(out), lo + most)
            code = out[lo:hi].astype(U)
            for k in range(1, depth + 1):
                code |= out[lo - k : hi - k].astype(U) << U(8 * (depth + 1 - k))
            yield code[real[lo:hi]], text[lo:hi][real[lo:hi]]
        first = last


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return (keys[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values])


def string_counts(data: np.ndarray, lengths: np.ndarray, learn: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of a bundle and how often each occurs in its training texts."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return parts[0] if len(parts) == 1 else summed(*(np.concatenate(p) for p in zip(*parts)))

    for code, text in strings_of(data, lengths, depth):
        marked = np.sort(code << U(1) | learn[text].astype(U))
        at = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]]))
        n = np.diff(np.append(at, len(marked)))
        key = marked[at]
        new = np.concatenate([[True], (key[1:] ^ key[:-1]) > 1]) if len(key) else np.zeros(0, bool)
        parts.append((key[new] >> U(1), np.add.reduceat(n * (key & U(1)).astype(np.int64), np.flatnonzero(new))))
        if len(parts) >= 6:
            parts = [merge()]
    return merge()


PACKED = "bundle long, kind int, shard int, ids array<long>, held array<boolean>, sizes array<long>, a binary, b binary"
TEXTS, STRINGS, WORDS = range(3)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, as compressed steps; best if they are in order or small."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


def table(schema: str, **columns: list) -> pa.Table:
    """Columns by name, NULL where not given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    n = len(next(iter(columns.values())))
    return pa.table({c: pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in (x.split(" ") for x in schema.split(", "))})


def in_shards(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places that belong to it, in order."""
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(shard) else np.zeros(0, int)
    for part in np.split(order, at[1:]) if len(shard) else ():
        yield int(shard[part[0]]), part


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(29)) * U(0x9E3779B97F4A7C15)
    return x ^ x >> U(32)


def string_shards(strings: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(strings) % U(shards)).astype(np.int64)


def word_shards(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % shards


def bundles(docs: DataFrame, depth: int, bundle_bytes: int, shards: int) -> DataFrame:
    """Rows of three kinds: a bundle's texts; its distinct strings in a shard; its distinct words in a shard, both with training counts. Store it:
    bundles get their numbers at random."""

    def pack(ids: list, held: list, texts: list) -> pa.Table:
        number = int.from_bytes(np.random.bytes(7), "little")
        data, ends, sizes = canonical(texts)
        texts.clear()
        learn = ~np.array(held, bool)
        strings, n = string_counts(data, sizes, learn, depth)
        rows = [(STRINGS, k, packed(strings[at]), packed(n[at])) for k, at in in_shards(string_shards(strings, shards))]
        word, names = words_in(data, ends)
        names = names.to_pylist()
        n = np.bincount(word, learn[np.searchsorted(np.cumsum(sizes), ends, side="left")], len(names)).astype(np.int64)
        rows += [(WORDS, k, zlib.compress(b"".join(names[i] for i in at), 1), packed(n[at])) for k, at in in_shards(word_shards(names, shards))]
        kind, shard, a, b = (list(c) for c in zip((TEXTS, None, zlib.compress(data.tobytes(), 1), None), *rows))
        none = [None] * len(rows)
        return table(PACKED, bundle=[number] * len(kind), kind=kind, shard=shard, ids=[ids, *none], held=[held, *none], sizes=[sizes.tolist(), *none], a=a, b=b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(*(batch.column(c) for c in ("doc_id", "held", "text"))):
                ids.append(i.as_py())
                held.append(h.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= bundle_bytes:
                    yield from pack(ids, held, texts).to_batches(64)
                    ids, held, texts, size = [], [], [], 0
        if texts:
            yield from pack(ids, held, texts).to_batches(64)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, PACKED)


# ---- the tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series eight places further up."""
    y, below = x + 8, np.ones_like(x)
    for k in range(8):
        below = below * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - np.log(below)


def own_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    a, b = n0.astype(float), n1.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)


def both_halves(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    m = np.maximum(own, children)
    return m + np.log(0.5 * np.exp(own - m) + 0.5 * np.exp(children - m))


class Level:
    """The nodes of one depth: keys (context, bit path) in order, the probability of a one, and the weight of the own estimate."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None):
        own = own_log(n0, n1)
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)
        self.log = own if children is None else both_halves(own, children)
        self.weight = np.ones(len(keys)) if children is None else 1 / (1 + np.exp(-np.clip(own - children, -700, 700)))

    def mix(self, nodes: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """The probability of a one at each node, given what the deeper levels say; one half where the node was never seen."""
        if not len(self.keys):
            return np.full(len(nodes), 0.5)
        at = np.minimum(np.searchsorted(self.keys, nodes), len(self.keys) - 1)
        seen = self.keys[at] == nodes
        p = self.one[at] if deeper is None else self.weight[at] * self.one[at] + (1 - self.weight[at]) * deeper
        return np.where(seen, p, 0.5)


def node_keys(strings: np.ndarray, depth: int, d: int, bit: int) -> np.ndarray:
    """The node at depth d that decides the bit: the d nearest bytes of the context, then the bits before it under a leading one."""
    context = strings >> U(8 * (depth + 1 - d)) if d else np.zeros_like(strings)
    return context << U(8) | U(1 << bit) | (strings & U(255)) >> U(8 - bit)


def levels(strings: np.ndarray, counts: np.ndarray, depth: int, least: int) -> dict[int, Level]:
    """Levels depth to `least` of whole groups of training strings, which are in order."""
    out: dict[int, Level] = {}
    for d in range(depth, least - 1, -1):
        byte = strings if d == depth else (strings >> U(8 * (depth + 1 - d)) << U(8) | strings & U(255))
        byte, n = (strings, counts) if d == depth else summed(byte, counts)
        found = []
        for bit in range(8):
            node = byte >> U(8) << U(8) | U(1 << bit) | (byte & U(255)) >> U(8 - bit)
            at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            ones = np.add.reduceat(n * (byte >> U(7 - bit) & U(1)).astype(np.int64), at)
            found.append((node[at], np.add.reduceat(n, at) - ones, ones))
        keys, n0, n1 = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(keys)
        children = None if d == depth else upper(out[d + 1].keys, out[d + 1].log)
        out[d] = Level(keys[order], n0[order], n1[order], children)
    return out


def upper(keys: np.ndarray, log: np.ndarray) -> np.ndarray:
    """Sums of the nodes' logarithms for the nodes one byte less deep, in order of their keys."""
    return summed(keys >> U(16) << U(8) | keys & U(255), log)[1]


DISTINCT = "shard int, part int, strings binary, train binary"


def distinct_strings(blobs: DataFrame, depth: int, shards: int) -> DataFrame:
    """Each shard's distinct strings with their training counts over all bundles, dealt to parts that hold whole subtrees."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        strings, train = summed(*(np.concatenate([unpacked(b) for b in rows[c].to_pylist()]) for c in ("a", "b")))
        part = string_shards(strings.astype(U) >> U(8 * (depth + 1 - SHARED)), shards)
        out = [(k, packed(strings[at]), packed(train[at])) for k, at in in_shards(part)]
        return table(DISTINCT, shard=[key[0].as_py()] * len(out), part=[o[0] for o in out], strings=[o[1] for o in out], train=[o[2] for o in out])

    return blobs.groupBy("shard").applyInArrow(add, DISTINCT)


def part_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A part's strings in order, and their counts."""
    strings, train = (np.concatenate([unpacked(b) for b in rows[c].to_pylist()]) for c in ("strings", "train"))
    order = np.argsort(strings)
    return strings[order].astype(U), train[order]


def top_levels(distinct: DataFrame, depth: int) -> dict[int, Level]:
    """Levels 0 to 2 of the tree."""

    def build(rows: pa.Table) -> pa.Table:
        strings, train = part_of(rows)
        if not (train > 0).any():
            return table("node long, log double, n0 long, n1 long", node=[])
        level = levels(strings[train > 0], train[train > 0], depth, SHARED)[SHARED]
        keys, log, n0, n1 = summed(level.keys >> U(16) << U(8) | level.keys & U(255), level.log, level.n0, level.n1)
        return pa.table({"node": keys.astype(np.int64), "log": log, "n0": n0, "n1": n1})

    nodes = distinct.groupBy("part").applyInArrow(build, "node long, log double, n0 long, n1 long")
    # At most 65,536 contexts of 255 nodes come to the driver; each is one row by now.
    top = nodes.groupBy("node").agg(F.sum("log").alias("log"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().sort_by("node")
    keys, log, n0, n1 = (top[c].to_numpy() for c in ("node", "log", "n0", "n1"))
    keys, out = keys.astype(U), {}
    for d in range(SHARED - 1, -1, -1):
        out[d] = Level(keys, n0, n1, log)
        keys, log, n0, n1 = summed(keys >> U(16) << U(8) | keys & U(255), out[d].log, n0, n1)
    return out


def log10_probabilities(strings: np.ndarray, deep: dict[int, Level], top: dict[int, Level], depth: int) -> np.ndarray:
    """log10 of the probability of each string's last byte after its context."""
    out = np.zeros(len(strings))
    for bit in range(8):
        p = None
        for d in range(depth, -1, -1):
            p = (deep if d >= SHARED else top)[d].mix(node_keys(strings, depth, d, bit), p)
        out += np.log10(np.where(strings >> U(7 - bit) & U(1) == 1, p, 1 - p))
    return out


def string_values(distinct: DataFrame, top: dict[int, Level], depth: int, shards: int) -> DataFrame:
    """shard, strings, values: log10 of the probability of each distinct string, handed back to its shard."""
    shared = distinct.sparkSession.sparkContext.broadcast(top)
    nothing = {d: Level(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), None) for d in range(depth + 1)}

    def score(rows: pa.Table) -> pa.Table:
        strings, train = part_of(rows)
        deep = levels(strings[train > 0], train[train > 0], depth, SHARED) if (train > 0).any() else nothing
        values = log10_probabilities(strings, deep, shared.value, depth)
        out = [(k, packed(strings[at]), values[at].tobytes()) for k, at in in_shards(string_shards(strings, shards))]
        return table(VALUES, shard=[o[0] for o in out], strings=[o[1] for o in out], values=[o[2] for o in out])

    return distinct.groupBy("part").applyInArrow(score, VALUES)


VALUES = "shard int, strings binary, values binary"
ANSWER = "bundle long, kind int, shard int, a binary, b binary, known long, total long"


def string_answers(blobs: DataFrame, values: DataFrame) -> DataFrame:
    """Each bundle's strings of each shard with their values."""

    def hand_back(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, v = np.concatenate([unpacked(b) for b in right["strings"].to_pylist()]), np.concatenate([np.frombuffer(b, float) for b in right["values"].to_pylist()])
        order = np.argsort(keys)
        keys, v = keys[order], v[order]
        b = [v[np.searchsorted(keys, unpacked(a))].tobytes() for a in left["a"].to_pylist()]
        return table(ANSWER, bundle=left["bundle"].to_pylist(), kind=[STRINGS] * len(b), shard=left["shard"].to_pylist(), a=left["a"].to_pylist(), b=b)

    small = blobs.select("bundle", "shard", "a")
    return small.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(hand_back, ANSWER)


def word_answers(blobs: DataFrame) -> DataFrame:
    """The training count over all bundles of each bundle's words of each shard; a shard's first row has its known words and their total."""

    def add(rows: pa.Table) -> pa.Table:
        words = [zlib.decompress(a).split(b" ")[:-1] for a in rows["a"].to_pylist()]
        sizes = np.cumsum([len(w) for w in words])
        each = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
        total = np.zeros(len(each.dictionary), np.int64)
        at = each.indices.to_numpy()
        np.add.at(total, at, np.concatenate([unpacked(b) for b in rows["b"].to_pylist()]))
        b = [packed(x) for x in np.split(total[at], sizes[:-1])]
        rest = [0] * (len(b) - 1)
        return table(ANSWER, bundle=rows["bundle"].to_pylist(), kind=[WORDS] * len(b), shard=rows["shard"].to_pylist(), b=b, known=[int((total > 0).sum()), *rest], total=[int(total.sum()), *rest])

    return blobs.select("bundle", "shard", "a", "b").groupBy("shard").applyInArrow(add, ANSWER)


# ---- scores of texts


RESULT = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double"


def scored(texts: DataFrame, answers: DataFrame, ends: int, depth: int, shards: int) -> DataFrame:
    """One row for each text from its bundle and the bundle's answers."""

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0].as_py() for c in ("ids", "held", "sizes", "a")}
        sizes, data = np.array(row["sizes"], np.int64), np.frombuffer(zlib.decompress(row["a"]), np.uint8)
        of_strings, of_words = (right.filter(pc.equal(right["kind"], k)) for k in (STRINGS, WORDS))
        keys = np.concatenate([unpacked(a) for a in of_strings["a"].to_pylist()]).astype(U)
        values = np.concatenate([np.frombuffer(b, float) for b in of_strings["b"].to_pylist()])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        score = np.zeros(len(sizes))
        for code, text in strings_of(data, sizes, depth):
            score += np.bincount(text, values[np.searchsorted(keys, code)], len(sizes))
        found = np.flatnonzero(data == 32) + 1  # a space in the canonical form is the end of a word
        word, names = words_in(data, found)
        names = names.to_pylist()
        totals, c = dict(zip(of_words["shard"].to_pylist(), of_words["b"].to_pylist())), np.zeros(len(names), np.int64)
        for k, at in in_shards(word_shards(names, shards)):
            c[at] = unpacked(totals[k])
        text = np.searchsorted(np.cumsum(sizes), found, side="left")
        add = lambda v: np.bincount(text, v[word], len(sizes))
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_bytes": sizes + 1,
            "n_tokens": (add(np.ones(len(c))) + 1).astype(np.int64), "n_known": (add((c > 0).astype(float)) + (ends > 0)).astype(np.int64),
            "base": add(np.log10(c + 0.1)) + math.log10(ends + 0.1), "score": score,
        })

    return texts.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(add_up, RESULT)


def context_tree_scores(docs: DataFrame, depth: int = 5, bundle_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, held_out, n_bytes (of the canonical text), n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    depth is 3 to 6: a string must fit into 56 bits.
    """
    if not SHARED <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    shards = max(1, math.ceil(size / bundle_bytes))
    blobs = stored(bundles(docs, depth, bundle_bytes, shards), "ctw-bundles", {"compression": "none"})
    of_strings = blobs.where(F.col("kind") == STRINGS)
    distinct = stored(distinct_strings(of_strings, depth, shards), "ctw-strings", {"compression": "none"})
    words = stored(word_answers(blobs.where(F.col("kind") == WORDS)), "ctw-words", {"compression": "none"})
    texts = blobs.where(F.col("kind") == TEXTS).select("bundle", "ids", "held", "sizes", "a")
    known = words.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    ends = texts.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")).first()["n"]
    n, v = known["n"] + ends, known["v"] + (ends > 0)
    values = string_values(distinct, top_levels(distinct, depth), depth, shards)
    out = stored(scored(texts, string_answers(of_strings, values).unionByName(words), ends, depth, shards), "ctw-scores")
    dropped(blobs, distinct, words)
    base = F.col("base") - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))
    return out.select("doc_id", "held_out", "n_bytes", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
