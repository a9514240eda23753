"""SimHash near-duplicates by vantage-point trees.

Fingerprints: 64 bits over word shingles, each hashed by XXH64 with seed 42; a bit is set if more than half of
the hashes have it. Equal fingerprints are one row before any comparison, so copies cost nothing further.

Search goes by shards and a vantage-point tree in each.

Shards. Of 64 bits in p pieces, two fingerprints within r agree in p - r pieces at least; each choice of so many is a key. As many
low bits of its pieces as make shards of about `shard` fingerprints are compared first; a table of up to 4 * shard fingerprints
is one shard. p is the least that gives enough bits: with shards of 2,048 and r = 4, 5 keys up to 8 million distinct
fingerprints, 15 up to 2 billion, 35 up to 270 billion, 70 beyond, so a shard doesn't grow with the table. (With
the full distance as the top level, evenly spread fingerprints lie within 4 of any median so often that each level halves
a shard but leaves 0.87 of it on the inner side, copies included: the work stays quadratic however many levels there are.)

Trees. Within a shard a vantage-point tree over the full distance is joined with itself: the ball of radius r around a
vantage point is linked at once, the rest is split at the median distance, and of the two sides only the boundary layers
that the triangle bound leaves are compared, sorted by distance so that each block meets only its stretch.

Large shards. A shard of more than 8 * shard fingerprints is not one task's work: it is partitioned by the distance from
a vantage point of its own, the fingerprint of its least node. Parts whose distances differ by more than r can hold no pair; only
the others meet, each pair of parts in a task of its own, and parts of one distance that are still too large are cut by a hash.

That is the query's form, and it is exact. A similarity of 0.8 means 10 of 64 bits on the average, up to 14; so few bits
neither tell such pairs from others nor leave bands of any use. keep_one takes WIDE words of 64 bits, each with hashes of its own,
in bands of 16 bits, and a sixth of all bits as its radius, where the expected similarity is 0.76; it misses pairs and links others
around that. keep_one_similar, the pipeline's form, decides by the shingle sets themselves (exact Jaccard):

1. A set is sorted by its hashes. Two sets of similarity t share a hash among the first n - ceil(t n) + 1 of each, for
   texts of any length; these hashes are the keys, and only those of two sets or more go on.
2. Under a key, a sketch of SKETCH words of 64 bits keeps apart what merely shares a passage, by the trees described above. Its radius
   is 90 of 256 bits; a similarity of 0.8 is 39 apart, 48 for the sets where it is most (4 and 5 shingles), so 6.7 standard
   deviations are left. The links give candidate groups.
3. The sets of each candidate group come together, and all pairs in it are counted by an inverted index. What has the
   similarity is linked; components of those links are the groups.

A shard returns its links as a spanning forest, never as all pairs (but for shards of up to LEAF fingerprints); components over
all shards then take the least label of their neighbours until nothing changes. Wide fingerprints and shingle sets are known
by a hash of 64 bits. A candidate group of more than `piece` shingles is cut into pieces that meet in pairs. Copies of one
text are one row in all of this; they come back by a join that deals the rows of a very frequent text over several tasks.

Nulls: a null or empty text has no words, and fingerprint zero. A null doc_id takes part in linking but is never
the id of a component, unless all of its ids are null (then null). Repeated rows get equal rows, an empty table gives an
empty one, texts of any length are taken whole. Extra columns, whatever their names, are not read; keep_one and keep_one_similar keep them.
"""

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import dropped, hot_join, read_table, stored, text_or_empty

BITS = 64
#: Words of a wide fingerprint, and bits of its bands.
WIDE, BAND = 12, 16
#: Words of the sketch of a shingle set, and the bits that two candidates may be apart.
SKETCH, SKETCH_RADIUS = 4, 90
#: Shards of up to so many fingerprints are compared whole, many shards at once.
LEAF = 8


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """bytes.lower() and bytes.split() are those of ASCII letters and white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(text: str, size: int = 4, words: int = 1) -> np.ndarray:
    """So many unsigned words of 64 bits. The first is over the hashes themselves, each other one over hashes derived from them."""
    return majority(shingle_hashes(text, size), words)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    counts = np.zeros(BITS * words, np.int64)
    shift = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):  # so many bits add up in one byte
        own = h[at : at + 255, None] + shift
        if words > 1:
            own = np.concatenate([own[:, :1], mixed(own[:, 1:])], axis=1)
        counts += np.unpackbits(own.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h)).view(">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, size: int = 4, words: int = 1) -> DataFrame:
    """doc_id, fp: the fingerprint as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fp = np.stack([fingerprint(t, size, words) for t in part.column("text").to_pylist()]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, fp.size + 1, words, dtype=np.int32)), pa.array(fp.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp array<long>")


class Forest:
    """Union by the least index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, others) -> None:
        a = self.root(i)
        for j in others:
            b = self.root(j)
            if a != b:
                if b < a:
                    a, b = b, a
                self.up[b] = a


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of each row of a from each row of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def link(points: np.ndarray, radius: int, forest: Forest, leaf: int = 96, tally: Counter | None = None) -> None:
    """points: a row of words each. Joins every two points within the radius, by a vantage-point tree joined with itself.
    tally: counts the splits, and the pairs that were compared and those that the bounds left out."""
    tally = Counter() if tally is None else tally
    points = points.reshape(len(points), -1)
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= leaf:
            if len(own) > 1:
                tally["compared"] += len(own) * (len(own) - 1) // 2
                near = apart(points[own], points[own]) <= radius
                for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
                    forest.union(int(own[i]), own[near[i]].tolist())
            continue
        d = apart(points[own[:1]], points[own])[0]
        tally["splits"] += 1
        ball = d <= radius
        forest.union(int(own[0]), own[ball].tolist())
        # The ball is one component now: each point beyond it needs one witness in it at most.
        rest, dr = own[~ball], d[~ball]
        inner, di = own[ball], d[ball]
        shell = dr <= 2 * radius
        tally["left out"] += int((~shell).sum()) * int((di > 0).sum())
        cross(points, rest[shell], dr[shell], inner[di > 0], di[di > 0], radius, forest, True, tally)
        if len(rest):
            middle = int(np.median(dr))
            low = dr <= middle
            if low.all():  # all at one distance: split by number, every pair of sides is compared
                low = np.arange(len(rest)) < len(rest) // 2
            a, b = rest[low], rest[~low]
            near_a, near_b = dr[low] + radius >= dr[~low].min(initial=np.iinfo(np.int16).max), dr[~low] <= dr[low].max(initial=0) + radius
            tally["left out"] += len(a) * len(b) - int(near_a.sum()) * int(near_b.sum())
            cross(points, a[near_a], dr[low][near_a], b[near_b], dr[~low][near_b], radius, forest, False, tally)
            stack += [a, b]


def cross(points: np.ndarray, a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, radius: int, forest: Forest, one: bool, tally: Counter) -> None:
    """Joins points of a with points of b. Both are met in order of their distance from a vantage point, so that a block of a
    meets only the stretch of b that the triangle bound leaves. one: b is a single component, so one link is enough."""
    if not len(a) or not len(b):
        return
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    a, da, b, db = a[oa], da[oa].astype(int), b[ob], db[ob].astype(int)
    step = max(1, min(len(a), 64, 2_000_000 // len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        lo, hi = np.searchsorted(db, da[at] - radius), np.searchsorted(db, da[min(at + step, len(a)) - 1] + radius, "right")
        tally["compared"] += len(rows) * max(0, hi - lo)
        tally["left out"] += len(rows) * (len(b) - max(0, hi - lo))
        if lo >= hi:
            continue
        near = apart(points[rows], points[b[lo:hi]]) <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            found = b[lo:hi][near[i]]
            forest.union(int(rows[i]), found[:1].tolist() if one else found.tolist())


def bands_of(words: int, radius: int, bits: int) -> list[list[tuple[int, int, int]]]:
    """For each key, the pieces (word, shift, width) that make it; no bits: one shard of all.

    Of p pieces p - radius agree at least, so each choice of so many is a key. p is the least that gives keys of `bits` bits: for a
    radius of 4, 5 keys of up to 12 bits, 15 of up to 20, 35 of up to 27, 70 of up to 32.
    """
    if words > 1:
        return [[(k, at, BAND)] for k in range(words) for at in range(0, BITS, BAND)]
    if bits <= 0:
        return [[(0, 0, 0)]]
    for p in range(radius + 1, BITS + 1):
        edges = [BITS * i // p for i in range(p + 1)]
        if (p - radius) * (BITS // p) >= bits or p == 2 * radius:
            break
    out = []
    for chosen in combinations(range(p), p - radius):
        left, key = bits, []
        for k, i in enumerate(chosen):
            width = min(edges[i + 1] - edges[i], -(-left // (len(chosen) - k)))
            key.append((0, edges[i], width))
            left -= width
        out.append(key)
    return out


def key_of(pieces: list[tuple[int, int, int]]) -> Column:
    """The bits of the pieces as one number."""
    value = F.lit(0).cast("long")
    for k, at, width in pieces:
        value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(F.col("fp")[k], at).bitwiseAND(F.lit((1 << width) - 1)))
    return value


def links_of(sizes: np.ndarray, node: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards of those sizes one behind the other: the nodes of each link."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat(sizes <= LEAF, sizes)
    u, v = [], []
    for step in range(1, min(LEAF, len(of))):
        i = np.flatnonzero(small[:-step] & (of[step:] == of[:-step]))
        i = i[np.bitwise_count(points[i] ^ points[i + step]).sum(axis=1) <= radius]
        u.append(node[i])
        v.append(node[i + step])
    for s in np.flatnonzero(sizes > LEAF).tolist():
        own, a = points[edges[s] : edges[s + 1]], edges[s]
        forest = Forest(len(own))
        link(own, radius, forest)
        root = np.array([forest.root(i) for i in range(len(own))])
        i = np.flatnonzero(root != np.arange(len(own)))
        u.append(node[a + i])
        v.append(node[a + root[i]])
    none = np.empty(0, np.int64)
    u, v = np.concatenate([none, *u]), np.concatenate([none, *v])
    return np.maximum(u, v), np.minimum(u, v)


def by_shard(keys: list[str], f: Callable[[np.ndarray, pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """Runs f(sizes, rows) over rows that come in order of their shard; the last shard of a batch may go on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
                changes = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
                if not held or (key[0] == last).all():
                    if not len(changes):
                        held.append(batch)
                        last = key[0]
                        continue
                    end = int(changes[-1])
                else:
                    end = int(changes[-1]) if len(changes) else 0
                now, held, last = [*held, batch.slice(0, end)], [batch.slice(end)], key[-1]
            else:
                now, held = held, []
            rows = pa.Table.from_batches(now).combine_chunks().to_batches() if now else []
            for part in rows:
                key = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
                starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
                yield f(np.diff(np.append(starts, len(key))), part)

    return run


def pairs_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def dealt(rows: DataFrame, g, by: list[str]) -> DataFrame:
    """One piece meets itself and each other piece; what is small enough has one piece. Rows come in order of `by`, i and j."""
    g = F.coalesce(g, F.lit(1))
    own = F.pmod(F.xxhash64("node"), g).cast("int")
    partners = F.transform(F.sequence(F.lit(0), g - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    keys = [*by, "i", "j"]
    return rows.withColumn("p", F.explode(partners)).select("*", "p.i", "p.j").drop("p", "g").repartition(*keys).sortWithinPartitions(*keys, "node")


def links_in_cells(placed: DataFrame, cell: list[str], words: int, radius: int, most: int) -> DataFrame:
    """placed: node, fp and the columns of a cell. Links within each cell; cells of more than `most` nodes go by parts of one distance."""
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", "node").alias("vantage"))
    large = stored(sizes.where(F.col("n") > most).drop("n"), "large")  # written, so that Spark knows how few there are
    far = F.lit(0)
    for k in range(words):
        far = far + F.bit_count(F.col("fp")[k].bitwiseXOR(F.col("vantage")[k]))
    rows = placed.join(large, cell, "left").withColumn("d", F.when(F.col("vantage").isNotNull(), far))
    parts = rows.where("d is not null").groupBy(*cell, "d").agg(F.count(F.lit(1)).alias("n")).groupBy(*cell).agg(F.collect_list(F.struct("d", F.ceil(F.col("n") / most).cast("int").alias("g"))).alias("parts"))
    rows = rows.join(stored(parts, "parts"), cell, "left")
    number = lambda d, s: d.cast("long") * (1 << 32) + s.cast("long")
    own = number(F.col("d"), F.pmod(F.xxhash64("node"), F.element_at(F.filter("parts", lambda x: x["d"] == F.col("d")), 1)["g"]))
    met = F.filter("parts", lambda x: F.abs(x["d"] - F.col("d")) <= radius)
    others = F.flatten(F.transform(met, lambda x: F.transform(F.sequence(F.lit(0), x["g"] - 1), lambda s: number(x["d"], s))))
    pairs = F.transform(others, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    keys = [*cell, "i", "j"]
    rows = rows.select(*cell, "node", "fp", F.explode(F.when(F.col("d").isNull(), alone).otherwise(pairs)).alias("p")).select(*cell, "node", "fp", "p.i", "p.j")
    by = by_shard(keys, lambda sizes, part: pairs_of(*links_of(sizes, part.column("node").to_numpy(), flat(part.column("fp")).reshape(-1, words), radius)))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(by, "u long, v long")


def spanning_links(fps: DataFrame, words: int, radius: int, shard: int, bits: int | None = None) -> DataFrame:
    """fps: node, fp. Gives u, v with u > v: enough links to connect whatever the radius connects in a shard. bits: of a key; by default just
    enough for shards of the size `shard`."""
    if bits is None:
        n = fps.count()
        bits = math.ceil(math.log2(n / shard)) if n > 4 * shard else 0
    cells = F.array(*[F.struct(F.lit(i).alias("band"), key_of(pieces).alias("value")) for i, pieces in enumerate(bands_of(words, radius, bits))])
    placed = fps.select("node", "fp", F.explode(cells).alias("cell")).select("node", "fp", "cell.*")
    return links_in_cells(placed, ["band", "value"], words, radius, 8 * shard)


def thinned(links: DataFrame) -> DataFrame:
    """The same groups by fewer links: each node keeps the one to its least neighbour, to which its other neighbours are linked
    instead. A node has one link for each shard that it is in at most, or LEAF, so a list of them is short."""
    near = links.groupBy("u").agg(F.collect_set("v").alias("vs")).select("u", "vs", F.array_min("vs").alias("m"))
    moved = F.transform(F.filter("vs", lambda v: v != F.col("m")), lambda v: F.struct(v.alias("u"), F.col("m").alias("v")))
    return near.select(F.explode(F.concat(F.array(F.struct("u", F.col("m").alias("v"))), moved)).alias("e")).select("e.u", "e.v").distinct()


def components(links: DataFrame, least: DataFrame) -> DataFrame:
    """links: u, v. least: node, label (to be made the least in each component). Gives node, label for the nodes that have links.

    Each round takes the least root of all neighbours and then the root of that root, so a chain shortens by a factor each time;
    a round's table is written to the shared folder and the one before it deleted. Ends when no root changed.
    """
    both = stored(links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select("v", "u")).distinct(), "links")
    # Work on node numbers (fingerprints); the wanted label is the least over the component at the end.
    now = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.lit(None).cast("long").alias("old"), F.least("a", "m").alias("root")), "round")
    while True:
        roots = now.select("node", "root")
        seen = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        nearer = roots.join(seen.select(F.col("a").alias("node"), "r"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jumped = (
            nearer.join(roots.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            .select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        )
        after = stored(jumped, "round")
        dropped(now)
        now = after
        if after.where("old <> root").isEmpty():
            break
    labels = now.join(least, "node").groupBy("root").agg(F.min("label").alias("label"))
    return now.join(labels, "root").select("node", "label")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, words: int = 1, shard: int = 2048) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    node = F.col("fp")[0] if words == 1 else F.xxhash64("fp")
    prints = stored(fingerprints(docs, size, words).select("doc_id", "fp", node.alias("node")), "fp")
    distinct = stored(prints.groupBy("node").agg(F.min("doc_id").alias("label"), F.any_value("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "fps")
    links = stored(thinned(spanning_links(distinct.select("node", "fp"), words, radius, shard)), "found")
    found = components(links, distinct.select("node", "label"))
    of = distinct.select("node", "label", "n").join(found.withColumnRenamed("label", "least"), "node", "left").select("node", "n", F.coalesce("least", "label").alias("component_id"))
    return hot_join(prints, stored(of, "of"), ["node"], "n", ["doc_id"]).select("doc_id", "fp", "component_id")


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def set_name(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def prefix(n: int, least: float) -> int:
    """Sets of the similarity share one of so many least hashes of each."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def lists(parts: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def sketches(docs: DataFrame, size: int, least: float) -> DataFrame:
    """doc_id, t (a hash of the text), node, n, fp and keys of the shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(x, size) for x in part.column("text").to_pylist()]
                columns = [pa.array([set_name(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64())]
                columns += [lists([majority(h, SKETCH) for h in sets]), lists([h[: prefix(len(h), least)] for h in sets])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), *columns], ["doc_id", "t", "node", "n", "fp", "keys"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, node long, n long, fp array<long>, keys array<long>")


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and node: each node of a key once, if the key has another one. Nothing is held but the last row."""
    last: tuple[int, int] | None = None  # the row before, and whether it is the only node of its key so far
    lonely = True
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if last is not None:
            key, node = np.append(last[0], key), np.append(last[1], node)
        same = key[1:] == key[:-1]
        # Rows that begin a node; the row that came over from the last batch was told already unless it was lonely.
        fresh = np.concatenate([[last is None or lonely], ~same | (node[1:] != node[:-1])])
        first = np.concatenate([[True], ~same])
        group = np.cumsum(first) - 1
        begins = np.concatenate([[True], ~same | (node[1:] != node[:-1])])
        nodes = np.bincount(group[begins], minlength=group[-1] + 1)
        told = fresh & (nodes[group] > 1)
        if last is not None and not lonely:  # the group went on: it has others
            told |= fresh & (group == 0)
        # The last group may go on in the next batch.
        open_group = group[-1]
        was_lonely = nodes[open_group] == 1 and (open_group > 0 or last is None or lonely)
        last, lonely = (key[-1], node[-1]), bool(was_lonely)
        yield pa.RecordBatch.from_arrays([pa.array(key[told]), pa.array(node[told])], ["key", "node"])


def similar(sizes: np.ndarray, node: np.ndarray, edges: np.ndarray, hashes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Groups of those sizes one behind the other; row i has hashes[edges[i]:edges[i + 1]]. A spanning forest of the pairs of that similarity."""
    u, v = [], []
    for end, m in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
        at = end - m
        n = np.diff(edges[at : end + 1])
        _, token = np.unique(hashes[edges[at] : edges[end]], return_inverse=True)
        order = np.argsort(token, kind="stable")
        posting, first = np.repeat(np.arange(m), n)[order], np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
        forest, trees, own = Forest(m), m, edges[at : end + 1] - edges[at]
        for i in range(m):
            if trees == 1:
                break
            mine = token[own[i] : own[i + 1]]
            if not len(mine):
                continue
            both = np.bincount(np.concatenate([posting[first[k] : first[k + 1]] for k in mine.tolist()]), minlength=m)
            for j in np.flatnonzero(both >= least * (n + n[i] - both) - 1e-9).tolist():
                if forest.root(i) != forest.root(j):
                    forest.union(i, [j])
                    trees -= 1
                    u.append(node[at + i])
                    v.append(node[at + j])
    u, v = np.array(u, np.int64), np.array(v, np.int64)
    return np.maximum(u, v), np.minimum(u, v)


def similar_links(docs: DataFrame, of: DataFrame, size: int, least: float, piece: int) -> DataFrame:
    """of: t, node, n, grp. Links of the similarity between the nodes of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = lists([shingle_set(x, size) for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("t", "node", "grp", "g")] + [sets], ["t", "node", "grp", "g", "hashes"])

    text = text_or_empty()
    groups = of.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / piece)).cast("int").alias("g"))
    wanted = stored(of.join(groups, "grp").select("t", "node", "grp", "g"), "wanted")
    source = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).join(wanted, "t")
    # Texts with equal hashes that are not equal have other names; copies are one row.
    sets = source.mapInArrow(run, "t long, node long, grp long, g int, hashes array<long>").dropDuplicates(["t", "node"])

    def found(sizes: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("hashes")
        edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return pairs_of(*similar(sizes, part.column("node").to_numpy(), edges, flat(column), least))

    return dealt(sets.drop("t"), F.col("g"), ["grp"]).mapInArrow(by_shard(["grp", "i", "j"], found), "u long, v long").distinct()


def similar_texts(docs: DataFrame, size: int, least: float = 0.8, shard: int = 2048, piece: int = 2_000_000) -> DataFrame:
    """doc_id, component_id for each row of docs: components of the pairs whose shingle sets have that similarity or more."""
    prints = stored(sketches(docs, size, least), "sketch")
    keyed = prints.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    shared = stored(keyed.mapInArrow(shared_only, "key long, node long"), "shared")
    distinct = stored(prints.groupBy("node").agg(F.min("doc_id").alias("label"), F.any_value("t").alias("t"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.count(F.lit(1)).alias("rows")), "sets")
    candidates = stored(thinned(links_in_cells(shared.join(distinct.select("node", "fp"), "node"), ["key"], SKETCH, SKETCH_RADIUS, 8 * shard)), "candidates")
    dropped(shared)
    groups = components(candidates, distinct.select("node", F.col("node").alias("label")))
    of = distinct.select("node", "t", "n").join(groups.select("node", F.col("label").alias("grp")), "node")
    links = stored(thinned(similar_links(docs, of, size, least, piece)), "found")
    found = components(links, distinct.select("node", "label"))
    ids = distinct.select("node", "label", "rows").join(found.withColumnRenamed("label", "least"), "node", "left").select("node", "rows", F.coalesce("least", "label").alias("component_id"))
    return hot_join(prints.select("doc_id", "node"), stored(ids, "of"), ["node"], "rows", ["doc_id"]).select("doc_id", "component_id")


def least_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one doc_id stay together, and so do rows with a null doc_id."""
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def keep_one(docs: DataFrame, size: int = 5, words: int = WIDE) -> DataFrame:
    """docs with the least doc_id of each group of near fingerprints."""
    return least_of_each(docs, near_duplicates(docs, size, BITS * words // 6, words))


def keep_one_similar(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """docs with the least doc_id of each group of similar texts."""
    return least_of_each(docs, similar_texts(docs, size, least))


def hex_of(fp: str = "fp"):
    """The first word as 16 lowercase digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)[0]), 16, "0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of().alias("fingerprint"), "component_id")
