import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.llm import simhash as H
from seriesforge.llm import suffix_dedup as S


@given(st.lists(st.integers(1, 4), max_size=80))
@settings(max_examples=200, deadline=None)
def test_suffix_array(x):
    x = [*x, 0]
    assert S.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 101, 300).astype(np.uint8)
    a, b = np.concatenate([rng.integers(97, 101, 57).astype(np.uint8), shared]), np.concatenate([rng.integers(97, 101, 211).astype(np.uint8), shared])

    def of(x):
        h, place, first, n = S.anchors(x, np.array([len(x)]), 100, 32)
        return {int(p): (int(k), int(q) - int(p)) for k, q, f, c in zip(h, place, first, n) for p in range(f, f + c)}

    wa, wb = of(a), of(b)
    assert sorted(wa) == list(range(len(a) - 99)) and sorted(wb) == list(range(len(b) - 99))
    assert all(wa[57 + i] == wb[211 + i] for i in range(201))


def test_equal_contexts_go_unsorted():
    """Contexts of one gram: what goes whole and what the sorted rest gives are all repeated windows; two contexts are never sorted."""
    rng, gram, sorted_ones = random.Random(8), "GRAM-" * 6 + "##", 0
    side = lambda n: "".join(rng.choices("ab", k=n))
    for size in (2, 2, 2, 3, 4, 6, 9, 30):
        lefts, rights = [side(90) for _ in range(2)], [side(90) for _ in range(3)]
        held = []
        for k in range(size):
            left, right = rng.choice(lefts)[rng.randint(0, 40) :], rng.choice(rights)[: rng.randint(40, 90)]
            left, right = side(rng.randint(0, 9)) + left, right + side(rng.randint(0, 9))
            held.append((rng.randint(0, 3), k, rng.randint(0, 50), len(left), (left + gram + right).encode()))
        gone, rest = S.told_apart(held, 100)
        found = {(d, v, q) for d, v, p, e in gone for q in range(p, e - 99)} | set(S.repeated_windows([(r[4], r[:3]) for r in rest], 100) if rest else ())
        assert found == set(S.repeated_windows([(r[4], r[:3]) for r in held], 100))
        assert size > 2 or not rest
        sorted_ones += len(rest)
    assert sorted_ones


def test_stretches_that_touch_are_one():
    spans = pa.array([None, [(5, 9), (0, 3), (3, 5)], [], [(7, 8), (1, 2), (1, 6)]], pa.list_(pa.struct([("p", pa.int32()), ("e", pa.int32())])))
    assert S.merged(spans) == ([0, 0, 1, 1, 3], [0, 1, 7], [9, 6, 8]) and S.merged(spans[1:3]) == ([0, 1, 1], [0], [9]) and S.merged(spans[:1]) == ([0, 0], [], [])


def brute_bytes(rows, width=100):
    docs = sorted({((r[0] is None, r[0] or 0), (r[1] or "").encode()) for r in rows}, key=lambda x: (x[0], S_crc(x[1])))
    seen, out = set(), {}
    for d, raw in docs:
        mark = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                mark[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        runs = sum(1 for i in range(len(mark)) if mark[i] and (not i or not mark[i - 1]))
        out[(None if d[0] else d[1], raw)] = (len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return sorted(repr((r[0], *out[(r[0], (r[1] or "").encode())])) for r in rows)


def S_crc(raw):
    import zlib

    return zlib.crc32(raw)


def test_bytes_match_brute_force(messy):
    rows = [tuple(r) for r in messy.collect()]
    for most in (4096, 1):  # 1: every gram with two contexts goes by digests
        found = S.remove_repeats(messy, most=most).drop("kept")
        assert sorted(repr(tuple(r)) for r in found.collect()) == brute_bytes(rows)


def test_query_of_bytes_by_brute_force(spark, fixture_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in S.op7_suffix_dedup(spark, fixture_dir).collect()) == brute_bytes(rows)


def test_hot_contexts_give_the_same(spark, monkeypatch):
    from functools import partial

    from seriesforge.llm import common

    rng = random.Random(9)
    passage = "".join(rng.choices("abcdef ", k=260))
    rows = [(i, f"{'x' * (i % 7)}{passage[: 120 + i]}{i * 7919} and {passage}") for i in range(60)]
    monkeypatch.setattr(S, "hot_join", partial(common.hot_join, pieces=7, least=3))
    for most in (4096, 5):
        found = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), most=most).drop("kept")
        assert sorted(repr(tuple(r)) for r in found.collect()) == brute_bytes(rows)


def test_bytes_of_random_texts(spark):
    rng = random.Random(3)
    bank = ["".join(rng.choices("abc", k=rng.randint(80, 180))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(bank)[rng.randint(0, 20) :] + rng.choice(["", "-", "+"]) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in S.remove_repeats(df).drop("kept").collect()) == brute_bytes(rows)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=900))
    texts = [b"x" * 50 + passage.encode() + b"y" * 50, passage[100:].encode()]
    got = set()
    for data, ends, of in S.pieces(texts, 100):
        h, a, p, n = S.anchors(data, ends, 100, 32)
        for i in range(len(h)):
            k = int(np.searchsorted(ends, p[i], "right"))
            start = int(ends[k - 1]) if k else 0
            got |= {(of[k][0], int(p[i]) - start + of[k][1] + j) for j in range(int(n[i]))}
    assert got == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 99)}


def test_bytes_of_nothing(empty):
    assert S.remove_repeats(empty).count() == 0


def brute_fingerprint(text, size):
    import xxhash

    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius, size=4):
    fps = [brute_fingerprint(r[1] or "", size) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = root(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(rows)]


def test_components_match_brute_force(messy):
    rows = [tuple(r) for r in messy.collect()]
    for radius, shard in ((4, 20_000), (12, 4)):
        found = H.near_duplicates(messy, radius=radius, shard=shard).select("doc_id", H.hex_of().alias("f"), "component_id")
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, brute_components(rows, radius)))


def test_tree_links_what_pairs_link():
    rng = np.random.default_rng(2)
    for case in range(20):
        centres = rng.integers(0, 1 << 63, 6).astype(np.uint64)
        points = np.unique(np.concatenate([rng.integers(0, 1 << 63, 150).astype(np.uint64)] + [c ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)) for c in centres]))
        forest = H.Forest(len(points))
        H.link(points, 4, forest, leaf=8 + case)
        want = H.Forest(len(points))
        for i in range(len(points)):
            want.union(i, np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4).tolist())
        assert [forest.root(i) for i in range(len(points))] == [want.root(i) for i in range(len(points))]


def test_tree_splits_and_leaves_pairs_out():
    from collections import Counter

    rng, tally = np.random.default_rng(4), Counter()
    points = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    H.link(points, 4, H.Forest(len(points)), tally=tally)
    assert tally["splits"] > 20 and tally["left out"] > 0.3 * len(points) ** 2 / 2
    assert tally["compared"] + tally["left out"] < 1.05 * len(points) ** 2 / 2


def test_shards_by_bits_and_by_distance_link_what_one_tree_links(spark):
    """The same links from one shard, from shards of few bits of each band, and from parts by distance of large shards."""
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    near = [c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centres]
    points = np.unique(np.concatenate([rng.integers(0, 1 << 63, 1500).astype(np.uint64), *near]))
    forest = H.Forest(len(points))
    for i in range(len(points)):
        forest.union(i, np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4).tolist())
    node = points.view(np.int64)
    want = {}
    for i in range(len(points)):
        want.setdefault(forest.root(i), set()).add(int(node[i]))
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    df = spark.createDataFrame([(int(x), [int(x)]) for x in node], "node long, fp array<long>").repartition(5)
    for shard, bits in ((1000, None), (100, None), (8, None), (2, None), (1000, 13), (1000, 20), (1000, 26), (1000, 32)):
        links = H.thinned(H.spanning_links(df, 1, 4, shard, bits))
        got = {}
        for r in H.components(links, df.select("node", df.node.alias("label"))).collect():
            got.setdefault(r.label, set()).add(r.node)
        assert {frozenset(x) for x in got.values()} == want


@pytest.mark.parametrize("bits,keys", [(1, 5), (12, 5), (13, 15), (20, 15), (21, 35), (27, 35), (28, 70), (32, 70)])
def test_two_fingerprints_within_the_radius_share_a_key_of_any_length(bits, keys):
    rng = np.random.default_rng(bits)
    found = H.bands_of(1, 4, bits)
    assert len(found) == keys and all(sum(w for _, _, w in k) == bits for k in found)
    value = lambda x, key: tuple(int(x) >> at & ((1 << w) - 1) for _, at, w in key)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for i in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= 1 << int(i)
        assert any(value(a, k) == value(b, k) for k in found)


def test_nodes_of_keys_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = sorted((int(k), int(n)) for k, n in zip(rng.integers(0, 40, 300), rng.integers(0, 4, 300))) + [(50, 1), (50, 1), (51, 1), (52, 1), (52, 2)]
    nodes = {}
    for k, n in rows:
        nodes.setdefault(k, set()).add(n)
    want = sorted((k, n) for k, own in nodes.items() if len(own) > 1 for n in own)
    for step in (1, 2, 3, 7, 1000):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.int64()), pa.array([n for _, n in p], pa.int64())], ["key", "node"]) for p in parts]
        got = [(k, n) for b in H.shared_only(iter(batches)) for k, n in zip(b.column("key").to_pylist(), b.column("node").to_pylist())]
        assert sorted(got) == want


def test_query_matches_brute_force(spark, fixture_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in H.op4_simhash(spark, fixture_dir).collect()) == sorted(map(repr, brute_components(rows, 4)))


def wide_components(rows, size=5):
    """By all pairs of the wide fingerprints."""
    fps = [H.fingerprint(r[1] or "", size, H.WIDE) for r in rows]
    forest = H.Forest(len(rows))
    for i in range(len(rows)):
        near = [j for j in range(len(rows)) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 64 * H.WIDE // 6]
        forest.union(i, near)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = forest.root(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], least.get(forest.root(i))) for i, r in enumerate(rows)]


def test_one_of_each_group(messy):
    rows = [tuple(r) for r in messy.collect()]
    gone = {d for d, c in wide_components(rows) if d is not None and d != c}
    left = H.keep_one(messy)
    assert left.columns == messy.columns
    assert sorted(repr(tuple(r)) for r in left.collect()) == sorted(repr(r) for r in rows if r[0] not in gone)


def test_first_word_of_a_wide_fingerprint():
    for text in ("", "a b", "one two three four five six seven"):
        assert H.fingerprint(text, 5, H.WIDE)[0] == H.fingerprint(text, 5)[0]


def test_similarity_of_four_fifths(spark):
    """Texts of similarity 0.86 are found but for a few in a thousand (one of these 40 shares no band), none of similarity 0.5 is."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        # Each changed word changes five shingles of 396.
        for j, changes in enumerate((0, 6, 25)):
            own = list(words)
            for at in rng.permutation(79)[:changes]:
                own[5 * at + 2] = f"x{rng.integers(0, 10**6)}"
            rows.append((10 * k + j, " ".join(own)))
    kept = sorted(r["doc_id"] for r in H.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {d for d in kept if d % 10 != 1} == {10 * k + j for k in range(40) for j in (0, 2)}
    assert sum(d % 10 == 1 for d in kept) <= 1


def test_fingerprints_of_nothing(empty):
    assert H.near_duplicates(empty).count() == 0


def test_kept_by_exact_similarity(spark):
    """Of changed texts of 5 to 404 words, those of similarity 0.8 or more go, and those below it (0.78 at the most) stay."""
    rows, gone, k = [], set(), 0
    for n, below, at_least in ((5, [(1, 1)], [(0, 1), (1, 0)]), (10, [(0, 3)], [(0, 2), (1, 0)]), (30, [(0, 7)], [(0, 6), (3, 3)]), (400, [(100, 11), (113, 0)], [(100, 0), (50, 30)])):
        for good, changes in ((False, below), (True, at_least)):
            for added, cut in changes:
                for _ in range(5):
                    k += 2
                    words = [f"w{k}x{i}" for i in range(n + 4)]
                    rows += [(k, " ".join(words)), (k + 1, " ".join(words[cut:] + [f"y{k}x{i}" for i in range(added)]))]
                    sets = [{tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for r in rows[-2:]]
                    similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
                    assert (similarity >= 0.8) is good and (good or n < 30 or similarity > 0.76)
                    gone |= {k + 1} if good else set()
    kept = {r["doc_id"] for r in H.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r[0] for r in rows} - kept == gone


def test_pieces_give_the_same_groups(spark):
    """A group in many pieces, and keys over the shard, link what whole ones link."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        own = list(base)
        for at in rng.permutation(200)[: k // 4]:
            own[at] = f"x{k}"
        rows.append((k, " ".join(own)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    forest = H.Forest(len(rows))
    for i in range(len(rows)):
        forest.union(i, [j for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    want = sorted((i, forest.root(i)) for i in range(len(rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shard, piece in ((20_000, 2_000_000), (4, 1000)):
        assert sorted(tuple(r) for r in H.similar_texts(df, 5, 0.8, shard, piece).collect()) == want


def test_similar_texts_with_nulls(messy, empty):
    rows = [tuple(r) for r in messy.collect()]
    sets = [set(H.shingle_hashes(r[1] or "", 5).tolist()) for r in rows]
    forest = H.Forest(len(rows))
    for i, a in enumerate(sets):
        forest.union(i, [j for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b) > 0])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[forest.root(i)] = min(least.get(forest.root(i), r[0]), r[0])
    want = [(r[0], least.get(forest.root(i))) for i, r in enumerate(rows)]
    assert sorted(map(repr, (tuple(r) for r in H.similar_texts(messy, 5).collect()))) == sorted(map(repr, want))
    assert H.keep_one_similar(empty).count() == 0
