"""The filter audit, the collocations and the context trees against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from seriesforge.llm import context_tree as C
from seriesforge.llm import filter_audit as A
from seriesforge.llm import phrases as P


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---- op12


def brute_audit(rows, labels):
    """rows of (doc_id, text, lang), labels of (doc_id, quality, toxic)."""
    mark = {c: {i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k, c in enumerate(("good", "toxic"))}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > first[t])) if x}
        docs[lang or ""].append((fails, i in mark["good"], i in mark["toxic"]))
    out = {}
    for part, members in docs.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [d for d in members if c in d[0] and not d[0] & before]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [sum(not d[0] & (before | {c}) for d in members), len(gone), sum(c in d[0] and bool(d[0] & before) for d in members), sum(d[0] == {c} for d in members), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_walking_every_order(spark, messy, fixture_dir):
    found = {tuple(r)[:3]: list(r)[3:] for r in plain(A.op12_filter_audit(spark, fixture_dir), "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    assert found == brute_audit(plain(messy, "doc_id", "text", "lang"), plain(spark.read.parquet(f"{fixture_dir}/labels.parquet"), "doc_id", "quality", "toxic"))


def test_copies_in_other_parts_and_hot_copies(spark, tmp_path):
    rows = [(i, "same text" if i % 3 else f"text {i}", ["en", "de", None][i % 3]) for i in range(3000)] + [(None, "same text", "en"), (1, "same text", "en"), (5, None, "fr"), (6, "", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {tuple(r)[:3]: list(r)[3:] for r in plain(A.op12_filter_audit(spark, str(tmp_path)), "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    assert found == brute_audit(rows, labels)


def test_audit_of_no_documents(spark, empty):
    counts = A.signatures(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.col("lang"))
    assert A.paths(A.lattice_edges(counts, 5), A.FILTERS).count() == 0


# ---- op13


def brute_phrases(rows, least, share, most):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = (b for (la, v), b in cand.items() if la == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
        if not any(100 * b >= share * a for b in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1): (r[2].decode(), r[3], r[4], r[5], n[lang], -r[0]) for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:most])}


def as_ranked(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("least,most_bits,portion,most", [(3, 28, 16_000_000, 2000), (5, 16, 3000, 40), (2, 16, 500, 7)])
def test_collocations_equal_brute_force(messy, least, most_bits, portion, most):
    found = as_ranked(P.collocations(messy, least, 80, most, most_bits, portion))
    assert found and found == brute_phrases(plain(messy, "text", "lang"), least, 80, most)


def test_collocation_query_on_the_fixture(spark, messy, fixture_dir):
    assert as_ranked(P.op13_collocations(spark, fixture_dir)) == brute_phrases(plain(messy, "text", "lang"), 30, 80, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    a = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", a), ("en", "y", a)], "lang string, phrase string, f long")
    row = P.scored(counts).first()
    assert (row["l"], row["r"], row["score"]) == (a, a, 2_000_000 * a // (2 * a))


def test_folded_sketch_keeps_every_frequent_cell(spark):
    """The sketch may let more through, never less, also when its bits are folded."""
    docs = spark.createDataFrame([(" ".join(f"w{i * j % 97}" for j in range(200)), None) for i in range(40)], "text string, lang string")
    few = P.frequent(P.rows_of(docs), 30, 16, 1000)
    w = Counter(x for r in docs.collect() for x in zip(*[r["text"].split()[k:] for k in range(2)]))
    assert {(" ".join(k), v) for k, v in w.items() if v >= 30} == {(r["phrase"], r["f"]) for r in few.where("phrase like '% %' and phrase not like '% % %'").collect()}


def test_portions_cut_between_pieces():
    parts = list(P.pieces(b"one two. three four. five six", 9))
    assert b"".join(parts) == b"one two. three four. five six" and len(parts) > 1 and all(p[:1] in b".o" for p in parts)


def test_collocations_of_no_documents(empty):
    assert P.collocations(empty).count() == 0


# ---- op11


def brute_canonical(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(w + " " for w in re.findall(r"[^\x20\x09-\x0D]+", low)).encode() + b"\n"


def brute_tree(texts, depth):
    """Counts of zeros and ones and weighted logarithms of all nodes by the definition, and the next-bit probability of a path."""
    n, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in texts:
        padded = bytes(depth) + t
        for i in range(depth, len(padded)):
            for bit in range(8):
                path = (1 << bit) | padded[i] >> (8 - bit)
                for d in range(depth + 1):
                    n[padded[i - d : i], path][padded[i] >> (7 - bit) & 1] += 1
                    if d:
                        children[padded[i - d + 1 : i], path].add((padded[i - d : i], path))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted, weight = {}, {}
    for node in sorted(n, key=lambda k: -len(k[0])):
        own = kt(*n[node])
        if len(node[0]) == depth:
            weighted[node], weight[node] = own, 1.0
        else:
            below = sum(weighted[c] for c in children[node])
            top = max(own, below)
            weighted[node] = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
            weight[node] = 0.5 * math.exp(own - weighted[node])

    def one(context, path):
        p = 0.5
        for d in range(depth, -1, -1):
            node = (context[depth - d :], path)
            if node not in n:
                p = 0.5
            else:
                a, b = n[node]
                p = weight[node] * (b + 0.5) / (a + b + 1) + (1 - weight[node]) * p
        return p

    return one


def brute_score(text, depth, one):
    padded, total = bytes(depth) + text, 0.0
    for i in range(depth, len(padded)):
        for bit in range(8):
            p = one(padded[i - depth : i], (1 << bit) | padded[i] >> (8 - bit))
            total += math.log10(p if padded[i] >> (7 - bit) & 1 else 1 - p)
    return total


@pytest.mark.parametrize("depth,bundle", [(3, 1), (5, 30_000)])
def test_context_tree_equals_the_definition(messy, depth, bundle):
    docs = [r for r in plain(messy, "doc_id", "text") if len(r[1] or "") < 3000]
    small = messy.where("length(coalesce(text, '')) < 3000")
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    one = brute_tree([brute_canonical(t) for i, t in docs if not held(i)], depth)
    words = Counter(w for i, t in docs if not held(i) for w in brute_canonical(t).split(b" "))
    n, v = sum(words.values()), len(words)
    wanted = []
    for i, t in docs:
        tokens = brute_canonical(t).split(b" ")
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        wanted.append((i, held(i), len(tokens), sum(words[w] > 0 for w in tokens), n, base, brute_score(brute_canonical(t), depth, one)))
    found = plain(C.context_tree_scores(small, depth, bundle), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert len(found) == len(wanted)
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_query_scores_every_row(spark, messy, fixture_dir):
    found = plain(C.op11_context_tree(spark, fixture_dir), "doc_id", "held_out", "score", "n_tokens")
    assert sorted(repr(r[0]) for r in found) == sorted(repr(r[0]) for r in plain(messy, "doc_id"))
    assert all(s < 0 for _, _, s, _ in found)


def test_probabilities_of_all_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 103, 4000).astype(np.uint8)
    strings, n = C.string_counts(data, np.array([2000, 2000]), np.array([True, True]), 4)
    deep = C.levels(strings, n, 4, 0)
    for context in (strings[5] >> np.uint64(8), strings[-1] >> np.uint64(8), np.uint64(0x6161617A)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** C.log10_probabilities(every, deep, deep, 4)).sum() == pytest.approx(1, abs=1e-9)


def test_own_estimate_is_the_product_of_its_steps():
    for bits in ("0", "1", "0010111", "1" * 40):
        p, a, b = 1.0, 0, 0
        for c in bits:
            p *= ((b if c == "1" else a) + 0.5) / (a + b + 1)
            a, b = a + (c == "0"), b + (c == "1")
        assert C.own_log(np.array([a]), np.array([b]))[0] == pytest.approx(math.log(p), rel=1e-12)


def test_long_texts_come_in_pieces():
    data = np.frombuffer(b"abc abd abe " * 50, np.uint8)
    whole = np.concatenate([c for c, _ in C.strings_of(data, np.array([300, 300]), 5)])
    pieces = np.concatenate([c for c, _ in C.strings_of(data, np.array([300, 300]), 5, 37)])
    assert (whole == pieces).all() and len(whole) == 602


def test_trees_without_training_texts_and_without_texts(spark, empty):
    assert C.context_tree_scores(empty).count() == 0
    one = C.context_tree_scores(spark.createDataFrame([(None, "Ab c")], SCHEMA.split(", lang")[0])).first()
    assert one["score"] == pytest.approx(-8 * 6 * math.log10(2)) and (one["train_tokens"], one["base_score"], one["n_known"]) == (0, 0.0, 0)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name,query,sql", [("audit", A.op12_filter_audit, A.ORACLE_SQL), ("phrases", P.op13_collocations, P.ORACLE_SQL)])
def test_sql(spark, name, query, sql):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = query(spark, "/root/testdata/sf0.001")
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())
