import random

import xxhash

from seriesforge.llm import line_dedup as L
from seriesforge.llm import unit_dedup as U


def distance_at_most_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows, least):
    lines = sorted({(d, n, x) for d, t, *_ in rows if d is not None and t for n, x in enumerate(t.split("\n")) if len(x) >= least})
    out = set()
    for d, n, x in lines:
        near = [(e, m, x == y) for e, m, y in lines if distance_at_most_one(x, y)]
        e, m, same = min(near)
        if (e, m) != (d, n):
            out.add((d, n, e, m, 0 if same else 1))
    return out


def test_lines_match_brute_force(messy):
    rows = [tuple(r) for r in messy.collect()]
    for least in (3, 20):
        found = L.repeated_lines(messy, least)
        assert found.columns == ["doc_id", "line_no", "keep_doc_id", "keep_line_no", "edits"]
        assert {tuple(r) for r in found.collect()} == brute_lines(rows, least)


def test_near_lines_of_all_kinds(spark):
    base = "the quick brown fox jumps over the lazy dog"
    texts = [base, base[1:], base + "s", base[:10] + base[11:], base[:10] + "X" + base[11:], "X" + base, base[:5] + base[4:], base.replace("quick", "quack"), base[:-2], "aaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in L.repeated_lines(df).collect()} == brute_lines(rows, 20)


def test_short_lines_by_exact_repeats(spark):
    """Short lines go if they repeat, and only then; blank ones stay. The pipeline's stage takes them all."""
    import corpus_pipeline

    rows = [(1, "Yes.\nA line that has more than twenty letters\n\n", 0), (2, "Yes.\nYes!\n\n  \n好的", 0), (3, "  \n好的\nA line that has more than twenty letterz", 0), (4, "Yes.", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {tuple(r) for r in L.repeated_lines(df, exact_chars=1).collect()}
    assert found == {(2, 0, 1, 0, 0), (3, 1, 2, 4, 0), (3, 2, 1, 1, 1), (4, 0, 1, 0, 0)}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, df, "").collect()}
    assert left == {1: rows[0][1], 2: "Yes!\n\n  \n好的"}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines_within_two_edits(spark):
    rng, rows = random.Random(6), []
    bank = ["".join(rng.choices("abc ", k=rng.randint(9, 16))) for _ in range(12)]
    for i in range(90):
        x = list(rng.choice(bank))
        for _ in range(rng.randint(0, 3)):
            q = rng.randrange(len(x))
            x[q : q + 1] = rng.choice([[], [x[q], rng.choice("abc")], [rng.choice("abc ")]])
        rows.append((i, "".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for edits in (1, 2):
        want = set()
        for d, x in rows:
            near = [(e, 0, edit_distance(x, y)) for e, y in rows if len(x) >= 8 and len(y) >= 8 and edit_distance(x, y) <= edits]
            if near and min(near)[0] != d:
                want.add((d, 0, min(near)[0], 0, min(near)[2]))
        assert {tuple(r) for r in L.repeated_lines(df, 8, edits=edits).collect()} == want


def test_hot_lines_give_the_same(spark, monkeypatch):
    """A line, a part and a variant with a great share of all rows are dealt over several tasks."""
    from functools import partial

    from seriesforge.llm import common

    rows = [(i, f"the same line for all of them\nprice of the article no {i % 10}\nown line {i * 7919} of this one") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(L, "hot_join", partial(common.hot_join, pieces=7, least=3))
    assert {tuple(r) for r in L.repeated_lines(df).collect()} == brute_lines(rows, 20)


def test_own_columns_of_any_name(spark):
    rows = [(1, "a line that is long enough to count", 1, "x"), (2, "a line that is long enough to count\nand one more", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _GONE_ string")
    left = L.remove_lines(df, L.repeated_lines(df))
    assert left.columns == df.columns and sorted(map(tuple, left.collect())) == [rows[0], (2, "and one more", 2, "y")]


def test_query_matches_brute_force_and_sql(spark, fixture_dir):
    """All non-blank lines take part in exact repeats, those of 20 code points in near ones."""
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()]
    lines = sorted({(d, n, x) for d, t, *_ in rows if d is not None and t for n, x in enumerate(t.split("\n")) if len(x) >= 20 or x.strip(L.BLANK)})
    want = set()
    for d, n, x in lines:
        e, m, same = min((e, m, x == y) for e, m, y in lines if x == y or min(len(x), len(y)) >= 20 and distance_at_most_one(x, y))
        if (e, m) != (d, n):
            want.add((d, n, e, m, 0 if same else 1))
    found = L.op8_line_dedup(spark, fixture_dir)
    assert {tuple(r) for r in found.collect()} == want
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{fixture_dir}/documents.parquet/*.parquet'")
    assert {tuple(r) for r in c.execute(L.ORACLE_SQL).fetchall()} == want


def test_removed_lines(messy):
    gone = L.repeated_lines(messy)
    cut = {}
    for r in gone.collect():
        cut.setdefault(r.doc_id, set()).add(r.line_no)
    left = L.remove_lines(messy, gone)
    assert left.columns == messy.columns
    want = []
    for r in messy.collect():
        if r.doc_id in cut:
            text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in cut[r.doc_id])
            if not text.strip():
                continue
            r = (r[0], text, *r[2:])
        want.append(tuple(r))
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in left.collect()), key=key) == sorted(want, key=key)


def test_no_lines(empty):
    assert L.repeated_lines(empty).count() == 0
    assert L.remove_lines(empty, L.repeated_lines(empty)).count() == 0


def slow_units(text):
    """Lines, sentences of 8 words and stretches between local minima, word by word."""
    import zlib

    at = 0
    for line in text.split("\n"):
        spans, q = [], 0
        lone = lambda c: "\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff"
        while q < len(line):
            if line[q].isspace():
                q += 1
            else:
                e = q + 1
                while not lone(line[q]) and e < len(line) and not line[e].isspace() and not lone(line[e]):
                    e += 1
                spans.append((q, e))
                q = e
        if spans:
            word = lambda i: line[spans[i][0] : spans[i][1]].lower()
            unit = lambda i, j, kind: (at + spans[i][0], at + spans[j - 1][1], kind, " ".join(word(k) for k in range(i, j)))
            n = len(spans)
            yield at, at + len(line), "line", " ".join(word(k) for k in range(n))
            if n > 8:
                begin = 0
                for k in range(n):
                    if k == n - 1 or line[spans[k][1] - 1] in ".!?" and spans[k][1] < spans[k + 1][0] or line[spans[k][1] - 1] in "。！？":
                        if 8 <= k + 1 - begin < n:
                            yield unit(begin, k + 1, "sentence")
                        begin = k + 1
            c = [zlib.crc32(word(k).encode()) for k in range(n)]
            h = [((c[k] * 0x9E3779B1 + c[k + 1]) * 0xD6E8FEB86659FD93 % 2**64) >> 11 for k in range(n - 1)]
            edges = [0] + [k + 1 for k in range(6, len(h) - 6) if all(h[k] < h[m] for m in range(k - 6, k + 7) if m != k)] + [n]
            if len(edges) > 2:
                for i, j in zip(edges, edges[1:]):
                    yield unit(i, j, "stretch")
        at += len(line) + 1


def brute_units(rows):
    units = sorted({(d, *u) for d, t, *_ in rows if d is not None and t for u in slow_units(t)})
    first = {}
    for d, a, _, _, u in units:
        first.setdefault(u, (d, a))
    gone = [(d, a, b, kind, *first[u]) for d, a, b, kind, u in units if first[u] != (d, a)]
    order = ["line", "sentence", "stretch"]
    inside = lambda g, h: g != h and g[0] == h[0] and h[1] <= g[1] and g[2] <= h[2] and ((g[1], g[2]) != (h[1], h[2]) or order.index(h[3]) < order.index(g[3]))
    return {g for g in gone if not any(inside(g, h) for h in gone)}


def test_units_match_brute_force(messy):
    rows = [tuple(r) for r in messy.collect()]
    found = [tuple(r) for r in U.repeated_units(messy).collect()]
    assert set(found) == brute_units(rows) and len(found) == len(set(found)) and {f[3] for f in found} >= {"line"}


def test_query_of_units_matches_brute_force(spark, fixture_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()]
    assert {tuple(r) for r in U.op3_unit_dedup(spark, fixture_dir).collect()} == brute_units(rows)


def test_units_of_many_texts_at_once():
    """Texts read as one row of characters have the units that each has alone: letters that change their length or form, blanks of all kinds."""
    rng = random.Random(21)
    letters = "abAB Σσ İı漢字かกั。！？.!? \n\t\x1c\x85\u3000éÉßK🙂Ⱥ,"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(300)] + ["\n", " ", "a", "İ", "Σ", "no end\n\n", " one  line "]
    texts += [" ".join("".join(rng.choices("aΣİ漢.", k=3)) for _ in range(60)) for _ in range(60)]
    texts = [t.replace("。", "。 ").replace("！", "！ ").replace("？", "？ ") for t in texts]  # slow_units looks for them at a word's end only
    found = list(zip(*[c.tolist() for c in U.units_of(texts, 8, 6)]))
    signed = lambda x: x - (1 << 63)
    wanted = {(k, a, b, U.KINDS.index(kind), signed(d >> 64), signed(d & (1 << 64) - 1)) for k, t in enumerate(texts) for a, b, kind, u in slow_units(t) for d in [xxhash.xxh3_128_intdigest(u)]}
    assert set(found) == wanted and len(found) == len(wanted) and {f[3] for f in found} == {0, 1, 2}
    assert all(len(c) == 0 for c in U.units_of(["", "\n \n"], 8, 6))


def test_passages_set_into_other_text(spark):
    """A passage of 60 words without sentence or line ends, set into other words, has whole stretches in common."""
    rng, rows = random.Random(12), []
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    for k in range(40):
        passage = words(60)
        rows += [(2 * k, f"{words(30)} {passage} {words(25)}"), (2 * k + 1, f"{words(11)} {passage} {words(40)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = U.repeated_units(df).collect()
    cut = {}
    for r in gone:
        text = rows[r.doc_id][1][r.start : r.stop]
        assert text in rows[r.keep_doc_id][1]
        cut[r.doc_id] = cut.get(r.doc_id, 0) + len(text.split())
    assert set(cut) == {2 * k + 1 for k in range(40)} and sum(cut.values()) > 40 * 60 * 0.5


def test_units_inside_lines_are_found(spark):
    passage = "One two three four five six seven eight nine ten. " * 2
    own = "Nothing of it at all."
    df = spark.createDataFrame([(1, "Before it. " + passage + "after.", 1), (2, "Other words. " + passage + "more of them.", 2), (3, own, 3), (4, None, 4)], "doc_id long, text string, _spans int")
    gone = U.repeated_units(df)
    assert {r.doc_id for r in gone.collect()} == {1, 2}  # the second time in document 1, both times in document 2
    left = {r.doc_id: r for r in U.remove_units(df, gone).collect()}
    assert "One two" not in left[2].text and left[2]._spans == 2 and left[4].text is None and left[4].kept is None
    assert left[3].text == own and [tuple(k) for k in left[3].kept] == [(0, 21)]
    for r in left.values():
        text = dict((x.doc_id, x.text) for x in df.collect())[r.doc_id]
        assert text is None or r.text == "".join(text[k.start : k.stop] for k in r.kept)


def test_units_of_nothing(empty):
    assert U.repeated_units(empty).count() == 0
    assert U.remove_units(empty, U.repeated_units(empty)).count() == 0
