import random

from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.llm import decontaminate as D
from seriesforge.llm import html_text as X
from seriesforge.llm import toxicity as T


def edit_distance(a, b, free):
    """free: begin and end of b cost nothing."""
    row = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row) if free else row[-1]


@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=120))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    peq = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    assert D.myers(pattern, peq, text)[0] == edit_distance(pattern, text, True)


@given(st.text("abcd", min_size=4, max_size=9))
@settings(max_examples=300, deadline=None)
def test_automaton_and_trie(word):
    terms = {"abcab": 1.0, "bbbbb": 2.0, "abcdabc": 3.0, "dcba": 9.0}
    own = T.Lexicon(terms, {})
    want = max((w for t, w in terms.items() if len(t) >= 5 and edit_distance(word, t, False) <= 1), default=0.0)
    assert own.misspelled(word) == (want if len(word) != 4 or edit_distance(word, "dcba", False) > 1 else max(want, 9.0))


def test_context_windows():
    own = T.Lexicon({"idiot": 7.0}, {"nast": 5.0})
    assert own.features("you idiot")[0] > 0 and own.features("you idiot")[2] == 0
    assert own.features('she said "you idiot" twice')[2] > 0 and own.features('she said "you idiot" twice')[0] == 0
    assert own.features("you idi0t")[1] > 0 and own.features("he wrote idi0t")[3] > 0
    assert own.features("nastier") == own.features("nastiest") and own.features("nast")[0] == 0
    assert own.features("") == own.features("fine words") == (0.0, 0.0, 0.0, 0.0)


def test_quotation_marks_over_lines_and_windows():
    own = T.Lexicon({"idiot": 7.0, "scum": 6.0}, {})
    long = "word " * 200
    quoted = lambda t: (lambda f: f[2] > 0 or f[3] > 0)(own.features(t))
    assert quoted(f'x "{long} idiot {long}\n{long}" y') and not quoted(f'x "{long}\n \n idiot" y') and not quoted('one mark" idiot')
    assert quoted("idiot, as the paper calls it") and not quoted("idiot a b c d e f g h says")
    assert own.features("scvm")[1] > 0 and own.features("scums") == own.features("cum") == (0, 0, 0, 0)


def test_learned_windows_tell_quotation_from_abuse(spark):
    """Clean documents that discuss a term with words that no list holds; held-out ones are told apart, without windows they are not."""
    rng, rows, labels = random.Random(2), [], []
    words = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(300)]
    for i in range(900):
        text = rng.choices(words, k=40)
        at = 5 * rng.randrange(1, 6)
        if i % 3 == 0:
            text[at] = rng.choice(["blockhead", "nitwit", "blokhead"])
        elif i % 6 == 1:
            text[at - 2 : at + 1] = [rng.choice(["glossary", "etymology"]), rng.choice(words), rng.choice(["blockhead", "nitwit"])]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, weights = T.learn(docs, labels, least_weight=0.5)
    assert {"glossary", "etymology"} <= lexicon.cues and len(lexicon.cues - T.SAYING) < 6
    blind = T.Lexicon(lexicon.words, lexicon.prefixes, lexicon.clean, frozenset(), lexicon.spelled)
    wrong = []
    for own in (lexicon, blind):
        got = T.score_documents(docs, own, weights, ["doc_id"]).withColumn("held", T.held_out()).where("held").collect()
        wrong.append(sum(r.predicted != int(r.doc_id % 3 == 0) for r in got) / len(got))
    assert wrong[0] < 0.03 and wrong[1] > 0.1


def test_scores_of_the_query(spark, fixture_dir):
    """Each document's score again, by itself, from what was learned; equal texts have equal scores, labels of held-out rows teach nothing."""
    import math
    import zlib

    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    lexicon, weights = T.learn(docs, spark.read.parquet(f"{fixture_dir}/labels.parquet"))
    want = []
    for r in docs.collect():
        z = weights[0] + sum(w * x for w, x in zip(weights[1:], lexicon.features(r.text or "")))
        held = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        want.append((r.doc_id, held, round(1 / (1 + math.exp(-z)), 9), int(z >= 0)))
    got = [(r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in T.op6_toxicity(spark, fixture_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def labelled_set(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = rng.choices(words, k=30)
        if toxic:
            text[rng.randrange(30)] = rng.choice(["blockhead", "nitwit"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled_set(spark)
    lexicon, weights = T.learn(docs, labels)
    got = {r.doc_id: r for r in T.score_documents(docs, lexicon, weights, ["doc_id"]).withColumn("held", T.held_out()).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d, r in got.items() if r.held]
    assert len(held) > 80 and all(got[d].predicted == truth[d] for d in held)
    extra = spark.createDataFrame([(1, "what a blokhead"), (2, 'they said "a blockhead" of him'), (3, "good words only"), (4, None), (5, "")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in T.score_documents(extra, lexicon, weights, ["doc_id"]).collect()}
    assert s[1] > 0.5 > s[3] == s[4] == s[5] and s[2] < s[1]


def test_labels_that_teach_nothing(messy, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (999, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        lexicon, weights = T.learn(messy, labels)
        found = T.score_documents(messy, lexicon, weights, messy.columns)
        assert found.count() == messy.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in found.collect())
    assert T.score_documents(empty, *T.learn(empty, none), empty.columns).count() == 0


def test_hits_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(25)) + ".") for i in range(8)] + [(90, None), (91, "tiny"), (92, "Tiny, one"), (93, "好的"), (94, " !? "), (None, "no id " * 20)]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(40))
        if i % 2:
            x = list(items[i % 8][1])
            for _ in range(rng.randint(0, 14)):
                x[rng.randrange(len(x))] = rng.choice("abcdefghijklm")
            text = f"{text} {''.join(x).upper() if i % 3 else ''.join(x)}\n{text[:50]}"
        docs.append((i, text))
    docs += [(60, None), (61, ""), (None, items[0][1]), (62, "A TINY-ONE here"), (63, "tinyone"), (64, "那好的吧"), (65, "untiny tiny2")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, x in items:
            if i is not None and x and t and 0 < len(n := D.normal(x)) < 40 and (n in D.normal(t).split() or f" {n} " in f" {D.normal(t)} " or n == "好的" and n in t):
                want.add((d, i, 0))
            if i is not None and x and len(n := D.normal(x)) >= 40 and t:
                e = edit_distance(n, D.normal(t), True)
                if e <= int(len(n) * 0.08):
                    want.add((d, i, e))
    assert len(want) > 10 and {(62, 91, 0), (62, 92, 0), (64, 93, 0)} == {w for w in want if w[1] > 90}
    for chars in (8_000_000, 300):
        got = {(r.doc_id, r.item_id, r.edits) for r in D.benchmark_hits(df, bench, block_chars=chars).collect()}
        assert got == want
    left = D.keep_clean(df, D.benchmark_hits(df, bench))
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(map(repr, (d for d, _ in docs if d is None or d not in {w[0] for w in want})))


def test_query_of_hits_by_brute_force(spark, fixture_dir):
    docs = [tuple(r)[:2] for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/benchmark.parquet").collect()]
    want = []
    for d, t in docs:
        for i, x in items:
            if i is not None and x and t:
                n, m = D.normal(x), D.normal(t)
                e = edit_distance(n, m, True) if len(n) >= 40 and len(m) < 3000 else 0 if f" {n} " in f" {m} " else len(n)
                want += [(d, i, e)] * (e <= (int(len(n) * 0.08) if len(n) >= 40 else 0))
    assert want and sorted(map(repr, ((r.doc_id, r.item_id, r.edits) for r in D.op5_decontaminate(spark, fixture_dir).collect()))) == sorted(map(repr, want))


def test_hits_of_nothing(messy, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.benchmark_hits(messy, none).count() == 0 and D.keep_clean(messy, D.benchmark_hits(messy, none)).count() == messy.count()
    assert D.benchmark_hits(empty, none).count() == 0


PAGE = """<html><head><title>T &amp; U</title><style>p{}</style></head><body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div><article><h1>Head &amp; line</h1><p>First   paragraph<br>goes on here, with some words in it.</p><script>var x = "</p>";</script>
<p><b>Second one is open.<br><p>Third &lt;one&gt; ends.</p><div class="ad">Buy now.</div></article><aside><p>See also this.</p></aside>
<section id="comments"><h3>Comments</h3><p>Nice article, thank you very much.</p></section><form><input><button>Send</button></form><footer>&copy; nobody</footer></body></html>"""


def model(spark):
    return X.train(spark.createDataFrame([(p,) for p in X.labelled_pages()], "html string"))


def test_main_text(spark):
    own = model(spark)
    assert own.text(PAGE) == "Head & line\n\nFirst paragraph goes on here, with some words in it.\n\nSecond one is open.\n\nThird <one> ends."
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", PAGE, 5), (1, "u", PAGE, 5), (4, "u", "<p>cut off <b", 5), (5, "u", "no markup < at > all", 5), (6, "u", "<div>" * 3000 + "deep", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = X.extract_text(df, own).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and sum(r.text == own.text(PAGE) for r in got) == 3
    assert X.extract_text(df.limit(0), own).count() == 0


def test_pages_without_regions(spark):
    """Text in the body itself, and pages without markup, are text; what stands around it in regions is not."""
    own = model(spark)
    words = "Some words that make a sentence of an ordinary length here."
    assert own.text(words) == words and own.text(f"{words} a < b &amp; c") == f"{words} a < b & c"
    assert own.text(f"<html><body>{words} {words}</body></html>") == f"{words} {words}"
    assert own.text(f'<html><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>{words} {words}<br>{words}<footer>&copy; nobody</footer></body></html>') == f"{words} {words} {words}"
    assert own.text(f"<body><p>{words}</p><p>{words} {words}</p></body>") == f"{words}\n\n{words} {words}"


def test_broken_pages_take_linear_time(spark):
    import time

    own, began = model(spark), time.time()
    for page in ("<p>x <b " + 'a="" ' * 20000, "<a " + "a=' " * 20001, "<!--" * 20000, "<script>" * 20000, "<" * 50000, "<p>" + "</script" * 20000, "<b>" * 20000 + "</i>" * 20000, "<p " + "a" * 200000 + ">x</p>", "<p " + 'a"' * 50001 + ">x</p>", "<title>" * 9999 + "</title"):
        own.text(page)
    assert time.time() - began < 30


def test_unclosed_elements_take_linear_time(spark):
    import time

    own = model(spark)
    shapes = ["<h2>x" * 100_000, "<dd>x" * 100_000, "<pre>x" * 100_000, "<span>" * 100_000 + "<p>x" * 100_000, "<b><div>" + "<i>" * 50_000 + "</b>x" * 50_000, "<td>x" * 100_000, "<li><b>x" * 50_000]
    for page in shapes:
        began = time.process_time()
        X.parse(page)
        assert time.process_time() - began < 6, page[:20]
    assert own.text(shapes[0]).count("x") in (0, 100_000)


def test_stack_places_give_the_same_tree_as_walking_the_stack():
    """The walk that the places replace, on random tag soup."""
    import random

    tags = "div p b i span h2 li ul td tr table a dd dl article".split()
    for seed in range(300):
        rng = random.Random(seed)
        page = "".join(rng.choice(["<{0}>", "</{0}>", "<{0}>t", "t</{0}>"]).format(rng.choice(tags)) for _ in range(60))
        nodes = [("#root", -1)]
        at = [0]
        for end, tag in __import__("re").findall(r"<(/?)(\w+)>", page):
            if end:
                for depth in range(len(at) - 1, 0, -1):
                    own = nodes[at[depth]][0]
                    if own == tag:
                        del at[depth:]
                        break
                    if own in X.SCOPES and tag not in X.SCOPES:
                        break
                continue
            if tag in X.BLOCKS:
                ends = X.ENDS.get(tag, set()) | {"p"}
                for depth in range(len(at) - 1, 0, -1):
                    own = nodes[at[depth]][0]
                    if own in ends:
                        del at[depth:]
                        break
                    if own in X.SCOPES:
                        break
            nodes.append((tag, at[-1]))
            at.append(len(nodes) - 1)
        found, blocks = X.parse(page)
        assert [(x.tag, x.up) for x in found] == nodes
        for i, _ in blocks:
            assert i == 0 or found[i].tag in X.BLOCKS


def test_only_the_outermost_article_is_labelled_content():
    page = "<html><nav><article>menu</article></nav><article>main<article class=comment>c</article></article><aside><article>t</article></aside></html>"
    nodes, blocks = X.parse(X.landmark_labels(page))
    y = X.states(nodes)
    assert [t for i, t in blocks if y[i]] == ["main"]


def test_query_on_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert X.op10_html_text(spark, str(tmp_path)).count() == 0


def test_held_out_landmarks(spark):
    """Trained on 100 real pages labelled by their landmarks and on the generated ones, tested on the other real pages."""
    import os

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        return
    pages = spark.read.parquet(path)
    own = X.train(spark.createDataFrame([(p,) for p in X.labelled_pages()], "html string").unionByName(X.by_landmarks(pages, 100)))
    taken = {r.html for r in X.by_landmarks(pages, 100).collect()}
    right = found = there = 0
    for r in pages.collect():
        if (marked := X.landmark_labels(r.html)) and marked not in taken:
            nodes, blocks = X.parse(marked)
            y, p = X.states(nodes), own.marginals(nodes)
            right += sum(bool(y[i]) and p[i] >= 0.5 for i, _ in blocks)
            found += sum(p[i] >= 0.5 for i, _ in blocks)
            there += sum(y[i] for i, _ in blocks)
    assert there > 500 and right / found > 0.99 and right / there > 0.99


def test_held_out_pages(spark):
    own, wrong, total = model(spark), 0, 0
    for page in X.labelled_pages(150, 99):
        nodes, blocks = X.parse(page)
        y, p = X.states(nodes), own.marginals(nodes)
        wrong += sum((p[i] >= 0.5) != y[i] for i, _ in blocks)
        total += len(blocks)
    assert wrong / total < 0.04


def test_marginals_match_enumeration(spark):
    from itertools import product

    own = model(spark)
    nodes, _ = X.parse('<body><div class="post"><p>Some words here.</p><p>x</p></div><div class="ad">y</div></body>')
    nodes, n = nodes, len(nodes)
    local = []
    for features in X.evidence(nodes):
        d = sum(own.log[f][1] - own.log[f][0] for f in features if f in own.log)
        local.append((1 / (1 + 2.718281828459045**d), 1 / (1 + 2.718281828459045**-d)))
    total, one = 0.0, [0.0] * n
    for y in product((0, 1), repeat=n):
        w = (1 - own.root, own.root)[y[0]]
        for i in range(n):
            w *= local[i][y[i]]
            if i:
                w *= own.tie.get(nodes[i].tag, own.other)[y[nodes[i].up]][y[i]]
        total += w
        for i in range(n):
            one[i] += w * y[i]
    assert all(abs(p - o / total) < 1e-9 for p, o in zip(own.marginals(nodes), one))
