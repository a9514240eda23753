"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements. Each element has a hidden state, content or not, with evidence from its
tag, the words of its class, id and role, the length of its own text, how it ends, and the share of link text below
it; parent and child are tied by a table for the child's tag. Messages go once from the leaves to the root
and once back (sum-product), which gives the exact marginal of every element. Blocks of text whose
element is content with a marginal of at least one half are kept.

The tables are counts over labelled pages: HTML in which data-label="1" or "0" on an element gives the state of it
and, until the next such mark, of what is below it (on <html>, or as a comment at the head of a page, that of the root
as well). `train` counts them on Spark for any table of such pages. The query takes two sets: `labelled_pages` (region
kinds and layouts drawn by a seeded generator) and `by_landmarks`, at most `most` real pages whose own landmark elements
(article, nav, footer and the like) say which parts are content.

Nulls: a null or empty page, and one without content, has text "" and 0 characters; null ids and urls stay.
Pages may end anywhere: elements open there end there, and a tag that the end cuts off is no text. A page without markup is
its own text. Where content and other are equally likely a block counts as content. Pages of any length are taken whole, in time
proportional to it, `rows` of them at a time. An empty table gives an empty one. Repeated rows give equal rows. Extra columns,
whatever their names, are not read.
"""

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import read_table

# Nothing in a tag is read twice: once a quoted value, or what stands outside of quotes, has matched, it is not tried another way.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w:-])([a-zA-Z][\w:-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
ROOT_MARK = re.compile(r"<!--data-label=([01])-->")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
#: Elements whose text is never text of an article.
SILENT = frozenset("head script style textarea title noscript iframe noframes template svg math canvas object audio video select option button form input label datalist xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
#: What a start tag ends, if it is open in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body div section article aside main nav header footer table td th ul ol dl blockquote form figure details".split())


class Node:
    __slots__ = ("tag", "up", "names", "mark", "words", "chars", "linked", "last", "silent", "block")

    def __init__(self, tag: str, up: int, names: tuple[str, ...] = (), mark: str | None = None, silent: bool = False, block: int = 0):
        self.tag, self.up, self.names, self.mark, self.silent, self.block = tag, up, names, mark, silent, block
        self.words = self.chars = self.linked = 0
        self.last = ""


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in document order, parents first, and blocks of text in page order with the block element they belong to."""
    nodes, blocks = [Node("#root", -1)], []
    stack, held = [0], []
    # Where in the stack the open elements of each tag and the open scopes are, so that no tag walks the stack.
    places: defaultdict[str, list[int]] = defaultdict(list)
    scopes = [0]
    if m := ROOT_MARK.match(page):
        nodes[0].mark = m.group(1)
    at = 0

    def close_block() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                i = nodes[stack[-1]].block
                node = nodes[i]
                node.words += text.count(" ") + 1
                node.last = text[-1]
                blocks.append((i, text))

    def end_to(depth: int) -> None:
        while len(stack) > depth:
            own = nodes[stack.pop()].tag
            places[own].pop()
            if own in SCOPES:
                scopes.pop()

    def take(text: str) -> None:
        top = nodes[stack[-1]]
        if top.silent:
            return
        held.append(text)
        if n := len(text.strip()):
            top.chars += n
            if any(nodes[i].tag == "a" for i in stack[-4:]):
                top.linked += n

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if m.group() == "<":
            # A lone "<" is text, a tag that the page's end cuts off is not.
            if page[at : at + 1].isalpha() or page[at : at + 1] == "/":
                break
            take("<")
            continue
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            # Formatting ends within its container only.
            if places[tag] and (tag in SCOPES or places[tag][-1] > scopes[-1]):
                if tag in BLOCKS:
                    close_block()
                end_to(places[tag][-1])
            continue
        if tag in BLOCKS:
            close_block()
            # A block ends an open paragraph; formatting inside it ends with it.
            wanted = ENDS.get(tag, set()) | ({"p"} if tag not in ("html", "body") else set())
            depth = max((places[t][-1] for t in wanted if places[t]), default=0)
            if depth and depth >= scopes[-1]:
                end_to(depth)
        if tag == "br":
            take(" ")
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(3))} if m.group(3).strip() else {}
        if tag in VOID:
            continue
        names = tuple(sorted({w.lower() for k in ("class", "id", "role") if k in attributes for w in NAME.findall(attributes[k])}))
        silent = tag in SILENT or nodes[stack[-1]].silent
        nodes.append(Node(tag, stack[-1], names, attributes.get("data-label"), silent, len(nodes) if tag in BLOCKS else nodes[stack[-1]].block))
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or n) if end else n
        elif not m.group(3).rstrip().endswith("/") or tag in BLOCKS:
            places[tag].append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(len(nodes) - 1)
        if tag == "html" and nodes[-1].mark is not None:
            nodes[0].mark = nodes[-1].mark
    close_block()
    return nodes, blocks


def bucket(n: int) -> int:
    return min(7, n.bit_length())


def evidence(nodes: list[Node]) -> list[list[str]]:
    chars, linked = [x.chars for x in nodes], [x.linked for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].up] += chars[i]
        linked[nodes[i].up] += linked[i]
    out = []
    for i, x in enumerate(nodes):
        # Each page has one root, html and body: their tags say nothing that their ties do not.
        tag = [] if x.tag in ("html", "body") else ["t alone"] * (len(nodes) == 1) if not i else [f"t {x.tag}"]
        own = [*tag, *(f"c {w}" for w in x.names)]
        if x.words:
            own += [f"n {bucket(x.words)}", f"e {x.last if x.last in '.!?:' else '-'}"]
        if chars[i]:
            own.append(f"k {round(4 * linked[i] / chars[i])}")
        out.append(own)
    return out


def states(nodes: list[Node]) -> list[int]:
    out = []
    for x in nodes:
        out.append(int(x.mark) if x.mark in ("0", "1") else out[x.up] if x.up >= 0 else 0)
    return out


class TreeModel:
    """counts: (kind, key, state or two states, n). Kinds: f evidence, y states, r states of roots, p parent and child states by the child's tag."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        table = {(k, key, s): n for k, key, s, n in counts}
        total = [table.get(("y", "", str(s)), 0) + 1 for s in (0, 1)]
        roots = [table.get(("r", "", str(s)), 0) + 1 for s in (0, 1)]
        #: How likely a page's root is content: text that stands in no region of its own.
        self.root = roots[1] / sum(roots)
        seen = {key for k, key, _, _ in counts if k == "f"}
        self.log = {key: tuple(math.log((table.get(("f", key, str(s)), 0) + 0.3) / (total[s] + 0.6)) for s in (0, 1)) for key in seen}
        tags = {key for k, key, _, _ in counts if k == "p"}
        whole = Counter()
        for k, _, s, n in counts:
            if k == "p":
                whole[s] += n
        prior = lambda a, b: (whole[f"{a}{b}"] + 1) / (whole[f"{a}0"] + whole[f"{a}1"] + 2)
        one = lambda tag, a, b: (table.get(("p", tag, f"{a}{b}"), 0) + 4 * prior(a, b)) / (table.get(("p", tag, f"{a}0"), 0) + table.get(("p", tag, f"{a}1"), 0) + 4)
        self.tie = {tag: tuple(tuple(one(tag, a, b) for b in (0, 1)) for a in (0, 1)) for tag in tags}
        self.other = tuple(tuple(prior(a, b) for b in (0, 1)) for a in (0, 1))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of each element, given the whole tree."""
        n = len(nodes)
        up0, up1 = [1.0] * n, [1.0] * n
        own: list[tuple[float, float]] = []
        log = self.log
        for features in evidence(nodes):
            d = 0.0
            for f in features:
                if f in log:
                    a, b = log[f]
                    d += b - a
            d = max(-30.0, min(30.0, d))
            p = 1 / (1 + math.exp(-d))
            own.append((1 - p, p))
        message: list[tuple[float, float]] = [(1.0, 1.0)] * n
        ties = [self.tie.get(x.tag, self.other) for x in nodes]
        for i in range(n - 1, 0, -1):
            b0, b1 = own[i][0] * up0[i], own[i][1] * up1[i]
            (t00, t01), (t10, t11) = ties[i]
            m0, m1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
            s = m0 + m1
            message[i] = m0, m1 = m0 / s, m1 / s
            j = nodes[i].up
            a0, a1 = up0[j] * m0, up1[j] * m1
            s = a0 + a1
            up0[j], up1[j] = a0 / s, a1 / s
        out = [0.0] * n
        down = [(1.0, 1.0)] * n
        down[0] = (1 - self.root, self.root)
        for i in range(n):
            if i:
                j = nodes[i].up
                m0, m1 = message[i]
                # What the parent believes without this child.
                r0, r1 = own[j][0] * up0[j] * down[j][0] / max(m0, 1e-300), own[j][1] * up1[j] * down[j][1] / max(m1, 1e-300)
                (t00, t01), (t10, t11) = ties[i]
                d0, d1 = r0 * t00 + r1 * t10, r0 * t01 + r1 * t11
                s = d0 + d1
                down[i] = (d0 / s, d1 / s) if s else (0.5, 0.5)
            b0, b1 = own[i][0] * up0[i] * down[i][0], own[i][1] * up1[i] * down[i][1]
            out[i] = b1 / (b0 + b1) if b0 + b1 else 0.5
        return out

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        p = self.marginals(nodes)
        return "\n\n".join(t for i, t in blocks if p[i] >= 0.5)


def page_counts(page: str) -> Counter:
    out: Counter = Counter()
    nodes, _ = parse(page)
    y = states(nodes)
    out["r", "", str(y[0])] += 1
    for i, features in enumerate(evidence(nodes)):
        out["y", "", str(y[i])] += 1
        for f in features:
            out["f", f, str(y[i])] += 1
        if i:
            out["p", nodes[i].tag, f"{y[nodes[i].up]}{y[i]}"] += 1
    return out


def train(pages: DataFrame, column: str = "html") -> TreeModel:
    """Counts over a table of labelled pages. All counts come to the driver: one for each tag, name and size class in the labelled pages,
    which are a set of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(column).to_pylist():
                total.update(page_counts(page or ""))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.string()) for i in range(3)] + [pa.array(list(total.values()), pa.int64())], ["kind", "key", "state", "n"])

    counted = pages.select(column).mapInArrow(run, "kind string, key string, state string, n long").groupBy("kind", "key", "state").agg(F.sum("n").alias("n"))
    return TreeModel([(r["kind"], r["key"], r["state"], r["n"]) for r in counted.orderBy("kind", "key", "state").collect()])


#: Region kinds of the generated pages: tags, and words for class or id. Fixed by what such regions are called on the web.
REGIONS = {
    "menu": (["nav", "div", "ul"], "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager toc tabs"),
    "header": (["header", "div"], "header masthead banner top brand logo site"),
    "footer": (["footer", "div"], "footer bottom colophon copyright legal site"),
    "sidebar": (["aside", "div", "section"], "sidebar side rail widget related recommended popular trending archive tags categories more"),
    "notice": (["div", "section", "aside", "p"], "notice cookie consent alert gdpr privacy warning paywall popup modal overlay message"),
    "advert": (["div", "aside", "section", "p", "ins"], "ad ads advert advertisement sponsor sponsored promo promotion banner adsense affiliate"),
    "form": (["div", "section"], "form login signup subscribe subscription newsletter search contact register"),
    "share": (["div", "ul", "p"], "share social sharing follow buttons meta byline"),
    "comments": (["section", "div", "ol", "aside"], "comments comment discussion replies reply respond disqus reader responses thread"),
}
CONTENT = (["article", "main", "div", "section"], "article content post entry story text body main page blog")


def labelled_pages(n: int = 600, seed: int = 17) -> list[str]:
    """Pages with a main part and other regions before, inside and after it. Words are drawn letters, so that no language is learned."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioutnrslmd", k=rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(k: int) -> str:
        return " ".join(words(1, 20).capitalize() + rng.choice("....!?") for _ in range(k))

    def attribute(names: str, how: float) -> str:
        if rng.random() > how:
            return ""
        own = rng.sample(names.split(), rng.randint(1, 2))
        return f' {rng.choice(["class", "class", "class", "id"])}="{rng.choice(["-", " ", "_"]).join(own)}"'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(k))

    def region(kind: str) -> str:
        tags, names = REGIONS[kind]
        tag = rng.choice(tags)
        telling = tag in ("nav", "header", "footer", "aside", "ins")
        body = {
            "menu": lambda: links(rng.randint(2, 9)) if tag == "ul" else f"<ul>{links(rng.randint(2, 9))}</ul>",
            "header": lambda: rng.choice([f"<a href='/'>{words(1, 3)}</a>", f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", f"<h2>{words(1, 3)}</h2><ul>{links(4)}</ul>"]),
            "footer": lambda: rng.choice([f"&copy; {words(1, 5)} &middot; {sentences(1)}", f"<p>&copy; 2020 {words(1, 5)}</p><ul>{links(3)}</ul>", f"<p>{sentences(2)}</p>"]),
            "sidebar": lambda: f"<h3>{words(1, 3)}</h3>" + rng.choice([f"<ul>{links(5)}</ul>", f"<p>{sentences(rng.randint(1, 3))}</p>", f"<div><p>{sentences(1)}</p><a href='/x'>{words(1, 3)}</a></div>"]),
            "notice": lambda: rng.choice([sentences(rng.randint(1, 3)), f"<p>{sentences(rng.randint(1, 3))}</p>", f"<p>{sentences(1)}<a href='/p'>{words(1, 2)}</a></p>"]),
            "advert": lambda: rng.choice([sentences(rng.randint(1, 2)), f"<p>{sentences(rng.randint(1, 2))}</p>" if tag != "p" else words(2, 9), f"<a href='http://{word()}'>{words(2, 6)}</a>"]),
            "form": lambda: f"<p>{sentences(1)}</p><form><label>{word()}</label><input><button>{word()}</button></form>",
            "share": lambda: links(4) if tag == "ul" else f"<a href='#'>{word()}</a> <a href='#'>{word()}</a>" + rng.choice(["", words(1, 4)]),
            "comments": lambda: f"<h3>{words(1, 2)}</h3>" * (tag != "ol") + "".join((f"<li>{x}</li>" if tag == "ol" else rng.choice([f'<div class="comment">{x}</div>', x, f"<article{attribute('comment reply user', 0.7)}>{x}</article>"])) for x in (f"<p>{sentences(rng.randint(1, 4))}</p>" for _ in range(rng.randint(1, 4)))),
        }[kind]()
        return f'<{tag} data-label="0"{attribute(names, 0.5 if telling else 1)}>{body}</{tag}>'

    def paragraph() -> str:
        x = sentences(rng.choice([1, 1, 2, 3, 5, 8]))
        x = rng.choice([x, x, x, f"<b>{x}</b>", x + f" <a href='/y'>{words(1, 2)}</a> {words(1, 5)}.", f"<b>{x}<br>"])
        return rng.choice([f"<p>{x}</p>"] * 8 + [f"<p>{x}", f"<blockquote><p>{x}</p></blockquote>", f"<ul><li>{words(2, 9)}</li><li>{sentences(1)}</li></ul>", f"<h2>{words(2, 6)}</h2>", f"<pre>{words(3, 9)}</pre>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 3)}</td></tr></table>", f"<div>{x}</div>", f"<figure><img><figcaption>{words(3, 9)}</figcaption></figure>"])

    out = []
    for _ in range(n):
        main = "".join(paragraph() for _ in range(rng.randint(1, 12)))
        if rng.random() < 0.7:
            main = f"<h1>{words(1, 9)}</h1>" + main
        inside = [region(k) for k in REGIONS if k in ("advert", "share", "comments", "notice", "sidebar", "form") and rng.random() < 0.15]
        for x in inside[:-1]:
            main += x if rng.random() < 0.5 else ""
        tag = rng.choice(CONTENT[0])
        if tag in ("div", "section"):
            whole = f'<{tag} data-label="1"{attribute(CONTENT[1], 1)}>{main}{"".join(inside[-1:])}</{tag}>'
        elif rng.random() < 0.3:
            whole = f'<{tag} data-label="1"{attribute(CONTENT[1], 0.3)}><div{attribute(CONTENT[1], 0.5)}>{main}</div>{"".join(inside[-1:])}</{tag}>'
        else:
            whole = f'<{tag} data-label="1"{attribute(CONTENT[1], 0.3)}>{main}{"".join(inside[-1:])}</{tag}>'
        before = [region(k) for k in ("header", "menu", "notice", "advert") if rng.random() < 0.6]
        after = [region(k) for k in ("sidebar", "comments", "share", "form", "advert", "notice", "footer") if rng.random() < 0.45]
        own = rng.random()
        if own < 0.04:
            out.append("<!--data-label=1-->" + rng.choice([sentences(rng.randint(1, 9)), words(1, 30)]))
            continue
        if own < 0.16:  # text in the page itself, without an element around it
            if rng.random() < 0.3:
                before, after = [], []
            page = "".join(before) + rng.choice([main, sentences(rng.randint(1, 9)), "<br>".join(sentences(2) for _ in range(4))]) + "".join(after)
            out.append(f'<!DOCTYPE html><html data-label="1"><head data-label="0"><title>{words(1, 8)}</title></head><body>{page}</body></html>')
            continue
        page = "".join(before) + whole + "".join(after)
        if rng.random() < 0.3:
            page = f'<div data-label="0"{attribute("wrapper container outer site page layout", 0.8)}>{page}</div>'
        end = "</body></html>" if rng.random() < 0.9 else ""
        out.append(f'<!DOCTYPE html><html lang="x"><head><title>{words(1, 8)}</title><script>var t="</p>";</script></head><body>{page}{end}')
    return out


ASIDE = frozenset("nav footer aside form".split())


def landmark_labels(page: str) -> str | None:
    """The page with its landmark elements marked; None if it doesn't say where its article is. Its <html> is marked as no content.

    Only an outermost <article> outside of the other landmarks is content: one within another is a comment on it or a teaser."""
    if not re.search(r"<article[\s>]", page, re.I):
        return None
    deep = {"article": 0, "aside": 0}

    def mark(m: re.Match) -> str:
        tag = m.group(2).lower()
        kind = "aside" if tag in ASIDE else "article"
        if m.group(1):
            deep[kind] = max(0, deep[kind] - 1)
            return m.group()
        deep[kind] += 1
        return f'{m.group()} data-label="{int(kind == "article" and deep == {"article": 1, "aside": 0})}"'

    marked = re.sub(r"<(/?)(article|nav|footer|aside|form)(?=[\s>])", mark, page, flags=re.I)
    return re.sub(r"<html(?=[\s>])", '<html data-label="0"', marked, count=1, flags=re.I)


def by_landmarks(pages: DataFrame, most: int = 200, longest: int = 200_000) -> DataFrame:
    """html: a sample of at most `most` labelled pages of at most `longest` characters, those with the least hash."""
    own = pages.select(F.col("html").cast("string").alias("html")).where(F.length("html") <= longest).where(F.col("html").rlike(r"(?i)<article[\s>]"))
    sample = [r["html"] for r in own.orderBy(F.xxhash64("html")).limit(most).collect()]
    return pages.sparkSession.createDataFrame([(landmark_labels(x),) for x in sample], "html string")


def extract_text(pages: DataFrame, model: TreeModel, rows: int = 200) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # as large as the set of labelled pages made it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [own.text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    labelled = spark.createDataFrame([(x,) for x in labelled_pages()], "html string")
    return extract_text(pages, train(labelled.unionByName(by_landmarks(pages))))
