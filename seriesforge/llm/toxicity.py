"""Toxicity by a lexicon, a Levenshtein automaton and context windows.

The lexicon is learned from labelled documents: words, and beginnings of words, that stand in toxic documents
far more often than chance allows among so many candidates; `max_labelled` bounds the labelled rows, and so all
that is learned. Of more rows, those with the least hash of the id are taken.

Each word of a text is looked up; one that is no term walks the trie of terms together with the automaton of
its spellings within one edit (bit-parallel states, a branch is left when no state lives). Words that the labels
show in clean documents are ordinary words and no misspellings, and a term whose neighbours stand in clean documents more
often than in toxic ones has ordinary neighbours: it is matched as it is only.

A hit counts as quoted if it stands between quotation marks, which may close anywhere in the same paragraph, or if a cue
word stands in its window of `WINDOW` words to either side, and as abuse otherwise. Cue words are learned too: words in the windows
of hits that the labels show in clean documents (where a term is reported, defined or discussed) and not in toxic ones, beyond what
chance allows; a short list of words of saying is there from the start and is dropped word by word where the labels
speak against it. The score is a logistic function of the four sums (exact or misspelled, abuse or quoted), fitted with
a pull towards a prior, so that what the labels don't show keeps a sensible weight.

Nulls: a null or empty text has no hits and gets the score of no hits. Rows with a null doc_id are scored, and
held out. Labels that are null, or of unknown documents, teach nothing; of several labels of one id the
highest counts, and of several documents with that id the least text. Repeated rows get equal scores; an empty table gives an
empty one. Without labels the lexicon is empty and the prior holds. Texts of any length are taken whole. Extra columns,
whatever their names, are kept by score_documents if they are in `carry`; those called score or predicted, in any case, are replaced.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import free_name, read_table, stored

TOKEN = re.compile(r"[^\W_](?:[\w*@$!]*[\w])?")
#: Words to either side of a hit that its window holds.
WINDOW = 5
#: Words of saying to start from, in four languages.
SAYING = frozenset("said says say wrote writes write called calls quoted quote quotes cited dit disait écrit appelé cite sagte sagt schrieb nannte zitiert dijo dice escribió llamó cita".split())
PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
#: Of the intercept and the four sums.
PRIOR = np.array([-4.0, 4.0, 3.5, 0.8, 0.5])
PREFIX = (4, 5, 6)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


class Lexicon:
    """Terms with weights; beginnings match as they are. The trie holds the words of four letters and more; of those with four letters
    a misspelling keeps the length, for what is a letter longer or shorter is most often another word."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], clean: frozenset[str] = frozenset(), cues: frozenset[str] = SAYING, spelled: frozenset[str] | None = None):
        self.words, self.prefixes, self.clean, self.cues = words, prefixes, clean, cues
        self.spelled = frozenset(w for w in (words if spelled is None else spelled) if len(w) >= 4)
        self.trie: dict = {}
        for w in sorted(self.spelled):
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        # One edit leaves the first or the second half of a term as it is.
        self.heads, self.tails = {w[: len(w) // 2] for w in self.spelled}, {w[len(w) // 2 :] for w in self.spelled}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.most = max(map(len, self.spelled), default=0)
        self.seen: dict[str, tuple[bool, float] | None] = {}

    def near(self, word: str) -> bool:
        return any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes)

    def misspelled(self, word: str) -> float:
        """The greatest weight of a term within one edit."""
        return max((self.words[t] for t in self.neighbours(word)), default=0.0)

    def neighbours(self, word: str) -> list[str]:
        """The terms within one edit: automaton and trie are walked together."""
        n, masks = len(word), {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        last, full = 1 << n, (1 << (n + 1)) - 1
        out = []
        # Bit i of a state: i characters of the word are read, with no edit (a) or at most one (b).
        stack = [(self.trie, 1, 0b11)]
        while stack:
            node, a, b = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (a | b) & last and (len(child) > 4 or n == 4):
                        out.append(child)
                    continue
                m = masks.get(c, 0)
                a2 = (a & m) << 1
                b2 = (((b & m) << 1) | a | (a << 1) | (a2 << 1)) & full
                if a2 | b2:
                    stack.append((child, a2, b2))
        return out

    def look(self, word: str) -> tuple[bool, float] | None:
        """Whether the word is a term as it is, and its weight."""
        if (w := self.words.get(word)) is not None:
            return True, w
        for n in PREFIX:
            if len(word) > n and (w := self.prefixes.get(word[:n])) is not None:
                return True, w
        if 4 <= len(word) <= self.most + 1 and word not in self.clean and self.near(word):
            if (w := self.misspelled(word)) > 0:
                return False, w
        return None

    def hits(self, text: str) -> list[tuple[bool, float, bool, list[str]]]:
        """Of each hit: whether it is exact, its weight, whether it stands between quotation marks, and the words around it."""
        low = text.lower()
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        bad = {}
        for w in set(TOKEN.findall(low)):
            if w in seen:
                hit = seen[w]
            else:
                hit = seen[w] = self.look(w)
            if hit:
                bad[w] = hit
        if not bad:
            return []
        spans = [(m.start(), m.group()) for m in TOKEN.finditer(low)]
        inside, k, out = quoted_spans(low), 0, []
        for i, (at, w) in enumerate(spans):
            if w in bad:
                while k < len(inside) and inside[k][1] <= at:
                    k += 1
                out.append((*bad[w], k < len(inside) and inside[k][0] <= at, [x for _, x in spans[max(0, i - WINDOW) : i] + spans[i + 1 : i + 1 + WINDOW]]))
        return out

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Logarithms of the sums of weights: exact and misspelled abuse, exact and misspelled quotation."""
        sums = [0.0] * 4
        for exact, weight, marked, around in self.hits(text):
            quoted = marked or not self.cues.isdisjoint(around)
            sums[2 * quoted + (not exact)] += weight
        return tuple(math.log1p(x) for x in sums)


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks, in order; a mark is closed in its paragraph or is none."""
    out = []
    marks = re.compile("[" + "".join(QUOTES) + "]")
    start = 0
    for end in [*(m.start() for m in PARAGRAPH.finditer(text)), len(text)]:
        at = start
        unclosed: set[str] = set()
        while m := marks.search(text, at, end):
            closing = QUOTES[m.group()]
            stop = -1 if closing in unclosed else text.find(closing, m.end(), end)
            if stop >= 0:
                out.append((m.end(), stop))
                at = stop + 1
            else:
                unclosed.add(closing)
                at = m.end()
        start = end
    return out


def labelled(labels: DataFrame, docs: DataFrame, max_labelled: int) -> DataFrame:
    """text, toxic of at most max_labelled rows that may be learned from, one for each id."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most max_labelled rows of two numbers: small enough to be sent everywhere.
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''").join(F.broadcast(chosen), "doc_id")
    return stored(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")


def words_of(text: str = "text") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))


def learn_lexicon(rows: DataFrame, least_weight: float) -> Lexicon:
    """Weights are smoothed log odds over documents. A term needs three toxic documents and a likelihood ratio beyond what the best
    of all candidates has by chance; for a beginning the ratio counts the different words of each document that have it."""
    docs = stored(rows.select("toxic", words_of().alias("w")), "words")
    of = lambda x: F.sum(F.when(F.col("toxic") == x, 1).otherwise(0))
    words = stored(docs.select("toxic", F.explode("w").alias("term")).groupBy("term").agg(of(1).alias("t"), of(0).alias("c")), "terms")
    # Beginnings once for each document; how many words of documents have them comes from the words' own counts.
    starts = lambda n, w: F.transform(F.filter(w, lambda x: F.length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))
    begun = docs.select("toxic", F.explode(F.array_distinct(F.concat(*[starts(n, F.col("w")) for n in PREFIX]))).alias("term")).groupBy("term").agg(of(1).alias("t"), of(0).alias("c"))
    pairs = words.select(F.explode(F.concat(*[starts(n, F.array("term")) for n in PREFIX])).alias("term"), "t", "c").groupBy("term").agg(F.sum("t").alias("tk"), F.sum("c").alias("ck"))
    counts = stored(words.select("term", "t", "c", F.col("t").alias("tk"), F.col("c").alias("ck")).unionByName(begun.join(pairs, "term")), "counts")
    n = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = float(n["t"] or 0), float(n["c"] or 0)
    if not toxic or not clean:
        return Lexicon({}, {})
    share = toxic / (toxic + clean)
    t, c, tk, ck = (F.col(x).cast("double") for x in ("t", "c", "tk", "ck"))
    part = lambda x, q: F.when(x > 0, x * F.log(x / ((tk + ck) * q))).otherwise(0.0)
    scored = counts.withColumn("weight", F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))).withColumn("ratio", part(tk, share) + part(ck, 1 - share))
    candidates = max(2, counts.count())
    best = scored.where((t >= 3) & (F.col("weight") >= least_weight) & (F.col("ratio") >= math.log(candidates)))
    found = {r["term"]: (r["weight"], r["t"]) for r in best.select("term", "weight", "t").collect()}  # terms of max_labelled documents
    whole, begin = {k: v for k, v in found.items() if k[-1] != "*"}, {k[:-1]: v for k, v in found.items() if k[-1] == "*"}
    # Where one word makes up most of a beginning, the beginning is none.
    ruled = {w[:n] for w, (_, k) in whole.items() for n in PREFIX if w[:n] in begin and 2 * k >= begin[w[:n]][1]}
    return Lexicon({k: v[0] for k, v in whole.items()}, {k: v[0] for k, v in begin.items() if k not in ruled})


def with_neighbours(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with the ordinary words near a term, and with the terms whose misspellings count."""
    if not lexicon.trie:
        return lexicon
    parts = lexicon.words, lexicon.prefixes
    words = rows.select("toxic", F.explode(words_of()).alias("w")).groupBy("w").agg(F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*parts)
        for batch in batches:
            rows = [(w, t, c) for w, t, c in zip(*(batch.column(k).to_pylist() for k in ("w", "t", "c"))) if (hit := own.look(w)) and not hit[0]]
            found = [(w, term, t, c) for w, t, c in rows for term in own.neighbours(w)]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["w", "term", "t", "c"])

    found = words.mapInArrow(near, "w string, term string, t long, c long").collect()  # words of max_labelled documents
    n = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = Counter(), Counter()
    for r in found:
        toxic[r["term"]] += r["t"]
        clean[r["term"]] += r["c"]
    spelled = frozenset(w for w in lexicon.spelled if (toxic[w] + 0.5) / (n["t"] + 1) >= (clean[w] + 0.5) / (n["c"] + 1))
    return Lexicon(*parts, frozenset(r["w"] for r in found if r["c"]), lexicon.cues, spelled)


def learn_cues(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words in the windows of hits that tell quotation from abuse: documents with them there are clean ones, far more than chance
    allows among so many words. A word of saying stays a cue unless the labels show it rather in toxic documents."""
    parts = lexicon.words, lexicon.prefixes, lexicon.clean, lexicon.cues, lexicon.spelled

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*parts)
        for batch in batches:
            words, toxic = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                if hits := own.hits(text):
                    near = {"", *(w for *_, around in hits for w in around)} - own.words.keys()
                    words += near
                    toxic += [y] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["w", "toxic"])

    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(windows, "w string, toxic int")
    counted = stored(counted.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "cues")
    whole = counted.where("w = ''").first()  # documents with hits
    if not whole or not whole["c"]:
        return SAYING
    share = (whole["c"] + 0.5) / (whole["t"] + whole["c"] + 1)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    part = lambda x, q: F.when(x > 0, x * F.log(x / ((t + c) * q))).otherwise(0.0)
    told = (c >= 3) & (c / (t + c) > share) & (part(c, share) + part(t, 1 - share) >= math.log(max(2, counted.count())))
    learned = {r["w"] for r in counted.where("w <> ''").where(told).select("w").collect()}
    against = {r["w"] for r in counted.where(F.col("w").isin(sorted(SAYING))).where((t >= 3) & (c / (t + c) <= share)).select("w").collect()}
    return frozenset(learned | (SAYING - against))


def with_features(df: DataFrame, lexicon: Lexicon, carry: list[str], mark: str = "x") -> DataFrame:
    """carry and `mark` (array of four doubles) for each row."""
    sent = df.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.prefixes, lexicon.clean, lexicon.cues, lexicon.spelled))  # learned from max_labelled documents
    schema = df.select(*carry).withColumn(mark, F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = [own.features(t) if t else (0.0, 0.0, 0.0, 0.0) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(x, pa.list_(pa.float64()))], [*carry, mark])

    return df.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards PRIOR."""
    x1, b = np.hstack([np.ones((len(x), 1)), x]), PRIOR.copy()

    def loss(b: np.ndarray) -> float:
        z = x1 @ b
        return float(np.logaddexp(0, z).sum() - y @ z + pull * ((b - PRIOR) ** 2).sum() / 2)

    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + pull * np.eye(len(b)), x1.T @ (y - p) - pull * (b - PRIOR))
        while (after := loss(b + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        b, gain, now = b + step, now - after, after
        if gain < 1e-9:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, least_weight: float = 2.5) -> tuple[Lexicon, list[float]]:
    rows = labelled(labels, docs, max_labelled)
    lexicon = learn_lexicon(rows, least_weight)
    lexicon = with_neighbours(rows, lexicon)
    lexicon = Lexicon(lexicon.words, lexicon.prefixes, lexicon.clean, learn_cues(rows, lexicon), lexicon.spelled)
    found = with_features(rows, lexicon, ["toxic"]).collect()  # max_labelled rows at most
    if not found:
        return lexicon, PRIOR.tolist()
    return lexicon, fit(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float)).tolist()


def score_documents(docs: DataFrame, lexicon: Lexicon, weights: list[float], carry: list[str]) -> DataFrame:
    """carry, score, predicted for each row of docs; columns of the docs called score or predicted are replaced."""
    z = F.lit(weights[0])
    mark = free_name(docs, "_x")
    for i, w in enumerate(weights[1:]):
        z = z + F.lit(w) * F.col(mark)[i]
    found = with_features(docs.withColumn("text", F.col("text").cast("string")), lexicon, [c for c in carry if c.lower() not in ("score", "predicted")], mark)
    return found.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(mark)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lexicon, weights = learn(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, lexicon, weights, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
