"""Byte-level BPE by forced boundaries.

A text is cut at special tokens and by the tokenizer's word pattern. Within a word, a cut is certain
between two bytes that stand side by side in no token of the vocabulary: no merge can ever cross it. The
fragments between such cuts are encoded on their own, lowest rank first, and their ids concatenated.
Fragments repeat far more than words, so each worker keeps bounded tables of those already encoded.

Nulls: a null text is an empty one and has no ids; an empty table gives an empty one. Texts of any length are taken
whole. Repeated rows give equal rows. Extra columns are not read by encode_documents and pass through the others,
whatever their names; one called like an output column is replaced there.
"""

import hashlib
import heapq
import json
import re
import struct
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import read_table, text_or_empty

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in the classes of the re module, which is faster; right for texts without the characters that the classes of both
#: modules treat differently.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def word_finder() -> Callable[[str], list[str]]:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    odd: set[str] = set()
    for own, wanted in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        odd |= set(re.findall(own, every)) ^ set(regex.findall(wanted, every))
    # One range for all that lies beyond 16 bits: re tests the rest of the class by a bitmap.
    unlike = re.compile("[" + "".join(re.escape(c) for c in sorted(odd) if c <= "\uffff") + "\U00010000-\U0010ffff]").search
    slow, fast = regex.compile(WORDS).findall, re.compile(PLAIN).findall
    return lambda text: slow(text) if unlike(text) else fast(text)


def printable_bytes() -> dict[str, int]:
    """The alphabet of such vocabularies: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Reads a tokenizers JSON file of a byte-level BPE model. What it has beyond that (a normalizer, another pre-tokenizer or decoder,
    flags of its added tokens, merges that are ignored) would change the ids, so it raises."""

    def __init__(self, path: str, most: int = 250_000):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        check(parts)
        known = printable_bytes()
        raw = lambda token: bytes(known[c] for c in token)
        vocab: dict[str, int] = parts["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.id_of = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        #: By two ids the rank of their merge, and by rank the id that they become.
        self.rank: dict[tuple[int, int], int] = {}
        self.becomes: list[int] = []
        for m in parts["model"]["merges"]:
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.rank[self.id_of[a], self.id_of[b]] = len(self.becomes)
            self.becomes.append(self.id_of[a + b])
        self.byte_ids = [self.id_of[bytes([i])] for i in range(256)]
        self.inside = {t[i : i + 2] for t in self.id_of for i in range(len(t) - 1)}
        self.words = word_finder()
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda text: [text]
        self.done: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self.most = most

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        inside, out, at = self.inside, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment. Only the two pairs beside a merge change; pairs of a long fragment wait in a heap, so it takes n log n steps."""
        rank, becomes, none = self.rank, self.becomes, 1 << 60
        parts = [self.byte_ids[b] for b in fragment]
        if len(parts) < 48:
            ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                parts[i : i + 2] = [becomes[best]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank.get((parts[i], parts[i + 1]), none)
                if i:
                    ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= len(parts) or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] = becomes[r]
            parts[j] = -1
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (p := rank.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (p, i))
            if before[i] >= 0 and (p := rank.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (p, before[i]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit integers."""
        out = []
        for fragment in self.cuts(word.encode()):
            ids = self.fragments.get(fragment)
            if ids is None:
                own = self.merged(fragment)
                ids = struct.pack(f"<{len(own)}I", *own)
                if len(fragment) <= 64:
                    if len(self.fragments) >= self.most:
                        self.fragments.clear()
                    self.fragments[fragment] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(word) <= 64:
            if len(self.done) >= self.most:
                self.done.clear()
            self.done[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, done, own = [], self.done, self.word
        for piece in self.split(text):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                out += [done[w] if w in done else own(w) for w in self.words(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Special tokens stay; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def check(parts: dict) -> None:
    """Raises on what this encoder does not do."""
    model, pre = parts["model"], parts.get("pre_tokenizer") or {}
    plain = {"use_regex": True, "add_prefix_space": False}
    wrong = {
        "model": model.get("type") not in (None, "BPE"),
        "normalizer": parts.get("normalizer") is not None,
        "pre_tokenizer": pre.get("type") != "ByteLevel" or any(pre.get(k, v) != v for k, v in plain.items()),
        "decoder": (parts.get("decoder") or {}).get("type") != "ByteLevel",
        "dropout": bool(model.get("dropout")),
        "ignore_merges": bool(model.get("ignore_merges")),
        "affixes": bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        "added_tokens": any(t.get(k) for t in parts["added_tokens"] for k in ("lstrip", "rstrip", "single_word")),
    }
    if found := [k for k, v in wrong.items() if v]:
        raise ValueError(f"not a plain byte-level BPE: {', '.join(found)}")


@lru_cache(maxsize=1)
def loaded(path: str) -> Bpe:
    """One encoder for each Python worker: Spark gives a worker many tasks, and what it has met stays in its bounded tables."""
    return Bpe(path)


def with_bpe(df: DataFrame, path: str, f: Callable[[Bpe, pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 200) -> DataFrame:
    """mapInArrow in slices of `rows` rows, with one encoder for each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield f(bpe, batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def f(bpe: Bpe, part: pa.RecordBatch) -> pa.RecordBatch:
        ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
        sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(bpe.decode(x).encode() for x in ids)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    return with_bpe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), path, f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(df: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """df with the array<int> column `ids` (replaced if it is there) of the text column."""
    rest = df.drop(ids)
    schema = rest.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def f(bpe: Bpe, part: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int32) for t in part.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], [*part.schema.names, ids])

    return with_bpe(rest, path, f, schema)


def decode_column(df: DataFrame, ids: str, path: str, text: str = "text") -> DataFrame:
    """df with the string column `text` (replaced if it is there) of the array<int> column of ids; null ids give a null text."""
    rest = df.drop(text)
    schema = rest.withColumn(text, F.lit(None).cast("string")).schema

    def f(bpe: Bpe, part: pa.RecordBatch) -> pa.RecordBatch:
        found = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in part.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, text])

    return with_bpe(rest, path, f, schema)


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
