import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesforge.llm import bpe as B
from seriesforge.llm import media as M
from seriesforge.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_ids_match_the_library(messy, library):
    found = sorted(repr(tuple(r)) for r in B.encode_documents(messy, PATH).collect())
    want = []
    for r in messy.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append(repr((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert found == sorted(want)


def test_columns_round_trip(messy):
    coded = B.encode_column(messy, "text", PATH)
    assert coded.schema["ids"].dataType.simpleString() == "array<int>" and set(coded.columns) == set(messy.columns)
    back = B.decode_column(coded.drop("text"), "ids", PATH)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in back.collect())) == sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in messy.collect()))


def test_cuts_and_heap_agree(library):
    bpe = B.Bpe(PATH)
    for word in ("antidisestablishmentarianism" * 4, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "ñandúñandú" * 5, "=" * 70):
        ids = np.frombuffer(bpe.word(word), "<u4").tolist()
        assert ids == library.encode(word, add_special_tokens=False).ids
        assert b"".join(bpe.cuts(word.encode())) == word.encode()


def test_words_of_odd_characters(library):
    """Characters that the two word patterns class differently: superscripts, fractions, numerals, separators, new letters."""
    import regex

    bpe = B.Bpe(PATH)
    texts = ["x²y½ ³ Ⅷ ⅳa ①②", "a\x1cb\x1d c\x1e\x1f", "٣٤ ४५ 〇五", "naïve_façade __ _1_ a_b", "\u0958\u00a0\u2003 \u3000x", "it's we'll I'M 'tis ' d", "e\u0301 \u200d\u200b🙂🏽", "ªº ʰʱ ௧௨ \u0345", "  \n\n  a \t b  "]
    for t in texts:
        assert bpe.words(t) == regex.findall(B.WORDS, t)
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"ignore_merges": True}}, {"added_tokens": {"lstrip": True}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    import json

    parts = json.load(open(PATH, encoding="utf-8"))
    (key, value), = change.items()
    if key == "added_tokens":
        parts[key][0] |= value
    else:
        parts[key] = (parts[key] or {}) | value if key == "model" else value
    (tmp_path / "t.json").write_text(json.dumps(parts))
    with pytest.raises(ValueError, match=key if key != "model" else "ignore_merges"):
        B.Bpe(str(tmp_path / "t.json"))


def test_no_documents(empty):
    assert B.encode_documents(empty, PATH).count() == 0


def test_media_of_no_documents(empty):
    assert M.media_features(M.decode_telephony(M.encode_media(empty), "media", 8000)).count() == 0


def test_rollup_query_on_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert T.op1_token_rollup(spark, str(tmp_path)).count() == 0


def test_media_fields(messy):
    rows = M.media_features(M.decode_telephony(M.encode_media(messy), "media", 8000)).collect()
    assert len(rows) == messy.count()
    texts = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in messy.collect()}
    for r in rows:
        raw = texts[(r.doc_id, r.n_bytes)]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + (60 if r.feature.startswith("adpcm") else 58)


def test_tables_of_g711():
    assert M.MU[0xFF] == 0 and M.MU[0x80] == 32124 and M.MU[0x00] == -32124
    assert M.A[0xD5] == 8 and M.A[0x55] == -8 and M.A[0xAA] == 32256 and M.A[0x2A] == -32256


def slow_g711(code, law):
    """By the segments of the recommendation: sign, three bits of the segment, four of the step."""
    if law == "mu":
        code ^= 0xFF
        sign, segment, step = code >> 7, code >> 4 & 7, code & 15
        value = (2 * step + 33) * 2**segment - 33
        return -4 * value if sign else 4 * value
    code ^= 0x55
    sign, segment, step = code >> 7, code >> 4 & 7, code & 15
    value = 2 * step + 1 if segment == 0 else (2 * step + 33) * 2 ** (segment - 1)
    return 8 * value if sign else -8 * value


def test_all_codes_of_g711():
    assert M.MU.tolist() == [slow_g711(c, "mu") for c in range(256)] and M.A.tolist() == [slow_g711(c, "a") for c in range(256)]


def slow_resample(pcm, rate, to):
    from fractions import Fraction as Q
    from math import floor

    wide = -(-rate // to)
    x = [Q(sum(pcm[min(i + k, len(pcm) - 1)] for k in range(wide)), wide) for i in range(len(pcm))]
    out = []
    for i in range(len(pcm) * to // rate):
        at = Q(i * rate, to)
        a, b = x[floor(at)], x[min(floor(at) + 1, len(x) - 1)]
        out.append(floor(a + (b - a) * (at - floor(at)) + Q(1, 2)))
    return out


def test_resampling():
    rng = np.random.default_rng(3)
    pcm = rng.integers(-32768, 32768, 97).astype(np.int16)
    for rate, to in ((8000, 16000), (16000, 8000), (8000, 11025), (8000, 8000), (44100, 8000), (8000, 24000)):
        got, want = M.resample(pcm, rate, to).tolist(), slow_resample(pcm.tolist(), rate, to)
        assert len(got) == len(want) and max(abs(a - b) for a, b in zip(got, want)) <= (0 if rate in (8000, 16000) and to != 11025 else 1)


def test_media_query_by_brute_force(spark, fixture_dir):
    rows = {(r.doc_id, r.payload_sha256): r for r in M.op2_media_telephony(spark, fixture_dir).collect()}
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()
    codecs = set()
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[(d.doc_id, hashlib.sha256(payload).hexdigest())]
        kind = zlib.crc32(payload) % 3
        if kind == 2:
            pcm = [x for k in range(0, len(payload), 64) for x in slow_adpcm(payload[k : k + 64])]
        else:
            pcm = [slow_g711(c, "mu" if kind == 0 else "a") for c in payload]
        s = slow_resample(pcm, 16000, 8000)
        turns = sum((a < 0) != (b < 0) for a, b in zip(s, s[1:]))
        feature = f"{['mulaw', 'alaw', 'adpcm'][kind]};rate=16000;n={len(s)};power={sum(x * x for x in s) // len(s)};peak={max(map(abs, s))};turns={turns};pcm={zlib.crc32(np.array(s, '<i2').tobytes()):08x}"
        media = M.wave(payload, [M.MU_LAW, M.A_LAW, M.IMA_ADPCM][kind], 16000, [1, 1, 64][kind])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        codecs.add(kind)
    assert len(rows) <= len(docs) and codecs == {0, 1, 2}


def test_malformed_media(spark):
    import struct

    good = M.wave(bytes(range(128)), M.MU_LAW, 8000)
    stereo = good[:22] + struct.pack("<H", 2) + good[24:]
    rows = [(1, good[:30]), (2, good[:24] + bytes(4) + good[28:]), (3, good[:22] + bytes(2) + good[24:]), (4, stereo), (5, good[:-100]), (6, None), (7, M.wave(bytes(100), M.IMA_ADPCM, 8000, 64)), (8, good[:20])]
    df = spark.createDataFrame(rows, "id long, media binary")
    got = {r.id: r.pcm for r in M.decode_telephony(df, "media", 8000).collect()}
    assert [i for i in got if got[i] is None] == [1, 2, 3, 6, 8]
    pairs = M.MU[:128].astype(int).reshape(-1, 2)
    assert np.frombuffer(got[4], "<i2").tolist() == np.floor(pairs.mean(axis=1) + 0.5).tolist()
    assert len(got[5]) == 2 * 28 and len(got[7]) == 2 * 121  # the second block is not whole
    features = {r.doc_id: r for r in M.media_features(M.decode_telephony(df.selectExpr("id as doc_id", "id as n_bytes", "media"), "media")).collect()}
    assert len(features) == 8 and features[6].feature == "none;;none" and features[6].media_bytes is None and features[4].payload_bytes == 128


def slow_adpcm(block: bytes) -> list[int]:
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(M.STEPS[index])
            delta = ((2 * (n & 7) + 1) * step) >> 3
            value = max(-32768, min(32767, value - delta if n & 8 else value + delta))
            index = max(0, min(88, index + int(M.INDEX_MOVE[n & 7])))
            out.append(value)
    return out


def test_adpcm_blocks():
    rng = np.random.default_rng(7)
    blocks = rng.integers(0, 256, (30, 64)).astype(np.uint8)
    assert M.adpcm_blocks(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]
    tone = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    back = M.adpcm_blocks(np.frombuffer(M.adpcm_encode(tone, 256), np.uint8).reshape(-1, 256)).ravel()[: len(tone)]
    assert np.abs(back.astype(int) - tone)[200:].mean() < 300


def test_decoding_keeps_every_row(spark):
    payload = bytes(range(256))
    rows = [(1, M.wave(payload, M.MU_LAW, 8000), "a"), (2, M.wave(payload, M.A_LAW, 8000), "b"), (3, M.wave(payload, M.IMA_ADPCM, 8000, 64), "c"), (4, None, "d"), (5, b"junk", "e"), (6, M.wave(b"", M.MU_LAW, 8000), "f"), (7, M.wave(payload, 1, 8000), "g")]
    df = spark.createDataFrame(rows, "id long, media binary, pcm string")
    got = {r.id: r.pcm for r in M.decode_telephony(df, "media", 16000).collect()}
    assert len(got) == 7 and got[4] is None and got[5] is None and got[7] is None and bytes(got[6]) == b""
    assert np.frombuffer(got[1], "<i2")[::2].tolist() == M.MU.tolist() and np.frombuffer(got[2], "<i2")[::2].tolist() == M.A.tolist()
    assert len(got[3]) == 2 * 2 * 4 * (2 * 60 + 1)


def test_rollup_is_the_sum_of_what_is_left(spark, tmp_path):
    words = {"w": None}
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "mail me@x.org now", "en", "s"), (3, None, None, None), (4, "gone gone", "de", "t"), (4, "gone gone", "de", "t"), (5, "", "de", "t")], "doc_id long, text string, lang string, source string")
    gone = spark.createDataFrame([(4,), (None,)], "doc_id long")
    feed = T.change_feed(docs, gone, words)
    r = T.Rollup(spark, str(tmp_path / "r"))
    for batch in ("purge", "load", "mask"):
        assert r.commit(batch, T.signed_deltas(feed.where(f"batch = '{batch}'")))
    assert not r.commit("load", T.signed_deltas(feed.where("batch = 'load'")))
    assert sorted(map(repr, (tuple(x) for x in r.totals().collect()))) == sorted(map(repr, [("s", "en", "w", 2, 6), (None, None, "w", 1, 0), ("t", "de", "w", 1, 0)]))


def test_half_written_batch_is_written_anew(spark, tmp_path):
    d = spark.createDataFrame([("s", "en", "w", None, 3)], "source string, lang string, tokenizer string, n_before long, n_after long")
    r = T.Rollup(spark, str(tmp_path / "r"))
    (tmp_path / "r" / "batch=b").mkdir(parents=True)
    assert r.commit("b", T.signed_deltas(d)) and [tuple(x) for x in r.totals().collect()] == [("s", "en", "w", 1, 3)]


def test_readers_see_whole_batches_only(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, n_before long, n_after long"
    d = T.signed_deltas(spark.createDataFrame([("s", "en", "w", None, 3)], schema))
    r = T.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0 and r.batches() == []
    assert r.commit("a", d)
    # What another writer left half-way, with files but without the marker.
    d.withColumn("docs", d.docs * 100).write.parquet(str(tmp_path / "r" / "batch=b"))
    (tmp_path / "r" / "batch=b" / "_SUCCESS").unlink()
    assert r.batches() == ["a"] and [tuple(x) for x in r.totals().collect()] == [("s", "en", "w", 1, 3)]
    assert r.commit("b", d) and r.batches() == ["a", "b"] and [tuple(x) for x in r.totals().collect()] == [("s", "en", "w", 2, 6)]
    assert not r.commit("b", d) and not [x for x in (tmp_path / "r").rglob("_draft-*")]


def test_two_streams_and_a_replay(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, n_before long, n_after long"
    r = T.Rollup(spark, str(tmp_path / "r"))
    for name in ("first", "second"):
        spark.createDataFrame([("s", "en", "w", None, 3), ("s", "en", "w", 3, 5), ("s", "de", "w", 4, None)], schema).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        start = lambda: stream.writeStream.foreachBatch(r.foreach_batch(name)).option("checkpointLocation", str(tmp_path / f"log-{name}")).trigger(availableNow=True).start().awaitTermination()  # noqa: B023, E731
        start()
        start()
    r.foreach_batch("first")(spark.createDataFrame([("s", "en", "w", None, 3)], schema), 0)  # replayed
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "w", 2, 10), ("s", "de", "w", -2, -8)}


def test_rollup_query_by_brute_force(spark, fixture_dir, library):
    import re

    toxic = {r.doc_id for r in spark.read.parquet(f"{fixture_dir}/labels.parquet").collect() if r.toxic == 1}
    want: dict = {}
    for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect():
        if r.doc_id is not None and r.doc_id in toxic:
            continue
        text = re.sub(T.EMAIL, "<EMAIL>", r.text or "")
        plain = text.replace("<|endoftext|>", "<|endoftext |>")  # the rollup counts special tokens as ordinary text
        ids = len(library.encode(plain, add_special_tokens=False).ids) if plain == text else None
        for t, n in (("byte_bpe_50k", ids), ("words_1", len(text.encode().split()))):
            k = (r.source, r.lang, t)
            docs, tokens, known = want.get(k, (0, 0, True))
            want[k] = docs + 1, tokens + (n or 0), known and n is not None
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in T.op1_token_rollup(spark, fixture_dir).collect()}
    assert set(got) == set(want)
    for k, (docs, tokens, known) in want.items():
        assert got[k][0] == docs and (got[k][1] == tokens if known else got[k][1] > tokens)


def test_bpe_counts(messy, library):
    paths = {"byte": public_tokenizers.path("byte_bpe_50k.tiktoken"), "words": None}
    got = T.count_tokens(messy.select("doc_id", "text").where("text is not null and text not like '%endoftext%'"), {"text": "n"}, paths).collect()
    for r in got:
        assert r.n_byte == len(library.encode(r.text, add_special_tokens=False).ids) and r.n_words == len([w for w in r.text.encode().split()])
