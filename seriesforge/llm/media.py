"""Telephony audio columns.

mu-law and A-law bytes expand through 256-entry tables (ITU-T G.711), IMA ADPCM blocks are decoded by numpy with one lane
per block: all blocks of a batch advance together, one nibble at a time. PCM is resampled linearly, below the old rate
behind a running mean as wide as the step, rounded half up, and stored as little-endian 16-bit samples.

Nulls: a null text is an empty one, an empty payload decodes to no samples; a null file, and one without a RIFF/WAVE head, with a
head cut off, of another codec, without channels or with a sample rate of zero, decodes to null PCM and keeps its row. Of several
channels of G.711 the mean is taken; ADPCM of several channels gives null PCM. An ADPCM block that the file's end cuts off is left out.
An empty table gives an empty one, repeated rows give equal rows. Texts and files of any length are taken whole, `rows` of them at a
time. Extra columns, whatever their names, pass through decode_telephony and are not read elsewhere; one called like an output column is replaced.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import read_table, stored, text_or_empty

MU_LAW, A_LAW, IMA_ADPCM = 7, 6, 0x11
#: Fixed values of the IMA ADPCM format: how the step index moves by a nibble's magnitude.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - magnitude, magnitude - 0x84).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, value = (code & 0x70) >> 4, (code & 0x0F) << 4
    value = np.where(part == 0, value + 8, (value + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


def ima_steps() -> np.ndarray:
    # The 89 quantiser steps of the IMA ADPCM format.
    fixed = "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767"
    return np.array(fixed.split(), dtype=np.int32)


MU, A, STEPS = mu_law_table(), a_law_table(), ima_steps()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """uint8 of shape (blocks, size) to int16 of shape (blocks, 2 * (size - 4) + 1). Each block has a head: first sample, step index, a zero."""
    first = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    nibbles = (blocks.shape[1] - 4) * 2
    out = np.empty((nibbles + 1, len(blocks)), dtype=np.int16)  # a row for each step, so that a step writes in one place
    out[0] = value = first
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(nibbles):
        n = (body[k // 2] >> (4 * (k % 2))) & 0x0F
        step = STEPS[index]
        low = n & 7
        delta = ((2 * low + 1).astype(np.int32) * step) >> 3
        value = np.clip(np.where(n & 8, value - delta, value + delta), -32768, 32767)
        out[k + 1] = value
        index = np.clip(index + INDEX_MOVE[low], 0, 88)
    return out.T


def adpcm_encode(pcm: np.ndarray, size: int) -> bytes:
    """Blocks of `size` bytes; the last one is filled up by its last sample. For tests and for writers."""
    per = 2 * (size - 4) + 1
    if not len(pcm):
        return b""
    rows = np.concatenate([pcm, np.full(-len(pcm) % per, pcm[-1], dtype=pcm.dtype)]).reshape(-1, per).astype(np.int32)
    value, index = rows[:, 0].copy(), np.zeros(len(rows), dtype=np.int32)
    out = np.zeros((len(rows), size), dtype=np.uint8)
    out[:, :2] = rows[:, 0].astype("<i2").view(np.uint8).reshape(-1, 2)
    for k in range(1, per):
        gap, step = rows[:, k] - value, STEPS[index]
        low = np.minimum(np.abs(gap) * 4 // step, 7)
        delta = ((2 * low + 1) * step) >> 3
        value = np.clip(np.where(gap < 0, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + INDEX_MOVE[low], 0, 88)
        out[:, 4 + (k - 1) // 2] |= ((low | np.where(gap < 0, 8, 0)) << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def wave(payload: bytes, codec: int, rate: int, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file around coded samples."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if codec == IMA_ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", codec, 1, rate, rate, block, 4 if codec == IMA_ADPCM else 8) + extra
    fact = struct.pack("<4sII", b"fact", 4, len(payload))
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwave(media: bytes | None) -> tuple[int, int, int, int, bytes] | None:
    """Codec, channels, rate, block size and payload; None if it isn't such a file."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        tag, n = struct.unpack_from("<4sI", media, at)
        if tag == b"fmt " and n >= 16 and at + 24 <= len(media):
            codec, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            form = codec, channels, rate, block
        if tag == b"data" and form:
            return (*form, media[at + 8 : at + 8 + n]) if form[1] and form[2] else None
        at += 8 + n + (n & 1)
    return None


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """As many samples as fit in the same time, each the straight line between its neighbours, rounded half up."""
    n = len(pcm) * to // rate
    if not n or rate == to:
        return pcm[:n].astype("<i2")
    x = pcm.astype(np.int64)
    wide = -(-rate // to)
    if wide > 1:  # a mean over one step of the new rate, so that what it cannot hold does not fold back
        sums = np.concatenate([[0], np.cumsum(np.concatenate([x, np.full(wide - 1, x[-1])]))])
        x = (sums[wide:] - sums[:-wide]) / wide
    place = np.arange(n, dtype=np.int64) * rate
    at, rest = place // to, place % to
    ahead = x[np.minimum(at + 1, len(x) - 1)]
    return np.floor((x[at] * (to - rest) + ahead * rest) / to + 0.5).clip(-32768, 32767).astype("<i2")


def decode_batch(found: list) -> list[np.ndarray | None]:
    """PCM of each parsed file. ADPCM blocks of equal size are decoded together, whichever file they come from."""
    out: list[np.ndarray | None] = [None] * len(found)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(found):
        if x is None:
            continue
        codec, channels, _, block, payload = x
        if codec in (MU_LAW, A_LAW):
            pcm = (MU if codec == MU_LAW else A)[np.frombuffer(payload[: len(payload) // channels * channels], np.uint8)]
            out[i] = pcm if channels == 1 else np.floor(pcm.reshape(-1, channels).mean(axis=1) + 0.5).astype(np.int16)
        elif codec == IMA_ADPCM and block > 4 and channels == 1:
            groups.setdefault(block, []).append(i)
    for block, members in groups.items():
        whole = [len(found[i][4]) // block for i in members]
        joined = b"".join(found[i][4][: n * block] for i, n in zip(members, whole))
        pcm = adpcm_blocks(np.frombuffer(joined, np.uint8).reshape(-1, block))
        for i, piece in zip(members, np.split(pcm, np.cumsum(whole)[:-1])):
            out[i] = piece.ravel()
    return out


def decode_telephony(df: DataFrame, media: str, rate: int = 16000, pcm: str = "pcm", rows: int = 256) -> DataFrame:
    """Adds the binary column `pcm`: the file in column `media` as 16-bit samples at `rate`; null where it can't be read."""
    rest = df.drop(pcm)
    schema = rest.withColumn(pcm, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = [unwave(x) for x in part.column(media).to_pylist()]
                done = [None if p is None else resample(p, x[2], rate).tobytes() for x, p in zip(found, decode_batch(found))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], [*part.schema.names, pcm])

    return rest.mapInArrow(run, schema)


def codec_of(payload: bytes) -> tuple[int, int]:
    """Codec and block size by the payload's checksum: a third of all payloads each."""
    return ((MU_LAW, 1), (A_LAW, 1), (IMA_ADPCM, 64))[zlib.crc32(payload) % 3]


def encode_media(docs: DataFrame, codec: int | None = None, rate: int = 16000, rows: int = 256) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled up by zeros to a positive multiple of 64, as the samples (8-bit codes, or ADPCM
    blocks of 64 bytes) of a WAVE file. Without a codec the payload's checksum chooses one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                raw = part.column("text").cast(pa.binary()).to_pylist()
                filled = [x + bytes(-len(x) % 64 or (0 if x else 64)) for x in raw]
                kinds = [codec_of(x) if codec is None else (codec, 64 if codec == IMA_ADPCM else 1) for x in filled]
                files = [wave(x, c, rate, block) for x, (c, block) in zip(filled, kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def sound(pcm: bytes | None) -> str:
    """Samples, mean power, peak and sign changes of 16-bit PCM, and its checksum."""
    if pcm is None:
        return "none"
    s = np.frombuffer(pcm, "<i2")
    wide, sign = s.astype(np.int64), s < 0
    power, peak = int(np.dot(wide, wide)) // max(1, len(s)), int(np.abs(wide).max(initial=0))
    return f"n={len(s)};power={power};peak={peak};turns={int(np.count_nonzero(sign[1:] != sign[:-1]))};pcm={zlib.crc32(pcm):08x}"


def media_digests(df: DataFrame, rows: int = 256) -> DataFrame:
    """Adds digests of the file in `media` and of the payload in it, and `form`, its codec and rate. A file that can't be read has null
    payload fields."""
    codecs = {MU_LAW: "mulaw", A_LAW: "alaw", IMA_ADPCM: "adpcm"}
    new = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "form": "string"}
    rest = df.drop(*new)
    schema = rest.select("*", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out: dict[str, list] = {k: [] for k in new}
                for file in part.column("media").to_pylist():
                    x = unwave(file)
                    payload = x and x[4]
                    out["payload_bytes"].append(None if x is None else len(payload))
                    out["payload_sha256"].append(None if x is None else hashlib.sha256(payload).hexdigest())
                    out["tail_crc32"].append(None if x is None else zlib.crc32(payload[-64:]))
                    out["media_bytes"].append(None if file is None else len(file))
                    out["media_sha256"].append(None if file is None else hashlib.sha256(file).hexdigest())
                    out["form"].append("none;" if x is None else f"{codecs.get(x[0], 'other')};rate={x[2]}")
                columns = [pa.array(v, pa.int64() if new[k] == "long" else pa.string()) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *new])

    return rest.mapInArrow(run, schema)


def sound_features(df: DataFrame, rows: int = 256) -> DataFrame:
    """`pcm` and `form` become `feature`."""
    rest = df.drop("feature")
    names = [c for c in rest.columns if c not in ("pcm", "form")]
    schema = rest.select(*names, F.lit(None).cast("string").alias("feature")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = [f"{form};{sound(pcm)}" for form, pcm in zip(part.column("form").to_pylist(), part.column("pcm").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(found, pa.string())], [*names, "feature"])

    return rest.mapInArrow(run, schema)


def media_features(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of `media` and the feature of `pcm`."""
    return sound_features(media_digests(df.select("doc_id", "n_bytes", "media", "pcm")).drop("media"))


def op2_media_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a telephony file in a stored table; read back, digested, decoded and resampled to 8000 samples a second; the PCM
    in a stored table beside the digests, read back for its features."""
    small = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20)}
    media = stored(encode_media(read_table(spark, sf_dir, "documents")), "media", small)
    return sound_features(stored(decode_telephony(media_digests(media), "media", 8000).drop("media"), "pcm", small))
