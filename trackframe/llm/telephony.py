"""Telephony audio: G.711 and IMA ADPCM columns, decoded with lookup tables and numpy across blocks.

``store`` keeps each payload of bytes as mu-law samples in a WAV file, one byte a sample and so without loss, in a column of a
Parquet table that it writes. ``load`` reads that table back: it takes the codes out of the file, expands them by both G.711
tables, decodes them as 64-byte ADPCM blocks too, and gives the audio resampled to 16 kHz PCM as a column beside digests and features.

Null text counts as empty; an empty payload becomes 64 zero bytes. Equal texts give equal values in every column
but ``doc_id``. Repeated rows stay; an empty table gives an empty one. A long text is taken whole, by itself. Columns other than the
key and the text are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackframe.llm.common import keyed, scratch, slices, text_bytes

BLOCK = 64
RATE = 8000
#: Bytes of payloads that a task handles at once.
SLICE = 2_000_000

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, step = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, step + 8, (step + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU, A = mu_law_table(), a_law_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """The change of the sample and the next state, by state (index times 16) plus code."""
    index, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(index + CHANGES[code], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -change, change).astype(np.int32), after.astype(np.int32)


CHANGE, AFTER = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 121) of IMA ADPCM blocks (n, 64): a 4-byte header, then two samples a byte, low half first."""
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.empty((2 * (BLOCK - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = sample
    for k, code in enumerate(codes, 1):
        key = state + code
        sample += CHANGE[key]
        np.clip(sample, -32768, 32767, out=sample)
        state = AFTER[key]
        out[k] = sample
    return out.T


def _half_band(taps: int = 8) -> np.ndarray:
    """Weights of the sample halfway between the inner two of ``taps`` samples: windowed sinc, sum 1."""
    at = np.arange(taps) - (taps - 1) / 2
    weights = np.sinc(at) * np.cos(np.pi * at / (taps + 1)) ** 2
    return weights / weights.sum()


HALF = _half_band()


def resample_16k(pcm: np.ndarray) -> np.ndarray:
    """Twice the samples: those given and, between them, interpolated ones."""
    edge = len(HALF) // 2
    wide = np.concatenate([np.zeros(edge - 1), pcm, np.zeros(edge)])
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(np.rint(np.correlate(wide, HALF, "valid")[: len(pcm)]), -32768, 32767)
    return out


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def to_wav(payload: bytes) -> bytes:
    """A WAV file whose samples are the payload's bytes as mu-law codes, 8 kHz, mono."""
    form = struct.pack("<HHIIHHH", 7, 1, RATE, RATE, 1, 8, 0)
    parts = b"WAVE" + b"".join(k + struct.pack("<I", len(x)) + x for k, x in ((b"fmt ", form), (b"fact", struct.pack("<I", len(payload))), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def from_wav(media: bytes) -> bytes:
    """The codes of such a file."""
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a mu-law WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = text_bytes(b, text)
            for i, j in slices(data, SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(x) for x in data[i:j]], pa.int64()), pa.array([to_wav(pad(x)) for x in data[i:j]], pa.binary())], [key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return keyed(docs, key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write what ``encode`` gives as a Parquet table to ``path`` (default: a new one in the shared folder), and return that table."""
    spark, encoded = docs.sparkSession, encode(docs, key, text)
    path = path or scratch(spark, "telephony")
    encoded.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(encoded.schema).parquet(path)


def _features(codes: list[bytes]) -> list[tuple[str, bytes]]:
    """A feature string and the 16 kHz PCM of each payload; ADPCM is decoded over all their blocks at once."""
    each = [np.frombuffer(x, np.uint8) for x in codes]
    adpcm = decode_adpcm(np.concatenate(each).reshape(-1, BLOCK))
    out, at = [], 0
    for c in each:
        n = len(c) // BLOCK
        mu, al, ad = MU[c], A[c], adpcm[at : at + n].reshape(-1)
        at += n
        pcm = resample_16k(mu)
        power = [int(np.dot(x.astype(np.float64), x) / len(x)) for x in (mu, al, ad)]
        zero = int(np.count_nonzero(np.signbit(mu[1:]) != np.signbit(mu[:-1])))
        raw = pcm.tobytes()
        out.append((f"mu={power[0]};a={power[1]};adpcm={power[2]}/{ad.size};zc={zero};peak={int(np.abs(mu.astype(np.int32)).max())};pcm16k={pcm.size}/{zlib.crc32(raw):08x}", raw))
    return out


def load(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read ``media`` back: digests of payload and file, features, and the resampled PCM (16-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm16k"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            size, files = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in slices(files, SLICE):
                codes = [from_wav(x) for x in files[i:j]]
                rows = [(n, len(c), hashlib.sha256(c).hexdigest(), zlib.crc32(c[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), *s) for n, c, f, s in zip(size[i:j], codes, files[i:j], _features(codes))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], [key, *names])

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm16k binary")
