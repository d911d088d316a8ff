"""Media columns: telephony audio.

mu-law and A-law codes are expanded through 256-entry lookup tables, IMA ADPCM is decoded with one
numpy step per sample position over all blocks at once, and 16-bit PCM, resampled to twice the rate, is
stored. PCM is stored without loss as its even samples and what the odd ones differ from the half-band
filter's prediction, which is nothing where that filter made them, so the storage compresses it well.

Edge cases: null text is empty; an empty payload still holds one unit of zeros; a null file gives a null
row of PCM; rows are described one by one, so repeated rows are answered alike and a very long text costs
memory for itself alone; a table without rows gives a table without rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared, textkit

UNIT = 64
RATE = 8000
#: Bytes of a row group of stored files, and how hard they are compressed.
BLOCK, LEVEL = 32 << 20, 9
PCM, ALAW, MULAW, IMA = 0x0001, 0x0006, 0x0007, 0x0011


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()

# Fixed values of the IMA ADPCM format: step sizes and the index change of each nibble.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
], dtype=np.int32)
IMA_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: (n, bytes a block) codes to (n, samples a block) 16-bit samples.

    A block's header is a 16-bit predictor, a step index (held to 0..88) and a spare byte.
    """
    blocks = np.ascontiguousarray(blocks, dtype=np.uint8)
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    codes = blocks[:, 4:].T
    for k in range(1, len(out)):
        nibble = (codes[(k - 1) >> 1] >> (4 * ((k - 1) & 1))) & 0x0F
        size = (nibble & 7).astype(np.int32)
        step = IMA_STEPS[index]
        change = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * ((size >> 1) & 1) + step * (size >> 2)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_CHANGE[size], 0, 88)
        out[k] = value
    return out.T


_TAPS = 8


def _half_band() -> np.ndarray:
    """Odd-phase taps of a windowed-sinc filter that doubles the rate; they sum to 1."""
    t = np.arange(-_TAPS, _TAPS) + 0.5
    taps = np.sinc(t) * np.hanning(2 * _TAPS + 2)[1:-1]
    return taps / taps.sum()


HALF_BAND = _half_band()


def _between(samples: np.ndarray) -> np.ndarray:
    """What the half-band filter makes of the places after each sample."""
    made = np.convolve(np.pad(samples.astype(np.float64), (_TAPS - 1, _TAPS)), HALF_BAND[::-1], "valid")
    return np.clip(np.rint(made), -32768, 32767).astype(np.int16)


def resample_double(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: given samples stay, those between come from a half-band filter."""
    out = np.empty(2 * len(samples), dtype=np.int16)
    out[::2], out[1::2] = samples, _between(samples)
    return out


def pack_pcm(samples: np.ndarray) -> tuple[bytes, bytes | None]:
    """(even samples, odd ones less their prediction) of 16-bit PCM; None if each odd one is as predicted."""
    even, odd = samples[::2].astype("<i2"), samples[1::2].astype("<i2")
    rest = odd - _between(even)[: len(odd)] if len(odd) else odd
    return even.tobytes(), None if len(odd) == len(even) and not rest.any() else rest.astype("<i2").tobytes()


def unpack_pcm(even: bytes, rest: bytes | None) -> np.ndarray:
    even = np.frombuffer(even, "<i2")
    between = _between(even) if len(even) else even
    odd = between if rest is None else np.frombuffer(rest, "<i2") + between[: len(rest) // 2]
    out = np.empty(len(even) + len(odd), dtype=np.int16)
    out[::2], out[1::2] = even, odd
    return out


def write_wav(data: bytes, tag: int, rate: int, bits: int, n_samples: int) -> bytes:
    """A mono RIFF/WAVE file; the fact chunk holds n_samples."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * max(bits, 8) // 8, max(bits // 8, 1), bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n_samples)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> dict:
    """tag, rate, bits, n_samples (of the fact chunk) and the data chunk of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    out, at = {}, 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            out["tag"], _, out["rate"], _, _, out["bits"] = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"fact":
            out["n_samples"] = struct.unpack_from("<I", media, at + 8)[0]
        elif name == b"data":
            out["data"] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out


def decode_wav(media: bytes, block: int = UNIT) -> np.ndarray:
    """16-bit samples of a mono mu-law, A-law, IMA ADPCM (blocks of `block` bytes) or PCM file."""
    wav = read_wav(media)
    raw = np.frombuffer(wav["data"], dtype=np.uint8)
    if wav["tag"] == MULAW:
        return MULAW_TABLE[raw]
    if wav["tag"] == ALAW:
        return ALAW_TABLE[raw]
    if wav["tag"] == IMA:
        return decode_ima(raw[: len(raw) // block * block].reshape(-1, block)).reshape(-1)
    if wav["tag"] == PCM and wav["bits"] == 16:
        return raw.view("<i2")
    raise ValueError(f"format {wav['tag']} is not supported")


def text_payload(text: bytes) -> bytes:
    """The text's bytes with zeros up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's payload as the 8-bit mu-law samples of a WAV file."""

    def run(batches):
        for batch in textkit.chunks(batches, "text", 8 << 20):
            data, offsets = textkit.string_buffers(batch.column(1))
            media = [write_wav(text_payload(t := data[a:b].tobytes()), MULAW, RATE, 8, len(t)) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], schema=_MEDIA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_STORED = ", even binary, rest binary"


def _measure(x: np.ndarray) -> str:
    x = x.astype(np.int64)
    return f"peak={np.abs(x).max()},energy={(x * x).sum()},crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))}"


def _pieces(batch: pa.RecordBatch, column: int, most: int = 2 << 20):
    """Slices of about `most` bytes of a binary column, of one row at least."""
    size = np.array([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()])
    reach, at = np.cumsum(size), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _batch(rows: list[tuple], schema: str, ids: pa.Array) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    cells = zip(*rows) if rows else [()] * (len(fields) - 1)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, kinds[k]) for c, (_, k) in zip(cells, fields[1:]))], names=[n for n, _ in fields])


def decode(media: DataFrame) -> DataFrame:
    """Read stored mu-law files back: payload digests, features of the samples, and the 16 kHz PCM, packed.

    The feature holds peak, energy and zero crossings of the codes taken as mu-law and as A-law
    samples and as IMA ADPCM blocks of UNIT bytes.
    """

    def run(batches):
        for batch in batches:
            for part in _pieces(batch, 1):
                files = part.column(1).to_pylist()
                wavs = [read_wav(f) for f in files]
                raw = np.frombuffer(b"".join(w["data"] for w in wavs), dtype=np.uint8)
                bounds = np.cumsum([0, *(len(w["data"]) // UNIT for w in wavs)])
                blocks = raw.reshape(-1, UNIT)
                ima = decode_ima(blocks)
                rows = []
                for i, (f, w) in enumerate(zip(files, wavs)):
                    payload, codes = w["data"], blocks[bounds[i] : bounds[i + 1]].reshape(-1)
                    linear = MULAW_TABLE[codes]
                    feature = f"mulaw:{_measure(linear)};alaw:{_measure(ALAW_TABLE[codes])};ima:{_measure(ima[bounds[i] : bounds[i + 1]].reshape(-1))}"
                    rows.append((w["n_samples"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), feature, *pack_pcm(resample_double(linear))))
                yield _batch(rows, _FEATURES + _STORED, part.column(0))

    return media.select("doc_id", "media").mapInArrow(run, _FEATURES + _STORED)


def pcm_file(samples: np.ndarray) -> bytes:
    """A 16-bit PCM file of 16 kHz samples."""
    return write_wav(samples.astype("<i2").tobytes(), PCM, 2 * RATE, 16, len(samples))


def store_pcm(media: DataFrame, path: str) -> None:
    """Store the media column decoded and resampled to 16 kHz PCM as Parquet (doc_id, even, rest).

    media: any of the supported WAV formats at 8 kHz; a null file gives a null row.
    """

    def run(batches):
        for batch in batches:
            for part in _pieces(batch, 1):
                pcm = [(None, None) if f is None else pack_pcm(resample_double(decode_wav(f))) for f in part.column(1).to_pylist()]
                yield _batch(pcm, "doc_id long" + _STORED, part.column(0))

    rows = media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long" + _STORED)
    rows.write.options(**shared.parquet_options(BLOCK, LEVEL)).parquet(path)


def read_pcm(stored: DataFrame) -> DataFrame:
    """The columns of stored rows but even and rest, then pcm_bytes and pcm_sha256 of the 16 kHz files."""
    names = [c for c in stored.columns if c not in ("even", "rest")]
    schema = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in names) + ", pcm_bytes long, pcm_sha256 string"

    def run(batches):
        for batch in batches:
            for part in _pieces(batch, 0):
                files = [None if e is None else pcm_file(unpack_pcm(e, r)) for e, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                sizes = pa.array([None if f is None else len(f) for f in files], pa.int64())
                prints = pa.array([None if f is None else hashlib.sha256(f).hexdigest() for f in files], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[2:], sizes, prints], names=[*names, "pcm_bytes", "pcm_sha256"])

    return stored.select("even", "rest", *names).mapInArrow(run, schema)


def telephony_digest(docs: DataFrame) -> DataFrame:
    """Store every text as telephony audio in shared storage, read it back, describe it, and store it
    resampled as PCM, which is read back too."""
    media, _ = shared.store(encode(docs), "telephony", BLOCK, LEVEL)
    pcm, _ = shared.store(decode(media), "telephony-pcm", BLOCK, LEVEL)
    return read_pcm(pcm)
