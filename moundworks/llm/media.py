"""Operator 9: media columns. Payloads are stored as WAV bytes, read by the wave module, and fingerprinted.

``encode_media`` writes each payload (the text's UTF-8, filled with zero bytes to a positive multiple of BLOCK) as mono
8-bit samples into a binary column, losslessly. ``read_media`` reads the stored bytes back and takes a short-time Fourier
transform (Hann frames of FRAME samples, a hop of BLOCK); in each frame the strongest bin is a peak if no neighbouring
frame is stronger; each peak is paired with the next FAN peaks within REACH frames, and a pair (bin, bin, distance) is a
code at the time of its first peak: two arrays, ``time`` and ``code``.

Defined cases: null text is empty, one block of zeros; silence has no peaks, so empty arrays; stored bytes that are no
8-bit mono WAV raise; null media gives null columns; repeated rows give equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

BLOCK, FRAME, RATE = 64, 128, 8000
FAN, REACH = 2, 16
#: Frames transformed at once: bounds a long text's memory.
CHUNK = 4096

READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, time array<int>, code array<int>"


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit")
        return w.readframes(w.getnframes())


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - np.float32(128)
    samples = np.concatenate([samples, np.zeros(FRAME - BLOCK, dtype=np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::BLOCK]
    hann = np.hanning(FRAME).astype(np.float32)
    bins, power = [], []
    for start in range(0, len(frames), CHUNK):
        part = frames[start : start + CHUNK]
        spectrum = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * hann, axis=1))[:, 1:]
        best = spectrum.argmax(axis=1)
        bins.append(best)
        power.append(np.round(spectrum[np.arange(len(best)), best], 2))
    bin_, strong = np.concatenate(bins), np.concatenate(power)
    around = np.r_[-1.0, strong, -1.0]
    at = np.flatnonzero((strong > 0) & (strong >= around[:-2]) & (strong >= around[2:]))
    return at, bin_[at]


def pair_codes(at: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of the pairs, by time and distance."""
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = at[k:] - at[:-k]
        near = gap <= REACH
        times.append(at[:-k][near])
        codes.append((bins[:-k][near] << 16 | bins[k:][near] << 8 | gap[near]))
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raws = [raw or b"" for raw in as_bytes(batch, "text")]
            media = [to_wav(padded(raw)) for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """The columns of READ from doc_id, n_bytes and media."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = [c.split()[0] for c in READ.split(", ")]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 7
        payload = from_wav(media)
        time, code = pair_codes(*peaks(payload))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), time, code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = list(zip(*map(one, batch.column("media").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def described(docs: DataFrame) -> DataFrame:
    """The stored form of each text read back: its pairs as time-coded arrays, and digested into ``feature``."""
    read = read_media(encode_media(docs))
    feature = F.concat(F.size("code").cast("string"), F.lit(":"), F.lower(F.hex(F.xxhash64("time", "code"))))
    return read.withColumn("feature", feature)
