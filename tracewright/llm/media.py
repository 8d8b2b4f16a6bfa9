"""Media columns: texts stored losslessly as 8-bit WAV, read back by the wave module, with spectral-peak pair fingerprints.

The payload of a text is its UTF-8 bytes, zero-padded to a positive multiple of 64; each byte is one mono sample. Features
come from the bytes that were read back: a short-time Fourier transform (Hann window of 512, hop 256), the two strongest
local maxima of each frame, and pairs of each peak with the strongest peaks of the next two frames. A pair is one 64-bit
number: frame << 20 | first bin << 11 | second bin << 2 | frame distance, so the array is coded by time.

Defined cases: a null or empty text has a payload of 64 zero bytes, one frame and no peaks; equal texts have equal values;
repeated rows each get their own row; very long texts are transformed in blocks of frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import shared

RATE, FRAME, HOP, PEAKS, REACH = 8000, 512, 256, 2, 2
_WINDOW = np.hanning(FRAME).astype(np.float32)
_BLOCK = 2048


def payload_of(data: bytes) -> bytes:
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peak_bins(samples: np.ndarray) -> np.ndarray:
    """The strongest local maxima of each frame's spectrum, strongest first; 0 where there is none."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.full((n - 1) * HOP + FRAME, 128, dtype=np.uint8)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    found = np.zeros((n, PEAKS), dtype=np.int64)
    for at in range(0, n, _BLOCK):
        block = frames[at : at + _BLOCK].astype(np.float32)
        block -= block.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(block * _WINDOW, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-3), inner, 0)
        for k in range(PEAKS):
            best = inner.argmax(axis=1)
            rows = np.arange(len(best))
            found[at : at + _BLOCK, k] = np.where(inner[rows, best] > 0, best + 1, 0)
            inner[rows, best] = 0
    return found


def pair_codes(bins: np.ndarray) -> np.ndarray:
    """Time-coded pairs of each frame's peaks with the strongest peak of the following frames, in time order."""
    n = len(bins)
    codes = []
    for k in range(bins.shape[1]):
        for d in range(1, REACH + 1):
            if n > d:
                a, b = bins[:-d, k], bins[d:, 0]
                code = np.arange(n - d, dtype=np.int64) << 20 | a << 11 | b << 2 | d
                codes.append(code[(a > 0) & (b > 0)])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_pairs array<long>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in _OUT.split(", ")]
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            out = []
            for key, text in zip(*(c.to_pylist() for c in whole.slice(at, 1000).columns)):
                data = (text or "").encode()
                media = to_wav(payload_of(data))
                back = from_wav(media)
                bins = peak_bins(np.frombuffer(back, dtype=np.uint8))
                codes = pair_codes(bins)
                feature = f"{len(bins)}:{len(codes)}:{hashlib.md5(codes.astype('<i8').tobytes(), usedforsecurity=False).hexdigest()}"
                out.append((key, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, codes))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: checks of payload and media, and the peak pairs of the samples read back. No shuffle."""
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_rows, _OUT)


_STORED = "doc_id long, media binary"


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The media bytes themselves, for a sink."""

    def rows(batches):
        for b in batches:
            keys, texts = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([to_wav(payload_of((t or "").encode())) for t in texts], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(rows, _STORED)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(shared.table(spark, sf_dir, "documents"))
