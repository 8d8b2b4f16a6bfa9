"""Byte payloads of streams: base-128 integers, length-prefixed strings, flag bits. Arrow UDFs over whole streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def varints(values: np.ndarray) -> bytes:
    """Non-negative integers in little-endian groups of seven bits."""
    v = np.asarray(values, dtype=np.uint64)
    if not len(v):
        return b""
    groups = v[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))  # at most ten groups of seven bits
    n = np.maximum(1, (groups > 0).sum(axis=1))
    place = np.arange(10)
    out = (groups & np.uint64(127)).astype(np.uint8) | np.where(place < n[:, None] - 1, 128, 0).astype(np.uint8)
    return out[place < n[:, None]].tobytes()


def unvarints(payload: bytes) -> np.ndarray:
    raw = np.frombuffer(payload, dtype=np.uint8)
    if len(raw) and raw[-1] & 128:
        raise ValueError("the payload ends within a number")
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts).astype(np.int64) if len(starts) else np.zeros(0, np.int64)


def strings(values: list[str]) -> bytes:
    out = bytearray()
    for v in values:
        raw = v.encode()
        out += varints(np.array([len(raw)])) + raw
    return bytes(out)


def unstrings(payload: bytes) -> list[str]:
    out, at = [], 0
    while at < len(payload):
        n = shift = 0
        while True:
            b = payload[at]
            n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                break
        if at + n > len(payload):
            raise ValueError("the payload ends within a string")
        out.append(payload[at : at + n].decode())
        at += n
    return out


def flags(values: list[bool]) -> bytes:
    return np.packbits(np.asarray(values, dtype=bool), bitorder="little").tobytes()


def unflags(payload: bytes, n: int) -> list[bool]:
    return np.unpackbits(np.frombuffer(payload, dtype=np.uint8), bitorder="little")[:n].astype(bool).tolist()


@F.pandas_udf(T.BinaryType())
def to_varints(streams: pd.Series) -> pd.Series:
    return streams.map(varints)


@F.pandas_udf(T.ArrayType(T.LongType()))
def from_varints(payloads: pd.Series) -> pd.Series:
    return payloads.map(unvarints)


@F.pandas_udf(T.BinaryType())
def to_strings(streams: pd.Series) -> pd.Series:
    return streams.map(lambda v: strings(list(v)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def from_strings(payloads: pd.Series) -> pd.Series:
    return payloads.map(unstrings)
