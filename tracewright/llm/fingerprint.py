"""Document fingerprints: quartile bucket digests of hashed byte triplets.

A sliding window of five bytes yields six triplets, each hashed into one of 256 buckets. The digest codes for every bucket
the quartile that its count falls in (two bits), preceded by a logarithmic length code and two quartile ratios. Two digests
are compared by a bounded difference score, turned into a likeness between 0 and 1.

Defined cases: a null text counts as empty; texts under five bytes use what triplets they have, an empty text has the digest
of all-zero counts; equal texts have equal digests; repeated rows each get their own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import shared
from tracewright.llm.words import mix

BUCKETS = 256
#: Difference at which two digests count as wholly unlike.
FULL_DIFFERENCE = 2 * BUCKETS
_PAIR_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)
#: Byte distances of the six triplets that end at a window's last byte.
_TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = (mix(np.arange(1, 3 * 256 + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return codes[:256], codes[256:512], codes[512:]


def bucket_counts(data: bytes) -> np.ndarray:
    """How many of the text's hashed triplets fall in each bucket."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    first, second, third = (t[raw] for t in _tables())
    n = len(raw)
    for k, (i, j) in enumerate(_TRIPLETS):
        if n > j:
            h = first[j:] + second[j - i : n - i] + third[: n - j] + np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Hex digest: length code, quartile ratios, then two bits a bucket."""
    counts = bucket_counts(data)
    low, mid, high = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    length = min(255, int(round(12 * np.log2(len(data) + 1))))
    ratios = (low * 15 // high) << 4 | (mid * 15 // high) if high else 0
    codes = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return bytes([length, ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Sum of bucket, ratio and length differences; at most FULL_DIFFERENCE counts."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    total = abs(int(x[0]) - int(y[0])) // 4
    total += abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15))
    for shift in (0, 2, 4, 6):
        total += int(_PAIR_COST[(x[2:] >> shift) & 3, (y[2:] >> shift) & 3].sum())
    return min(total, FULL_DIFFERENCE)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / FULL_DIFFERENCE


def _places(keys: np.ndarray, hashes: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket of each (key, hash, row): how many of the bounds (a structured array of such triples) are at or below it."""
    asked = np.empty(len(keys), dtype=bounds.dtype)
    asked["k"], asked["h"], asked["r"] = keys, hashes, rows
    order = np.lexsort((rows, hashes, keys))
    both = np.concatenate([bounds, asked[order]])
    at = np.lexsort((np.r_[np.zeros(len(bounds), int), np.ones(len(keys), int)], both["r"], both["h"], both["k"]))
    seen = np.cumsum(at < len(bounds))[at >= len(bounds)]
    out = np.empty(len(keys), np.int64)
    out[order[at[at >= len(bounds)] - len(bounds)]] = seen
    return out


_TRIPLE = np.dtype([("k", np.int64), ("h", np.int64), ("r", np.int64)])
_LEAST = np.iinfo(np.int64).min
#: Rows looked at for each bucket's bounds.
SAMPLE = 64


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Range-partitions docs by key, text hash and row number with one shuffle; each bucket gets the first row of the next one.

    Columns: bucket, tail (the copied row), key, text, ordered within a bucket, the copy last. So equal keys and repeated rows
    may lie in several buckets. Bounds come from SAMPLE rows a bucket, those of least hash; they only shape the buckets.
    Gathered are the sample's numbers and one row a bucket. Row numbers are the scan's, the same whenever it is read.
    """
    spark = docs.sparkSession
    wanted = shared.shuffle_partitions(spark)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("k"), F.xxhash64(value).alias("h"), F.monotonically_increasing_id().alias("r"), F.col(key).isNull().alias("no_key"), value.alias("text"))
    ids = rows.select("k", "h", "r")
    some = ids.orderBy(F.xxhash64("k", "h", "r")).limit(SAMPLE * wanted).toArrow()
    sample = np.zeros(some.num_rows, dtype=_TRIPLE)
    for c in _TRIPLE.names:
        sample[c] = some.column(c).to_numpy()
    sample = np.sort(sample)
    bounds = np.unique(sample[[len(sample) * i // wanted for i in range(1, wanted)]]) if len(sample) else sample

    def place(batches):
        for b in batches:
            at = _places(*(b.column(i).to_numpy() for i in range(3)), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], names=["b", *b.schema.names])

    firsts = ids.mapInArrow(place, "b long, k long, h long, r long").groupBy("b").agg(F.min(F.struct("k", "h", "r")).alias("x")).orderBy("b").collect()  # one row a bucket
    held = np.array([f["b"] for f in firsts], np.int64)
    heads = np.array([tuple(f["x"]) for f in firsts], dtype=_TRIPLE)

    def dealt(batches):
        for b in batches:
            k, h, r = (b.column(i).to_numpy() for i in range(3))
            bucket = _places(k, h, r, bounds)
            at = np.searchsorted(held, bucket)
            copied = np.flatnonzero((heads["k"][at] == k) & (heads["h"][at] == h) & (heads["r"][at] == r))
            for where, rows_, tail in ((bucket, np.arange(len(k)), False), (held[at[copied] - 1], copied, True)):
                part = b.take(pa.array(rows_))
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.full(len(rows_), tail)), *part.columns], names=["bucket", "tail", *b.schema.names])

    out = rows.mapInArrow(dealt, "bucket long, tail boolean, k long, h long, r long, no_key boolean, text string")
    out = out.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tail", "k", "h", "r")
    return out.select("bucket", "tail", F.when(~F.col("no_key"), F.col("k")).alias("key"), "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _OUT.split(", ")]
    held = None  # the row that waits for its successor: bucket, key, text, digest
    for batch in batches:
        out: list[tuple] = []
        for bucket, tail, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            print_ = digest(text.encode())
            if held is not None:
                _, k, before, print_before = held
                changed = edited(before, text)
                raw = changed.encode()
                print_edited = digest(raw)
                out.append((k, len(before), hashlib.sha256(raw).hexdigest(), print_before, print_edited, likeness(print_before, print_edited), likeness(print_before, print_)))
            held = None if tail else (bucket, key, text, print_)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
    if held is not None:
        raise RuntimeError("a bucket's last row has no successor: the input gave other rows when read again")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of every text and of its edited text, with likenesses to the edited text and to the next document.

    The next document is the next row by key, of equal keys by the text's hash; after the last comes the first. A null key sorts first. One row per
    input row; other columns are ignored. An empty table gives an empty result.
    """
    return with_next(docs, key, text).mapInArrow(_compare, _OUT)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(shared.table(spark, sf_dir, "documents"))
