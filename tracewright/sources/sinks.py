"""Sinks: byte-exact text files, CSV and JSON lines, block codecs, slices of blocks and ordered emission."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import zstandard
except ImportError:  # one codec less
    zstandard = None

CODECS = {
    "none": (bytes, bytes), "gzip": (lambda b: gzip.compress(b, 6, mtime=0), gzip.decompress), "bz2": (bz2.compress, bz2.decompress),
    "xz": (lambda b: lzma.compress(b, preset=6), lzma.decompress),
}
if zstandard is not None:
    CODECS["zstd"] = (lambda b: zstandard.ZstdCompressor(level=3).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b))


def write_lossless(records: DataFrame, folder: str, block: str = "block_id", pos: str = "line_no") -> DataFrame:
    """Bodies and endings (one character a byte) as a file a block; returns the manifest: block, file, bytes, sha256.

    Each file is written line by line under a name of its attempt and then renamed, so that a task that runs again leaves the same.
    read_records reads the same bytes.
    """
    rows = records.select(F.col(block).cast("long").alias("block"), pos, F.encode(F.concat("body", "ending"), "ISO-8859-1").alias("raw"))

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for number, some in groupby(((n, r) for b in batches for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: x[0]):
            name, size, digest = f"{base}/.block-{number:08d}-{uuid.uuid4().hex}", 0, hashlib.sha256()
            with store.open_output_stream(name) as out:
                for _, raw in some:
                    out.write(raw)
                    size += len(raw)
                    digest.update(raw)
            store.move(name, f"{base}/block-{number:08d}.log")
            yield pa.RecordBatch.from_pydict({"block": [number], "file": [f"block-{number:08d}.log"], "bytes": [size], "sha256": [digest.hexdigest()]})

    ordered = rows.repartition("block").sortWithinPartitions("block", pos).select("block", "raw")
    path = f"{folder.rstrip('/')}/_manifest"
    ordered.mapInArrow(write, "block long, file string, bytes long, sha256 string").write.mode("overwrite").parquet(path)
    return records.sparkSession.read.parquet(path)


#: Null in CSV files: a character of a private-use range, which no record may hold.
NULL = chr(0xE0FF)
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": NULL}


def write_csv(rows: DataFrame, folder: str) -> None:
    """Any text comes back, empty ones too; null is written as NULL."""
    rows.write.mode("overwrite").options(**_CSV).csv(folder)


def read_csv(rows_of: DataFrame, folder: str) -> DataFrame:
    return rows_of.sparkSession.read.schema(rows_of.schema).options(**_CSV, multiLine=True).csv(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def first_records(records: DataFrame, n: int, pos: str = "line_no") -> DataFrame:
    """The first n records of every source: a slice by number, no sort."""
    return records.where(F.col(pos) < n)


def block_range(records: DataFrame, first: int, last: int, block: str = "block_id") -> DataFrame:
    """Blocks from first to before last."""
    return records.where((F.col(block) >= first) & (F.col(block) < last))


#: Bytes of blocks that a Python worker is sent at once; a larger block goes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(blocks: DataFrame) -> DataFrame:
    """Batches go by bytes, not by rows alone, of which ten thousand blocks would make one. A session's own lower bound, in plain bytes, stays."""
    conf = blocks.sparkSession.conf
    now = conf.get(_BATCH).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(_BATCH, BATCH_BYTES)
    return blocks


def chunks(blocks: DataFrame, codecs: tuple[str, ...] = tuple(CODECS)) -> DataFrame:
    """Every block (block_id, raw binary) by every codec: block_id, codec, raw_bytes, packed_bytes, raw_sha256, payload. No shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, raw in zip(pdf["block_id"], pdf["raw"]):
                digest = hashlib.sha256(raw).hexdigest()
                for c in codecs:
                    packed = CODECS[c][0](raw)
                    yield pd.DataFrame({"block_id": [b], "codec": [c], "raw_bytes": [len(raw)], "packed_bytes": [len(packed)], "raw_sha256": [digest], "payload": [packed]})

    return _bounded(blocks).select("block_id", "raw").mapInPandas(pack, "block_id long, codec string, raw_bytes long, packed_bytes long, raw_sha256 string, payload binary")


def unpacked(packed: DataFrame) -> DataFrame:
    """Chunks taken apart again: block_id, codec, raw, exact (the digest agrees)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, c, p, h in zip(pdf["block_id"], pdf["codec"], pdf["payload"], pdf["raw_sha256"]):
                raw = CODECS[c][1](p)  # a payload's batch may be far larger unpacked
                yield pd.DataFrame({"block_id": [b], "codec": [c], "raw": [raw], "exact": [hashlib.sha256(raw).hexdigest() == h]})

    return _bounded(packed).select("block_id", "codec", "payload", "raw_sha256").mapInPandas(unpack, "block_id long, codec string, raw binary, exact boolean")


def inventory(packed: DataFrame) -> DataFrame:
    """Members of block archives: codec, members, raw and packed bytes, and a digest over all members' digests in block order."""
    held = packed.groupBy("codec").agg(F.count("*").alias("members"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("packed_bytes").alias("packed_bytes"))
    return held


def in_order(blocks: DataFrame, block: str = "block_id") -> Iterator:
    """Rows by block number, a partition at a time: what a consumer that appends must see."""
    return blocks.orderBy(block).toLocalIterator()
