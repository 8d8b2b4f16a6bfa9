"""Lossless reading of record files and block archives that are checked by their inverse.

A block's lines are joined by LF and stored as an LZMA payload with the block's SHA-256; decoding compares the digest, so a
block that can't be rebuilt byte for byte is reported, never dropped.
"""

from __future__ import annotations

import hashlib
import lzma

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_RECORDS = 100_000


def read_records(spark: SparkSession, path: str, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Physical lines of byte files: source, block_id, line_no, body, ending. One Latin-1 character per byte, so any bytes survive.

    Only LF ends a record; the ending is CRLF, LF or empty. Files are read by splits: a split's lines are numbered within it, from
    the lines of the splits before it, and a file's size tells whether its last line ends in LF. Only counts of splits are shuffled.
    """
    files = spark.read.option("lineSep", "\n").text(path)
    rows = files.select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    splits = rows.groupBy("source", "start").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.sum(F.length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    by_file = Window.partitionBy("source").orderBy("start")  # one row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy("source")
    splits = splits.withColumn("lines", F.sum("n").over(whole)).withColumn("ended", F.sum("bytes").over(whole) <= F.col("size"))
    found = rows.drop("size").join(splits.drop("size", "n", "bytes"), ["source", "start"]).withColumn("line_no", F.col("before") + F.col("id") - F.col("least"))
    has_lf = F.col("ended") | (F.col("line_no") + 1 < F.col("lines"))
    crlf = has_lf & F.col("line").endswith("\r")
    body = F.when(crlf, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    ending = F.when(crlf, "\r\n").when(has_lf, "\n").otherwise("")
    return found.select("source", F.expr(f"line_no div {block_records}").alias("block_id"), "line_no", body.alias("body"), ending.alias("ending"))


def _joined(pdf: pd.DataFrame) -> bytes:
    """Lines in the order of pos, which may be a struct."""
    at = pdf["pos"].map(lambda p: tuple(p.values()) if isinstance(p, dict) else tuple(p) if isinstance(p, tuple) else p)
    return "\n".join(pdf["line"].iloc[at.argsort(kind="stable") if at.dtype != object else sorted(range(len(at)), key=at.tolist().__getitem__)]).encode()


def encoded(records: DataFrame, preset: int = 1) -> DataFrame:
    """Archives of blocks (block_id, pos, line) by LZMA at a preset: block_id, raw_bytes, archive_bytes, raw_sha256, payload, lines."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = _joined(pdf)
        payload = lzma.compress(raw, preset=preset)
        return pd.DataFrame({"block_id": [pdf["block_id"].iloc[0]], "raw_bytes": [len(raw)], "archive_bytes": [len(payload)], "raw_sha256": [hashlib.sha256(raw).hexdigest()], "payload": [payload], "lines": [len(pdf)]})

    return records.groupBy("block_id").applyInPandas(pack, "block_id long, raw_bytes long, archive_bytes long, raw_sha256 string, payload binary, lines long")


def decoded(archives: DataFrame) -> DataFrame:
    """Bytes of every block, the text they spell, and whether they are exact: block_id, raw, exact, text."""

    def unpack(batches):
        for pdf in batches:
            raw = [lzma.decompress(p) for p in pdf["payload"]]
            exact = [hashlib.sha256(r).hexdigest() == h for r, h in zip(raw, pdf["raw_sha256"])]
            yield pd.DataFrame({"block_id": pdf["block_id"], "raw": raw, "exact": exact})

    return archives.select("block_id", "payload", "raw_sha256").mapInPandas(unpack, "block_id long, raw binary, exact boolean").withColumn("text", F.decode("raw", "UTF-8"))


def archive_sizes(records: DataFrame) -> DataFrame:
    return encoded(records).select("block_id", "lines", "raw_bytes", "archive_bytes", F.round(F.col("raw_bytes") / F.col("archive_bytes"), 4).alias("ratio"))
