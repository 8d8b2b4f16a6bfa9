"""Session helpers shared by the operators: table access and the shared work folder."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a filter of wanted ids that is sent to executors; beyond it all rows are shuffled instead, to the same result.
FILTER_BITS = 1 << 28


#: Rows and bytes of text that a Python worker is sent at once: texts are long, and several workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Rows that Spark's Parquet reader decodes at once, whole texts among them.
READER_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step of a mapInArrow, which gives freed memory back to the system at its end: workers wait long, and are reused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where a local session has no such setting (single-process tests), a temporary folder serves and is set as it.
    """
    bound_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tracewright/{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as keep it apart from every column of df."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return tuple(found)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wanted_bits(ids: DataFrame, column: str):
    """A broadcast Bloom filter (url_filter.Level) of the long ids in a column; None where it would pass FILTER_BITS.

    Its bits are set on the executors, gathered as words (at most FILTER_BITS / 64 rows) and sent back.
    """
    from tracewright.llm.url_filter import Level

    size = 1 << max(10, math.ceil(math.log2(max(1, 8 * ids.count()))))
    if size > FILTER_BITS:
        return None
    empty = Level(np.zeros(size // 64, dtype=np.uint64), size, 5)

    def words(batches):
        for b in batches:
            p = empty.positions(b.column(0).to_numpy().view(np.uint64)).ravel()
            bits = np.uint64(1) << (p & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = ids.select(column).where(F.col(column).isNotNull()).mapInArrow(released(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(tuple(empty))


def filter_of(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A predicate on long columns that holds for all of ids and about one in twenty others; never null.

    Where the next step is Python too, test wanted_bits in it instead: each Python step of a task is a process of its own.
    """
    from tracewright.llm.url_filter import Level

    sent = wanted_bits(ids, column)
    if sent is None:
        return lambda c: F.lit(True)

    @F.pandas_udf("boolean")
    def has(keys):
        import pandas as pd

        return pd.Series(Level(*sent.value).has(keys.to_numpy(np.int64, na_value=-1).view(np.uint64)))

    return lambda c: F.coalesce(has(c.cast("long")), F.lit(False))


def packed_texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, packed): compressed texts of the rows whose id is among ids (column doc_id), and of few others, by one Python step."""
    from tracewright.llm.url_filter import Level

    sent = wanted_bits(ids, "doc_id")

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        level = None if sent is None else Level(*sent.value)
        for b in batches:
            if level is not None:
                b = b.filter(pa.array(level.has(b.column(0).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "packed"])

    chosen = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(released(pack), "doc_id long, packed binary")
