"""Streaming counterparts: event-time windows, and the block policy over micro-batches.

Event-time windows with watermarks go beyond the engine's own count windows and are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import adaptive


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of them per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "event_type", "cnt")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("cnt")).select("user_id", F.col("w.start").alias("start"), "cnt")


class BlockPolicy:
    """foreachBatch sink: keeps per-block costs (one row a block) and replays the online policy over them.

    A batch has rows (block_id, plan_total, empty_total, candidate_total); only these numbers reach the driver. A batch that is
    delivered again replaces its own blocks, so replays are harmless.
    """

    def __init__(self) -> None:
        self.costs: dict[int, tuple[int, int, int]] = {}
        self.events: list[adaptive.Event] = []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for r in batch.select("block_id", "plan_total", "empty_total", "candidate_total").collect():
            self.costs[r[0]] = tuple(r[1:])
        self.events = adaptive.evolve((b, *self.costs[b]) for b in sorted(self.costs))
