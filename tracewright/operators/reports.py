"""Aggregates of recorded results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Z = 1.96


def ratios(rows: DataFrame, keys: list[str], raw: str, archive: str) -> DataFrame:
    """Mean, geometric mean and corpus ratio of raw to archive sizes."""
    r = F.col(raw) / F.col(archive)
    return rows.groupBy(*keys).agg(F.round(F.avg(r), 6).alias("mean"), F.round(F.exp(F.avg(F.ln(r))), 6).alias("geomean"), F.round(F.sum(raw) / F.sum(archive), 6).alias("corpus"))


def wilson(strata: DataFrame) -> DataFrame:
    """95 % intervals of k successes in n: adds lo and hi."""
    n, p, z2 = F.col("n"), F.col("k") / F.col("n"), Z * Z
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = lambda s: F.round((p + z2 / (2 * n) + s * half) / (1 + z2 / n), 6)
    return strata.withColumn("lo", bound(-1)).withColumn("hi", bound(1))


def systematic_sample(counted: DataFrame, most: int) -> DataFrame:
    """Evenly spread positions 1..n-1 of n rows: i, idx. counted has one row."""
    k = F.least(F.lit(most).cast("long"), F.col("n") - 1)
    spread = counted.select("n", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("i"))
    return spread.select("i", F.floor(1 + F.col("i") * (F.col("n") - 2) / (F.col("k") - 1) + 0.5).alias("idx"))
