"""Encodings of ordered value streams. A stream is a key (one or more columns) with rows ordered by pos."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import values as V


def ordered(keys: list[str], pos: str) -> Window:
    return Window.partitionBy(*keys).orderBy(pos)


#: Rows of a stream that one window holds, where positions are spread evenly.
PART_ROWS = 20000


def in_parts(rows: DataFrame, stream: str, pos: str) -> DataFrame:
    """Adds __part, by which long streams are cut along their order: no window needs more than a part, and parts follow each other as they sort.

    A part is a function of an integer position and of exact counts and bounds, so that every evaluation cuts alike. The second
    round cuts each part of the first by its own bounds, for positions that lie together. Bounds are a row a part.
    """

    def cut(df: DataFrame, keys: list[str], out: str) -> DataFrame:
        x = F.col(pos).cast("double")
        bounds = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.ceil(F.count("*") / PART_ROWS).alias("__k"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        met = df.join(F.broadcast(bounds), same)
        return met.withColumn(out, F.floor((x - F.col("__lo")) * F.col("__k") / (F.col("__hi") - F.col("__lo") + 1))).drop("__k", "__lo", "__hi", *[f"__{k}" for k in keys])

    twice = cut(cut(rows, [stream], "__p1"), [stream, "__p1"], "__p2")
    return twice.withColumn("__part", F.struct("__p1", "__p2")).drop("__p1", "__p2")


def delta(v: str, keys: list[str], pos: str) -> Column:
    """First value as it is, then differences."""
    return F.col(v) - F.lag(v, 1, 0).over(ordered(keys, pos))


def undelta(d: str, keys: list[str], pos: str) -> Column:
    return F.sum(d).over(ordered(keys, pos).rowsBetween(Window.unboundedPreceding, 0))


def delta2(rows: DataFrame, v: str, keys: list[str], pos: str, out: str = "dd") -> DataFrame:
    return rows.withColumn("__d", delta(v, keys, pos)).withColumn(out, delta("__d", keys, pos)).drop("__d")


def runs(rows: DataFrame, v: str, keys: list[str], pos: str) -> DataFrame:
    """Run-length pairs: keys, run_id from 1, value, run_len."""
    w = ordered(keys, pos)
    marked = rows.withColumn("__new", F.when(F.col(v).eqNullSafe(F.lag(v).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = marked.withColumn("run_id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run_id", F.col(v).alias("value")).agg(F.count("*").alias("run_len"))


def unruns(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Values of run-length pairs in order: keys, run_id, i, value."""
    return pairs.select(*keys, "run_id", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("run_len"))).alias("i"))


def dictionary(rows: DataFrame, v: str, keys: list[str], pos: str) -> DataFrame:
    """Ids from 0 by first occurrence: keys, value, id, first_pos, cnt. The window runs over distinct values only."""
    firsts = rows.groupBy(*keys, F.col(v).alias("value")).agg(F.min(pos).alias("first_pos"), F.count("*").alias("cnt"))
    return firsts.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("first_pos")).cast("long") - 1)


def _moved(table: list, v, size: int) -> int:
    """The rank of v in the table, to whose front it goes."""
    try:
        rank = table.index(v) + 1
        del table[rank - 1]
    except ValueError:
        rank = 0
    table.insert(0, v)
    del table[size:]
    return rank


def move_to_front(values: list, size: int = 512) -> list[int]:
    """Recency rank from 1, 0 for a value that isn't in the table."""
    table: list = []
    return [_moved(table, v, size) for v in values]


def unmove_to_front(ranks: list[int], misses: list, size: int = 512) -> list:
    table, out, rest = [], [], iter(misses)
    for r in ranks:
        v = table.pop(r - 1) if r else next(rest)
        out.append(v)
        table.insert(0, v)
        del table[size:]
    return out


def mtf_ranks(rows: DataFrame, v: str, keys: str | list[str], pos: str, size: int = 512) -> DataFrame:
    """Recency rank of every row in its stream: keys, pos, rank.

    The sorted streams of a partition pass one after another through one step, which holds a batch and a table: streams may be
    of any length, and many short ones cost no more than a long one.
    """
    keys = [keys] if isinstance(keys, str) else keys
    n = len(keys)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, []
        for b in batches:
            out = []
            for k, x in zip(zip(*(b.column(i).to_pylist() for i in range(n))), b.column(n + 1).to_pylist()):
                if k != at:
                    at, table = k, []
                out.append(_moved(table, x, size))
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(out, pa.int64())], names=[*keys, pos, "rank"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, pos])
    return rows.select(*keys, pos, v).repartition(*keys).sortWithinPartitions(*keys, pos).mapInArrow(rank, f"{schema}, rank long")


def denum_key(text: Column) -> tuple[Column, Column]:
    """Width, and the first digit where there are four or more (else 10)."""
    width = F.length(text).cast("long")
    return width, F.when(width >= 4, F.substring(text, 1, 1).cast("long")).otherwise(F.lit(10).cast("long"))


def last_before(v: Column, condition: Column, keys: list[str], pos: str) -> Column:
    """As-of: the value of the last row up to this one where the condition holds."""
    return F.last(F.when(condition, v), ignorenulls=True).over(ordered(keys, pos).rowsBetween(Window.unboundedPreceding, 0))


PERIODS = (10, 30, 60, 100, 300, 600, 1000, 3600, 10000, 65536)


def modular_costs(rows: DataFrame, v: str, keys: list[str], pos: str) -> DataFrame:
    """Cost of splitting a stream by every period: period, q_bytes (varints of zigzag quotient deltas), r_distinct."""
    led = rows.select(F.col(v).alias("v"), F.lag(v, 1, 0).over(ordered(keys, pos)).alias("before"))  # one sort for all periods
    each = led.withColumn("period", F.explode(F.array(*[F.lit(p).cast("long") for p in PERIODS])))
    each = each.select("period", F.pmod("v", "period").alias("r"), (F.floor(F.col("v") / F.col("period")) - F.floor(F.col("before") / F.col("period"))).alias("d"))
    return each.groupBy("period").agg(F.sum(V.varint_length(V.zigzag(F.col("d")))).alias("q_bytes"), F.countDistinct("r").alias("r_distinct"))


def majority_shape(rows: DataFrame, shape: Column) -> DataFrame:
    """The most frequent shape, its share and the rows that don't have it."""
    counted = rows.groupBy(shape.alias("shape")).agg(F.count("*").alias("c"))
    out = counted.agg(F.max_by("shape", F.struct(F.col("c"), F.col("shape"))).alias("shape"), F.max("c").alias("c"), F.sum("c").alias("n"))
    return out.select("shape", F.round(F.col("c") / F.col("n"), 6).alias("share"), (F.col("n") - F.col("c")).alias("n_exc"))


def byte_costs(rows: DataFrame, v: str, keys: list[str], pos: str, text: str) -> DataFrame:
    """Bytes of a stream of integers (v) with text form under each encoding: keys, kind, bytes. Lengths only, no payloads."""
    d = rows.withColumn("__d", delta(v, keys, pos)).withColumn("__dd", delta("__d", keys, pos))
    costs = [
        ("string", V.string_cost(F.col(text))), ("int_abs", V.varint_length(F.col(v))),
        ("int_delta", V.varint_length(V.zigzag(F.col("__d")))), ("int_delta2", V.varint_length(V.zigzag(F.col("__dd")))),
    ]
    summed = d.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in costs])
    return summed.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("bytes")) for k, _ in costs])).alias("x")).select(*keys, "x.*")


def cheapest(costs: DataFrame, keys: list[str]) -> DataFrame:
    """The kind of least bytes for each stream; the first by name on ties."""
    return costs.groupBy(*keys).agg(F.min(F.struct("bytes", "kind")).alias("m")).select(*keys, F.col("m.kind").alias("best_kind"), F.col("m.bytes").alias("bytes"))
