"""Streams of texts taken apart at their numbers: skeletons, numeric columns with widths, literal columns, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators import streams as S

NUMBER = r"[0-9]+(?:[.][0-9]+)?"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def literals(text: Column) -> Column:
    """What stands around the numbers: one more than there are numbers."""
    return F.split(text, NUMBER, -1)


def decimal_parts(number: Column) -> Column:
    """value (all digits as an integer, null beyond 18 of them), width before the point, width after it (0 without a point)."""
    parts = F.split(number, r"\.")
    joined = F.array_join(parts, "")
    after = F.when(F.size(parts) > 1, F.length(parts[1])).otherwise(0)
    value = F.when(F.length(joined) <= 18, joined.try_cast("long"))
    return F.struct(value.alias("value"), F.length(parts[0]).cast("long").alias("whole"), after.cast("long").alias("fraction"))


def decimal_text(parts: Column) -> Column:
    digits = F.lpad(parts["value"].cast("string"), (parts["whole"] + parts["fraction"]).cast("int"), "0")
    whole = F.substring(digits, F.lit(1), parts["whole"].cast("int"))
    return F.when(parts["fraction"] > 0, F.concat(whole, F.lit("."), F.substring(digits, (parts["whole"] + 1).cast("int"), parts["fraction"].cast("int")))).otherwise(whole)


def joined(around: Column, texts: Column) -> Column:
    return F.array_join(F.zip_with(around, texts, lambda a, t: F.concat(a, F.coalesce(t, F.lit("")))), "")


def shapes_of_streams(rows: DataFrame, stream: str, text: str) -> DataFrame:
    """Which skeleton kinds a stream allows: stream, n, skeletons, numeric (one skeleton), mixed (one number count), arity."""
    parts = rows.select(stream, literals(F.col(text)).alias("l"))
    out = parts.groupBy(stream).agg(F.count("*").alias("n"), F.countDistinct("l").alias("skeletons"), F.min(F.size("l") - 1).alias("lo"), F.max(F.size("l") - 1).alias("hi"))
    has = F.col("lo") > 0
    return out.select(stream, "n", "skeletons", (has & (F.col("skeletons") == 1)).alias("numeric"), (has & (F.col("lo") == F.col("hi"))).alias("mixed"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).cast("long").alias("arity"))


def shape_columns(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Shape-mixed skeletons: key, pos, shape_id (by first occurrence in the key's stream), around, numbers (parts), exact.

    Shapes are numbered over distinct skeletons only. A value whose numbers don't come back exactly is not exact and stays text.
    """
    cut = rows.select(key, pos, text, literals(F.col(text)).alias("around"), F.transform(numbers(F.col(text)), decimal_parts).alias("numbers"))
    shapes = S.dictionary(cut.withColumn("shape", F.array_join("around", "\x1f")), "shape", [key], pos).select(key, F.col("value").alias("shape"), F.col("id").alias("shape_id"))
    found = cut.withColumn("shape", F.array_join("around", "\x1f")).join(shapes, [key, "shape"])
    exact = F.coalesce(joined(F.col("around"), F.transform("numbers", decimal_text)) == F.col(text), F.lit(False))
    return found.select(key, pos, text, "shape_id", "around", "numbers", exact.alias("exact"))


def numeric_columns(shaped: DataFrame, key: str, pos: str) -> DataFrame:
    """Deltas of every numeric column of every shape: key, shape_id, col, pos, delta, whole, fraction."""
    each = shaped.where("exact").select(key, pos, "shape_id", F.posexplode("numbers").alias("col", "x")).select(key, pos, "shape_id", "col", "x.*")
    return each.withColumn("delta", S.delta("value", [key, "shape_id", "col"], pos)).drop("value")


def restored(shaped: DataFrame, key: str, pos: str) -> DataFrame:
    """The texts again, from shapes, running sums of the deltas and widths: key, pos, restored."""
    d = numeric_columns(shaped, key, pos).withColumn("value", S.undelta("delta", [key, "shape_id", "col"], pos))
    texts = d.groupBy(key, pos).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value", "whole", "fraction"))), decimal_text).alias("texts"))  # the numbers of one value
    out = shaped.select(key, pos, "around", "exact", "text").join(texts, [key, pos], "left")
    back = joined(F.col("around"), F.coalesce("texts", F.array().cast("array<string>")))
    return out.select(key, pos, F.when(F.col("exact"), back).otherwise(F.col("text")).alias("restored"))


def last_number(text: Column) -> tuple[Column, Column, Column]:
    """Prefix, last digit run and suffix of a text."""
    pattern = "^(.*?)([0-9]+)([^0-9]*)$"
    return tuple(F.regexp_extract(text, pattern, i) for i in (1, 2, 3))


def prefix_deltas(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Digit tuples as a prefix dictionary and the last number's deltas under each prefix: key, pos, prefix, d, width."""
    prefix, digits, suffix = last_number(F.col(text))
    cut = rows.where(F.col(text).rlike("[0-9]")).select(key, pos, F.concat(prefix, F.lit("\x1f"), suffix).alias("prefix"), digits.try_cast("long").alias("v"), F.length(digits).cast("long").alias("width"))
    return cut.select(key, pos, "prefix", S.delta("v", [key, "prefix"], pos).alias("d"), "width")


def column_prefix_deltas(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Digit columns where the last one is differenced under equal values of all others: key, pos, d."""
    runs = F.regexp_extract_all(F.col(text), F.lit("[0-9]+"), F.lit(0))
    cut = rows.select(key, pos, runs.alias("r")).where("size(r) > 0")
    cut = cut.select(key, pos, F.array_join(F.slice("r", F.lit(1), F.size("r") - 1), ",").alias("others"), F.element_at("r", -1).try_cast("long").alias("v"))
    return cut.select(key, pos, S.delta("v", [key, "others"], pos).alias("d"))


def layout_deltas(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Canonical integers share one delta stream; how each was written is an id in a layout dictionary: key, pos, d, layout_id."""
    plain = F.col(text).try_cast("long")
    cut = rows.where(F.col(text).rlike("^[0-9]{1,18}$")).select(key, pos, plain.alias("v"), (F.length(text) - F.length(plain.cast("string"))).cast("long").alias("zeros"))
    layouts = S.dictionary(cut, "zeros", [key], pos).select(key, F.col("value").alias("zeros"), F.col("id").alias("layout_id"))
    return cut.join(layouts, [key, "zeros"]).select(key, pos, S.delta("v", [key], pos).alias("d"), "zeros", "layout_id")


def fixed_widths(rows: DataFrame, stream: str, pos: str, text: str) -> DataFrame:
    """Streams of integers written with one width: stream, width (null where it varies), abs_bytes, delta_bytes.

    Deltas are taken within parts of a stream; of each part its first and last values remain, for the deltas between parts.
    """
    v = S.in_parts(rows.select(stream, pos, F.col(text).try_cast("long").alias("v"), F.length(text).cast("long").alias("w")), stream, pos)
    order = Window.partitionBy(stream, "__part").orderBy(pos, "v")
    cost = lambda d: V.varint_length(V.zigzag(d))
    d = v.withColumn("inner", F.when(F.row_number().over(order) > 1, cost(F.col("v") - F.lag("v").over(order))))
    parts = d.groupBy(stream, "__part").agg(
        F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum(V.varint_length(F.col("v"))).alias("abs_bytes"), F.sum("inner").alias("inner"),
        F.min(F.struct(pos, "v"))["v"].alias("first"), F.max(F.struct(pos, "v"))["v"].alias("last"),
    )
    led = parts.withColumn("between", cost(F.col("first") - F.lag("last", 1, 0).over(Window.partitionBy(stream).orderBy("__part"))))  # a row a part
    out = led.groupBy(stream).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("abs_bytes").alias("abs_bytes"), F.sum(F.coalesce("inner", F.lit(0)) + F.col("between")).alias("delta_bytes"))
    return out.select(stream, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("width"), "abs_bytes", "delta_bytes")


def mtf_by(rows: DataFrame, v: str, keys: list[str], pos: str, size: int = 512) -> DataFrame:
    """Recency ranks with a table for every combination of keys: keys, pos, rank (0 for a value that isn't in the table)."""
    return S.mtf_ranks(rows, v, keys, pos, size)


def mtf_deltas(rows: DataFrame, v: str, key: str, pos: str) -> DataFrame:
    """Ranks and their differences: key, pos, rank, d."""
    return S.mtf_ranks(rows, v, key, pos).withColumn("d", S.delta("rank", [key], pos))


def merged_streams(rows: DataFrame, stream: str, pos: str, least: int = 64, text: str = "text") -> DataFrame:
    """Hexadecimal streams of enough values as slices of one: stream, offset, n. Each value's place is its stream's offset plus its own."""
    hexes = rows.groupBy(stream).agg(F.count("*").alias("n"), F.bool_and(F.col(text).rlike("^[0-9a-fA-F]+$")).alias("hex")).where(F.col("hex") & (F.col("n") >= least))
    before = Window.orderBy(stream).rowsBetween(Window.unboundedPreceding, -1)  # one row a stream
    return hexes.select(stream, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "n")


def surrogate_gains(rows: DataFrame, stream: str, pos: str, text: str, sample: int = 4096, model: int = 32) -> DataFrame:
    """Cheap estimate of what a codec may save: stream, sampled, gain. A systematic sample of each stream: it is the feature.

    Rows are numbered within parts of their stream, from the number of rows before the part.
    """
    cut = S.in_parts(rows, stream, pos)
    parts = cut.groupBy(F.col(stream).alias("__s"), F.col("__part").alias("__q")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy("__s").orderBy("__q")  # a row a part
    before = F.coalesce(F.sum("c").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("__s", "__q", before.alias("before"), F.sum("c").over(Window.partitionBy("__s")).alias("n"))
    met = cut.join(F.broadcast(placed), F.col(stream).eqNullSafe(F.col("__s")) & F.col("__part").eqNullSafe(F.col("__q")))
    numbered = met.withColumn("i", F.row_number().over(Window.partitionBy(stream, "__part").orderBy(pos)) - 1 + F.col("before"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / sample))
    some = numbered.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < sample))
    number = F.when(F.col(text).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.regexp_replace(text, r"\.", "").try_cast("long"))
    some = some.select(stream, pos, text, "n", number.alias("v"), F.when(F.col(text).contains("."), 2).otherwise(1).alias("w"))
    some = some.withColumn("cost", V.varint_length(V.zigzag(S.delta("v", [stream], pos))) + F.col("w"))
    out = some.groupBy(stream).agg(
        F.count("*").alias("sampled"), F.max("n").alias("n"), F.sum(F.length(text) + 1).alias("raw"), F.countDistinct(text).alias("d"), F.sum(F.length(text)).alias("chars"), F.bool_and(F.col("v").isNotNull()).alias("numeric"), F.sum("cost").alias("num")
    )
    distinct = F.col("d") * F.greatest(F.lit(1), F.floor(F.col("chars") / F.col("sampled")))
    best = F.least("raw", distinct, F.when(F.col("numeric"), F.col("num")))
    return out.select(stream, "sampled", F.expr("CAST(0 AS bigint)").alias("zero"), ((F.col("raw") - best - model) * F.col("n") / F.col("sampled")).cast("long").alias("gain")).drop("zero")
