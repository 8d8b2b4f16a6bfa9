"""Relations between streams: as-of contexts, shared pools, routes, aliases, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators import streams as S
from tracewright.operators.lineage import cut

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def port_by_ip(rows: DataFrame, block: str, pos: str, ip: str, port: str) -> DataFrame:
    """Ports with the last ip before them and the difference to that ip's last port, plain and circular.

    Rows hold an ip or a port, the other is null. Ports before any ip form a context of their own.
    """
    known = rows.withColumn("ip", F.last(ip, ignorenulls=True).over(S.ordered([block], pos).rowsBetween(Window.unboundedPreceding, -1))).where(F.col(port).isNotNull())
    d = known.withColumn("d", S.delta(port, [block, "ip"], pos))
    return d.select(block, pos, "ip", "d", V.circular_u16(F.col("d")).alias("d16"))


def size_from_bytes(rows: DataFrame, block: str, pos: str, bytes_: str, text: str) -> DataFrame:
    """Size texts with whether the last byte count before them predicts them; else the text is an exception."""
    known = rows.withColumn("__b", F.last(bytes_, ignorenulls=True).over(S.ordered([block], pos).rowsBetween(Window.unboundedPreceding, -1))).where(F.col(text).isNotNull())
    hit = F.coalesce(V.pretty_size(F.col("__b")) == F.col(text), F.lit(False))
    return known.select(block, pos, hit.alias("predicted"), F.when(~hit, F.col(text)).alias("exception"))


def separator_columns(rows: DataFrame, text: str, separators: str = "_.~") -> DataFrame:
    """Splits texts at their separators where these are those of the majority: (col, value), col null on the exception route."""
    signature = F.regexp_replace(text, f"[^{separators}]", "")
    most = rows.groupBy(signature.alias("sig")).agg(F.count("*").alias("c")).agg(F.max_by("sig", F.struct("c", "sig")).alias("sig"), (F.max("c") * 2 >= F.sum("c")).alias("enough"))
    routed = rows.crossJoin(F.broadcast(most))  # one row
    fits = F.col("enough") & (signature == F.col("sig"))
    split = routed.where(fits).select(F.posexplode(F.split(text, f"[{separators}]", -1)).alias("col", "value"))
    return split.unionByName(routed.where(~F.coalesce(fits, F.lit(False))).select(F.lit(None).cast("int").alias("col"), F.col(text).alias("value")))


def shared_pools(values: DataFrame) -> DataFrame:
    """Streams that share any value, directly or through others, get one pool: stream, pool (least stream), pool_size.

    values has a row per (stream, value). Links run from each value to its least stream, so a common value makes no pairs; the
    rounds work on distinct (stream, stream) links, of which there are few. A round lowers each link's end to that end's own
    least neighbour and links all lesser neighbours of a stream with the least; it goes on until nothing moves.
    """
    distinct = values.distinct()
    least = distinct.groupBy("value").agg(F.min("stream").alias("least"))
    down = cut(distinct.join(least, "value").where("stream <> least").select(F.col("stream").alias("a"), F.col("least").alias("b")).distinct())
    moved = True
    while moved:
        ends = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        large = down.join(ends, F.col("b") == F.col("n"), "left").select("a", F.coalesce("low", "b").alias("b"), F.col("low").isNotNull().alias("moved"))
        large = cut(large.groupBy("a", "b").agg(F.max("moved").alias("moved")))
        ends = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        apart = F.col("b") != F.col("low")
        small = large.join(ends, F.col("a") == F.col("n")).select(F.when(apart, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b"), (F.col("moved") | apart).alias("moved"))
        small = cut(small.groupBy("a", "b").agg(F.max("moved").alias("moved")))
        moved = not small.where("moved").isEmpty()
        down = small.select("a", "b")
    streams = distinct.select("stream").distinct()
    labels = streams.join(down, F.col("stream") == F.col("a"), "left").select("stream", F.coalesce("b", "stream").alias("pool"))
    sizes = distinct.join(labels, "stream").groupBy("pool").agg(F.countDistinct("value").alias("pool_size"))
    return labels.join(sizes, "pool").select("stream", "pool", "pool_size")


def aliases(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """The least key with the same payload, by digest: key, alias."""
    d = payloads.select(key, F.sha2(F.col(payload).cast("binary"), 256).alias("h"))
    return d.withColumn("alias", F.min(key).over(Window.partitionBy("h"))).select(key, "alias")


def route_key(before: Column, after: Column) -> Column:
    """Local context of a value with digits masked."""
    masked = lambda c: F.regexp_replace(c, "[0-9]", "D")
    return F.concat(masked(before), F.lit("<P>"), masked(after))


def base62(v: Column, digits: int = 6) -> Column:
    """A non-negative integer in the 62-letter alphabet, without leading zeros."""
    letters = [F.substring(F.lit(ALPHABET), ((F.floor(v / 62**i) % 62) + 1).cast("int"), F.lit(1)) for i in range(digits - 1, -1, -1)]
    text = F.regexp_replace(F.concat(*letters), "^0+", "")
    return F.when(text == "", "0").otherwise(text)


def structured_tag(index: Column, token: Column, context: Column) -> Column:
    parts = F.concat_ws("|", F.concat(F.lit("IDX="), index.cast("string")), F.concat(F.lit("LEN="), F.length(token).cast("string")), F.when(context != "", F.concat(F.lit("CTX="), context)))
    return F.concat(F.lit("<"), parts, F.lit(">"))


def parsed_tag(tag: Column) -> Column:
    """The tag's parts as a map."""
    return F.str_to_map(F.regexp_replace(tag, "^<|>$", ""), F.lit(r"\|"), F.lit("="))


def candidate_gain(occurrences: DataFrame, placeholder: int = 1, fixed: int = 96) -> DataFrame:
    """Bytes that a field saves at least: its values leave the text for placeholders and one copy of each distinct value."""
    each = occurrences.groupBy("tag", "value").agg(F.count("*").alias("c"))
    length = F.octet_length("value").cast("long")
    return each.groupBy("tag").agg((F.sum(length * F.col("c")) - F.sum("c") * placeholder - F.sum(length + 1) - fixed).alias("gain"), F.sum("c").alias("n"))
