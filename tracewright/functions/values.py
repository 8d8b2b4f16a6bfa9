"""Reversible value functions as Column expressions: integers, times, addresses, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_STARTS = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 give 0, 1, 2, 3."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def varint_length(v: Column) -> Column:
    """Bytes of a non-negative integer in base-128 groups."""
    out = F.when(v < 1 << 7, 1)
    for n in range(2, 9):
        out = out.when(v < 1 << 7 * n, n)
    return out.otherwise(9)


def floor_div(a: Column, n: int) -> Column:
    """Division that rounds down for negative numbers too."""
    return (a - F.pmod(a, F.lit(n).cast("long"))) / F.lit(n)


def hms_seconds(text: Column) -> Column:
    p = F.split(text, ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")


def hms_text(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def _month_case(month: Column, values: tuple) -> Column:
    out = F.lit(None)
    for name, v in zip(MONTHS, values):
        out = F.when(month == name, v).otherwise(out)
    return out


_SYSLOG = r"^([A-Z][a-z]{2})( +)([0-9]{1,2}) +([0-9]{2}:[0-9]{2}:[0-9]{2})$"


def syslog_seconds(text: Column) -> Column:
    """Seconds of a 365-day year; null where the text isn't `Mon D HH:MM:SS`."""
    part = lambda i: F.regexp_extract(text, _SYSLOG, i)
    day = _month_case(part(1), MONTH_STARTS).cast("long") + part(3).try_cast("long") - 1
    return F.when(text.rlike(_SYSLOG), day * 86400 + hms_seconds(F.when(text.rlike(_SYSLOG), part(4))))


def syslog_layout(text: Column) -> Column:
    """Spaces (4 bits), day width (2 bits) and a leading-zero flag."""
    part = lambda i: F.regexp_extract(text, _SYSLOG, i)
    spaces, width = F.least(F.length(part(2)), F.lit(15)), F.least(F.length(part(3)), F.lit(3))
    return F.when(text.rlike(_SYSLOG), (spaces + width * 16 + F.when(part(3).startswith("0"), 64).otherwise(0)).cast("long"))


def ipv4_packed(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    return ((p[0].cast("long") * 256 + p[1].cast("long")) * 256 + p[2].cast("long")) * 256 + p[3].cast("long")


def ipv4_text(packed: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(packed, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])


def floor_3_significant(bytes_: Column, unit: int) -> Column:
    """bytes / unit cut to three significant digits."""
    out = None
    for limit, scale in ((10, 100), (100, 10)):
        whole = F.floor(bytes_ * scale / unit)
        text = F.concat(F.floor(whole / scale).cast("string"), F.lit("."), F.lpad((whole % scale).cast("string"), len(str(scale)) - 1, "0"))
        out = F.when(bytes_ < limit * unit, text) if out is None else out.when(bytes_ < limit * unit, text)
    return out.otherwise(F.floor(bytes_ / unit).cast("string"))


def byte_phrase_suffix(bytes_: Column) -> Column:
    mb = 1 << 20
    return F.when(bytes_ <= 1024, "").when(bytes_ >= mb, F.concat(floor_3_significant(bytes_, mb), F.lit(" MB"))).otherwise(F.concat(floor_3_significant(bytes_, 1024), F.lit(" KB")))


def pretty_size(bytes_: Column) -> Column:
    """(x.xx KB) cut to two, one or no decimals as the number grows."""
    out = None
    for unit, scale in (("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        text = F.concat(F.lit("("), floor_3_significant(bytes_, scale), F.lit(f" {unit})"))
        out = F.when(bytes_ >= scale, text) if out is None else out.when(bytes_ >= scale, text)
    return out.otherwise(F.concat(F.lit("("), bytes_.cast("string"), F.lit(" B)")))


def circular_u16(delta: Column) -> Column:
    """A difference modulo 65536, as a signed number."""
    low = F.pmod(delta, F.lit(65536).cast("long"))
    return F.when(low >= 32768, low - 65536).otherwise(low)


def string_cost(text: Column) -> Column:
    """Bytes of a length-prefixed string."""
    n = F.octet_length(text).cast("long")
    return n + varint_length(n)
