"""Typed value kinds: a forward Column from text to latent integers and layout, and the inverse Column.

A kind applies to a value only where its inverse gives the text back; other values take the exception route as plain text.
Latents are LONG arrays, so that every kind can be stored, differenced and counted alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import values as V


class Kind(NamedTuple):
    name: str
    pattern: str
    forward: Callable[[Column], list[Column]]  #: latents of a matching text
    inverse: Callable[[list[Column]], Column]
    taken: Callable[..., list[Column]]  #: latents of the groups of a match
    groups: int


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _pad(c: Column, width: int | Column) -> Column:
    text = c.cast("string")
    if isinstance(width, int):
        return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return F.concat(F.repeat(F.lit("0"), (width - F.length(text)).cast("int")), text)


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, i + 1) for i in range(n)]


_TIME = "([0-9]{2}):([0-9]{2}):([0-9]{2})"


def _seconds(h: Column, m: Column, s: Column) -> Column:
    return _long(h) * 3600 + _long(m) * 60 + _long(s)


def _kind(name: str, pattern: str, n: int, forward: Callable[..., list[Column]], inverse: Callable[[list[Column]], Column]) -> Kind:
    return Kind(name, f"^{pattern}$", lambda t: forward(*_groups(t, f"^{pattern}$", n)), inverse, forward, n)


def _all_groups(text: Column, kind: Kind) -> Column:
    """The groups of a matching text by one search; no pattern matches the separator."""
    return F.split(F.regexp_replace(text, kind.pattern, "\x1f".join(f"${i + 1}" for i in range(kind.groups))), "\x1f", -1)


def _octet_mask(parts: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for i, p in enumerate(parts):
        out = out + (F.length(p) - 1).cast("long") * (1 << 2 * i)
    return out


def _hex_case(t: Column) -> Column:
    return F.when(t.rlike("[A-F]"), 1).otherwise(0).cast("long")


def _hex_text(v: Column, width: Column, upper: Column) -> Column:
    h = F.hex(v)
    padded = F.concat(F.repeat(F.lit("0"), (width - F.length(h)).cast("int")), h)
    return F.when(upper == 1, padded).otherwise(F.lower(padded))


def _month_names(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in V.MONTHS]), month.cast("int"))


def _day_number(y: Column, m: Column, d: Column) -> Column:
    return F.unix_date(F.try_to_date(F.concat_ws("-", y, _pad(m, 2), _pad(d, 2)), "yyyy-MM-dd")).cast("long")


_DAY = lambda n: F.date_from_unix_date(n.cast("int"))

WEEKDAYS, UNITS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), ("B", "KB", "MB", "GB", "TB")


def _unit(u: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, UNITS)), u).cast("long")


def _weekday(w: Column) -> Column:
    """As written, which may not be the date's own."""
    return F.array_position(F.array(*map(F.lit, WEEKDAYS)), w).cast("long")


KINDS: tuple[Kind, ...] = (
    _kind("int_width", "([0-9]{1,18})", 1, lambda a: [_long(a), F.length(a).cast("long")], lambda x: _pad(x[0], x[1])),
    _kind("signed_int", "(-?(?:0|[1-9][0-9]{0,17}))", 1, lambda a: [_long(a)], lambda x: x[0].cast("string")),
    _kind("decimal", "([0-9]{1,9})[.]([0-9]{1,9})", 2, lambda a, b: [_long(F.concat(a, b)), F.length(a).cast("long"), F.length(b).cast("long")], lambda x: F.concat(F.substring(_pad(x[0], x[1] + x[2]), F.lit(1), x[1].cast("int")), F.lit("."), F.substring(_pad(x[0], x[1] + x[2]), (x[1] + 1).cast("int"), x[2].cast("int")))),
    _kind("hms", _TIME, 3, lambda h, m, s: [_seconds(h, m, s)], lambda x: V.hms_text(x[0])),
    _kind("day_hms", "([0-9]{1,9}) " + _TIME, 4, lambda d, h, m, s: [_long(d) * 86400 + _seconds(h, m, s), F.length(d).cast("long")], lambda x: F.concat(_pad(F.floor(x[0] / 86400), x[1]), F.lit(" "), V.hms_text(x[0] % 86400))),
    _kind("month_day_hms", "([0-9]{2})[.]([0-9]{2}) " + _TIME, 5, lambda mo, d, h, m, s: [_long(mo) * 100 + _long(d), _seconds(h, m, s)], lambda x: F.concat(_pad(F.floor(x[0] / 100), 2), F.lit("."), _pad(x[0] % 100, 2), F.lit(" "), V.hms_text(x[1]))),
    _kind("iso_datetime", "([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]" + _TIME, 6, lambda y, mo, d, h, m, s: [_day_number(y, mo, d) * 86400 + _seconds(h, m, s)], lambda x: F.concat(_DAY(F.floor(x[0] / 86400)).cast("string"), F.lit(" "), V.hms_text(F.pmod(x[0], F.lit(86400).cast("long"))))),
    _kind("packed_datetime", "([0-9]{4})([0-9]{2})([0-9]{2})-([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,3})", 7, lambda y, mo, d, h, m, s, f: [_day_number(y, mo, d) * 86400000 + _seconds(h, m, s) * 1000 + _long(f), F.length(h) + F.length(m) * 4 + F.length(s) * 16 + F.length(f).cast("long") * 64], lambda x: F.concat(F.date_format(_DAY(F.floor(x[0] / 86400000)), "yyyyMMdd"), F.lit("-"), _pad(F.floor(x[0] / 3600000) % 24, x[1] % 4), F.lit(":"), _pad(F.floor(x[0] / 60000) % 60, F.floor(x[1] / 4) % 4), F.lit(":"), _pad(F.floor(x[0] / 1000) % 60, F.floor(x[1] / 16) % 4), F.lit(":"), _pad(x[0] % 1000, F.floor(x[1] / 64)))),
    _kind("syslog", "([A-Z][a-z]{2})( {1,2})([0-9]{1,2}) " + _TIME, 6, lambda mo, sp, d, h, m, s: [V._month_case(mo, tuple(range(1, 13))).cast("long") * 100 + _long(d), _seconds(h, m, s), F.length(sp) * 4 + F.length(d).cast("long")], lambda x: F.concat(_month_names(F.floor(x[0] / 100)), F.repeat(F.lit(" "), F.floor(x[2] / 4).cast("int")), _pad(x[0] % 100, x[2] % 4), F.lit(" "), V.hms_text(x[1]))),
    _kind("apache_time", "\\[([0-9]{2})/([A-Z][a-z]{2})/([0-9]{4}):" + _TIME + " ([+-])([0-9]{4})\\]", 8, lambda d, mo, y, h, m, s, sg, z: [_day_number(y, V._month_case(mo, tuple(range(1, 13))), d) * 86400 + _seconds(h, m, s), F.when(sg == "-", -1).otherwise(1) * (_long(z) + 10000)], lambda x: F.concat(F.lit("["), F.date_format(_DAY(F.floor(x[0] / 86400)), "dd"), F.lit("/"), _month_names(F.month(_DAY(F.floor(x[0] / 86400)))), F.lit("/"), F.date_format(_DAY(F.floor(x[0] / 86400)), "yyyy"), F.lit(":"), V.hms_text(F.pmod(x[0], F.lit(86400).cast("long"))), F.when(x[1] < 0, " -").otherwise(" +"), _pad(F.abs(x[1]) - 10000, 4), F.lit("]"))),
    _kind("colon_duration", "([0-9]{1,6}):([0-9]{2})", 2, lambda m, s: [_long(m) * 60 + _long(s), F.length(m).cast("long")], lambda x: F.concat(_pad(F.floor(x[0] / 60), x[1]), F.lit(":"), _pad(x[0] % 60, 2))),
    _kind("hex_width", "([0-9a-fA-F]{1,15})", 1, lambda a: [_long(F.conv(a, 16, 10)), F.length(a).cast("long"), _hex_case(a)], lambda x: _hex_text(*x)),
    _kind("hex_pair", "0x([0-9a-fA-F]{1,15})/0x([0-9a-fA-F]{1,15})", 2, lambda a, b: [_long(F.conv(a, 16, 10)), F.length(a).cast("long"), _hex_case(a), _long(F.conv(b, 16, 10)), F.length(b).cast("long"), _hex_case(b)], lambda x: F.concat(F.lit("0x"), _hex_text(*x[:3]), F.lit("/0x"), _hex_text(*x[3:]))),
    _kind("ipv4_width", "([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})", 4, lambda *p: [*map(_long, p), _octet_mask(list(p))], lambda x: F.concat_ws(".", *[_pad(x[i], F.floor(x[4] / (1 << 2 * i)) % 4 + 1) for i in range(4)])),
    _kind("endpoint", "([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3}):([0-9]{1,5})", 5, lambda a, b, c, d, p: [((_long(a) * 256 + _long(b)) * 256 + _long(c)) * 256 + _long(d), _long(p)], lambda x: F.concat(V.ipv4_text(x[0]), F.lit(":"), x[1].cast("string"))),
    _kind("byte_phrase", "([0-9]{1,15}) bytes(?: [(]([0-9.]+ [KM]B)[)])?", 2, lambda n, s: [_long(n), F.when(s == "", 0).otherwise(1).cast("long")], lambda x: F.concat(x[0].cast("string"), F.lit(" bytes"), F.when(x[1] == 1, F.concat(F.lit(" ("), V.byte_phrase_suffix(x[0]), F.lit(")"))).otherwise(""))),
    _kind("int_tuple", "([0-9]{1,17}),([0-9]{1,17}),([0-9]{1,17})", 3, lambda *p: [*map(_long, p)], lambda x: F.concat_ws(",", *[v.cast("string") for v in x])),
    _kind("asctime_year", f"({'|'.join(WEEKDAYS)}) ([A-Z][a-z]{{2}})( +)([0-9]{{1,2}}) {_TIME} ([0-9]{{4}})", 8, lambda w, mo, sp, d, h, m, s, y: [_day_number(y, V._month_case(mo, tuple(range(1, 13))), d) * 86400 + _seconds(h, m, s), F.length(sp) * 4 + F.length(d).cast("long"), _weekday(w)], lambda x: F.concat(F.element_at(F.array(*map(F.lit, WEEKDAYS)), x[2].cast("int")), F.lit(" "), _month_names(F.month(_DAY(F.floor(x[0] / 86400)))), F.repeat(F.lit(" "), F.floor(x[1] / 4).cast("int")), _pad(F.dayofmonth(_DAY(F.floor(x[0] / 86400))), x[1] % 4), F.lit(" "), V.hms_text(F.pmod(x[0], F.lit(86400).cast("long"))), F.lit(" "), F.date_format(_DAY(F.floor(x[0] / 86400)), "yyyy"))),
    _kind("yy_datetime", "([0-9]{2})/([0-9]{2})/([0-9]{2}) " + _TIME, 6, lambda y, mo, d, h, m, s: [_day_number(F.concat(F.when(y < "69", "20").otherwise("19"), y), mo, d) * 86400 + _seconds(h, m, s)], lambda x: F.concat(F.date_format(_DAY(F.floor(x[0] / 86400)), "yy/MM/dd"), F.lit(" "), V.hms_text(F.pmod(x[0], F.lit(86400).cast("long"))))),
    _kind("iso_millis", "([0-9]{4})-([0-9]{2})-([0-9]{2}) " + _TIME + "([,.])([0-9]{3})", 8, lambda y, mo, d, h, m, s, p, f: [(_day_number(y, mo, d) * 86400 + _seconds(h, m, s)) * 1000 + _long(f), F.when(p == ",", 0).otherwise(1).cast("long")], lambda x: F.concat(_DAY(F.floor(x[0] / 86400000)).cast("string"), F.lit(" "), V.hms_text(F.floor(F.pmod(x[0], F.lit(86400000).cast("long")) / 1000)), F.when(x[1] == 0, ",").otherwise("."), _pad(F.pmod(x[0], F.lit(1000).cast("long")), 3))),
    _kind("scaled_unit", "([0-9]{1,16})[.]([0-9]) (B|KB|MB|GB|TB)", 3, lambda a, b, u: [_long(a) * 10 + _long(b), _unit(u)], lambda x: F.concat(F.floor(x[0] / 10).cast("string"), F.lit("."), (x[0] % 10).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), x[1].cast("int")))),
    _kind("integer_unit", "([0-9]{1,17})(MB|GB)", 2, lambda a, u: [_long(a), _unit(u)], lambda x: F.concat(x[0].cast("string"), F.element_at(F.array(*map(F.lit, UNITS)), x[1].cast("int")))),
    _kind("affixed_int", "(?:blk_)(-?[0-9]{1,18})", 1, lambda a: [_long(a)], lambda x: F.concat(F.lit("blk_"), x[0].cast("string"))),
)


def coded(rows: DataFrame, kind: Kind, column: str) -> DataFrame:
    """Adds latents (null on the exception route) and exception (null where the kind is exact)."""
    text = F.col(column)
    with_latents = rows.withColumn("latents", F.when(text.rlike(kind.pattern), F.array(*[x.cast("long") for x in kind.forward(text)])))
    n = len(kind.forward(F.lit("")))
    back = kind.inverse([F.get("latents", F.lit(i)) for i in range(n)])
    exact = F.coalesce(F.forall("latents", lambda x: x.isNotNull()) & (back == text), F.lit(False))
    return with_latents.withColumn("exception", F.when(~exact, text)).withColumn("latents", F.when(F.col("exception").isNull(), F.col("latents")))


def decoded(rows: DataFrame, kind: Kind, column: str) -> DataFrame:
    """The text again, from latents and exception."""
    n = len(kind.forward(F.lit("")))
    inverse = kind.inverse([F.get("latents", F.lit(i)) for i in range(n)])
    return rows.withColumn(column, F.coalesce("exception", F.when(F.col("latents").isNotNull(), inverse)))


AT_ONCE = 1


def measured(texts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Kinds over columns of texts: kind, n, exact (values held exactly), first (sum of their first latent), mismatches after the inverse.

    The sum is a decimal: milliseconds since 1970 of six million values pass 64 bits. A pass takes AT_ONCE kinds: methods
    that hold the code of more are too long for the JVM to compile, and run interpreted.
    """
    chosen = [(i, k, columns[k.name]) for i, k in enumerate(KINDS) if k.name in columns]
    if len(chosen) > AT_ONCE:
        names = [k.name for _, k, _ in chosen]
        passes = [measured(texts, {n: columns[n] for n in names[a : a + AT_ONCE]}) for a in range(0, len(names), AT_ONCE)]
        return reduce(DataFrame.unionByName, passes)
    texts = texts.select(*dict.fromkeys(c for _, _, c in chosen))
    cut = texts.select("*", *[F.when(F.col(c).rlike(k.pattern), _all_groups(F.col(c), k)).alias(f"g{i}") for i, k, c in chosen])  # once, for all latents
    coded_ = cut.select("*", *[F.when(F.col(f"g{i}").isNotNull(), F.array(*[x.cast("long") for x in k.taken(*[F.get(f"g{i}", F.lit(j)) for j in range(k.groups)])])).alias(f"l{i}") for i, k, _ in chosen])
    back = coded_.select("*", *[k.inverse([F.get(f"l{i}", F.lit(j)) for j in range(len(k.forward(F.lit(""))))]).alias(f"b{i}") for i, k, _ in chosen])
    flags = back.select("*", *[F.coalesce(F.forall(f"l{i}", lambda x: x.isNotNull()) & (F.col(f"b{i}") == F.col(c)), F.lit(False)).alias(f"x{i}") for i, _, c in chosen])
    restored = lambda i, c: F.when(F.col(f"x{i}"), F.col(f"b{i}")).otherwise(F.col(c))
    sums = [
        F.struct(F.lit(k.name).alias("kind"), F.count("*").alias("n"), F.count_if(f"x{i}").alias("exact"), F.sum(F.when(F.col(f"x{i}"), F.get(f"l{i}", F.lit(0))).cast("decimal(20,0)")).alias("first"), F.count_if(~restored(i, c).eqNullSafe(F.col(c))).alias("mismatches")).alias(f"s{i}")
        for i, k, c in chosen
    ]
    return flags.agg(*sums).select(F.explode(F.array(*[F.col(f"s{i}") for i, _, _ in chosen])).alias("s")).select("s.*")


def best_kind(values: DataFrame, column: str) -> DataFrame:
    """How many values each kind holds exactly: kind, n, exact; the basis of a choice. Few passes over the values."""
    return measured(values.select(column), {k.name: column for k in KINDS}).select("kind", "n", "exact")
