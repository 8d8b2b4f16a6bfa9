"""Secret scans with DataFrame functions only: three base patterns and a randomness test battery.

Base kinds are pattern matches (assign, access, hex). The method looks at maximal runs of 20 or more key characters that hold
a digit and a letter, infers the narrowest encoding that the run fits (hex, base32, base36, base62, base64), and computes
- a chi-squared test of alphabet uniformity, a runs test about the alphabet's middle and a lag-1 serial-correlation test,
  joined by Fisher's method into the probability of so uneven a run among random ones, and
- the probability of so random a run among natural identifiers, from the log-likelihood ratio of the encoding's uniform
  distribution against letter frequencies of prose.
Both are controlled for false discoveries by Benjamini-Hochberg steps over the whole table, within each class of length, as
short runs carry less evidence and mustn't ride on long ones: a run is reported where the natural hypothesis is rejected at a
rate of FDR and the battery's own probability is not among those rejected at a rate of UNEVEN. (The battery alone tells what
isn't random; that a run isn't a name needs the second hypothesis, or names too short for the battery would be reported.)
Ranks come from a histogram of quantised probabilities, so no run leaves its executor.

Positions: the pieces between matches and the matches themselves have known lengths in code points; their prefix sums, taken
in blocks, give starts and ends.

Defined cases: a null text counts as empty and has no spans; runs that overlap a base span aren't reported again; repeated
rows each get a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import shared

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs, so that asking for the least length at once finds the same matches as dropping shorter ones later.
ACCESS, HEX, RUN = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
FDR, UNEVEN, BLOCK = 0.01, 0.01, 256
#: Upper bounds of the length classes within which false discoveries are controlled.
LENGTH_CLASSES = (24, 32, 48)
#: Steps of the quantised natural log of a probability.
GRID, GRID_END = 20, 60 * 20

_ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Per mille frequencies of a-z in English prose.
_LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))


def _natural(c: str) -> float:
    """Share of a character in natural identifiers: mostly small letters, some capitals, digits and joints."""
    if c.islower():
        return 0.80 * _LETTERS[c] / 1003
    if c.isupper():
        return 0.08 * _LETTERS[c.lower()] / 1003
    return 0.10 / 10 if c.isdigit() else 0.01


def _model(name: str) -> tuple[dict[str, float], float, float]:
    """Log ratio of uniform to natural for each character; its mean and deviation among natural characters."""
    letters = _ALPHABETS[name]
    total = sum(map(_natural, letters))
    ratio = {c: math.log(total / len(letters) / _natural(c)) for c in letters}
    mean = sum(_natural(c) / total * r for c, r in ratio.items())
    return ratio, mean, math.sqrt(sum(_natural(c) / total * r * r for c, r in ratio.items()) - mean * mean)


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern.replace('"', r"\x22") + '"'


def _spans(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, m>>: start and end in code points and the text of every match."""
    pieces = f"split({text}, {_sql(pattern)}, -1)"
    matches = f"regexp_extract_all({text}, {_sql(pattern)}, 0)"
    gaps = f"transform({pieces}, x -> length(x))"
    # with(...) by nested one-element transforms: each expensive array is computed once
    return f"""flatten(transform(array(struct({gaps} AS g, {matches} AS m)), a ->
      flatten(transform(array(transform(a.m, (x, i) -> length(x) + a.g[i])), t ->
        flatten(transform(array(transform(sequence(0, greatest(size(t) - 1, 0) div {BLOCK}), b -> aggregate(slice(t, b * {BLOCK} + 1, {BLOCK}), 0L, (p, q) -> p + q))), u ->
          transform(a.m, (x, i) -> struct(
            aggregate(slice(u, 1, i div {BLOCK}), 0L, (p, q) -> p + q) + aggregate(slice(t, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, (p, q) -> p + q) + a.g[i] AS s,
            aggregate(slice(u, 1, i div {BLOCK}), 0L, (p, q) -> p + q) + aggregate(slice(t, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (p, q) -> p + q) AS e,
            x AS m))))))))"""


_NONE = "CAST(array() AS array<struct<s: bigint, e: bigint, m: string>>)"


def _upper_tail(z: str) -> str:
    """SQL for the normal upper tail by a rational approximation, accurate to 1e-7 and never 0."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = f"{t} * (0.31938153D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    tail = f"greatest(1e-300D, 0.3989422804014327D * exp(-least({z} * {z}, 1300D) / 2) * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def _battery(runs: DataFrame) -> DataFrame:
    """Adds p_random and p_natural to rows with a run (columns run, and whatever else)."""
    inferred = F.expr(
        r"""CASE WHEN run RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN run RLIKE '^[A-Z2-7]+=*$' THEN 'base32'
        WHEN run RLIKE '^([0-9a-z]+|[0-9A-Z]+)$' THEN 'base36' WHEN run RLIKE '^[0-9A-Za-z]+$' THEN 'base62' ELSE 'base64' END"""
    )
    out = runs.withColumn("encoding", inferred)
    per: dict[str, str] = {"letters": "", "mean": "", "dev": "", "ratio": ""}
    for name, letters in _ALPHABETS.items():
        ratio, mean, dev = _model(name)
        values = ", ".join(f"{r!r}D" for r in ratio.values())
        for k, v in (("letters", f"'{letters}'"), ("mean", f"{mean!r}D"), ("dev", f"{dev!r}D"), ("ratio", f"array({values})")):
            per[k] += f" WHEN encoding = '{name}' THEN {v}"
    for k, v in per.items():
        out = out.withColumn(k, F.expr(f"CASE{v} END"))
    folded = "CASE WHEN encoding = 'base32' THEN regexp_replace(run, '=', '') WHEN encoding IN ('hex', 'base36') THEN lower(run) ELSE translate(regexp_replace(run, '=', ''), '-_', '+/') END"
    out = out.withColumn("v", F.expr(f"transform(filter(split({folded}, ''), c -> c <> ''), c -> instr(letters, c) - 1)"))
    out = out.withColumn("n", F.expr("CAST(size(v) AS double)")).withColumn("a", F.expr("length(letters)")).withColumn("cells", F.expr("CASE WHEN n < 40 THEN 4 ELSE 8 END"))
    out = out.withColumn("chi", F.expr("aggregate(transform(sequence(0, cells - 1), k -> size(filter(v, x -> (x * cells) div a = k)) - n / cells), 0D, (p, x) -> p + x * x) * cells / n"))
    out = out.withColumn("n1", F.expr("CAST(size(filter(v, x -> 2 * x >= a)) AS double)")).withColumn("avg", F.expr("aggregate(v, 0D, (p, x) -> p + x) / n"))
    pairs = "sequence(0, greatest(size(v) - 2, 0))"
    out = out.withColumn("changes", F.expr(f"size(filter({pairs}, i -> (2 * v[i] >= a) <> (2 * v[i + 1] >= a)))"))
    out = out.withColumn("lag", F.expr(f"aggregate({pairs}, 0D, (p, i) -> p + (v[i] - avg) * (v[i + 1] - avg)) / greatest(1e-9D, aggregate(v, 0D, (p, x) -> p + (x - avg) * (x - avg)))"))
    out = out.withColumn("llr", F.expr("aggregate(v, 0D, (p, x) -> p + ratio[x])"))
    df = "(cells - 1)"
    z_chi = f"((power(chi / {df}, 1 / 3D) - (1 - 2D / (9 * {df}))) / sqrt(2D / (9 * {df})))"
    middle = "(2 * n1 * (n - n1) / n)"
    z_runs = f"((changes - {middle}) / sqrt(greatest(1e-9D, {middle} * ({middle} - 1) / (n - 1))))"
    out = out.withColumn("z_chi", F.expr(z_chi)).withColumn("z_runs", F.expr(f"abs(CASE WHEN n1 = 0 OR n1 = n THEN 9D ELSE {z_runs} END)"))
    out = out.withColumn("z_lag", F.expr("abs(lag * sqrt(n) + 1 / sqrt(n))")).withColumn("z_nat", F.expr("(llr - n * mean) / (dev * sqrt(n))"))
    y = f"-(ln({_upper_tail('z_chi')}) + ln(least(1D, 2 * {_upper_tail('z_runs')})) + ln(least(1D, 2 * {_upper_tail('z_lag')})))"
    out = out.withColumn("y", F.expr(y)).withColumn("p_random", F.expr("exp(-y) * (1 + y + y * y / 2)")).withColumn("p_natural", F.expr(_upper_tail("z_nat")))
    return out.drop("letters", "mean", "dev", "ratio", "v", "n", "a", "cells", "chi", "n1", "avg", "changes", "lag", "llr", "z_chi", "z_runs", "z_lag", "z_nat", "y")


def _quantised(p: str) -> str:
    """SQL for the quantised -ln of a probability: exp(-grid / GRID) bounds it from above."""
    return f"CAST(least({GRID_END}, floor(-{GRID} * ln(greatest({p}, 1e-300D)))) AS int)"


def _thresholds(tested: DataFrame, grid: str, rate: float, name: str) -> DataFrame:
    """Per length class the least quantised -ln p that Benjamini-Hochberg rejects (column name): one row a class."""
    counts = tested.groupBy("len_class", grid).agg(F.count("*").alias("c"))  # at most GRID_END + 1 rows a class
    ranked = counts.selectExpr(
        "len_class", grid, f"sum(c) OVER (PARTITION BY len_class ORDER BY {grid} DESC) AS rank", "sum(c) OVER (PARTITION BY len_class) AS tests"
    )
    cut = F.min(F.when(F.expr(f"exp(-{grid} / {GRID}D) <= {rate} * rank / tests"), F.col(grid)))
    return ranked.groupBy("len_class").agg(F.coalesce(cut, F.lit(GRID_END + 1)).alias(name))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "long") -> DataFrame:
    """Spans of secrets in every text: doc_id (the key as kind), row (a number of the input row), base and found, arrays of (s, ord, e).

    ord is the index of the span's kind in KINDS; both arrays are sorted by s, then ord; s and e are code points.
    """
    spark = docs.sparkSession
    folder = shared.work_folder(spark)
    base = docs.select(F.col(key).cast(kind).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("row", F.monotonically_increasing_id())
    small = base.withColumn("low", F.lower("t"))
    named = " OR ".join(f"contains(low, '{w}')" for w in NAMES)
    scanned = small.selectExpr(
        "doc_id", "row",
        f"CASE WHEN {named} THEN {_spans('t', ASSIGN)} ELSE {_NONE} END AS assigns",
        f"CASE WHEN contains(t, 'AKIA') THEN {_spans('t', ACCESS)} ELSE {_NONE} END AS accesses",
        f"CASE WHEN t RLIKE {_sql(HEX)} THEN {_spans('t', HEX)} ELSE {_NONE} END AS hexes",
        f"CASE WHEN t RLIKE {_sql(RUN)} THEN {_spans('t', RUN)} ELSE {_NONE} END AS runs",
    )
    kept = scanned.selectExpr(
        "doc_id", "row",
        "filter(runs, x -> x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]') AS runs",
        f"""array_sort(concat(
          transform(filter(assigns, x -> length(regexp_extract(x.m, {_sql(ASSIGN)}, 2)) >= 6), x -> struct(x.s AS s, 0 AS ord, x.e AS e)),
          transform(accesses, x -> struct(x.s AS s, 1 AS ord, x.e AS e)), transform(hexes, x -> struct(x.s AS s, 2 AS ord, x.e AS e)))) AS base""",
    )
    kept = shared.staged(kept, folder, "scanned")  # the texts are read once; what follows is a few runs a document
    runs = kept.where("size(runs) > 0").select("row", "base", F.explode("runs").alias("x")).where("NOT exists(base, b -> b.s < x.e AND x.s < b.e)")
    classes = " ".join(f"WHEN x.e - x.s < {n} THEN {i}" for i, n in enumerate(LENGTH_CLASSES))
    tested = _battery(runs.selectExpr("row", "x.s AS s", "x.e AS e", "x.m AS run", f"CASE {classes} ELSE {len(LENGTH_CLASSES)} END AS len_class"))
    tested = tested.withColumn("natural_grid", F.expr(_quantised("p_natural"))).withColumn("random_grid", F.expr(_quantised("p_random")))
    tested = shared.staged(tested.select("row", "s", "e", "len_class", "natural_grid", "random_grid"), folder, "tested")
    cuts = _thresholds(tested, "natural_grid", FDR, "cut").join(_thresholds(tested, "random_grid", UNEVEN, "uneven"), "len_class")
    found = tested.join(F.broadcast(cuts), "len_class").where("natural_grid >= cut AND random_grid < uneven")  # cuts: one row a length class
    per_row = found.groupBy("row").agg(F.collect_list(F.struct("s", F.lit(3).alias("ord"), "e")).alias("random"))  # as many as the row's own runs
    none = "CAST(array() AS array<struct<s: bigint, ord: int, e: bigint>>)"
    return kept.select("doc_id", "row", "base").join(per_row, "row", "left").selectExpr("doc_id", "row", "base", f"array_sort(concat(base, coalesce(random, {none}))) AS found")


def _written(column: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, x -> concat(array({kinds})[x.ord], ':', x.s, ':', x.e)), ',')"


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans per document, of the whole table."""
    return scan(shared.table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", *(f"CAST(size(filter(base, x -> x.ord = {i})) AS bigint) AS n_{k}" for i, k in enumerate(KINDS[:3])),
        f"sha2({_written('base')}, 256) AS base_sha256", f"{_written('found')} AS spans",
    )


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of a secret replaced by mask; overlapping spans become one mask.

    The text is cut up by code points with DataFrame functions. Rows that can't have a span pass through; others meet their
    spans by the text's 128-bit digest: equal texts have equal spans.
    """
    h, found = shared.fresh(docs, "h", "found")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = " OR ".join(f"contains(lower(`{text}`), '{w}')" for w in NAMES)
    maybe = F.expr(f"coalesce({named} OR contains(`{text}`, 'AKIA') OR `{text}` RLIKE {_sql(HEX)} OR `{text}` RLIKE {_sql(RUN)}, false)")  # else no span
    rows = shared.staged(docs.where(maybe).withColumn(h, F.md5(value)), shared.work_folder(docs.sparkSession), "maybe")  # few: their texts are met again
    spans = scan(rows.select(h, text), h, text, "string").where("size(found) > 0").groupBy(F.col("doc_id").alias(h)).agg(F.first("found").alias(found))
    # merge: a span is kept as (s, e) where it starts after all ends before it; its end is that of the last it touches
    merged = f"""aggregate(`{found}`, CAST(array() AS array<struct<s: bigint, e: bigint>>), (acc, x) ->
      CASE WHEN size(acc) > 0 AND x.s < acc[size(acc) - 1].e
        THEN concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].s AS s, greatest(acc[size(acc) - 1].e, x.e) AS e)))
        ELSE concat(acc, array(struct(x.s AS s, x.e AS e))) END)"""
    out = rows.join(spans, h, "left").withColumn(found, F.expr(f"CASE WHEN `{found}` IS NULL THEN NULL ELSE {merged} END"))
    pieces = f"""concat_ws('', transform(sequence(0, size(`{found}`)), i -> concat(
      CASE WHEN i = 0 THEN '' ELSE '{mask}' END,
      substring(`{text}`, CAST(CASE WHEN i = 0 THEN 1 ELSE `{found}`[i - 1].e + 1 END AS int),
        CAST(CASE WHEN i = size(`{found}`) THEN 2147483647 ELSE `{found}`[i].s - CASE WHEN i = 0 THEN 0 ELSE `{found}`[i - 1].e END END AS int)))))"""
    out = out.withColumn(text, F.expr(f"CASE WHEN `{found}` IS NULL THEN `{text}` ELSE {pieces} END"))
    return docs.where(~maybe).unionByName(out.select(*docs.columns))
