"""Lines, ordered field extraction and its inverse.

A plan is an ordered tuple of fields; each field's pattern has one group that is stored, the rest of the match stays in the
text around a placeholder. The k-th placeholder of a tag in a line stands for the line's k-th stored value.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import signatures as G
from tracewright.functions import tokens as T


class Field(NamedTuple):
    tag: str
    before: str  #: pattern before the stored part, without groups
    stored: str  #: pattern of the stored part, without groups
    after: str = ""

    @property
    def pattern(self) -> str:
        return f"({self.before})({self.stored})({self.after})"


#: Placeholders are in a private-use range, which no record may hold.
def placeholder(i: int) -> str:
    return chr(0xE000 + i)


URL_PLAN = (Field("host", "://", "[^/?#]+"), Field("lang", "/", "[a-z]{2}", "/"), Field("num", "", "[0-9]+"))

_RISKY = re.compile(r"\([^)]*[+*][^)]*\)[+*]|\\[1-9]|\(\?P=")


def check_plan(plan: tuple[Field, ...]) -> list[str]:
    """Reasons why a plan isn't accepted: too long, nested quantifiers, back references, groups, repeated tags, matches of the empty text."""
    reasons = []
    tags = [f.tag for f in plan]
    for f in plan:
        if len(f.pattern) > 260:
            reasons.append(f"{f.tag}: pattern over 260 characters")
        if _RISKY.search(f.before + f.stored + f.after):
            reasons.append(f"{f.tag}: nested quantifier or back reference")
        try:
            if re.compile(f.pattern).groups != 3:
                reasons.append(f"{f.tag}: groups of its own")
            elif re.fullmatch(f.stored, ""):
                reasons.append(f"{f.tag}: matches nothing")
        except re.error as e:
            reasons.append(f"{f.tag}: {e}")
        if tags.count(f.tag) > 1:
            reasons.append(f"{f.tag}: repeated tag")
    return reasons


def split_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per LF-ended record: line_no from 0, line without its LF. A text that ends in LF has an empty last line, so joining by LF restores it."""
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def apply_plan(lines: DataFrame, plan: tuple[Field, ...]) -> tuple[DataFrame, DataFrame]:
    """Coded lines (line_no, text) and occurrences (line_no, tag, pos, value), by one pass of column expressions."""
    if reasons := check_plan(plan):
        raise ValueError("; ".join(reasons))
    text, stored = F.col("text"), []
    for i, f in enumerate(plan):
        stored.append(F.struct(F.lit(f.tag).alias("tag"), F.regexp_extract_all(text, F.lit(f.pattern), F.lit(2)).alias("values")))
        text = F.regexp_replace(text, f.pattern, f"$1{placeholder(i)}$3")
    coded = lines.select("line_no", text.alias("text"), F.array(*stored).alias("stored"))
    each = coded.select("line_no", F.explode("stored").alias("s")).select("line_no", "s.tag", F.posexplode("s.values").alias("pos", "value"))
    return coded.select("line_no", "text"), each


def restore_plan(coded: DataFrame, occurrences: DataFrame, plan: tuple[Field, ...]) -> DataFrame:
    """The original lines: the k-th placeholder of each tag becomes its k-th value, last field first."""
    per_line = occurrences.groupBy("line_no", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
    wide = per_line.groupBy("line_no").pivot("tag", [f.tag for f in plan]).agg(F.first("v"))
    out = coded.join(wide, "line_no", "left")
    text = F.col("text")
    for i, f in reversed(list(enumerate(plan))):
        parts = F.split(text, placeholder(i), -1)
        values = F.coalesce(F.col(f.tag), F.array().cast("array<string>"))
        led = F.concat(F.array(F.lit("")), values)  # what stands before each part
        out = out.withColumn("text", F.array_join(F.zip_with(led, parts, lambda v, p: F.concat(v, p)), ""))
        text = F.col("text")
    return out.select("line_no", "text")


def first_span(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Code-point span of the first match in each row that has one: key, start, end."""
    at = F.regexp_instr(F.col(text), F.lit(pattern)) - 1
    return rows.where(F.col(text).rlike(pattern)).select(key, at.alias("start"), (at + F.length(F.regexp_extract(text, pattern, 1))).alias("end"))


def json_pairs(rows: DataFrame, column: str) -> DataFrame:
    """Key and value of every member of flat JSON objects."""
    return rows.select("*", F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def overlap_pairs(spans: DataFrame, key: str = "line_no", rule: str = "rule", share: float = 0.1) -> DataFrame:
    """Pairs of rules whose spans (start, end) meet in at least a share of the smaller rule's lines: rule_a, rule_b, hits.

    A range join inside each line, by the line's key.
    """
    a, b = spans.alias("a"), spans.alias("b")
    meet = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{rule}") < F.col(f"b.{rule}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    hits = a.join(b, meet).groupBy(F.col(f"a.{rule}").alias("rule_a"), F.col(f"b.{rule}").alias("rule_b")).agg(F.countDistinct(F.col(f"a.{key}")).alias("hits"))
    sizes = spans.groupBy(rule).agg(F.countDistinct(key).alias("n"))
    out = hits.join(sizes.select(F.col(rule).alias("rule_a"), F.col("n").alias("na")), "rule_a").join(sizes.select(F.col(rule).alias("rule_b"), F.col("n").alias("nb")), "rule_b")
    return out.where(F.col("hits") >= share * F.least("na", "nb")).select("rule_a", "rule_b", "hits")


def routed_tokens(lines: DataFrame) -> DataFrame:
    """Variable tokens of lines by the tag of their stream: t, tag, cnt. A token is variable where it has a digit or a special character.

    Integers of one or two digits go by length; longer ones by the last other token before them in the line, their length and
    their place; mixed ones by that token and their special characters.

    A line is cut at its other tokens, and each run of variable ones between two takes the first as its context: no token
    leaves its line before it is counted.
    """
    words = lines.select(T.words(F.col("line")).alias("w"))
    stable = F.filter(F.transform("w", lambda t, i: F.when(~t.rlike("[^A-Za-z<>]"), i + 1)), lambda i: i.isNotNull())
    found = words.select("w", stable.alias("at"))
    ends = F.concat("at", F.array(F.size("w") + 1))
    gaps = F.filter(F.zip_with(F.concat(F.array(F.lit(0)), "at"), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"] - x["a"] > 1)
    runs = F.transform(gaps, lambda x: F.struct(F.when(x["a"] > 0, F.get("w", x["a"] - 1)).otherwise("").alias("ctx"), x["a"].alias("a"), F.slice("w", x["a"] + 1, x["b"] - x["a"] - 1).alias("run")))
    each = found.select(F.explode(runs).alias("x")).select("x.ctx", "x.a", F.posexplode("x.run").alias("i", "t"))
    t = F.col("t")
    short, pure = t.rlike("^[0-9]{1,2}$"), t.rlike("^[0-9]+$")
    keyed = each.select("t", F.when(short, "").otherwise(F.col("ctx")).alias("ctx"), F.when(pure & ~short, F.col("a") + F.col("i") + 1).alias("p"))
    counted = keyed.groupBy("t", "ctx", "p").agg(F.count("*").alias("c"))
    ctx = F.concat(F.lit("CTX"), F.col("ctx"), F.lit("|STR"))
    tag = (
        F.when(short, F.concat(F.lit("LEN"), F.length(t).cast("string"))).when(pure, F.concat(ctx, G.regex_tag(t), F.lit("|IDX"), F.col("p").cast("string")))
        .otherwise(F.concat(ctx, F.lit("_"), G.special_characters(t)))
    )
    return counted.groupBy("t", tag.alias("tag")).agg(F.sum("c").alias("cnt"))
