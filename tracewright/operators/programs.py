"""Plans as data: guarded replay with fallback, integer expressions and templates, and checks of plans and programs.

Programs are expressions over captured groups, translated into Columns; code is never run. check_program says which rules
a piece of program text breaks, so that a plan from elsewhere can be judged before anything of it is used.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.extract import Field, placeholder


def sample_pattern(sample: str, letters: bool = True, flexible: bool = False) -> str:
    r"""A pattern of a sample's shape: digit runs \d{n} (or \d+), letter runs [A-Za-z]{n}, white space \s+, the rest as it is."""
    out = []
    for m in re.finditer(r"([0-9]+)|([A-Za-z]+)|(\s+)|(.)", sample, re.S):
        digits, word, space, other = m.groups()
        if digits:
            out.append(r"\d+" if flexible else rf"\d{{{len(digits)}}}")
        elif word:
            out.append(rf"[A-Za-z]{{{len(word)}}}" if letters else word)
        else:
            out.append(r"\s+" if space else re.escape(other))
    return "".join(out)


def replacement_is_safe(replacement: str | None) -> bool:
    """Holds {placeholder}, no fields but group0 to group6 beside it, and is at most 180 characters long."""
    if not replacement or len(replacement) > 180:
        return False
    fields = set(re.findall(r"\{([^{}]+)\}", replacement))
    return "placeholder" in fields and fields <= {"placeholder", *(f"group{i}" for i in range(7))}


def broadened(pattern: str) -> tuple[str, str]:
    r"""Widths of digits and spaces let loose, for displays that pad: \d{n} becomes \d+, a space [ ]+. Returns the pattern and what was done.

    Patterns in verbose mode, and those where a loose part would stand within a repeated group, stay as they are.
    """
    if re.compile(pattern).flags & re.X:
        return pattern, "verbose"
    atoms = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{[0-9,]+\}|.", pattern, re.S)
    if any(a == ")" and i + 1 < len(atoms) and (atoms[i + 1] in "*+" or atoms[i + 1][0] == "{") for i, a in enumerate(atoms)):
        return pattern, "repeated group"
    out, i = [], 0
    while i < len(atoms):
        follows = atoms[i + 1] if i + 1 < len(atoms) else ""
        if atoms[i] in (r"\d", "[0-9]") and re.fullmatch(r"\{[1-9][0-9]*(,[0-9]+)?\}", follows):
            out.append(atoms[i] + "+")
            i += 2
        elif atoms[i] == " ":
            n = i
            while n < len(atoms) and atoms[n] == " ":
                n += 1
            loose = n == len(atoms) or atoms[n] not in "+*?" and atoms[n][0] != "{"
            out.append("[ ]+" if loose else " " * (n - i))
            i = n
        else:
            out.append(atoms[i])
            i += 1
    new = "".join(out)
    if re.compile(new).groups != re.compile(pattern).groups:
        return pattern, "groups changed"
    return new, "broadened" if new != pattern else "unchanged"


def lowered(item: dict) -> tuple[dict, str]:
    """A plan item whose whole match is one numeric program, marked as free in its layout and with broadened patterns."""
    program, replacement = item.get("program") or {}, item.get("replacement") or ""
    if item.get("kind") != "open_function" or item.get("store_group") != 0 or program.get("op") != "expression":
        return dict(item), "no numeric program of the whole match"
    before, mark, after = replacement.partition("{placeholder}")
    if not mark or "{" in before + after:
        return dict(item), "no single placeholder between literals"
    pattern, _ = broadened(item["pattern"])
    groups = broadened(program["group_regex"])[0] if program.get("group_regex") else ""
    if pattern == item["pattern"] and groups == program.get("group_regex", ""):
        return dict(item), "unchanged"
    return {**item, "pattern": pattern, "program": {**program, "group_regex": groups, "free_layout": True, "prefix": before, "suffix": after}}, "lowered"


_ALLOWED = (
    ast.Expression, ast.Constant, ast.Name, ast.Load, ast.BinOp, ast.UnaryOp, ast.Add, ast.Sub, ast.Mult, ast.FloorDiv, ast.Mod, ast.LShift, ast.RShift, ast.UAdd, ast.USub, ast.Call,
)


def check_program(text: str, names: set[str]) -> list[str]:
    """Rules that an integer expression breaks; none if it may be used."""
    if len(text) > 400:
        return ["too long"]
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError):
        return ["syntax"]
    broken = []
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            broken.append(f"node {type(node).__name__}")
        elif isinstance(node, ast.Constant) and (type(node.value) is not int or not -(2**62) < node.value < 2**62):
            broken.append("constant")
        elif isinstance(node, ast.Name) and node.id not in names | {"int"}:
            broken.append(f"name {node.id}")
        elif isinstance(node, ast.Call):
            base = node.args[1] if len(node.args) == 2 else ast.Constant(10)
            ok = isinstance(node.func, ast.Name) and node.func.id == "int" and len(node.args) in (1, 2) and not node.keywords
            if not ok or not isinstance(base, ast.Constant) or base.value not in (2, 8, 10, 16):
                broken.append("call")
        elif isinstance(node, ast.BinOp) and isinstance(node.op, (ast.LShift, ast.RShift)) and not (isinstance(node.right, ast.Constant) and type(node.right.value) is int and 0 <= node.right.value < 63):
            broken.append("shift")
    return sorted(set(broken))


def int_expression(text: str, groups: dict[str, Column]) -> Column:
    """An integer expression over captured groups (text columns) as a Column; // and % round down, division by zero is null."""
    if broken := check_program(text, set(groups)):
        raise ValueError(f"{text!r}: {', '.join(broken)}")

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression():
                return build(node.body)
            case ast.Constant():
                return F.lit(node.value).cast("long")
            case ast.Name():
                return groups[node.id].try_cast("long")
            case ast.UnaryOp():
                return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
            case ast.Call():
                if len(node.args) == 1:
                    return build(node.args[0])
                if not isinstance(node.args[0], ast.Name):
                    raise ValueError("int(x, base) takes a captured group")
                return F.conv(groups[node.args[0].id], node.args[1].value, 10).try_cast("long")
        a, b = build(node.left), build(node.right)
        rest = F.pmod(a, F.when(b != 0, b))
        match node.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.FloorDiv():
                return ((a - rest) / F.when(b != 0, b)).cast("long")
            case ast.Mod():
                return rest
            case ast.LShift():
                return F.shiftleft(a, node.right.value)
            case _:
                return F.shiftright(a, node.right.value)

    return build(ast.parse(text, mode="eval"))


def int_template(template: str, value: Column) -> Column:
    """{expression} and {expression:0n} parts of a template rendered from an integer v, the rest as it is."""
    parts, at = [], 0
    for m in re.finditer(r"\{([^{}:]+)(?::0?([0-9]+)d?)?\}", template):
        parts.append(F.lit(template[at : m.start()]))
        text = int_expression(m[1], {"v": value.cast("string")}).cast("string")
        parts.append(F.when(F.length(text) >= int(m[2]), text).otherwise(F.lpad(text, int(m[2]), "0")) if m[2] else text)
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def replayed(rows: DataFrame, text: str, pattern: str, forward: dict[str, str], inverse: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """Latents of the first match where their inverse gives the match back, else the whole span as text.

    forward has integer expressions over g1, g2, ...; adds span, latents (a struct, null on the fallback route) and fallback.
    """
    groups = {f"g{i + 1}": F.regexp_extract(text, pattern, i + 1) for i in range(re.compile(pattern).groups)}
    out = rows.withColumn("span", F.regexp_extract(text, pattern, 0)).where(F.col("span") != "")
    out = out.withColumn("latents", F.struct(*[int_expression(e, groups).alias(n) for n, e in forward.items()]))
    back = inverse({n: F.col(f"latents.{n}") for n in forward})
    out = out.withColumn("fallback", F.when(~F.coalesce(back == F.col("span"), F.lit(False)), F.col("span")))
    return out.withColumn("latents", F.when(F.col("fallback").isNull(), F.col("latents")))


def is_identity(forward: dict[str, str], groups: int) -> bool:
    """Whether a program stores its groups as they are, so that it is no better than text."""
    return sorted(e.strip() for e in forward.values()) == sorted(f"g{i + 1}" for i in range(groups))


def _meets(held: Column, new: Column) -> Column:
    return F.exists(held, lambda x: (new["start"] < x["end"]) & (new["end"] > x["start"]))


def accepted_spans(rows: DataFrame, key: str, text: str, patterns: list[str]) -> DataFrame:
    """First match of every pattern in each row, but for those that meet an earlier pattern's accepted one: key, spec, start, end.

    Patterns have one group around what counts. An anti-join by intervals within the row, without a shuffle: the accepted
    spans of a row are carried along as an array, one step a pattern.
    """
    state = F.array().cast("array<struct<spec:int,start:int,end:int>>")
    for i, p in enumerate(patterns):
        start = F.regexp_instr(F.col(text), F.lit(p)) - 1
        span = F.struct(F.lit(i).alias("spec"), start.cast("int").alias("start"), (start + F.length(F.regexp_extract(text, p, 1))).cast("int").alias("end"))
        rows = rows.withColumn(f"__s{i}", F.when(start >= 0, span))
    held = state
    for i in range(len(patterns)):
        new = F.col(f"__s{i}")
        rows = rows.withColumn(f"__h{i}", F.when(new.isNull() | _meets(held, new), held).otherwise(F.concat(held, F.array(new))))
        held = F.col(f"__h{i}")
    return rows.select(key, F.explode(held).alias("x")).select(key, "x.*")


def guarded(lines: DataFrame, plan: tuple[Field, ...]) -> DataFrame:
    """Which fields of a plan would rewrite or capture an earlier field's placeholder: tag, lines. Such a field is left out of the replay."""
    text, marks = F.col("text"), []
    for i, f in enumerate(plan):
        new = F.regexp_replace(text, f.pattern, f"$1{placeholder(i)}$3")
        stored = F.array_join(F.regexp_extract_all(text, F.lit(f.pattern), F.lit(2)), "")
        hit = F.lit(False)
        for j in range(i):
            mark = placeholder(j)
            hit = hit | stored.contains(mark) | (F.regexp_count(text, F.lit(mark)) != F.regexp_count(new, F.lit(mark)))
        marks.append(F.struct(F.lit(f.tag).alias("tag"), hit.alias("hit")))
        text = F.when(hit, text).otherwise(new)
    each = lines.select(F.explode(F.array(*marks)).alias("m")).select("m.*")
    return each.groupBy("tag").agg(F.count_if("hit").alias("lines"))


def analysed(occurrences: DataFrame) -> DataFrame:
    """First pass of a two-pass plan: tag, n, distinct_n, numeric, min and max width; the basis for a stream's kind."""
    width = F.length("value").cast("long")
    return occurrences.groupBy("tag").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("distinct_n"), F.bool_and(F.col("value").rlike("^[0-9]{1,18}$")).alias("numeric"), F.min(width).alias("min_w"), F.max(width).alias("max_w")
    )


def kinds_of(stats: DataFrame) -> DataFrame:
    """Second pass: the kind a stream is stored as: tag, kind."""
    kind = (
        F.when(F.col("distinct_n") == 1, "constant").when(F.col("numeric") & (F.col("min_w") == F.col("max_w")), "int_fixed_width").when(F.col("numeric"), "int_width")
        .when(F.col("distinct_n") * 4 <= F.col("n"), "dictionary").otherwise("string")
    )
    return stats.select("tag", kind.alias("kind"))
