"""Token and line shape functions as Column expressions. Letters are Unicode letters, digits are 0-9."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that mark a token as a value, beside digits.
HINTS = r"[0-9./:;=_\[\]{}()<>@#%+-]"
_DELIMITERS = r"[ \t\r\n,|;\[\]_+=:@#\\\"{}()]"


def _runs(token: Column, pattern: str) -> Column:
    return F.regexp_extract_all(token, F.lit(pattern), F.lit(0))


def token_shape(token: Column) -> Column:
    """Letter runs as A<n>, digit runs as D<n>, other characters as they are: abc12- gives A3D2-."""
    coded = F.transform(
        _runs(token, r"[0-9]+|\p{L}+|[^0-9\p{L}]"),
        lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("D"), F.length(x).cast("string"))).when(x.rlike(r"^\p{L}"), F.concat(F.lit("A"), F.length(x).cast("string"))).otherwise(x),
    )
    return F.array_join(coded, "")


def numeric_pattern(token: Column) -> Column:
    """Digit runs as D<n>, the rest as it is."""
    coded = F.transform(_runs(token, r"[0-9]+|[^0-9]+"), lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("D"), F.length(x).cast("string"))).otherwise(x))
    return F.array_join(coded, "")


def value_hint(token: Column) -> Column:
    return token.rlike(HINTS)


def token_mask(token: Column) -> Column:
    """The shape of a token that looks like a value, else the token in small letters."""
    return F.when(value_hint(token), token_shape(token)).otherwise(F.lower(token))


def words(line: Column) -> Column:
    return _runs(line, r"[^ \t\r\n\x0b\f]+")


def lossless_tokens(text: Column) -> Column:
    """Runs of white space and of other characters; joined they give the text."""
    return _runs(text, r"[^ \t\r\n\x0b\f]+|[ \t\r\n\x0b\f]+")


def delimited_tokens(text: Column) -> Column:
    return _runs(text, _DELIMITERS + "|" + _DELIMITERS.replace("[", "[^", 1) + "+")


HEX_LENGTHS = (8, 12, 16, 32)


def shape_class(token: Column) -> Column:
    """WS, HEX, NUMERIC, WORD, MIXED or OTHER, the first that fits."""
    hexes = token.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") | (F.length(token).isin(*HEX_LENGTHS) & token.rlike("^[0-9a-fA-F]+$"))
    return (
        F.when(token.rlike(r"^[ \t\r\n\x0b\f]+$"), "WS").when(hexes, "HEX").when(token.rlike("^[0-9]+([.,:/-][0-9]+)*$"), "NUMERIC")
        .when(token.rlike(r"^\p{L}+$"), "WORD").when(token.rlike(r"\p{L}") & token.rlike("[0-9]"), "MIXED").otherwise("OTHER")
    )


def punctuation_skeleton(line: Column) -> Column:
    """Punctuation in order; neighbouring equal characters count once."""
    runs = _runs(line, r"[^0-9\p{L} \t\r\n\x0b\f]+")
    squeezed = F.transform(runs, lambda r: F.regexp_replace(r, r"(.)\1+", "$1"))
    return F.array_join(squeezed, "")


def family_key(line: Column) -> Column:
    """Number of tokens, the first eight stable masks and the punctuation skeleton."""
    tokens = words(line)
    stable = F.filter(F.transform(tokens, token_mask), lambda m: ~m.contains("D"))
    return F.concat(F.lit("len="), F.size(tokens).cast("string"), F.lit("|stable="), F.array_join(F.slice(stable, 1, 8), " "), F.lit("|punct="), punctuation_skeleton(line))


def line_features(line: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(words(line), token_mask), F.array(F.concat(F.lit("P:"), punctuation_skeleton(line)))))


def skeleton(line: Column) -> Column:
    """Token count and the first twelve tokens with digits masked."""
    tokens = words(line)
    return F.concat(F.size(tokens).cast("string"), F.lit("|"), F.array_join(F.transform(F.slice(tokens, 1, 12), lambda t: F.regexp_replace(t, "[0-9]+", "#")), " "))


def line_prefixes(line: Column, most: int = 5) -> Column:
    tokens = words(line)
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.greatest(F.size(tokens), F.lit(1)))), lambda n: F.array_join(F.slice(tokens, 1, n), " "))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
