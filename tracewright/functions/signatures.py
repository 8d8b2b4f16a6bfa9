"""Predicates, signatures and keys of tokens and lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import tokens as T

#: Joins parts of a key; no record holds it.
UNIT = "\x1f"
_PLACEHOLDER = "<[A-Z][A-Z0-9]{0,3}>"
_NUMBER = r"\b[0-9]+[.][0-9]+\b|\b[0-9]+\b"


def has_delimiter(text: Column) -> Column:
    return text.rlike(T._DELIMITERS)


def type_flags(text: Column) -> Column:
    """alpha (letters A-Z and angle brackets), digit, special (all else) and pure (digits alone)."""
    return F.struct(text.rlike("[A-Za-z<>]").alias("alpha"), text.rlike("[0-9]").alias("digit"), text.rlike("[^0-9A-Za-z<>]").alias("special"), text.rlike("^[0-9]+$").alias("pure"))


def special_characters(text: Column) -> Column:
    """ASCII characters that are no letters, digits or white space."""
    return F.regexp_replace(text, r"[^\x00-\x7f]|[0-9A-Za-z \t-\r]", "")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def regex_tag(text: Column) -> Column:
    r"""Digit runs as \d{n}, characters that mean something in a pattern escaped."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    escaped = lambda x: F.regexp_replace(x, r"([.*+?()\[\]{}^$\\])", r"\\$1")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit(r"\d{"), F.length(x).cast("string"), F.lit("}"))).otherwise(escaped(x))), "")


def value_like(token: Column) -> Column:
    """Holds a digit and no placeholder."""
    return token.rlike("[0-9]") & ~token.rlike(_PLACEHOLDER)


def value_shape(token: Column) -> Column:
    """IPV4, HMS, D+, or runs as D+ and A with other characters kept, 64 characters at most."""
    runs = F.regexp_extract_all(token, F.lit(r"[0-9]+|[A-Za-z]+|\p{L}|[^0-9A-Za-z\p{L}]"), F.lit(0))
    coded = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), "D+").when(x.rlike(r"^\p{L}"), "A").otherwise(x))
    return (
        F.when(token.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "IPV4").when(token.rlike("^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$"), "HMS")
        .when(token.rlike("^[0-9]+$"), "D+").otherwise(F.substring(F.array_join(coded, ""), 1, 64))
    )


def stable_token(token: Column) -> Column:
    """The shape of a value-like token, the length of a long one, else the token."""
    return (
        F.when(value_like(token), F.concat(F.lit("<"), value_shape(token), F.lit(">")))
        .when(F.length(token) > 40, F.concat(F.lit("<LIT"), F.length(token).cast("string"), F.lit(">"))).otherwise(token)
    )


def template_key(line: Column) -> Column:
    return F.array_join(F.transform(T.words(line), stable_token), UNIT)


def numeric_kind(value: Column) -> Column:
    return F.when(value.contains("."), "float").otherwise("int")


def lattice_token(token: Column) -> Column:
    """Numbers as <F> or <I>, long tokens by length; placeholders as they are."""
    masked = F.regexp_replace(F.regexp_replace(token, r"\b[0-9]+[.][0-9]+\b", "<F>"), r"\b[0-9]+\b", "<I>")
    return (
        F.when(token.rlike(f"^{_PLACEHOLDER}$"), token).when(token.rlike(_NUMBER), masked)
        .when(F.length(token) > 40, F.concat(F.lit("<LIT"), F.length(token).cast("string"), F.lit(">"))).otherwise(token)
    )


def lattice_keys(line: Column, most: int = 4) -> tuple[Column, Column]:
    """Template key, and prefix key of the first tokens."""
    tokens = F.transform(T.words(line), lattice_token)
    return F.array_join(tokens, UNIT), F.array_join(F.slice(tokens, 1, most), UNIT)


def left_anchor(token: Column, before: Column) -> Column:
    """Context of a token's first number: what stands before it in the token, else the token before, else <BOL>."""
    prefix = F.regexp_extract(token, f"^(.*?)({_NUMBER})", 1)
    return F.when(prefix != "", lattice_token(prefix)).otherwise(lattice_token(F.coalesce(before, F.lit("<BOL>"))))


def transducer_value(token: Column) -> Column:
    """Digits, or letters with other characters; not placeholders nor short bracketed words."""
    inner = F.regexp_replace(token, r"^[\[\](){}<>]+|[\[\](){}<>]+$", "")
    word = inner.rlike(r"^\p{L}+$") & (F.length(inner) <= 16)
    mixed = token.rlike(r"[0-9\p{L}]") & token.rlike(r"[^0-9\p{L}]") & ~word & (F.length(token) >= 3)
    return ~token.rlike(f"^{_PLACEHOLDER}$") & (token.rlike("[0-9]") | mixed)


def transducer_key(line: Column) -> Column:
    one = lambda t: F.when(t.rlike(f"^{_PLACEHOLDER}$"), t).when(transducer_value(t), F.concat(F.lit("<"), T.token_shape(t), F.lit(">"))).otherwise(F.substring(F.lower(t), 1, 48))
    return F.array_join(F.transform(T.words(line), one), UNIT)


def _run_kind(run: Column) -> Column:
    """A for a run of letters, D for one of digits, else S. Beyond ASCII only a pattern tells letters; before it, the order of characters does."""
    ascii_ = F.when(run < "0", "S").when(run < ":", "D").when(run < "A", "S").when(run < "[", "A").when(run < "a", "S").when(run < "{", "A")
    return ascii_.when(run.rlike(r"^\p{L}"), "A").otherwise("S")


def context_signature(token: Column, shape: Column | None = None) -> Column:
    """Short words in small letters, [HEX], [NUM:pattern], [NL], [WS], or runs of letters, digits and others as [SIG:A3|S1]."""
    shape = T.shape_class(token) if shape is None else shape
    runs = F.regexp_extract_all(F.substring(token, 1, 32), F.lit(r"\p{L}+|[0-9]+|[^0-9\p{L}]+"), F.lit(0))
    coded = F.transform(runs, lambda x: F.concat(_run_kind(x), F.length(x).cast("string")))
    return (
        F.when((shape == "WORD") & (F.length(token) <= 16), F.lower(token)).when(shape == "HEX", "[HEX]").when(shape == "NUMERIC", F.concat(F.lit("[NUM:"), T.numeric_pattern(token), F.lit("]")))
        .when(shape == "WS", F.when(token.contains("\n"), "[NL]").otherwise("[WS]")).otherwise(F.concat(F.lit("[SIG:"), F.array_join(coded, "|"), F.lit("]")))
    )


def position_bucket(position: Column, most: int = 15) -> Column:
    return F.least(position, F.lit(most))


def slot_template_key(line: Column) -> Column:
    """Shape and signature of every lossless token; [EMPTY] for an empty line.

    Single spaces and short words, most tokens, are told by one comparison and one pattern; the shape of others is found once.
    """
    word = lambda t: t.rlike(r"^\p{L}{1,16}\z") & ~(F.length(t).isin(*T.HEX_LENGTHS) & t.rlike("^[a-fA-F]+$"))
    shaped = F.transform(T.lossless_tokens(line), lambda t: F.struct(t.alias("t"), F.when(t == " ", "_").when(word(t), "W").otherwise(T.shape_class(t)).alias("s")))
    full = lambda x: F.concat(x["s"], F.lit(":"), context_signature(x["t"], x["s"]))
    parts = F.transform(shaped, lambda x: F.when(x["s"] == "_", "WS:[WS]").when(x["s"] == "W", F.concat(F.lit("WORD:"), F.lower(x["t"]))).otherwise(full(x)))
    return F.when(line == "", "[EMPTY]").otherwise(F.array_join(parts, UNIT))


def leading_zero(text: Column) -> Column:
    return text.rlike("(^|[^0-9])0[0-9]")


def numeric_parts(token: Column) -> Column:
    """Digits joined as a number, lengths of the digit runs, and what stands around them."""
    runs = F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0))
    return F.struct(F.array_join(runs, "").try_cast("long").alias("value"), F.transform(runs, F.length).alias("lengths"), F.split(token, "[0-9]+", -1).alias("around"))


def numeric_restored(parts: Column) -> Column:
    """The inverse of numeric_parts."""
    lengths = parts["lengths"]
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    digits = F.lpad(parts["value"].cast("string"), total, "0")
    runs = F.transform(lengths, lambda n, i: F.substring(digits, F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(1), lambda a, x: a + x), n))
    return F.array_join(F.zip_with(parts["around"], runs, lambda a, r: F.concat(a, F.coalesce(r, F.lit("")))), "")


def block_shape(text: Column) -> Column:
    """LF count, and whether the text ends in one."""
    return F.struct(F.regexp_count(text, F.lit("\n")).cast("long").alias("n_lf"), text.endswith("\n").alias("ended"))
