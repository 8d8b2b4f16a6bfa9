"""Queries on token predicates, signatures and line keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import signatures as G
from tracewright.functions import tokens as T
from tracewright.operators import extract
from tracewright.plans.registry import query, table
from tracewright.plans.text_queries import LINES_SQL, SHAPE_CLASS_SQL, WORD_SQL, lines, shape_sql

TOKENS_SQL = f"tok AS (SELECT unnest(regexp_extract_all(text, '{WORD_SQL}')) AS t FROM documents)"
UNIT_SQL = "chr(31)"
PLACE = "<[A-Z][A-Z0-9]{0,3}>"


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("t"))


@query("token_flags", rf"""WITH {TOKENS_SQL} SELECT t, count(*) AS cnt, regexp_matches(t, '[ \t\r\n,|;\[\]_+=:@#\\"{{}}()]') AS has_delim, regexp_matches(t, '[A-Za-z<>]') AS alpha, regexp_matches(t, '[0-9]') AS digit, regexp_matches(t, '[^0-9A-Za-z<>]') AS special, regexp_full_match(t, '[0-9]+') AS pure FROM tok GROUP BY t""")
def token_flags(spark, sf_dir):
    t = F.col("t")
    return _tokens(spark, sf_dir).groupBy("t").agg(F.count("*").alias("cnt")).select("t", "cnt", G.has_delimiter(t).alias("has_delim"), G.type_flags(t).alias("f")).select("t", "cnt", "has_delim", "f.*")


@query("token_regex_tags", rf"""WITH {TOKENS_SQL}, d AS (SELECT DISTINCT t FROM tok WHERE regexp_matches(t, '[0-9]')) SELECT t, regexp_replace(t, '[^\x00-\x7f]|[0-9A-Za-z \t-\r]', '', 'g') AS specials, regexp_replace(t, '[^0-9]', '', 'g') AS digits,
array_to_string(list_transform(regexp_extract_all(t, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '\d{{' || length(x) || '}}' ELSE regexp_replace(x, '([.*+?()\[\]{{}}^$\\])', '\\\1', 'g') END), '') AS tag FROM d""")
def token_regex_tags(spark, sf_dir):
    t = F.col("t")
    return _tokens(spark, sf_dir).where(t.rlike("[0-9]")).distinct().select("t", G.special_characters(t).alias("specials"), G.digits_only(t).alias("digits"), G.regex_tag(t).alias("tag"))


def value_shape_sql(t: str) -> str:
    return rf"""CASE WHEN regexp_full_match({t}, '([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}') THEN 'IPV4' WHEN regexp_full_match({t}, '[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}') THEN 'HMS' WHEN regexp_full_match({t}, '[0-9]+') THEN 'D+'
 ELSE substr(array_to_string(list_transform(regexp_extract_all({t}, '[0-9]+|[A-Za-z]+|\p{{L}}|[^0-9A-Za-z\p{{L}}]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D+' WHEN regexp_matches(x, '^\p{{L}}') THEN 'A' ELSE x END), ''), 1, 64) END"""


def value_like_sql(t: str) -> str:
    return f"(regexp_matches({t}, '[0-9]') AND NOT regexp_matches({t}, '{PLACE}'))"


STABLE_SQL = f"CASE WHEN {value_like_sql('t')} THEN '<' || {value_shape_sql('t')} || '>' WHEN length(t) > 40 THEN '<LIT' || length(t) || '>' ELSE t END"


@query("value_shapes", f"WITH {TOKENS_SQL} SELECT {value_shape_sql('t')} AS shape, count(*) AS cnt, count(DISTINCT t) AS distinct_n FROM tok WHERE {value_like_sql('t')} GROUP BY 1")
def value_shapes(spark, sf_dir):
    t = F.col("t")
    return _tokens(spark, sf_dir).where(G.value_like(t)).groupBy(G.value_shape(t).alias("shape")).agg(F.count("*").alias("cnt"), F.countDistinct("t").alias("distinct_n"))


@query("cache_families", f"""WITH {LINES_SQL}, w AS (SELECT regexp_extract_all(line, '{WORD_SQL}') AS ws FROM lines), k AS (SELECT ws, md5(coalesce(array_to_string(list_transform(ws, lambda t: {STABLE_SQL}), {UNIT_SQL}), '')) AS template FROM w),
s AS (SELECT template, unnest(ws) AS t, generate_subscripts(ws, 1) - 1 AS slot FROM k) SELECT template, slot, {value_shape_sql('t')} AS shape, count(*) AS support FROM s WHERE {value_like_sql('t')} GROUP BY 1, 2, 3""")
def cache_families(spark, sf_dir):
    """Families (template key, slot, value shape) of value-like tokens and their support."""
    keyed = lines(spark, sf_dir).select(F.md5(G.template_key(F.col("line"))).alias("template"), T.words(F.col("line")).alias("ws"))
    slots = keyed.select("template", F.posexplode("ws").alias("slot", "t")).where(G.value_like(F.col("t")))
    return slots.groupBy("template", F.col("slot").cast("long").alias("slot"), G.value_shape(F.col("t")).alias("shape")).agg(F.count("*").alias("support"))


def lattice_sql(t: str) -> str:
    return rf"""CASE WHEN regexp_full_match({t}, '{PLACE}') THEN {t} WHEN regexp_matches({t}, '\b[0-9]+[.][0-9]+\b|\b[0-9]+\b') THEN regexp_replace(regexp_replace({t}, '\b[0-9]+[.][0-9]+\b', '<F>', 'g'), '\b[0-9]+\b', '<I>', 'g')
 WHEN length({t}) > 40 THEN '<LIT' || length({t}) || '>' ELSE {t} END"""


LATTICE_SQL = f"{LINES_SQL}, w AS (SELECT doc_id, line_no, list_transform(regexp_extract_all(line, '{WORD_SQL}'), lambda t: {lattice_sql('t')}) AS ks FROM lines)"


@query("lattice_top", f"""WITH {LATTICE_SQL}, k AS (SELECT md5(coalesce(array_to_string(ks, {UNIT_SQL}), '')) AS template, coalesce(array_to_string(ks[1:4], {UNIT_SQL}), '') AS prefix FROM w WHERE len(list_filter(ks, lambda x: regexp_matches(x, '<[FI]>'))) > 0)
SELECT prefix, count(*) AS support, count(DISTINCT template) AS templates FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32""")
def lattice_top(spark, sf_dir):
    """The 32 prefix families of lines with numbers that have most support: a top-k report."""
    template, prefix = G.lattice_keys(F.col("line"))
    numbered = F.exists(F.transform(T.words(F.col("line")), G.lattice_token), lambda x: x.rlike("<[FI]>"))
    keyed = lines(spark, sf_dir).where(numbered).select(F.md5(template).alias("template"), prefix.alias("prefix"))
    return keyed.groupBy("prefix").agg(F.count("*").alias("support"), F.countDistinct("template").alias("templates")).orderBy(F.desc("support"), "prefix").limit(32)


@query("left_anchors", rf"""WITH {LINES_SQL}, tok AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{WORD_SQL}')) AS t, generate_subscripts(regexp_extract_all(line, '{WORD_SQL}'), 1) AS p FROM lines),
a AS (SELECT t, lag(t) OVER (PARTITION BY doc_id, line_no ORDER BY p) AS b FROM tok), n AS (SELECT t, coalesce(b, '<BOL>') AS b, regexp_extract(t, '^(.*?)(\b[0-9]+[.][0-9]+\b|\b[0-9]+\b)', 1) AS pre, regexp_extract(t, '\b[0-9]+[.][0-9]+\b|\b[0-9]+\b') AS v FROM a WHERE regexp_matches(t, '\b[0-9]+[.][0-9]+\b|\b[0-9]+\b'))
SELECT CASE WHEN pre <> '' THEN {lattice_sql('pre')} ELSE {lattice_sql('b')} END AS anchor, CASE WHEN contains(v, '.') THEN 'float' ELSE 'int' END AS kind, count(*) AS cnt FROM n GROUP BY 1, 2""")
def left_anchors(spark, sf_dir):
    """First number of each token by its left context and kind."""
    words = T.words(F.col("line"))
    pairs = lines(spark, sf_dir).select(words.alias("w")).where("size(w) > 0").select(F.explode(F.arrays_zip(F.col("w").alias("t"), F.concat(F.array(F.lit("<BOL>")), F.slice("w", F.lit(1), F.size("w") - 1)).alias("b"))).alias("x")).select("x.t", "x.b")
    found = pairs.where(F.col("t").rlike(G._NUMBER))
    kind = G.numeric_kind(F.regexp_extract("t", f"({G._NUMBER})", 1))
    return found.groupBy(G.left_anchor(F.col("t"), F.col("b")).alias("anchor"), kind.alias("kind")).agg(F.count("*").alias("cnt"))


TRANSDUCER_SQL = rf"""(NOT regexp_full_match(t, '{PLACE}') AND (regexp_matches(t, '[0-9]') OR (regexp_matches(t, '[0-9\p{{L}}]') AND regexp_matches(t, '[^0-9\p{{L}}]') AND length(t) >= 3
 AND NOT (regexp_full_match(regexp_replace(t, '^[\[\](){{}}<>]+|[\[\](){{}}<>]+$', '', 'g'), '\p{{L}}+') AND length(regexp_replace(t, '^[\[\](){{}}<>]+|[\[\](){{}}<>]+$', '', 'g')) <= 16))))"""


@query("transducer_templates", f"""WITH {LINES_SQL}, k AS (SELECT md5(coalesce(array_to_string(list_transform(regexp_extract_all(line, '{WORD_SQL}'), lambda t: CASE WHEN regexp_full_match(t, '{PLACE}') THEN t WHEN {TRANSDUCER_SQL} THEN '<' || {shape_sql('t')} || '>' ELSE substr(lower(t), 1, 48) END), {UNIT_SQL}), '')) AS template FROM lines)
SELECT template, count(*) AS support FROM k GROUP BY 1""")
def transducer_templates(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.md5(G.transducer_key(F.col("line"))).alias("template")).agg(F.count("*").alias("support"))


SIG_SQL = rf"""CASE WHEN shape = 'WORD' AND length(t) <= 16 THEN lower(t) WHEN shape = 'HEX' THEN '[HEX]' WHEN shape = 'NUMERIC' THEN '[NUM:' || array_to_string(list_transform(regexp_extract_all(t, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D' || length(x) ELSE x END), '') || ']'
 WHEN shape = 'WS' THEN CASE WHEN contains(t, chr(10)) THEN '[NL]' ELSE '[WS]' END ELSE '[SIG:' || array_to_string(list_transform(regexp_extract_all(substr(t, 1, 32), '\p{{L}}+|[0-9]+|[^0-9\p{{L}}]+'), lambda x: CASE WHEN regexp_matches(x, '^\p{{L}}') THEN 'A' WHEN regexp_matches(x, '^[0-9]') THEN 'D' ELSE 'S' END || length(x)), '|') || ']' END"""
ALL_SQL = rf"{WORD_SQL}|[ \t\r\n\x0b\f]+"


@query("context_signatures", f"""WITH {LINES_SQL}, tok AS (SELECT unnest(regexp_extract_all(line, '{ALL_SQL}')) AS t, least(15, generate_subscripts(regexp_extract_all(line, '{ALL_SQL}'), 1) - 1) AS bucket FROM lines), s AS (SELECT t, bucket, {SHAPE_CLASS_SQL} AS shape FROM tok) SELECT bucket, {SIG_SQL} AS signature, count(*) AS cnt FROM s GROUP BY 1, 2""")
def context_signatures(spark, sf_dir):
    """Signatures of lossless tokens by their position in the line."""
    tok = lines(spark, sf_dir).select(F.posexplode(T.lossless_tokens(F.col("line"))).alias("p", "t"))
    counted = tok.groupBy(G.position_bucket(F.col("p")).cast("long").alias("bucket"), "t").agg(F.count("*").alias("c"))  # each distinct token is looked at once
    return counted.groupBy("bucket", G.context_signature(F.col("t")).alias("signature")).agg(F.sum("c").alias("cnt"))


@query("slot_templates", f"""WITH {LINES_SQL}, tok AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{ALL_SQL}')) AS t, generate_subscripts(regexp_extract_all(line, '{ALL_SQL}'), 1) AS p FROM lines WHERE line <> ''), s AS (SELECT *, {SHAPE_CLASS_SQL} AS shape FROM tok),
k AS (SELECT string_agg(shape || ':' || {SIG_SQL}, {UNIT_SQL} ORDER BY p) AS template FROM s GROUP BY doc_id, line_no UNION ALL SELECT '[EMPTY]' FROM lines WHERE line = '') SELECT md5(template) AS template, count(*) AS support FROM k GROUP BY 1""")
def slot_templates(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.md5(G.slot_template_key(F.col("line"))).alias("template")).agg(F.count("*").alias("support"))


@query("numeric_restore", rf"""WITH {TOKENS_SQL}, d AS (SELECT DISTINCT t FROM tok WHERE regexp_matches(t, '[0-9]') AND length(regexp_replace(t, '[^0-9]', '', 'g')) <= 18) SELECT t, CAST(regexp_replace(t, '[^0-9]', '', 'g') AS BIGINT) AS value, len(regexp_extract_all(t, '[0-9]+')) AS runs, regexp_matches(t, '(^|[^0-9])0[0-9]') AS zeros, t AS restored FROM d""")
def numeric_restore(spark, sf_dir):
    t = F.col("t")
    found = _tokens(spark, sf_dir).where(t.rlike("[0-9]") & (F.length(G.digits_only(t)) <= 18)).distinct().withColumn("n", G.numeric_parts(t))
    return found.select("t", "n.value", F.size("n.lengths").cast("long").alias("runs"), G.leading_zero(t).alias("zeros"), G.numeric_restored(F.col("n")).alias("restored"))


@query("block_shapes", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_lf, ends_with(text, chr(10)) AS ended FROM documents")
def block_shapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.block_shape(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("token_routes", rf"""WITH {LINES_SQL}, tok AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{WORD_SQL}')) AS t, generate_subscripts(regexp_extract_all(line, '{WORD_SQL}'), 1) AS p FROM lines),
f AS (SELECT *, regexp_matches(t, '[0-9]') OR regexp_matches(t, '[^0-9A-Za-z<>]') AS variable, regexp_full_match(t, '[0-9]+') AS pure FROM tok), c AS (SELECT *, coalesce(last_value(CASE WHEN NOT variable THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, line_no ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ctx FROM f)
SELECT CASE WHEN pure AND length(t) <= 2 THEN 'LEN' || length(t) WHEN pure THEN 'CTX' || ctx || '|STR\d{{' || length(t) || '}}|IDX' || p ELSE 'CTX' || ctx || '|STR_' || regexp_replace(t, '[^\x00-\x7f]|[0-9A-Za-z \t-\r]', '', 'g') END AS tag, count(*) AS cnt, count(DISTINCT t) AS distinct_n FROM c WHERE variable GROUP BY 1""")
def token_routes(spark, sf_dir):
    """Streams that variable tokens of a line go to: short integers by length, others by the last word before them."""
    return extract.routed_tokens(lines(spark, sf_dir)).groupBy("tag").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("distinct_n"))
