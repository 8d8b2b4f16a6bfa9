"""Queries on lines and tokens of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import tokens as T
from tracewright.operators import extract, templates
from tracewright.plans.registry import query, table
from tracewright.sources import blocks

LINES_SQL = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
WORD_SQL = r"[^ \t\r\n\x0b\f]+"


def shape_sql(t: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({t}, '[0-9]+|\p{{L}}+|[^0-9\p{{L}}]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D' || length(x) WHEN regexp_matches(x, '^\p{{L}}') THEN 'A' || length(x) ELSE x END), '')"


def mask_sql(t: str) -> str:
    return rf"CASE WHEN regexp_matches({t}, '[0-9./:;=_\[\]{{}}()<>@#%+-]') THEN {shape_sql(t)} ELSE lower({t}) END"


#: Squeezing neighbours without backreferences: keep a character where the one before it differs.
PUNCT_SQL = r"array_to_string(list_transform(regexp_extract_all(line, '[^0-9\p{L} \t\r\n\x0b\f]+'), lambda r: array_to_string(list_transform(list_filter(range(1, length(r) + 1), lambda i: i = 1 OR substr(r, i, 1) <> substr(r, i - 1, 1)), lambda i: substr(r, i, 1)), '')), '')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("line_split", f"WITH {LINES_SQL} SELECT doc_id, line_no, length(line) AS len FROM lines")
def line_split(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").cast("long").alias("len"))


@query("block_inventory", f"WITH {LINES_SQL} SELECT doc_id // 100 AS block_id, count(*) AS n_lines, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS n_bytes FROM lines GROUP BY 1")
def block_inventory(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.expr("doc_id div 100").alias("block_id")).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line") + 1).alias("n_bytes"))


@query(
    "lossless_tokens",
    rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD_SQL}')) AS BIGINT) AS n_tok, CAST(len(regexp_extract_all(text, '[ \t\r\n\x0b\f]+')) AS BIGINT) AS n_ws, true AS joined FROM documents",
)
def lossless_tokens(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", "text", T.lossless_tokens(F.col("text")).alias("t"))
    ws = F.size(F.filter("t", lambda x: x.rlike(r"^[ \t\r\n\x0b\f]")))
    return found.select("doc_id", (F.size("t") - ws).cast("long").alias("n_tok"), ws.cast("long").alias("n_ws"), (F.array_join("t", "") == F.col("text")).alias("joined"))


SHAPE_CLASS_SQL = r"""CASE WHEN regexp_full_match(t, '[ \t\r\n\x0b\f]+') THEN 'WS'
 WHEN regexp_full_match(t, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') OR (length(t) IN (8, 12, 16, 32) AND regexp_full_match(t, '[0-9a-fA-F]+')) THEN 'HEX'
 WHEN regexp_full_match(t, '[0-9]+([.,:/-][0-9]+)*') THEN 'NUMERIC' WHEN regexp_full_match(t, '\p{L}+') THEN 'WORD'
 WHEN regexp_matches(t, '\p{L}') AND regexp_matches(t, '[0-9]') THEN 'MIXED' ELSE 'OTHER' END"""


@query("shape_class_hist", rf"WITH tok AS (SELECT unnest(regexp_extract_all(text, '{WORD_SQL}|[ \t\r\n\x0b\f]+')) AS t FROM documents) SELECT {SHAPE_CLASS_SQL} AS shape, count(*) AS cnt FROM tok GROUP BY 1")
def shape_class_hist(spark, sf_dir):
    tok = table(spark, sf_dir, "documents").select(F.explode(T.lossless_tokens(F.col("text"))).alias("t"))
    return tok.groupBy(T.shape_class(F.col("t")).alias("shape")).agg(F.count("*").alias("cnt"))


@query("token_shape_top", f"SELECT {shape_sql('url')} AS shape, count(*) AS cnt FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def token_shape_top(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.token_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "shape").limit(40)


@query("numeric_patterns", r"SELECT array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D' || length(x) ELSE x END), '') AS pattern, count(*) AS cnt FROM pages GROUP BY 1")
def numeric_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.numeric_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("cnt"))


@query("punct_skeleton_top", f"WITH {LINES_SQL} SELECT {PUNCT_SQL} AS skeleton, count(*) AS cnt FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def punct_skeleton_top(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(T.punctuation_skeleton(F.col("line")).alias("skeleton")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "skeleton").limit(40)


FAMILY_SQL = f"""'len=' || len(regexp_extract_all(line, '{WORD_SQL}')) || '|stable=' || coalesce(array_to_string(list_filter(list_transform(regexp_extract_all(line, '{WORD_SQL}'), lambda t: {mask_sql("t")}), lambda m: NOT contains(m, 'D'))[1:8], ' '), '') || '|punct=' || coalesce({PUNCT_SQL}, '')"""


@query("family_topk", f"WITH {LINES_SQL}, keyed AS (SELECT {FAMILY_SQL} AS family FROM lines), counted AS (SELECT family, count(*) AS support FROM keyed GROUP BY 1) SELECT family, support, row_number() OVER (ORDER BY support DESC, family) AS rank FROM counted QUALIFY rank <= 40")
def family_topk(spark, sf_dir):
    return templates.family_topk(lines(spark, sf_dir), 40, 1)


@query("family_examples")
def family_examples(spark, sf_dir):
    return templates.family_examples(lines(spark, sf_dir), 2, 0.15)


@query(
    "value_slot_stats",
    rf"WITH tok AS (SELECT page_id, regexp_extract_all(url, '[0-9]+') AS v FROM pages), slots AS (SELECT unnest(v) AS value, generate_subscripts(v, 1) - 1 AS slot FROM tok) SELECT slot, count(*) AS n, count(DISTINCT value) AS distinct_n FROM slots GROUP BY 1",
)
def value_slot_stats(spark, sf_dir):
    slots = table(spark, sf_dir, "pages").select(F.posexplode(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).alias("slot", "value"))
    return slots.groupBy(F.col("slot").cast("long").alias("slot")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_n"))


ALPHA_SQL = rf"""WITH {LINES_SQL}, tok AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{WORD_SQL}')) AS t, generate_subscripts(regexp_extract_all(line, '{WORD_SQL}'), 1) AS p FROM lines),
around AS (SELECT t, coalesce(lag(lower(t)) OVER w, '<BOL>') AS "left", coalesce(lead(lower(t)) OVER w, '<EOL>') AS "right" FROM tok WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY p)),
counted AS (SELECT "left", "right", t, count(*) AS c FROM around WHERE regexp_full_match(t, '\p{{L}}+') GROUP BY ALL)
SELECT "left", "right", CAST(sum(c) AS BIGINT) AS support, count(*) AS distinct_n, max(c) AS top_cnt FROM counted GROUP BY 1, 2 HAVING sum(c) >= 5 AND count(*) >= 3 AND max(c) <= 0.8 * sum(c)"""


@query("alpha_contexts", ALPHA_SQL)
def alpha_contexts(spark, sf_dir):
    return templates.alpha_contexts(lines(spark, sf_dir), 5, 3, 0.8)


COVERAGE_SQL = rf"""WITH {LINES_SQL}, sk AS (SELECT l.doc_id, lang, len(regexp_extract_all(line, '{WORD_SQL}')) || '|' || coalesce(array_to_string(list_transform(regexp_extract_all(line, '{WORD_SQL}')[1:12], lambda t: regexp_replace(t, '[0-9]+', '#', 'g')), ' '), '') AS s FROM lines l JOIN documents d USING (doc_id)),
train AS (SELECT DISTINCT s FROM sk WHERE doc_id % 2 = 0), held AS (SELECT lang, s FROM sk WHERE doc_id % 2 = 1)
SELECT lang, count(*) AS n, CAST(sum(CASE WHEN s IN (SELECT s FROM train) THEN 1 ELSE 0 END) AS BIGINT) AS hit, round(100.0 * sum(CASE WHEN s IN (SELECT s FROM train) THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM held GROUP BY 1"""


@query("skeleton_coverage", COVERAGE_SQL)
def skeleton_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sk = extract.split_lines(docs).select("doc_id", "lang", T.skeleton(F.col("line")).alias("s"))
    train = sk.where("doc_id % 2 = 0").select("s").distinct().withColumn("seen", F.lit(1))
    held = sk.where("doc_id % 2 = 1").join(train, "s", "left")
    return held.groupBy("lang").agg(F.count("*").alias("n"), F.count("seen").alias("hit")).withColumn("pct", F.round(100.0 * F.col("hit") / F.col("n"), 4))


@query("jaccard_pairs", rf"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) AS w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) AS w FROM benchmark),
p AS (SELECT doc_id, unnest(w) AS t FROM d), q AS (SELECT item_id, unnest(w) AS t FROM b), c AS (SELECT doc_id, item_id, count(*) AS common FROM p JOIN q USING (t) GROUP BY 1, 2)
SELECT doc_id, item_id, round(common / (len(d.w) + len(b.w) - common), 6) AS jaccard FROM c JOIN d USING (doc_id) JOIN b USING (item_id) WHERE common / (len(d.w) + len(b.w) - common) >= 0.2""")
def jaccard_pairs(spark, sf_dir):
    return templates.jaccard_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.2)


@query("template_ids", f"""WITH {LINES_SQL}, masked AS (SELECT doc_id // 100 AS block_id, doc_id, line_no, regexp_replace(line, '[0-9]+', '<*>', 'g') AS template FROM lines), firsts AS (SELECT block_id, template, min({{'d': doc_id, 'l': line_no}}) AS pos0, count(*) AS cnt FROM masked WHERE template <> '' GROUP BY 1, 2)
SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY pos0) AS template_id, cnt, length(template) AS len FROM firsts UNION ALL SELECT block_id, 0, count(*), 0 FROM masked WHERE template = '' GROUP BY 1""")
def template_ids(spark, sf_dir):
    numbered = lines(spark, sf_dir).select(F.expr("doc_id div 100").alias("block_id"), F.struct("doc_id", "line_no").alias("pos"), F.regexp_replace("line", "[0-9]+", "<*>").alias("template"))
    return templates.template_dictionary(numbered).select("block_id", "template_id", "cnt", F.length("template").cast("long").alias("len"))


@query("line_dictionary", f"""WITH {LINES_SQL}, counted AS (SELECT doc_id // 100 AS block_id, line, count(*) AS cnt, octet_length(encode(line)) AS n FROM lines GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY cnt * n DESC, cnt DESC, line) - 1 AS line_id FROM counted WHERE cnt >= 2 AND n > 3)
SELECT block_id, line_id, cnt, n AS bytes, n * (cnt - 1) - (3 + length(CAST(line_id AS VARCHAR))) * cnt AS gain FROM ranked WHERE n * (cnt - 1) - (3 + length(CAST(line_id AS VARCHAR))) * cnt > 0 AND line_id < 8192""")
def line_dictionary(spark, sf_dir):
    return templates.line_dictionary(lines(spark, sf_dir).select(F.expr("doc_id div 100").alias("block_id"), "line"), 2, 8192)


@query("or20_admission", rf"""WITH tok AS (SELECT unnest(regexp_extract_all(text, '{WORD_SQL}')) AS t, count(*) OVER () AS docs FROM documents), tagged AS (SELECT {shape_sql("t")} AS tag, t FROM tok WHERE regexp_matches(t, '[0-9]')), total AS (SELECT count(*) AS n FROM tok),
stats AS (SELECT tag, count(*) AS n, count(DISTINCT t) AS distinct_n, round(avg(length(t)), 6) AS avg_len FROM tagged GROUP BY 1)
SELECT tag, s.n, distinct_n, avg_len, s.n >= greatest(20, least(200, total.n / 1000)) AND (distinct_n >= 30 OR avg_len > 20) AS admitted FROM stats s, total""")
def or20_admission(spark, sf_dir):
    tok = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("t"))
    return templates.admission(tok)


@query("plan_apply", r"""WITH a AS (SELECT page_id, url, regexp_extract_all(url, '://([^/?#]+)', 1) AS host, regexp_replace(url, '://[^/?#]+', '://<H>', 'g') AS u1 FROM pages), b AS (SELECT *, regexp_extract_all(u1, '/([a-z]{2})/', 1) AS lang, regexp_replace(u1, '/[a-z]{2}/', '/<L>/', 'g') AS u2 FROM a), c AS (SELECT *, regexp_extract_all(u2, '[0-9]+') AS num FROM b),
o AS (SELECT 'host' AS tag, unnest(host) AS v FROM c UNION ALL SELECT 'lang', unnest(lang) FROM c UNION ALL SELECT 'num', unnest(num) FROM c) SELECT tag, count(*) AS n, count(DISTINCT v) AS distinct_n FROM o GROUP BY 1""")
def plan_apply(spark, sf_dir):
    _, occurrences = extract.apply_plan(table(spark, sf_dir, "pages").select(F.col("page_id").alias("line_no"), F.col("url").alias("text")), extract.URL_PLAN)
    return occurrences.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_n"))


@query("restore_roundtrip", r"""WITH a AS (SELECT page_id, url, regexp_replace(url, '://[^/?#]+', '://' || chr(57344), 'g') AS u1 FROM pages), b AS (SELECT *, regexp_replace(u1, '/[a-z]{2}/', '/' || chr(57345) || '/', 'g') AS u2 FROM a)
SELECT page_id, md5(regexp_replace(u2, '[0-9]+', chr(57346), 'g')) AS coded, md5(url) AS restored FROM b""")
def restore_roundtrip(spark, sf_dir):
    """Urls with placeholders and urls rebuilt from them and the stored values, by digest."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("line_no"), F.col("url").alias("text"))
    coded, occurrences = extract.apply_plan(pages, extract.URL_PLAN)
    back = extract.restore_plan(coded, occurrences, extract.URL_PLAN).select("line_no", F.md5("text").alias("restored"))
    return coded.select("line_no", F.md5("text").alias("coded")).join(back, "line_no").select(F.col("line_no").alias("page_id"), "coded", "restored")


@query("span_overlap", r"""WITH a AS (SELECT page_id, regexp_extract(url, '^(.*?)(://[^/?#]+/[a-z]*)', 1) AS pre, regexp_extract(url, '(://[^/?#]+/[a-z]*)', 1) AS m FROM pages), b AS (SELECT page_id, regexp_extract(url, '^(.*?)(/[a-z]{2}/[0-9]+)', 1) AS pre, regexp_extract(url, '(/[a-z]{2}/[0-9]+)', 1) AS m FROM pages)
SELECT page_id, count(*) AS pairs FROM a JOIN b USING (page_id) WHERE a.m <> '' AND b.m <> '' AND length(a.pre) < length(b.pre) + length(b.m) AND length(b.pre) < length(a.pre) + length(a.m) GROUP BY 1""")
def span_overlap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    a = extract.first_span(pages, "page_id", "url", r"(://[^/?#]+/[a-z]*)").select("page_id", F.col("start").alias("s"), F.col("end").alias("e"))
    b = extract.first_span(pages, "page_id", "url", r"(/[a-z]{2}/[0-9]+)")
    return a.join(b, "page_id").where("s < end AND start < e").groupBy("page_id").agg(F.count("*").alias("pairs"))


@query("id_grid_check", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS repeated")
def id_grid_check(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    missing = d.join(l, "doc_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = l.join(d, "doc_id", "left_anti").agg(F.count("*").alias("extra"))
    repeated = l.agg((F.count("*") - F.countDistinct("doc_id")).alias("repeated"))
    one = F.lit(1)
    return missing.withColumn("k", one).join(extra.withColumn("k", one), "k").join(repeated.withColumn("k", one), "k").drop("k")


@query("lzma_cost")
def lzma_cost(spark, sf_dir):
    return blocks.archive_sizes(_numbered(spark, sf_dir))


def _numbered(spark, sf_dir):
    return lines(spark, sf_dir).select(F.expr("doc_id div 100").alias("block_id"), F.struct("doc_id", "line_no").alias("pos"), "line")


@query("block_archive_roundtrip", "WITH b AS (SELECT doc_id // 100 AS block_id, string_agg(text, chr(10) ORDER BY doc_id) AS raw FROM documents GROUP BY 1) SELECT block_id, sha256(raw) AS digest, octet_length(encode(raw)) AS raw_bytes, true AS exact FROM b")
def block_archive_roundtrip(spark, sf_dir):
    """Blocks packed and unpacked: digest and size of what came back."""
    back = blocks.decoded(blocks.encoded(_numbered(spark, sf_dir)))
    return back.select("block_id", F.sha2("raw", 256).alias("digest"), F.octet_length("raw").cast("long").alias("raw_bytes"), "exact")
