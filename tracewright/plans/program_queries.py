"""Queries on guarded replay, integer programs, accepted spans, dictionaries' inverses and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import tokens as T
from tracewright.operators import extract, programs, templates
from tracewright.plans.registry import query, table
from tracewright.plans.text_queries import LINES_SQL, lines
from tracewright.sources import sinks

EXPRESSIONS = {"e1": "g0 * 1000 + g1", "e2": "(g0 - g1) // 7", "e3": "(g1 - g0) % 60", "e4": "g0 << 3", "e5": "-g1 + int(g0)", "e6": "g0 >> 2"}


@query("int_expressions", "SELECT o_orderkey, o_orderkey * 1000 + o_custkey AS e1, CAST(floor((o_orderkey - o_custkey) / 7) AS BIGINT) AS e2, (((o_custkey - o_orderkey) % 60) + 60) % 60 AS e3, o_orderkey * 8 AS e4, o_orderkey - o_custkey AS e5, o_orderkey // 4 AS e6 FROM orders")
def int_expressions(spark, sf_dir):
    """Integer programs over two captured groups."""
    groups = {"g0": F.col("o_orderkey").cast("string"), "g1": F.col("o_custkey").cast("string")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[programs.int_expression(e, groups).alias(n) for n, e in EXPRESSIONS.items()])


@query("int_templates", "SELECT o_custkey AS v, 'k' || CAST(o_custkey // 100 AS VARCHAR) || ':' || CASE WHEN length(CAST(o_custkey % 100 AS VARCHAR)) < 3 THEN lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0') ELSE CAST(o_custkey % 100 AS VARCHAR) END || '!' AS text, count(*) AS cnt FROM orders GROUP BY 1, 2")
def int_templates(spark, sf_dir):
    v = F.col("o_custkey")
    return table(spark, sf_dir, "orders").groupBy(v.alias("v"), programs.int_template("k{v // 100}:{v % 100:03}!", v).alias("text")).agg(F.count("*").alias("cnt"))


@query("replay_fallback", r"WITH s AS (SELECT page_id, regexp_extract(url, '/([0-9]+)([^0-9]|$)', 1) AS g, regexp_extract(url, '/([0-9]+)') AS span FROM pages) SELECT page_id, CASE WHEN CAST(CAST(g AS BIGINT) AS VARCHAR) = g THEN CAST(g AS BIGINT) // 16 END AS q, CASE WHEN CAST(CAST(g AS BIGINT) AS VARCHAR) <> g THEN span END AS fallback FROM s WHERE span <> ''")
def replay_fallback(spark, sf_dir):
    """Numbers in urls as quotient and rest of 16; the whole span where the inverse doesn't give it back."""
    back = lambda x: F.concat(F.lit("/"), (x["q"] * 16 + x["r"]).cast("string"))
    out = programs.replayed(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "/([0-9]+)", {"q": "g1 // 16", "r": "g1 % 16"}, back)
    return out.select("page_id", "latents.q", "fallback")


@query("accepted_spans", r"""WITH m AS (SELECT page_id, url, regexp_extract(url, '([a-z]+[.]example)', 1) AS a, regexp_extract(url, '(//[^/]+)', 1) AS b, regexp_extract(url, '(/[a-z]{2}/[0-9]*)', 1) AS c FROM pages),
p AS (SELECT page_id, a, b, c, strpos(url, a) - 1 AS sa, length(regexp_extract(url, '^(.*?)(//[^/]+)', 1)) AS sb, length(regexp_extract(url, '^(.*?)(/[a-z]{2}/[0-9]*)', 1)) AS sc FROM m),
k AS (SELECT *, a <> '' AS ka, b <> '' AND NOT (a <> '' AND sb < sa + length(a) AND sb + length(b) > sa) AS kb FROM p), l AS (SELECT *, c <> '' AND NOT (ka AND sc < sa + length(a) AND sc + length(c) > sa) AND NOT (kb AND sc < sb + length(b) AND sc + length(c) > sb) AS kc FROM k)
SELECT page_id, 0 AS spec, CAST(sa AS INTEGER) AS start, CAST(sa + length(a) AS INTEGER) AS "end" FROM l WHERE ka UNION ALL SELECT page_id, 1, sb, sb + length(b) FROM l WHERE kb UNION ALL SELECT page_id, 2, sc, sc + length(c) FROM l WHERE kc""")
def accepted_spans(spark, sf_dir):
    """Matches of three patterns that don't meet those of an earlier one."""
    return programs.accepted_spans(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "url", ["([a-z]+[.]example)", "(//[^/]+)", "(/[a-z]{2}/[0-9]*)"])


@query("placeholder_guard", r"""WITH h AS (SELECT regexp_replace(url, '://[^/?#]+', '://' || chr(57344), 'g') AS u FROM pages)
SELECT 'host' AS tag, CAST(0 AS BIGINT) AS lines UNION ALL SELECT 'rest', count(*) FILTER (WHERE regexp_matches(u, '//[^/]*' || chr(57344) || '[^/]*/')) FROM h""")
def placeholder_guard(spark, sf_dir):
    """A field that would capture an earlier field's placeholder, and in how many lines."""
    plan = (extract.Field("host", "://", "[^/?#]+"), extract.Field("rest", "//", "[^/]+", "/"))
    return programs.guarded(table(spark, sf_dir, "pages").select(F.col("url").alias("text")), plan)


@query("two_pass_kinds", r"""WITH a AS (SELECT page_id, url, regexp_extract_all(url, '://([^/?#]+)', 1) AS host, regexp_replace(url, '://[^/?#]+', '://<H>', 'g') AS u1 FROM pages), b AS (SELECT *, regexp_extract_all(u1, '/([a-z]{2})/', 1) AS lang, regexp_replace(u1, '/[a-z]{2}/', '/<L>/', 'g') AS u2 FROM a), c AS (SELECT *, regexp_extract_all(u2, '[0-9]+') AS num FROM b),
o AS (SELECT 'host' AS tag, unnest(host) AS v FROM c UNION ALL SELECT 'lang', unnest(lang) FROM c UNION ALL SELECT 'num', unnest(num) FROM c), s AS (SELECT tag, count(*) AS n, count(DISTINCT v) AS d, bool_and(regexp_full_match(v, '[0-9]{1,18}')) AS numeric, min(length(v)) AS lo, max(length(v)) AS hi FROM o GROUP BY 1)
SELECT tag, CASE WHEN d = 1 THEN 'constant' WHEN numeric AND lo = hi THEN 'int_fixed_width' WHEN numeric THEN 'int_width' WHEN d * 4 <= n THEN 'dictionary' ELSE 'string' END AS kind FROM s""")
def two_pass_kinds(spark, sf_dir):
    """Kinds of a plan's streams: all occurrences are analysed first, then each stream is given its kind."""
    _, found = extract.apply_plan(table(spark, sf_dir, "pages").select(F.col("page_id").alias("line_no"), F.col("url").alias("text")), extract.URL_PLAN)
    return programs.kinds_of(programs.analysed(found))


@query("line_dictionary_expand", f"WITH {LINES_SQL} SELECT doc_id, line_no, md5(line) AS digest FROM lines")
def line_dictionary_expand(spark, sf_dir):
    """Lines that went to the block's dictionary and came back, by digest."""
    rows = lines(spark, sf_dir).withColumn("block_id", F.expr("doc_id div 100"))
    coded, entries = templates.dictionary_coded(rows)
    return templates.dictionary_expanded(coded, entries).select("doc_id", "line_no", F.md5("line").alias("digest"))


@query("template_inverse", f"WITH {LINES_SQL} SELECT doc_id, line_no, md5(line) AS digest, CAST(len(regexp_extract_all(line, '[0-9]+')) AS INTEGER) AS pieces FROM lines")
def template_inverse(spark, sf_dir):
    """Lines rebuilt from template ids and ordered values, by digest."""
    rows = lines(spark, sf_dir).withColumn("block_id", F.expr("doc_id div 100"))
    coded, entries = templates.template_coded(rows)
    return templates.template_restored(coded, entries).select("doc_id", "line_no", F.md5("line").alias("digest"), F.size("pieces").alias("pieces"))


@query("codec_chunks", "WITH c AS (SELECT unnest(['none', 'gzip', 'bz2', 'xz', 'zstd']) AS codec), b AS (SELECT doc_id // 100 AS block_id, string_agg(text, chr(10) ORDER BY doc_id) AS raw FROM documents GROUP BY 1) SELECT block_id, codec, octet_length(encode(raw)) AS raw_bytes, sha256(raw) AS digest, true AS exact FROM b, c")
def codec_chunks(spark, sf_dir):
    """Blocks by every codec and back: sizes and digests of what came back."""
    blocks = templates.block_texts(table(spark, sf_dir, "documents"), 100)
    back = sinks.unpacked(sinks.chunks(blocks))
    return back.select("block_id", "codec", F.octet_length("raw").cast("long").alias("raw_bytes"), F.sha2("raw", 256).alias("digest"), "exact")


@query("first_and_range", f"WITH {LINES_SQL}, f AS (SELECT 'first' AS part, doc_id, line_no FROM lines WHERE line_no < 2), r AS (SELECT 'range', doc_id, line_no FROM lines WHERE doc_id // 100 >= 1 AND doc_id // 100 < 3) SELECT part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT * FROM f UNION ALL SELECT * FROM r) GROUP BY 1")
def first_and_range(spark, sf_dir):
    """The first records of each text, and a range of blocks."""
    rows = lines(spark, sf_dir).withColumn("block_id", F.expr("doc_id div 100"))
    first = sinks.first_records(rows, 2).select(F.lit("first").alias("part"), "doc_id")
    both = first.unionByName(sinks.block_range(rows, 1, 3).select(F.lit("range").alias("part"), "doc_id"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("percent_vs_baseline", "WITH m AS (SELECT o_orderpriority AS method, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT method, round(100 * (v / (SELECT v FROM m WHERE method = '1-URGENT') - 1), 6) AS percent FROM m")
def percent_vs_baseline(spark, sf_dir):
    """Each method's total against that of the first, in percent."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.sum("o_totalprice").alias("v"))
    base = m.where("method = '1-URGENT'").select(F.col("v").alias("base"))
    return m.join(F.broadcast(base)).select("method", F.round(100 * (F.col("v") / F.col("base") - 1), 6).alias("percent"))  # one row


@query("timings_by_operation", "SELECT event_type AS op, round(sum(value), 4) AS seconds, count(*) AS n, round(1000 * sum(value) / count(*), 4) AS avg_ms, round(100 / sum(value), 6) AS mb_per_s FROM events GROUP BY 1")
def timings_by_operation(spark, sf_dir):
    """Seconds and calls of every operation, with the speed over 100 MB."""
    total = F.sum("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("op")).agg(F.round(total, 4).alias("seconds"), F.count("*").alias("n"), F.round(1000 * total / F.count("*"), 4).alias("avg_ms"), F.round(100 / total, 6).alias("mb_per_s"))


@query("block_zip", "WITH p AS (SELECT o_orderkey // 1000 AS block_id, CAST(sum(length(CAST(o_custkey AS VARCHAR))) AS BIGINT) AS pool FROM orders GROUP BY 1), e AS (SELECT l_orderkey // 1000 AS block_id, count(*) AS empty FROM lineitem GROUP BY 1) SELECT block_id, pool, empty, pool < empty AS better FROM p JOIN e USING (block_id)")
def block_zip(spark, sf_dir):
    """Two totals of every block side by side."""
    pool = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 1000").alias("block_id")).agg(F.sum(F.length(F.col("o_custkey").cast("string"))).cast("long").alias("pool"))
    empty = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 1000").alias("block_id")).agg(F.count("*").alias("empty"))
    return pool.join(empty, "block_id").withColumn("better", F.col("pool") < F.col("empty"))
