"""Queries on skeleton kinds, digit tuples, layouts and the variants of recency ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators import skeletons as K
from tracewright.operators import streams as S
from tracewright.plans.registry import query, table
from tracewright.plans.stream_queries import E_SQL, POS, VL, ZZ, stream

NUM = "[0-9]+(?:[.][0-9]+)?"
STREAMS_SQL = """s AS (SELECT 'c_name' AS stream, c_custkey AS pos, c_name AS text FROM customer UNION ALL SELECT 'p_name', p_partkey, p_name FROM part UNION ALL SELECT 'p_brand', p_partkey, p_brand FROM part
 UNION ALL SELECT 'o_date', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'url', page_id, url FROM pages UNION ALL SELECT 'custkey', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders)"""


def _streams(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    one = lambda name, df, pos, text: df.select(F.lit(name).alias("stream"), F.col(pos).alias("pos"), text.alias("text"))
    out = one("c_name", t("customer"), "c_custkey", F.col("c_name"))
    for more in (
        one("p_name", t("part"), "p_partkey", F.col("p_name")), one("p_brand", t("part"), "p_partkey", F.col("p_brand")), one("o_date", t("orders"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd")),
        one("url", t("pages"), "page_id", F.col("url")), one("custkey", t("orders"), "o_orderkey", F.col("o_custkey").cast("string")),
    ):
        out = out.unionByName(more)
    return out


@query("skeleton_kinds", f"WITH {STREAMS_SQL}, l AS (SELECT stream, regexp_replace(text, '{NUM}', chr(31), 'g') AS k, len(regexp_extract_all(text, '{NUM}')) AS a FROM s) SELECT stream, count(*) AS n, count(DISTINCT k) AS skeletons, min(a) > 0 AND count(DISTINCT k) = 1 AS numeric, min(a) > 0 AND min(a) = max(a) AS mixed, CASE WHEN min(a) = max(a) THEN min(a) END AS arity FROM l GROUP BY 1")
def skeleton_kinds(spark, sf_dir):
    """Which skeleton kinds each stream allows."""
    return K.shapes_of_streams(_streams(spark, sf_dir), "stream", "text")


@query("shape_mixed_skeleton", f"""WITH p AS (SELECT page_id // 1000 AS block_id, page_id AS pos, regexp_replace(url, '{NUM}', chr(31), 'g') AS k, regexp_extract_all(url, '{NUM}') AS v FROM pages), f AS (SELECT block_id, k, min(pos) AS pos0 FROM p GROUP BY 1, 2), i AS (SELECT block_id, k, row_number() OVER (PARTITION BY block_id ORDER BY pos0) - 1 AS shape_id FROM f),
x AS (SELECT p.block_id, shape_id, pos, CAST(replace(unnest(v), '.', '') AS BIGINT) AS value, generate_subscripts(v, 1) - 1 AS col FROM p JOIN i USING (block_id, k)), d AS (SELECT *, value - lag(value, 1, 0) OVER (PARTITION BY block_id, shape_id, col ORDER BY pos) AS d FROM x)
SELECT block_id, shape_id, col, count(*) AS n, CAST(sum({VL.format('(' + ZZ.format('d') + ')')}) AS BIGINT) AS bytes FROM d GROUP BY 1, 2, 3""")
def shape_mixed_skeleton(spark, sf_dir):
    """Bytes of every numeric column of every shape of a block's urls."""
    pages = table(spark, sf_dir, "pages").select(F.expr("page_id div 1000").alias("block_id"), F.col("page_id").alias("pos"), F.col("url").alias("text"))
    d = K.numeric_columns(K.shape_columns(pages, "block_id", "pos", "text"), "block_id", "pos")
    return d.groupBy("block_id", "shape_id", F.col("col").cast("long").alias("col")).agg(F.count("*").alias("n"), F.sum(V.varint_length(V.zigzag(F.col("delta")))).cast("long").alias("bytes"))


@query("skeleton_restore", "SELECT page_id, md5(url) AS digest FROM pages")
def skeleton_restore(spark, sf_dir):
    """Urls rebuilt from shapes, deltas and widths, by digest."""
    pages = table(spark, sf_dir, "pages").select(F.expr("page_id div 1000").alias("block_id"), "page_id", F.col("url").alias("text"))
    return K.restored(K.shape_columns(pages, "block_id", "page_id", "text"), "block_id", "page_id").select("page_id", F.md5("restored").alias("digest"))


MIXED_SQL = f"""b AS (SELECT c_custkey // 1000 AS block_id, c_custkey AS pos, c_name || '/' || c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS text FROM customer), p AS (SELECT block_id, pos, regexp_extract_all(text, '{NUM}') AS v, string_split_regex(text, '{NUM}') AS l FROM b)"""


@query("mixed_skeleton", f"""WITH {MIXED_SQL}, x AS (SELECT block_id, pos, CAST(unnest(v) AS BIGINT) AS value, generate_subscripts(v, 1) - 1 AS col FROM p), d AS (SELECT *, value - lag(value, 1, 0) OVER (PARTITION BY block_id, col ORDER BY pos) AS d FROM x), y AS (SELECT block_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS col FROM p)
SELECT block_id, 'number' AS part, col, count(*) AS n, CAST(sum({VL.format('(' + ZZ.format('d') + ')')}) AS BIGINT) AS cost FROM d GROUP BY 1, 3 UNION ALL SELECT block_id, 'literal', col, count(*), count(DISTINCT t) FROM y GROUP BY 1, 3""")
def mixed_skeleton(spark, sf_dir):
    """Numeric columns (bytes of deltas) and literal columns (distinct texts) of values with one number count."""
    text = F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 1000").alias("block_id"), F.col("c_custkey").alias("pos"), text.alias("text"))
    cut = rows.select("block_id", "pos", F.transform(K.numbers(F.col("text")), K.decimal_parts).alias("v"), K.literals(F.col("text")).alias("l"))
    x = cut.select("block_id", "pos", F.posexplode("v").alias("col", "x")).select("block_id", "pos", "col", "x.value").withColumn("d", S.delta("value", ["block_id", "col"], "pos"))
    numbers = x.groupBy("block_id", F.lit("number").alias("part"), F.col("col").cast("long").alias("col")).agg(F.count("*").alias("n"), F.sum(V.varint_length(V.zigzag(F.col("d")))).cast("long").alias("cost"))
    y = cut.select("block_id", F.posexplode("l").alias("col", "t"))
    return numbers.unionByName(y.groupBy("block_id", F.lit("literal").alias("part"), F.col("col").cast("long").alias("col")).agg(F.count("*").alias("n"), F.countDistinct("t").alias("cost")))


URLS_SQL = "u AS (SELECT page_id // 1000 AS block_id, page_id AS pos, url AS text FROM pages)"


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.expr("page_id div 1000").alias("block_id"), F.col("page_id").alias("pos"), F.col("url").alias("text"))


@query("digit_tuple_dictionary", f"""WITH {URLS_SQL}, c AS (SELECT block_id, pos, regexp_extract(text, '^(.*?)([0-9]+)([^0-9]*)$', 1) || chr(31) || regexp_extract(text, '^(.*?)([0-9]+)([^0-9]*)$', 3) AS prefix, regexp_extract(text, '^(.*?)([0-9]+)([^0-9]*)$', 2) AS g FROM u WHERE regexp_matches(text, '[0-9]'))
SELECT block_id, pos, md5(prefix) AS prefix, CAST(g AS BIGINT) - lag(CAST(g AS BIGINT), 1, 0) OVER (PARTITION BY block_id, prefix ORDER BY pos) AS d, length(g) AS width FROM c""")
def digit_tuple_dictionary(spark, sf_dir):
    return K.prefix_deltas(_urls(spark, sf_dir), "block_id", "pos", "text").withColumn("prefix", F.md5("prefix"))


@query("digit_columns_prefix", f"""WITH {URLS_SQL}, r AS (SELECT block_id, pos, regexp_extract_all(text, '[0-9]+') AS r FROM u), c AS (SELECT block_id, pos, coalesce(array_to_string(r[1:len(r) - 1], ','), '') AS others, CAST(r[len(r)] AS BIGINT) AS v FROM r WHERE len(r) > 0)
SELECT block_id, pos, v - lag(v, 1, 0) OVER (PARTITION BY block_id, others ORDER BY pos) AS d FROM c""")
def digit_columns_prefix(spark, sf_dir):
    return K.column_prefix_deltas(_urls(spark, sf_dir), "block_id", "pos", "text")


PADDED_SQL = "w AS (SELECT o_orderkey // 1000 AS block_id, o_orderkey AS pos, lpad(CAST(o_custkey AS VARCHAR), CAST(length(CAST(o_custkey AS VARCHAR)) + o_orderkey % 3 AS INTEGER), '0') AS text FROM orders)"


@query("layout_shared_delta", f"""WITH {PADDED_SQL}, c AS (SELECT block_id, pos, CAST(text AS BIGINT) AS v, length(text) - length(CAST(CAST(text AS BIGINT) AS VARCHAR)) AS zeros FROM w), f AS (SELECT block_id, zeros, min(pos) AS pos0 FROM c GROUP BY 1, 2), i AS (SELECT block_id, zeros, row_number() OVER (PARTITION BY block_id ORDER BY pos0) - 1 AS layout_id FROM f)
SELECT block_id, pos, v - lag(v, 1, 0) OVER (PARTITION BY block_id ORDER BY pos) AS d, zeros, layout_id FROM c JOIN i USING (block_id, zeros)""")
def layout_shared_delta(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    padded = F.concat(F.repeat(F.lit("0"), (F.col("o_orderkey") % 3).cast("int")), key)
    rows = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 1000").alias("block_id"), F.col("o_orderkey").alias("pos"), padded.alias("text"))
    return K.layout_deltas(rows, "block_id", "pos", "text")


@query("fixed_widths", f"""WITH s AS (SELECT 'date' AS stream, o_orderkey AS pos, strftime(o_orderdate, '%Y%m%d') AS text FROM orders UNION ALL SELECT 'custkey', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders), d AS (SELECT stream, length(text) AS w, CAST(text AS BIGINT) AS v, CAST(text AS BIGINT) - lag(CAST(text AS BIGINT), 1, 0) OVER (PARTITION BY stream ORDER BY pos) AS d FROM s)
SELECT stream, CASE WHEN min(w) = max(w) THEN min(w) END AS width, CAST(sum({VL.format('v')}) AS BIGINT) AS abs_bytes, CAST(sum({VL.format('(' + ZZ.format('d') + ')')}) AS BIGINT) AS delta_bytes FROM d GROUP BY 1""")
def fixed_widths(spark, sf_dir):
    """Streams of one width and their bytes, plain and as deltas."""
    orders = table(spark, sf_dir, "orders")
    one = lambda name, text: orders.select(F.lit(name).alias("stream"), F.col("o_orderkey").alias("pos"), text.alias("text"))
    return K.fixed_widths(one("date", F.date_format("o_orderdate", "yyyyMMdd")).unionByName(one("custkey", F.col("o_custkey").cast("string"))), "stream", "pos", "text")


def _mtf_sql(keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""p AS (SELECT {keys}, event_id, event_type, lag(event_id) OVER (PARTITION BY {keys}, event_type ORDER BY event_id) AS prev FROM e),
r AS (SELECT {cols}, a.event_id, CASE WHEN a.prev IS NULL THEN 0 ELSE 1 + count(b.event_id) END AS rank FROM p a LEFT JOIN p b ON {on} AND b.event_id > a.prev AND b.event_id < a.event_id AND (b.prev IS NULL OR b.prev < a.prev) GROUP BY {cols}, a.event_id, a.prev)"""


@query("mtf_by_context", f"WITH {E_SQL}, {_mtf_sql('block_id, user_id')} SELECT block_id, user_id, event_id, rank FROM r")
def mtf_by_context(spark, sf_dir):
    return K.mtf_by(stream(spark, sf_dir), "event_type", ["block_id", "user_id"], POS)


@query("mtf_rank_deltas", f"WITH {E_SQL}, {_mtf_sql('block_id')} SELECT block_id, event_id, rank, rank - lag(rank, 1, 0) OVER (PARTITION BY block_id ORDER BY event_id) AS d FROM r")
def mtf_rank_deltas(spark, sf_dir):
    return K.mtf_deltas(stream(spark, sf_dir), "event_type", "block_id", POS)


HEX_SQL = "h AS (SELECT 'seg' || CAST(o_orderkey % 5 AS VARCHAR) AS stream, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 4 THEN 'x' ELSE '' END || hex(o_orderkey) AS text FROM orders)"


@query("hex_merge", f"WITH {HEX_SQL}, g AS (SELECT stream, count(*) AS n FROM h GROUP BY 1 HAVING bool_and(regexp_full_match(text, '[0-9a-fA-F]+')) AND count(*) >= 64) SELECT stream, CAST(coalesce(sum(n) OVER (ORDER BY stream ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", n FROM g")
def hex_merge(spark, sf_dir):
    """Slices of hexadecimal streams in one merged stream."""
    mark = F.when(F.col("o_orderkey") % 5 == 4, "x").otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("seg"), (F.col("o_orderkey") % 5).cast("string")).alias("stream"), F.col("o_orderkey").alias("pos"), F.concat(mark, F.hex("o_orderkey")).alias("text"))
    return K.merged_streams(rows, "stream", "pos")


@query("surrogate_gain", f"""WITH {STREAMS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM s), g AS (SELECT stream, pos, text, n FROM i WHERE i % greatest(1, n // 4096) = 0 AND i // greatest(1, n // 4096) < 4096),
v AS (SELECT *, CASE WHEN regexp_full_match(text, '-?[0-9]+(\\.[0-9]+)?') THEN CAST(replace(text, '.', '') AS BIGINT) END AS v, CASE WHEN contains(text, '.') THEN 2 ELSE 1 END AS w FROM g), d AS (SELECT *, v - lag(v, 1, 0) OVER (PARTITION BY stream ORDER BY pos) AS d FROM v),
a AS (SELECT stream, count(*) AS sampled, max(n) AS n, sum(length(text) + 1) AS raw, count(DISTINCT text) AS k, sum(length(text)) AS chars, bool_and(v IS NOT NULL) AS numeric, sum({VL.format('(' + ZZ.format('d') + ')')} + w) AS num FROM d GROUP BY 1)
SELECT stream, sampled, CAST(trunc((raw - least(raw, k * greatest(1, floor(chars / sampled)), CASE WHEN numeric THEN num ELSE raw END) - 32) * n / sampled) AS BIGINT) AS gain FROM a""")
def surrogate_gain(spark, sf_dir):
    return K.surrogate_gains(_streams(spark, sf_dir), "stream", "pos", "text")
