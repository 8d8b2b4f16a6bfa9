"""Queries on relations between streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators import extract
from tracewright.operators import relations as R
from tracewright.plans.registry import query, table
from tracewright.plans.value_queries import _sig3

PORT_SQL = """WITH e AS (SELECT event_id // 1000 AS block_id, event_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS ip0, CASE WHEN event_id % 4 <> 0 THEN (event_id * 7919) % 65536 END AS port FROM events),
k AS (SELECT *, last_value(ip0 IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ip FROM e),
d AS (SELECT block_id, event_id, ip, port - lag(port, 1, 0) OVER (PARTITION BY block_id, ip ORDER BY event_id) AS d FROM k WHERE port IS NOT NULL)
SELECT block_id, event_id, ip, d, CASE WHEN (d % 65536 + 65536) % 65536 >= 32768 THEN (d % 65536 + 65536) % 65536 - 65536 ELSE (d % 65536 + 65536) % 65536 END AS d16 FROM d"""


@query("port_by_ip", PORT_SQL)
def port_by_ip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("block_id"), "event_id", F.when(F.col("event_id") % 4 == 0, F.col("user_id")).alias("ip0"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 7919 % 65536).alias("port"))
    return R.port_by_ip(e, "block_id", "event_id", "ip0", "port")


SIZE_SQL = f"""WITH l AS (SELECT event_id // 1000 AS block_id, event_id, CASE WHEN event_id % 2 = 0 THEN (event_id * 7919) % 3000000 END AS bytes, (CASE WHEN event_id % 3 = 0 THEN event_id ELSE event_id - 1 END * 7919) % 3000000 AS n FROM events),
t AS (SELECT *, CASE WHEN event_id % 2 = 1 THEN '(' || CASE WHEN n >= 1048576 THEN {_sig3(1 << 20)} || ' MB' WHEN n >= 1024 THEN {_sig3(1024)} || ' KB' ELSE n || ' B' END || ')' END AS text, last_value(bytes IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l),
p AS (SELECT block_id, event_id, text, b AS n FROM t WHERE text IS NOT NULL), q AS (SELECT *, coalesce('(' || CASE WHEN n >= 1048576 THEN {_sig3(1 << 20)} || ' MB' WHEN n >= 1024 THEN {_sig3(1024)} || ' KB' ELSE n || ' B' END || ')' = text, false) AS predicted FROM p)
SELECT block_id, event_id, predicted, CASE WHEN NOT predicted THEN text END AS exception FROM q"""


@query("size_from_bytes", SIZE_SQL)
def size_from_bytes(spark, sf_dir):
    i = F.col("event_id")
    source = F.when(i % 3 == 0, i).otherwise(i - 1) * 7919 % 3000000
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("block_id"), "event_id", F.when(i % 2 == 0, i * 7919 % 3000000).alias("bytes"), F.when(i % 2 == 1, V.pretty_size(source)).alias("text"))
    return R.size_from_bytes(e, "block_id", "event_id", "bytes", "text")


@query("separator_columns", r"""WITH s AS (SELECT url, regexp_replace(url, '[^_.~]', '', 'g') AS sig FROM pages), m AS (SELECT sig, count(*) AS c FROM s GROUP BY 1 ORDER BY c DESC, sig DESC LIMIT 1),
r AS (SELECT url, s.sig = m.sig AND m.c * 2 >= (SELECT count(*) FROM s) AS fits FROM s, m), v AS (SELECT generate_subscripts(regexp_split_to_array(url, '[_.~]'), 1) - 1 AS col, unnest(regexp_split_to_array(url, '[_.~]')) AS value FROM r WHERE fits UNION ALL SELECT NULL, url FROM r WHERE NOT fits)
SELECT CAST(col AS BIGINT) AS col, count(*) AS n, count(DISTINCT value) AS distinct_n FROM v GROUP BY 1""")
def separator_columns(spark, sf_dir):
    return R.separator_columns(table(spark, sf_dir, "pages").select("url"), "url").groupBy(F.col("col").cast("long").alias("col")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_n"))


_STREAMS = (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_linestatus"), ("lineitem", "l_returnflag"), ("customer", "c_mktsegment"), ("region", "r_name"), ("nation", "n_name"))


@query("shared_pools", f"""WITH RECURSIVE v AS ({" UNION ".join(f"SELECT '{c}' AS stream, CAST({c} AS VARCHAR) AS value FROM {t}" for t, c in _STREAMS)}), e AS (SELECT DISTINCT a.stream AS a, b.stream AS b FROM v a JOIN v b USING (value)),
r AS (SELECT DISTINCT stream, stream AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.stream), m AS (SELECT stream, min(root) AS pool FROM r GROUP BY 1), n AS (SELECT pool, count(DISTINCT value) AS pool_size FROM v JOIN m USING (stream) GROUP BY 1) SELECT stream, pool, pool_size FROM m JOIN n USING (pool)""")
def shared_pools(spark, sf_dir):
    out = None
    for t, c in _STREAMS:
        one = table(spark, sf_dir, t).select(F.lit(c).alias("stream"), F.col(c).alias("value"))
        out = one if out is None else out.unionByName(one)
    return R.shared_pools(out)


@query("payload_aliases", "WITH p AS (SELECT o_orderkey // 4 AS block_id, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS payload FROM orders GROUP BY 1) SELECT block_id, min(block_id) OVER (PARTITION BY sha256(payload)) AS alias FROM p")
def payload_aliases(spark, sf_dir):
    blocks = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 4").alias("block_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), ",").alias("payload"))
    return R.aliases(blocks, "block_id", "payload")


@query("routed_split", r"WITH v AS (SELECT regexp_extract(url, '^(.*?)([0-9]+)(.*)$', 1) AS b, regexp_extract(url, '^(.*?)([0-9]+)(.*)$', 2) AS value, regexp_extract(url, '^(.*?)([0-9]+)(.*)$', 3) AS a FROM pages WHERE regexp_matches(url, '[0-9]')) SELECT regexp_replace(right(b, 4), '[0-9]', 'D', 'g') || '<P>' || regexp_replace(left(a, 4), '[0-9]', 'D', 'g') AS route, count(*) AS n, count(DISTINCT value) AS distinct_n FROM v GROUP BY 1")
def routed_split(spark, sf_dir):
    g = lambda i: F.regexp_extract("url", "^(.*?)([0-9]+)(.*)$", i)
    v = table(spark, sf_dir, "pages").where(F.col("url").rlike("[0-9]")).select(F.right(g(1), F.lit(4)).alias("b"), g(2).alias("value"), F.left(g(3), F.lit(4)).alias("a"))
    return v.groupBy(R.route_key(F.col("b"), F.col("a")).alias("route")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_n"))


@query("base62_ids", f"WITH d AS (SELECT event_id, array_to_string(list_transform(range(5, -1, -1), lambda i: substr('{R.ALPHABET}', CAST((event_id // CAST(pow(62, i) AS BIGINT)) % 62 AS INT) + 1, 1)), '') AS t FROM events) SELECT event_id, CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END AS id FROM d")
def base62_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.base62(F.col("event_id")).alias("id"))


@query("structured_tags", r"WITH v AS (SELECT regexp_extract_all(url, '[0-9]+') AS t, regexp_extract(url, '/([a-z]{2})/', 1) AS ctx FROM pages), x AS (SELECT unnest(t) AS t, generate_subscripts(t, 1) - 1 AS i, ctx FROM v) SELECT CAST(i AS VARCHAR) AS idx, CAST(length(t) AS VARCHAR) AS len, nullif(ctx, '') AS ctx, count(*) AS n FROM x GROUP BY ALL")
def structured_tags(spark, sf_dir):
    x = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("ctx"), F.posexplode(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).alias("i", "t"))
    tags = x.groupBy(R.structured_tag(F.col("i"), F.col("t"), F.col("ctx")).alias("tag")).agg(F.count("*").alias("n")).withColumn("m", R.parsed_tag(F.col("tag")))
    part = lambda k: F.try_element_at("m", F.lit(k))
    return tags.select(part("IDX").alias("idx"), part("LEN").alias("len"), part("CTX").alias("ctx"), "n")


@query("candidate_gain", "WITH h AS (SELECT 'host' AS tag, regexp_extract(url, '://([^/?#]+)', 1) AS value FROM pages WHERE regexp_matches(url, '://[^/?#]+')), c AS (SELECT tag, value, count(*) AS c, octet_length(encode(value)) AS len FROM h GROUP BY 1, 2) SELECT tag, CAST(sum(len * c) - sum(c) - sum(len + 1) - 96 AS BIGINT) AS gain, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY 1")
def candidate_gain(spark, sf_dir):
    _, found = extract.apply_plan(table(spark, sf_dir, "pages").select(F.col("page_id").alias("line_no"), F.col("url").alias("text")), extract.URL_PLAN[:1])
    return R.candidate_gain(found)


@query("block_parts", "WITH b AS (SELECT event_id // 100 AS block_id, count(*) AS n FROM events GROUP BY 1) SELECT block_id // 4 AS part, min(block_id) AS first_block, max(block_id) AS last_block, CAST(sum(n) AS BIGINT) AS n FROM b WHERE block_id BETWEEN 2 AND 90 GROUP BY 1")
def block_parts(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 100").alias("block_id")).agg(F.count("*").alias("n"))
    return b.where(F.col("block_id").between(2, 90)).groupBy(F.expr("block_id div 4").alias("part")).agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"), F.sum("n").alias("n"))
