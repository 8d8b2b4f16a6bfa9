"""Queries on ordered streams: deltas, runs, dictionaries, ranks, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import tokens as T
from tracewright.functions import values as V
from tracewright.operators import streams as S
from tracewright.operators import templates
from tracewright.plans.registry import query, table
from tracewright.plans.text_queries import shape_sql

#: Events by user, in order of event_id, with a value in hundredths.
E_SQL = "e AS (SELECT event_id, user_id, event_type, event_id // 1000 AS block_id, CAST(floor(value * 100) AS BIGINT) AS v FROM events)"
ZZ = "CASE WHEN {0} < 0 THEN -2 * ({0}) - 1 ELSE 2 * ({0}) END"
VL = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 WHEN {0} < 34359738368 THEN 5 WHEN {0} < 4398046511104 THEN 6 WHEN {0} < 562949953421312 THEN 7 WHEN {0} < 72057594037927936 THEN 8 ELSE 9 END)"
BY_USER, POS = ["user_id"], "event_id"


def stream(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("event_id div 1000").alias("block_id"), F.floor(F.col("value") * 100).alias("v"))


@query("delta_zigzag", f"WITH {E_SQL}, d AS (SELECT event_id, v - lag(v, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM e) SELECT event_id, d, {ZZ.format('d')} AS z FROM d")
def delta_zigzag(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", S.delta("v", BY_USER, POS).alias("d")).withColumn("z", V.zigzag(F.col("d")))


@query("delta2", f"WITH {E_SQL}, d AS (SELECT *, v - lag(v, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM e) SELECT event_id, d - lag(d, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS dd FROM d")
def delta2(spark, sf_dir):
    return S.delta2(stream(spark, sf_dir), "v", BY_USER, POS).select("event_id", "dd")


@query("delta_roundtrip", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM events")
def delta_roundtrip(spark, sf_dir):
    coded = S.delta2(stream(spark, sf_dir), "v", BY_USER, POS)
    back = coded.withColumn("d", S.undelta("dd", BY_USER, POS)).withColumn("back", S.undelta("d", BY_USER, POS))
    return back.agg(F.count("*").alias("n"), F.count_if(F.col("back") != F.col("v")).alias("mismatches"))


@query("varint_bytes", f"WITH {E_SQL}, d AS (SELECT user_id, v - lag(v, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM e), z AS (SELECT user_id, {ZZ.format('d')} AS z FROM d) SELECT user_id, CAST(sum({VL.format('z')}) AS BIGINT) AS bytes FROM z GROUP BY 1")
def varint_bytes(spark, sf_dir):
    d = stream(spark, sf_dir).select("user_id", S.delta("v", BY_USER, POS).alias("d"))
    return d.groupBy("user_id").agg(F.sum(V.varint_length(V.zigzag(F.col("d")))).alias("bytes"))


RUNS_SQL = f"WITH {E_SQL}, m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY block_id ORDER BY event_id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY block_id ORDER BY event_id) AS run_id FROM m) SELECT block_id, CAST(run_id AS BIGINT) AS run_id, event_type AS value, count(*) AS run_len FROM r GROUP BY ALL"


@query("rle_runs", RUNS_SQL)
def rle_runs(spark, sf_dir):
    return S.runs(stream(spark, sf_dir), "event_type", ["block_id"], POS)


@query("rle_roundtrip", f"WITH {E_SQL} SELECT block_id, count(*) AS n, true AS exact FROM e GROUP BY 1")
def rle_roundtrip(spark, sf_dir):
    rows = stream(spark, sf_dir)
    listed = lambda df, at: F.transform(F.array_sort(F.collect_list(F.struct(*at, df))), lambda x: x[df])
    was = rows.groupBy("block_id").agg(listed("event_type", ["event_id"]).alias("a"))  # a block has at most 1000 rows
    back = S.unruns(S.runs(rows, "event_type", ["block_id"], POS), ["block_id"]).groupBy("block_id").agg(listed("value", ["run_id", "i"]).alias("b"))
    return was.join(back, "block_id").select("block_id", F.size("a").cast("long").alias("n"), (F.col("a") == F.col("b")).alias("exact"))


@query("dictionary_ids", "WITH f AS (SELECT o_orderpriority AS value, min(o_orderkey) AS first_pos, count(*) AS cnt FROM orders GROUP BY 1) SELECT value, row_number() OVER (ORDER BY first_pos) - 1 AS id, first_pos, cnt FROM f")
def dictionary_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lit(0).alias("block_id"))
    return S.dictionary(orders, "o_orderpriority", ["block_id"], "o_orderkey").drop("block_id")


@query("mtf_rank", f"""WITH {E_SQL}, p AS (SELECT block_id, event_id, event_type, lag(event_id) OVER (PARTITION BY block_id, event_type ORDER BY event_id) AS prev FROM e)
SELECT a.block_id, a.event_id, CASE WHEN a.prev IS NULL THEN 0 ELSE 1 + count(b.event_id) END AS rank FROM p a LEFT JOIN p b ON a.block_id = b.block_id AND b.event_id > a.prev AND b.event_id < a.event_id AND (b.prev IS NULL OR b.prev < a.prev) GROUP BY a.block_id, a.event_id, a.prev""")
def mtf_rank(spark, sf_dir):
    return S.mtf_ranks(stream(spark, sf_dir), "event_type", "block_id", POS)


@query("context_delta", f"WITH {E_SQL} SELECT event_id, v - lag(v, 1, 0) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS d FROM e")
def context_delta(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", S.delta("v", ["user_id", "event_type"], POS).alias("d"))


@query("denum_buckets", """WITH k AS (SELECT o_orderkey, o_custkey, o_orderkey // 1000 AS block_id, length(CAST(o_custkey AS VARCHAR)) AS width, CASE WHEN o_custkey >= 1000 THEN CAST(substr(CAST(o_custkey AS VARCHAR), 1, 1) AS BIGINT) ELSE 10 END AS first_digit FROM orders),
d AS (SELECT *, o_custkey - lag(o_custkey, 1, 0) OVER (PARTITION BY block_id, width, first_digit ORDER BY o_orderkey) AS d FROM k) SELECT width, first_digit, count(*) AS n, CAST(sum(abs(d)) AS BIGINT) AS sum_abs_d FROM d GROUP BY 1, 2""")
def denum_buckets(spark, sf_dir):
    width, first = S.denum_key(F.col("o_custkey").cast("string"))
    keyed = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("o_orderkey div 1000").alias("block_id"), width.alias("width"), first.alias("first_digit"))
    d = keyed.withColumn("d", S.delta("o_custkey", ["block_id", "width", "first_digit"], "o_orderkey"))
    return d.groupBy("width", "first_digit").agg(F.count("*").alias("n"), F.sum(F.abs("d")).alias("sum_abs_d"))


@query("modular_split", f"""WITH l AS (SELECT l_orderkey // 1000 AS block_id, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS pos, l_partkey AS v FROM lineitem), p AS (SELECT unnest([10, 30, 60, 100, 300, 600, 1000, 3600, 10000, 65536]) AS period),
d AS (SELECT period, v % period AS r, v // period - lag(v // period, 1, 0) OVER (PARTITION BY block_id, period ORDER BY pos) AS d FROM l, p), z AS (SELECT period, r, {ZZ.format('d')} AS z FROM d) SELECT CAST(period AS BIGINT) AS period, CAST(sum({VL.format('z')}) AS BIGINT) AS q_bytes, count(DISTINCT r) AS r_distinct FROM z GROUP BY 1""")
def modular_split(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 1000").alias("block_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("v"))
    return S.modular_costs(l, "v", ["block_id"], "pos")


@query("circular_u16", f"WITH {E_SQL}, d AS (SELECT event_id, ((v - lag(v, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id)) % 65536 + 65536) % 65536 AS d FROM e) SELECT event_id, CASE WHEN d >= 32768 THEN d - 65536 ELSE d END AS d16 FROM d")
def circular_u16(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", V.circular_u16(S.delta("v", BY_USER, POS)).alias("d16"))


@query("uint16_planes", "SELECT l_partkey % 256 AS lo, (l_partkey // 256) % 256 AS hi, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def uint16_planes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 256).alias("lo"), F.expr("(l_partkey div 256) % 256").alias("hi")).agg(F.count("*").alias("cnt"))


@query("majority_shape", f"WITH s AS (SELECT {shape_sql('url')} AS shape FROM pages), c AS (SELECT shape, count(*) AS c FROM s GROUP BY 1) SELECT shape, round(c / (SELECT count(*) FROM s), 6) AS share, (SELECT count(*) FROM s) - c AS n_exc FROM c ORDER BY c DESC, shape DESC LIMIT 1")
def majority_shape(spark, sf_dir):
    return S.majority_shape(table(spark, sf_dir, "pages"), T.token_shape(F.col("url")))


@query("asof_last_error", f"WITH {E_SQL} SELECT event_id, last_value(CASE WHEN event_type = (SELECT max(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_error_id FROM e")
def asof_last_error(spark, sf_dir):
    rows = stream(spark, sf_dir)
    kind = rows.agg(F.max("event_type").alias("kind"))
    marked = rows.crossJoin(F.broadcast(kind))  # one row
    return marked.select("event_id", S.last_before(F.col("event_id"), F.col("event_type") == F.col("kind"), BY_USER, POS).alias("last_error_id"))


@query("storage_type", """WITH l AS (SELECT 'o_custkey' AS col, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
s AS (SELECT col, bool_and(regexp_full_match(v, '[0-9]{1,18}')) AS numeric, bool_or(regexp_matches(v, '^0[0-9]')) AS zeros, count(DISTINCT v) AS d, count(*) AS n, count(DISTINCT length(v)) AS w FROM l GROUP BY 1)
SELECT col, CASE WHEN numeric AND d = 1 THEN 'ALLSAME' WHEN NOT numeric OR zeros THEN 'MAPPING' WHEN n > 100 AND w >= 3 THEN 'NUMERIC_NODELTA' ELSE 'NUMERIC_DELTA' END AS type FROM s""")
def storage_type(spark, sf_dir):
    return templates.storage_types(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"])


COST_SQL = f"""WITH s AS (SELECT 'custkey' AS stream, o_orderkey AS pos, o_custkey AS v, CAST(o_custkey AS VARCHAR) AS t FROM orders UNION ALL SELECT 'orderkey', o_orderkey, o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders),
b AS (SELECT *, pos // 1000 AS block_id FROM s), d AS (SELECT *, v - lag(v, 1, 0) OVER (PARTITION BY stream, block_id ORDER BY pos) AS d FROM b), dd AS (SELECT *, d - lag(d, 1, 0) OVER (PARTITION BY stream, block_id ORDER BY pos) AS dd FROM d),
z AS (SELECT stream, block_id, v, length(t) AS n, {ZZ.format('d')} AS zd, {ZZ.format('dd')} AS zdd FROM dd),
c AS (SELECT stream, block_id, 'string' AS kind, sum(n + {VL.format('n')}) AS bytes FROM z GROUP BY 1, 2 UNION ALL SELECT stream, block_id, 'int_abs', sum({VL.format('v')}) FROM z GROUP BY 1, 2 UNION ALL SELECT stream, block_id, 'int_delta', sum({VL.format('zd')}) FROM z GROUP BY 1, 2 UNION ALL SELECT stream, block_id, 'int_delta2', sum({VL.format('zdd')}) FROM z GROUP BY 1, 2)"""


def _costs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    one = lambda name, c: orders.select(F.lit(name).alias("stream"), F.col("o_orderkey").alias("pos"), F.col(c).alias("v"))
    rows = one("custkey", "o_custkey").union(one("orderkey", "o_orderkey")).withColumn("block_id", F.expr("pos div 1000")).withColumn("t", F.col("v").cast("string"))
    return S.byte_costs(rows, "v", ["stream", "block_id"], "pos", "t")


@query("codec_cost", f"{COST_SQL} SELECT stream, block_id, kind, CAST(bytes AS BIGINT) AS bytes FROM c")
def codec_cost(spark, sf_dir):
    return _costs(spark, sf_dir)


@query("codec_argmin", f"{COST_SQL} SELECT stream, block_id, kind AS best_kind, CAST(bytes AS BIGINT) AS bytes FROM c QUALIFY row_number() OVER (PARTITION BY stream, block_id ORDER BY bytes, kind) = 1")
def codec_argmin(spark, sf_dir):
    return S.cheapest(_costs(spark, sf_dir), ["stream", "block_id"])
