"""Queries on per-block choices, triggers and event windows. Blocks are hours of events; a key is the day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import adaptive as A
from tracewright.plans.registry import query, table
from tracewright.plans.value_queries import events

B_SQL = """b AS (SELECT epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 3600000000 AS block_id, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS plan_total, CAST(100 * sum(length(props)) AS BIGINT) AS empty_total FROM events GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN plan_total < empty_total THEN 'plan' ELSE 'empty' END AS chosen, least(plan_total, empty_total) AS total, plan_total >= empty_total OR plan_total > 0.99 * empty_total AS loss FROM b)"""
S_SQL = """s AS (SELECT *, CAST(sum(CASE WHEN loss THEN 1 ELSE 0 END) OVER w AS BIGINT) AS losses, sum(CASE WHEN loss THEN 1 ELSE 0 END) OVER w >= 3 AND count(*) OVER w >= 3 AS fired FROM c WINDOW w AS (PARTITION BY day ORDER BY block_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def blocks(spark, sf_dir):
    e = events(spark, sf_dir)
    keyed = e.groupBy(F.expr("us div 86400000000").alias("day"), F.expr("us div 3600000000").alias("block_id"))
    return keyed.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("plan_total"), (100 * F.sum(F.length("props"))).alias("empty_total"))


@query("block_min_choice", f"WITH {B_SQL} SELECT block_id, chosen, total FROM c")
def block_min_choice(spark, sf_dir):
    return A.choose(blocks(spark, sf_dir)).select("block_id", "chosen", "total")


@query("loss_window5", f"WITH {B_SQL}, {S_SQL} SELECT block_id, losses, fired FROM s")
def loss_window5(spark, sf_dir):
    return A.losses_in_span(A.choose(blocks(spark, sf_dir)), "day").select("block_id", "losses", "fired")


@query("first_trigger", f"WITH {B_SQL}, {S_SQL} SELECT day, min(block_id) AS block_id FROM s WHERE fired GROUP BY 1")
def first_trigger(spark, sf_dir):
    return A.losses_in_span(A.choose(blocks(spark, sf_dir)), "day").where("fired").groupBy("day").agg(F.min("block_id").alias("block_id"))


@query("cumulative_ratio", f"WITH {B_SQL} SELECT block_id, round(sum(plan_total) OVER w / sum(empty_total) OVER w, 6) AS ratio FROM b WINDOW w AS (PARTITION BY day ORDER BY block_id ROWS UNBOUNDED PRECEDING)")
def cumulative_ratio(spark, sf_dir):
    return A.cumulative_ratio(blocks(spark, sf_dir), "day", "plan_total", "empty_total").select("block_id", "ratio")


@query("suffix_ratio", f"WITH {B_SQL}, f AS (SELECT *, min(block_id) OVER (PARTITION BY day) AS first FROM b) SELECT day, round(sum(plan_total) / sum(empty_total), 6) AS ratio_all, round(sum(plan_total) FILTER (block_id > first) / sum(empty_total) FILTER (block_id > first), 6) AS ratio_suffix FROM f GROUP BY 1")
def suffix_ratio(spark, sf_dir):
    f = blocks(spark, sf_dir).withColumn("later", F.col("block_id") > F.min("block_id").over(Window.partitionBy("day")))
    later = lambda c: F.sum(F.when(F.col("later"), F.col(c)))
    return f.groupBy("day").agg(F.round(F.sum("plan_total") / F.sum("empty_total"), 6).alias("ratio_all"), F.round(later("plan_total") / later("empty_total"), 6).alias("ratio_suffix"))


@query("events_tumbling", "SELECT epoch_us(ts) // 300000000 AS win, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    """An extension beyond the engine's own count windows: event-time windows of five minutes."""
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    counted = table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("cnt"))
    return counted.select(F.expr("unix_micros(w.start) div 300000000").alias("win"), "event_type", "cnt")


@query("events_session", """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, us, sum(nw) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(us) AS start_us, count(*) AS cnt FROM s GROUP BY user_id, sid""")
def events_session(spark, sf_dir):
    """An extension: sessions of a user that end after thirty idle minutes."""
    s = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    counted = table(spark, sf_dir, "events").groupBy("user_id", s.alias("w")).agg(F.count("*").alias("cnt"))
    return counted.select("user_id", F.expr("unix_micros(w.start)").alias("start_us"), "cnt")
