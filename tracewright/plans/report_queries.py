"""Reporting queries: ratios, wins, intervals, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import reports as R
from tracewright.plans.registry import query, table

RATIO = "l_extendedprice / (1000 * l_quantity)"


@query("ratio_aggregates", "WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS raw, 1000 * l_quantity AS arc FROM lineitem) SELECT l_returnflag, l_linestatus, round(avg(raw / arc), 6) AS mean, round(exp(avg(ln(raw / arc))), 6) AS geomean, round(sum(raw) / sum(arc), 6) AS corpus FROM r GROUP BY 1, 2")
def ratio_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("raw"), (1000 * F.col("l_quantity")).alias("arc"))
    return R.ratios(rows, ["l_returnflag", "l_linestatus"], "raw", "arc")


@query("wins_vs_baseline", "SELECT s_nationkey AS nation, CAST(sum(CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END) AS BIGINT) AS wins, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def wins_vs_baseline(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count_if(F.col("l_extendedprice") > 30000).alias("wins"), F.count("*").alias("n"))


@query("byte_weighted_speed", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_extendedprice / l_quantity), 6) AS speed FROM lineitem GROUP BY 1")
def byte_weighted_speed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / F.sum(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("speed"))


@query("median_trials", "SELECT o_orderpriority AS grp, round(median(o_totalprice), 4) AS median, round(100 * (max(o_totalprice) / min(o_totalprice) - 1), 4) AS spread FROM orders GROUP BY 1")
def median_trials(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.round(F.median(price), 4).alias("median"), F.round(100 * (F.max(price) / F.min(price) - 1), 4).alias("spread"))


@query("timing_summary", "WITH m AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, median(o_totalprice) AS med FROM orders GROUP BY 1, 2) SELECT method, count(*) AS datasets, round(exp(avg(ln(med))), 4) AS gmean FROM m GROUP BY 1")
def timing_summary(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), "o_orderstatus").agg(F.median("o_totalprice").alias("med"))
    return m.groupBy("method").agg(F.count("*").alias("datasets"), F.round(F.exp(F.avg(F.ln("med"))), 4).alias("gmean"))


_WILSON = "round(({p} + 3.8416 / (2 * n) {s} 1.96 * sqrt({p} * (1 - {p}) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6)"


@query("wilson_strata", f"WITH s AS (SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT lang, n, k, {_WILSON.format(p='(k / n)', s='-')} AS lo, {_WILSON.format(p='(k / n)', s='+')} AS hi FROM s")
def wilson_strata(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return R.wilson(joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("k")))


@query("label_set_diff", "WITH s AS (SELECT doc_id, list_filter(['quality', 'labelled'], lambda x: x = 'labelled' OR quality = 1) AS a, list_filter(['toxic', 'labelled'], lambda x: x = 'labelled' OR toxic = 1) AS b FROM labels) SELECT doc_id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS only_a, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS only_b FROM s")
def label_set_diff(spark, sf_dir):
    labelled = F.array(F.lit("labelled"))
    a = F.when(F.col("quality") == 1, F.concat(F.array(F.lit("quality")), labelled)).otherwise(labelled)
    b = F.when(F.col("toxic") == 1, F.concat(F.array(F.lit("toxic")), labelled)).otherwise(labelled)
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(F.array_except(a, b), ",").alias("only_a"), F.array_join(F.array_except(b, a), ",").alias("only_b"))


@query("systematic_sample", "WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT n, least(8, n - 1) AS k FROM n), i AS (SELECT n, k, unnest(range(0, k)) AS i FROM k) SELECT i, CAST(floor(1 + i * (n - 2) / (k - 1) + 0.5) AS BIGINT) AS idx FROM i")
def systematic_sample(spark, sf_dir):
    return R.systematic_sample(table(spark, sf_dir, "documents").agg(F.count("*").alias("n")), 8)


@query("best_method", "WITH m AS (SELECT l_shipmode AS dataset, l_returnflag AS method, sum(l_extendedprice) / sum(l_quantity) AS ratio FROM (SELECT *, l_linenumber AS l_shipmode FROM lineitem) GROUP BY 1, 2) SELECT CAST(dataset AS BIGINT) AS dataset, method, round(ratio, 4) AS ratio FROM m QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ratio DESC, method) = 1")
def best_method(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("dataset"), F.col("l_returnflag").alias("method")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("ratio"))
    best = m.groupBy("dataset").agg(F.max_by(F.struct("method", "ratio"), F.struct("ratio", -F.ascii("method"))).alias("b"))
    return best.select("dataset", F.col("b.method").alias("method"), F.round("b.ratio", 4).alias("ratio"))


@query("category_census", "WITH c AS (SELECT doc_id, source, unnest(list_filter(['good', 'toxic', 'long'], lambda x: (x = 'good' AND quality = 1) OR (x = 'toxic' AND toxic = 1) OR (x = 'long' AND n_chars > 2000))) AS category FROM documents JOIN labels USING (doc_id)) SELECT category, count(*) AS n, count(DISTINCT source) AS sources FROM c GROUP BY 1")
def category_census(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    kinds = F.filter(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") > 2000, "long")), lambda x: x.isNotNull())
    return d.select("source", F.explode(kinds).alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("rule_union", "SELECT DISTINCT regexp_replace(shape, '[0-9]+', '#', 'g') AS sig FROM (SELECT url AS shape FROM pages UNION ALL SELECT c_name FROM customer)")
def rule_union(spark, sf_dir):
    both = table(spark, sf_dir, "pages").select(F.col("url").alias("shape")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("shape")))
    return both.select(F.regexp_replace("shape", "[0-9]+", "#").alias("sig")).distinct()
