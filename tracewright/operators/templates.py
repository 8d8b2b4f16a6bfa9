"""Families, templates, dictionaries and admission of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import tokens as T


def family_topk(lines: DataFrame, most: int, min_support: int) -> DataFrame:
    """The most frequent families: family, support, rank. Partial counts first; only the top rows meet in one task."""
    counted = lines.groupBy(T.family_key(F.col("line")).alias("family")).agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    top = counted.orderBy(F.desc("support"), "family").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("support"), "family")).cast("long"))  # at most `most` rows


def family_examples(lines: DataFrame, per_family: int, distance: float) -> DataFrame:
    """Up to per_family unlike lines of each family: family, line.

    The greedy choice goes through all lines of a family in their order: the least line, then the next one that is farther
    than the distance from all chosen, and for the last place the next other line of any kind. Each place is a filter and a
    min with partial results, so no family's lines meet in one task.
    """
    keyed = lines.select(T.family_key(F.col("line")).alias("family"), "line")
    chosen = keyed.groupBy("family").agg(F.min("line").alias("last")).withColumn("examples", F.array("last"))
    for place in range(2, per_family + 1):
        open_ = chosen.where(F.size("examples") == place - 1)  # the others have run out of lines far enough
        after = keyed.join(open_, "family").where(F.col("line") > F.col("last"))
        if place < per_family:
            features = T.line_features(F.col("line"))
            after = after.where(F.forall("examples", lambda x: 1 - T.jaccard(features, T.line_features(x)) > distance))
        following = after.groupBy("family").agg(F.min("line").alias("next"))
        more = F.when(F.col("next").isNotNull(), F.array("next")).otherwise(F.array().cast("array<string>"))
        chosen = chosen.join(following, "family", "left").select("family", F.coalesce("next", "last").alias("last"), F.concat("examples", more).alias("examples"))
    return chosen.select("family", F.explode("examples").alias("line"))


def alpha_contexts(lines: DataFrame, min_support: int, min_distinct: int, max_top: float) -> DataFrame:
    """Contexts (left and right neighbour) whose letter tokens vary: support, distinct_n, top_cnt."""
    low = lines.select(T.words(F.col("line")).alias("t")).select("t", F.transform("t", F.lower).alias("low"))
    left = F.concat(F.array(F.lit("<BOL>")), F.slice("low", F.lit(1), F.greatest(F.size("low") - 1, F.lit(0))))
    right = F.concat(F.slice("low", F.lit(2), F.size("low")), F.array(F.lit("<EOL>")))
    around = low.select(F.explode(F.arrays_zip(F.col("t"), left.alias("left"), right.alias("right"))).alias("x")).select("x.*")  # three arrays, each built once
    counted = around.where(F.col("t").rlike(r"^\p{L}+$")).groupBy("left", "right", "t").agg(F.count("*").alias("c"))
    out = counted.groupBy("left", "right").agg(F.sum("c").alias("support"), F.count("*").alias("distinct_n"), F.max("c").alias("top_cnt"))
    return out.where((F.col("support") >= min_support) & (F.col("distinct_n") >= min_distinct) & (F.col("top_cnt") <= max_top * F.col("support")))


def template_dictionary(rows: DataFrame) -> DataFrame:
    """(block_id, template, template_id, cnt) of rows (block_id, pos, template): ids from 1 by first occurrence, 0 for the empty template."""
    firsts = rows.groupBy("block_id", "template").agg(F.min("pos").alias("at"), F.count("*").alias("cnt"))
    order = Window.partitionBy("block_id", F.col("template") == "").orderBy("at")  # a block's distinct templates
    return firsts.withColumn("template_id", F.when(F.col("template") == "", 0).otherwise(F.row_number().over(order)).cast("long"))


def line_dictionary(rows: DataFrame, min_support: int, most: int, prefix: int = 2) -> DataFrame:
    """Frequent exact lines of each block with a positive gain: block_id, line_id, cnt, bytes, gain. The marker is prefix, id and LF."""
    counted = rows.groupBy("block_id", "line").agg(F.count("*").alias("cnt")).withColumn("bytes", F.octet_length("line").cast("long"))
    order = Window.partitionBy("block_id").orderBy(F.desc(F.col("cnt") * F.col("bytes")), F.desc("cnt"), "line")
    ranked = counted.where((F.col("cnt") >= min_support) & (F.col("bytes") > prefix + 1)).withColumn("line_id", F.row_number().over(order).cast("long") - 1)
    marker = F.lit(prefix + 1) + F.length(F.col("line_id").cast("string"))
    gained = ranked.withColumn("gain", (F.col("bytes") * (F.col("cnt") - 1) - marker * F.col("cnt")).cast("long"))
    return gained.where((F.col("gain") > 0) & (F.col("line_id") < most)).select("block_id", "line_id", "cnt", "bytes", "gain")


def admission(tokens: DataFrame) -> DataFrame:
    """Tags (shapes of tokens with a digit) and whether they get a stream: enough occurrences, and variety or length."""
    total = tokens.agg(F.count("*").alias("total"))
    tagged = tokens.where(F.col("t").rlike("[0-9]")).groupBy(T.token_shape(F.col("t")).alias("tag"), "t").agg(F.count("*").alias("c"))
    stats = tagged.groupBy("tag").agg(F.sum("c").alias("n"), F.count("*").alias("distinct_n"), F.round(F.sum(F.length("t") * F.col("c")) / F.sum("c"), 6).alias("avg_len"))
    limit = F.greatest(F.lit(20), F.least(F.lit(200), F.col("total") / 1000))
    admitted = (F.col("n") >= limit) & ((F.col("distinct_n") >= 30) | (F.col("avg_len") > 20))
    return stats.withColumn("k", F.lit(1)).join(F.broadcast(total.withColumn("k", F.lit(1))), "k").select("tag", "n", "distinct_n", "avg_len", admitted.alias("admitted"))  # total: one row


def jaccard_pairs(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Documents and items whose word sets have a similarity of least or more, through their common words alone."""
    bag = lambda df, key: df.select(key, F.array_distinct(T.words(F.lower(F.col("text")))).alias("w"))
    d, b = bag(docs, "doc_id"), bag(items, "item_id")
    common = d.select("doc_id", F.size("w").alias("nd"), F.explode("w").alias("t")).join(b.select("item_id", F.size("w").alias("nb"), F.explode("w").alias("t")), "t").groupBy("doc_id", "item_id", "nd", "nb").agg(F.count("*").alias("c"))
    value = F.col("c") / (F.col("nd") + F.col("nb") - F.col("c"))
    return common.where(value >= least).select("doc_id", "item_id", F.round(value, 6).alias("jaccard"))


def storage_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """ALLSAME, NUMERIC_DELTA, NUMERIC_NODELTA or MAPPING for each string column, by one aggregation."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    stats = long.groupBy("col").agg(
        F.bool_and(F.col("v").rlike("^[0-9]{1,18}$")).alias("numeric"), F.bool_or(F.col("v").rlike("^0[0-9]")).alias("zeros"), F.countDistinct("v").alias("d"), F.count("*").alias("n"), F.countDistinct(F.length("v")).alias("w")
    )
    kind = F.when(F.col("numeric") & (F.col("d") == 1), "ALLSAME").when(~F.col("numeric") | F.col("zeros"), "MAPPING").when((F.col("n") > 100) & (F.col("w") >= 3), "NUMERIC_NODELTA").otherwise("NUMERIC_DELTA")
    return stats.select("col", kind.alias("type"))


def dictionary_coded(lines: DataFrame, min_support: int = 2) -> tuple[DataFrame, DataFrame]:
    """Lines of at least min_support in their block as ids: rows with line (null where coded) and line_id, and entries (block_id, line_id, entry)."""
    counted = lines.groupBy("block_id", "line").agg(F.count("*").alias("cnt")).where((F.col("cnt") >= min_support) & (F.octet_length("line") > 3))
    order = Window.partitionBy("block_id").orderBy(F.desc(F.col("cnt") * F.octet_length("line")), "line")  # a block's repeated lines
    entries = counted.select("block_id", "line", (F.row_number().over(order) - 1).cast("long").alias("line_id"))
    coded = lines.join(entries, ["block_id", "line"], "left").withColumn("line", F.when(F.col("line_id").isNull(), F.col("line")))
    return coded, entries.withColumnRenamed("line", "entry")


def dictionary_expanded(coded: DataFrame, entries: DataFrame) -> DataFrame:
    """The inverse of dictionary_coded. An id without an entry stays a null line."""
    return coded.join(entries, ["block_id", "line_id"], "left").withColumn("line", F.coalesce("line", "entry")).drop("entry", "line_id")


def template_coded(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines as template_id and pieces (their digit runs in order), and entries (block_id, template_id, around)."""
    cut = lines.withColumn("pieces", F.regexp_extract_all("line", F.lit("[0-9]+"), F.lit(0))).withColumn("around", F.split("line", "[0-9]+", -1))
    firsts = cut.groupBy("block_id", "around").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    entries = firsts.select("block_id", "around", F.row_number().over(Window.partitionBy("block_id").orderBy("first")).cast("long").alias("template_id"))
    return cut.join(entries, ["block_id", "around"]).drop("line", "around"), entries


def template_restored(coded: DataFrame, entries: DataFrame) -> DataFrame:
    """The inverse of template_coded: a template's texts and a line's pieces in turn."""
    line = F.array_join(F.zip_with("around", "pieces", lambda a, p: F.concat(a, F.coalesce(p, F.lit("")))), "")
    return coded.join(entries, ["block_id", "template_id"]).withColumn("line", line).drop("around")


def block_texts(docs: DataFrame, size: int) -> DataFrame:
    """Texts of `size` consecutive ids joined by LF in order: block_id, raw. A block is bounded by its ids."""
    each = docs.select(F.expr(f"doc_id div {size}").alias("block_id"), "doc_id", "text").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    return each.select("block_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").cast("binary").alias("raw"))
