"""Operator 10, mixing sources to target weights: capped water-filling, then seeded repetitions. DataFrame functions only.

A source's target is min(cap, level * weight), its cap being max_epochs times its size. The level is found by rounds of
two sums over the table of sources: those whose share lies above their cap are clamped, and what they can't take is
dealt again in proportion to weight, until no target lies above its cap.

A target of r times the source's size takes every document floor(r) times. The rest is sampled: documents are ordered by
a seeded hash of their id and taken whole up to the budget, and the document on its border in part, so that what a
source takes is its target to the word. The running sum goes by slices of about SLICE documents of that order, first
over slices and then within each, so that a source with a third of all rows is no single task's work.

Defined cases: a null text has size 0, a null source is a source of its own. Sources without words get a target of 0.
Where all caps together lie below the total, each source gets its cap. Documents with equal hash and doc_id (repeated
rows) go by size, and equal ones among these share what they take in some order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
SLICE = 4000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, by: str) -> DataFrame:
    """sources with `rank` from 0 in the order of column `by`, nulls last, without bringing them into one task."""
    sorted_ = common.materialize(sources.orderBy(F.col(by).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    before = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row a partition of the sort
    return joined.withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*sources.columns, "rank")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """sources (weight, source_size) with `target`: total in proportion to weight, none above max_epochs * source_size."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    free, clamped = None, F.lit(False)
    while True:
        full, free_now = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight").cast("double")))).first()
        if not free_now:  # all are clamped, or there is no source
            return sources.withColumn("target", cap)
        level = (float(total) - (full or 0.0)) / free_now
        if free_now == free:
            break
        free = free_now
        clamped = cap < F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights, share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document (doc_id, text, source) go in.

    weights: a function of the table of sources (source, n_docs, source_size, rank by code point) that adds `weight`.
    share: the mix's size, relative to all words of docs.
    """
    rows = _mixed(docs, weights, share, max_epochs, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_part")).cast("long").alias("taken"))


def _order(seed: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")), 256), 1, 16)


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))


def _mixed(docs: DataFrame, weights, share: float, max_epochs: float, seed: str) -> DataFrame:
    sized = common.materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _order(seed).alias("_order")), "sizes")
    sources = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    sources = common.materialize(weights(ranked(sources, "source")), "sources")
    n, words = sources.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    plan = water_fill(sources, share * words, max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("_budget", F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 0.5).cast("long")).withColumn("_slices", F.ceil(F.col("n_docs") / F.lit(SLICE)))
    plan = common.materialize(plan.select(_source_key().alias("_source"), "n_docs", "source_size", "target", "_whole", "_budget", "_slices"), "plan")
    # rows alike in all that decides are one group with a number, so that a doc_id with a third of all rows is no hot key
    alike = sized.groupBy("doc_id", "source", "size", "_order").agg(F.count("*").alias("_same"))
    rows = common.attach_stats(alike.withColumn("_source", _source_key()), plan, "_source", "n_docs", n, ["_order", "doc_id"])
    slice_ = F.floor(F.conv(F.substring("_order", 1, 6), 16, 10).cast("long") * F.col("_slices") / F.lit(float(1 << 24)))
    rows = common.materialize(rows.withColumn("_slice", slice_), "sliced")
    words_of = F.col("size") * F.col("_same")
    sums = rows.groupBy("_source", "_slice").agg(F.sum(words_of).alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).select("_source", "_slice", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = Window.partitionBy("_source", "_slice").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["_source", "_slice"]).withColumn("_start", F.col("_before") + F.coalesce(F.sum(words_of).over(within), F.lit(0)))
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1))).withColumn("_start", F.col("_start") + F.col("_nth") * F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - F.col("_start")))
    return rows.withColumn("_part", part)


def repeating(*weights: int):
    """Weights for `mix`: these in turn along the sources' order."""
    return lambda sources: sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))


def repeat_documents(docs: DataFrame, weights, share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with each row as often as the mix takes it, whole: the document on a source's border is in if half of it is.

    Only the border's hash has to reach the rows, one for each source, so that texts needn't be shuffled.
    """
    mixed = _mixed(docs, weights, share, max_epochs, seed)
    inside = (F.col("_start") < F.col("_budget")) & (2 * F.col("_part") >= F.col("size"))
    borders = mixed.groupBy(F.col("_source").alias("_vl_source")).agg(F.count("*").alias("_vl_n"), F.max("_whole").alias("_vl_whole"), F.max(F.when(inside, F.struct("_order", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size"))).alias("_vl_border"))
    borders = common.materialize(borders, "borders")
    keyed = docs.select("*", _source_key().alias("_vl_source"), _order(seed).alias("_vl_order"), n_words(F.col("text")).alias("_vl_size"))
    rows = common.attach_stats(keyed, borders, "_vl_source", "_vl_n", common.total_of(borders, "_vl_n"), ["_vl_order"])
    own = F.struct(F.col("_vl_order").alias("_order"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("_vl_size").alias("size"))
    times = F.col("_vl_whole") + F.when(own <= F.col("_vl_border"), 1).otherwise(0)
    rows = rows.withColumn("_vl_times", times.cast("int")).filter("_vl_times > 0")
    return rows.withColumn("_vl_copy", F.explode(F.sequence(F.lit(1), F.col("_vl_times")))).select(*docs.columns)
