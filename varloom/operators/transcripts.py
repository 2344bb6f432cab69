"""Annotations: one row a site, gene and transcript. Preferred transcripts, ranks, collapsing, population filters.

Columns: site_id, k (the order in the file), gene, transcript, impact, consequence, popmax, mane (0/1), picked (0/1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Impacts from the most severe.
IMPACTS = ("HIGH", "MODERATE", "LOW", "MODIFIER")
NO_GENE = ("", ".", "-", "—")


def impact_rank(impact: Column, start: int = 1) -> Column:
    at = F.array_position(F.array(*[F.lit(i) for i in IMPACTS]), F.coalesce(impact, F.lit(""))).cast("int")
    return F.when(at > 0, at - 1 + start).otherwise(len(IMPACTS) + start)


def ranked(annotations: DataFrame, per_gene: bool = False) -> DataFrame:
    """With annotation_rank: MANE, then picked, then the more severe impact, then file order; by site, or site and gene."""
    by = ["site_id", "gene"] if per_gene else ["site_id"]
    return annotations.withColumn("annotation_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mane"), F.desc("picked"), impact_rank(F.col("impact")), "k")))


def preferred(annotations: DataFrame) -> DataFrame:
    """Every MANE row, and the picked row of a site and gene that has no MANE row."""
    has_mane = F.max("mane").over(Window.partitionBy("site_id", "gene"))
    return annotations.withColumn("_m", has_mane).filter((F.col("mane") == 1) | ((F.col("picked") == 1) & (F.col("_m") == 0))).drop("_m")


def preferred_by_anti_join(annotations: DataFrame) -> DataFrame:
    """The same as `preferred`, by set difference: for annotation tables already bucketed by site."""
    mane = annotations.filter("mane = 1")
    fallback = annotations.filter("mane = 0 AND picked = 1").join(mane.select("site_id", "gene"), ["site_id", "gene"], "left_anti")
    return mane.unionByName(fallback)


def with_single_fallback(annotations: DataFrame) -> DataFrame:
    """picked set where a site and gene has one row only and that isn't MANE: for files without a pick field."""
    alone = (F.count("*").over(Window.partitionBy("site_id", "gene")) == 1) & (F.col("mane") == 0)
    return annotations.withColumn("picked", F.when(alone, 1).otherwise(F.col("picked")))


def compact(annotations: DataFrame) -> DataFrame:
    """Rows kept by the compact form: all MANE; else all picked; else the first, for each site and gene."""
    w = Window.partitionBy("site_id", "gene")
    first = F.row_number().over(w.orderBy("k")) == 1
    mane, picked = F.max("mane").over(w), F.max("picked").over(w)
    keep = F.when(mane == 1, F.col("mane") == 1).when(picked == 1, F.col("picked") == 1).otherwise(first)
    return annotations.withColumn("_keep", keep).filter("_keep").drop("_keep")


def preferred_entry(annotations: DataFrame) -> DataFrame:
    """One row a site: MANE, else picked, else the first."""
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("mane"), F.desc("picked"), "k"))
    return annotations.withColumn("_r", rank).filter("_r = 1").drop("_r")


def collapsed(annotations: DataFrame, carriers: DataFrame) -> DataFrame:
    """One row a sample and site: the first by MANE, severity and pick, and the others' transcripts as an array."""
    order = F.struct((-F.col("mane")).alias("m"), impact_rank(F.col("impact"), 0).alias("i"), (-F.col("picked")).alias("p"), "k")
    per_site = annotations.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "gene", "transcript", "impact"))).alias("_all"))
    per_site = per_site.select("site_id", F.col("_all")[0]["gene"].alias("gene"), F.col("_all")[0]["transcript"].alias("transcript"), F.col("_all")[0]["impact"].alias("impact"), F.transform(F.slice("_all", 2, 1000000), lambda x: x["transcript"]).alias("others"))
    return carriers.select("sample_id", "site_id").join(per_site, "site_id")


def rare(annotations: DataFrame, max_popmax: float | None) -> DataFrame:
    """At most this frequent; a missing frequency passes."""
    return annotations if max_popmax is None else annotations.filter(F.col("popmax").isNull() | (F.col("popmax") <= max_popmax))


def at_least(column: str, least: float | None) -> Column:
    """A missing score fails, unless there is no minimum."""
    return F.lit(True) if least is None else F.coalesce(F.col(column) >= least, F.lit(False))


def gene_counts(annotations: DataFrame, carriers: DataFrame) -> DataFrame:
    """gene, rows: rows of a review by gene."""
    return carriers.select("site_id").join(annotations.filter(~F.col("gene").isin(*NO_GENE)), "site_id").groupBy("gene").agg(F.count("*").alias("rows"))


def consequence_counts(annotations: DataFrame) -> DataFrame:
    """consequence, rows: terms of combined consequences each count."""
    return annotations.select(F.explode(F.split("consequence", "&")).alias("consequence")).groupBy("consequence").agg(F.count("*").alias("rows"))


def text_search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows of which some column holds the text, in either case."""
    return rows.filter(F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in columns])).contains(text.strip().lower()))


def disrupted_last(rows: DataFrame, flag: str, *order: str) -> DataFrame:
    """Sorted with rows whose reference is disrupted behind all others."""
    return rows.orderBy(F.coalesce(F.col(flag), F.lit(False)), *order)


def with_place(rows: DataFrame, by: str, flag: str, *order: str) -> DataFrame:
    """rows with `place`, from 1 within `by`: in the given order, but rows whose reference is disrupted behind all others."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce(F.col(flag), F.lit(False)), *order)))
