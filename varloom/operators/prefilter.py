"""Whole-genome prefilter: which records are worth a review, and why an unscored indel is kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.operators import intervals as I  # noqa: E741

SPLICE_UNSCORED, PROMOTER_UNSCORED = "splice_intronic", "promoter"


@dataclass(frozen=True)
class PrefilterOptions:
    """None switches a route off. noncoding: ccre (in an element), all (anything outside of the exome) or none."""

    max_popmax: float | None = 0.01
    min_splice: float | None = 0.5
    min_promoter_abs: float | None = 0.8
    noncoding: str = "ccre"

    def __post_init__(self):
        if self.noncoding not in ("ccre", "all", "none"):
            raise ValueError("noncoding is ccre, all or none")


def flags(alts: DataFrame, intervals: dict[str, DataFrame]) -> DataFrame:
    """alts with a boolean column for each name: whether the reference bases overlap an interval of that table.

    All tables are met in one overlap join by bins, and a site's hits are summed up before they go back to the alts.
    """
    labelled = None
    for name, rows in intervals.items():
        one = rows.select("chrom", "start0", "end0", F.lit(name).alias("name"))
        labelled = one if labelled is None else labelled.unionByName(one)
    spans = I.as_interval(alts).select("site_id", "chrom", "start0", "end0").distinct()
    hits = I.overlaps(spans, labelled).groupBy("site_id").agg(*[F.max(F.col("name") == n).alias(n) for n in intervals])
    out = alts.join(hits, "site_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(False)) for n in intervals})


def evaluate(alts: DataFrame, options: PrefilterOptions = PrefilterOptions()) -> DataFrame:
    """alts with `retain` and `reasons`, by ALT: columns popmax, splice, promoter, consequences (array), in_exome, in_ccre, in_promoter.

    A frequency above the limit drops the ALT; no frequency doesn't. Indels that a route can't score are kept for it.
    """
    o = options
    common = F.lit(False) if o.max_popmax is None else F.coalesce(F.col("popmax") > o.max_popmax, F.lit(False))
    splice = F.lit(False) if o.min_splice is None else F.coalesce(F.col("splice") >= o.min_splice, F.lit(False))
    promoter = F.lit(False) if o.min_promoter_abs is None else F.coalesce(F.abs("promoter") >= o.min_promoter_abs, F.lit(False))
    indel = A.is_sequence(F.col("ref")) & A.is_sequence(F.col("alt")) & (F.length("ref") != F.length("alt"))
    no_splice = indel & F.lit(o.min_splice is not None) & F.col("splice").isNull() & F.array_contains("consequences", "intron_variant")
    no_promoter = indel & F.lit(o.min_promoter_abs is not None) & F.col("promoter").isNull() & F.col("in_promoter")
    reasons = F.array_compact(F.array(F.when(no_splice, SPLICE_UNSCORED), F.when(no_promoter, PROMOTER_UNSCORED)))
    reasons = F.when(common, F.array().cast("array<string>")).otherwise(reasons)
    noncoding = {"ccre": F.col("in_ccre"), "all": ~F.col("in_exome"), "none": F.lit(False)}[o.noncoding]
    route = F.when(F.col("in_exome"), "exome").when(splice, "splice").when(promoter, "promoter").when(noncoding, "noncoding").when(F.size(reasons) > 0, "unscored_indel")
    out = alts.withColumn("reasons", reasons)
    return out.withColumn("route", F.when(~common, route)).withColumn("retain", F.col("route").isNotNull())


def records(evaluated: DataFrame) -> DataFrame:
    """record_id, retain, flag: a record is kept if any ALT is; flag holds the reasons by ALT, null if there are none."""
    slots = F.array_sort(F.collect_list(F.struct("alt_index", F.when(F.size("reasons") > 0, F.array_join("reasons", "&")).otherwise(".").alias("r"))))
    out = evaluated.groupBy("record_id").agg(F.max("retain").alias("retain"), slots.alias("_s"))
    joined = F.array_join(F.transform("_s", lambda s: s["r"]), ",")
    return out.select("record_id", "retain", F.when(F.exists("_s", lambda s: s["r"] != "."), joined).alias("flag"))


def route_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy(F.coalesce("route", F.lit("dropped")).alias("route")).agg(F.count("*").alias("alts"))
