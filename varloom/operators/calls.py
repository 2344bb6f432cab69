"""Calls: one row a sample and site. Quality control, carriers, and what is summed from them.

Columns: sample_id, site_id, gt, dp, gq, ad_alt, filter. A missing depth is null, never zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import genotypes as G


def passing(calls: DataFrame) -> DataFrame:
    """Sites that pass, or to which no filter was applied; null counts as neither."""
    return calls.filter(F.col("filter").isin("PASS", "."))


def carriers(calls: DataFrame, allele: int = 1) -> DataFrame:
    """Calls that carry the ALT, with copies, zygosity, phased, ad_ref and allele_balance."""
    a = F.lit(allele)
    out = calls.filter(G.copies(F.col("gt"), a) > 0)
    return out.withColumns({"copies": G.copies(F.col("gt"), a), "zygosity": G.zygosity(F.col("gt"), a), "phased": G.is_phased(F.col("gt")), "ad_ref": F.col("dp") - F.col("ad_alt"), "allele_balance": G.allele_balance(F.col("ad_alt"), F.col("dp"))})


@dataclass(frozen=True)
class CallQc:
    """Thresholds of call quality; None leaves a check out. A check on a missing value fails."""

    min_dp: float | None = 10
    min_gq: float | None = 20
    min_alt_depth: float | None = 3
    min_het_ref_depth: float | None = None
    het_ab_min: float | None = 0.2
    het_ab_max: float | None = 0.8
    hom_ab_min: float | None = 0.8
    max_dp: float | None = None
    ft: str = "exclude_explicit"  # or ignore, require_pass
    min_site: tuple[tuple[str, float], ...] = ()  # (column, least) for site metrics: qual, qd, mq, rank sums
    max_site: tuple[tuple[str, float], ...] = ()  # (column, most): fs, sor


STANDARD = CallQc()
NONE = CallQc(min_dp=None, min_gq=None, min_alt_depth=None, het_ab_min=None, het_ab_max=None, hom_ab_min=None, ft="ignore")


def _low(label: str, value: Column, least: float | None) -> list[Column]:
    return [] if least is None else [F.when(value.isNull(), f"{label} unavailable").when(value < least, f"{label} low")]


def _high(label: str, value: Column, most: float | None) -> list[Column]:
    return [] if most is None else [F.when(value.isNull(), f"{label} unavailable").when(value > most, f"{label} high")]


def qc_failures(qc: CallQc = STANDARD, ft: str | None = None) -> Column:
    """array<string> of the reasons why a call fails; empty if it passes. ft: the column with the genotype's own filter."""
    gt, balance = F.col("gt"), F.col("allele_balance")
    klass = G.review_class(gt)
    only = lambda kind, checks: [F.when(kind, c) for c in checks]
    half = F.when(~G.fully_called(gt) & gt.rlike(r"(^|[|/])0*[1-9][0-9]*([|/]|$)"), "genotype partially called")
    checks = [*_low("DP", F.col("dp"), qc.min_dp), *_low("GQ", F.col("gq"), qc.min_gq), *_low("alternate depth", F.col("ad_alt"), qc.min_alt_depth), *_high("DP", F.col("dp"), qc.max_dp), half]
    checks += only(klass == "heterozygous", [*_low("reference depth", F.col("ad_ref"), qc.min_het_ref_depth), *_low("allele balance", balance, qc.het_ab_min), *_high("allele balance", balance, qc.het_ab_max)])
    checks += only(klass.isin("homozygous_alt", "hemizygous"), _low("alternate allele balance", balance, qc.hom_ab_min))
    if ft and qc.ft != "ignore":
        own = F.upper(F.trim(F.coalesce(F.col(ft), F.lit(""))))
        checks += [F.when(~own.isin("", ".", "PASS"), F.concat(F.lit("genotype FT "), F.trim(F.col(ft))))] if qc.ft == "exclude_explicit" else [F.when(own != "PASS", "genotype FT not PASS")]
    for column, least in qc.min_site:
        checks += _low(column, F.col(column), least)
    for column, most in qc.max_site:
        checks += _high(column, F.col(column), most)
    return F.array_distinct(F.array_compact(F.array(*checks)))


def with_qc(calls: DataFrame, qc: CallQc = STANDARD) -> DataFrame:
    return calls.withColumn("failures", qc_failures(qc))


def site_qc(calls: DataFrame, qc: CallQc = STANDARD) -> DataFrame:
    """site_id, carriers, passing, passes: a site passes if any of its carriers does."""
    checked = with_qc(carriers(calls), qc)
    return checked.groupBy("site_id").agg(F.count("*").alias("carriers"), F.count_if(F.size("failures") == 0).alias("passing"), F.max(F.size("failures") == 0).alias("passes"))


def compound_candidates(calls: DataFrame, genes: DataFrame) -> DataFrame:
    """sample_id, gene, chrom, variants: two or more different heterozygous sites. genes: site_id, gene, chrom, variant_key."""
    het = calls.filter(G.is_heterozygous(F.col("gt"))).select("sample_id", "site_id")
    rows = het.join(genes.filter(~F.col("gene").isin("", ".", "-", "—")), "site_id")
    return rows.groupBy("sample_id", "gene", "chrom").agg(F.countDistinct("variant_key").alias("variants")).filter("variants >= 2")


def best_evidence(calls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each of keys: called calls before uncalled, then higher GQ, then the first by `order`."""
    called = F.col("gt").rlike("[0-9]")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(called.desc(), F.col("gq").desc_nulls_last(), order))
    return calls.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def cohort_rows(calls: DataFrame) -> DataFrame:
    """site_id, carrier_count, carriers (sorted array<struct<sample, gt, gq>>), representative: the carrier with the highest GQ.

    A site's carriers are one array, so it suits cohorts whose carriers of one allele fit in a row.
    """
    rows = carriers(calls)
    best = F.max_by("sample_id", F.struct("gq", F.col("sample_id")))
    return rows.groupBy("site_id").agg(F.count("*").alias("carrier_count"), F.array_sort(F.collect_list(F.struct("sample_id", "gt", "gq"))).alias("carriers"), best.alias("representative"))


def import_counts(calls: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, records, excluded, passing, carriers of each file's calls."""
    ok = F.col("filter").isin("PASS", ".")
    carried = G.copies(F.col("gt"), F.lit(1)) > 0
    return calls.join(files.select("sample_id", "file_id"), "sample_id").groupBy("file_id").agg(F.countDistinct("site_id").alias("sites"), F.count("*").alias("records"), F.count_if(~ok).alias("excluded"), F.count_if(ok).alias("passing"), F.count_if(ok & carried).alias("carriers"))


def filter_census(calls: DataFrame) -> DataFrame:
    """label, calls: how often each filter label occurs; a call may have several, separated by semicolons."""
    return calls.select(F.explode(F.split("filter", ";")).alias("label")).groupBy("label").agg(F.count("*").alias("calls"))
