"""Queries on the review's filter set and on typed annotation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import calls as C
from varloom.operators import cohort as H
from varloom.operators import review as W
from varloom.plans.base import CARRIERS, KEYED, on_views
from varloom.plans.review import FAILURES, PREFERRED

V = ("fx_sites", "fx_calls", "fx_annotations")


@on_views("f05_review_filters", V, """SELECT sample_id, site_id, k, gene FROM failed JOIN preferred USING (site_id) JOIN (SELECT site_id, variant_key FROM keyed) USING (site_id)
 WHERE len(failures) = 0 AND impact IN ('HIGH', 'MODERATE', 'LOW') AND (popmax IS NULL OR popmax <= 0.04) AND sample_id IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8', 'S9') AND contains(lower(gene || ' ' || transcript || ' ' || sample_id || ' ' || variant_key), 'g1')""", KEYED, CARRIERS, FAILURES, PREFERRED)
def filtered(v):
    keys = H.keyed_sites(v.sites).select("site_id", "variant_key")
    rows = C.carriers(v.calls).join(v.annotations, "site_id").join(keys, "site_id")
    f = W.ReviewFilters(text="G1", samples=tuple(f"S{i}" for i in range(1, 10)), impacts=("HIGH", "MODERATE", "LOW"), max_popmax=0.04, preferred_only=True)
    return W.apply(rows, f, v.annotations).select("sample_id", "site_id", "k", "gene")


@on_views("f05_score_filters", V, "SELECT sample_id, site_id, k FROM carried JOIN fx_annotations USING (site_id) WHERE alpha_missense >= 0.6 AND mane = 0 AND gene IN ('G3', 'G5', 'G7')", CARRIERS)
def scored(v):
    rows = C.carriers(v.calls).join(v.annotations, "site_id")
    f = W.ReviewFilters(qc=None, min_scores=(("alpha_missense", 0.6),), exclude_flags=("mane",))
    genes = v.sites.sparkSession.createDataFrame([("g3",), ("G5",), ("G7",)], "gene string")
    return W.apply(rows, f, gene_sets=(genes,)).select("sample_id", "site_id", "k")


@on_views("p17_annotation_rows", ("fx_annotations",), """SELECT site_id, k, gene, transcript, impact, popmax::DOUBLE AS popmax, CASE WHEN NOT p0 THEN 'gnomad_popmax' WHEN site_id % 2 = 0 THEN 'max_af' ELSE '' END AS popmax_source, mane, picked,
 CASE WHEN site_id % 3 = 0 THEN 31.0 WHEN site_id % 3 = 1 THEN 20.5 ELSE 12.0 END::DOUBLE AS cadd, alpha_missense::DOUBLE AS alpha_missense FROM (SELECT * REPLACE (coalesce(popmax, CASE WHEN site_id % 2 = 0 THEN 0.25 END) AS popmax), popmax IS NULL AS p0 FROM fx_annotations)""")
def typed(v):
    """Consequence entries made from annotations and read again: CADD of three sources by precedence, frequency with its source."""
    n = F.col("site_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = F.create_map(
        F.lit("SYMBOL"), F.lower("gene"), F.lit("Feature"), F.col("transcript"), F.lit("IMPACT"), F.lower("impact"), F.lit("gnomADg_AF_popmax"), text("popmax"), F.lit("MAX_AF"), F.when(n % 2 == 0, "0.25").otherwise("."),
        F.lit("MANE_SELECT"), F.when(F.col("mane") == 1, "NM_1.1").otherwise(""), F.lit("PICK"), F.when(F.col("picked") == 1, "1").otherwise(""), F.lit("AlphaMissense_score"), text("alpha_missense"),
        F.lit("CADD_PHRED"), F.when(n % 3 == 0, "31&5").otherwise("."), F.lit("starter_cadd_phred"), F.when(n % 3 == 1, "20.5").otherwise("x"), F.lit("CADD_phred"), F.lit("12&11"),
    )
    rows = v.annotations.select("site_id", "k", *W.annotation_columns(entry))
    return rows.select("site_id", "k", "gene", "transcript", "impact", "popmax", "popmax_source", "mane", "picked", "cadd", "alpha_missense")


@on_views("p19_starter_status", ("fx_scores",), """SELECT site_id, transcript_base, copy_no, CASE WHEN site_id % 5 = 0 THEN 'unmatched' WHEN site_id % 5 = 1 THEN 'partial' WHEN score % 2 = 1 THEN 'partial' ELSE 'exact' END AS status,
 CASE WHEN site_id % 5 > 1 AND score % 2 = 0 AND score <= 90 THEN score / 90.0 END::DOUBLE AS score FROM fx_scores""")
def starter(v):
    n, s = F.col("site_id") % 5, F.col("score")
    status = F.when(n == 0, "").when(n == 1, "odd").otherwise("exact")
    match = F.when(n == 0, ".").when(s % 2 == 1, "allele").otherwise("allele_transcript_protein")
    out = W.starter_status(status, match, F.when(n == 0, "").otherwise((s / 90).cast("string")), "allele_transcript_protein", 1.0)
    return v.scores.select("site_id", "transcript_base", "copy_no", out.alias("o")).select("site_id", "transcript_base", "copy_no", "o.status", "o.score")
