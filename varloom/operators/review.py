"""The review: filter set over call and annotation rows, typed annotation rows, and evidence of single scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import fields as X
from varloom.operators import calls as C
from varloom.operators import clinical as L
from varloom.operators import genes as E
from varloom.operators import transcripts as T

#: Fields of a consequence entry under the names that annotators give them, by typed column.
TEXT_FIELDS = {
    "gene": ("SYMBOL", "HGNC"), "gene_id": ("Gene",), "transcript": ("Feature",), "hgvsc": ("HGVSc",), "hgvsp": ("HGVSp",), "consequence": ("Consequence",), "impact": ("IMPACT",),
    "clinvar": ("ClinVar_CLNSIG", "CLNSIG"), "clinvar_conflicting": ("ClinVar_CLNSIGCONF", "CLNSIGCONF"), "loftee": ("LoF", "LOFTEE"), "mechanism": ("LoGoFunc_prediction",), "mechanism_match": ("LoGoFunc_match",),
}
FLAG_FIELDS = {"mane": ("MANE_SELECT", "MANE_PLUS_CLINICAL"), "picked": ("PICK",), "repeat_masker": ("RepeatMasker", "REPEATMASKER"), "segdup": ("SegDup", "SEGDUP")}
SPLICE_FIELDS = ("SpliceAI_pred_DS_AG", "SpliceAI_pred_DS_AL", "SpliceAI_pred_DS_DG", "SpliceAI_pred_DS_DL", "DS_AG", "DS_AL", "DS_DG", "DS_DL")
WGS_CADD, CODING_CADD, MISSENSE = ("CADD_PHRED", "CADD_WGS_CADD_PHRED", "CADD_WGS_PHRED"), ("CADD_phred",), ("AlphaMissense_score", "am_pathogenicity")
STARTER_CADD = "starter_cadd_phred"


def annotation_columns(entry: Column) -> list[Column]:
    """Typed columns of a consequence entry (a map). Sources of one score go by precedence, never by the larger number."""
    get = lambda names: X.first_present(*[entry[n] for n in names])
    most = lambda names: F.array_max(F.array_compact(F.array(*[X.largest(entry[n]) for n in names])))
    frequency, source = X.population_frequency({f: entry[f] for _, fields in X.FREQUENCY_GROUPS for f in fields})
    text = {n: get(f) for n, f in TEXT_FIELDS.items()}
    text["gene"] = F.upper(F.coalesce(text["gene"], F.lit("—")))
    text["consequence"] = F.coalesce(text["consequence"], F.lit("unannotated"))
    text["impact"] = F.when(F.upper(text["impact"]).isin(*T.IMPACTS), F.upper(text["impact"])).otherwise("UNKNOWN")
    flags = {n: F.when(F.coalesce(~F.lower(get(f)).isin("0", "false", "no"), F.lit(False)), 1).otherwise(0) for n, f in FLAG_FIELDS.items()}
    cadd = F.coalesce(most(WGS_CADD), X.strict_decimal(entry[STARTER_CADD]), most(CODING_CADD))
    scores = {"popmax": frequency, "popmax_source": source, "cadd": cadd, "alpha_missense": most(MISSENSE), "splice": most(SPLICE_FIELDS)}
    return [c.alias(n) for n, c in (text | flags | scores).items()]


def starter_status(status: Column, match: Column, score: Column, expected: str, most: float, target_agrees: Column | None = None) -> Column:
    """struct(status, score): an exact match needs the expected kind of match and, where asked, the row's own target; a score needs all that, and its range.

    A status of another name is partial if there is any evidence, else unmatched.
    """
    known = status.isin("exact", "partial", "ambiguous", "unmatched")
    some = X.first_present(match, score).isNotNull()
    own = F.when(known, status).when(some, "partial").otherwise("unmatched")
    exact = (own == "exact") & F.coalesce(match == expected, F.lit(False)) & (F.lit(True) if target_agrees is None else F.coalesce(target_agrees, F.lit(False)))
    out = F.when((own == "exact") & ~exact, "partial").otherwise(own)
    value = X.strict_decimal(score)
    return F.struct(out.alias("status"), F.when(exact & value.between(0, most), value).alias("score"))


@dataclass(frozen=True)
class ReviewFilters:
    """The filter set of a review. None, an empty tuple or False leaves a condition out; a missing score fails a minimum, a missing frequency passes."""

    text: str = ""
    samples: tuple[str, ...] = ()
    impacts: tuple[str, ...] = ()
    max_popmax: float | None = None
    preferred_only: bool = False
    exclude_flags: tuple[str, ...] = ()  # columns that must be 0
    require_flags: tuple[str, ...] = ()  # columns that must be true: protein matches, assertions
    clinvar_pathogenic: bool = False
    clinvar_conflict: bool = False
    exclude_status: tuple[tuple[str, str], ...] = ()  # (column, value)
    min_scores: tuple[tuple[str, float], ...] = ()
    min_abs_scores: tuple[tuple[str, float], ...] = ()
    mechanism: str | None = None
    min_mechanism: float | None = None
    qc: C.CallQc | None = C.STANDARD
    search_columns: tuple[str, ...] = ("gene", "transcript", "sample_id", "variant_key")


def apply(rows: DataFrame, f: ReviewFilters, annotations: DataFrame | None = None, gene_sets: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Rows (a call with one annotation) that fulfil all conditions. Preferred transcripts are decided over `annotations`, not over what other filters leave.

    All conditions on a row go into one predicate, so that they reach the scan together; gene sets are semi joins.
    """
    test = F.lit(True)
    if f.qc is not None:
        test &= F.size(C.qc_failures(f.qc)) == 0
    if f.samples:
        test &= F.col("sample_id").isin(*f.samples)
    if f.impacts:
        test &= F.col("impact").isin(*f.impacts)
    if f.max_popmax is not None:
        test &= F.col("popmax").isNull() | (F.col("popmax") <= f.max_popmax)
    for c in f.exclude_flags:
        test &= F.col(c) == 0
    for c in f.require_flags:
        test &= F.coalesce(F.col(c), F.lit(False))
    if f.clinvar_pathogenic:
        test &= L.mentions_pathogenic(F.col("clinvar"))
    if f.clinvar_conflict:
        test &= L.conflict_with_pathogenic(F.col("clinvar"), F.col("clinvar_conflicting"))
    for c, value in f.exclude_status:
        test &= ~F.col(c).eqNullSafe(F.lit(value))
    for c, least in f.min_scores:
        test &= T.at_least(c, least)
    for c, least in f.min_abs_scores:
        test &= F.coalesce(F.abs(F.col(c)) >= least, F.lit(False))
    if f.mechanism:
        test &= F.coalesce(F.col("mechanism") == f.mechanism, F.lit(False)) & T.at_least("mechanism_score", f.min_mechanism)
    out = rows.filter(test)
    if f.text.strip():
        out = T.text_search(out, list(f.search_columns), f.text)
    if f.preferred_only:
        keys = T.preferred(annotations).select("site_id", "k")
        out = out.join(keys, ["site_id", "k"], "left_semi")
    return E.in_sets(out, *gene_sets) if gene_sets else out
