"""Cohort search: carriers of qualifying variants by variant, region, gene or gene list, and statistics of a cohort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.operators import calls as C
from varloom.operators import transcripts as T

MOST_GENES, MOST_SPAN = 2000, 5_000_000


@dataclass(frozen=True)
class CohortQuery:
    """mode: variant (keys), region (chrom, start, end), gene or gene_list (genes). Filters hold for all but variant."""

    mode: str
    keys: tuple[str, ...] = ()
    chrom: str | None = None
    start: int | None = None
    end: int | None = None
    genes: tuple[str, ...] = ()
    impacts: tuple[str, ...] = ("HIGH", "MODERATE")
    max_popmax: float | None = None
    min_scores: tuple[tuple[str, float], ...] = ()
    mane_only: bool = True
    exclude_flags: tuple[str, ...] = ()
    mechanism: str | None = None
    min_mechanism: float | None = None
    zygosity: str | None = None
    scopes: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("variant", "region", "gene", "gene_list"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode in ("gene", "gene_list") and not 0 < len(self.genes) <= (1 if self.mode == "gene" else MOST_GENES):
            raise ValueError("a gene query takes one gene, a list up to 2000")
        if self.mode == "region" and not (self.chrom and 0 <= self.end - self.start <= MOST_SPAN):
            raise ValueError("a region spans at most 5 Mb")
        if self.mode == "variant" and not self.keys:
            raise ValueError("a variant query takes keys or rsIDs")


def keyed_sites(sites: DataFrame) -> DataFrame:
    """site_id, variant_key, chrom, pos, ref, alt of the minimal allele."""
    m = A.minimal(F.col("pos"), F.col("ref"), F.col("alt"))
    out = sites.withColumn("_m", m).withColumn("_c", A.chromosome(F.col("chrom")))
    key = F.concat_ws(":", "_c", F.col("_m.pos").cast("string"), "_m.ref", "_m.alt")
    return out.select("site_id", key.alias("variant_key"), F.col("_c").alias("chrom"), F.col("_m.pos").alias("pos"), F.col("_m.ref").alias("ref"), F.col("_m.alt").alias("alt"), *[c for c in sites.columns if c not in ("site_id", "chrom", "pos", "ref", "alt")])


def matched_sites(sites: DataFrame, q: CohortQuery) -> DataFrame:
    """keyed_sites under the query's conditions on variants. An rsID matches in either case, as does a key."""
    if q.mode == "variant":
        wanted = [k.upper() for k in q.keys]
        hit = F.upper("variant_key").isin(wanted)
        return sites.filter(hit | F.upper("rsid").isin(wanted) if "rsid" in sites.columns else hit)
    if q.mode == "region":
        return sites.filter((F.col("chrom") == q.chrom) & F.col("pos").between(q.start, q.end))
    return sites


def qualifying(annotations: DataFrame, q: CohortQuery) -> DataFrame:
    """Annotations under the query's conditions. Preference of MANE is decided among all of a site's rows, before filters."""
    if q.mode == "variant":
        return annotations
    out = T.preferred(annotations) if q.mane_only else annotations
    if q.genes:
        out = out.filter(F.col("gene").isin(*[g.upper() for g in q.genes]))
    if q.impacts:
        out = out.filter(F.col("impact").isin(*q.impacts))
    out = T.rare(out, q.max_popmax)
    for column, least in q.min_scores:
        out = out.filter(T.at_least(column, least))
    for flag in q.exclude_flags:
        out = out.filter(F.col(flag) == 0)
    if q.mechanism:
        found = annotations.filter((F.col("mechanism") == q.mechanism) & (F.col("mechanism_match") == "exact"))
        if q.min_mechanism is not None:
            found = found.filter(T.at_least("mechanism_score", q.min_mechanism))
        out = out.join(found.select("site_id", "gene").distinct(), ["site_id", "gene"], "left_semi")
    return out


def zygosity_condition(q: CohortQuery) -> Column:
    """Homozygous and hemizygous searches widen to each other at single-copy loci; recorded females aren't hemizygous."""
    if q.zygosity in (None, "heterozygous"):
        return F.lit(True) if q.zygosity is None else F.col("zygosity") == "heterozygous"
    other = "hemizygous" if q.zygosity == "homozygous" else "homozygous"
    widened = (F.col("zygosity") == other) & A.single_copy(F.col("chrom"), F.col("pos"))
    if q.zygosity == "hemizygous":
        widened &= ~F.coalesce(F.col("sex") == "female", F.lit(False))
    return (F.col("zygosity") == q.zygosity) | widened


def search(sites: DataFrame, annotations: DataFrame, calls: DataFrame, files: DataFrame, q: CohortQuery, individuals: DataFrame | None = None) -> DataFrame:
    """One row a carrier and site: the best annotation, the call, its file, and the sample's number of qualifying variants.

    Conditions on sites and annotations are applied first; what is left of them limits the calls by the join. In gene
    mode the best annotation is chosen by site and gene, otherwise by site.
    """
    return search_matched(matched_sites(keyed_sites(sites), q), annotations, calls, files, q, individuals)


def search_matched(matched: DataFrame, annotations: DataFrame, calls: DataFrame, files: DataFrame, q: CohortQuery, individuals: DataFrame | None = None) -> DataFrame:
    """`search` from keyed sites that meet the query's conditions on variants."""
    best = T.ranked(qualifying(annotations, q).join(matched.select("site_id"), "site_id", "left_semi"), per_gene=q.mode == "gene").filter("annotation_rank = 1")
    rows = C.carriers(C.passing(calls)).join(matched, "site_id").join(best.select("site_id", "gene", "transcript", "consequence", "impact", "popmax", "mane", "picked"), "site_id").join(files, "sample_id")
    if individuals is not None:
        sexes = individuals.groupBy("sample_id").agg(F.max(F.when(F.col("sex_at_birth") == "female", "female")).alias("sex"))
        rows = rows.join(sexes, "sample_id", "left")
    else:
        rows = rows.withColumn("sex", F.lit(None).cast("string"))
    rows = rows.filter(zygosity_condition(q))
    if q.scopes:
        rows = rows.filter(F.col("analysis_scope").isin(*q.scopes))
    if q.profiles:
        rows = rows.filter(F.concat_ws(":", "import_profile", "analysis_scope").isin(*q.profiles))
    return rows.withColumn("sample_qualifying_variant_count", F.count("*").over(Window.partitionBy("sample_id")))


def page(rows: DataFrame, limit: int, per_gene: bool = False) -> DataFrame:
    """The first rows in the order of a search: the more severe and the rarer first, then by place and sample."""
    first = [F.desc("sample_qualifying_variant_count"), "sample_id"] if per_gene else []
    return rows.orderBy(*first, T.impact_rank(F.col("impact")), F.coalesce("popmax", F.lit(-1)), "chrom", "pos", "sample_id", "gene", "site_id").limit(limit)


def totals(rows: DataFrame) -> DataFrame:
    """rows, individuals, variants, and whether more than one import profile takes part."""
    profile = F.concat_ws(":", "import_profile", "analysis_scope")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("individuals"), F.countDistinct("variant_key").alias("variants"), (F.countDistinct(profile) > 1).alias("mixed_profiles"))


def with_mechanism(annotations: DataFrame) -> DataFrame:
    """Rows without a mechanism of their own take that of the first matching row of the same site and gene, and say so."""
    exact = annotations.filter(F.col("mechanism_match") == "exact")
    first = exact.groupBy("site_id", "gene").agg(F.min(F.struct("k", "mechanism", "mechanism_score", "transcript")).alias("_f"))
    out = annotations.join(first, ["site_id", "gene"], "left")
    elsewhere = F.col("_f").isNotNull() & (F.col("_f.k") != F.col("k"))
    match = F.when(elsewhere, "source_transcript_match_elsewhere").otherwise(F.col("mechanism_match"))
    return out.select(*[c for c in annotations.columns if not c.startswith("mechanism")], F.coalesce("mechanism", "_f.mechanism").alias("mechanism"), F.coalesce("mechanism_score", "_f.mechanism_score").alias("mechanism_score"), match.alias("mechanism_match"), F.col("_f.transcript").alias("source_transcript"))


def statistics(files: DataFrame, individuals: DataFrame, sites: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of counts over the whole cohort."""
    carried = C.carriers(C.passing(calls))
    parts = [
        files.agg(F.countDistinct("file_id").alias("files"), F.countDistinct("sample_id").alias("samples"), F.countDistinct(F.concat_ws(":", "import_profile", "analysis_scope")).alias("profiles")),
        individuals.agg(F.countDistinct("individual_id").alias("individuals")),
        keyed_sites(sites).agg(F.countDistinct("variant_key").alias("variants")),
        carried.agg(F.count("*").alias("carriers")),
    ]  # each is one row
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def import_profiles(files: DataFrame) -> DataFrame:
    return files.groupBy("import_profile", "analysis_scope").agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("sample_entries"))


def sample_list(files: DataFrame, calls: DataFrame, like: str | None = None) -> DataFrame:
    """sample_id, file_id, carriers (0 for samples without any)."""
    counts = C.carriers(C.passing(calls)).groupBy("sample_id").agg(F.count("*").alias("carriers"))
    chosen = files if like is None else files.filter(F.col("sample_id").ilike(like))
    return chosen.join(counts, "sample_id", "left").select("sample_id", "file_id", F.coalesce("carriers", F.lit(0).cast("long")).alias("carriers"))


def by_variant(rows: DataFrame) -> DataFrame:
    """variant_key, individuals, samples (sorted): search results by variant."""
    return rows.groupBy("variant_key").agg(F.countDistinct("sample_id").alias("individuals"), F.array_sort(F.collect_set("sample_id")).alias("samples"))


def detail(sites: DataFrame, annotations: DataFrame, calls: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """All transcripts and all carriers of one variant."""
    site = keyed_sites(sites).filter(F.col("variant_key") == key).select("site_id", "variant_key")
    return site.join(annotations, "site_id"), site.join(C.carriers(C.passing(calls)), "site_id")


def separately_called(calls: DataFrame, files: DataFrame, annotations: DataFrame, max_popmax: float) -> DataFrame:
    """site_id, carriers: carriers over files called apart. The first file that has a site decides by its frequency whether it's dropped."""
    rows = C.carriers(C.passing(calls)).join(files.select("sample_id", "file_id"), "sample_id")
    first = rows.groupBy("site_id").agg(F.min("file_id").alias("first_file"), F.count("*").alias("carriers"), F.countDistinct("file_id").alias("files"))
    freq = annotations.groupBy("site_id").agg(F.max("popmax").alias("popmax"))
    return first.join(freq, "site_id", "left").filter(F.col("popmax").isNull() | (F.col("popmax") <= max_popmax)).select("site_id", "first_file", "carriers", "files")
