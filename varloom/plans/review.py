"""Queries on sites, calls, annotations and the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions import fields as X
from varloom.functions import genotypes as G
from varloom.functions.scratch import scratch_path
from varloom.operators import calls as C
from varloom.operators import cohort as H
from varloom.operators import cohort_store as HS
from varloom.operators import reference as P
from varloom.operators import transcripts as T
from varloom.plans.base import CARRIERS, IMPACT, KEYED, on_views

S, K, N = ("fx_sites",), ("fx_calls",), ("fx_annotations",)
PASSING = CARRIERS.replace("WHERE gt <> '0/0'", "WHERE gt <> '0/0' AND filter IN ('PASS', '.')")


@on_views("p01_p03_keys", S, "SELECT site_id, chrom, pos, ref, alt, variant_key FROM keyed", KEYED)
def keys(v):
    return H.keyed_sites(v.sites).select("site_id", "chrom", "pos", "ref", "alt", "variant_key")


@on_views("p05_vep_alt", S, """SELECT site_id, CASE WHEN left2 = '' THEN '-' ELSE left2 END AS vep_alt, length(alt) - length(ref) AS change, (length(alt) - length(ref)) % 3 <> 0 AS frameshift,
 reverse(translate(ref, 'ACGT', 'TGCA')) AS ref_rc FROM v3""",
 """v1 AS (SELECT *, list_max([k FOR k IN range(0, least(length(ref), length(alt)) + 1) IF right(ref, k) = right(alt, k)]) AS s FROM fx_sites)""",
 "v2 AS (SELECT *, left(ref, length(ref) - s) AS r, left(alt, length(alt) - s) AS a FROM v1)",
 "v3 AS (SELECT *, substr(a, list_max([k FOR k IN range(0, least(length(r), length(a)) + 1) IF left(r, k) = left(a, k)]) + 1) AS left2 FROM v2)")
def vep(v):
    ref, alt = F.col("ref"), F.col("alt")
    return v.sites.select("site_id", A.vep_alt(ref, alt).alias("vep_alt"), A.length_change(ref, alt).alias("change"), A.is_frameshift(ref, alt).alias("frameshift"), A.reverse_complement(ref).alias("ref_rc"))


@on_views("p16_single_copy", S, "SELECT site_id, (chrom = 'X' AND pos > 2781479 AND pos < 155701383) OR (chrom = 'Y' AND pos > 2781479 AND pos < 56887903) AS single_copy FROM keyed", KEYED)
def single(v):
    return H.keyed_sites(v.sites).select("site_id", A.single_copy(F.col("chrom"), F.col("pos")).alias("single_copy"))


@on_views("p29_p35_p38_ids", N, "SELECT site_id, k, split_part(transcript, '.', 1) AS base, ((k + 1) * (k + 2) // 2)::BIGINT AS diploid_genotypes FROM fx_annotations")
def ids(v):
    return v.annotations.select("site_id", "k", A.stable_id(F.col("transcript")).alias("base"), A.genotype_count(F.lit(2), F.col("k") + 1).alias("diploid_genotypes"))


@on_views("w06_duplicate_sites", S, """SELECT site_id, variant_key, row_number() OVER (PARTITION BY chrom, alt ORDER BY site_id) AS occurrence, count(*) OVER (PARTITION BY chrom, alt) AS copies,
 count(DISTINCT pos) OVER (PARTITION BY chrom, alt) > 1 AS collision FROM keyed""", KEYED)
def duplicates(v):
    """Records of equal chromosome and ALT, numbered; a collision when they lie at several places."""
    from pyspark.sql import Window

    w = Window.partitionBy("chrom", "alt")
    rows = H.keyed_sites(v.sites)
    return rows.select("site_id", "variant_key", F.row_number().over(w.orderBy("site_id")).alias("occurrence"), F.count("*").over(w).alias("copies"), (F.size(F.collect_set("pos").over(w)) > 1).alias("collision"))


@on_views("o04_coordinate_order", S, """SELECT site_id, chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos, site_id) AS place,
 CASE chrom WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '7' THEN 7 WHEN 'X' THEN 23 WHEN 'MT' THEN 25 END AS contig_rank FROM keyed""", KEYED)
def ordered(v):
    from pyspark.sql import Window

    rows = H.keyed_sites(v.sites).withColumn("contig_rank", A.contig_rank(F.col("chrom")))
    return rows.select("site_id", "chrom", "pos", F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "site_id")).alias("place"), "contig_rank")


@on_views("f01_passing_calls", K, "SELECT sample_id, site_id, gt, filter FROM fx_calls WHERE filter IN ('PASS', '.')")
def passing(v):
    return C.passing(v.calls).select("sample_id", "site_id", "gt", "filter")


@on_views("p15_carriers", K, "SELECT sample_id, site_id, gt, copies, zygosity, phased, ad_ref, allele_balance FROM carried", CARRIERS)
def carriers(v):
    return C.carriers(v.calls).select("sample_id", "site_id", "gt", "copies", "zygosity", "phased", "ad_ref", "allele_balance")


FAILURES = """
failed AS (SELECT *, list_filter([CASE WHEN dp < 10 THEN 'DP low' END, CASE WHEN gq < 20 THEN 'GQ low' END, CASE WHEN ad_alt < 3 THEN 'alternate depth low' END,
  CASE WHEN gt = './1' THEN 'genotype partially called' END,
  CASE WHEN gt IN ('0/1', '0|1', '1|0') THEN CASE WHEN allele_balance IS NULL THEN 'allele balance unavailable' WHEN allele_balance < 0.2 THEN 'allele balance low' END END,
  CASE WHEN gt IN ('0/1', '0|1', '1|0') AND allele_balance > 0.8 THEN 'allele balance high' END,
  CASE WHEN gt = '1/1' THEN CASE WHEN allele_balance IS NULL THEN 'alternate allele balance unavailable' WHEN allele_balance < 0.8 THEN 'alternate allele balance low' END END], lambda x: x IS NOT NULL) AS failures FROM carried)"""


@on_views("f03_call_qc", K, "SELECT sample_id, site_id, gt, array_to_string(failures, '; ') AS failures FROM failed", CARRIERS, FAILURES)
def call_qc(v):
    return C.with_qc(C.carriers(v.calls)).select("sample_id", "site_id", "gt", F.array_join("failures", "; ").alias("failures"))


@on_views("f04_site_qc", K, "SELECT site_id, count(*) AS carriers, count(*) FILTER (WHERE len(failures) = 0) AS passing, bool_or(len(failures) = 0) AS passes FROM failed GROUP BY site_id", CARRIERS, FAILURES)
def site_qc(v):
    return C.site_qc(v.calls)


@on_views("a18_compound_candidates", ("fx_sites", "fx_calls", "fx_annotations"), """SELECT sample_id, gene, chrom, count(DISTINCT variant_key) AS variants FROM fx_calls JOIN fx_annotations USING (site_id) JOIN keyed USING (site_id)
 WHERE gt IN ('0/1', '0|1', '1|0') GROUP BY ALL HAVING count(DISTINCT variant_key) >= 2""", KEYED)
def candidates(v):
    genes = v.annotations.select("site_id", "gene").distinct().join(H.keyed_sites(v.sites).select("site_id", "chrom", "variant_key"), "site_id")
    return C.compound_candidates(v.calls, genes)


@on_views("j27_best_evidence", K, """SELECT site_id, sample_id, gt, gq FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY gq DESC NULLS LAST, sample_id) AS r FROM fx_calls) WHERE r = 1""")
def evidence(v):
    return C.best_evidence(v.calls, ["site_id"], "sample_id").select("site_id", "sample_id", "gt", "gq")


@on_views("a19_cohort_rows", K, """SELECT site_id, count(*) AS carrier_count, array_to_string(list(sample_id || '=' || gt ORDER BY sample_id), ',') AS carriers,
 arg_max(sample_id, struct_pack(gq := gq, s := sample_id)) AS representative FROM carried GROUP BY site_id""", CARRIERS)
def cohort_rows(v):
    return C.cohort_rows(v.calls).withColumn("carriers", F.array_join(F.transform("carriers", lambda c: F.concat_ws("=", c["sample_id"], c["gt"])), ","))


@on_views("a41_import_counts", ("fx_calls", "fx_files"), """SELECT file_id, count(DISTINCT site_id) AS sites, count(*) AS records, count(*) FILTER (WHERE filter = 'LowQual') AS excluded,
 count(*) FILTER (WHERE filter <> 'LowQual') AS passing, count(*) FILTER (WHERE filter <> 'LowQual' AND gt <> '0/0') AS carriers FROM fx_calls JOIN fx_files USING (sample_id) GROUP BY file_id""")
def import_counts(v):
    return C.import_counts(v.calls, v.files)


@on_views("a33_filter_census", K, "SELECT filter AS label, count(*) AS calls FROM fx_calls GROUP BY filter")
def census(v):
    return C.filter_census(v.calls)


RANKED = f"row_number() OVER (PARTITION BY site_id ORDER BY mane DESC, picked DESC, {IMPACT}, k)"


@on_views("w01_ranked_annotations", N, f"SELECT site_id, k, gene, {RANKED} AS annotation_rank FROM fx_annotations")
def ranked(v):
    return T.ranked(v.annotations).select("site_id", "k", "gene", "annotation_rank")


PREFERRED = "preferred AS (SELECT * FROM fx_annotations a WHERE mane = 1 OR (picked = 1 AND NOT EXISTS (SELECT 1 FROM fx_annotations b WHERE b.site_id = a.site_id AND b.gene = a.gene AND b.mane = 1)))"


@on_views("f11_preferred_transcripts", N, "SELECT site_id, k, gene, transcript FROM preferred", PREFERRED)
def preferred(v):
    return T.preferred(v.annotations).select("site_id", "k", "gene", "transcript")


@on_views("u03_preferred_by_difference", N, "SELECT site_id, k, gene, transcript FROM preferred", PREFERRED)
def preferred_by_difference(v):
    return T.preferred_by_anti_join(v.annotations).select("site_id", "k", "gene", "transcript")


@on_views("f12_single_fallback", N, "SELECT site_id, k, gene, CASE WHEN count(*) OVER (PARTITION BY site_id, gene) = 1 AND mane = 0 THEN 1 ELSE picked END AS picked FROM fx_annotations")
def fallback(v):
    return T.with_single_fallback(v.annotations).select("site_id", "k", "gene", "picked")


@on_views("f10_compact_transcripts", N, """SELECT site_id, k, gene FROM (SELECT *, max(mane) OVER w AS m, max(picked) OVER w AS p, row_number() OVER (PARTITION BY site_id, gene ORDER BY k) AS r FROM fx_annotations WINDOW w AS (PARTITION BY site_id, gene))
 WHERE CASE WHEN m = 1 THEN mane = 1 WHEN p = 1 THEN picked = 1 ELSE r = 1 END""")
def compact(v):
    return T.compact(v.annotations).select("site_id", "k", "gene")


@on_views("w05_preferred_entry", N, "SELECT site_id, k, transcript FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY mane DESC, picked DESC, k) AS r FROM fx_annotations) WHERE r = 1")
def entry(v):
    return T.preferred_entry(v.annotations).select("site_id", "k", "transcript")


@on_views("w04_collapsed_rows", ("fx_calls", "fx_annotations"), f"""SELECT sample_id, site_id, first(transcript) FILTER (WHERE r = 1) AS transcript, string_agg(transcript, ',' ORDER BY r) FILTER (WHERE r > 1) AS others
 FROM carried JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY mane DESC, {IMPACT}, picked DESC, k) AS r FROM fx_annotations) USING (site_id) GROUP BY ALL""", PASSING)
def collapsed(v):
    return T.collapsed(v.annotations, C.carriers(C.passing(v.calls))).select("sample_id", "site_id", "transcript", F.array_join("others", ",").alias("others"))


@on_views("p13_rare_annotations", N, "SELECT site_id, k, popmax FROM fx_annotations WHERE popmax IS NULL OR popmax <= 0.01")
def rare(v):
    return T.rare(v.annotations, 0.01).select("site_id", "k", "popmax")


@on_views("f07_minimum_score", N, "SELECT site_id, k, alpha_missense FROM fx_annotations WHERE alpha_missense >= 0.5")
def minimum(v):
    return v.annotations.filter(T.at_least("alpha_missense", 0.5)).select("site_id", "k", "alpha_missense")


@on_views("a10_consequence_counts", N, "SELECT consequence, count(*) AS rows FROM fx_annotations GROUP BY consequence")
def consequences(v):
    return T.consequence_counts(v.annotations)


@on_views("a17_gene_counts", ("fx_calls", "fx_annotations"), "SELECT gene, count(*) AS rows FROM carried JOIN fx_annotations USING (site_id) GROUP BY gene", PASSING)
def gene_counts(v):
    return T.gene_counts(v.annotations, C.carriers(C.passing(v.calls)))


@on_views("f22_text_search", N, "SELECT site_id, k, gene FROM fx_annotations WHERE contains(lower(concat_ws(chr(10), gene, transcript, consequence)), 'frameshift')")
def found(v):
    return T.text_search(v.annotations, ["gene", "transcript", "consequence"], " FrameShift ").select("site_id", "k", "gene")


def _search_sql(annotation_where: str, site_where: str = "TRUE", genotype_where: str = "TRUE", per_gene: bool = False, preferred_only: bool = True) -> tuple[str, ...]:
    rows = f"""ranked AS (SELECT a.*, row_number() OVER (PARTITION BY site_id{', gene' if per_gene else ''} ORDER BY mane DESC, picked DESC, {IMPACT}, k) AS r
  FROM {'preferred' if preferred_only else 'fx_annotations'} a JOIN keyed USING (site_id) WHERE {annotation_where} AND {site_where}),
found AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS sample_qualifying_variant_count FROM carried c JOIN keyed USING (site_id)
  JOIN (SELECT site_id, gene, transcript, consequence, impact, popmax, mane, picked FROM ranked WHERE r = 1) USING (site_id) JOIN fx_files USING (sample_id) WHERE {site_where} AND {genotype_where})"""
    return (KEYED, PASSING, PREFERRED, rows)


OUT = "variant_key, gene, transcript, impact, popmax, sample_id, gt, zygosity, import_profile, sample_qualifying_variant_count"
V4 = ("fx_calls", "fx_annotations", "fx_files")
GENES = H.CohortQuery("gene_list", genes=("G1", "G2", "G3", "G5", "G8"), max_popmax=0.03)
GENE_SQL = _search_sql("gene IN ('G1', 'G2', 'G3', 'G5', 'G8') AND impact IN ('HIGH', 'MODERATE') AND (popmax IS NULL OR popmax <= 0.03)")


def _search(v, q, individuals=None):
    return H.search(v.sites, v.annotations, v.calls, v.files, q, individuals)


@on_views("x01_cohort_gene_list", V4, f"SELECT {OUT} FROM found", *GENE_SQL)
def gene_list(v):
    return _search(v, GENES).select(*OUT.split(", "))


@on_views("x01_cohort_gene_search", V4, f"SELECT {OUT} FROM found", *_search_sql("gene = 'G7' AND impact IN ('HIGH', 'MODERATE')", per_gene=True))
def gene_search(v):
    return _search(v, H.CohortQuery("gene", genes=("g7",))).select(*OUT.split(", "))


@on_views("x01_cohort_region", V4, f"SELECT {OUT} FROM found", *_search_sql("impact IN ('HIGH', 'MODERATE', 'LOW')", "(chrom = '2' AND pos BETWEEN 1000 AND 300000)"))
def region(v):
    return _search(v, H.CohortQuery("region", chrom="2", start=1000, end=300000, impacts=("HIGH", "MODERATE", "LOW"))).select(*OUT.split(", "))


@on_views("x01_cohort_variant", V4, f"SELECT {OUT} FROM found", *_search_sql("TRUE", "variant_key IN ('2:8919:G:T', '7:16838:G:GGT', 'X:3024757:TACG:T')", preferred_only=False))
def variant(v):
    return _search(v, H.CohortQuery("variant", keys=("2:8919:G:T", "7:16838:g:ggt", "X:3024757:TACG:T"))).select(*OUT.split(", "))


def stored(v):
    """The cohort's tables published with an rsID for each site."""
    spark = v.sites.sparkSession
    store = HS.CohortStore(spark, scratch_path(spark, "cohort"), width=1 << 16)
    store.publish(v.sites.withColumn("rsid", F.concat(F.lit("rs"), (F.col("site_id") * 7).cast("string"))), v.annotations, v.calls)
    return store


@on_views("x01_stored_region", V4, f"SELECT {OUT} FROM found", *_search_sql("impact IN ('HIGH', 'MODERATE', 'LOW')", "(chrom = '2' AND pos BETWEEN 1000 AND 300000)"))
def stored_region(v):
    return stored(v).search(v.files, H.CohortQuery("region", chrom="2", start=1000, end=300000, impacts=("HIGH", "MODERATE", "LOW"))).select(*OUT.split(", "))


@on_views("x01_u02_stored_variants", V4, f"SELECT {OUT} FROM found", *_search_sql("TRUE", "(variant_key IN ('2:8919:G:T', '7:16838:G:GGT', 'X:3024757:TACG:T') OR site_id IN (0, 1, 5, 9, 44))", preferred_only=False))
def stored_variants(v):
    """Keys and rsIDs of either case, one of which names a site that a key names too."""
    keys = ("2:8919:G:T", "7:16838:g:ggt", "X:3024757:TACG:T", "rs7", "RS35", "rs63", "rs308", "rs0", "rs1")
    return stored(v).search(v.files, H.CohortQuery("variant", keys=keys)).select(*OUT.split(", "))


@on_views("f14_zygosity_search", (*V4, "fx_individuals"), f"SELECT {OUT} FROM found", *_search_sql("impact IN ('HIGH', 'MODERATE')", genotype_where="""zygosity = 'homozygous' AND (chrom = 'X' AND pos > 2781479 AND pos < 155701383)
  AND NOT EXISTS (SELECT 1 FROM fx_individuals i WHERE i.sample_id = c.sample_id AND sex_at_birth = 'female')"""))
def zygosity(v):
    """A hemizygous search, in which these files' diploid calls at single-copy loci take part."""
    q = H.CohortQuery("region", chrom="X", start=0, end=5_000_000, zygosity="hemizygous")
    return _search(v, q, v.individuals).select(*OUT.split(", "))


@on_views("f15_scope_search", V4, f"SELECT {OUT} FROM found", *_search_sql("gene IN ('G1', 'G2', 'G3', 'G5', 'G8') AND impact IN ('HIGH', 'MODERATE')", genotype_where="analysis_scope = 'exome' AND import_profile || ':' || analysis_scope = 'full:exome'"))
def scoped(v):
    q = H.CohortQuery("gene_list", genes=GENES.genes, scopes=("exome",), profiles=("full:exome",))
    return _search(v, q).select(*OUT.split(", "))


@on_views("a12_x29_search_totals", V4, "SELECT count(*) AS n, count(DISTINCT sample_id) AS individuals, count(DISTINCT variant_key) AS variants, count(DISTINCT import_profile || analysis_scope) > 1 AS mixed_profiles FROM found", *GENE_SQL)
def search_totals(v):
    return H.totals(_search(v, GENES))


@on_views("a16_search_by_variant", V4, "SELECT variant_key, count(DISTINCT sample_id) AS individuals, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS samples FROM found GROUP BY variant_key", *GENE_SQL)
def by_variant(v):
    return H.by_variant(_search(v, GENES)).withColumn("samples", F.array_join("samples", ","))


@on_views("o01_search_page", V4, f"SELECT variant_key, sample_id, gene, impact FROM found ORDER BY {IMPACT}, coalesce(popmax, -1), chrom, pos, sample_id, gene, site_id LIMIT 50", *GENE_SQL)
def search_page(v):
    """The first page of a search: the limit is the feature."""
    return H.page(_search(v, GENES), 50).select("variant_key", "sample_id", "gene", "impact")


@on_views("j15_mechanism", ("fx_annotations", "fx_scores"), """SELECT a.site_id, a.k, a.gene, coalesce(a.mechanism, f.mechanism) AS mechanism, CASE WHEN f.k IS NOT NULL AND f.k <> a.k THEN 'source_transcript_match_elsewhere' ELSE a.mechanism_match END AS mechanism_match, f.transcript AS source_transcript
 FROM m a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, gene ORDER BY k) AS r FROM m WHERE mechanism_match = 'exact') WHERE r = 1) f USING (site_id, gene)""",
 """m AS (SELECT a.*, CASE WHEN s.score > 50 THEN 'GOF' WHEN s.score IS NOT NULL THEN 'LOF' END AS mechanism, s.score AS mechanism_score, CASE WHEN s.score IS NOT NULL THEN 'exact' ELSE 'none' END AS mechanism_match
  FROM fx_annotations a LEFT JOIN (SELECT site_id, transcript_base, max(score) AS score FROM fx_scores GROUP BY ALL) s ON a.site_id = s.site_id AND split_part(a.transcript, '.', 1) = s.transcript_base)""")
def mechanism(v):
    return H.with_mechanism(annotated_mechanism(v)).select("site_id", "k", "gene", "mechanism", "mechanism_match", "source_transcript")


def annotated_mechanism(v):
    best = v.scores.groupBy("site_id", F.col("transcript_base").alias("base")).agg(F.max("score").alias("mechanism_score"))
    rows = v.annotations.withColumn("base", A.stable_id(F.col("transcript"))).join(best, ["site_id", "base"], "left").drop("base")
    known = F.col("mechanism_score").isNotNull()
    return rows.withColumns({"mechanism": F.when(F.col("mechanism_score") > 50, "GOF").when(known, "LOF"), "mechanism_match": F.when(known, "exact").otherwise("none")})


@on_views("a13_cohort_statistics", ("fx_sites", "fx_calls", "fx_files", "fx_individuals"), """SELECT (SELECT count(DISTINCT file_id) FROM fx_files) AS files, (SELECT count(DISTINCT sample_id) FROM fx_files) AS samples, (SELECT count(DISTINCT import_profile || analysis_scope) FROM fx_files) AS profiles,
 (SELECT count(DISTINCT individual_id) FROM fx_individuals) AS individuals, (SELECT count(DISTINCT variant_key) FROM keyed) AS variants, (SELECT count(*) FROM carried) AS carriers""", KEYED, PASSING)
def statistics(v):
    return H.statistics(v.files, v.individuals, v.sites, v.calls)


@on_views("a14_import_profiles", ("fx_files",), "SELECT import_profile, analysis_scope, count(DISTINCT file_id) AS files, count(*) AS sample_entries FROM fx_files GROUP BY ALL")
def profiles(v):
    return H.import_profiles(v.files)


@on_views("a15_sample_list", ("fx_files", "fx_calls"), "SELECT sample_id, file_id, (SELECT count(*) FROM carried c WHERE c.sample_id = f.sample_id) AS carriers FROM fx_files f WHERE sample_id ILIKE 's1%'", PASSING)
def samples(v):
    return H.sample_list(v.files, v.calls, "s1%")


@on_views("x33_separately_called", V4, """SELECT site_id, min(file_id) AS first_file, count(*) AS carriers, count(DISTINCT file_id) AS files FROM carried JOIN fx_files USING (sample_id)
 JOIN (SELECT site_id, max(popmax) AS popmax FROM fx_annotations GROUP BY site_id) USING (site_id) WHERE popmax IS NULL OR popmax <= 0.02 GROUP BY site_id""", PASSING)
def separately(v):
    return H.separately_called(v.calls, v.files, v.annotations, 0.02)


@on_views("j26_variant_detail", ("fx_calls", "fx_annotations"), "SELECT variant_key, transcript, consequence, sample_id, gt FROM keyed JOIN fx_annotations USING (site_id) JOIN carried USING (site_id) WHERE variant_key = '2:8919:G:T'", KEYED, PASSING)
def detail(v):
    transcripts, carriers_ = H.detail(v.sites, v.annotations, v.calls, "2:8919:G:T")
    return transcripts.select("site_id", "variant_key", "transcript", "consequence").join(carriers_.select("site_id", "sample_id", "gt"), "site_id").drop("site_id")


@on_views("p12_multi_values", S, """SELECT site_id, greatest(a, b) AS hi, least(a, b) AS lo, CASE WHEN abs(-b) > abs(a) THEN -b ELSE a END AS extreme FROM
 (SELECT site_id, site_id % 17 / 4.0 AS a, site_id % 11 / 2.0 AS b FROM fx_sites)""")
def multi(v):
    rows = v.sites.select("site_id", (F.col("site_id") % 17 / 4).alias("a"), (F.col("site_id") % 11 / 2).alias("b"))
    rows = rows.withColumn("both", F.concat_ws("&", F.col("a").cast("string"), F.lit("."), F.col("b").cast("string"))).withColumn("signed", F.concat_ws(",", F.col("a").cast("string"), (-F.col("b")).cast("string")))
    return rows.select("site_id", X.largest(F.col("both")).alias("hi"), X.smallest(F.col("both")).alias("lo"), X.most_extreme(F.col("signed")).alias("extreme"))


@on_views("p04_s04_p07_info", S, """SELECT site_id, CASE WHEN site_id % 3 = 0 THEN NULL ELSE (site_id % 100)::VARCHAR END AS ac, (site_id % 7)::VARCHAR AS second_value, '1' AS flag FROM fx_sites""")
def info(v):
    """INFO text made from sites: per-ALT tokens by arity, a repeated key whose last value holds, a flag."""
    site = F.col("site_id")
    text = F.concat(F.lit("DB;AC="), F.when(site % 3 == 0, F.concat((site % 100).cast("string"), F.lit(",1,2"))).otherwise(F.concat_ws(",", (site % 100).cast("string"), F.lit("9"))), F.lit(";X=0;X="), (site % 7).cast("string"))
    rows = v.sites.select("site_id", X.info_map(text).alias("m"))
    return rows.select("site_id", X.per_allele(F.col("m")["AC"], F.lit(0), F.lit(2)).alias("ac"), F.col("m")["X"].alias("second_value"), F.col("m")["DB"].alias("flag"))


@on_views("p25_zygosity_classes", K, "SELECT gt, zygosity, count(*) AS n FROM carried GROUP BY ALL", CARRIERS)
def classes(v):
    return C.carriers(v.calls).groupBy("gt", "zygosity").agg(F.count("*").alias("n"))


@on_views("p15_review_classes", K, """SELECT gt, CASE WHEN gt IN ('./1', '0/0') THEN 'other' WHEN gt = '1/1' THEN 'homozygous_alt' ELSE 'heterozygous' END AS class, count(*) AS n FROM fx_calls GROUP BY ALL""")
def review_classes(v):
    return v.calls.groupBy("gt", G.review_class(F.col("gt")).alias("class")).agg(F.count("*").alias("n"))


@on_views("o02_disrupted_last", N, "SELECT site_id, k, row_number() OVER (PARTITION BY site_id ORDER BY consequence = 'frameshift_variant', mane DESC, k)::INTEGER AS place FROM fx_annotations")
def disrupted_last(v):
    """A site's transcripts, those with a shifted frame behind the others."""
    rows = v.annotations.withColumn("disrupted", F.when(F.col("consequence") == "frameshift_variant", True)).withColumn("other", 1 - F.col("mane"))
    return T.with_place(rows, "site_id", "disrupted", "other", "k").select("site_id", "k", "place")


@on_views("p04_left_aligned", S, "SELECT site_id, 1::BIGINT AS pos, CASE WHEN site_id % 2 = 0 THEN 'T' || u ELSE 'T' END AS ref, CASE WHEN site_id % 2 = 0 THEN 'T' ELSE 'T' || u END AS alt, 'aligned' AS status FROM (SELECT site_id, ['A', 'CA', 'GTC'][site_id % 3 + 1] AS u FROM fx_sites)")
def left_aligned(v):
    """A repeat on a contig for each site, some of 3,000 bases, with a turned unit taken out or put in somewhere within."""
    n = F.col("site_id")
    unit = F.element_at(F.array(F.lit("A"), F.lit("CA"), F.lit("GTC")), (n % 3 + 1).cast("int"))
    rows = v.sites.select("site_id", F.concat(F.lit("k"), n.cast("string")).alias("chrom"), unit.alias("u"), ((5 + n % 50) * F.when(n % 25 == 0, 40).otherwise(1)).cast("int").alias("times"))
    rows = rows.withColumns({"sequence": F.concat(F.lit("T"), F.repeat("u", F.col("times")), F.lit("NNNN")), "size": F.length("u")})
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / P.CHUNK).cast("int")), lambda i: F.struct(i.cast("long").alias("chunk"), F.substring("sequence", i * P.CHUNK + 1, F.lit(P.CHUNK)).alias("bases")))
    chunks = rows.select("chrom", F.inline(pieces)).withColumnRenamed("bases", "sequence")
    path = scratch_path(rows.sparkSession, "chunks")  # each round reads the sequence: it's made once
    chunks.write.parquet(path)
    chunks = rows.sparkSession.read.parquet(path)
    at = (1 + n % (F.col("size") * (F.col("times") - 1))).cast("int")  # the base in front of the indel
    base, turned = F.substring("sequence", at, F.lit(1)), F.substring("sequence", at + 1, F.col("size"))
    long, short = F.concat(base, turned), base
    alleles = rows.select("site_id", "chrom", at.alias("pos"), F.when(n % 2 == 0, long).otherwise(short).alias("ref"), F.when(n % 2 == 0, short).otherwise(long).alias("alt"))
    return P.left_aligned(alleles, chunks).select("site_id", "pos", "ref", "alt", "status")
