"""Queries on regulatory context and the ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions.scratch import scratch_path
from varloom.operators import cohort as H
from varloom.operators import intervals as I  # noqa: E741
from varloom.operators import matrix as M
from varloom.operators import regulatory as R
from varloom.plans.base import KEYED, on_views

CO, PR, CP, ED = ("fx_codes",), ("fx_profiles",), ("fx_codes", "fx_profiles"), ("fx_edges",)
FAM = "['', 'promoter', 'enhancer', 'enhancer', 'h3k4me3', 'ctcf', 'tf', 'accessibility', 'tf'][code + 1]"
CLS = "['inactive', 'PLS', 'pELS', 'dELS', 'CA-H3K4me3', 'CA-CTCF', 'CA-TF', 'CA', 'TF'][code + 1]"
MEMBERS = """
rp AS (SELECT ontology_id, donor, sample_index, evidence_tier FROM (SELECT *, row_number() OVER (PARTITION BY ontology_id, donor ORDER BY CASE evidence_tier WHEN 'full_classification' THEN 1 WHEN 'partial_classification' THEN 2 ELSE 3 END, sample_index) AS r FROM fx_profiles) WHERE r = 1),
cm AS (SELECT c.row_index, m.*, c.code, """ + FAM + """ AS fam FROM fx_codes c JOIN rp m USING (sample_index))"""
STATE = "CASE WHEN detected = 0 THEN 'not_detected' WHEN len(s) > 1 THEN 'mixed' WHEN s = ['h3k4me3'] THEN 'h3k4me3_associated' WHEN len(s) = 1 THEN 'classified' {more} ELSE 'accessible_only' END"
SPEC = "coalesce(list(DISTINCT fam) FILTER (WHERE code > 0 AND fam <> 'accessibility'), [])"
CONTEXT = f"""
cx AS (SELECT *, {STATE.format(more="WHEN capability = 0 THEN 'accessible_classification_unavailable'")} AS state FROM (SELECT row_index, ontology_id, count(DISTINCT donor) AS donors, count(DISTINCT donor) FILTER (WHERE code > 0) AS detected,
 count(*) FILTER (WHERE evidence_tier <> 'accessibility_only') AS capability, {SPEC} AS s FROM cm GROUP BY ALL))"""


def members(v):
    return R.representatives(v.profiles)


def packed(v):
    """The matrix, packed once and read back."""
    spark, path = v.codes.sparkSession, scratch_path(v.codes.sparkSession, "matrix")
    M.pack(v.codes, 25).write.parquet(path)
    return spark.read.parquet(path)


@on_views("a21_element_states", CO, f"SELECT row_index, samples, detected, {STATE.format(more='')} AS state FROM (SELECT row_index, count(*) AS samples, count(*) FILTER (WHERE code > 0) AS detected, {SPEC} AS s FROM (SELECT *, {FAM} AS fam FROM fx_codes) GROUP BY row_index)")
def states(v):
    return M.element_states(packed(v))


@on_views("a22_tissue_evidence", CO, f"SELECT row_index, sample_index, {CLS} AS class, CASE WHEN code = 0 THEN 'not_detected' WHEN code = 7 THEN 'accessible_only' WHEN code = 4 THEN 'h3k4me3_associated' ELSE 'classified' END AS state FROM fx_codes")
def tissues(v):
    return M.tissue_evidence(packed(v))


@on_views("w09_representatives", PR, "SELECT ontology_id, donor, first(sample_index) FILTER (WHERE r = 1) AS sample_index, coalesce(string_agg(sample_index, ',' ORDER BY r) FILTER (WHERE r > 1), '') AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY ontology_id, donor ORDER BY CASE evidence_tier WHEN 'full_classification' THEN 1 WHEN 'partial_classification' THEN 2 ELSE 3 END, sample_index) AS r FROM fx_profiles) GROUP BY ALL")
def chosen(v):
    return members(v).select("ontology_id", "donor", "sample_index", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"))


@on_views("a23_context_evidence", CP, f"""SELECT row_index, ontology_id, donors, detected, capability, state, classes FROM cx JOIN (SELECT row_index, ontology_id, string_agg(class || '=' || n, ',' ORDER BY class) AS classes FROM (SELECT row_index, ontology_id, {CLS} AS class, count(*) AS n FROM cm GROUP BY ALL) GROUP BY ALL) USING (row_index, ontology_id)""", MEMBERS, CONTEXT)
def contexts(v):
    out = M.context_evidence(packed(v), members(v))
    return out.withColumn("classes", F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@on_views("a24_curated_summary", CP, """SELECT row_index, ontology_id, CASE WHEN positive = 0 AND cap = 0 THEN 'no_classifying_evidence_in_context' WHEN positive = 0 THEN 'not_detected' WHEN classified = 0 THEN CASE WHEN positive >= 2 THEN 'replicated_' ELSE 'single_' END || 'accessibility_only'
 WHEN len(s) > 1 THEN 'mixed_specific_classes' WHEN len(s) = 1 THEN CASE WHEN ing >= 2 THEN 'replicated_' ELSE 'single_' END || s[1] || CASE WHEN s[1] = 'h3k4me3' THEN '_associated' ELSE '_like' END ELSE CASE WHEN classified >= 2 THEN 'replicated_' ELSE 'single_' END || 'accessibility_supported' END AS status,
 len(s) > 1 AS discordant, CASE cap WHEN 0 THEN 'unavailable' WHEN 1 THEN 'single_donor' ELSE 'replicated' END AS evidence FROM (SELECT row_index, ontology_id, count(*) FILTER (WHERE code > 0) AS positive, count(*) FILTER (WHERE code > 0 AND ok) AS classified, count(*) FILTER (WHERE ok) AS cap,
 coalesce(list(DISTINCT fam) FILTER (WHERE code > 0 AND ok AND fam <> 'accessibility'), []) AS s, count(*) FILTER (WHERE code > 0 AND ok AND fam <> 'accessibility') AS ing FROM (SELECT *, evidence_tier <> 'accessibility_only' AS ok FROM cm) GROUP BY ALL)""", MEMBERS)
def curated(v):
    return M.curated_summary(packed(v), members(v))


@on_views("a25_overlap_summary", CP, "SELECT row_index, td AS tissues_detected, t AS tissues, cd AS contexts_detected, c AS contexts, mixed FROM (SELECT row_index, count(*) FILTER (WHERE code > 0) AS td, count(*) AS t FROM fx_codes GROUP BY 1) JOIN (SELECT row_index, count(*) FILTER (WHERE detected > 0) AS cd, count(*) AS c, count(*) FILTER (WHERE state = 'mixed') AS mixed FROM cx GROUP BY 1) USING (row_index)", MEMBERS, CONTEXT)
def summary(v):
    return M.overlap_summary(packed(v), members(v))


def _filtered(v, mode):
    sites = I.as_interval(H.keyed_sites(v.sites)).select("site_id", "chrom", "start0", "end0")
    return R.filter_sites(sites, v.ccre, M.context_evidence(packed(v), members(v)), ["CL:1", "CL:2"], mode).select("site_id")


FILTER = "hit AS (SELECT site_id, count(DISTINCT ontology_id) AS n FROM keyed s JOIN fx_ccre c ON c.chrom = s.chrom AND s.pos - 1 < c.end0 AND c.start0 < s.pos - 1 + length(s.ref) JOIN cx USING (row_index) WHERE detected > 0 AND ontology_id IN ('CL:1', 'CL:2') GROUP BY site_id)"


@on_views("f17_any_context", ("fx_sites", *CP), "SELECT site_id FROM hit", KEYED, MEMBERS, CONTEXT, FILTER)
def any_context(v):
    return _filtered(v, "any")


@on_views("f17_all_contexts", ("fx_sites", *CP), "SELECT site_id FROM hit WHERE n = 2", KEYED, MEMBERS, CONTEXT, FILTER)
def all_contexts(v):
    return _filtered(v, "all")


@on_views("a27_assay_capabilities", PR, "SELECT ontology_id, count(DISTINCT donor) AS donors, count(*) FILTER (WHERE evidence_tier <> 'accessibility_only') AS any_specific, count(*) FILTER (WHERE evidence_tier = 'full_classification') AS full FROM fx_profiles GROUP BY 1")
def capabilities(v):
    return R.assay_capabilities(v.profiles)


@on_views("a30_element_summary", CP, "SELECT row_index, count(DISTINCT ontology_id) AS contexts, count(DISTINCT donor) AS donors FROM cm WHERE code > 0 GROUP BY 1", MEMBERS)
def elements(v):
    return M.element_summary(packed(v), members(v))


@on_views("a31_histograms", CO, "SELECT sample_index, code, count(*) AS elements, 0::BIGINT AS copies FROM fx_codes GROUP BY ALL")
def histograms(v):
    return R.histograms(v.codes)


@on_views("a31_histogram_mismatch", CO, "SELECT sample_index, code, count(*) AS a, nullif(count(*) FILTER (WHERE row_index % 10 <> 3), 0) AS b FROM fx_codes GROUP BY ALL HAVING count(*) <> count(*) FILTER (WHERE row_index % 10 <> 3)")
def mismatch(v):
    return R.histogram_mismatch(R.histograms(v.codes), R.histograms(v.codes.filter("row_index % 10 <> 3")))


@on_views("x17_encoded_rows", CO, "SELECT row_index, string_agg(code, ',' ORDER BY sample_index) AS codes, sha256(string_agg(code, ',' ORDER BY sample_index)) AS digest FROM fx_codes GROUP BY 1")
def encoded(v):
    return packed(v).withColumn("codes", F.array_join(F.transform("codes", lambda c: c.cast("string")), ","))


@on_views("x38_misaligned_rows", CO, "SELECT row_index, row_index % 100 = 7 AS missing FROM (SELECT DISTINCT row_index FROM fx_codes) WHERE row_index % 100 IN (5, 7)")
def misaligned(v):
    rows = packed(v)
    pinned = rows.select("row_index", F.when(F.col("row_index") % 100 == 5, "?").otherwise(F.col("digest")).alias("digest"))
    return R.misaligned(rows.filter("row_index % 100 <> 7"), pinned)


CLOSURE = "cl AS (WITH RECURSIVE r(term, ancestor) AS (SELECT term, parent FROM fx_edges UNION SELECT r.term, e.parent FROM r JOIN fx_edges e ON e.term = r.ancestor) SELECT DISTINCT term, ancestor FROM r)"


@on_views("x20_closure", ED, "SELECT term, ancestor FROM cl", CLOSURE)
def closure(v):
    return R.closure(v.edges)


@on_views("x21_direct_parents", ED, "SELECT term, parent AS ancestor FROM fx_edges", CLOSURE)
def parents(v):
    return R.direct_parents(R.closure(v.edges))


@on_views("x19_lineages", ED, "SELECT term, CASE WHEN term = 1 OR EXISTS (SELECT 1 FROM cl WHERE cl.term = t.term AND ancestor = 1) THEN 'left' WHEN term = 5 OR EXISTS (SELECT 1 FROM cl WHERE cl.term = t.term AND ancestor = 5) THEN 'right' WHEN term % 2 = 0 THEN 'even' ELSE 'other' END AS lineage FROM fx_edges t", CLOSURE)
def lineages(v):
    terms = v.edges.select("term", F.when(F.col("term") % 2 == 0, "Even cell").otherwise("cell").alias("name"))
    return R.lineages(terms, R.closure(v.edges), [("left", 1), ("right", 5)], [("even", "^even")])


@on_views("a29_donor_dependence", ("fx_edges", "fx_profiles"), """SELECT ancestor AS parent, term AS child, (SELECT count(DISTINCT a.donor) FROM pm a JOIN pm b USING (donor) WHERE a.term = cl.term AND b.term = cl.ancestor) AS shared FROM cl WHERE term IN (SELECT term FROM pm) AND ancestor IN (SELECT term FROM pm)""", CLOSURE, "pm AS (SELECT sample_index AS term, donor FROM fx_profiles)")
def dependence(v):
    return R.donor_dependence(v.profiles.select(F.col("sample_index").alias("term"), "donor"), R.closure(v.edges))


PROFILE = "cp AS (SELECT c_custkey AS id, c_custkey % 4 AS lineage, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 END AS donor, c_custkey % 11 = 0 AS treated, c_custkey % 13 = 0 AS diseased FROM customer)"


def profiles(v):
    n = F.col("c_custkey")
    return R.curated_profiles(v.table("customer").select(n.alias("id"), (n % 4).alias("lineage"), F.when(n % 7 != 0, n % 50).alias("donor"), F.lit("CL:1").alias("ontology_id"), (n % 11 == 0).alias("treated"), (n % 13 == 0).alias("diseased")))


@on_views("a26_curated_profiles", (), "SELECT id, concat_ws(',', CASE WHEN donor IS NULL THEN 'no_donor' END, CASE WHEN treated THEN 'treated' END, CASE WHEN diseased THEN 'diseased' END) AS reasons, donor IS NOT NULL AND NOT treated AND NOT diseased AS baseline FROM cp", PROFILE)
def curation(v):
    return profiles(v).select("id", F.array_join("reasons", ",").alias("reasons"), "baseline")


@on_views("a28_lineage_coverage", (), """SELECT lineage, source, eligible, donors, reasons FROM (SELECT lineage, count(*) AS source, count(*) FILTER (WHERE ok) AS eligible, count(DISTINCT donor) FILTER (WHERE ok) AS donors FROM (SELECT *, donor IS NOT NULL AND NOT treated AND NOT diseased AS ok FROM cp) GROUP BY 1)
 LEFT JOIN (SELECT lineage, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT lineage, reason, count(*) AS n FROM (SELECT lineage, unnest(list_filter([CASE WHEN donor IS NULL THEN 'no_donor' END, CASE WHEN treated THEN 'treated' END, CASE WHEN diseased THEN 'diseased' END], lambda x: x IS NOT NULL)) AS reason FROM cp) GROUP BY ALL) GROUP BY 1) USING (lineage)""", PROFILE)
def coverage(v):
    return R.lineage_coverage(profiles(v)).withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat_ws("=", r["reason"], r["n"].cast("string"))), ","))


@on_views("a47_biosamples", (), """SELECT 'cell donor_' || c_nationkey AS name, CASE n WHEN 3 THEN 'full_classification' WHEN 0 THEN 'accessibility_only' ELSE 'partial_classification' END AS tier, c_nationkey::VARCHAR AS donor
 FROM (SELECT c_nationkey, count(DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END) AS n FROM customer GROUP BY 1)""")
def biosamples(v):
    n = F.col("c_custkey")
    rows = v.table("customer").select(F.concat(F.lit("cell donor_"), "c_nationkey").alias("name"), F.element_at(F.array(*[F.lit(x) for x in ("H3K4me3", "H3K27ac", "CTCF", "DNase", "ATAC")]), (n % 5 + 1).cast("int")).alias("assay"))
    return R.selected_biosamples(rows)


@on_views("s07_interval_order", ("fx_ccre",), "SELECT row_index, 'unsorted' AS violation FROM (SELECT *, lag(start0) OVER (PARTITION BY chrom ORDER BY row_index) AS b FROM fx_ccre) WHERE start0 < b")
def order(v):
    return R.ordered_violations(v.ccre, "row_index").select("row_index", "violation")


@on_views("x18_element_catalog", ("fx_ccre", "fx_codes"), "SELECT row_index, chrom, start0, end0, ccre_class, count(code) AS samples FROM fx_ccre JOIN fx_codes USING (row_index) GROUP BY ALL")
def catalog(v):
    return v.ccre.join(v.codes, "row_index").groupBy("row_index", "chrom", "start0", "end0", "ccre_class").agg(F.count("code").alias("samples"))
