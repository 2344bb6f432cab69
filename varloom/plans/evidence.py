"""Queries on clinical evidence and genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import fields as X
from varloom.operators import clinical as L
from varloom.operators import cohort as H
from varloom.operators import genes as E
from varloom.plans.base import KEYED, on_views
from varloom.sources import fixtures

CAT, PRO = ("fx_catalog",), ("fx_protein", "fx_catalog")
PATH = "classification IN ('Pathogenic', 'Likely_pathogenic')"


@on_views("p25_p26_labels", CAT, f"SELECT record_id, {PATH} AS whole, contains(lower(classification), 'pathogenic') AS mentioned FROM fx_catalog")
def labels(v):
    c = F.col("classification")
    return v.catalog.select("record_id", L.is_pathogenic_label(c).alias("whole"), L.mentions_pathogenic(c).alias("mentioned"))


@on_views("j01_exact_evidence", ("fx_sites", "fx_catalog"), """SELECT k.site_id, coalesce(string_agg(record_id, ',' ORDER BY record_id), '') AS records FROM keyed k LEFT JOIN fx_catalog c ON c.source_site_id = k.site_id GROUP BY k.site_id""", KEYED)
def exact(v):
    sites = H.keyed_sites(v.sites).select("site_id", "chrom", "pos", "ref", "alt")
    evidence = v.catalog.join(sites.withColumnRenamed("site_id", "source_site_id"), "source_site_id").drop("source_site_id")
    out = L.exact_evidence(sites, evidence, ["chrom", "pos", "ref", "alt"], "record_id", ["record_id", "classification"])
    return out.select("site_id", F.array_join(F.transform("evidence", lambda e: e["record_id"]), ",").alias("records"))


@on_views("j02_active_assertions", ("fx_sites", "fx_catalog"), f"SELECT k.site_id, count(record_id) AS assertions FROM keyed k LEFT JOIN fx_catalog c ON c.source_site_id = k.site_id AND {PATH} GROUP BY k.site_id", KEYED)
def assertions(v):
    sites = H.keyed_sites(v.sites).select("site_id")
    active = v.catalog.filter(L.is_pathogenic_label(F.col("classification"))).withColumnRenamed("source_site_id", "site_id").select("site_id", "record_id", "gene")
    return L.exact_evidence(sites, active, ["site_id"], "gene", ["gene", "record_id"]).select("site_id", F.size("evidence").cast("long").alias("assertions"))


MATCH = f"""
pm AS (SELECT q.*, max(record_id) IS NOT NULL AS residue_match, coalesce(bool_or(c.alt_aa = q.alt_aa), FALSE) AS change_match, coalesce(string_agg(DISTINCT record_id, ',' ORDER BY record_id), '') AS details
 FROM fx_protein q LEFT JOIN (SELECT gene AS g, transcript_base, protein_position AS p, ref_aa AS r, alt_aa, record_id, source_site_id FROM fx_catalog WHERE {PATH}) c
 ON g = gene AND transcript_base = split_part(transcript, '.', 1) AND p = protein_position AND r = ref_aa AND source_site_id <> site_id GROUP BY ALL)"""


@on_views("j12_protein_matches", PRO, "SELECT site_id, k, residue_match, change_match, details FROM pm", MATCH)
def protein(v):
    return L.protein_matches(v.protein, v.catalog).select("site_id", "k", "residue_match", "change_match", F.array_join("details", ",").alias("details"))


@on_views("p24_protein_status", PRO, "SELECT site_id, k, CASE WHEN change_match THEN 'selected' WHEN bool_or(change_match) OVER (PARTITION BY site_id) THEN 'other_transcript' ELSE 'no_match' END AS status FROM pm", MATCH)
def status(v):
    return L.protein_status(L.protein_matches(v.protein, v.catalog)).select("site_id", "k", "status")


@on_views("a46_ordered_classes", CAT, """SELECT gene, string_agg(classification, ',' ORDER BY r) AS classes FROM (SELECT DISTINCT gene, classification, CASE classification WHEN 'Pathogenic' THEN 1 WHEN 'Likely_pathogenic' THEN 2 ELSE 9 END AS r FROM fx_catalog) GROUP BY gene""")
def ordered(v):
    return L.ordered_classes(v.catalog, "gene", "classification").select("gene", F.array_join("classes", ",").alias("classes"))


@on_views("x10_protein_catalog", CAT, f"""SELECT gene, transcript_base, protein_position, alt_aa, record_id, source FROM (SELECT *, row_number() OVER (PARTITION BY gene, transcript_base, protein_position, ref_aa, alt_aa, source_site_id ORDER BY o, record_id) AS r FROM
 (SELECT *, 0 AS o, 'first' AS source FROM fx_catalog WHERE length(record_id) % 2 = 0 UNION ALL SELECT *, 1, 'second' FROM fx_catalog UNION ALL SELECT * REPLACE (source_site_id + 7 AS source_site_id), 2, 'third' FROM fx_catalog) WHERE {PATH}) WHERE r = 1""")
def catalog(v):
    c = v.catalog
    sources = [("first", c.filter(F.length("record_id") % 2 == 0)), ("second", c), ("third", c.withColumn("source_site_id", F.col("source_site_id") + 7))]
    return L.build_catalog(sources).select("gene", "transcript_base", "protein_position", "alt_aa", "record_id", "source")


MAPPED = """
mp AS (SELECT record_id, CASE WHEN n % 5 = 0 THEN n END AS i, CASE WHEN n % 3 = 0 THEN 'A' || n END AS a, n, n % 11 <> 0 AS active FROM (SELECT *, CAST(substr(record_id, 2) AS BIGINT) AS n FROM fx_catalog)),
mq AS (SELECT *, CASE WHEN i IS NOT NULL THEN 'id' WHEN a IS NOT NULL THEN 'alias' WHEN n % 2 = 0 THEN 'text' ELSE 'unmapped' END AS mapping, CASE WHEN i IS NOT NULL OR a IS NOT NULL OR n % 2 = 0 THEN n END AS site_id FROM mp)"""


def mapping_rows(v):
    n = F.substring("record_id", 2, 20).cast("long")
    rows = v.catalog.select("record_id", F.when(n % 5 == 0, n).alias("id"), F.when(n % 3 == 0, F.concat(F.lit("A"), n)).alias("alias"), F.concat(F.lit("T"), n).alias("text"), (n % 11 != 0).alias("active"))
    s = v.sites.select("site_id")
    return L.mapped(rows, s.select(F.col("site_id").alias("id"), "site_id"), s.select(F.concat(F.lit("A"), "site_id").alias("alias"), "site_id"), s.filter("site_id % 2 = 0").select(F.concat(F.lit("T"), "site_id").alias("text"), "site_id"))


@on_views("j23_mapping", CAT, "SELECT record_id, site_id, mapping FROM mq", MAPPED)
def mapping(v):
    return mapping_rows(v).select("record_id", "site_id", "mapping")


@on_views("x22_mapping_rate", CAT, "SELECT count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE active AND mapping <> 'unmapped') AS mapped, count(*) FILTER (WHERE active AND mapping <> 'unmapped') >= count(*) FILTER (WHERE active) * 0.995 AS enough FROM mq", MAPPED)
def rate(v):
    return L.mapping_rate(mapping_rows(v))


@on_views("s19_import_rejects", ("fx_sites",), "SELECT site_id, CASE WHEN site_id % 13 = 0 THEN 'no position' WHEN site_id % 7 = 0 THEN 'symbolic allele' WHEN upper(ref) = upper(alt) THEN 'no change' END AS reason FROM fx_sites")
def rejects(v):
    rows = v.sites.withColumns({"pos": F.when(F.col("site_id") % 13 != 0, F.col("pos")), "alt": F.when(F.col("site_id") % 7 == 0, "<DEL>").otherwise(F.col("alt"))})
    return L.split_rejects(rows).select("site_id", "reason")


@on_views("s20_last_row_by_key", CAT, "SELECT gene, transcript_base, record_id FROM (SELECT *, row_number() OVER (PARTITION BY gene, transcript_base ORDER BY source_site_id DESC) AS r FROM fx_catalog) WHERE r = 1")
def last(v):
    return L.last_by_key(v.catalog, ["gene", "transcript_base"], "source_site_id").select("gene", "transcript_base", "record_id")


@on_views("s21_repeated_keys", CAT, "SELECT gene, count(*) AS n FROM fx_catalog GROUP BY gene HAVING count(*) > 1")
def repeated(v):
    return L.repeated_keys(v.catalog, "gene")


@on_views("p27_protein_change", ("fx_protein",), "SELECT site_id, k, ref_aa AS ref, protein_position AS position, alt_aa AS alt FROM fx_protein")
def change(v):
    """HGVSp text written from one-letter code and read again."""
    three = F.create_map(*[F.lit(x) for n, c in X.AMINO_ACIDS.items() if c not in "U*" for x in (c, n)])
    text = F.concat(F.lit("ENSP1.2:p."), three[F.col("ref_aa")], F.col("protein_position").cast("string"), three[F.col("alt_aa")])
    return v.protein.select("site_id", "k", X.protein_change(text).alias("c")).select("site_id", "k", "c.ref", "c.position", "c.alt")


@on_views("j20_resolved_symbols", ("fx_aliases",), """SELECT symbol, coalesce(ap, CASE WHEN n = 1 THEN ot END) AS hgnc_id, CASE WHEN ap IS NOT NULL THEN 'approved' WHEN n = 1 THEN 'alias' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS how FROM
 (SELECT DISTINCT alias AS symbol FROM fx_aliases UNION SELECT alias || 'X' FROM fx_aliases) LEFT JOIN (SELECT alias AS symbol, min(hgnc_id) AS ap FROM fx_aliases WHERE kind = 'approved' GROUP BY 1) USING (symbol)
 LEFT JOIN (SELECT alias AS symbol, count(DISTINCT hgnc_id) AS n, min(hgnc_id) AS ot FROM fx_aliases WHERE kind <> 'approved' GROUP BY 1) USING (symbol)""")
def resolve(v):
    symbols = v.aliases.select(F.explode(F.array("alias", F.concat("alias", F.lit("X")))).alias("symbol")).distinct()
    return E.resolve(symbols, v.aliases)


@on_views("j21_gene_report", ("fx_aliases", "fx_catalog", "fx_annotations"), """SELECT hgnc_id, (SELECT string_agg(DISTINCT alias, ',' ORDER BY alias) FROM fx_aliases b WHERE b.hgnc_id = a.hgnc_id AND kind = 'previous') AS previous,
 (SELECT count(DISTINCT record_id) FROM fx_catalog c WHERE c.gene = a.alias) AS records FROM fx_aliases a WHERE kind = 'approved'""")
def report(v):
    genes = v.aliases.filter("kind = 'approved'").select("hgnc_id", F.col("alias").alias("symbol"))
    records = v.catalog.join(genes, F.col("gene") == F.col("symbol")).select("hgnc_id", "record_id", "classification")
    out = E.report(genes, {"previous": (v.aliases.filter("kind = 'previous'"), ["alias"]), "records": (records, ["record_id", "classification"])})
    return out.select("hgnc_id", F.array_join(F.transform("previous", lambda p: p["alias"]), ",").alias("previous"), F.size("records").cast("long").alias("records"))


CONSTRAINT = "gc AS (SELECT 'G' || p_partkey % 29 AS gene, p_partkey AS id, (p_partkey % 100) / 100.0 AS pli, (p_partkey % 37) / 20.0 AS loeuf, p_partkey % 2 = 0 AS canonical, p_size AS size FROM part)"


def constraint(v):
    n = F.col("p_partkey")
    return v.table("part").select(F.concat(F.lit("G"), n % 29).alias("gene"), n.alias("id"), (n % 100 / 100).alias("pli"), (n % 37 / 20).alias("loeuf"), (n % 2 == 0).alias("canonical"), F.col("p_size").alias("size"))


@on_views("a34_one_row_per_gene", (), "SELECT gene, id FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY canonical DESC, size DESC, id) AS r FROM gc) WHERE r = 1", CONSTRAINT)
def per_gene(v):
    return E.one_per_gene(constraint(v), [F.col("canonical"), F.col("size")], "id").select("gene", "id")


@on_views("f21_constrained", (), "SELECT id, gene FROM gc WHERE pli >= 0.9 OR loeuf < 0.6", CONSTRAINT)
def constrained(v):
    return E.constrained(constraint(v)).select("id", "gene")


@on_views("j13_with_constraint", ("fx_annotations",), "SELECT site_id, k, id FROM fx_annotations LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY canonical DESC, size DESC, id) AS r FROM gc) WHERE r = 1 AND id % 3 <> 0) USING (gene)", CONSTRAINT)
def with_constraint(v):
    one = E.one_per_gene(constraint(v), [F.col("canonical"), F.col("size")], "id").filter("id % 3 <> 0").withColumn("gene", F.lower("gene"))
    return E.with_constraint(v.annotations.select("site_id", "k", "gene"), one).select("site_id", "k", "id")


@on_views("f20_s13_gene_sets", ("fx_annotations",), "SELECT site_id, k, gene FROM fx_annotations WHERE gene IN ('G1', 'G4', 'G9') AND gene IN (SELECT gene FROM gc WHERE pli >= 0.9 OR loeuf < 0.6)", CONSTRAINT)
def sets(v):
    wanted = E.gene_list(v.sites.sparkSession.createDataFrame([("Gene g1, g4;G9",)], "value string"))
    return E.in_sets(v.annotations, wanted, E.constrained(constraint(v))).select("site_id", "k", "gene")


@on_views("a35_composite_genes", (), """SELECT id, unnest(list_distinct(['G' || id % 7, 'H' || id % 3])) AS gene, id % 3 = 0 AS dominant, id % 3 = 1 AS recessive, id % 3 = 2 AS x_linked FROM (SELECT p_partkey AS id FROM part)""")
def composite(v):
    n = F.col("p_partkey")
    rows = v.table("part").select(n.alias("id"), F.concat(F.lit("g"), n % 7, F.lit("/ H"), n % 3, F.lit(", G"), n % 7).alias("genes"), F.when(n % 3 == 0, "AD").when(n % 3 == 1, "Autosomal recessive").otherwise("XLR").alias("inheritance"))
    return E.gene_rows(rows).select("id", "gene", "dominant", "recessive", "x_linked")


@on_views("a36_categories", ("fx_annotations",), "SELECT consequence AS category, count(DISTINCT gene) AS genes FROM fx_annotations GROUP BY 1")
def categories(v):
    return E.categories(v.annotations.withColumnRenamed("consequence", "category"))


PHENO = "ph AS (SELECT 'G' || p_partkey % 29 AS gene, p_brand AS phenotype, substr(p_type, 1, 3) AS inheritance, (1 + p_partkey % 4)::INT AS mapping_key, 100000 + p_partkey AS mim FROM part)"


def phenotypes(v):
    n = F.col("p_partkey")
    return v.table("part").select(F.concat(F.lit("G"), n % 29).alias("gene"), F.col("p_brand").alias("phenotype"), F.substring("p_type", 1, 3).alias("inheritance"), (1 + n % 4).cast("int").alias("mapping_key"), (100000 + n).alias("mim"))


@on_views("a37_phenotypes", (), "SELECT gene, phenotype, max(inheritance) AS inheritance, min(mapping_key) AS mapping_key, count(*) AS rows FROM ph GROUP BY ALL", PHENO)
def grouped(v):
    return E.grouped_phenotypes(phenotypes(v))


@on_views("j24_anchored", (), "SELECT mim, gene, CASE WHEN mim % 3 = 0 OR mim % 5 = 0 THEN phenotype END AS phenotype, CASE WHEN mim % 3 = 0 THEN 'first' WHEN mim % 5 = 0 THEN 'second' END AS source FROM ph", PHENO)
def anchored(v):
    p = phenotypes(v)
    return E.anchored(p.select("mim", "gene"), p.filter("mim % 3 = 0"), p.filter("mim % 5 = 0"))


@on_views("j22_relationships", (), """SELECT r.gene, coalesce(c1.mim, c2.mim) AS disease_id, CASE WHEN c1.mim IS NOT NULL THEN 'id' WHEN c2.mim IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM (SELECT * FROM ph WHERE mim % 4 <> 0) r LEFT JOIN (SELECT mim FROM ph WHERE mim % 3 = 0) c1 USING (mim)
 LEFT JOIN (SELECT phenotype, min(mim) AS mim FROM ph WHERE mim % 3 = 0 GROUP BY 1 HAVING count(*) = 1) c2 USING (phenotype)
 UNION ALL SELECT NULL, mim, 'catalog_only' FROM ph WHERE mim % 3 = 0 AND mim % 4 = 0 AND mim NOT IN (SELECT c2.mim FROM ph r JOIN (SELECT phenotype, min(mim) AS mim FROM ph WHERE mim % 3 = 0 GROUP BY 1 HAVING count(*) = 1) c2 USING (phenotype) WHERE r.mim % 4 <> 0 AND r.mim % 3 <> 0)""", PHENO)
def relationships(v):
    p = phenotypes(v)
    relations = p.filter("mim % 4 <> 0").select("gene", F.col("mim").alias("disease_id"), F.col("phenotype").alias("disease_name"))
    return E.relationships(relations, p.filter("mim % 3 = 0").select(F.col("mim").alias("disease_id"), F.col("phenotype").alias("name")))


@on_views("p30_p32_ids_and_phenotypes", (), """SELECT mim, 'MONDO:' || lpad(mim::VARCHAR, 7, '0') AS mondo, CASE WHEN mim % 2 = 0 THEN 'OMIM:' || mim END AS omim, phenotype AS name, mapping_key, CASE WHEN mim % 3 = 0 THEN inheritance END AS inheritance,
 ['Definitive', 'Strong', 'Moderate', 'Limited'][mapping_key] AS status FROM ph""", PHENO)
def ids(v):
    p = phenotypes(v)
    text = F.concat("phenotype", F.lit(", "), "mim", F.lit(" ("), "mapping_key", F.lit(")"), F.when(F.col("mim") % 3 == 0, F.concat(F.lit(", "), "inheritance")).otherwise(""))
    parts = E.phenotype_parts(text)
    return p.select("mim", E.disease_id(F.concat(F.lit("mondo_"), "mim")).alias("mondo"), E.disease_id(F.concat(F.when(F.col("mim") % 2 == 0, "MIM #").otherwise("x"), F.col("mim"))).alias("omim"), parts["name"].alias("name"), parts["mapping_key"].alias("mapping_key"), parts["inheritance"].alias("inheritance"), E.curation(F.col("mapping_key").cast("string")).alias("status"))


FINDINGS = """
fi AS (SELECT doc_id, trim(regexp_replace(replace(concat(CASE doc_id % 8 WHEN 0 THEN 'Normal count, low memory B cells ' WHEN 1 THEN 'NK cells: absent; monocytes elevated ' WHEN 2 THEN 'T cell response not assessed, low '
  WHEN 3 THEN 'Low to normal' || chr(160) || 'neutrophils/platelets ' WHEN 4 THEN 'Hypogammaglobulinemia, poor proliferation, skin ' WHEN 5 THEN 'Expanded gamma-delta, eosinophils high ' ELSE '' END, coalesce(text, '')), chr(160), ' '), '\\s+', ' ', 'g')) AS t FROM documents)"""


def _wording(table: dict[str, str], other: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(t, '{w}', 'i') THEN '{label}' END" for label, w in table.items())
    return f"CASE WHEN t = '' THEN [] ELSE coalesce(nullif(list_filter([{found}], lambda x: x IS NOT NULL), []), ['{other}']) END"


@on_views("p31_finding_tags", (), f"""SELECT doc_id, array_to_string(CASE WHEN list_contains(tags, 'Not assessed') THEN ['Not assessed'] ELSE tags END, ';') AS tags, array_to_string(cells, ';') AS cells
 FROM (SELECT doc_id, {_wording(E.FINDING_TAGS, 'Descriptive finding')} AS tags, {_wording(E.CELL_GROUPS, 'Other cell or tissue')} AS cells FROM fi)""", FINDINGS)
def tags(v):
    """Findings on documents; a unit test holds the tags of fixed wordings."""
    n = F.col("doc_id") % 8
    lead = F.when(n == 0, "Normal count, low memory B cells ").when(n == 1, "NK cells: absent; monocytes elevated ").when(n == 2, "T cell response not assessed, low ").when(n == 3, "Low to normal\u00a0neutrophils/platelets ")
    lead = lead.when(n == 4, "Hypogammaglobulinemia, poor proliferation, skin ").when(n == 5, "Expanded gamma-delta, eosinophils high ").otherwise("")
    text = F.concat(lead, F.coalesce("text", F.lit("")))
    return fixtures.dealt(v.table("documents")).select("doc_id", F.array_join(E.finding_tags(text), ";").alias("tags"), F.array_join(E.cell_groups(text), ";").alias("cells"))


@on_views("s18_missense_scan", ("fx_sites",), """SELECT chrom, pos, ref, one AS alt, CASE WHEN site_id % 4 = 0 THEN concat(CASE replace(chrom, 'chr', '') WHEN 'M' THEN 'MT' ELSE replace(chrom, 'chr', '') END, ':', pos, ':', ref, ':', one) ELSE 'R' || site_id END || CASE WHEN site_id % 3 = 2 THEN '' WHEN k = 0 THEN ':ALT1' ELSE ':ALT2' END AS record_id,
 CASE site_id % 5 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic' ELSE 'Pathogenic/Likely pathogenic' END AS classification, CASE WHEN site_id % 7 = 0 THEN '' ELSE 'Immune deficiency ' || site_id % 7 END AS disease, CASE WHEN site_id % 7 = 1 THEN '' ELSE 'G' || gene_no || '|H1' END AS genes
 FROM (SELECT *, alt AS one, 0 AS k FROM fx_sites UNION ALL SELECT *, 'TT', 1 FROM fx_sites WHERE site_id % 3 = 1) WHERE site_id % 2 = 0 AND site_id % 5 IN (0, 1, 4)""")
def missense(v):
    """A clinical VCF made from the sites: compound and benign labels, other consequences and symbolic second ALTs stay out."""
    n = F.col("site_id")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Pathogenic", "Likely_pathogenic", "Pathogenic|risk_factor", "Benign", "Pathogenic/Likely_pathogenic")]), (n % 5 + 1).cast("int"))
    info = F.concat_ws(";", F.concat(F.lit("CLNSIG="), label), F.when(n % 2 == 0, "MC=SO:0001583|missense_variant,SO:0001623|5_prime_UTR_variant").otherwise("MC=SO:0001627|intron_variant"), F.when(n % 7 != 0, F.concat(F.lit("CLNDN=Immune_deficiency_"), n % 7)), F.when(n % 7 != 1, F.concat(F.lit("GENEINFO=G"), "gene_no", F.lit(":12|H1:13|"))))
    alts = F.concat("alt", F.when(n % 3 == 0, ",<DEL>").when(n % 3 == 1, ",TT").otherwise(""))
    rows = v.sites.select("chrom", F.col("pos").cast("string").alias("pos"), F.when(n % 4 == 0, ".").otherwise(F.concat(F.lit("R"), n)).alias("id"), "ref", alts.alias("alt"), info.alias("info"))
    return L.missense_scan(rows)


@on_views("p09_alt_evidence", ("fx_sites",), """SELECT site_id, k AS alt_index, CASE site_id % 6 WHEN 0 THEN CASE k WHEN 0 THEN alt || '|A1|x,' || alt || '|A2|y' ELSE '' END WHEN 1 THEN CASE k WHEN 0 THEN 'A1,A2' ELSE '' END WHEN 2 THEN CASE k WHEN 0 THEN 'A1|p' ELSE 'A2|q' END
  WHEN 4 THEN CASE k WHEN 0 THEN alt || '|A1' ELSE 'TTTTTTTTT|A2' END WHEN 5 THEN 'A9' ELSE '' END AS assertions, CASE site_id % 6 WHEN 0 THEN CASE k WHEN 0 THEN '2' ELSE '' END WHEN 1 THEN CASE k WHEN 0 THEN '2' ELSE '' END WHEN 3 THEN '' ELSE '1' END AS n_assertions,
 CASE site_id % 6 WHEN 0 THEN CASE k WHEN 0 THEN alt || '|A1|x&' || alt || '|A2|y' ELSE '' END WHEN 4 THEN CASE k WHEN 0 THEN alt || '|A1' ELSE 'TTTTTTTTT|A2' END ELSE '' END AS records, CASE k WHEN 0 THEN 'yes,no' ELSE '' END AS matched FROM fx_sites, (SELECT 0 AS k UNION ALL SELECT 1) ks""")
def alt_evidence(v):
    """Record-wide lists, slots for each ALT, named and unnamed tokens, for both ALTs of a record."""
    n, alt = F.col("site_id") % 6, F.col("alt")
    raw = F.when(n == 0, F.concat(alt, F.lit("|A1|x,"), alt, F.lit("|A2|y"))).when(n == 1, "A1&A2,.").when(n == 2, "A1|p,A2|q").when(n == 3, ".").when(n == 4, F.concat(alt, F.lit("|A1,TTTTTTTTT|A2"))).otherwise("A9")
    info = F.create_map(F.lit("ClinGen_ERepo"), raw, F.lit("GenIA"), raw, F.lit("ClinVar_path_aa_match"), F.lit("yes%2Cno,."), F.lit("DB"), F.lit("1"))
    rows = v.sites.withColumn("alts", F.array(alt, F.lit("TTTTTTTTT"))).withColumn("info", info).select("site_id", "alts", "info", F.posexplode("alts").alias("alt_index", "one"))
    own = X.prediction_info(F.col("info"), F.col("one"), F.col("alt_index"), F.col("alts"))
    return rows.select("site_id", "alt_index", own["ClinGen_ERepo"].alias("assertions"), own["ClinGen_ERepo_count"].alias("n_assertions"), own["GenIA"].alias("records"), own["ClinVar_path_aa_match"].alias("matched"))

