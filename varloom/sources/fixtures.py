"""Review tables derived from the given tables, by SQL that Spark and DuckDB both take.

The given tables hold orders, parts and customers. Each view here reads them and shapes their rows as the engine's
inputs: sites, calls, annotations, intervals, pedigrees and so on, as large as the tables are. Later views use earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("part", "customer", "orders", "lineitem", "nation", "documents")
VIEWS: dict[str, str] = {
    # Allele sites; mixed contig spelling, padded SNVs, deletions, insertions, in-frame deletions, X both in and out of the pseudoautosomal region.
    "fx_sites": """
SELECT site_id, chrom, pos, ref, alt, gene_no FROM (
 SELECT p_partkey AS site_id,
  CASE p_partkey % 5 WHEN 0 THEN 'chr1' WHEN 1 THEN '2' WHEN 2 THEN '7' WHEN 3 THEN 'chrX' ELSE 'M' END AS chrom,
  1000 + (p_partkey * 7919) % 400000 + CASE WHEN p_partkey % 5 = 3 AND p_partkey % 2 = 1 THEN 3000000 ELSE 0 END AS pos,
  CASE p_partkey % 6 WHEN 0 THEN concat('A', b1, 'T') WHEN 1 THEN concat(b1, 'AC') WHEN 3 THEN concat(b1, 'ACG') ELSE b1 END AS ref,
  CASE p_partkey % 6 WHEN 0 THEN concat('A', b2, 'T') WHEN 1 THEN b1 WHEN 2 THEN concat(b1, 'GT') WHEN 3 THEN b1 ELSE b2 END AS alt,
  p_partkey % 23 AS gene_no
 FROM (SELECT p_partkey, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS b1,
        substr('ACGT', CAST(1 + (p_partkey % 4 + 1 + p_partkey % 3) % 4 AS INT), 1) AS b2 FROM part) x) y
""",
    # One genotype per (sample, site), a sample for each customer; phased, half-called and reference calls, three FILTER values.
    "fx_calls": """
SELECT sample_id, site_id, gt, dp, gq, ad_alt, filter FROM (
 SELECT concat('S', CAST(o_custkey AS INT)) AS sample_id, l_partkey AS site_id,
  CASE (l_orderkey + l_linenumber) % 8 WHEN 3 THEN '1/1' WHEN 4 THEN '0|1' WHEN 5 THEN '1|0' WHEN 6 THEN './1' WHEN 7 THEN '0/0' ELSE '0/1' END AS gt,
  CAST(FLOOR(l_quantity) AS INT) AS dp, CAST(FLOOR(l_extendedprice) AS BIGINT) % 100 AS gq,
  CAST(FLOOR(l_quantity * (l_discount * 10)) AS INT) AS ad_alt,
  CASE l_returnflag WHEN 'N' THEN 'PASS' WHEN 'A' THEN '.' ELSE 'LowQual' END AS filter,
  ROW_NUMBER() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS rn
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t WHERE rn = 1
""",
    # Three transcripts per site over 23 genes; NULL frequencies and scores; some site-genes without MANE.
    "fx_annotations": """
SELECT site_id, k, concat('G', CAST((gene_no + CASE WHEN k = 2 THEN 1 ELSE 0 END) % 23 AS INT)) AS gene,
 concat('ENST', CAST(100000 + site_id * 3 + k AS BIGINT), '.', CAST(1 + k AS INT)) AS transcript,
 CASE (site_id + k) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END AS impact,
 CASE (site_id + k) % 4 WHEN 0 THEN 'frameshift_variant' WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'synonymous_variant' ELSE 'intron_variant' END AS consequence,
 CASE WHEN site_id % 7 = 0 THEN NULL ELSE (site_id * 37 % 1000) / 20000.0 END AS popmax,
 CASE WHEN (site_id + k) % 4 = 1 THEN (site_id * 13 % 100) / 100.0 END AS alpha_missense,
 CASE WHEN k = 0 AND site_id % 3 <> 0 THEN 1 ELSE 0 END AS mane, CASE WHEN k = 1 THEN 1 ELSE 0 END AS picked
FROM fx_sites CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks
""",
    # 0-based half-open intervals, overlapping, with a class.
    "fx_ccre": """
SELECT c_custkey AS row_index, CASE c_custkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '7' WHEN 3 THEN 'X' ELSE 'MT' END AS chrom,
 (c_custkey * 104729) % 400000 AS start0, (c_custkey * 104729) % 400000 + 200 + (c_custkey % 7) * 400 AS end0,
 c_mktsegment AS ccre_class FROM customer
""",
    # Families of three customers: proband, mother, father, sex of the proband.
    "fx_trios": """
SELECT concat('F', CAST(FLOOR(c_custkey / 3.0) AS INT)) AS family_id, concat('S', CAST(c_custkey AS INT)) AS proband, concat('S', CAST(c_custkey + 1 AS INT)) AS mother,
 concat('S', CAST(c_custkey + 2 AS INT)) AS father, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS proband_sex
FROM customer WHERE c_custkey % 3 = 0
""",
    # Protein change of the missense rows.
    "fx_protein": """
SELECT site_id, k, gene, transcript, CAST(1 + (site_id % 97) * 3 AS INT) AS protein_position,
 substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + site_id % 20 AS INT), 1) AS ref_aa,
 substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + (site_id + 1 + site_id % 7) % 20 AS INT), 1) AS alt_aa
FROM fx_annotations WHERE consequence = 'missense_variant'
""",
    # Clinical missense catalog; a quarter of the rows carry the identical allele (must be excluded), one class is a compound label (must not count as pathogenic).
    "fx_catalog": """
SELECT gene, split_part(transcript, '.', 1) AS transcript_base, protein_position,
 ref_aa, CASE WHEN site_id % 2 = 0 THEN alt_aa ELSE 'X' END AS alt_aa,
 concat('R', CAST(site_id AS BIGINT)) AS record_id,
 CASE WHEN site_id % 4 = 0 THEN site_id ELSE site_id + 1000000 END AS source_site_id,
 CASE site_id % 3 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' ELSE 'Pathogenic|risk_factor' END AS classification
FROM fx_protein WHERE site_id % 5 <> 0
""",
    # Score rows by site and transcript: exact, missing transcript (partial), double rows (ambiguous).
    "fx_scores": """
SELECT site_id, transcript_base, score, copy_no FROM (
 SELECT site_id, CASE WHEN site_id % 5 = 4 THEN 'ENST0' ELSE split_part(transcript, '.', 1) END AS transcript_base,
  CAST((site_id * 31 + k) % 100 AS INT) AS score, c.copy_no
 FROM fx_annotations CROSS JOIN (SELECT 0 AS copy_no UNION ALL SELECT 1) c
 WHERE k < 2 AND site_id % 3 <> 1 AND (c.copy_no = 0 OR site_id % 11 = 0)) t
""",
    # Interval × biosample class codes 0–8.
    "fx_codes": """
SELECT row_index, sample_index, CASE WHEN (row_index * 7 + sample_index * 13) % 5 < 3 THEN 0 ELSE CAST(1 + (row_index + sample_index) % 8 AS INT) END AS code
FROM fx_ccre CROSS JOIN (SELECT n_nationkey AS sample_index FROM nation) s
""",
    # Biosample dimension with shared donors.
    "fx_profiles": """
SELECT n_nationkey AS sample_index, concat('CL:', CAST(n_nationkey % 4 AS INT)) AS ontology_id, concat('D', CAST(n_nationkey % 5 AS INT)) AS donor,
 CASE n_nationkey % 3 WHEN 0 THEN 'full_classification' WHEN 1 THEN 'partial_classification' ELSE 'accessibility_only' END AS evidence_tier
FROM nation
""",
    # Ontology edges (a tree).
    "fx_edges": """
SELECT n_nationkey AS term, CAST(FLOOR((n_nationkey - 1) / 2.0) AS INT) AS parent FROM nation WHERE n_nationkey > 0
""",
    # 1–4 exons per transcript, both strands, 1-based closed.
    "fx_exons": """
SELECT p_partkey AS tx_id, CASE p_partkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '7' WHEN 3 THEN 'X' ELSE 'MT' END AS chrom,
 CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, e AS exon_no,
 (p_partkey * 7919) % 400000 + e * 500 + 1 AS start1, (p_partkey * 7919) % 400000 + e * 500 + 120 + p_partkey % 30 AS end1
FROM part CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) es WHERE e <= p_partkey % 4
""",
    # A transcript for each part on a contig of its own: 1-4 exons of x bases, introns of 20, 12 bases before the start codon; some with a stop within or none at the end.
    "fx_coding": """
SELECT n, strand, exons, x, cds, cdna, CASE WHEN strand = '+' THEN plus ELSE reverse(translate(plus, 'ACGT', 'TGCA')) END AS contig FROM (
 SELECT *, concat(substr(cdna, 1, x), CASE WHEN exons > 1 THEN concat(gap, substr(cdna, x + 1, x)) ELSE '' END,
   CASE WHEN exons > 2 THEN concat(gap, substr(cdna, 2 * x + 1, x)) ELSE '' END, CASE WHEN exons > 3 THEN concat(gap, substr(cdna, 3 * x + 1, x)) ELSE '' END) AS plus FROM (
  SELECT *, 'TTTTTTTTTTGGGGGGGGGG' AS gap, CAST(FLOOR((length(cdna) + exons - 1) / CAST(exons AS DOUBLE)) AS INT) AS x FROM (
   SELECT *, concat('CCATCCATCCGG', cds, substr(repeat('GATTCATAACCTGA', 6), 1, CAST(30 + n % 40 AS INT))) AS cdna FROM (
    SELECT p_partkey AS n, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(1 + p_partkey % 4 AS INT) AS exons,
     concat('ATG', substr(repeat('GCACTGACCGATCCTGGCAAATTCCAT', 9), CAST(1 + 3 * (p_partkey % 9) AS INT), 15), CASE WHEN p_partkey % 37 = 9 OR p_partkey % 41 = 10 THEN 'TGA' ELSE '' END,
      substr(repeat('GCACTGACCGATCCTGGCAAATTCCAT', 9), CAST(1 + 3 * (p_partkey % 7) AS INT), CAST(3 * (30 + p_partkey % 20) AS INT)), CASE p_partkey % 13 WHEN 7 THEN 'GCA' ELSE 'TAA' END) AS cds FROM part) a) b) c) d
""",
    # One edit of each transcript at place a of its coding sequence, as the genome has it: insertions of one or two bases, deletions of one; some that must be refused.
    "fx_edits": """
SELECT n, a, kind, concat(CASE WHEN n % 31 = 0 THEN 'N' ELSE 'M' END, CAST(n AS BIGINT), CASE n % 23 WHEN 5 THEN '.7' WHEN 6 THEN '' ELSE '.3' END) AS tx_id, pos,
 CASE WHEN n % 11 = 8 AND kind < 2 THEN 'N' ELSE substr(contig, pos, CASE kind WHEN 2 THEN 2 ELSE 1 END) END AS ref,
 CASE WHEN n % 29 = 6 THEN '<DEL>' ELSE concat(substr(contig, pos, 1), CASE kind WHEN 0 THEN 'G' WHEN 1 THEN 'GT' ELSE '' END) END AS alt,
 CASE WHEN n % 19 = 4 THEN 'frameshift_variant&start_lost' ELSE 'frameshift_variant' END AS consequence FROM (
 SELECT *, CAST(CASE WHEN strand = '+' THEN g + 1 ELSE length(contig) - g - CASE kind WHEN 2 THEN 1 ELSE 0 END END AS INT) AS pos FROM (
  SELECT *, 12 + a + 20 * CAST(FLOOR((12 + a) / CAST(x AS DOUBLE)) AS INT) AS g FROM (
   SELECT *, CAST(1 + (n * 5) % (length(cds) - 5) AS INT) AS a, CAST(FLOOR(n / 4.0) AS INT) % 3 AS kind FROM fx_coding) p) q) r
""",
    # Approved symbols plus previous symbols, some ambiguous.
    "fx_aliases": """
SELECT concat('G', CAST(g AS INT)) AS alias, g AS hgnc_id, 'approved' AS kind FROM (SELECT DISTINCT gene_no AS g FROM fx_sites) a
UNION ALL SELECT concat('OLD', CAST(g % 15 AS INT)), g, 'previous' FROM (SELECT DISTINCT gene_no AS g FROM fx_sites) b
""",
    # Sample → file, assay scope, import profile.
    "fx_files": """
SELECT sample_id, CAST(CAST(substr(sample_id, 2) AS INT) % 6 AS INT) AS file_id,
 CASE WHEN CAST(substr(sample_id, 2) AS INT) % 6 < 4 THEN 'exome' ELSE 'whole_genome' END AS analysis_scope,
 CASE WHEN CAST(substr(sample_id, 2) AS INT) % 6 < 3 THEN 'full' ELSE 'prefiltered' END AS import_profile
FROM (SELECT DISTINCT sample_id FROM fx_calls) s
""",
    # Individual ↔ sample, sex with blanks, ages with and without unit.
    "fx_individuals": """
SELECT concat('P', CAST(c_custkey AS INT)) AS individual_id, concat('S', CAST(c_custkey AS INT)) AS sample_id,
 CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE '' END AS sex_at_birth,
 CASE WHEN c_custkey % 4 = 0 THEN concat(CAST(c_custkey AS INT), ' months') ELSE CAST(c_custkey % 140 AS VARCHAR(10)) END AS age_at_onset
FROM customer
""",
}


def needs(*names: str) -> list[str]:
    """The views named and those that they use, in order."""
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= {other for other in VIEWS if other != name and other in VIEWS[name]}
    return [v for v in VIEWS if v in wanted]


#: Views that `store` has written: (sf_dir, name) -> path.
_stored: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str, names: list[str], path: str) -> None:
    """Write views as tables under path, from which `load` reads them from then on."""
    for name in names:
        load(spark, sf_dir, name).write.mode("overwrite").parquet(f"{path}/{name}")
        _stored[sf_dir, name] = f"{path}/{name}"


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt to all cores where its files make fewer tasks, as a small file may hold many rows and the work on each may be long."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables in sf_dir, as one lazy query: Spark reads just the columns that it uses."""
    if (sf_dir, name) in _stored:
        return spark.read.parquet(_stored[sf_dir, name])
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needs(name))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if any(t in VIEWS[v] for v in needs(name))}
    tables |= {t: dealt(tables[t]) for t in ("part", "customer") if t in tables}
    # the tables take part under their names, without being registered in the session
    query = f"WITH {ctes} SELECT * FROM {name}"
    for t in tables:
        query = _renamed(query, t)
    return spark.sql(query, **{f"t_{t}": df for t, df in tables.items()})


def _renamed(query: str, table: str) -> str:
    """Table names after FROM and JOIN become parameters."""
    for word in ("FROM", "JOIN"):
        for end in (" ", ")", "\n"):
            query = query.replace(f"{word} {table}{end}", f"{word} {{t_{table}}}{end}")
    return query


def ctes(*names: str) -> str:
    """`WITH ...` of the views for DuckDB, without the word and without an end."""
    return ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in needs(*names))
