"""Queries on the readers of text tables: text made from the given tables, as the sources deliver it, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import fields as X
from varloom.functions.scratch import scratch_path
from varloom.operators import reference as K
from varloom.plans.base import on_views
from varloom.sources import tables as S


def written(rows: DataFrame, value: Column, line_sep: str = "\n") -> str:
    """The path of a folder of text files with a line for each row."""
    path = scratch_path(rows.sparkSession, "text")
    rows.select(value.alias("value")).write.option("lineSep", line_sep).text(path)
    return path


def tabbed(*columns) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


@on_views("s06_bed_intervals", ("fx_ccre",), "SELECT chrom, start0, end0, ccre_class, row_index::VARCHAR AS row_index FROM fx_ccre WHERE row_index % 11 > 0 AND row_index % 13 > 0 AND row_index % 17 > 0")
def bed(v):
    """Comments, track lines and empty intervals among the rows."""
    n = F.col("row_index")
    line = tabbed("chrom", "start0", F.when(n % 17 == 0, F.col("start0")).otherwise(F.col("end0")).cast("string"), "ccre_class", "row_index")
    path = written(v.ccre, F.when(n % 11 == 0, F.concat(F.lit("# "), line)).when(n % 13 == 0, F.concat(F.lit("track name="), n)).otherwise(line))
    return S.read_bed(v.ccre.sparkSession, path, ("ccre_class", "row_index"))


@on_views("s08_s23_carrier_table", ("fx_calls",), "SELECT sample_id, site_id::VARCHAR AS site_id, gt, CASE WHEN gq > 50 THEN gq::VARCHAR END AS gq FROM fx_calls WHERE gt <> '0/0'")
def carriers(v):
    path = scratch_path(v.calls.sparkSession, "carriers")
    rows = v.calls.filter("gt <> '0/0'").withColumn("gq", F.when(F.col("gq") > 50, F.col("gq")))
    S.write_tsv(rows, path, ["sample_id", "site_id", "gt", "gq"], partitions=8)
    return S.read_table(v.calls.sparkSession, path, ("sample_id", "gt"))


@on_views("s09_after_preamble", ("fx_ccre",), "SELECT row_index::VARCHAR AS element, ccre_class AS class FROM fx_ccre WHERE row_index % 9 > 0")
def preamble(v):
    """Notes before the header in every file, and rows of another width."""
    n = F.col("row_index")
    notes = v.ccre.filter(n % 50 == 1)
    lines = v.ccre.select(tabbed("row_index", F.when(n % 9 == 0, F.lit("x\ty")).otherwise(F.col("ccre_class"))).alias("value"))
    head = notes.select(F.explode(F.array(F.lit("released as it is"), F.lit("#element\tclass"))).alias("value"))
    return S.read_after_preamble(v.ccre.sparkSession, written(head.union(lines), F.col("value")), "element")


@on_views("s10_gtf_features", ("fx_exons",), "SELECT chrom, 'exon' AS feature, start1, end1, strand, 'T' || tx_id AS transcript, CASE tx_id % 3 WHEN 0 THEN 'basic' END AS tag FROM fx_exons WHERE tx_id % 19 > 0")
def gtf(v):
    n = F.col("tx_id")
    notes = F.concat(F.lit('transcript_id "T'), n, F.lit('"; exon_number '), "exon_no", F.when(n % 3 == 0, '; tag "basic"; tag "late";').otherwise(";"))
    line = tabbed("chrom", F.lit("made"), F.lit("exon"), "start1", "end1", F.lit("."), "strand", F.lit("."), notes)
    rows = S.read_gtf(v.exons.sparkSession, written(v.exons, F.when(n % 19 == 0, F.concat(F.lit("#"), line)).otherwise(line)))
    return rows.select("chrom", "feature", "start1", "end1", "strand", F.col("attributes")["transcript_id"].alias("transcript"), F.col("attributes")["tag"].alias("tag"))


@on_views("s14_gene_constraint", ("fx_sites",), "SELECT 'G' || site_id AS gene, CASE WHEN site_id % 7 > 0 THEN (site_id % 1000)::DOUBLE / 1000 END AS pli, (site_id % 200)::DOUBLE / 100 AS loeuf, CASE WHEN site_id % 5 > 0 THEN (site_id % 40)::DOUBLE - 20 END AS mis_z FROM fx_sites")
def constraint(v):
    n = F.col("site_id")
    rows = v.sites.select(F.concat(F.lit("G"), n).alias("gene"), F.when(n % 7 == 0, "NA").otherwise((n % 1000 / 1000).cast("string")).alias("pli"), (n % 200 / 100).alias("loeuf"), F.when(n % 5 > 0, n % 40 - 20).alias("mis_z"), F.lit("x").alias("other"))
    path = scratch_path(v.sites.sparkSession, "constraint")
    S.write_tsv(rows, path, rows.columns, partitions=4)
    return S.read_constraint(v.sites.sparkSession, path)


def stanzas(v) -> str:
    n = F.col("site_id")
    name = lambda x: F.concat(F.when(x % 6 == 5, "GO:").otherwise("CL:"), x)
    parents = F.when(n > 2, F.concat(F.lit("\nis_a: "), name(F.floor(n / 2)), F.lit(" ! half\nis_a: "), name(F.floor(n / 3)))).otherwise("")
    text = F.concat(F.when(n % 8 == 7, "[Typedef]").otherwise("[Term]"), F.lit("\nid: "), name(n), F.lit("\nname: cell "), n, parents, F.when(n % 10 == 9, "\nis_obsolete: true").otherwise(""))
    return written(v.sites, text, "\n\n")


ACTIVE = "WHERE site_id % 6 <> 5 AND site_id % 8 <> 7 AND site_id % 10 <> 9"


@on_views("s15_ontology_terms", ("fx_sites",), f"SELECT 'CL:' || site_id AS term, 'cell ' || site_id AS name FROM fx_sites {ACTIVE}")
def terms(v):
    return S.read_obo(v.sites.sparkSession, stanzas(v))[0]


@on_views("s15_ontology_edges", ("fx_sites",), f"SELECT 'CL:' || site_id AS term, 'CL:' || p AS parent FROM (SELECT site_id, unnest([site_id // 2, site_id // 3]) AS p FROM fx_sites {ACTIVE} AND site_id > 2) WHERE p % 6 <> 5")
def edges(v):
    return S.read_obo(v.sites.sparkSession, stanzas(v))[1]


def haplotype_lines(v) -> tuple[DataFrame, DataFrame]:
    text = F.to_json(F.struct("sample_id", "site_id", "gt"))
    path = written(v.calls, F.when(F.col("site_id") % 31 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text))
    return S.read_haplotypes(v.calls.sparkSession, path, "sample_id string, site_id long, gt string")


@on_views("s16_haplotype_lines", ("fx_calls",), "SELECT sample_id, site_id, gt FROM fx_calls WHERE site_id % 31 > 0")
def haplotypes(v):
    return haplotype_lines(v)[0]


@on_views("s16_malformed_lines", ("fx_calls",), "SELECT count(*) AS malformed FROM fx_calls WHERE site_id % 31 = 0")
def malformed(v):
    return haplotype_lines(v)[1].agg(F.count("*").alias("malformed"))


@on_views("s17_protein_catalog", ("fx_protein",), "SELECT gene, protein_position, CASE WHEN site_id % 4 > 0 THEN alt_aa END AS alt_aa, CASE WHEN site_id % 4 > 1 THEN transcript END AS transcript, CASE WHEN site_id % 4 > 2 THEN 'R' || site_id END AS record_id FROM fx_protein")
def catalog(v):
    """Two to five columns, as older and newer catalogs have them."""
    n = F.col("site_id") % 4
    line = tabbed("gene", "protein_position", F.when(n > 0, F.col("alt_aa")), F.when(n > 1, F.col("transcript")), F.when(n > 2, F.concat(F.lit("R"), "site_id")))
    return S.read_protein_catalog(v.protein.sparkSession, written(v.protein, line))


@on_views("p10_percent_decoding", ("fx_annotations",), "SELECT site_id, k, CASE site_id % 3 WHEN 0 THEN gene || ';' || impact || '+1' WHEN 1 THEN gene || '=50%' ELSE gene || '+' || impact END AS text FROM fx_annotations")
def decoded(v):
    n = F.col("site_id") % 3
    raw = F.when(n == 0, F.concat("gene", F.lit("%3B"), "impact", F.lit("+1"))).when(n == 1, F.concat("gene", F.lit("%3D50%25"))).otherwise(F.concat("gene", F.lit("+"), "impact"))
    return v.annotations.select("site_id", "k", X.percent_decoded(raw).alias("text"))


@on_views("p14_subpopulations", ("fx_sites",), "SELECT site_id, 'gnomADe_AFR_AF' AS population, '0.' || site_id AS frequency FROM fx_sites UNION ALL SELECT site_id, 'gnomADg_NFE_AF', '1e-' || (site_id % 9) FROM fx_sites WHERE site_id % 2 = 0")
def subpopulations(v):
    n = F.col("site_id")
    info = F.concat(F.lit("AF=1;gnomADe_AFR_AF=0."), n, F.lit(";gnomAD_popmax_AF=1"), F.when(n % 2 == 0, F.concat(F.lit(";gnomADg_NFE_AF=1e-"), n % 9)).otherwise(";DB"))
    return v.sites.select("site_id", F.explode(X.subpopulation_frequencies(X.info_map(info))).alias("population", "frequency"))


SIZE = 64
BASE = "substr('ACGTTGCAGT', 1 + ({p}) * ({p}) % 97 % 10, 1)"
SPAN = "array_to_string([{b} FOR q IN range({a}, {z} + 1)], '')"


def span(a: str, z: str) -> str:
    return SPAN.format(b=BASE.format(p="q"), a=a, z=z)


@on_views("p28_hgvs_alleles", ("fx_sites",), f"""SELECT site_id, CASE WHEN kind IN (1, 4, 5) THEN pos - 1 ELSE pos END AS pos,
 CASE kind WHEN 0 THEN b WHEN 1 THEN before || deleted WHEN 2 THEN b WHEN 3 THEN NULL WHEN 4 THEN before WHEN 5 THEN before || deleted END AS ref,
 CASE kind WHEN 0 THEN 'A' WHEN 1 THEN before WHEN 2 THEN b || 'TT' WHEN 3 THEN NULL WHEN 4 THEN before || deleted WHEN 5 THEN before || 'GG' END AS alt FROM (SELECT site_id, CASE WHEN site_id % 7 = 3 THEN NULL ELSE pos END AS pos, site_id % 7 AS kind, {BASE.format(p='pos')} AS b, {BASE.format(p='pos - 1')} AS before, {span('pos', 'pos + site_id % 5')} AS deleted FROM fx_sites) WHERE kind < 6""")
def hgvs(v):
    """Substitutions, deletions, insertions, unknown text, duplications and replacements, over chunk ends too."""
    n, p = F.col("site_id"), F.col("pos").cast("string")
    kind, last = n % 7, (F.col("pos") + n % 5).cast("string")
    base = lambda x: F.substring(F.lit("ACGTTGCAGT"), (x * x % 97 % 10 + 1).cast("int"), F.lit(1))
    text = (
        F.when(kind == 0, F.concat(F.lit("g."), p, base(F.col("pos")), F.lit(">A"))).when(kind == 1, F.concat(F.lit("g."), p, F.lit("_"), last, F.lit("del"))).when(kind == 2, F.concat(F.lit("g."), p, F.lit("_"), (F.col("pos") + 1).cast("string"), F.lit("insTT")))
        .when(kind == 3, F.lit("g.(1_2)del")).when(kind == 4, F.concat(F.lit("g."), p, F.lit("_"), last, F.lit("dup"))).when(kind == 5, F.concat(F.lit("g."), p, F.lit("_"), last, F.lit("delinsGG")))
    )
    rows = v.sites.filter(kind < 6).select("site_id", "chrom", text.alias("hgvs"))
    numbers = v.sites.select("chrom", F.explode(F.sequence(F.floor((F.col("pos") - 1) / SIZE) - 1, F.floor((F.col("pos") - 1) / SIZE) + 1)).alias("chunk")).distinct()
    bases = F.array_join(F.transform(F.sequence(F.col("chunk") * SIZE + 1, (F.col("chunk") + 1) * SIZE), base), "")
    return K.hgvs_alleles(rows, numbers.select("chrom", "chunk", bases.alias("sequence")), SIZE).select("site_id", "pos", "ref", "alt")
