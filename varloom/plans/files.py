"""Queries that go through files: VCF text made from the fixture's calls, and streaming intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.scratch import scratch_path
from varloom.operators import cohort as H
from varloom.plans.base import KEYED, Views, on_views, oracle, query
from varloom.sources import headers as HD
from varloom.sources import phenotypes as PH
from varloom.sources import vcf as V
from varloom.streaming import intake as T

BLOCK = 32  # samples in a line: a site has a line for each block of samples that has a call there, and its id names both
SAMPLES = tuple(f"C{i}" for i in range(BLOCK))
FIELDS = ("Allele", "Consequence", "SYMBOL", "ALLELE_NUM")


def site_of() -> Column:
    return F.substring_index("id", "_", 1).cast("long")


def block_of() -> Column:
    return F.substring_index("id", "_", -1).cast("long")


def vcf_lines(v: Views) -> DataFrame:
    """Lines of all calls: a second ALT G on every third site, consequences by number or by allele.

    Calls are dealt once, by site, which serves both the lines and the sites that they meet. A line's call or two are put between runs of uncalled cells.
    """
    number = F.substring("sample_id", 2, 12).cast("long")
    text = F.concat_ws(":", "gt", F.col("dp").cast("string"), F.col("gq").cast("string"))
    calls = v.calls.select("site_id", F.floor(number / BLOCK).alias("block"), (number % BLOCK).cast("int").alias("place"), text.alias("text")).repartition("site_id")
    calls = calls.groupBy("site_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("calls"))
    uncalled = lambda n: F.repeat(F.lit("\t./."), n)
    put = lambda done, c: F.struct((c["place"] + 1).alias("n"), F.concat(done["text"], uncalled(c["place"] - done["n"]), F.lit("\t"), c["text"]).alias("text"))
    cells = F.aggregate("calls", F.struct(F.lit(0).alias("n"), F.lit("").alias("text")), put, lambda done: F.concat(done["text"], uncalled(BLOCK - done["n"])))
    n = F.col("site_id")
    entry = F.transform(F.col("genes"), lambda g: F.concat_ws("|", F.col("alt"), F.lit("missense%20variant"), g, F.when(n % 2 == 0, "1").otherwise("")))
    genes = v.annotations.groupBy("site_id").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    alts = F.when(n % 3 == 0, F.concat("alt", F.lit(",TTTTTTTTT"))).otherwise(F.col("alt"))
    # made once a site, before its lines are met
    place = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), n.cast("string"))
    rest = F.concat_ws("\t", "ref", alts, F.lit("."), F.when(n % 5 == 0, "LowQual").otherwise("PASS"), F.concat(F.lit("DB;CSQ="), F.array_join(entry, ",")), F.lit("GT:DP:GQ"))
    sites = v.sites.join(genes, "site_id").select("site_id", place.alias("place"), rest.alias("rest"))
    return sites.join(calls, "site_id").select(F.concat("place", F.lit("_"), F.col("block").cast("string"), F.lit("\t"), "rest", cells).alias("value"))


def lines_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines written as text and read again. The files are compressed, as most of a line are uncalled cells."""
    path = scratch_path(spark, "vcf")
    vcf_lines(Views(spark, sf_dir)).write.text(path, compression="gzip")
    return V.read_lines(spark, path)


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines written as text and read again as ALT rows."""
    return V.alleles(V.records(lines_written(spark, sf_dir)))


VCF = f"""
bl AS (SELECT *, n // {BLOCK} AS block, n % {BLOCK} AS place FROM (SELECT *, substr(sample_id, 2)::BIGINT AS n FROM fx_calls)),
st AS (SELECT k.*, block FROM keyed k JOIN (SELECT DISTINCT site_id, block FROM bl) USING (site_id))"""


@query("s01_p06_vcf_alleles", oracle(("fx_sites", "fx_calls"), "SELECT site_id, block, 0 AS alt_index, variant_key FROM st WHERE TRUE UNION ALL SELECT site_id, block, 1, NULL FROM st WHERE site_id % 3 = 0", KEYED, VCF))
def alleles(spark, sf_dir):
    rows = read_back(spark, sf_dir)
    return rows.select(site_of().alias("site_id"), block_of().alias("block"), "alt_index", F.when(F.col("alt_index") == 0, F.col("variant_key")).alias("variant_key"))


@query("s01_p15_vcf_genotypes", oracle(("fx_sites", "fx_calls"), "SELECT variant_key, sample_id, gt, CASE WHEN gt = '1/1' THEN 'homozygous' WHEN gt = './1' THEN 'half_called' ELSE 'heterozygous' END AS zygosity, dp, gq::DOUBLE AS gq FROM bl JOIN keyed USING (site_id) WHERE gt <> '0/0'", KEYED, VCF))
def genotypes(spark, sf_dir):
    rows = V.genotypes(read_back(spark, sf_dir), SAMPLES, keep=("id",))
    sample = F.concat(F.lit("S"), (block_of() * BLOCK + F.substring("sample_id", 2, 3).cast("long")).cast("string"))
    return rows.select("variant_key", sample.alias("sample_id"), "gt", "zygosity", "dp", "gq")


@query("s05_p08_vcf_consequences", oracle(("fx_sites", "fx_calls", "fx_annotations"), "SELECT variant_key, block, gene, 'missense variant' AS consequence FROM st JOIN (SELECT DISTINCT site_id, gene FROM fx_annotations) USING (site_id)", KEYED, VCF))
def consequences(spark, sf_dir):
    rows = V.consequences(read_back(spark, sf_dir), FIELDS)
    return rows.select("variant_key", block_of().alias("block"), F.col("entry")["SYMBOL"].alias("gene"), F.col("entry")["Consequence"].alias("consequence"))


@query("s26_sample_projection", oracle(("fx_sites", "fx_calls"), "SELECT site_id, block, coalesce(a.gt, './.') AS first_gt, coalesce(b.gt, './.') AS second_gt FROM st LEFT JOIN (SELECT site_id, block, gt FROM bl WHERE place = 1) a USING (site_id, block) LEFT JOIN (SELECT site_id, block, gt FROM bl WHERE place = 4) b USING (site_id, block) WHERE site_id % 5 <> 0 AND (contains(coalesce(a.gt, ''), '1') OR contains(coalesce(b.gt, ''), '1'))", KEYED, VCF))
def projection(spark, sf_dir):
    """Two samples of each block: what a projection is for."""
    rows, _ = V.projection(V.records(lines_written(spark, sf_dir)), SAMPLES, ("C1", "C4"))
    return rows.select(site_of().alias("site_id"), block_of().alias("block"), F.substring_index(F.col("samples")[0], ":", 1).alias("first_gt"), F.substring_index(F.col("samples")[1], ":", 1).alias("second_gt"))


@query("s24_info_write_back", oracle(("fx_sites", "fx_calls"), "SELECT site_id, block, 'NEW=' || (site_id % 9)::VARCHAR || CASE WHEN site_id % 3 = 0 THEN ',.' ELSE '' END AS info FROM st", KEYED, VCF))
def write_back(spark, sf_dir):
    rows = V.records(lines_written(spark, sf_dir))
    n = F.size(F.split("alt", ","))
    out = V.with_info(rows, "NEW", F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, (site_of() % 9).cast("string"))))
    return V.records(V.to_lines(out)).select(site_of().alias("site_id"), block_of().alias("block"), F.element_at(F.split("info", ";"), -1).alias("info"))


@query("t01_t02_streamed_calls", oracle(("fx_calls",), "SELECT sample_id, site_id, gt, dp, gq, filter FROM fx_calls WHERE site_id % 97 <> 0"))
def streamed(spark, sf_dir):
    """Calls as text in files for all cores, taken in by a stream of four batches; lines with a bad genotype are set aside."""
    calls = Views(spark, sf_dir).calls
    source, target, bad, checkpoint = (scratch_path(spark, f"intake-{k}") for k in ("source", "target", "bad", "checkpoint"))
    gt, files = F.when(F.col("site_id") % 97 == 0, "broken").otherwise(F.col("gt")), 4 * spark.sparkContext.defaultParallelism
    calls.select(F.concat_ws("\t", "sample_id", "site_id", gt, "dp", "gq", "ad_alt", "filter").alias("value")).repartition(files, "sample_id").write.text(source)
    T.start(spark, source, target, bad, checkpoint, files_per_batch=files // 4, fold_every=3).awaitTermination()
    return T.DeltaTable(spark, target).read().select("sample_id", "site_id", "gt", "dp", "gq", "filter")


@query("t03_intake_counters", oracle(("fx_calls",), "SELECT count(*) AS records, count(*) FILTER (WHERE filter IN ('PASS', '.') AND site_id % 97 <> 0) AS passing, count(*) FILTER (WHERE site_id % 97 = 0) AS quarantined FROM fx_calls"))
def intake_counters(spark, sf_dir):
    """The counters that a stream stores with its two batches, added up."""
    calls = Views(spark, sf_dir).calls
    source, target, bad, checkpoint = (scratch_path(spark, f"counted-{k}") for k in ("source", "target", "bad", "checkpoint"))
    gt, files = F.when(F.col("site_id") % 97 == 0, "broken").otherwise(F.col("gt")), 4 * spark.sparkContext.defaultParallelism
    calls.select(F.concat_ws("\t", "sample_id", "site_id", gt, "dp", "gq", "ad_alt", "filter").alias("value")).repartition(files, "sample_id").write.text(source)
    T.start(spark, source, target, bad, checkpoint, files_per_batch=files // 2).awaitTermination()
    return T.counters(spark, target).agg(*[F.sum(c).alias(c) for c in ("records", "passing", "quarantined")])


@query("t03_scan_counters", oracle(("fx_calls",), "SELECT count(*) AS records, count(*) FILTER (WHERE filter IN ('PASS', '.') AND gq >= 20) AS passing, count(*) FILTER (WHERE gq < 20) AS quarantined FROM fx_calls"))
def scan_counters(spark, sf_dir):
    """The counters of one scan of all calls, of which those of low quality count as set aside."""
    got = T.scan_counters(Views(spark, sf_dir).calls, F.col("gq") >= 20)
    return spark.createDataFrame([tuple(got[c] for c in ("records", "passing", "quarantined"))], "records long, passing long, quarantined long")


def header_files(spark: SparkSession, sf_dir: str) -> HD.Headers:
    """A file for each import file, with its samples in order: two orders of consequence fields, a Number and a contig length that differ, and one header of 30,000 lines more."""
    v, path = Views(spark, sf_dir), scratch_path(spark, "headers")
    names = v.files.groupBy("file_id").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))
    f = F.col("file_id")
    csq = F.when(f % 2 == 0, "Allele|Consequence|SYMBOL").otherwise("SYMBOL|Allele|Consequence|Extra")
    first = [
        F.lit("##fileformat=VCFv4.2"), F.concat(F.lit("##INFO=<ID=AC,Number="), F.when(f == 4, "1").otherwise("A"), F.lit(',Type=Integer,Description="x">')),
        F.concat(F.lit("##contig=<ID=chr1,length="), (248956422 + (f == 5).cast("int")).cast("string"), F.lit(">")),
        F.concat(F.lit('##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequences. Format: '), csq, F.lit('">')),
    ]
    more = F.when(f == 1, F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("##contig=<ID=part"), i.cast("string"), F.lit(">")))).otherwise(F.array().cast("array<string>"))
    last = F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.array_join("samples", "\t"))
    lines = F.concat(F.array(*first), more, F.array(last), F.array(F.lit("1\t5\t.\tA\tC\t.\tPASS\tDB\tGT"), F.lit("#no header")))
    rows = names.select(F.col("file_id").alias("file"), F.posexplode(lines).alias("n", "value"))
    rows.repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(path)
    return HD.read_headers(spark, path)


def file_no() -> Column:
    return F.regexp_extract("file", r"file=(\d+)", 1).cast("int")


@query("s02_header_samples", oracle(("fx_files",), "SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY sample_id) - 1)::INTEGER AS ordinal, sample_id AS sample FROM fx_files"))
def header_samples(spark, sf_dir):
    return header_files(spark, sf_dir).samples().select(file_no().alias("file_id"), "ordinal", "sample")


@query("s02_header_conflicts", oracle(("fx_files",), """SELECT kind, name, variants FROM (VALUES ('info_number', 'AC', '1,A', 4), ('contig_length', 'chr1', '248956422,248956423', 5)) t(kind, name, variants, f) WHERE f IN (SELECT file_id FROM fx_files)"""))
def header_conflicts(spark, sf_dir):
    return header_files(spark, sf_dir).conflicts()


@query("s03_csq_by_file", oracle(("fx_files",), "SELECT DISTINCT file_id, CASE WHEN file_id % 2 = 0 THEN 'Allele,Consequence,SYMBOL' ELSE 'SYMBOL,Allele,Consequence,Extra' END AS csq, CASE WHEN file_id % 2 = 0 THEN 'G1' ELSE 'G2 x' END AS symbol FROM fx_files"))
def csq_by_file(spark, sf_dir):
    """The same kind of entry in each file, read by the file's own order of fields."""
    heads = header_files(spark, sf_dir)
    rows = heads.csq().select("file", F.when(F.size("csq") == 3, "A|missense|G1").otherwise("G2%20x|A").alias("csq"))
    symbols = HD.entries_by_file(rows, heads).select("file", F.col("entries")[0]["SYMBOL"].alias("symbol"))
    return heads.csq().join(symbols, "file").select(file_no().alias("file_id"), F.array_join("csq", ",").alias("csq"), "symbol")


def phenotype_files(spark: SparkSession, sf_dir: str) -> PH.PhenotypeTable:
    """Tables of a thousand individuals each: a title, a header with a repeated and an empty name, quoted cells with separators, quotes and line ends, blank rows, short rows."""
    path, n = scratch_path(spark, "phenotypes"), F.col("c_custkey")
    v = Views(spark, sf_dir)
    rows = v.individuals.withColumn("c_custkey", F.substring("individual_id", 2, 12).cast("long"))
    quoted = F.concat(F.lit('"fever, "'), F.lit('"high""'), F.when(n % 5 == 0, F.lit("\nand more")).otherwise(""), F.lit('"'))
    cells = F.concat_ws(",", F.concat(F.lit(" P"), F.floor(n / 2).cast("string")), "sample_id", "sex_at_birth", quoted, F.when(n % 3 != 0, F.concat(F.lit("note"), n.cast("string"))).otherwise(""), F.lit("second"), F.lit("left over"))
    line = F.concat(F.when(n % 7 == 3, "P_short,S_short").otherwise(cells), F.when(n % 4 == 1, "\n,,,,,,").otherwise(""))
    text = rows.select(F.floor(n / 1000).alias("file"), n.alias("n"), line.alias("value"))
    head = text.select("file").distinct().select("file", F.lit(-1).cast("long").alias("n"), F.lit("Report,,\n\ufeffSubject ID,VCF Sample,Sex,Present Features,Comments,Comments,,Extra A,Extra B").alias("value"))
    head.unionByName(text).repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(path)
    return PH.read_phenotypes(spark, path)


PHENOTYPES = """
ph AS (SELECT FLOOR(n / 1000)::INTEGER AS file_no, row_number() OVER (PARTITION BY FLOOR(n / 1000) ORDER BY n)::INTEGER AS row_no, CASE WHEN n % 7 = 3 THEN 'P_short' ELSE 'P' || FLOOR(n / 2)::BIGINT END AS individual_id,
  CASE WHEN n % 7 = 3 THEN 'S_short' ELSE sample_id END AS sample_ids, CASE WHEN n % 7 <> 3 THEN nullif(sex_at_birth, '') END AS sex_at_birth,
  CASE WHEN n % 7 <> 3 THEN 'fever, "high"' || CASE WHEN n % 5 = 0 THEN chr(10) || 'and more' ELSE '' END END AS present_features,
  CASE WHEN n % 7 <> 3 AND n % 3 <> 0 THEN 'note' || n END AS notes, CASE WHEN n % 7 = 3 THEN '' ELSE 'Column 7=left over;Comments (2)=second' END AS custom
  FROM (SELECT *, substr(individual_id, 2)::BIGINT AS n FROM fx_individuals))"""


@query("s12_phenotype_rows", oracle(("fx_individuals",), "SELECT * FROM ph", PHENOTYPES))
def phenotype_rows(spark, sf_dir):
    rows = phenotype_files(spark, sf_dir).rows
    custom = F.array_join(F.array_sort(F.transform(F.map_entries("custom"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return rows.select(file_no().alias("file_no"), "row_no", "individual_id", "sample_ids", "sex_at_birth", "present_features", "notes", custom.alias("custom"))


@query("s12_phenotype_duplicates", oracle(("fx_individuals",), "SELECT file_no, individual_id, string_agg(row_no::VARCHAR, ',' ORDER BY row_no) AS row_nos FROM ph GROUP BY ALL HAVING count(*) > 1", PHENOTYPES))
def phenotype_duplicates(spark, sf_dir):
    return phenotype_files(spark, sf_dir).duplicates().select(file_no().alias("file_no"), "individual_id", F.array_join(F.col("row_nos").cast("array<string>"), ",").alias("row_nos"))


@on_views("s22_s25_published_tables", ("fx_sites", "fx_calls"), "SELECT chrom, count(*) AS sites FROM keyed GROUP BY chrom", KEYED)
def published(v):
    from varloom.sources.tables import publish

    path = scratch_path(v.sites.sparkSession, "index")
    publish({"sites": H.keyed_sites(v.sites)}, path)
    return v.sites.sparkSession.read.parquet(f"{path}/sites").groupBy("chrom").agg(F.count("*").alias("sites"))
