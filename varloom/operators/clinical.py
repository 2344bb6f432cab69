"""Clinical evidence: labels, exact-allele evidence, protein-level matches, catalogs and their mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.alleles import chromosome
from varloom.functions.fields import info_map

#: Whole labels that count as pathogenic, and classes in clinical order.
PATHOGENIC = ("pathogenic", "likely pathogenic", "pathogenic/likely pathogenic")
CLASS_ORDER = ("Pathogenic", "Likely_pathogenic", "Uncertain_significance", "Likely_benign", "Benign")


def label_key(label: Column) -> Column:
    """Lower case, with underscores and runs of white space as one space."""
    return F.trim(F.lower(F.regexp_replace(label, r"[_\s]+", " ")))


def is_pathogenic_label(label: Column, labels: tuple[str, ...] = PATHOGENIC) -> Column:
    """Whether the whole label is one of the pathogenic ones: compound labels aren't."""
    return F.coalesce(label_key(label).isin(*labels), F.lit(False))


def mentions_pathogenic(text: Column) -> Column:
    """A mention of pathogenic in a label without conflict."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains("pathogenic") & ~low.contains("conflict")


def conflict_with_pathogenic(text: Column, evidence: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).contains("conflict") & F.lower(F.coalesce(evidence, F.lit(""))).contains("pathogenic")


def exact_evidence(variants: DataFrame, evidence: DataFrame, on: list[str], order: str, columns: list[str]) -> DataFrame:
    """variants with `evidence`: all records of the same allele, sorted by `order`; an empty array without any."""
    rows = evidence.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("evidence"))
    out = variants.join(rows, on, "left")
    kind = rows.schema["evidence"].dataType.simpleString()
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def protein_matches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """queries (site_id, k, gene, transcript, protein_position, ref_aa, alt_aa) with residue_match, change_match and details.

    A catalog row matches on gene, transcript without version, position and reference residue; never by the same allele. Only
    whole pathogenic labels count. Null flags mean that the query wasn't evaluated, as without a position.
    """
    q = queries.withColumn("_base", F.substring_index("transcript", ".", 1))
    c = catalog.filter(is_pathogenic_label(F.col("classification"))).select(F.col("gene").alias("_g"), F.col("transcript_base").alias("_t"), F.col("protein_position").alias("_p"), F.col("ref_aa").alias("_r"), F.col("alt_aa").alias("_a"), "record_id", "source_site_id")
    on = (F.col("gene") == F.col("_g")) & (F.col("_base") == F.col("_t")) & (F.col("protein_position") == F.col("_p")) & (F.col("ref_aa") == F.col("_r")) & (F.col("source_site_id") != F.col("site_id"))
    rows = q.join(c, on, "left").groupBy(*queries.columns).agg(F.max(F.col("record_id").isNotNull()).alias("residue_match"), F.max(F.coalesce(F.col("_a") == F.col("alt_aa"), F.lit(False))).alias("change_match"), F.array_sort(F.collect_set("record_id")).alias("details"))
    seen = F.col("protein_position").isNotNull() & F.col("ref_aa").isNotNull()
    return rows.withColumns({n: F.when(seen, F.col(n)) for n in ("residue_match", "change_match")})


def match_status(own: Column, any_other: Column) -> Column:
    """What a display says: selected, other_transcript, no_match or not_evaluated. Not evaluated is never negative."""
    return F.when(own, "selected").when(any_other, "other_transcript").when(own.isNull(), "not_evaluated").otherwise("no_match")


def protein_status(matched: DataFrame) -> DataFrame:
    """A row for each of `protein_matches` with `status` over all transcripts of the site."""
    other = F.max("change_match").over(Window.partitionBy("site_id"))
    return matched.withColumn("status", match_status(F.col("change_match"), F.coalesce(other, F.lit(False))))


def ordered_classes(rows: DataFrame, by: str, label: str) -> DataFrame:
    """by, classes: the different labels, in clinical order, unknown ones last by name."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col(label)).cast("int")
    pair = F.struct(F.when(rank > 0, rank).otherwise(len(CLASS_ORDER) + 1).alias("r"), F.col(label).alias("c"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(pair)).alias("_c")).select(by, F.transform("_c", lambda x: x["c"]).alias("classes"))


def missense_scan(records: DataFrame, labels: tuple[str, ...] = PATHOGENIC) -> DataFrame:
    """chrom, pos, ref, alt, record_id, classification, disease, genes: an ALT each of the pathogenic missense records of a clinical VCF.

    records: chrom, pos, id, ref, alt, info as `sources.vcf.records` gives them. Whole labels decide, as in `is_pathogenic_label`;
    ALTs that aren't plain sequence are left out, and take their number with them. A record without position stops the job.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = records.withColumn("_i", info_map(F.col("info")))
    rows = rows.filter(is_pathogenic_label(F.col("_i")["CLNSIG"], labels) & text(F.col("_i")["MC"]).contains("missense_variant"))
    position = F.coalesce(F.col("pos").try_cast("long"), F.raise_error(F.lit("a clinical record has no whole number as position")).cast("long"))
    alts = F.split("alt", ",", -1)
    rows = rows.withColumns({"_pos": position, "_n": F.size(alts)}).select("*", F.posexplode(alts).alias("_k", "_alt"))
    rows = rows.filter(F.col("ref").rlike("^[ACGTNacgtn]+$") & F.col("_alt").rlike("^[ACGTNacgtn]+$"))
    own = F.coalesce(F.when(~F.col("id").isin("", "."), F.col("id")), F.concat_ws(":", chromosome(F.col("chrom")), F.col("_pos").cast("string"), "ref", "_alt"))
    genes = F.filter(F.transform(F.split(text(F.col("_i")["GENEINFO"]), r"\|"), lambda g: F.substring_index(g, ":", 1)), lambda g: g != "")
    return rows.select(
        "chrom", F.col("_pos").alias("pos"), "ref", F.col("_alt").alias("alt"), F.when(F.col("_n") > 1, F.concat(own, F.lit(":ALT"), F.col("_k") + 1)).otherwise(own).alias("record_id"),
        F.translate(F.col("_i")["CLNSIG"], "_", " ").alias("classification"), F.translate(text(F.col("_i")["CLNDN"]), "_", " ").alias("disease"), F.array_join(genes, "|").alias("genes"),
    )


def build_catalog(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """One catalog from sources with the same columns: pathogenic rows, one for each record, gene, transcript, position and change; the first source's row wins."""
    parts = [df.filter(is_pathogenic_label(F.col("classification"))).withColumns({"source": F.lit(name), "_o": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    key = ["gene", "transcript_base", "protein_position", "ref_aa", "alt_aa", "source_site_id"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_o", "record_id"))
    return out.withColumn("_r", rank).filter("_r = 1").drop("_r", "_o")


def mapped(rows: DataFrame, by_id: DataFrame, by_alias: DataFrame, by_text: DataFrame) -> DataFrame:
    """rows (id, alias, text, active) with site_id and mapping: by id, else by alias, else by text; each table has one row a key."""
    a = by_id.select(F.col("id").alias("_i"), F.col("site_id").alias("_s1"))
    b = by_alias.select(F.col("alias").alias("_a"), F.col("site_id").alias("_s2"))
    c = by_text.select(F.col("text").alias("_t"), F.col("site_id").alias("_s3"))
    out = rows.join(a, F.col("id") == F.col("_i"), "left").join(b, F.col("alias") == F.col("_a"), "left").join(c, F.col("text") == F.col("_t"), "left")
    how = F.when(F.col("_s1").isNotNull(), "id").when(F.col("_s2").isNotNull(), "alias").when(F.col("_s3").isNotNull(), "text").otherwise("unmapped")
    return out.select(*rows.columns, F.coalesce("_s1", "_s2", "_s3").alias("site_id"), how.alias("mapping"))


def mapping_rate(mapped_rows: DataFrame, least: float = 0.995) -> DataFrame:
    """One row: active rows, how many are mapped, and whether that is enough."""
    ok = F.count_if(F.col("active") & (F.col("mapping") != "unmapped"))
    n = F.count_if("active")
    return mapped_rows.agg(n.alias("active"), ok.alias("mapped"), (ok >= n * F.lit(least)).alias("enough"))


def split_rejects(rows: DataFrame) -> DataFrame:
    """rows (chrom, pos, ref, alt) with `reason`, null for accepted ones: the first rule that fails."""
    seq = r"^[ACGTNacgtn]+$"
    why = F.when(F.col("chrom").isNull() | F.col("pos").isNull(), "no position").when(F.col("pos") <= 0, "position out of range").when(~F.coalesce(F.col("ref").rlike(seq), F.lit(False)), "bad reference").when(~F.coalesce(F.col("alt").rlike(seq), F.lit(False)), "symbolic allele").when(F.upper("ref") == F.upper("alt"), "no change")
    return rows.withColumn("reason", why)


def last_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that should be unique and aren't, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def haplotype_evidence(tokens: DataFrame) -> DataFrame:
    """The best event for each variant, sample and transcript from rows (variant_key, sample_id, transcript, status, partners)."""
    order = F.array(F.lit("FRAME_RESTORED_CONFIRMED"), F.lit("FRAME_RESTORATION_PARTIAL_CONFIRMED"), F.lit("FRAME_RESTORING_POSSIBLE_UNPHASED"))
    rank = F.array_position(order, F.col("status")).cast("int")
    return tokens.filter(rank > 0).groupBy("variant_key", "sample_id", "transcript").agg(F.min_by(F.struct("status", "partners"), F.struct(rank, F.col("partners"))).alias("best")).select("variant_key", "sample_id", "transcript", "best.*")
