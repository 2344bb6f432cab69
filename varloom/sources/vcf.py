"""VCF text as tables: headers, records, ALTs, genotypes and consequences, and the way back to text.

Lines are split on the executors; only headers come to the driver. A gzip file is one split, so that its rows are
dealt out again after reading; plain text is split by size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions import fields as X
from varloom.functions import genotypes as G
from varloom.sources import headers

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


@dataclass(frozen=True)
class VcfHeader:
    samples: tuple[str, ...] = ()
    csq_fields: tuple[str, ...] = ()
    info: dict[str, str] = field(default_factory=dict)  # id -> Number
    lines: tuple[str, ...] = ()


def csq_fields(line: str) -> tuple[str, ...]:
    """The field names in a CSQ header line, after Format."""
    found = re.search(r'Format:\s*([^">]+)', line)
    return tuple(x.strip() for x in found.group(1).split("|")) if found else ()


def parse_header(lines: list[str]) -> VcfHeader:
    samples, csq, info = (), (), {}
    for line in lines:
        if line.startswith("#CHROM"):
            samples = tuple(line.rstrip("\r\n").split("\t")[9:])
        elif line.startswith("##INFO=<ID=CSQ"):
            csq = csq_fields(line)
        elif found := re.match(r"##INFO=<ID=([^,]+),Number=([^,>]+)", line):
            info[found.group(1)] = found.group(2)
    return VcfHeader(samples, csq, info, tuple(lines))


def read_header(spark: SparkSession, path: str) -> VcfHeader:
    """The header of one file, or of the first one by name of a set, up to its #CHROM line; `headers.read_headers` reads those of all."""
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    return parse_header(headers.head_of(spark, first) if first else [])


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """value, file, ordinal: data lines with their order in the file. ordinal grows with the place, but has gaps."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ordinal")).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.repartition(partitions) if partitions else rows


def records(lines: DataFrame) -> DataFrame:
    """Columns of FIXED and samples (array of text) for lines (value, and others that are kept). Too short lines get nulls."""
    parts = F.split("value", "\t")
    named = [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(FIXED)]
    out = lines.select(*[c for c in lines.columns if c != "value"], *named, F.slice(parts, 10, 1_000_000).alias("samples"))
    return out.withColumn("pos", F.when(F.col("pos").rlike("^[0-9]+$"), F.col("pos").cast("long")))


def column_mismatches(rows: DataFrame, header: VcfHeader) -> DataFrame:
    """Records with another number of sample columns than the header names: a truncated or damaged file."""
    return rows.filter(F.size("samples") != len(header.samples))


def alleles(rows: DataFrame) -> DataFrame:
    """One row an ALT: alt_index from 0, alts, variant_key, minimal pos, ref and alt."""
    out = rows.withColumn("alts", F.split("alt", ",")).select("*", F.posexplode("alts").alias("alt_index", "one")).drop("alt").withColumnRenamed("one", "alt")
    out = out.withColumn("_m", A.minimal(F.col("pos"), F.col("ref"), F.col("alt"))).withColumn("chrom", A.chromosome(F.col("chrom")))
    key = F.concat_ws(":", "chrom", F.col("_m.pos").cast("string"), "_m.ref", "_m.alt")
    return out.withColumns({"variant_key": key, "min_pos": F.col("_m.pos"), "min_ref": F.col("_m.ref"), "min_alt": F.col("_m.alt")}).drop("_m")


def genotypes(allele_rows: DataFrame, samples: tuple[str, ...], chosen: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Carriers of each ALT: keep, variant_key, sample_id and the call's fields. Non-carriers never leave the row they are in."""
    names = F.array(*[F.lit(s) for s in samples])
    n = F.size("samples")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(names, i).alias("sample_id"), F.get(F.col("samples"), i).alias("raw")))
    allele = F.col("alt_index") + 1
    # the carrier test looks at the genotype alone, before anything is exploded
    # and most cells of many samples are uncalled, which a comparison tells
    called = F.filter(each, lambda s: (s["raw"] != "./.") & ~s["raw"].startswith("./.:"))
    carried = F.filter(called, lambda s: G.copies(F.substring_index(s["raw"], ":", 1), allele) > 0)
    if chosen is not None:
        carried = F.filter(carried, lambda s: s["sample_id"].isin(*chosen))
    own = [*keep, "variant_key", "chrom", "min_pos", "filter"]
    rows = allele_rows.filter(n > 0).select(*own, "alt_index", "format", F.inline(carried))
    return rows.select(*own, "sample_id", G.genotype(F.col("format"), F.col("raw"), F.col("alt_index") + 1).alias("g")).select(*own, "sample_id", "g.*")


def consequences(allele_rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """id (if the rows have one), variant_key, alt_index and entry (map) for each consequence that belongs to the ALT.

    Number, exact and minimised alleles decide in turn; of a record with one ALT and no match all entries are taken.
    """
    kept = ["id"] if "id" in allele_rows.columns else []
    # a column, so that INFO is searched once
    rows = allele_rows.withColumn("_csq", X.info_value(F.col("info"), "CSQ")).withColumn("_all", X.csq_entries(F.col("_csq"), list(fields)))
    own = F.filter("_all", lambda e: X.attributed(F.coalesce(e["ALLELE_NUM"], F.lit("")) if "ALLELE_NUM" in fields else F.lit(""), e["Allele"] if "Allele" in fields else F.lit(""), F.col("ref"), F.col("alts"), F.col("alt_index")))
    # a column, so that the filter is done once
    rows = rows.withColumn("_own", own)
    taken = F.when((F.size("_own") == 0) & (F.size("alts") == 1), F.col("_all")).otherwise(F.col("_own"))
    return rows.select(*kept, "variant_key", "alt_index", F.explode(taken).alias("entry"))


def with_info(rows: DataFrame, key: str, values: Column) -> DataFrame:
    """rows whose INFO has one more key, per ALT and comma-joined; an older entry of that key goes first. Null slots are dots."""
    kept = F.filter(F.split("info", ";"), lambda x: ~(x.startswith(key + "=") | x.isin("", ".")))
    text = F.concat(F.lit(key + "="), F.array_join(values, ",", "."))
    return rows.withColumn("info", F.when(F.exists(values, lambda x: x.isNotNull()), F.array_join(F.concat(kept, F.array(text)), ";")).otherwise(F.when(F.size(kept) > 0, F.array_join(kept, ";")).otherwise(".")))


def to_lines(rows: DataFrame) -> DataFrame:
    """value: a VCF line for each record."""
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in FIXED], F.array_join("samples", "\t")).alias("value"))


def write(rows: DataFrame, header: VcfHeader, path: str, partitions: int = 8) -> None:
    """A directory of text files by range of place, sorted within; the header is the first file's own part."""
    spark = rows.sparkSession
    spark.createDataFrame([(i, x) for i, x in enumerate(header.lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{path}/header")
    chrom = A.chromosome(F.col("chrom"))
    placed = rows.withColumns({"_rank": A.contig_rank(chrom), "_chrom": chrom})
    to_lines(placed.repartitionByRange(partitions, "_rank", "_chrom", "pos").sortWithinPartitions("_rank", "_chrom", "pos")).write.mode("overwrite").text(f"{path}/records")


def projection(rows: DataFrame, samples: tuple[str, ...], chosen: tuple[str, ...], keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with only the chosen samples, keys that no record has). keys: variant_key; a record stays if any of its ALTs is wanted.

    Without keys: passing records that some chosen sample carries.
    """
    at = [samples.index(s) for s in chosen]
    picked = F.array(*[F.get(F.col("samples"), F.lit(i)) for i in at])
    named = rows.withColumn("_record", F.xxhash64("chrom", "pos", "ref", "alt", "ordinal") if "ordinal" in rows.columns else F.xxhash64("chrom", "pos", "ref", "alt"))
    if keys is None:
        carried = F.exists(picked, lambda s: F.substring_index(s, ":", 1).rlike("[1-9]"))
        out = named.filter(F.col("filter").isin("PASS", ".") & carried)
        return out.withColumn("samples", picked).drop("_record"), rows.sparkSession.createDataFrame([], "variant_key string")
    wanted = keys.select("variant_key").distinct()
    hits = alleles(named).join(wanted, "variant_key").select("_record", "variant_key")
    out = named.join(hits.select("_record").distinct(), "_record", "left_semi").withColumn("samples", picked).drop("_record")
    return out, wanted.join(hits.select("variant_key").distinct(), "variant_key", "left_anti")
