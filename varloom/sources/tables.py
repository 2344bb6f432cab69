"""Readers of interval, gene, pedigree and ontology text, and writers of tables.

Files are read on the executors with a given schema; what comes to the driver is a header line or a column mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def read_bed(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """chrom, start0, end0 and extra columns; comments, track and browser lines are skipped, bad rows dropped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track\b|browser\b|\s*$)"))
    out = rows.select(F.get(parts, F.lit(0)).alias("chrom"), *[F.get(parts, F.lit(i)).try_cast("long").alias(c) for i, c in ((1, "start0"), (2, "end0"))], *[F.get(parts, F.lit(3 + i)).alias(c) for i, c in enumerate(extra)])
    return out.filter("start0 >= 0 AND end0 > start0")


def read_table(spark: SparkSession, path: str, required: tuple[str, ...], sep: str = "\t") -> DataFrame:
    """A headed table as text columns. A missing or repeated column and a row of another width raise."""
    first = spark.read.text(path).filter(F.col("value") != "").first()
    names = first["value"].lstrip("#").split(sep) if first else []
    if len(set(names)) < len(names) or not set(required) <= set(names):
        raise ValueError(f"columns of {path}: {names}")
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("mode", "FAILFAST").csv(path, sep=sep, header=True)


def read_after_preamble(spark: SparkSession, path: str, first_column: str, sep: str = "\t") -> DataFrame:
    """A table whose header line, the one that begins with first_column, comes after lines of other text. Rows of other widths are dropped."""
    lines = spark.read.text(path)
    header = lines.filter(F.regexp_replace("value", "^#+ ?", "").startswith(first_column)).first()
    if header is None:
        raise ValueError(f"{path} has no header with {first_column}")
    names = header["value"].lstrip("# ").split(sep)
    parts = F.split("value", sep)
    rows = lines.filter((F.col("value") != header["value"]) & ~F.col("value").startswith("#") & (F.size(parts) == len(names)))
    return rows.select(*[parts[i].alias(n) for i, n in enumerate(names)])


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, feature, start1, end1, strand, attributes (map; of repeated keys the first)."""
    p = F.split("value", "\t")
    keys, values = F.regexp_extract_all(p[8], F.lit(r'(\w+) "?([^";]*)"?'), 1), F.regexp_extract_all(p[8], F.lit(r'(\w+) "?([^";]*)"?'), 2)
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, 1, i), lambda o: o["key"] == x["key"]))
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(p) >= 9))
    return rows.select(p[0].alias("chrom"), p[2].alias("feature"), p[3].cast("long").alias("start1"), p[4].cast("long").alias("end1"), p[6].alias("strand"), F.map_from_entries(first).alias("attributes"))


def read_ped(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows of six columns with their line, lines that are too short)."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    names = ("family", "sample", "father", "mother", "sex", "affected")
    return lines.filter(F.size(p) >= 6).select(*[p[i].alias(n) for i, n in enumerate(names)], "line"), lines.filter(F.size(p) < 6)


def read_constraint(spark: SparkSession, path: str) -> DataFrame:
    """gene, pli, loeuf, mis_z from a constraint table; other text than numbers is null."""
    t = read_table(spark, path, ("gene", "pli", "loeuf", "mis_z"))
    return t.select("gene", *[F.col(c).try_cast("double").alias(c) for c in ("pli", "loeuf", "mis_z")])


def read_obo(spark: SparkSession, path: str, prefix: str = "CL:") -> tuple[DataFrame, DataFrame]:
    """(terms: term, name; edges: term, parent) of active terms with the prefix. Stanzas are rows: the file is split at empty lines."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path)
    one = lambda key: F.regexp_extract("value", rf"(?m)^{key}: (.*?)\s*$", 1)
    terms = stanzas.filter(F.col("value").contains("[Term]") & ~F.col("value").rlike(r"(?m)^is_obsolete: true")).select(one("id").alias("term"), one("name").alias("name"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), 1).alias("parents")).filter(F.col("term").startswith(prefix))
    return terms.select("term", "name"), terms.select("term", F.explode("parents").alias("parent")).filter(F.col("parent").startswith(prefix))


def read_haplotypes(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of JSON lines: a bad line is set aside and doesn't stop the rest."""
    full = T._parse_datatype_string(schema).add("_bad", T.StringType())
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_row"))
    broken = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    return rows.filter(~broken).select("_row.*").drop("_bad"), rows.filter(broken).select("value")


def read_protein_catalog(spark: SparkSession, path: str) -> DataFrame:
    """gene, protein_position, alt_aa, transcript, record_id of a catalog with two to five columns; older files have fewer, which are null."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(p) >= 2))
    get = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
    return rows.select(get(0).alias("gene"), get(1).try_cast("int").alias("protein_position"), get(2).alias("alt_aa"), get(3).alias("transcript"), get(4).alias("record_id"))


def write_tsv(rows: DataFrame, path: str, columns: list[str], partitions: int = 1) -> None:
    """A headed table of chosen columns; arrays are comma-joined, nulls are empty."""
    kinds = dict(rows.dtypes)
    text = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if kinds[c].startswith("array") else F.col(c).cast("string").alias(c) for c in columns]
    rows.select(*text).coalesce(partitions).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def publish(tables: dict[str, DataFrame], path: str, by: str = "chrom") -> None:
    """Parquet tables under a path, those with column `by` partitioned by it and sorted by place; only partitions that occur are replaced."""
    for name, df in tables.items():
        parted = by in df.columns
        place = [c for c in (by, "pos", "variant_key") if c in df.columns]
        rows = df.repartitionByRange(*place).sortWithinPartitions(*place) if parted else df  # by place, as one chromosome may be too large for a task
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(by) if parted else writer).parquet(f"{path}/{name}")
