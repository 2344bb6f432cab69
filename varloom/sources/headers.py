"""Headers of sets of called files, each read to its own #CHROM line and no further, and what doesn't fit between them.

A head is read through Hadoop's file systems by the driver, CHUNK bytes at a time, so that a file of any size costs its header only; texts of heads go to the
shared folder a slice of files at a time, and what is said about them are DataFrames. A header may have any number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import fields as X
from varloom.functions.scratch import scratch_path

CHUNK, FILES_AT_ONCE = 1 << 16, 64
ZIPPED = (".gz", ".bgz")


def head_of(spark: SparkSession, file: str) -> list[str]:
    """The lines of a file up to #CHROM, or up to the first that doesn't begin with #. gzip by its suffix, in one member or many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(file)
    stream = place.getFileSystem(conf).open(place)
    try:
        if file.lower().endswith(ZIPPED):
            codec = jvm.org.apache.hadoop.io.compress.GzipCodec()
            codec.setConf(conf)
            stream = codec.createInputStream(stream)
        done, rest = [], b""
        while True:
            part = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, CHUNK)))
            *lines, rest = (rest + part).split(b"\n")
            for line in lines if part else [*lines, rest]:
                if not line.startswith(b"#"):
                    return done
                done.append(line.decode("utf-8", "replace").rstrip("\r"))
                if line.startswith(b"#CHROM"):
                    return done
            if not part:
                return done
    finally:
        stream.close()


def _slices(spark: SparkSession, path: str | list[str]) -> Iterator[list[tuple[str, int, str]]]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").distinct()
    held, n = [], 0
    for row in files.toLocalIterator():
        held += [(row["path"], i, line) for i, line in enumerate(head_of(spark, row["path"]))] or [(row["path"], 0, "")]
        n += 1
        if n % FILES_AT_ONCE == 0:
            yield held
            held = []
    if held:
        yield held


@dataclass(frozen=True)
class Headers:
    """lines: file, line_no, value."""

    lines: DataFrame

    def _of(self, start: str) -> DataFrame:
        return self.lines.filter(F.col("value").startswith(start))

    def samples(self) -> DataFrame:
        """file, ordinal (from 0), sample."""
        names = F.slice(F.split("value", "\t", -1), 10, 1 << 30)
        return self._of("#CHROM").select("file", F.posexplode(names).alias("ordinal", "sample"))

    def csq(self) -> DataFrame:
        """file, csq: the names of the consequence fields in the file's own order; the last such line counts."""
        names = F.transform(F.split(F.regexp_extract("value", r'(?i)Format:\s*([^">]+)', 1), r"\|"), lambda x: F.trim(x))
        return self._of("##INFO=<ID=CSQ").groupBy("file").agg(F.max_by(names, "line_no").alias("csq"))

    def info(self) -> DataFrame:
        """file, id, number, type of INFO lines."""
        get = lambda k: F.regexp_extract("value", rf"[<,]{k}=([^,>]+)", 1)
        return self._of("##INFO=<").select("file", get("ID").alias("id"), get("Number").alias("number"), get("Type").alias("type"))

    def contigs(self) -> DataFrame:
        """file, contig, length (null if it isn't stated)."""
        return self._of("##contig=<").select("file", F.regexp_extract("value", r"[<,]ID=([^,>]+)", 1).alias("contig"), F.regexp_extract("value", r"[<,]length=(\d+)", 1).try_cast("long").alias("length"))

    def problems(self) -> DataFrame:
        """file, problem: no_fileformat, no_columns, no_samples, no_csq, repeated_sample, empty_sample."""
        has = lambda start: F.max(F.col("value").startswith(start))
        one = self.lines.groupBy("file").agg(has("##fileformat=VCF").alias("f"), has("#CHROM").alias("c"), has("##INFO=<ID=CSQ").alias("q"))
        names = self.samples().groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("sample").alias("d"), F.count_if(F.col("sample") == "").alias("e"))
        n = F.coalesce("n", F.lit(0))
        tests = {"no_fileformat": ~F.col("f"), "no_columns": ~F.col("c"), "no_samples": F.col("c") & (n == 0), "no_csq": ~F.col("q"), "repeated_sample": n > F.col("d"), "empty_sample": F.col("e") > 0}
        found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
        return one.join(names, "file", "left").select("file", F.explode(found).alias("problem"))

    def conflicts(self) -> DataFrame:
        """kind, name, variants: what files say differently of an INFO id (number or type) or of a contig's length, and samples that several files have."""

        def differ(rows: DataFrame, kind: str, name: str, value: Column) -> DataFrame:
            out = rows.groupBy(F.col(name).alias("name")).agg(F.array_sort(F.collect_set(value)).alias("variants"))
            return out.filter(F.size("variants") > 1).select(F.lit(kind).alias("kind"), "name", F.array_join("variants", ",").alias("variants"))

        parts = [
            differ(self.info(), "info_number", "id", F.col("number")), differ(self.info(), "info_type", "id", F.col("type")), differ(self.contigs(), "contig_length", "contig", F.col("length").cast("string")),
            differ(self.samples().select("sample", F.element_at(F.split("file", "/"), -1).alias("file")).distinct(), "sample_in_files", "sample", F.col("file")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def read_headers(spark: SparkSession, path: str | list[str]) -> Headers:
    """The headers of all files under path, or of a list of paths. A file without any header has one empty line."""
    target, schema = scratch_path(spark, "headers"), "file string, line_no int, value string"
    spark.createDataFrame([], schema).write.parquet(target)
    for rows in _slices(spark, path):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(target)
    return Headers(spark.read.schema(schema).parquet(target))


def entries_by_file(rows: DataFrame, headers: Headers, csq: str = "csq") -> DataFrame:
    """rows (file and raw consequence text in column `csq`) with `entries`, array<map<field, value>> by the order of the row's own file."""
    orders = headers.csq().select(F.col("file"), F.col("csq").alias("_fields"))

    def entry(text: Column) -> Column:
        values = F.split(text, r"\|", -1)
        n = F.size("_fields")
        padded = F.slice(F.concat(values, F.array_repeat(F.lit(""), n)), F.lit(1), n)
        return F.map_from_arrays(F.col("_fields"), F.transform(padded, X.percent_decoded))

    out = rows.join(orders, "file", "left")
    return out.withColumn("entries", F.when((F.col(csq) != "") & F.col("_fields").isNotNull(), F.transform(F.split(csq, ","), entry))).drop("_fields")


