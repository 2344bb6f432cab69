"""Checks and reports: annotation coverage, record validity, assemblies, liftover, and contracts of expected annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import alleles as A

#: Verdicts by severity.
SEVERITY = ("PASS", "SKIPPED", "NOT_APPLICABLE", "WARN", "FAIL")
#: Length of chromosome 1 by assembly, and names under which assemblies go.
CHR1_LENGTH = {249_250_621: "GRCh37", 248_956_422: "GRCh38"}
ASSEMBLY_NAMES = {"GRCh37": r"grch37|hg19|b37|hs37", "GRCh38": r"grch38|hg38|hs38"}


def record_flags(annotations: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """site_id and one boolean for each predicate: whether some row of the record fulfils it."""
    return annotations.groupBy("site_id").agg(*[F.coalesce(F.max(p), F.lit(False)).alias(n) for n, p in predicates.items()])


def counters(flags: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """metric, applicable, present: for each (applicable, present) pair of flags how many records are in the first, and in both."""
    total = flags.agg(*[x for i, (a, p) in enumerate(pairs) for x in (F.count_if(F.col(a)).alias(f"a{i}"), F.count_if(F.col(a) & F.col(p)).alias(f"p{i}"))])
    rows = [F.struct(F.lit(p).alias("metric"), F.col(f"a{i}").alias("applicable"), F.col(f"p{i}").alias("present")) for i, (_, p) in enumerate(pairs)]
    return total.select(F.inline(F.array(*rows)))


def with_status(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics with status from thresholds (metric, warn, fail, installed): nothing applicable or not installed is never a failure."""
    rate = F.col("present") / F.col("applicable")
    status = F.when(~F.coalesce("installed", F.lit(True)), "SKIPPED").when(F.col("applicable") == 0, "NOT_APPLICABLE").when(rate < F.col("fail"), "FAIL").when(rate < F.col("warn"), "WARN").otherwise("PASS")
    return metrics.join(thresholds, "metric", "left").withColumn("status", status).select("metric", "applicable", "present", "status")


def verdict(metrics: DataFrame) -> DataFrame:
    """One row: the worst status."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    return metrics.agg(F.max(F.struct(rank.alias("r"), "status"))["status"].alias("verdict"))


def examples(rows: DataFrame, label: str, order: str, n: int = 5) -> DataFrame:
    """label, examples: the first n of each label, as a report shows them."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order))).filter(F.col("_r") <= n)
    return ranked.groupBy(label).agg(F.array_sort(F.collect_list(order)).alias("examples"))


def violations(records: DataFrame) -> DataFrame:
    """records (chrom, pos, ref, alt, format, samples array, n_samples) with an array of what is wrong with each."""
    alts, keys = F.split("alt", ","), F.split("format", ":")
    gts = F.transform("samples", lambda s: F.substring_index(s, ":", 1))
    numbers = F.flatten(F.transform(gts, lambda g: F.filter(F.split(g, "[|/]"), lambda x: x.rlike("^[0-9]+$"))))
    checks = [
        F.when(F.col("pos") < 1, "position"), F.when(~F.col("ref").rlike("^[ACGTNacgtn]+$"), "reference alphabet"), F.when(F.size(F.array_distinct(alts)) < F.size(alts), "repeated ALT"),
        F.when(F.exists(alts, lambda a: ~a.rlike(r"^([ACGTNacgtn]+|\*|\.|<[^>]+>|.*[\[\]].*)$")), "ALT alphabet"), F.when(F.array_contains(keys, "GT") & (keys[0] != "GT"), "GT not first"), F.when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated FORMAT key"),
        F.when(F.size("samples") != F.col("n_samples"), "column count"), F.when(F.exists(numbers, lambda x: x.cast("int") > F.size(alts)), "genotype index"),
    ]
    return records.withColumn("violations", F.array_compact(F.array(*checks)))


def intake_report(checked: DataFrame, duplicates: int, unsorted: int) -> DataFrame:
    """check, status, detail over `violations`: one aggregate for all."""
    names = ["position", "reference alphabet", "repeated ALT", "ALT alphabet", "GT not first", "repeated FORMAT key", "column count", "genotype index"]
    row = checked.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("violations", n)).alias(f"v{i}") for i, n in enumerate(names)])
    say = lambda name, n: F.struct(F.lit(name).alias("check"), F.when(n == 0, "pass").otherwise("warning").alias("status"), n.cast("long").alias("records"))
    return row.select(F.inline(F.array(*[say(n, F.col(f"v{i}")) for i, n in enumerate(names)], say("duplicate records", F.lit(duplicates)), say("unsorted records", F.lit(unsorted)))))


def assemblies(headers: DataFrame) -> DataFrame:
    """file_id, assembly of many files at once from header lines (file_id, line): GRCh37, GRCh38, conflict or unknown.

    Evidence is the reference's name and the length of chromosome 1.
    """
    line = F.lower("line")
    about = line.rlike("^##(reference|assembly|contig)")
    by_name = [F.when(about & line.rlike(p), n) for n, p in ASSEMBLY_NAMES.items()]
    size = F.regexp_extract(line, r"^##contig=<id=(?:chr)?1,.*length=(\d+)", 1)
    by_size = [F.when(size == str(k), n) for k, n in CHR1_LENGTH.items()]
    found = headers.groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(*by_name, *by_size))))).alias("e"))
    return found.select("file_id", F.when(F.size("e") > 1, "conflict").when(F.size("e") == 1, F.col("e")[0]).otherwise("unknown").alias("assembly"))


def mixed_releases(files: DataFrame, column: str) -> DataFrame:
    """One row: the different releases of several files, and whether that calls for a warning."""
    return files.agg(F.array_sort(F.collect_set(column)).alias("releases"), (F.countDistinct(column) > 1).alias("mixed"))


def liftover_triage(sites: DataFrame, most: int = 50) -> DataFrame:
    """sites with `rejected`: why a record can't be lifted over; null for those that can."""
    why = F.when(~F.col("chrom").isin(*A.PRIMARY_CONTIGS), "not a primary contig").when(~A.is_sequence(F.col("ref")) | ~A.is_sequence(F.col("alt")), "symbolic or spanning").when(F.greatest(F.length("ref"), F.length("alt")) > most, "too long")
    return sites.withColumn("rejected", why)


def width_violations(records: DataFrame) -> DataFrame:
    """records (record_id, alts, info map, number map: A, R, G) with the keys kept and dropped for their width."""
    n = F.size("alts")
    width = lambda k: F.when(F.col("number")[k] == "A", n).when(F.col("number")[k] == "R", n + 1).when(F.col("number")[k] == "G", (n + 1) * (n + 2) / 2)
    keep = F.map_filter("info", lambda k, v: F.coalesce(F.size(F.split(v, ",")) == width(k), F.lit(True)))
    return records.select("record_id", keep.alias("info"), F.array_sort(F.array_except(F.map_keys("info"), F.map_keys(keep))).alias("dropped"))


def change_class(ref: Column, alt: Column, new_ref: Column, new_alt: Column) -> Column:
    """unchanged, swap, reverse_complement, new_reference or renormalised, of a lifted allele against its source."""
    rc = A.reverse_complement
    return F.when((ref == new_ref) & (alt == new_alt), "unchanged").when((ref == new_alt) & (alt == new_ref), "swap").when((rc(ref) == new_ref) & (rc(alt) == new_alt), "reverse_complement").when(alt == new_alt, "new_reference").otherwise("renormalised")


def liftover_metrics(lifted: DataFrame) -> DataFrame:
    """class, records, originals (different source keys)."""
    return lifted.groupBy("class").agg(F.count("*").alias("records"), F.countDistinct("original_key").alias("originals"))


def swap_outcomes(lifted: DataFrame, calls: DataFrame) -> DataFrame:
    """lifted (site_id, class) with outcome: a swap whose called genotypes are all reference is a correction, others are swaps; null otherwise."""
    gts = calls.groupBy("site_id").agg(F.max(F.col("gt").rlike("[0-9]")).alias("called"), F.max(F.col("gt").rlike("[1-9]")).alias("nonref"))
    out = lifted.join(gts, "site_id", "left")
    swapped = F.col("class") == "swap"
    return out.select(*lifted.columns, F.when(swapped & F.coalesce("called", F.lit(False)) & ~F.coalesce("nonref", F.lit(False)), "correction").when(swapped, "swap").when(F.col("class") == "new_reference", "new_reference").alias("outcome"))


def reconciliation(attempted: DataFrame, raw: DataFrame, rejected: DataFrame, accepted: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row of counts and whether they add up: raw and rejected to attempted, accepted and corrections to raw."""
    out = None
    for name, df in (("attempted", attempted), ("raw", raw), ("rejected", rejected), ("accepted", accepted), ("corrections", corrections)):
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.withColumns({"complete": F.col("raw") + F.col("rejected") == F.col("attempted"), "split": F.col("accepted") + F.col("corrections") == F.col("raw")})


def contract(annotations: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (variant_key, gene, consequence, min_score) with PASS, FAIL or SKIP: SKIP when the variant isn't there."""
    rows = annotations.groupBy("variant_key").agg(F.collect_set("gene").alias("_genes"), F.collect_set(F.struct("gene", "consequence")).alias("_c"), F.max("score").alias("_score"))
    out = expected.join(rows, "variant_key", "left")
    good = F.array_contains("_genes", F.col("gene")) & F.exists("_c", lambda x: (x["gene"] == F.col("gene")) & (x["consequence"] == F.col("consequence"))) & (F.col("min_score").isNull() | F.coalesce(F.col("_score") >= F.col("min_score"), F.lit(False)))
    return out.select(*expected.columns, F.when(F.col("_genes").isNull(), "SKIP").when(good, "PASS").otherwise("FAIL").alias("result"))
