"""State: upserts of the cohort index, callset identity and versions, and phenotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """old merged with new by key, one full outer join. rules by column: latest (new wins), keep (old wins) or max; a null never wins.

    Both sides must have one row a key; `last_by_key` sees to that.
    """
    a = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in rules])
    b = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in rules])
    merge = {"latest": lambda o, n: F.coalesce(n, o), "keep": lambda o, n: F.coalesce(o, n), "max": lambda o, n: F.greatest(o, n)}
    return a.join(b, key, "full_outer").select(*key, *[merge[r](F.col(f"_o_{c}"), F.col(f"_n_{c}")).alias(c) for c, r in rules.items()])


def merge_observations(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Observations (status, annotation_id, value) by key: an exact old row keeps status and annotation against a non-exact new one; values take the newer."""
    a = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in ("status", "annotation_id", "value")])
    b = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in ("status", "annotation_id", "value")])
    j = a.join(b, key, "full_outer")
    keep = F.coalesce((F.col("_o_status") == "exact") & (F.col("_n_status") != "exact"), F.lit(False)) | F.col("_n_status").isNull()
    return j.select(*key, F.when(keep, F.col("_o_status")).otherwise(F.col("_n_status")).alias("status"), F.when(keep, F.col("_o_annotation_id")).otherwise(F.col("_n_annotation_id")).alias("annotation_id"), F.coalesce("_n_value", "_o_value").alias("value"))


def append_calls(old: DataFrame, new: DataFrame, file_id, samples: DataFrame | None) -> DataFrame:
    """Calls after an import of a file: all its rows are replaced, or those of `samples` alone when the import was restricted to them."""
    own = old.filter(F.col("file_id") == file_id)
    kept = old.filter(~F.col("file_id").eqNullSafe(F.lit(file_id)))
    if samples is not None:
        kept = kept.unionByName(own.join(samples.select("sample_id"), "sample_id", "left_anti"))
    return kept.unionByName(new)


def remove_samples(calls: DataFrame, sites: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, sites) without the samples, and without sites that nobody carries any more."""
    left = calls.join(samples.select("sample_id").distinct(), "sample_id", "left_anti")
    return left, sites.join(left.select("site_id").distinct(), "site_id", "left_semi")


def fingerprint(calls: DataFrame, by: str) -> DataFrame:
    """by, records, fingerprint: a digest of a callset's sites and genotypes in any order and partitioning; copies of a row count.

    A multiset hash: the eight 32-bit pieces of each row's SHA-256 are added up, and the sums are digested. A null counts as a dot.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("variant_key", "sample_id", "gt")])
    row = calls.select(by, F.sha2(text, 256).alias("_h"))
    pieces = [F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"_{i}") for i in range(8)]
    return row.groupBy(by).agg(F.count("*").alias("records"), *pieces).select(by, "records", F.sha2(F.concat_ws("-", *[F.col(f"_{i}").cast("string") for i in range(8)]), 256).alias("fingerprint"))


def identity(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """file_id, outcome, callset_id: exact_current, exact_previous, reannotation, possible_update or new.

    incoming: file_id, checksum, fingerprint, samples (sorted array). library: callset_id, version, is_current, checksum, fingerprint, samples.
    """
    j = _by_sample(incoming, library)
    rank = F.when((F.col("checksum") == F.col("_l_checksum")) & (F.col("samples") == F.col("_l_samples")), F.when(F.col("_l_is_current"), 0).otherwise(1)).when(F.col("_l_is_current") & (F.col("fingerprint") == F.col("_l_fingerprint")), 2).when(F.col("_l_is_current"), 3)
    best = j.groupBy("file_id").agg(F.min(F.struct(rank.alias("r"), (F.col("samples") != F.col("_l_samples")).alias("other"), (-F.col("_shared")).alias("s"), F.col("_l_callset_id").alias("callset_id"))).alias("b"))
    names = F.array(*[F.lit(x) for x in ("exact_current", "exact_previous", "reannotation", "possible_update")])
    out = incoming.select("file_id").join(best.filter("b.r IS NOT NULL"), "file_id", "left")
    return out.select("file_id", F.coalesce(F.get(names, F.col("b.r")), F.lit("new")).alias("outcome"), F.col("b.callset_id").alias("callset_id"))


def _by_sample(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs of an incoming file and a version that share a sample, with how many: an equality join on samples."""
    a = incoming.select("file_id", F.explode("samples").alias("sample"))
    b = library.select(F.col("callset_id").alias("_l_callset_id"), F.col("version").alias("_l_version"), F.explode("samples").alias("sample"))
    shared = a.join(b, "sample").groupBy("file_id", "_l_callset_id", "_l_version").agg(F.count("*").alias("_shared"))
    named = library.select(*[F.col(c).alias(f"_l_{c}") for c in library.columns])
    return shared.join(named, ["_l_callset_id", "_l_version"]).join(incoming, "file_id")


def switch_version(library: DataFrame, callset_id, version) -> DataFrame:
    """library with one current version of the callset; raises nothing if the version isn't there, then none changes."""
    there = F.max((F.col("callset_id") == callset_id) & (F.col("version") == version)).over(Window.partitionBy("callset_id"))
    return library.withColumn("is_current", F.when((F.col("callset_id") == callset_id) & there, F.col("version") == version).otherwise(F.col("is_current")))


def add_version(library: DataFrame, new: DataFrame) -> DataFrame:
    """library with new rows (callset_id, ...) as the current version of their callset, numbered one above the last."""
    last = library.groupBy("callset_id").agg(F.max("version").alias("_v"))
    fresh = new.join(last, "callset_id", "left").withColumns({"version": F.coalesce("_v", F.lit(0)) + 1, "is_current": F.lit(True)}).drop("_v")
    old = library.join(new.select("callset_id").distinct().withColumn("_new", F.lit(True)), "callset_id", "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(fresh.select(*old.columns))


def library_view(library: DataFrame) -> DataFrame:
    """callset_id, versions, current, datasets: newest version first."""
    rows = library.groupBy("callset_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("version")).alias("o"), "version", "is_current"))).alias("v"))
    return rows.select("callset_id", F.size("v").alias("versions"), F.filter("v", lambda x: x["is_current"])[0]["version"].alias("current"), F.transform("v", lambda x: x["version"]).alias("newest_first"))


def profile_hash(*columns: str) -> Column:
    """A stable digest of the settings that make imports comparable."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def profile_label(*columns: str) -> Column:
    return F.concat_ws(" · ", *[F.col(c).cast("string") for c in columns])


# --- phenotypes ---------------------------------------------------------------------------------------------------------


def age_parts(text: Column) -> Column:
    """struct(value, unit, years) of an age; without a unit it's in years; null out of 0 to 130 years or without a number."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(years?|y|months?|mo|weeks?|w|days?|d)?\s*$"
    unit = F.lower(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))
    value = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("double"))
    name = F.when(unit.isin("", "y"), "years").when(unit == "m", "months").when(unit == "w", "weeks").otherwise("days")
    years = F.when(name == "years", value).when(name == "months", value / 12).when(name == "weeks", value * 7 / 365.25).otherwise(value / 365.25)
    return F.when(years.between(0, 130), F.struct(value.alias("value"), name.alias("unit"), years.alias("years")))


def sex(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low.isin("m", "male", "1"), "male").when(low.isin("f", "female", "2"), "female").when(low == "", F.lit(None)).otherwise("other")


def values(text: Column) -> Column:
    """array of the different parts of a list in text, split at semicolon, bar and line end."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[;|\n]+"), lambda x: F.trim(x)), lambda x: x != ""))


def phenotype_upsert(old: DataFrame, new: DataFrame, mode: str = "update_nonblank") -> DataFrame:
    """Individuals (individual_id, sex, age, features array) after an import: update_nonblank, replace or skip_existing; lists are united on update."""
    a = old.select("individual_id", *[F.col(c).alias(f"_o_{c}") for c in ("sex", "age", "features")], F.lit(True).alias("_has"))
    b = new.select("individual_id", *[F.col(c).alias(f"_n_{c}") for c in ("sex", "age", "features")], F.lit(True).alias("_new"))
    j = a.join(b, "individual_id", "full_outer")
    both = F.col("_has").isNotNull() & F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if mode == "skip_existing":
            return F.when(F.col("_has").isNotNull(), o).otherwise(n)
        if mode == "replace":
            return F.when(F.col("_new").isNotNull(), n).otherwise(o)
        if c == "features":
            return F.when(both, F.array_sort(F.array_union(F.coalesce(o, F.array().cast("array<string>")), F.coalesce(n, F.array().cast("array<string>"))))).otherwise(F.coalesce(n, o))
        return F.coalesce(F.nullif(n, F.lit("")), o)

    return j.select("individual_id", *[pick(c).alias(c) for c in ("sex", "age", "features")])


def validate_links(links: DataFrame, samples: DataFrame) -> DataFrame:
    """links (individual_id, sample) with status: exact, suggestion (one sample in another case), ambiguous or unmatched; and the sample meant."""
    s = samples.select(F.col("sample_id")).distinct()
    exact = s.select(F.col("sample_id").alias("sample"), F.lit(True).alias("_exact"))
    loose = s.groupBy(F.lower(F.trim("sample_id")).alias("_low")).agg(F.count("*").alias("_n"), F.min("sample_id").alias("_guess"))
    out = links.join(exact, "sample", "left").join(loose, F.lower(F.trim("sample")) == F.col("_low"), "left")
    status = F.when(F.col("_exact"), "exact").when(F.col("_n") == 1, "suggestion").when(F.col("_n") > 1, "ambiguous").otherwise("unmatched")
    return out.select(*links.columns, status.alias("status"), F.when(F.col("_exact"), F.col("sample")).when(F.col("_n") == 1, F.col("_guess")).alias("sample_id"))


def repeated_individuals(rows: DataFrame) -> DataFrame:
    """individual_id, rows (sorted row numbers) of ids that an import names twice or more."""
    return rows.groupBy("individual_id").agg(F.array_sort(F.collect_list("row_no")).alias("rows")).filter(F.size("rows") > 1)


def search_individuals(individuals: DataFrame, text: str) -> DataFrame:
    """Individuals whose id, features, diagnosis or linked sample holds the text."""
    q = text.strip().lower()
    return individuals.filter(F.lower(F.concat_ws("\n", "individual_id", "features", "diagnosis", "sample_id")).contains(q))


def dataset_phenotypes(datasets: DataFrame, links: DataFrame, individuals: DataFrame) -> DataFrame:
    """Datasets with the individual behind their sample, null without a link."""
    return datasets.join(links.select("sample_id", "individual_id"), "sample_id", "left").join(individuals.drop("sample_id"), "individual_id", "left")
