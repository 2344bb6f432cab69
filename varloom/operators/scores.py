"""Matching of score tables to annotated alleles, with an explicit status, and preparation of such tables.

A score is emitted only for an exact match; anything less says what it matched and gives provenance alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import fields as X


@dataclass(frozen=True)
class ScoreSpec:
    """How a score table is matched: allele columns, further dimensions in order, and the score columns.

    Dimension columns have the same names in queries and scores. snv_only leaves other alleles without a status.
    """

    allele: tuple[str, ...] = ("site_id",)
    dimensions: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ("score",)
    consequences: tuple[str, ...] = ()
    normal: tuple[tuple[str, str], ...] = ()  # dimension, one of NORMAL
    ranges: tuple[tuple[str, float | None, float | None], ...] = ()  # output, least, most


def _one_letter(text: Column) -> Column:
    p = X.protein_change(text)
    return F.when(p.isNotNull(), F.concat(p["ref"], p["position"].cast("string"), p["alt"])).otherwise(F.regexp_replace(text, r"^.*p\.", ""))


#: Ways to compare a dimension, by their names in a manifest.
NORMAL = {"exact": lambda c: c, "strip_version": lambda c: F.substring_index(c, ".", 1), "one_letter_protein_change": _one_letter}
NUMBERS = ("number", "integer")


def spec_of(manifest: dict) -> tuple[ScoreSpec, dict[str, str]]:
    """(spec, names: table column -> name in the spec) of a score table's manifest; a faulty manifest raises, before any table is read.

    Keys: table.columns; match.required (allele first) and match.dimensions (columns and normalisations; allele has chrom, position, reference
    and alternate); outputs (id, column, type, minimum, maximum); applicability.consequences.
    """

    def need(ok, what: str) -> None:
        if not ok:
            raise ValueError(f"score manifest: {what}")

    columns = manifest.get("table", {}).get("columns") or []
    need(columns and len(set(columns)) == len(columns), "table.columns must be different names")
    required, places = manifest.get("match", {}).get("required") or [], manifest.get("match", {}).get("dimensions") or {}
    need(required[:1] == ["allele"] and len(set(required)) == len(required), "match.required must begin with allele and repeat nothing")
    need(set(required) <= set(places), "each required dimension must have a place")
    names = {places["allele"].get(k): k for k in ("chrom", "position", "reference", "alternate")} | {places[d].get("column"): d for d in required[1:]}
    need(len(names) == 3 + len(required) and set(names) <= set(columns), "dimensions must have different columns of the table")
    normal = tuple((d, places[d].get("normalization") or "exact") for d in required[1:])
    need(all(n in NORMAL for _, n in normal), "a normalisation isn't known")
    outputs, ranges = manifest.get("outputs") or [], []
    need(outputs and len({o.get("id") for o in outputs}) == len(outputs), "outputs must have different ids")
    for o in outputs:
        low, high = o.get("minimum"), o.get("maximum")
        need(o.get("column") in columns and o.get("column") not in names, f"output {o.get('id')} must have a column of its own")
        need((low is None and high is None) or o.get("type") in NUMBERS, f"the range of {o.get('id')} needs a number")
        need(low is None or high is None or low <= high, f"the range of {o.get('id')} is empty")
        names[o["column"]] = o["id"]
        if low is not None or high is not None:
            ranges.append((o["id"], low, high))
    applies = manifest.get("applicability")
    terms = tuple((applies or {}).get("consequences") or ())
    need(applies is None or (terms and len(set(terms)) == len(terms)), "applicability.consequences must be different terms")
    return ScoreSpec(("chrom", "position", "reference", "alternate"), tuple(required[1:]), tuple(o["id"] for o in outputs), terms, normal, tuple(ranges)), names


def named(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """A score table with the columns of its manifest only, under the names of its spec."""
    return table.select(*[F.col(c).alias(n) for c, n in names.items()])


def out_of_range(scores: DataFrame, spec: ScoreSpec) -> DataFrame:
    """scores that break a stated range, with `outputs`, the names of those that do; a table should have none."""
    beyond = F.array_compact(F.array(*[F.when((F.col(o) < low if low is not None else F.lit(False)) | (F.col(o) > high if high is not None else F.lit(False)), F.lit(o)) for o, low, high in spec.ranges]))
    return scores.withColumn("outputs", beyond).filter(F.size("outputs") > 0) if spec.ranges else scores.withColumn("outputs", F.array().cast("array<string>")).limit(0)


def lookup(queries: DataFrame, scores: DataFrame, spec: ScoreSpec) -> DataFrame:
    """queries with status (exact, ambiguous, partial, or null without the allele), match, targets and the outputs.

    Exact: one record agrees in all dimensions. Ambiguous: several do, or the query lacks a dimension. Partial: the longest
    prefix of dimensions in which some record agrees. The records of an allele are one row, equal ones counted, so that each
    query row meets one row at most and none is grouped afterwards.
    """
    asked = queries.filter(F.arrays_overlap(F.split("consequence", "&"), F.array(*[F.lit(x) for x in spec.consequences]))) if spec.consequences else queries
    normal = dict(spec.normal)
    same = {d: NORMAL[normal.get(d, "exact")] for d in spec.dimensions}
    names = {c: f"_s_{c}" for c in (*spec.allele, *spec.dimensions, *spec.outputs)}
    allele, dims = [names[c] for c in spec.allele], [names[c] for c in spec.dimensions]
    s = scores.select(*[F.col(c).alias(n) for c, n in names.items()])
    s = s.groupBy(*dict.fromkeys((*allele, *dims))).agg(F.count("*").alias("_n"), *[F.max(names[c]).alias(f"_max_{c}") for c in spec.outputs])
    record = F.struct(*[same[d](F.col(names[d])).alias(f"_d_{d}") for d in spec.dimensions], "_n", *[f"_max_{c}" for c in spec.outputs])
    target = F.concat_ws(":", *[F.col(d).cast("string") for d in dims])
    s = s.groupBy(*allele).agg(F.collect_list(record).alias("_found"), F.array_sort(F.collect_set(target)).alias("_targets"))
    on = F.lit(True)
    for c in spec.allele:
        on &= F.col(c) == F.col(names[c])

    def prefix(record: Column) -> Column:
        n, agrees = F.lit(0), F.lit(True)
        for d in spec.dimensions:
            agrees &= F.coalesce(F.col(f"_q_{d}") == record[f"_d_{d}"], F.lit(False))
            n = n + agrees.cast("int")
        return n

    missing = F.lit(False)
    for d in spec.dimensions:
        missing |= F.col(d).isNull()
    # sorted, not broadcast: a score table is large, however small its files look to the planner
    found = asked.withColumns({f"_q_{d}": same[d](F.col(d)) for d in spec.dimensions}).join(s.hint("merge"), on, "left").withColumn("_p", F.transform("_found", prefix))
    full = F.filter("_found", lambda r, i: F.get("_p", i) == len(spec.dimensions))
    found = found.withColumns({"_best": F.array_max("_p"), "_exact": full})
    n = F.aggregate("_exact", F.lit(0).cast("long"), lambda n, r: n + r["_n"])
    labels = F.array(F.lit("allele_only"), *[F.lit("_".join(("allele", *spec.dimensions[: k + 1]))) for k in range(len(spec.dimensions))])
    met = F.col("_best").isNotNull()
    status = F.when(met & (missing | (n > 1)), "ambiguous").when(met & (n == 1), "exact").when(met, "partial")
    match = F.when(met & missing, "query_target_unavailable").when(met & (n > 1), "multiple_exact_records").when(met, F.element_at(labels, F.col("_best") + 1))
    out = found.withColumns({"status": status, "match": match, "targets": F.coalesce("_targets", F.array().cast("array<string>"))})
    value = lambda c: F.array_max(F.transform("_exact", lambda r: r[f"_max_{c}"]))
    return out.select(*asked.columns, "status", "match", "targets", *[F.when(F.col("status") == "exact", value(c)).alias(c) for c in spec.outputs])


def by_version_or_base(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """queries (site_id, transcript) with the score of the exact transcript version, else of the base if the site has just one record of it."""
    exact = scores.groupBy("site_id", "transcript").agg(F.max("score").alias("_exact"), F.count("*").alias("_n"))
    base = scores.groupBy("site_id", F.substring_index("transcript", ".", 1).alias("_base")).agg(F.max("score").alias("_by_base"), F.count("*").alias("_m"))
    out = queries.withColumn("_base", F.substring_index("transcript", ".", 1)).join(exact, ["site_id", "transcript"], "left").join(base, ["site_id", "_base"], "left")
    how = F.when(F.col("_n") == 1, "exact_version").when(F.col("_n").isNull() & (F.col("_m") == 1), "unique_base").when(F.col("_m").isNotNull(), "ambiguous")
    out = out.withColumn("match", how).withColumn("score", F.when(how == "exact_version", F.col("_exact")).when(how == "unique_base", F.col("_by_base")))
    return out.drop("_base", "_exact", "_n", "_by_base", "_m")


def by_symbol(queries: DataFrame, scores: DataFrame, symbols: DataFrame) -> DataFrame:
    """queries (site_id, gene_id) with the score of a symbol (scores: site_id, symbol, score) through a map symbol -> gene_id.

    Symbols of several genes are left out; a score counts only if all the gene's symbols at the site agree.
    """
    sure = symbols.groupBy("symbol").agg(F.countDistinct("gene_id").alias("_n"), F.min("gene_id").alias("gene_id")).filter("_n = 1").drop("_n")
    known = scores.join(sure, "symbol").groupBy("site_id", "gene_id").agg(F.countDistinct("score").alias("_n"), F.max("score").alias("score"))
    return queries.join(known.filter("_n = 1").drop("_n"), ["site_id", "gene_id"], "left")


def resolved(scores: DataFrame, key: list[str], canonical: str, exact: str, value: str = "score") -> DataFrame:
    """One score for each key: canonical rows come first, then exact ones; a tier whose values disagree is withheld, never decided by size."""
    tier = F.when(F.col(canonical), 0).when(F.col(exact), 1).otherwise(2)
    ranked = scores.withColumn("_tier", tier).withColumn("_top", F.dense_rank().over(Window.partitionBy(*key).orderBy("_tier"))).filter("_top = 1")
    out = ranked.groupBy(*key).agg(F.countDistinct(value).alias("_n"), F.max(value).alias(value), F.min("_tier").alias("tier"))
    return out.withColumn("conflict", F.col("_n") > 1).withColumn(value, F.when(F.col("_n") == 1, F.col(value))).drop("_n")


def best_prediction(rows: DataFrame, key: list[str], status: str, order: str) -> DataFrame:
    """One row a key: an exact observation before others, the later one otherwise."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy((F.col(status) == "exact").desc(), F.desc(order)))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def classified(rows: DataFrame, thresholds: DataFrame, value: str = "score") -> DataFrame:
    """rows (predictor, value) with damaging by the predictor's threshold and direction: higher, lower or absolute."""
    v, t = F.col(value), F.col("threshold")
    test = F.when(F.col("direction") == "higher", v >= t).when(F.col("direction") == "lower", v <= t).when(F.col("direction") == "absolute", F.abs(v) >= t)
    return rows.join(thresholds, "predictor").withColumn("damaging", test)


@dataclass(frozen=True)
class Predictor:
    """One entry of a registry: where a value comes from, how it's matched, and in which range it makes sense."""

    name: str
    column: str
    least: float | None = None
    most: float | None = None
    scope: str = "allele"  # or transcript
    bind: bool = True
    priority: int = 0
    threshold: float | None = None
    direction: str = "higher"


def checked_registry(predictors: list[Predictor]) -> list[Predictor]:
    """The list by falling priority, then name; raises for repeated names, unknown scopes or directions, and empty ranges."""
    names = [p.name for p in predictors]
    for p in predictors:
        if names.count(p.name) > 1 or p.scope not in ("allele", "transcript") or p.direction not in ("higher", "lower", "absolute"):
            raise ValueError(f"bad registry entry {p.name}")
        if p.least is not None and p.most is not None and p.least > p.most:
            raise ValueError(f"empty range of {p.name}")
    return sorted(predictors, key=lambda p: (-p.priority, p.name))


def observations(annotations: DataFrame, predictors: list[Predictor], installed: tuple[str, ...] | None = None) -> DataFrame:
    """Long form: a row for each annotation row and predictor with a value: predictor, value, status, invalid, target.

    A value outside of its range is dropped and named in `invalid`; the row stays. A transcript-scoped predictor without a
    transcript is partial and its value withheld. Predictors that aren't installed give no row; `source_status` names them.
    """
    out = []
    for p in checked_registry(predictors):
        if p.column not in annotations.columns or (installed is not None and p.name not in installed):
            continue
        v = F.col(p.column).cast("double")
        bad = F.lit(False) if p.least is None else v < p.least
        bad = bad if p.most is None else bad | (v > p.most)
        lacks = F.col("transcript").isNull() if p.scope == "transcript" else F.lit(False)
        target = F.col("transcript") if p.scope == "transcript" else F.lit("")
        out.append(F.when(v.isNotNull(), F.struct(F.lit(p.name).alias("predictor"), F.when(~bad & ~lacks, v).alias("value"), F.when(lacks, "partial").otherwise("exact").alias("status"), F.when(bad, F.lit(p.column)).otherwise("").alias("invalid"), target.alias("target"))))
    if not out:
        return annotations.limit(0).select("site_id", "k", *[F.lit(None).cast(t).alias(n) for n, t in (("predictor", "string"), ("value", "double"), ("status", "string"), ("invalid", "string"), ("target", "string"))])
    return annotations.select("site_id", "k", F.inline(F.array_compact(F.array(*out))))


def source_status(predictors: list[Predictor], columns: list[str], installed: tuple[str, ...], required: tuple[str, ...] = ()) -> dict[str, str]:
    """Predictor -> READY, SKIPPED_NOT_INSTALLED or NO_COLUMN; a required one that is missing raises."""
    out = {}
    for p in predictors:
        out[p.name] = "SKIPPED_NOT_INSTALLED" if p.name not in installed else "READY" if p.column in columns else "NO_COLUMN"
        if p.name in required and out[p.name] != "READY":
            raise ValueError(f"{p.name} is required: {out[p.name]}")
    return out


def metric_filter(observed: DataFrame, predictor: str, op: str, limit: float) -> DataFrame:
    """Observations of a predictor whose numeric value compares as asked; no value, no match."""
    v = F.col("value")
    tests = {"=": v == limit, "!=": v != limit, "<": v < limit, "<=": v <= limit, ">": v > limit, ">=": v >= limit}
    if op not in tests:
        raise ValueError(f"unknown comparison {op}")
    return observed.filter((F.col("predictor") == predictor) & F.coalesce(tests[op], F.lit(False)))


def pivot_alts(rows: DataFrame, key: list[str]) -> DataFrame:
    """key with columns A, C, G, T from rows (alt, score), and complete: whether three ALTs have a score."""
    wide = rows.groupBy(*key).pivot("alt", ["A", "C", "G", "T"]).agg(F.max("score"))
    n = sum((F.col(a).isNotNull().cast("int") for a in "ACGT"), F.lit(0))
    return wide.withColumn("complete", n == 3)


def per_position(rows: DataFrame) -> DataFrame:
    """chrom, pos, ref, alts: sorted array<struct<alt, score>>, complete if there are just three different ALTs, none the reference."""
    grouped = rows.groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_set(F.struct("alt", "score"))).alias("alts"))
    return grouped.withColumn("complete", (F.size("alts") == 3) & (F.size(F.array_distinct(F.transform("alts", lambda a: a["alt"]))) == 3) & ~F.exists("alts", lambda a: a["alt"] == F.col("ref")))


def first_transcript_of_tss(rows: DataFrame) -> DataFrame:
    """One transcript for each (chrom, tss, strand): the first in source order."""
    return rows.groupBy("chrom", "tss", "strand").agg(F.min_by("tx_id", "source_ordinal").alias("tx_id"), F.count("*").alias("transcripts"))


def parse_splice(text: Column) -> Column:
    """array<struct<allele, symbol, delta>> of ALLELE|SYMBOL|four deltas|...; entries with a delta outside 0..1 are left out."""
    def one(x: Column) -> Column:
        p = F.split(x, r"\|")
        deltas = F.transform(F.slice(p, 3, 4), X.strict_decimal)
        return F.struct(p[0].alias("allele"), p[1].alias("symbol"), F.array_max(deltas).alias("delta"), F.forall(deltas, lambda d: d.between(0, 1)).alias("ok"))

    return F.filter(F.transform(F.split(text, ","), one), lambda s: F.coalesce(s["ok"], F.lit(False)))


def probability_violations(rows: DataFrame, classes: dict[str, str], label: str) -> DataFrame:
    """Rows whose class probabilities don't sum to 1 or whose label isn't that of the largest one; classes: label -> column."""
    cols = list(classes.values())
    total = sum((F.col(c) for c in cols), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(name).alias("n")) for name, c in classes.items()]))
    why = F.array_compact(F.array(F.when(F.abs(total - 1) > 1e-6, "sum"), F.when(best["n"] != F.col(label), "label")))
    return rows.withColumn("violations", why).filter(F.size("violations") > 0)


def promoter_status(score: Column, transcript: Column, tss: Column, strand: Column) -> Column:
    """exact with one number of each kind and a strand; partial with some; unmatched with none. Several different numbers are none."""
    one = lambda c: F.size(F.array_distinct(X.numbers(c))) == 1
    whole = one(score) & one(tss) & strand.isin("+", "-", "1", "-1") & X.present(transcript).isNotNull()
    some = X.present(score).isNotNull() | X.present(tss).isNotNull() | X.present(transcript).isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)), "exact").when(some, "partial").otherwise("unmatched")


def phred(text: Column) -> Column:
    """A phred-like score: one plain decimal, not negative."""
    v = X.strict_decimal(text)
    return F.when(v >= 0, v)


#: Markers of a withheld score, and names that a contig may have.
WITHHELD = ("", ".", "na", "n/a", "nan")
CONTIG = r"^([1-9]|1[0-9]|2[0-2]|X|Y|MT)$"


def gene_scores(rows: DataFrame, scores: list[str], allele: str = "variant", gene: str = "gene") -> DataFrame:
    """chrom, pos, ref, alt, gene, the scores as text and `reason` for rows of a gene-level score table with ids chrom-pos-ref-alt.

    Only the named scores are kept; a withheld one is a dot. reason names the first rule that a row breaks, null if none: a
    known contig, a whole position from 1 on, one base changed into another, an Ensembl gene id (its version is dropped), and
    scores from 0 to 1.
    """
    parts = F.split(F.col(allele), "-", -1)
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    plain = F.regexp_replace(F.trim(part(0)), "(?i)^chr", "")
    chrom = F.when(F.upper(plain) == "M", "MT").when(F.upper(plain).isin("X", "Y", "MT"), F.upper(plain)).otherwise(plain)
    pos, ref, alt = F.trim(part(1)).try_cast("long"), F.upper(part(2)), F.upper(part(3))
    kept = {c: F.when(F.lower(F.trim(c)).isin(*WITHHELD) | F.col(c).isNull(), ".").otherwise(F.trim(c)) for c in scores}
    bad = lambda c: (kept[c] != ".") & ~F.coalesce(kept[c].try_cast("double").between(0, 1), F.lit(False))
    base = lambda x: x.isin("A", "C", "G", "T")
    reason = F.when(F.coalesce(F.size(parts), F.lit(0)) != 4, "variant id").when(~chrom.rlike(CONTIG), "contig").when(F.coalesce(pos, F.lit(0)) < 1, "position").when(~base(ref) | ~base(alt) | (ref == alt), "not a single base")
    reason = reason.when(~F.coalesce(F.col(gene).rlike(r"^ENSG[0-9]{11}([.][0-9]+)?$"), F.lit(False)), "gene")
    for c in scores:
        reason = reason.when(bad(c), f"score {c}")
    return rows.select(chrom.alias("chrom"), pos.alias("pos"), ref.alias("ref"), alt.alias("alt"), F.substring_index(gene, ".", 1).alias("gene"), *[v.alias(c) for c, v in kept.items()], reason.alias("reason"))


def prepared_gene_scores(rows: DataFrame, scores: list[str], allele: str = "variant", gene: str = "gene", partitions: int | None = None) -> DataFrame:
    """`gene_scores` as a table in ranges of place, sorted within; a row that breaks a rule or repeats an allele and gene stops the job."""
    key = ["chrom", "pos", "ref", "alt", "gene"]
    read = gene_scores(rows, scores, allele, gene)
    firm = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("a score row is invalid: "), "reason")).cast("string")).otherwise(F.col("chrom"))
    once = read.withColumn("chrom", firm).groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in scores])
    once = once.withColumn("gene", F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("an allele and gene are repeated:"), "chrom", F.col("pos").cast("string"), "gene")).cast("string")).otherwise(F.col("gene")))
    order = [F.when(F.col("chrom").rlike("^[0-9]+$"), F.col("chrom").cast("int")).otherwise(F.array_position(F.array(F.lit("X"), F.lit("Y"), F.lit("MT")), F.col("chrom")) + 22), "pos"]
    ranged = once.drop("_n").withColumn("_o", order[0])
    ranged = ranged.repartitionByRange(partitions, "_o", "pos") if partitions else ranged.repartitionByRange("_o", "pos")
    return ranged.sortWithinPartitions("_o", "pos", "ref", "alt", "gene").drop("_o")
