"""Regulatory context: class codes of elements in biosamples, their summaries, and an ontology of contexts.

Codes come as a long table (row_index, sample_index, code), as its checks need it; `matrix` packs it to a row an element and reads that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scratch import scratch_path
from varloom.operators import intervals as I  # noqa: E741

#: Classes by code, and the family of each.
CLASSES = ("inactive", "PLS", "pELS", "dELS", "CA-H3K4me3", "CA-CTCF", "CA-TF", "CA", "TF")
FAMILIES = ("", "promoter", "enhancer", "enhancer", "h3k4me3", "ctcf", "tf", "accessibility", "tf")
#: Evidence tiers from the fullest, and assays that allow a specific class.
TIERS = ("full_classification", "partial_classification", "accessibility_only")
SPECIFIC_ASSAYS = ("H3K4me3", "H3K27ac", "CTCF")
#: Samples whose codes are gathered as columns of one row.
BLOCK = 32
#: Bases in a bin in which the elements of a context are ordered.
ISLAND_BIN = 1 << 16


def class_of(code: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), code)


def family_of(code: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in FAMILIES]), code)


def state(detected: Column, specific: Column, capability: Column | None = None) -> Column:
    """not_detected, mixed, classified, h3k4me3_associated, accessible_only or accessible_classification_unavailable.

    specific: array of the different families other than accessibility; capability: donors that could have a class.
    """
    n = F.size(specific)
    out = F.when(detected == 0, "not_detected").when(n > 1, "mixed").when((n == 1) & F.array_contains(specific, "h3k4me3"), "h3k4me3_associated").when(n == 1, "classified")
    return (out if capability is None else out.when(capability == 0, "accessible_classification_unavailable")).otherwise("accessible_only")


def representatives(profiles: DataFrame, tier: str = "evidence_tier") -> DataFrame:
    """One profile for each ontology term and donor: the fuller tier, then the lower index; the others as `duplicates`."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col(tier))
    rows = profiles.groupBy("ontology_id", "donor").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "sample_index", F.col(tier).alias("tier")))).alias("_p"))
    return rows.select("ontology_id", "donor", F.col("_p")[0]["sample_index"].alias("sample_index"), F.col("_p")[0]["tier"].alias("evidence_tier"), F.transform(F.slice("_p", 2, 1000), lambda p: p["sample_index"]).alias("duplicates"))


def capable(tier: Column) -> Column:
    """Whether a profile's assays can show a specific class."""
    return tier != "accessibility_only"


def curated_status(per: DataFrame) -> DataFrame:
    """row_index, ontology_id, status, discordant and evidence from counts: positive, classified, specific (families), in_group, capability."""
    many = lambda n: F.when(n >= 2, "replicated_").otherwise("single_")
    name = F.element_at("specific", 1)
    status = (
        F.when((F.col("positive") == 0) & (F.col("capability") == 0), "no_classifying_evidence_in_context")
        .when(F.col("positive") == 0, "not_detected")
        .when(F.col("classified") == 0, F.concat(many(F.col("positive")), F.lit("accessibility_only")))
        .when(F.size("specific") > 1, "mixed_specific_classes")
        .when(F.size("specific") == 1, F.concat(many(F.col("in_group")), name, F.when(name == "h3k4me3", "_associated").otherwise("_like")))
        .otherwise(F.concat(many(F.col("classified")), F.lit("accessibility_supported")))
    )
    evidence = F.when(F.col("capability") == 0, "unavailable").when(F.col("capability") == 1, "single_donor").otherwise("replicated")
    return per.select("row_index", "ontology_id", status.alias("status"), (F.size("specific") > 1).alias("discordant"), evidence.alias("evidence"))


def filter_contexts(sites: DataFrame, overlaps: DataFrame, contexts: DataFrame, wanted: list[str], mode: str = "any") -> DataFrame:
    """Sites with an overlapping element that is detected in any, or altogether in all, of the wanted contexts."""
    if not wanted or mode not in ("any", "all") or contexts.filter(F.col("ontology_id").isin(*wanted)).agg(F.countDistinct("ontology_id")).first()[0] < len(set(wanted)):
        raise ValueError("choose known contexts, and any or all")
    hits = overlaps.join(contexts.filter(F.col("ontology_id").isin(*wanted) & (F.col("detected") > 0)).select("row_index", "ontology_id"), "row_index")
    good = hits.groupBy("site_id").agg(F.countDistinct("ontology_id").alias("n")).filter(F.col("n") >= (1 if mode == "any" else len(set(wanted))))
    return sites.join(good, "site_id", "left_semi")


def context_islands(elements: DataFrame, contexts: DataFrame, wanted: list[str]) -> DataFrame:
    """ontology_id, chrom, start0, end0: what the elements (row_index, chrom, start0, end0) that each wanted context detects cover together.

    Elements that only touch stay apart, so that a site without a base between them is in neither.
    """
    if not wanted or contexts.filter(F.col("ontology_id").isin(*wanted)).agg(F.countDistinct("ontology_id")).first()[0] < len(set(wanted)):
        raise ValueError("choose known contexts, and any or all")
    on = contexts.filter(F.col("ontology_id").isin(*wanted) & (F.col("detected") > 0)).select("row_index", "ontology_id")
    rows = elements.join(on, "row_index").select("ontology_id", "chrom", "start0", "end0")
    return I.merged(rows, -1, ISLAND_BIN, ("ontology_id",)).unionByName(rows.filter("end0 <= start0").distinct())


def filter_sites(sites: DataFrame, elements: DataFrame, contexts: DataFrame, wanted: list[str], mode: str = "any") -> DataFrame:
    """Sites (site_id, chrom, start0, end0) with an overlapping element that is detected in any, or altogether in all, of the wanted contexts.

    A site meets what a context's elements cover together, not each element.
    """
    if mode not in ("any", "all"):
        raise ValueError("choose known contexts, and any or all")
    hits = I.overlaps(sites.select("site_id", "chrom", "start0", "end0"), context_islands(elements, contexts, wanted)).select("site_id", "ontology_id")
    good = hits.groupBy("site_id").agg(F.countDistinct("ontology_id").alias("n")).filter(F.col("n") >= (1 if mode == "any" else len(set(wanted))))
    return sites.join(good, "site_id", "left_semi")


def assay_capabilities(members: DataFrame) -> DataFrame:
    """ontology_id, donors, capable donors by tier."""
    return members.groupBy("ontology_id").agg(F.countDistinct("donor").alias("donors"), F.count_if(capable(F.col("evidence_tier"))).alias("any_specific"), F.count_if(F.col("evidence_tier") == TIERS[0]).alias("full"))


def selected_biosamples(assays: DataFrame) -> DataFrame:
    """name, tier, donor from rows (name, assay): full with all specific assays, partial with some, else accessibility only."""
    rows = assays.groupBy("name").agg(F.collect_set("assay").alias("a"))
    n = F.size(F.array_intersect("a", F.array(*[F.lit(x) for x in SPECIFIC_ASSAYS])))
    tier = F.when(n == len(SPECIFIC_ASSAYS), TIERS[0]).when(n > 0, TIERS[1]).otherwise(TIERS[2])
    return rows.filter(F.size("a") > 0).select("name", tier.alias("tier"), F.nullif(F.regexp_extract("name", r"donor[ _:]([A-Za-z0-9]+)", 1), F.lit("")).alias("donor"))


def curated_profiles(profiles: DataFrame) -> DataFrame:
    """profiles with exclusion reasons and baseline: rows need a donor, a term, and a tier above accessibility or a healthy state."""
    why = F.array_compact(F.array(F.when(F.col("donor").isNull(), "no_donor"), F.when(F.col("ontology_id").isNull(), "no_term"), F.when(F.col("treated"), "treated"), F.when(F.col("diseased"), "diseased")))
    return profiles.withColumn("reasons", why).withColumn("baseline", F.size("reasons") == 0)


def lineage_coverage(profiles: DataFrame) -> DataFrame:
    """lineage, source, eligible, donors, reasons (map of exclusion reason to profiles)."""
    a = profiles.groupBy("lineage").agg(F.count("*").alias("source"), F.count_if("baseline").alias("eligible"), F.countDistinct(F.when(F.col("baseline"), F.col("donor"))).alias("donors"))
    b = profiles.filter(~F.col("baseline")).select("lineage", F.explode("reasons").alias("reason")).groupBy("lineage", "reason").agg(F.count("*").alias("n"))
    b = b.groupBy("lineage").agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    return a.join(b, "lineage", "left")


def donor_dependence(members: DataFrame, closure: DataFrame) -> DataFrame:
    """parent, child, shared: donors that nested contexts share; members: term, donor; closure: term, ancestor."""
    m = members.select("term", "donor").distinct()
    pairs = closure.join(m.select("term").distinct(), "term", "left_semi").join(m.select(F.col("term").alias("ancestor")).distinct(), "ancestor", "left_semi")
    shared = pairs.join(m, "term").join(m.select(F.col("term").alias("ancestor"), "donor"), ["ancestor", "donor"]).groupBy("ancestor", "term").agg(F.countDistinct("donor").alias("shared"))
    return pairs.join(shared, ["ancestor", "term"], "left").select(F.col("ancestor").alias("parent"), F.col("term").alias("child"), F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def histograms(codes: DataFrame) -> DataFrame:
    """sample_index, code, elements, and copies: repeated (row, sample) pairs, which should be 0.

    Pairs meet as columns of a row an element and block of samples; the last column is of codes without a sample.
    """
    kind, n = codes.schema["sample_index"].dataType, F.col("sample_index")
    rows = codes.withColumns({"_block": F.floor(n / BLOCK), "_slot": F.coalesce(F.pmod(n, F.lit(BLOCK)), F.lit(BLOCK))})
    here = [F.col("_slot") == i for i in range(BLOCK + 1)]
    rows = rows.groupBy("row_index", "_block").agg(*[F.min(F.when(x, F.col("code"))).alias(f"_c{i}") for i, x in enumerate(here)], *[F.count_if(x).alias(f"_n{i}") for i, x in enumerate(here)])
    slots = [F.struct(((F.col("_block") * BLOCK + i).cast(kind) if i < BLOCK else F.lit(None).cast(kind)).alias("sample_index"), F.col(f"_c{i}").alias("code"), (F.col(f"_n{i}") - 1).alias("extra")) for i in range(BLOCK + 1)]
    pairs = rows.select(F.inline(F.array(*slots))).filter("extra >= 0")
    return pairs.groupBy("sample_index", "code").agg(F.count("*").alias("elements"), F.sum("extra").alias("copies"))


def histogram_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts that differ between two histograms, null where one has none."""
    x = a.select("sample_index", "code", F.col("elements").alias("a"))
    y = b.select("sample_index", "code", F.col("elements").alias("b"))
    return x.join(y, ["sample_index", "code"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def misaligned(actual: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned rows (row_index, digest) that are missing or differ."""
    return pinned.join(actual.select("row_index", F.col("digest").alias("_d")), "row_index", "left").filter(~F.col("digest").eqNullSafe(F.col("_d"))).select("row_index", F.col("_d").isNull().alias("missing"))


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """term, ancestor, for all pairs of an ontology (term, parent); cycles raise.

    Only pairs that the last round found are led on, by all pairs known so far, so that paths double with each round and no pair is
    extended twice from the same find. Parents that aren't terms themselves take part as ancestors. Pairs are written each round.
    """
    pairs = new = _kept(edges.select("term", F.col("parent").alias("ancestor")).distinct())
    for _ in range(most_rounds):
        if not new.filter("term = ancestor").isEmpty():
            raise ValueError("the ontology has a cycle")
        if new.isEmpty():
            return pairs
        ahead = new.select("term", F.col("ancestor").alias("mid")).join(pairs.select(F.col("term").alias("mid"), "ancestor"), "mid").select("term", "ancestor")
        behind = pairs.select("term", F.col("ancestor").alias("mid")).join(new.select(F.col("term").alias("mid"), "ancestor"), "mid").select("term", "ancestor")
        new = _kept(ahead.union(behind).distinct().join(pairs, ["term", "ancestor"], "left_anti"))
        pairs = _kept(pairs.union(new))
    raise ValueError("the ontology is too deep")


def _kept(pairs: DataFrame) -> DataFrame:
    """pairs, written to the shared folder and read back."""
    path = scratch_path(pairs.sparkSession, "closure")
    pairs.write.parquet(path)
    return pairs.sparkSession.read.schema(pairs.schema).parquet(path)


def direct_parents(pairs: DataFrame) -> DataFrame:
    """Of a closure the pairs without a term between them: the transitive reduction."""
    between = pairs.select("term", F.col("ancestor").alias("mid")).join(pairs.select(F.col("term").alias("mid"), "ancestor"), "mid").select("term", "ancestor").distinct()
    return pairs.join(between, ["term", "ancestor"], "left_anti")


def lineages(terms: DataFrame, pairs: DataFrame, roots: list[tuple[str, object]], fallback: list[tuple[str, str]] = ()) -> DataFrame:
    """term, lineage: the first of roots (name, term) that is the term or an ancestor; else the first pattern that fits its name."""
    own = pairs.select("term", "ancestor").union(terms.select("term", F.col("term").alias("ancestor")))
    order = F.coalesce(*[F.when(F.col("ancestor") == t, F.lit(i)) for i, (_, t) in enumerate(roots)])
    first = own.withColumn("_o", order).groupBy("term").agg(F.min("_o").alias("_o"))
    names = F.array(*[F.lit(n) for n, _ in roots])
    out = terms.join(first, "term", "left")
    text = F.coalesce(*[F.when(F.lower("name").rlike(p), F.lit(n)) for n, p in fallback]) if fallback else F.lit(None).cast("string")
    return out.select("term", F.coalesce(F.get(names, F.col("_o")), text, F.lit("other")).alias("lineage"))


def ordered_violations(rows: DataFrame, order: str, chunk: int = 1 << 17) -> DataFrame:
    """Rows of intervals (chrom, start0, end0) that are empty or begin before their predecessor in file order, a whole number.

    The order is cut in chunks of numbers. A chunk's first row meets the last start of the chunk before, of which there is one
    row a chunk, so that no task orders a whole chromosome.
    """
    cut = rows.withColumn("_c", F.floor(F.col(order) / chunk))
    tails = cut.groupBy("chrom", "_c").agg(F.max_by("start0", order).alias("_tail"))
    tails = tails.select("chrom", "_c", F.lag("_tail").over(Window.partitionBy("chrom").orderBy("_c")).alias("_prior"))
    own = F.lag("start0").over(Window.partitionBy("chrom", "_c").orderBy(order))
    cut = cut.join(tails, ["chrom", "_c"]).withColumn("_before", F.coalesce(own, "_prior"))
    why = F.when(F.col("end0") <= F.col("start0"), "empty").when(F.col("start0") < F.col("_before"), "unsorted")
    return cut.select(*rows.columns, why.alias("violation")).filter(F.col("violation").isNotNull())
