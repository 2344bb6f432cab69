"""The matrix of elements and biosamples as packed rows: one row an element, a byte a biosample.

`pack` groups the long table of codes once; what reads the matrix afterwards works within its row, by array expressions, without a shuffle: counts, states
and summaries of an element and of each of its contexts. Contexts and their members are a dimension of some thousand rows at most, which
takes part as one constant.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators import regulatory as R

#: Profiles that contexts may have together; more are an error, as they go into the plan.
MOST_MEMBERS = 100_000
CONTEXTS = "array<struct<ontology_id:string,members:array<struct<donor:string,sample:int,capable:boolean>>>>"


def pack(codes: DataFrame, samples: int) -> DataFrame:
    """row_index, codes (array<tinyint>, one a sample, null where none was read), digest. Of codes repeated for a pair the least counts.

    A task keeps a row an element and block of samples, with a column a sample, not a row a pair.
    """
    n = F.when(F.col("sample_index").between(0, samples - 1), F.col("sample_index"))
    rows = codes.withColumns({"_block": F.coalesce(F.floor(n / R.BLOCK), F.lit(0)), "_slot": F.pmod(n, F.lit(R.BLOCK))})
    rows = rows.groupBy("row_index", "_block").agg(*[F.min(F.when(F.col("_slot") == i, F.col("code"))).cast("tinyint").alias(f"_{i}") for i in range(min(samples, R.BLOCK))])
    own = F.array(*[F.col(f"_{i}") for i in range(min(samples, R.BLOCK))])
    if samples <= R.BLOCK:
        out = rows.select("row_index", own.alias("codes"))
    else:
        rows = rows.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_block").cast("int"), own))).alias("m"))
        none = F.array_repeat(F.lit(None).cast("tinyint"), R.BLOCK)
        blocks = F.transform(F.sequence(F.lit(0), F.lit((samples - 1) // R.BLOCK)), lambda b: F.coalesce(F.element_at("m", b), none))
        out = rows.select("row_index", F.slice(F.flatten(blocks), 1, samples).alias("codes"))
    return out.withColumn("digest", F.sha2(F.array_join(F.transform("codes", lambda c: c.cast("string")), ",", "."), 256))


def _family(code: Column) -> Column:
    return R.family_of(code.cast("int"))


def _specific(codes: Column) -> Column:
    """The different families of an array of codes other than none and accessibility."""
    families = F.transform(codes, _family)
    return F.array_distinct(F.filter(families, lambda f: (f != "") & (f != "accessibility")))


def _read(codes: Column) -> Column:
    return F.filter(codes, lambda c: c.isNotNull())


def _some(codes: Column) -> Column:
    return F.filter(codes, lambda c: c > 0)


def element_states(packed: DataFrame) -> DataFrame:
    """row_index, samples, detected, state."""
    rows = packed.select("row_index", _read(F.col("codes")).alias("c"))
    detected = F.size(_some(F.col("c"))).cast("long")
    return rows.filter(F.size("c") > 0).select("row_index", F.size("c").cast("long").alias("samples"), detected.alias("detected"), R.state(detected, _specific(F.col("c"))).alias("state"))


def tissue_evidence(packed: DataFrame) -> DataFrame:
    """row_index, sample_index, class, state of each biosample by itself."""
    rows = packed.select("row_index", F.posexplode("codes").alias("sample_index", "code")).filter("code IS NOT NULL")
    return rows.select("row_index", F.col("sample_index").cast("long").alias("sample_index"), R.class_of(F.col("code").cast("int")).alias("class"), R.state((F.col("code") > 0).cast("int"), _specific(F.array("code"))).alias("state"))


def _contexts(members: DataFrame) -> Column:
    """The constant of all contexts from members (ontology_id, donor, sample_index, evidence_tier)."""
    rows = members.select("ontology_id", "donor", F.col("sample_index").cast("int").alias("sample"), R.capable(F.col("evidence_tier")).alias("capable")).limit(MOST_MEMBERS + 1).collect()
    if len(rows) > MOST_MEMBERS:
        raise ValueError(f"contexts have more than {MOST_MEMBERS} profiles")
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r.ontology_id, r.sample)):
        found.setdefault(r.ontology_id, []).append({"donor": r.donor, "sample": r.sample, "capable": r.capable})
    return F.from_json(F.lit(json.dumps([{"ontology_id": k, "members": m} for k, m in found.items()])), CONTEXTS)


def by_context(packed: DataFrame, members: DataFrame) -> DataFrame:
    """row_index, ontology_id, own: array<struct<donor, capable, code>> of the context's profiles that were read for the element; contexts without any aren't there."""
    rows = packed.select("row_index", "codes", F.explode(_contexts(members)).alias("x"))
    own = F.transform("x.members", lambda m: F.struct(m["donor"].alias("donor"), m["capable"].alias("capable"), F.get("codes", m["sample"]).alias("code")))
    return rows.select("row_index", "x.ontology_id", F.filter(own, lambda m: m["code"].isNotNull()).alias("own")).filter(F.size("own") > 0)


def _count(own: Column, test) -> Column:
    return F.size(F.filter(own, test)).cast("long")


def context_evidence(packed: DataFrame, members: DataFrame) -> DataFrame:
    """row_index, ontology_id, donors, detected, capability, state, classes (map of class to profiles) of each context."""
    own = F.col("own")
    donors = lambda a: F.size(F.array_distinct(F.transform(a, lambda m: m["donor"]))).cast("long")
    classes = F.transform(own, lambda m: R.class_of(m["code"].cast("int")))
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(classes)), lambda k: F.struct(k, F.size(F.filter(classes, lambda c: c == k)).cast("long"))))
    out = by_context(packed, members).select(
        "row_index", "ontology_id", donors(own).alias("donors"), donors(F.filter(own, lambda m: m["code"] > 0)).alias("detected"), _count(own, lambda m: m["capable"]).alias("capability"), _specific(F.transform(own, lambda m: m["code"])).alias("_s"), counted.alias("classes")
    )
    return out.select("row_index", "ontology_id", "donors", "detected", "capability", "classes", R.state(F.col("detected"), F.col("_s"), F.col("capability")).alias("state"))


def curated_summary(packed: DataFrame, members: DataFrame) -> DataFrame:
    """row_index, ontology_id, status, discordant, evidence: whether detection and class are replicated among donors."""
    own = F.col("own")
    can = F.filter(own, lambda m: m["capable"] & (m["code"] > 0))
    per = by_context(packed, members).select(
        "row_index", "ontology_id", _count(own, lambda m: m["code"] > 0).alias("positive"), F.size(can).cast("long").alias("classified"), _specific(F.transform(can, lambda m: m["code"])).alias("specific"),
        _count(can, lambda m: _family(m["code"]) != "accessibility").alias("in_group"), _count(own, lambda m: m["capable"]).alias("capability"),
    )
    return R.curated_status(per)


def element_summary(packed: DataFrame, members: DataFrame) -> DataFrame:
    """row_index, contexts, donors: of elements that some context detects, in how many contexts and donors."""
    found = F.transform(_contexts(members), lambda x: F.struct(x["ontology_id"].alias("o"), F.transform(F.filter(x["members"], lambda m: F.coalesce(F.get("codes", m["sample"]) > 0, F.lit(False))), lambda m: m["donor"]).alias("d")))
    rows = packed.select("row_index", F.filter(found, lambda x: F.size(x["d"]) > 0).alias("f")).filter(F.size("f") > 0)
    return rows.select("row_index", F.size("f").cast("long").alias("contexts"), F.size(F.array_distinct(F.flatten(F.transform("f", lambda x: x["d"])))).cast("long").alias("donors"))


def overlap_summary(packed: DataFrame, members: DataFrame) -> DataFrame:
    """row_index with how many tissues and contexts detect it, and how many contexts are mixed; elements that no context has read aren't there."""
    own = F.transform(_contexts(members), lambda x: _read(F.transform(x["members"], lambda m: F.get("codes", m["sample"]))))
    rows = packed.select("row_index", _read(F.col("codes")).alias("c"), F.filter(own, lambda x: F.size(x) > 0).alias("own")).filter(F.size("own") > 0)
    counts = {
        "tissues_detected": _some(F.col("c")), "tissues": F.col("c"), "contexts_detected": F.filter("own", lambda x: F.size(_some(x)) > 0),
        "contexts": F.col("own"), "mixed": F.filter("own", lambda x: F.size(_specific(x)) > 1),
    }
    return rows.select("row_index", *[F.size(a).cast("long").alias(name) for name, a in counts.items()])
