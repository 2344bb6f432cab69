"""Observations of predictors from annotation rows by a table of rules, one entry a source, compiled to column expressions.

A rule says which metrics a source has, what makes its match exact, which values an inexact match withholds, from which columns the target of the
observation comes, which parts of it are needed, and when the observation belongs to the annotation row itself. No row runs through Python, and all
sources are read in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import alleles as A
from varloom.functions import fields as X

STATUSES = ("exact", "partial", "ambiguous", "unmatched")
#: Scopes whose exact observations belong to annotation rows, and texts that mean that there's nothing.
BOUND = ("allele_transcript", "allele_transcript_protein", "allele_transcript_tss_strand", "transcript_consequence", "gene_protein_residue")
SCOPES = ("allele", "allele_gene", "allele_gene_symbol", *BOUND, "interval")
NOTHING = ("", ".", "-")
VARIANT = ("chromosome", "position", "reference", "alternate")
#: What a part of a target must look like; other texts make it invalid.
SHAPES = {"ensembl_transcript": r"^ENST[0-9]+(\.[0-9]+)?$", "ensembl_gene": r"^ENSG[0-9]+(\.[0-9]+)?$", "protein_position": r"^[1-9][0-9]*$", "strand": r"^([+-]|1|-1)$", "tss_position": r"^[1-9][0-9]*$"}


@dataclass(frozen=True)
class Metric:
    """A value of a source: the columns to look in, in order; its kind (number, integer, text or boolean); filterable ones are values, others say where a value comes from."""

    name: str
    columns: tuple[str, ...]
    kind: str = "number"
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] = ()
    filterable: bool = True


@dataclass(frozen=True)
class Rule:
    """status: conditions in order, each (test, argument, status): stated (a metric holds a status), matches (the metric `match` is one of some), both (a metric is
    there and `match` is one of some), any (some metric is there), flag (a boolean metric is true), else. withheld: metrics that an inexact match withholds, None for all.
    target: dimension -> column. transcript_version: the target keeps a version if `match` is exact_version. same: columns of row and source that must agree for a binding."""

    predictor: str
    resource: str
    scope: str
    metrics: tuple[Metric, ...]
    status: tuple[tuple[str, tuple[str, ...], str], ...] = (("else", (), "exact"),)
    withheld: tuple[str, ...] | None = ()
    target: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()
    transcript_version: bool = False
    same: tuple[tuple[str, str], ...] = ()


def checked(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules; raises for repeated names, unknown scopes, kinds, tests or statuses, and for a required part without a column."""
    names = [r.predictor for r in rules]
    for r in rules:
        metrics = {m.name for m in r.metrics}
        bad = names.count(r.predictor) > 1 or r.scope not in SCOPES or len(metrics) < len(r.metrics) or not set(r.required) <= {d for d, _ in r.target}
        bad |= any(m.kind not in ("number", "integer", "text", "boolean") or (m.least is not None and m.most is not None and m.least > m.most) for m in r.metrics)
        bad |= any(test not in ("stated", "matches", "both", "any", "flag", "else") or (test != "stated" and status not in STATUSES) for test, _, status in r.status)
        bad |= r.withheld is not None and not set(r.withheld) <= metrics
        if bad:
            raise ValueError(f"bad rule of {r.predictor}")
    return rules


def _text(column: str) -> Column:
    text = F.trim(F.col(column).cast("string"))
    return F.when(~text.isin(*NOTHING), text)


def _typed(m: Metric) -> tuple[Column, Column]:
    """(value as text in its normal form, null if absent or malformed; whether it's there but malformed)."""
    raw = F.coalesce(*[_text(c) for c in m.columns])
    if m.kind == "boolean":
        value = F.when(F.lower(raw).isin("1", "true", "yes"), "true").when(F.lower(raw).isin("0", "false", "no"), "false")
    elif m.kind == "text":
        value = F.when(raw.isin(*m.allowed), raw) if m.allowed else raw
    else:
        n = raw.try_cast("double")
        good = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
        for limit, beyond in ((m.least, lambda x: n < x), (m.most, lambda x: n > x)):
            good = good if limit is None else good & ~beyond(limit)
        value = F.when(good & (F.lit(m.kind == "number") | (n == F.floor(n))), F.when(F.lit(m.kind == "number"), n.cast("string")).otherwise(F.floor(n).cast("string")))
    return value, raw.isNotNull() & value.isNull()


def _status(rule: Rule, values: dict[str, Column]) -> Column:
    get = lambda name: values.get(name, F.lit(None).cast("string"))
    out = None
    for test, args, status in rule.status:
        if test == "stated":
            said = F.lower(get(args[0]))
            ok, then = F.coalesce(said.isin(*STATUSES), F.lit(False)), said
        else:
            match = F.coalesce(F.lower(get("match")).isin(*args[1:] if test == "both" else args), F.lit(False)) if args else F.lit(True)
            ok = {
                "matches": lambda m=match: m, "both": lambda a=args, m=match: get(a[0]).isNotNull() & m, "any": lambda a=args: reduce(lambda x, y: x | y, [get(n).isNotNull() for n in a]),
                "flag": lambda a=args: F.coalesce(get(a[0]) == "true", F.lit(False)), "else": lambda: F.lit(True),
            }[test]()
            then = F.lit(status)
        out = F.when(ok, then) if out is None else out.when(ok, then)
    return out.otherwise("unmatched")


def _target(rule: Rule, exact_version: Column) -> tuple[dict[str, Column], list[Column]]:
    """(dimension -> text, '' if invalid or absent; names of invalid ones)."""
    parts, invalid = {}, []
    for dimension, column in rule.target:
        text = F.coalesce(_text(column), F.lit(""))
        if dimension == "protein_position" and column.endswith(":hgvsp"):
            text = F.coalesce(X.protein_change(F.col(column.split(":")[0]))["position"].cast("string"), F.lit(""))
        elif dimension == "amino_acid_change":
            p = X.protein_change(F.col(column.split(":")[0]))
            text = F.when(p.isNotNull(), F.concat(p["ref"], p["position"].cast("string"), p["alt"])).otherwise("")
        elif dimension == "strand":
            text = F.coalesce(F.trim(F.col(column)), F.lit(""))
        shape = SHAPES.get(dimension)
        bad = (text != "") & ~text.rlike(shape) if shape else F.lit(False)
        if dimension == "ensembl_transcript":
            kept = exact_version if rule.transcript_version else F.lit(False)
            text = F.when(kept, text).otherwise(A.stable_id(text))
        parts[dimension] = F.when(bad, "").otherwise(text)
        invalid.append(F.when(bad, F.lit(dimension)))
    return parts, invalid


def _names(columns: list[Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*columns))) if columns else F.array().cast("array<string>")


def _prepared(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with a column for each typed metric, then for each status and part of a target, so that no expression is written out twice."""
    typed = {}
    for r in rules:
        for m in r.metrics:
            typed[f"_v_{r.predictor}_{m.name}"], typed[f"_b_{r.predictor}_{m.name}"] = _typed(m)
    rows, made = rows.withColumns(typed), {}
    for r in rules:
        values = {m.name: F.col(f"_v_{r.predictor}_{m.name}") for m in r.metrics}
        made[f"_s_{r.predictor}"] = _status(r, values)
        made[f"_e_{r.predictor}"] = exact = F.coalesce(F.lower(values.get("match", F.lit(None).cast("string"))) == "exact_version", F.lit(False))
        parts, invalid = _target(r, exact)
        made |= {f"_t_{r.predictor}_{d}": c for d, c in parts.items()} | {f"_x_{r.predictor}_{d}": c for (d, _), c in zip(r.target, invalid, strict=True)}
    return rows.withColumns(made)


def _observation(rule: Rule) -> Column:
    p = rule.predictor
    values = {m.name: F.col(f"_v_{p}_{m.name}") for m in rule.metrics}
    malformed = [F.when(F.col(f"_b_{p}_{m.name}"), F.lit(m.name)) for m in rule.metrics]
    there = reduce(lambda a, b: a | b, [v.isNotNull() for v in values.values()])
    status, exact_version = F.col(f"_s_{p}"), F.col(f"_e_{p}")
    target, invalid = {d: F.col(f"_t_{p}_{d}") for d, _ in rule.target}, [F.col(f"_x_{p}_{d}") for d, _ in rule.target]
    missing = [F.when(target[d].isin("", "."), F.lit(d)) for d in rule.required]
    no_target, n_missing = F.size(_names(invalid)) > 0, F.size(_names(missing)) > 0
    final = F.when(no_target, "partial").when((status == "exact") & n_missing, "partial").otherwise(status)
    everything = no_target | ((status == "exact") & n_missing)  # an exact match without its target keeps nothing
    kept, withheld, about = [], [], []
    for m in rule.metrics:
        v = values[m.name]
        if not m.filterable:
            about.append(F.when(v.isNotNull(), F.struct(F.lit(m.name).alias("metric"), v.alias("value"))))
            continue
        drop = everything | ((status != "exact") & F.lit(rule.withheld is None or m.name in rule.withheld))
        number, flag = (v.try_cast(t) if m.kind in kinds else F.lit(None).cast(t) for t, kinds in (("double", ("number", "integer")), ("boolean", ("boolean",))))
        text = v if m.kind == "text" else F.lit(None).cast("string")
        kept.append(F.when(v.isNotNull() & ~drop, F.struct(F.lit(m.name).alias("metric"), number.alias("number"), text.alias("text"), flag.alias("flag"))))
        withheld.append(F.when(v.isNotNull() & drop, F.lit(m.name)))
    bind = (final == "exact") & F.lit(rule.scope in BOUND)
    if rule.scope in BOUND and "ensembl_transcript" in target:
        own, source = F.coalesce(_text("transcript"), F.lit("")), target["ensembl_transcript"]
        bind &= F.when(exact_version & own.contains("."), own == source).otherwise(A.stable_id(own) == A.stable_id(source))
    for row, source in rule.same:
        bind &= F.coalesce(F.col(row), F.lit("")) == F.coalesce(F.col(source), F.lit(""))
    dimensions = [F.lit(d) for d in VARIANT] + [F.when((final == "exact") | ~target[d].isin("", "."), F.lit(d)) for d, _ in rule.target]
    return F.when(there, F.struct(
        F.lit(rule.predictor).alias("predictor"), F.lit(rule.resource).alias("resource"), F.lit(rule.scope).alias("scope"), final.alias("status"), bind.alias("bind"),
        F.map_from_arrays(F.array(*[F.lit(d) for d in target]).cast("array<string>"), F.array(*target.values()).cast("array<string>")).alias("target"),
        F.array_compact(F.array(*kept)).alias("values"), F.array_compact(F.array(*about) if about else F.array().cast("array<struct<metric:string,value:string>>")).alias("provenance"),
        _names(withheld).alias("withheld"), _names(malformed).alias("invalid_metrics"), _names(invalid).alias("invalid_dimensions"), F.when(status == "exact", _names(missing)).otherwise(F.array().cast("array<string>")).alias("missing_dimensions"),
        F.when(final == "unmatched", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*dimensions))).alias("matched_dimensions"),
    ))


def source_observations(annotations: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...] = ("site_id", "k")) -> DataFrame:
    """A row for each annotation row and source with some value: keep, predictor, resource, scope, status, bind, target, values (number, text, flag), provenance, withheld,
    invalid_metrics, invalid_dimensions, missing_dimensions and matched_dimensions. Columns that a table lacks count as empty; sources without any column give nothing."""
    used = [r for r in checked(rules) if any(c in annotations.columns for m in r.metrics for c in m.columns)]
    if not used:
        annotations, used = annotations.limit(0), list(rules[:1])
    wanted = {c.split(":")[0] for r in used for c in [*(c for m in r.metrics for c in m.columns), *(c for _, c in r.target), *(c for pair in r.same for c in pair)]} | {"transcript"}
    rows = annotations.withColumns({c: F.lit(None).cast("string") for c in sorted(wanted - set(annotations.columns))})
    return _prepared(rows, used).select(*keep, F.inline(F.array_compact(F.array(*[_observation(r) for r in used]))))


#: Sources whose matches have rules of their own, with their metrics and what they need.
RULES = (
    Rule(
        "funcvep", "funcvep", "allele_gene",
        (*[Metric(n, (f"FuncVEP_{n.upper()}",), least=0, most=1) for n in ("cti", "cte", "sp")], Metric("allele_available", ("FuncVEP_allele_available",), "boolean"), Metric("match_status", ("FuncVEP_match_status",), "text", filterable=False), Metric("match", ("FuncVEP_match",), "text", filterable=False)),
        (("stated", ("match_status",), ""), ("matches", ("allele_gene",), "exact"), ("any", ("cti", "cte", "sp"), "exact"), ("flag", ("allele_available",), "partial")),
        ("cti", "cte", "sp"), (("ensembl_gene", "FuncVEP_source_gene"),), ("ensembl_gene",),
    ),
    Rule(
        "logofunc", "logofunc", "allele_transcript_protein",
        (*[Metric(n, (f"LoGoFunc_{n}",), least=0, most=1) for n in ("neutral", "gof", "lof")], Metric("prediction", ("LoGoFunc_prediction",), "text", allowed=("Neutral", "GOF", "LOF")), Metric("allele_available", ("LoGoFunc_allele_available",), "boolean", filterable=False), Metric("match", ("LoGoFunc_match",), "text", filterable=False)),
        (("matches", ("allele_transcript_protein",), "exact"), ("else", (), "partial")),
        None, (("ensembl_transcript", "LoGoFunc_source_transcript"), ("protein_position", "LoGoFunc_source_HGVSp:hgvsp"), ("amino_acid_change", "LoGoFunc_source_HGVSp:hgvsp")),
        ("ensembl_transcript", "protein_position", "amino_acid_change"), True, (("hgvsp", "LoGoFunc_source_HGVSp"),),
    ),
    Rule(
        "promoterai", "promoterai", "allele_transcript_tss_strand",
        (Metric("score", ("PromoterAI_score", "promoterAI"), least=-1, most=1), Metric("match", ("PromoterAI_match",), "text", filterable=False)),
        (("both", ("score", "allele_transcript_tss_strand", "exact_version", "stable_id", "stable_transcript_id"), "exact"), ("else", (), "partial")),
        None, (("ensembl_transcript", "PromoterAI_source_transcript"), ("tss_position", "PromoterAI_tss"), ("strand", "PromoterAI_strand")), ("ensembl_transcript", "tss_position", "strand"), True,
    ),
)
