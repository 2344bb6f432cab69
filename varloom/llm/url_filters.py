"""Operator 4, URL filters: empirical-Bayes host reputation, with fixed rules on top.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix. Each level's good share gets a
beta-binomial prior whose mean is the posterior mean one level up: suffix from the whole, domain from its suffix, host
from its domain. How strongly a level shrinks is estimated from its own children by moments (`prior_strength`). A host
is blocked where the upper bound of its posterior share of good pages stays below `least_good`: a host with little
evidence keeps its benefit of the doubt.

Counts are summed by host first, so that later levels see one row a host, and a host with a third of all pages is summed
before the shuffle and joined by the split in `common.attach_stats`.

Defined cases: a null url, or one without "://", has an empty host and path; the empty host is a host like others, whose
domain and suffix are empty too. Without any labelled page the prior is even and nothing is blocked by the method.
Rules: the longest that fits decides; without rules all is left to the method. An empty table gives an empty result.
Repeated rows each count as a page. A port isn't part of domain and suffix; a numeric address is its own domain under the
suffix ADDRESS. Very long urls are read whole. Extra columns of pages aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The suffix that stands for numeric addresses, which nobody registers under another name.
ADDRESS = "(address)"
#: Suffixes of two labels under which names are registered; others have one label. A stand-in for the table that `with_domains` takes.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]+([.][0-9]+){3}|\[.*\])$")


def _tail(name: Column, labels: int) -> Column:
    return F.substring_index(name, ".", -labels)


def suffix_of(host: Column) -> Column:
    """The public suffix by the built-in list; ADDRESS for numeric addresses."""
    name = name_of(host)
    return F.when(is_address(name), ADDRESS).when(_tail(name, 2).isin(*LONG_SUFFIXES), _tail(name, 2)).otherwise(_tail(name, 1))


def domain_of(host: Column) -> Column:
    """The registered domain by the built-in list; a numeric address is its own."""
    name = name_of(host)
    return F.when(is_address(name), name).when(_tail(name, 2).isin(*LONG_SUFFIXES), _tail(name, 3)).otherwise(_tail(name, 2))


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (host, one row each) with domain and suffix.

    suffixes: a table of public suffixes (suffix) such as the published list without its wildcards; the longest that ends
    the host at a label counts, and the domain has one label more. Hosts without one, and all without a table, go by the
    built-in rule: two labels for LONG_SUFFIXES, else one.
    """
    own = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    if suffixes is None:
        return own
    name = name_of(F.col("host"))
    tails = hosts.filter(~is_address(name)).select("host", F.split(name, "[.]").alias("_l"))
    tails = tails.select("host", "_l", F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("_n")).withColumn("_tail", F.expr("array_join(slice(_l, -_n, _n), '.')"))
    found = tails.join(suffixes.select(F.lower("suffix").alias("_tail")).distinct(), "_tail").groupBy("host").agg(F.max(F.struct("_n", "_tail", "_l")).alias("_s"))
    found = found.select("host", F.col("_s._tail").alias("_suffix"), F.expr("array_join(slice(_s._l, -least(_s._n + 1, size(_s._l)), _s._n + 1), '.')").alias("_domain"))
    out = own.join(found, "host", "left").withColumns({"domain": F.coalesce("_domain", "domain"), "suffix": F.coalesce("_suffix", "suffix")})
    return out.drop("_domain", "_suffix")


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host + path) that fits, as struct(rule, verdict); null if none does.

    The rules are a short list of configuration and become one CASE expression.
    """
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, hit) if chain is None else chain.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chain is None else chain


def prior_strength(good: Column, n: Column, mean: Column) -> list[Column]:
    """Sums from which `strength` is estimated by the method of moments: children's spread around their parent's mean."""
    return [F.sum(F.when(n > 0, (good - n * mean) * (good - n * mean))).alias("_ss"), F.sum(F.when(n > 0, n * mean * (1 - mean))).alias("_within"), F.sum(F.when(n > 0, n * (n - 1) * mean * (1 - mean))).alias("_pairs")]


def _strength(row) -> float:
    """Prior strength a + b. For beta-binomial children sum (g - n m)^2 is on average m(1-m)(n + rho n(n-1)), rho = 1/(a+b+1)."""
    if not row["_pairs"] or row["_ss"] is None:
        return 2.0
    rho = min(max((row["_ss"] - row["_within"]) / row["_pairs"], 0.001), 0.9)
    return float(round(1 / rho - 1, 3))


def host_reputation(outcomes: DataFrame, z: float = 1.645, suffix_table: DataFrame | None = None) -> DataFrame:
    """host, pages, n, good, mean, upper from outcomes (host, good): good is true, false, or null for unlabelled pages.

    upper: mean plus z posterior standard deviations. One row a host; a shuffle by host, then rows by host only.
    """
    counts = outcomes.groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.count_if("good").alias("good"))
    hosts = common.materialize(with_domains(counts, suffix_table), "hosts")
    domains = common.materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("kids")), "domains")
    suffixes = common.materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("kids")), "suffixes")
    n, good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    base = F.lit((float(good or 0) + 1.0) / (float(n or 0) + 2.0))

    def shrunk(level: DataFrame, prior: Column, name: str) -> DataFrame:
        level = level.withColumn("_m", prior)
        k = _strength(level.agg(*prior_strength(F.col("good").cast("double"), F.col("n").cast("double"), F.col("_m"))).first())
        a, b = F.col("good") + F.lit(k) * F.col("_m"), F.col("n") - F.col("good") + F.lit(k) * (1 - F.col("_m"))
        return level.withColumns({f"{name}_a": a, f"{name}_b": b, f"{name}_mean": a / (a + b)}).drop("_m")

    suffixes = common.materialize(shrunk(suffixes, base, "s").select("suffix", "s_mean", "kids"), "suffix-prior")
    # a suffix may hold a third of all domains, and a domain a third of all hosts
    placed = common.attach_stats(domains.withColumnRenamed("kids", "hosts"), suffixes, "suffix", "kids", common.total_of(suffixes, "kids"), ["domain"])
    domains = common.materialize(shrunk(placed, F.col("s_mean"), "d").select("domain", "d_mean", F.col("hosts").alias("kids")), "domain-prior")
    hosts = shrunk(common.attach_stats(hosts, domains, "domain", "kids", common.total_of(domains, "kids"), ["host"]), F.col("d_mean"), "h")
    a, b = F.col("h_a"), F.col("h_b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return common.materialize(hosts.select("host", "pages", "n", "good", F.col("h_mean").alias("mean"), (F.col("h_mean") + F.lit(z) * deviation).alias("upper")), "reputation")


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None, least_good: float = 0.5, z: float = 1.645, suffix_table: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, host_good, host_labelled for pages (page_id, url).

    outcomes: labelled pages (url, good) from elsewhere. Without them the pages that a rule decides are the labelled
    ones: an allowed page is a good outcome and a blocked one is a bad one, and hosts without rules inherit from their
    domain and suffix.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_hit", matching_rule(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        known = rows.select("host", (F.col("_hit.verdict") == "allow").alias("good"))
    else:
        known = rows.select("host", F.lit(None).cast("boolean").alias("good")).unionByName(outcomes.select(host_of(F.col("url")).alias("host"), F.col("good").cast("boolean")))
    hosts = host_reputation(known, z, suffix_table)
    total = common.total_of(hosts, "pages")
    out = common.attach_stats(rows, hosts, "host", "pages", total, ["path", "page_id"])
    own = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", own).alias("verdict"), F.col("good").alias("host_good"), F.col("n").alias("host_labelled"))
