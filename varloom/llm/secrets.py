"""Operator 7, secret scans: an incremental blob ledger. DataFrame functions only.

Texts are content-addressed by SHA-256: any number of paths and historical versions that hold the same bytes are one
blob. The ledger keeps which rules, with which version, have seen which blob, and what they found. A scan reads only
pairs of blob and rule version that the ledger lacks, appends its findings and then what it has scanned, and joins the
findings back to all paths. A job that dies between the two appends scans the same pairs again, and equal findings count once.

Findings are spans of code points, end exclusive. A rule's matches are leftmost and don't overlap each other. Positions
come from the pieces between matches: `split` and `regexp_extract_all` use the same matcher, and a running sum of the
lengths of both gives each match's start.

Defined cases: a null text counts as empty and has no findings. Repeated rows each get their blob's findings. A null
doc_id is kept. Rules' kinds are numbered in the order of the list. An empty table gives an empty result. Whole texts are
scanned, however long.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def any_case(word: str) -> str:
    """A pattern for word in either case of its ASCII letters, alike in all regex engines."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern, and optionally a group that must have at least `least` code points; other matches are consumed and dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_NAMES = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
BASE_RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run of these characters is matched as a whole, so the least length can stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
TABLES = {"scanned": "blob BINARY, rules ARRAY<STRING>", "findings": "blob BINARY, rule STRING, start BIGINT, `end` BIGINT", "paths": "blob BINARY, path STRING, version STRING"}


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<rule, gap, size, ok>>: for each match the length before it since the last one, its own, and whether it counts."""
    pattern = F.lit(rule.pattern)
    whole, gaps = F.regexp_extract_all(text, pattern, 0), F.split(text, rule.pattern, -1)
    tested = F.regexp_extract_all(text, pattern, rule.group) if rule.group else whole
    rows = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), tested.alias("t")), lambda x: F.struct(F.lit(rule.key).alias("rule"), F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("size"), (F.length(x["t"]) >= rule.least).alias("ok")))
    return F.when(text.rlike(rule.pattern), F.filter(rows, lambda x: x["size"].isNotNull()))


class BlobLedger:
    """Tables of TABLES under `path`: scanned, findings and paths, each clustered and sorted by blob into `buckets`.

    The same path finds the same ledger again, also in another session; `buckets` is fixed at its first use. The catalog
    only holds names for this session; `forget` drops these and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.names = {t: f"ledger_{t}_{hashlib.sha1(self.path.encode()).hexdigest()}" for t in TABLES}
        for t, columns in TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[t]} ({columns}) USING parquet CLUSTERED BY (blob) SORTED BY (blob) INTO {buckets} BUCKETS LOCATION '{self.path}/{t}'")

    def forget(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.table(self.names[table])

    def _append(self, table: str, rows: DataFrame) -> None:
        rows = rows.repartition(self.buckets, "blob").sortWithinPartitions("blob")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "blob").sortBy("blob").saveAsTable(self.names[table])
        self.spark.catalog.refreshTable(self.names[table])

    def scanned(self) -> DataFrame:
        return self._read("scanned")

    def findings(self) -> DataFrame:
        return self._read("findings")

    def paths(self) -> DataFrame:
        return self._read("paths")

    def record(self, docs: DataFrame, path: str, version: str) -> None:
        """Note which blob each path (a column of docs) has in a version; what is noted already isn't noted twice."""
        now = docs.select(blob_of(F.col("text")).alias("blob"), F.col(path).cast("string").alias("path"), F.lit(version).alias("version")).distinct()
        known = self.paths().filter(F.col("version") == version)
        here = [now[c].eqNullSafe(known[c]) for c in ("path", "version")]
        self._append("paths", now.join(known.hint("merge"), (now["blob"] == known["blob"]) & here[0] & here[1], "left_anti"))

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what the ledger lacks of docs' `text`.

        One shuffle moves each map task's distinct texts to their hash; equal texts are joined before it, so a text with
        a third of all rows moves once a task.
        """
        done = self.scanned().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        text = common.plain_text()
        blobs = docs.select(blob_of(F.col("text")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        todo = blobs.join(done.hint("merge"), "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
        todo = todo.filter(F.size("todo") > 0)
        none = F.array().cast("array<struct<rule:string,gap:int,size:int,ok:boolean>>")
        hits = F.concat(*[F.coalesce(F.when(F.array_contains("todo", r.key), _matches(F.col("text"), r)), none) for r in rules])
        seen = common.materialize(todo.select("blob", "todo", hits.alias("hits")), "scan")
        rows = seen.select("blob", F.posexplode("hits").alias("pos", "hit"))
        so_far = Window.partitionBy("blob", "hit.rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("end", F.sum(F.col("hit.gap").cast("long") + F.col("hit.size")).over(so_far))
        self._append("findings", rows.filter("hit.ok").select("blob", "hit.rule", (F.col("end") - F.col("hit.size")).alias("start"), "end"))
        self._append("scanned", seen.select("blob", F.col("todo").alias("rules")))

    def _found(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, found: the findings of these rules and versions, once each and in order."""
        kind = F.coalesce(*[F.when(F.col("rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
        return self.findings().withColumn("kind", kind).filter(F.col("kind").isNotNull()).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """path, version, blob, found for every recorded path whose blob has findings, in all versions: both tables are read by bucket."""
        return self.paths().join(self._found(rules).hint("merge"), "blob").select("path", "version", "blob", "found")

    def report(self, docs: DataFrame, ids: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """A row for each row of docs: ids and `found`, its blob's findings array<struct<start, kind, end>> in order.

        kind: the rule's number in `rules`. Findings of other rules or versions are left out.
        """
        found = self._found(rules)
        paths = common.materialize(docs.select(*ids, blob_of(F.col("text")).alias("_blob")), "paths")
        sizes = paths.groupBy("_blob").agg(F.count("*").alias("_n"))
        stats = common.materialize(sizes.join(found, F.col("_blob") == F.col("blob")).select("_blob", "_n", "found"), "found")
        # a blob may have any number of findings: they are dealt, never broadcast
        out = common.attach_wide(paths, stats, "_blob", "_n", paths.count(), ids)
        return out.select(*ids, F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))


def span_text(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
