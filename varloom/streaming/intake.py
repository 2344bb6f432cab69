"""Intake of many called files by Structured Streaming, into a table of deltas that replaying doesn't change.

A batch writes its own rows as a delta and one line of a log: its cost goes with its rows, not with the table. Readers merge what deltas
say over the base. Every so many batches the deltas are folded into the base, part by part, where a part is a range of sites and is
written by several tasks; parts that no delta touches stay where they are. Each step moves the log last: what a crash leaves behind is written
over when the step is run again, and a batch whose number is in the log does nothing.

Lines that can't be used go to a quarantine table and stop nothing. What a batch held is counted while it's scanned, and stored with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from varloom.operators import clinical as L

CALLS = "sample_id string, site_id long, gt string, dp int, gq long, ad_alt int, filter string, file_id string"
KEY = ["sample_id", "site_id"]
VALUES = [c.split()[0] for c in CALLS.split(", ") if c.split()[0] not in KEY]
COUNTERS = "batch long, records long, passing long, quarantined long"
#: Sites in a part; sites are numbered by place, so that a part is a stretch of the genome.
PART_SITES = 1 << 16


def parsed(lines: DataFrame) -> DataFrame:
    """Columns of CALLS, value and reason (null for a line that can be used) of lines (value, file): seven tab-separated fields."""
    p = F.split("value", "\t")
    get = lambda i: F.get(p, F.lit(i))
    named = [get(0).alias("sample_id"), get(1).try_cast("long").alias("site_id"), get(2).alias("gt"), get(3).try_cast("int").alias("dp"), get(4).try_cast("long").alias("gq"), get(5).try_cast("int").alias("ad_alt"), get(6).alias("filter")]
    why = F.when(F.size(p) != 7, "field count").when(get(1).try_cast("long").isNull(), "site").when(~get(2).rlike(r"^[0-9.]+([/|][0-9.]+)*$"), "genotype")
    return lines.select(*named, F.col("file").alias("file_id"), "value", why.alias("reason"))


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, quarantined lines with a reason) from lines (value, file)."""
    rows = parsed(lines)
    return rows.filter("reason IS NULL").drop("value", "reason"), rows.filter("reason IS NOT NULL").select("value", F.col("file_id").alias("file"), "reason")


@dataclass(frozen=True)
class State:
    """What the log says: its version, the last batch, the version that holds each part of the base, and the deltas not yet in the base."""

    version: int = -1
    batch: int = -1
    base: tuple[tuple[int, int], ...] = ()
    deltas: tuple[int, ...] = ()


class DeltaTable:
    """Calls under path: base/v=N/part=P, delta/b=BATCH and log/v=N. The log has a row a delta, and since the last folding a row a part: that is all that the driver reads."""

    def __init__(self, spark: SparkSession, path: str, part_sites: int = PART_SITES):
        self.spark, self.path, self.part_sites = spark, path.rstrip("/"), part_sites

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def part_of(self) -> Column:
        return F.floor(F.col("site_id") / self.part_sites).cast("int")

    def state(self) -> State:
        if not self._exists(f"{self.path}/log"):
            return State()
        log = self.spark.read.schema("kind string, part int, at long, v long").parquet(f"{self.path}/log")
        folded, version = log.agg(F.max(F.when(F.col("kind") == "folded", F.col("v"))), F.max("v")).first()
        rows = log.filter(F.col("v") >= (-1 if folded is None else folded)).collect()
        deltas = tuple(sorted(r["at"] for r in rows if r["kind"] == "delta"))
        upto = max((r["at"] for r in rows if r["kind"] == "folded"), default=-1)
        return State(-1 if version is None else version, max((upto, *deltas)), tuple(sorted((r["part"], r["at"]) for r in rows if r["kind"] == "base")), deltas)

    def _log(self, version: int, rows: list[tuple]) -> None:
        """One file, which appears whole or not at all."""
        self.spark.createDataFrame(rows, "kind string, part int, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/v={version}")

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Write rows (CALLS, one a key) as the batch's delta; False for a batch that is in already."""
        state = self.state()
        if batch <= state.batch:
            return False
        self._write_delta(rows, batch)
        self._log(state.version + 1, [("delta", None, batch)])
        return True

    def _write_delta(self, rows: DataFrame, batch: int) -> None:
        placed = rows.withColumn("part", self.part_of()).repartitionByRange("part", *KEY[::-1]).sortWithinPartitions("part", *KEY[::-1])
        placed.write.mode("overwrite").parquet(f"{self.path}/delta/b={batch}")

    def deltas(self, state: State, parts: set[int] | None = None) -> DataFrame:
        """The rows of the deltas merged by key: of each column the last value that isn't null. Parts are filters of the scan."""
        if not state.deltas:
            return self.spark.createDataFrame([], CALLS)
        paths = [f"{self.path}/delta/b={b}" for b in state.deltas]
        rows = self.spark.read.schema(f"{CALLS}, part int, b long").option("basePath", f"{self.path}/delta").parquet(*paths)
        rows = rows if parts is None else rows.filter(F.col("part").isin(sorted(parts)))
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("b"))).alias(c) for c in VALUES]
        return rows.groupBy(*KEY).agg(*last)

    def base(self, state: State, parts: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/base/v={v}/part={p}" for p, v in state.base if parts is None or p in parts]
        return self.spark.read.schema(CALLS).parquet(*paths) if paths else self.spark.createDataFrame([], CALLS)

    def read(self, parts: set[int] | None = None) -> DataFrame:
        """The merged rows, of all parts or some. The base meets only the keys of deltas, which Spark broadcasts while they are few."""
        state = self.state()
        base, new = self.base(state, parts), self.deltas(state, parts)
        if not state.deltas:
            return base
        changed = base.join(new.select(*KEY, *[F.col(c).alias(f"_{c}") for c in VALUES]), KEY, "left")
        merged = changed.select(*KEY, *[F.coalesce(f"_{c}", c).alias(c) for c in VALUES])
        return merged.unionByName(new.join(base.select(*KEY), KEY, "left_anti"))

    def fold(self) -> set[int]:
        """Fold the deltas into new versions of the parts that they touch; these parts. Old files stay for readers that have begun, until `vacuum`."""
        state = self.state()
        if not state.deltas:
            return set()
        touched = self.spark.read.schema(f"{CALLS}, part int").parquet(*[f"{self.path}/delta/b={b}" for b in state.deltas]).select("part").distinct()
        parts, new = {r["part"] for r in touched.collect()}, state.version + 1
        place = ["part", *KEY[::-1]]
        rows = self.read(parts).withColumn("part", self.part_of()).repartitionByRange(*place).sortWithinPartitions(*place)
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/base/v={new}")
        base = dict(state.base) | dict.fromkeys(parts, new)
        self._log(new, [("folded", None, state.batch), *[("base", p, v) for p, v in sorted(base.items())]])
        return parts

    def vacuum(self) -> None:
        """Delete the files of folded deltas and replaced parts, and the log before the last folding. Not while others read."""
        state = self.state()
        fs_of = self.spark._jvm.org.apache.hadoop.fs.Path
        root = fs_of(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = {f"v={v}/part={p}" for p, v in state.base}
        first = min([state.version, *[v for v in self._folded()]]) if state.base else -1
        for entry in fs.listStatus(fs_of(f"{self.path}/delta")) if self._exists(f"{self.path}/delta") else ():
            if int(entry.getPath().getName().split("=")[1]) not in state.deltas:
                fs.delete(entry.getPath(), True)
        for version in fs.listStatus(fs_of(f"{self.path}/base")) if self._exists(f"{self.path}/base") else ():
            for part in fs.listStatus(version.getPath()):
                name = f"{version.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in kept:
                    fs.delete(part.getPath(), True)
        for entry in fs.listStatus(fs_of(f"{self.path}/log")):
            if int(entry.getPath().getName().split("=")[1]) < first:
                fs.delete(entry.getPath(), True)

    def _folded(self) -> list[int]:
        log = self.spark.read.schema("kind string, part int, at long, v long").parquet(f"{self.path}/log")
        return [r[0] for r in log.filter("kind = 'folded'").agg(F.max("v")).collect()]


def merge_batch(table: DeltaTable, calls: DataFrame, batch: int) -> bool:
    """Calls of one batch into the table: the later call of a sample and site wins; nothing happens twice."""
    return table.append(L.last_by_key(calls, KEY, "file_id"), batch)


def observed(rows: DataFrame, into: Observation | str, good: Column | None = None) -> DataFrame:
    """rows with counters of the scan that reads them: records, passing (FILTER is PASS or a dot) and quarantined (not good)."""
    good = F.lit(True) if good is None else good
    passing = F.count_if(good & F.col("filter").isin("PASS", "."))
    return rows.observe(into, F.count(F.lit(1)).alias("records"), passing.alias("passing"), F.count_if(~good).alias("quarantined"))


def scan_counters(rows: DataFrame, good: Column | None = None) -> dict[str, int]:
    """The counters of one whole scan of rows, in one pass that keeps nothing."""
    seen = Observation()
    observed(rows, seen, good).write.format("noop").mode("overwrite").save()
    return seen.get


class ProgressLog(StreamingQueryListener):
    """Rows that each batch of each query has read, as Spark reports them while a stream runs: (query, batch, rows)."""

    def __init__(self):
        self.rows: list[tuple[str, int, int]] = []
        self.ended: list[str] = []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.rows.append((str(p.id), p.batchId, p.numInputRows))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.ended.append(str(event.id))


def start(spark: SparkSession, source: str, target: str, quarantine: str, checkpoint: str, files_per_batch: int = 50, fold_every: int = 16, part_sites: int = PART_SITES):
    """A query that takes in what lies in `source` and ends; run it again for what has come since. Counters by batch lie in target/counters."""
    table = DeltaTable(spark, target, part_sites)
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(source).withColumn("file", F.input_file_name())

    def one_batch(batch_lines: DataFrame, batch: int) -> None:
        seen = Observation()
        rows = observed(parsed(batch_lines), seen, F.col("reason").isNull()).persist()
        rows.count()
        merge_batch(table, rows.filter("reason IS NULL").drop("value", "reason"), batch)
        rows.filter("reason IS NOT NULL").select("value", F.col("file_id").alias("file"), "reason").withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{quarantine}/batch={batch}")
        got = seen.get
        spark.createDataFrame([(batch, got["records"], got["passing"], got["quarantined"])], COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{target}/counters/b={batch}")
        rows.unpersist()
        if len(table.state().deltas) >= fold_every:
            table.fold()

    return lines.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, target: str) -> DataFrame:
    """COUNTERS: what each batch held."""
    return spark.read.schema(COUNTERS).parquet(f"{target}/counters")
