"""Operator 1, exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows meet the index in a sort-merge anti-join on the digest; what it lacks is appended. The index side is read by
bucket and isn't shuffled, so a small new batch doesn't move a large index.

Defined cases: a null text counts as empty, and empty texts equal each other. Of equal texts in one batch the row with
the largest doc_id stays; a null doc_id is smaller than all others. Rows repeated with the same doc_id and text are one
group, of which exactly one row stays. A text that an earlier batch has brought keeps that batch's row. An empty batch
appends nothing and returns no rows. Very long texts are hashed whole and don't move. Other columns of the input are not read by `ingest` and all kept by `keep_first`;
columns named like those this module adds (digest) are not touched, the module's own begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


class DigestIndex:
    """Table `name` with one row a text: digest (SHA-256), keep_id, batch; clustered and sorted by digest.

    The table lives in the catalog's warehouse, or at `path` when that is given. With a catalog that forgets tables
    when the session ends, give the same path again: the buckets are found there. `buckets` is fixed at creation; aim
    at 100 to 200 MB of digests a bucket for the largest size expected.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        place = f" LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{place}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _judged(self, docs: DataFrame, batches: list[tuple[str, Column]], digest=None) -> DataFrame:
        """A row for each (doc_id, digest) of docs: copies, group_size, keep_id and stays; appends what is new, batch by batch."""
        digest = text_digest() if digest is None else digest
        seen = common.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
        groups = common.materialize(seen.groupBy("digest").agg(F.max("doc_id").alias("top"), F.sum("copies").alias("group_size")), "groups")
        for batch, part in batches:
            # what this batch has appended before, as ahead of a restart, is in the index and isn't appended again
            own = seen.filter(part).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
            fresh = own.join(self.read().hint("merge").select("digest"), "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch"))
            fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
            self.spark.catalog.refreshTable(self.name)
        known = self.read().select("digest", "keep_id", F.col("batch").isin([b for b, _ in batches]).alias("mine"))
        stats = common.materialize(groups.join(known.hint("merge"), "digest").select("digest", "keep_id", "mine", "group_size"), "known")
        out = common.attach_stats(seen, stats, "digest", "group_size", common.total_of(groups, "group_size"), ["doc_id"])
        return out.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("mine"))

    def ingest(self, docs: DataFrame, batch: str, digest=None) -> DataFrame:
        """Deduplicate docs (doc_id, text) against the index and append what is new.

        Returns doc_id, keep_id, group_size (rows of this batch with the text), kept, digest; a row for each row of docs.
        A batch that was already appended, as after a driver's restart, isn't appended twice: its own rows don't count
        as earlier ones. digest: another column to compare by, instead of SHA-256 of the text as it is.
        """
        return self.ingest_in_turn(docs, [(batch, F.lit(True))], digest)

    def ingest_in_turn(self, docs: DataFrame, batches: list[tuple[str, Column]], digest=None) -> DataFrame:
        """As ingest, for several batches of docs one after another: (name, condition on doc_id) of each; a row belongs to exactly one.

        Texts are hashed once. A later batch meets what the earlier ones appended, and appends what they lack. The result
        is for all rows of docs, with group_size over all batches.
        """
        out = self._judged(docs, batches, digest).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        return out.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "digest")


def text_digest():
    return F.unhex(F.sha2(common.plain_text(), 256))


def keep_first(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with the same doc_id and text any one.

    Rows leave by an anti-join with the (doc_id, digest) of those to drop: the usual small share of the input.
    """
    judged = common.materialize(index._judged(docs, [(batch, F.lit(True))]), "judged")
    gone = judged.filter(~F.col("stays")).select(F.col("doc_id").alias("_vl_id"), F.col("digest").alias("_vl_gone"))
    out = docs.withColumn("_vl_digest", text_digest())
    out = out.join(gone, out["doc_id"].cast("long").eqNullSafe(gone["_vl_id"]) & (out["_vl_digest"] == gone["_vl_gone"]), "left_anti")
    if not judged.filter("stays AND copies > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_vl_digest"])
    return out.drop("_vl_digest")
