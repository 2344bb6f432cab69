"""Operator 12, vector code compression: a product code whose codebooks are refined with norm-of-sum bounds.

A vector is cut into equal parts; each part position has a codebook, which starts as the parts of the vectors with the smallest ids, and
each round assigns every part to its nearest entry and replaces entries by the floor of their parts' mean.

Rounds don't measure all distances again. A part keeps its entry, a lower bound of its distance to any other entry, and the round in
which that bound was exact (its stamp). The codebooks of all rounds are retained, so that a later round lowers the bound by how far entries
have truly moved since the stamp: the norm of the sum of their moves, never more than the sum of the norms that
step-by-step bounds subtract. If the distance to the own entry, which is always measured, stays below, the entry is kept unseen by the others; else
the part is rescanned and stamped anew. Bounds are rounded so that a kept entry is the strictly nearest one; results are those of full scans.

Vectors are dealt once, as blocks of `block_rows` rows, to a table bucketed by block. A round reads it beside the bounds' table of the round before, which has the
same buckets, so that neither moves, and writes new bounds and each block's sums; the driver gets sums over all blocks, a number for
each component of the codebooks. A lost executor costs its tasks of one round. The tables of the round before last are dropped.

Defined cases: vectors that are null or hold a null or non-finite component are dropped. Shorter vectors count as filled up with zeros,
and all up to a multiple of the number of parts. Components beyond 2^27 / scale count as that. Fewer vectors than entries give smaller codebooks. Repeated ids are rows
of their own; among equal ids the first codebooks take the vector that sorts first. A null vec_id comes last. Null labels are one label. An empty table gives an empty result.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Bounds are trusted to this share of a distance.
SLACK = 1e-9


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whole squared distances of the rows of x from entries."""
    x, entries = x.astype(np.int64), entries.astype(np.int64)
    return (x**2).sum(1)[:, None] + (entries**2).sum(1) - 2 * vectors.product(x, entries)


class Bounds:
    """Of the rows of one part position: the entry, the bound and its stamp."""

    def __init__(self, rows: int):
        self.entry, self.low, self.stamp = np.zeros(rows, np.uint8), np.full(rows, -1.0), np.zeros(rows, np.uint8)

    def assign(self, x: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, int]:
        """Assign rows of x to the last codebook of history (rounds, entries, width); their squared distances and how many were rescanned."""
        now, t = history[-1].astype(np.int64), len(history) - 1
        own = ((x.astype(np.int64) - now[self.entry]) ** 2).sum(1)
        moved = np.sqrt(((history.astype(np.float64) - now) ** 2).sum(2)) * (1 + SLACK)  # since each round, of each entry
        others = np.stack([np.delete(moved, j, 1).max(1, initial=0) for j in range(len(now))], 1)
        low = self.low - others[self.stamp, self.entry]
        again = np.flatnonzero(np.sqrt(own) * (1 + SLACK) >= low * (1 - SLACK))
        if len(again):
            d = squares(x[again], now)
            self.entry[again] = d.argmin(1)
            own[again] = d.min(1)
            d[np.arange(len(again)), self.entry[again]] = np.iinfo(np.int64).max
            self.low[again], self.stamp[again] = np.sqrt(d.min(1)) * (1 - SLACK), t
        return own, len(again)

    def sums(self, x: np.ndarray, entries: int) -> np.ndarray:
        """By entry: the sum of its rows' components, then their number."""
        out = np.zeros((entries, x.shape[1] + 1), np.int64)
        np.add.at(out, self.entry, np.concatenate([x.astype(np.int64), np.ones((len(x), 1), np.int64)], 1))
        return out

    def packed(self) -> bytes:
        return self.entry.tobytes() + self.stamp.tobytes() + self.low.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Bounds:
        n = len(data) // 10
        out = cls(0)
        out.entry, out.stamp, out.low = np.frombuffer(data, np.uint8, n).copy(), np.frombuffer(data, np.uint8, n, n).copy(), np.frombuffer(data, np.float64, n, 2 * n).copy()
        return out


class Block:
    """A block's vectors with the bounds of all part positions."""

    def __init__(self, data: bytes, kind: str, width: int, bounds: bytes | None):
        self.x = np.frombuffer(data, kind).reshape(-1, PARTS, width)
        n = len(self.x)
        self.bounds = [Bounds(n) if bounds is None else Bounds.unpacked(bounds[10 * n * p : 10 * n * (p + 1)]) for p in range(PARTS)]

    def assign(self, history: np.ndarray) -> tuple[np.ndarray, int]:
        """Squared distances by row and part, and the number of rescans. history: (rounds, parts, entries, width)."""
        d, n = zip(*[b.assign(self.x[:, p], history[:, p]) for p, b in enumerate(self.bounds)], strict=True)
        return np.stack(d, 1), sum(n)


def _blocks(points: DataFrame, width: int, kind: str, block_rows: int) -> DataFrame:
    """block, rids, data of the vectors, filled up to PARTS * width components."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            rid, x = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rid[:1]), pa.array([rid.tolist()], pa.list_(pa.int64())), pa.array([x.astype(kind).tobytes()])], ["block", "rids", "data"])

        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = b.slice(at, block_rows)
                held.append((part.column(0).to_numpy(), vectors.matrix(part.column(1), PARTS * width)))
                n += part.num_rows
                if n >= block_rows:
                    yield batch()
                    held, n = [], 0
        if held:
            yield batch()

    return points.select("rid", "ints").mapInArrow(tasks, "block long, rids array<long>, data binary")


def _round(blocks: DataFrame, history: np.ndarray, width: int, kind: str) -> DataFrame:
    """block, bounds, sums and the number of rescans after an assignment to history's last codebooks; blocks may hold earlier bounds."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data, bounds in zip(*[b.column(i) for i in range(3)], strict=True):
                x = Block(data.as_py(), kind, width, bounds.as_py())
                n = x.assign(history)[1]
                sums = np.stack([p.sums(x.x[:, i], history.shape[2]) for i, p in enumerate(x.bounds)]).ravel()
                packed = b"".join(p.packed() for p in x.bounds)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([packed]), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["block", "bounds", "sums", "rescans"])

    return blocks.select("block", "data", "bounds").mapInArrow(tasks, "block long, bounds binary, sums array<long>, rescans long")


def _coded(blocks: DataFrame, history: np.ndarray, width: int, kind: str) -> DataFrame:
    """rid, code and error of every vector by history's last codebooks."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rids, data, bounds in zip(*[b.column(i) for i in range(3)], strict=True):
                x = Block(data.as_py(), kind, width, bounds.as_py())
                d = x.assign(history)[0].sum(1)
                code = [r.tobytes().hex() for r in np.stack([p.entry for p in x.bounds], 1)]
                yield pa.RecordBatch.from_arrays([rids.values, pa.array(code), pa.array(d)], ["rid", "code", "error"])

    return blocks.select("rids", "data", "bounds").mapInArrow(tasks, "rid long, code string, error long")


def compress(rows: DataFrame, scale: int = 4096, vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, block_rows: int = 1024) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, the label column, code, error and label_error of each usable row; the codebooks of all rounds (round, part, entry, component); rescans by round.

    The result lies in the shared folder; the tables on the way are dropped.
    """
    spark = rows.sparkSession
    common.ship(spark)
    tables, states = common.Tables(spark), common.Tables(spark)
    points, longest, top = vectors.written(rows, vector, scale, [F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label")], tables)
    width, kind = max(1, -(-longest // PARTS)), vectors.kind_for(top)
    first = points.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(ENTRIES).select("ints").toArrow()
    start = vectors.matrix(first.column(0).combine_chunks(), PARTS * width).reshape(-1, PARTS, width).transpose(1, 0, 2)
    history, rescans = start[None], []
    if not start.shape[1]:
        tables.drop()
        return spark.createDataFrame([], f"vec_id long, label {rows.schema[label].dataType.simpleString()}, code string, error long, label_error long"), history, rescans
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = tables.write_bucketed(_blocks(points, width, kind, block_rows).repartition(buckets, "block"), "blocks", "block")
    met = blocks.withColumn("bounds", F.lit(None).cast("binary"))
    for _ in range(rounds):
        before, states = states, common.Tables(spark)
        state = states.write_bucketed(_round(met, history, width, kind), "bounds", "block")
        sums = state.select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(PARTS * start.shape[1] * (width + 1), np.int64)
        for r in sums:  # a number for each component of the codebooks
            flat[r.i] = r.n
        rescans.append(state.agg(F.sum("rescans")).first()[0])
        total = flat.reshape(PARTS, start.shape[1], width + 1)
        mean = total[..., :-1] // np.maximum(1, total[..., -1:])
        history = np.concatenate([history, np.where(total[..., -1:] > 0, mean, history[-1])[None]])
        met = blocks.join(state.select("block", "bounds").hint("merge"), "block")
        before.drop()
    coded = tables.write(_coded(met, history, width, kind), "codes")
    out = points.select("rid", "vec_id", "label").join(coded, "rid")
    out = tables.write(out, "coded")
    key = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n"))
    keyed = out.withColumn("_key", key)
    sums = tables.write(keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    out = common.attach_stats(keyed, sums, "_key", "_n", common.total_of(sums, "_n"), ["rid"]).drop("_key", "_n", "rid")
    out = tables.write(out, "result", keep=True)
    tables.drop()
    states.drop()
    return out, history, rescans


def codebooks_text(codebooks: np.ndarray) -> str:
    """The components of codebooks (part, entry, component) in that order, comma-joined."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
