"""Operator 11, exact top-k search: a Voronoi kNN join by inner product.

Vectors are integers. A vector x is set in a space with one more axis, as (x, sqrt(M - |x|^2)) with M the largest squared length, and a
query q as (q, 0): there |q - x|^2 = |q|^2 + M - 2 q.x, so that the highest products are the nearest neighbours and the
triangle inequality holds.

1. Pivots are drawn from a bounded sample of the vectors (`max_pivots`, `SAMPLE`); each vector goes to its nearest pivot's cell.
2. A cell's summary is its number of rows, its least and largest distance from the pivot, and the distances of some rows near the pivot, which
   are minima over salts, so that no cell is ever sorted. A query cell's summary is its number and its largest distance.
3. From summaries alone: a query cell's k-th neighbour is at most theta away (its own radius, the way between pivots and the way from there to k + 1
   known rows); a data cell whose rows lie further than theta from every query of the cell isn't needed by it.
4. Query cells near each other are joined into groups, a cell with many queries is split into several. Data rows are replicated to
   the groups that need their cell, dealt in parts of about `part_rows` rows. A part and its group's queries meet in one call: a cell
   with a third of all rows, or of all queries, is spread like any other.
5. A part is solved cell by cell, nearest first: a query skips a cell that its own distances to both pivots, the cell's ring or the
   hyperplane between the pivots put beyond its k-th best so far. Then the k best of a query's parts are taken by a window
   whose limit applies before the shuffle as well.

Pruning leaves whole results: bounds are rounded outwards, and scores are whole numbers. In many dimensions without clusters little
can be pruned; the work is then all products, in blocks.

Defined cases: vectors that are null or hold a null or non-finite component take no part, neither as queries nor as candidates.
Shorter vectors count as filled up with zeros, also empty ones. Components beyond 2^27 / scale count as that. A query's own row is no candidate, but other
rows with the same id are. Ties go to the smaller vec_id, a null vec_id comes last and is never a query. Fewer candidates than k
give fewer rows. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

SAMPLE = 8192
NONE = -(1 << 62)  # below every score
RESULT = "query_rid long, query_id long, vec_id long, score long"
#: Distances are trusted to this share of the largest one.
SLACK = 1e-6


class Space:
    """Pivots and distances in the space with one more axis. All arrays are of bounded size."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most = most
        self.pivots, self.lift = pivots.astype(np.float64), self.lifted(pivots)
        self.squares = (self.pivots**2).sum(1)
        self.slack = SLACK * float(np.sqrt(most) * 2 + 1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.most - (x.astype(np.float64) ** 2).sum(1)))

    def from_pivots(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        """Distances of rows of x, at height lift, from all pivots."""
        x = x.astype(np.float64)
        d = (x**2).sum(1)[:, None] + self.squares - 2 * (x @ self.pivots.T) + (lift[:, None] - self.lift) ** 2
        return np.sqrt(np.maximum(0, d))


def _space(points: DataFrame, width: int, pivots: int, most: float) -> Space:
    """Pivots: distinct vectors of a bounded sample, which is drawn by row numbers' hash."""
    rows = points.orderBy(F.xxhash64("rid"), "rid").limit(min(SAMPLE, 8 * pivots)).select("ints").toArrow()
    sample = np.unique(vectors.matrix(rows.column(0).combine_chunks(), width), axis=0)
    return Space(sample[np.random.default_rng(5).permutation(len(sample))[:pivots]], most)


def _placed(points: DataFrame, width: int, kind: str, space: Space, is_query: Column) -> DataFrame:
    """rid, vec_id, vec, cell, dist, and for queries q_cell and q_dist."""

    def tasks(batches):
        for b in batches:
            x = vectors.matrix(b.column(2), width)
            d = space.from_pivots(x, space.lifted(x))
            q = space.from_pivots(x, np.zeros(len(x)))
            asks = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            cell, q_cell, at = d.argmin(1), q.argmin(1), np.arange(len(x))
            columns = [b.column(0), b.column(1), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(cell, pa.int32()), pa.array(d[at, cell])]
            columns += [pa.array(q_cell, pa.int32(), mask=~asks), pa.array(q[at, q_cell], mask=~asks)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "rid long, vec_id long, vec binary, cell int, dist double, q_cell int, q_dist double"
    names = [c.split()[0] for c in schema.split(", ")]
    return points.select("rid", "vec_id", "ints", is_query.alias("asks")).mapInArrow(tasks, schema)


def _summaries(placed: DataFrame, k: int, cells: int) -> tuple[np.ndarray, ...]:
    """n, lo, hi, near (distances of up to 4 (k + 1) rows) of data cells; n and radius of query cells."""
    salts = 4 * (k + 1)
    rows = placed.groupBy("cell", F.pmod(F.xxhash64("rid"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    n, lo, hi = np.zeros(cells, np.int64), np.full(cells, np.inf), np.zeros(cells)
    near = np.full((cells, salts), np.inf)
    for r in rows.collect():  # at most max_pivots * 4 (k + 1) rows
        n[r.cell] += r.n
        lo[r.cell], hi[r.cell] = min(lo[r.cell], r.lo), max(hi[r.cell], r.hi)
        near[r.cell, r.salt] = r.lo
    q_n, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in placed.filter("q_cell IS NOT NULL").groupBy("q_cell").agg(F.count("*").alias("n"), F.max("q_dist").alias("r")).collect():
        q_n[r.q_cell], radius[r.q_cell] = r.n, r.r
    return n, lo, hi, np.sort(near, 1)[:, : k + 1], q_n, radius


def needed(space: Space, k: int, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: np.ndarray, q_n: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Boolean by (query cell, data cell): whether a row of the data cell may be among the k nearest of a query of the query cell."""
    apart = space.from_pivots(space.pivots, space.lift)
    out = np.zeros((len(n), len(n)), bool)
    for i in np.flatnonzero(q_n):
        reach = (near + apart[i][:, None]).ravel()
        theta = radius[i] + (np.partition(reach, k)[k] if np.isfinite(reach).sum() > k else np.inf)
        least = np.maximum(np.maximum(apart[i] - radius[i] - hi, lo - apart[i] - radius[i]), apart[i] / 2 - radius[i])
        out[i] = (n > 0) & (least - space.slack <= theta + space.slack)
    return out


def grouped(space: Space, q_n: np.ndarray, group_queries: int) -> np.ndarray:
    """The group of each query cell (-1 without queries): cells near each other, until group_queries are together."""
    apart = space.from_pivots(space.pivots, space.lift)
    group, left, g = np.full(len(q_n), -1), set(np.flatnonzero(q_n).tolist()), 0
    while left:
        first = max(left, key=lambda c: (q_n[c], -c))
        held = 0
        for c in sorted(left, key=lambda c: (apart[first, c], c)):
            if held and held + q_n[c] > group_queries:
                break
            group[c] = g
            held += q_n[c]
            left.discard(c)
        g += 1
    return group


def solve(space: Space, k: int, width: int, kind: str, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
    """RESULT of the k best of a part's rows for each query; the part's rows hold the needed cells of the queries' group."""
    if not len(queries) or not len(data):
        return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in RESULT.split(", ")})
    q = np.frombuffer(b"".join(queries["vec"]), kind).reshape(-1, width)
    x = np.frombuffer(b"".join(data["vec"]), kind).reshape(-1, width)
    q_rid, x_rid, cell, dist = queries["rid"].to_numpy(), data["rid"].to_numpy(), data["cell"].to_numpy(), data["dist"].to_numpy()
    from_pivots, q_cell = space.from_pivots(q, np.zeros(len(q))), queries["q_cell"].to_numpy()
    own = from_pivots[np.arange(len(q)), q_cell]
    shift = (q.astype(np.float64) ** 2).sum(1) + space.most  # a squared distance is shift - 2 * score
    best = np.full((len(q), k), NONE)  # of each query, ascending
    found = []
    order = np.argsort(cell, kind="stable")
    cells = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)
    cells.sort(key=lambda rows: from_pivots[:, cell[rows[0]]].min())
    for rows in cells:
        j = cell[rows[0]]
        d, gap = from_pivots[:, j], np.sqrt(((space.pivots[q_cell] - space.pivots[j]) ** 2).sum(1) + (space.lift[q_cell] - space.lift[j]) ** 2)
        plane = np.where(gap > 0, (d**2 - own**2) / (2 * np.maximum(gap, 1e-300)), 0)
        least = np.maximum(np.maximum(d - dist[rows].max(), dist[rows].min() - d), plane) - space.slack
        reach = np.sqrt(np.maximum(0, shift - 2.0 * best[:, 0])) + space.slack
        asks = np.flatnonzero((best[:, 0] == NONE) | (least <= reach))
        if not len(asks):
            continue
        s = vectors.product(q[asks], x[rows])
        s[q_rid[asks][:, None] == x_rid[rows]] = NONE
        both = np.concatenate([best[asks], s], 1)
        best[asks] = now = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        a, b = np.nonzero((s >= now[:, :1]) & (s != NONE))
        found.append((asks[a], rows[b], s[a, b]))
    a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
    better = score >= best[a, 0]
    a, b, score = a[better], b[better], score[better]
    out = pd.DataFrame({"a": a, "query_rid": q_rid[a], "query_id": queries["vec_id"].to_numpy()[a], "vec_id": data["vec_id"].astype("Int64").take(b).array, "score": score})
    out = out.sort_values(["a", "score", "vec_id"], ascending=[True, False, True], na_position="last", kind="stable")
    return out[out.groupby("a").cumcount() < k].drop(columns=["a"])


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vector: str = "embedding", max_pivots: int = 256, cell_rows: int = 512, group_queries: int = 1024, part_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query with the other rows (vec_id and `vector`).

    is_query: a condition on vec_id. There is a pivot for each cell_rows rows, at most max_pivots. All tables on the way lie in the shared
    folder; the result is written there as well, and the others are dropped.
    """
    spark = rows.sparkSession
    common.ship(spark)
    tables = common.Tables(spark)
    points, width, top = vectors.written(rows, vector, scale, [F.col("vec_id").cast("long").alias("vec_id")], tables)
    schema = "query_id long, rank int, vec_id long, score long"
    squares = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    total, most = points.agg(F.count("*"), F.max(squares)).first()
    if not total:
        tables.drop()
        return spark.createDataFrame([], schema)
    width, kind = max(1, width), vectors.kind_for(top)
    space = _space(points, width, int(min(max_pivots, 1 + total // cell_rows)), most)
    cells = len(space.pivots)
    placed = tables.write(_placed(points, width, kind, space, F.coalesce(is_query, F.lit(False))), "placed")
    n, lo, hi, near, q_n, radius = _summaries(placed, k, cells)
    use, group = needed(space, k, n, lo, hi, near, q_n, radius), grouped(space, q_n, group_queries)
    # what follows has a row a cell: at most max_pivots rows of at most max_pivots numbers, so that it may be broadcast
    plan = {g: (np.flatnonzero(group == g), np.flatnonzero(use[group == g].any(0))) for g in range(group.max() + 1)}
    splits = {g: int(-(-q_n[own].sum() // group_queries)) for g, (own, _) in plan.items()}
    parts = {g: int(max(1, -(-n[data].sum() // part_rows))) for g, (_, data) in plan.items()}
    asked = spark.createDataFrame([(int(c), g, splits[g], parts[g]) for g, (own, _) in plan.items() for c in own], "q_cell int, g int, splits int, parts int")
    wanted = spark.createDataFrame([(int(c), [(g, splits[g], parts[g]) for g, (_, data) in plan.items() if c in data]) for c in range(cells)], "cell int, to array<struct<g:int,splits:int,parts:int>>")
    numbers = lambda x: F.sequence(F.lit(0), x - 1)
    dealt = F.pmod(F.xxhash64("rid"), F.col("parts"))
    queries = placed.join(F.broadcast(asked), "q_cell").withColumn("split", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("splits")).cast("int"))
    queries = queries.select("g", "split", F.explode(numbers(F.col("parts"))).alias("part"), *[F.col(c).alias(c) for c in ("rid", "vec_id", "vec", "q_cell")])
    data = placed.join(F.broadcast(wanted), "cell").select("rid", "vec_id", "vec", "cell", "dist", F.inline("to"))
    data = data.select("g", F.explode(numbers(F.col("splits"))).alias("split"), dealt.cast("int").alias("part"), "rid", "vec_id", "vec", "cell", "dist")

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return solve(space, k, width, kind, left, right)

    keys = ["g", "split", "part"]
    near_by = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(one, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    out = near_by.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = tables.write(out, "nearest", keep=True)
    tables.drop()
    return out
