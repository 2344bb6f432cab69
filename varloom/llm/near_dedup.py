"""Operator 2, near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A text is its shingles of five words (lower case; a shorter text is one shingle), each with weight tf * idf. Document
frequencies are counted over all different texts, so that exact copies don't count, in IDF_BUCKETS hashed counters; from
each counter the mean load of all counters is taken off, so that what collides in it doesn't count for a shingle, however
large the corpus. The idf goes by the share of texts that hold a shingle, and so is the same at every size: a shingle in up
to RARE of the texts weighs 1, and more frequent ones ln(1 / share) / ln(1 / RARE), but `idf_floor` at least.
A group of near copies may hold a third of all rows. It would make its own shingles frequent and so lose the links within
it, so that a family counts as about one text: plain min-hashes in FAMILY_BANDS bands of FAMILY_ROWS group the texts first,
and each text counts by one over the size of its largest group. PRIOR texts without any shingle are added to those counted,
so that in a small corpus what few texts hold isn't frequent. Weights and counts are whole numbers, so that sums are exact.

Each of HASHES samples draws a shingle in proportion to weight, the same for texts that agree in it, so that two texts
agree in a sample with a chance that is their weighted Jaccard similarity. BANDS bands of ROWS samples are hashed to
buckets; pairs at the least similarity of 0.8 meet in some bucket with a chance of 1 - (1 - 0.8**4)**12, 0.998, and more
similar ones, or ones with several ways to each other, still more surely.

Equal texts are one node. Each member of a bucket is first held against one leader, the member with the largest buckets
altogether, which the original of many copies tends to be, by the exact weighted Jaccard similarity of both whole texts.
Classes are the connected components of verified links. Members that are then still outside of their bucket's largest
class are a query set that is held against the whole bucket, in blocks of bounded size: a task multiplies the weights of
two blocks, which gives the exact similarity of every pair, and returns at most one link for each class that it joins, so
that rows grow with members and never with pairs, and a pair of texts that shows each link. Each query meets one block of its bucket first, and all blocks if that
leaves more than one class. So each pair that shares a bucket is either within one class or was verified; none is capped. Every text of a class of several texts thus has a verified link, the most
similar of which names its partner.

Defined cases: a null text counts as empty; empty texts equal each other and nothing else. Rows repeated with the same
doc_id get a class each, the same one. A null doc_id takes part: its text has a class, named by the smallest doc_id of the
class that isn't null, or null. Very long texts are read whole; a block holds fewer of them. An empty table gives an empty
result. Extra columns are kept by `keep_one` and not read, whatever their names (but `_vl_` at the front is ours).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 12, 4
HASHES = BANDS * ROWS
IDF_BITS, RARE, IDF_FLOOR = 18, 0.01, 0.05
IDF_BUCKETS = 1 << IDF_BITS
FAMILY_BANDS, FAMILY_ROWS = 6, 3
#: Texts that count besides those of the corpus, and the parts of one text in which they are counted.
PRIOR, UNIT = 1000, 1 << 30
#: The weight of one occurrence of a rare shingle.
SCALE = 256
#: Shingles that are drawn from at once, and bytes of text that are cut into shingles at once.
CHUNK, BATCH = 1 << 16, 1 << 18
#: Bytes of a block, to which each text adds its own and EACH more; tokens that a product takes at once.
BLOCK, EACH, COLUMNS = 1 << 20, 1000, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
#: The first k bytes of a word of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Odd factors of the words of a shingle by place.
_FACTORS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D)]

Bag = tuple[np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)
        return x ^ (x >> _U(32))


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables that turn 16 bits of a hash into draws: r and ln c from Gamma(2, 1), and an odd factor for each sample."""
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
    return r, np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32), rng.integers(1, 1 << 63, HASHES).astype(np.uint64) | _U(1)


def _words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all parts, number of words of each part): eight bytes of every word at a time."""
    data = np.frombuffer(b"\n".join([*parts, bytes(8)]), np.uint8)
    space = _SPACE[data]
    space[-8:] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    length = stop - start
    window = np.ndarray(len(data) - 7, np.uint64, buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        word = _mixed((window[start] & _FIRST[np.minimum(length, 8)]) + length.astype(np.uint64) * _FACTORS[0])
        at, more = 8, np.flatnonzero(length > 8)
        while len(more):
            word[more] = _mixed(word[more] * _FACTORS[4] + (window[start[more] + at] & _FIRST[np.minimum(length[more] - at, 8)]))
            at += 8
            more = more[length[more] > at]
    ends = np.cumsum([len(p) + 1 for p in parts])
    return word, np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def _counted(shingle: np.ndarray) -> Bag:
    shingle.sort()
    first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))) if len(shingle) else np.zeros(0, np.int64)
    return shingle[first], np.diff(np.append(first, len(shingle)))


def bags(texts: list[str]) -> Iterator[Bag]:
    """(hash, count) of each text's shingles, by ascending hash; texts are cut in batches of about BATCH bytes."""
    parts, size = [], 0
    for text in [*texts, None]:
        if text is None or (parts and size + len(text) > BATCH):
            word, counts = _words(parts)
            with np.errstate(over="ignore"):
                wide = max(0, len(word) - SHINGLE + 1)
                full = np.zeros(wide, np.uint64)
                for k in range(SHINGLE):
                    full += word[k : k + wide] * _FACTORS[k]
                full = _mixed(full)
                at = 0
                for n in counts.tolist():
                    if 0 < n < SHINGLE:
                        yield _counted(_mixed(sum((word[at + k : at + k + 1] * _FACTORS[k] for k in range(n)), np.full(1, n, np.uint64))))
                    else:
                        yield _counted(full[at : at + max(0, n - SHINGLE + 1)].copy())
                    at += n
            parts, size = [], 0
        if text is not None:
            parts.append(text.lower().encode("utf-8", "replace"))
            size += len(text)


def shingles(text: str) -> Bag:
    return next(bags([text]))


def idf_bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> _U(64 - IDF_BITS)).astype(np.int64)


def weights(bag: Bag, idf: np.ndarray) -> np.ndarray:
    """Whole weights of a text's shingles; idf: SCALE times the idf by hashed bucket."""
    return bag[1] * idf[idf_bucket(bag[0])]


def similar(low, high):
    """Whether the sum of minima is at least SIMILARITY of the sum of maxima; both are whole numbers."""
    return low * SIMILARITY[1] >= high * SIMILARITY[0]


def _minima(a: Bag, b: Bag, idf: np.ndarray) -> tuple[int, int]:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = weights(a, idf), weights(b, idf)
    low = int(np.minimum(wa[i], wb[j]).sum())
    return low, int(wa.sum() + wb.sum()) - low


def weighted_jaccard(a: Bag, b: Bag, idf: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two texts' weights; 1 if neither has a shingle."""
    low, high = _minima(a, b, idf)
    return low / high if high else 1.0


def _tokens(found: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, its shingle, its text's number): the n-th occurrence of a shingle in a text is the token (shingle, n)."""
    count = np.concatenate([b[1] for b in found])
    shingle = np.repeat(np.concatenate([b[0] for b in found]), count)
    nth = np.arange(len(shingle)) - np.repeat(np.cumsum(count) - count, count)
    text = np.repeat(np.arange(len(found)), [int(b[1].sum()) for b in found])
    with np.errstate(over="ignore"):
        return np.where(nth == 0, shingle, _mixed(shingle + nth.astype(np.uint64) * _FACTORS[1])), shingle, text


def all_similar(one: list[Bag], other: list[Bag], idf: np.ndarray) -> np.ndarray:
    """Which pairs of the two lists are similar (a matrix of booleans), by products over the tokens that both lists hold.

    The sum of minima of two texts is the weight of the tokens that they share. All numbers are whole; where a sum could
    pass 2**24, the product is taken in double precision, so that it is exact in either case.
    """
    wx, wy = (np.array([int(weights(b, idf).sum()) for b in part], np.int64) for part in (one, other))
    (tx, sx, x), (ty, _, y) = _tokens(one), _tokens(other)
    shared = np.intersect1d(tx, ty)
    kind = np.float32 if max(wx.max(), wy.max()) < 1 << 24 else np.float64
    low = np.zeros((len(one), len(other)), kind)
    px, py = np.searchsorted(shared, tx), np.searchsorted(shared, ty)
    in_x, in_y = (shared[np.minimum(p, len(shared) - 1)] == t if len(shared) else np.zeros(len(t), bool) for p, t in ((px, tx), (py, ty)))
    px, x, weight, py, y = px[in_x], x[in_x], idf[idf_bucket(sx[in_x])], py[in_y], y[in_y]
    order_x, order_y = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    for at in range(0, len(shared), COLUMNS):
        cut_x, cut_y = (o[slice(*np.searchsorted(p, (at, at + COLUMNS), sorter=o))] for p, o in ((px, order_x), (py, order_y)))
        wide = min(COLUMNS, len(shared) - at)
        left, right = np.zeros((len(one), wide), kind), np.zeros((len(other), wide), kind)
        left[x[cut_x], px[cut_x] - at] = weight[cut_x]
        right[y[cut_y], py[cut_y] - at] = 1
        low += left @ right.T
    low = low.astype(np.int64)
    return similar(low, wx[:, None] + wy[None, :] - low)


def joining(alike: np.ndarray, class_x: np.ndarray, class_y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of classes (numbers) that similar pairs join: a spanning forest of the classes, one pair less than it joins."""
    of_x, of_y = ({c: np.flatnonzero(own == c) for c in np.unique(own).tolist()} for own in (class_x, class_y))
    seen, out = set(), []
    for begin in of_x:
        todo = [] if begin in seen else [begin]
        seen.add(begin)
        while todo:
            c = todo.pop()
            near = []
            if c in of_x:
                near.append(class_y[alike[of_x[c]].any(0)])
            if c in of_y:
                near.append(class_x[alike[:, of_y[c]].any(1)])
            for d in np.unique(np.concatenate(near)).tolist():
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
                    out.append((c, d))
    return out


def joined_by(alike: np.ndarray, class_x: np.ndarray, class_y: np.ndarray, pair: tuple[int, int]) -> tuple[int, int]:
    """A row and a column of `alike` that join the two classes."""
    for c, d in (pair, pair[::-1]):
        x, y = np.flatnonzero(class_x == c), np.flatnonzero(class_y == d)
        hit = np.argwhere(alike[np.ix_(x, y)])
        if len(hit):
            return int(x[hit[0, 0]]), int(y[hit[0, 1]])
    raise ValueError("no similar texts of these classes")


def _band_hashes(texts: list[str], sampled: Callable[[list[Bag], np.ndarray, np.ndarray], np.ndarray], bands: int, rows: int) -> list:
    """int64 band hashes of each text, None for one without shingles; in chunks of about CHUNK shingles.

    sampled: samples (texts x bands * rows) of some texts, from their bags, all their shingles and where each text's begin.
    """
    out: list = [None] * len(texts)
    part: list[tuple[int, Bag]] = []
    size = 0
    for k, bag in enumerate([*bags(texts), None]):
        if part and (bag is None or size + len(bag[0]) > CHUNK):
            own = [b for _, b in part]
            first = np.concatenate(([0], np.cumsum([len(b[0]) for b in own])[:-1]))
            samples = sampled(own, np.concatenate([b[0] for b in own]), first).astype(np.uint64).reshape(len(part), bands, rows)
            band = np.zeros((len(part), bands), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    band = _mixed(band * _FACTORS[4] + samples[:, :, r] + _U(r + 1))
            for (at, _), b in zip(part, band.view(np.int64), strict=True):
                out[at] = b
            part, size = [], 0
        if bag is not None and len(bag[0]):
            part.append((k, bag))
            size += len(bag[0])
    return out


def family_bands(texts: list[str]) -> list:
    """Band hashes of each text by plain min-hashes, None for one without shingles."""
    factors = _draws()[2][: FAMILY_BANDS * FAMILY_ROWS]

    def least(_: list[Bag], key: np.ndarray, first: np.ndarray) -> np.ndarray:
        out, h, s = np.empty((len(first), len(factors)), np.uint64), np.empty(len(key), np.uint64), np.empty(len(key), np.uint64)
        with np.errstate(over="ignore"):
            for i, factor in enumerate(factors):
                np.multiply(key, factor, out=h)
                np.right_shift(h, _U(32), out=s)
                np.bitwise_xor(h, s, out=h)
                np.multiply(h, _FACTORS[3], out=h)
                out[:, i] = np.minimum.reduceat(h, first)
        return out

    return _band_hashes(texts, least, FAMILY_BANDS, FAMILY_ROWS)


class Sampler:
    """Band hashes of texts by improved consistent weighted sampling."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.r, self.ln_c, self.factors = _draws()

    def signatures(self, key: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Samples (texts x HASHES) of texts whose shingles lie one after another, each text's from `first` on.

        Of a shingle with weight w: t = floor(ln w / r + beta), and ln a = ln c - r (t - beta + 1); t is 0 where w is SCALE,
        as it mostly is. The shingle with the least a is drawn, together with t. Both fit into one integer whose upper half
        keeps the order of a.
        """
        n = len(key)
        out = np.empty((len(first), HASHES), np.uint32)
        ln_w = np.log(weight / SCALE).astype(np.float32)
        odd = np.flatnonzero(ln_w)
        ln_w, high = ln_w[odd], key >> _U(32)
        h, s, r, ln_a, x = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.float32), np.empty(n, np.float32), np.empty(n, np.float32)
        bits, sign = ln_a.view(np.int32), np.empty(n, np.int32)
        quarters = h.view(np.uint16).reshape(-1, 4)
        with np.errstate(over="ignore"):
            for i, factor in enumerate(self.factors):
                np.multiply(key, factor, out=h)
                np.right_shift(h, _U(32), out=s)
                np.bitwise_xor(h, s, out=h)
                np.multiply(h, _FACTORS[3], out=h)
                np.right_shift(h, _U(32), out=s)
                np.bitwise_xor(h, s, out=h)
                np.take(self.r, quarters[:, 0], out=r, mode="clip")
                np.take(self.ln_c, quarters[:, 1], out=ln_a, mode="clip")
                np.multiply(quarters[:, 2], np.float32(2**-16), out=x)
                np.right_shift(h, _U(48), out=s)
                np.bitwise_xor(s, high, out=s)
                if len(odd):
                    t = np.floor(ln_w / r[odd] + x[odd])
                    x[odd] -= t
                    s[odd] ^= (t.astype(np.int64).astype(np.uint64) * _U(0x9E3779B1)) & _U(0xFFFFFFFF)
                np.subtract(x, np.float32(1), out=x)
                np.multiply(x, r, out=x)
                np.add(ln_a, x, out=ln_a)
                np.right_shift(bits, 31, out=sign)  # a float's bits, flipped so that they ascend with it
                np.bitwise_or(sign, np.int32(-(1 << 31)), out=sign)
                np.bitwise_xor(bits, sign, out=sign)
                h[:] = sign.view(np.uint32)
                np.left_shift(h, _U(32), out=h)
                np.bitwise_or(h, s, out=h)
                out[:, i] = np.minimum.reduceat(h, first)  # the lower half
        return out

    def bands(self, texts: list[str]) -> list:
        """Band hashes of each text, None for one without shingles."""

        def sampled(own: list[Bag], key: np.ndarray, first: np.ndarray) -> np.ndarray:
            return self.signatures(key, np.concatenate([weights(b, self.idf) for b in own]), first)

        return _band_hashes(texts, sampled, BANDS, ROWS)


def _family_sizes(nodes: DataFrame, tables: common.Tables) -> DataFrame:
    """node, family: the size of the largest group of texts with an equal band of plain min-hashes, where that isn't the text alone. nodes: node, text."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(family_bands(part.column(1).to_pylist()), pa.list_(pa.int64()))], ["node", "bands"])

    banded = tables.write(nodes.select("node", "text").mapInArrow(tasks, "node binary, bands array<long>"), "families")
    spread = banded.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    sizes = tables.write(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "family-sizes")
    met = common.attach_stats(spread, sizes, "bucket", "n", common.total_of(sizes, "n"), ["node"]).filter(F.col("n").isNotNull())
    return tables.write(met.groupBy("node").agg(F.max("n").alias("family")), "family")


def inverse_frequencies(nodes: DataFrame, tables: common.Tables | None = None, idf_floor: float = IDF_FLOOR) -> np.ndarray:
    """SCALE times the idf by hashed bucket, whole numbers, from all rows of nodes (node, text): IDF_BUCKETS counts reach the driver, whatever the input.

    A task adds up its batches in a table of its own and gives its non-zero counters; Spark sums them by bucket.
    """
    common.ship(nodes.sparkSession)
    own = tables or common.Tables(nodes.sparkSession)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(IDF_BUCKETS, np.int64), 0
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                for (shingle, _), family in zip(bags(part.column(0).to_pylist()), part.column(1).to_pylist(), strict=True):
                    np.add.at(seen, idf_bucket(shingle), UNIT // family)
                    n += UNIT // family
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(full, -1), pa.int32()), "n": pa.array(np.append(seen[full], n), pa.int64())})

    sized = nodes.select("node", "text").join(_family_sizes(nodes, own), "node", "left").select("text", F.coalesce("family", F.lit(1).cast("long")).alias("family"))
    sums = sized.mapInArrow(tasks, "bucket int, n long").groupBy("bucket").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toPandas()
    if tables is None:
        own.drop()
    n = float(sums.loc[sums["bucket"] < 0, "n"].sum()) / UNIT + PRIOR
    df = np.zeros(IDF_BUCKETS)
    held = sums[sums["bucket"] >= 0]
    df[held["bucket"].to_numpy()] = held["n"].to_numpy() / UNIT
    share = np.clip((df - df.mean()) / n, RARE, 1)
    return np.rint(SCALE * np.maximum(idf_floor, np.log(1 / share) / np.log(1 / RARE))).astype(np.int64)


def _digest():
    """The first half of the text's SHA-256: 16 bytes tell texts apart at any number of documents."""
    return F.unhex(F.substring(F.sha2(common.plain_text(), 256), 1, 32))


def _banded(nodes: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, size (bytes of its text, and EACH more), band hashes for each row of nodes (node, text)."""
    common.ship(nodes.sparkSession)
    shared = nodes.sparkSession.sparkContext.broadcast(idf)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                bands = sampler.bands(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bands, pa.list_(pa.int64()))], ["node", "size", "bands"])

    rows = nodes.select("node", (F.octet_length("text") + F.lit(EACH)).cast("long").alias("size"), "text")
    return rows.mapInArrow(tasks, "node binary, size long, bands array<long>")


def _verified(texts: DataFrame, pairs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Those of pairs (a, b: nodes) whose texts (node, text) are similar, and their similarity."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bag = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                good, sums = [], []
                for leader, text, found in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), bags(part.column(2).to_pylist()), strict=True):
                    if own != leader:  # pairs of one leader tend to come one after another
                        own, bag = leader, shingles(text)
                    low, high = _minima(found, bag, shared.value)
                    good.append(similar(low, high))
                    sums.append(low / high if high else 1.0)
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(sums, pa.float64()).filter(keep)], ["a", "b", "similarity"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(tasks, "a binary, b binary, similarity double")


def components(links: DataFrame, tables: common.Tables | None = None) -> DataFrame:
    """node, root: the least node of the connected component, for all nodes of links (a, b).

    Each round takes the least root next to a node and then that root's own root, so that chains halve. Labels are written
    after every second round, so that a lost executor costs two. Links are stars mostly, so that rounds are few. Both joins
    put plain exchanges against each other, which lets AQE split a node with very many links.
    """
    tables = tables or common.Tables(links.sparkSession)
    edges = tables.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = tables.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        old = labels
        for _ in range(2):  # two rounds for each table that is written
            heard = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
            least = heard.union(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("low"))
            ahead = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
            labels = least.join(ahead, "low").select("node", F.least("low", "next").alias("root"))
        labels = tables.write(labels.join(old.withColumnRenamed("root", "old"), "node"), "labels")
        if labels.filter("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def classes(docs: DataFrame, idf_floor: float = IDF_FLOOR) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the least doc_id of the class), class_size (rows), texts (different ones), partner_id, similarity, digest, root.

    partner_id: the least doc_id of another text of the class with a verified link to the row's own, the most similar one
    that was verified (not all pairs within a class are); null, as its similarity, where the class is one text. digest and
    root: of the text and of its class.
    """
    tables = common.Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), common.plain_text().alias("text"))
    nodes = docs.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("text").alias("text"))
    nodes = tables.write_bucketed(nodes, "nodes", "node", "zstd")
    idf = inverse_frequencies(nodes, tables, idf_floor)
    banded = tables.write(_banded(nodes.select("node", "text"), idf), "bands")
    spread = banded.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    spread = spread.select("node", "size", F.xxhash64("band", "hash").alias("bucket"))
    sizes = tables.write(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    total = common.total_of(sizes, "n")
    met = common.attach_stats(spread, sizes, "bucket", "n", total, ["node"]).filter(F.col("n").isNotNull())
    met = tables.write(met, "met")
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    weight = tables.write(weight, "weight")
    texts = tables.write(nodes.select("node", "text").join(weight, "node", "left_semi"), "texts", "zstd")
    met = tables.write(met.join(weight, "node").select("bucket", "node", "size", "weight"), "met")
    pairs = tables.write(_to_leaders(met, tables, total), "pairs")
    verified = tables.write(_verified(texts, pairs, idf), "links")
    labels = components(verified, tables)
    known = tables.write(nodes.select("node", "least", "copies").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
    rooted = tables.write(met.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root")), "rooted")
    for whole in (False, True):
        mixed = _mixed_buckets(rooted, tables).filter(F.col("blocks") > int(whole))  # the first turn has met buckets of one block whole
        if not mixed.isEmpty():
            found = tables.write(_links_apart(rooted, mixed, texts, idf, total, whole), "links")
            verified = verified.union(found.select("x", "y", "similarity"))
            moved = components(found, tables).withColumnRenamed("node", "old").withColumnRenamed("root", "new")
            known, rooted = (
                tables.write(x.withColumnRenamed("root", "old").join(moved, "old", "left").select(*[c for c in x.columns if c != "root"], F.coalesce("new", "old").alias("root")), name) for x, name in ((known, "known"), (rooted, "rooted"))
            )
    by_root = tables.write(known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("texts")), "roots")
    stats = common.attach_stats(known, by_root, "root", "texts", common.total_of(by_root, "texts"), ["node"])
    stats = stats.join(_partners(verified, known, tables), "node", "left")
    stats = tables.write(stats.select(F.col("node").alias("digest"), "copies", "root", "class_id", "class_size", "texts", "partner_id", "similarity"), "stats", keep=True)
    tables.drop()
    out = common.attach_stats(docs.select("doc_id", "digest"), stats, "digest", "copies", common.total_of(stats, "copies"), ["doc_id"])
    return out.select("doc_id", "class_id", "class_size", "texts", "partner_id", "similarity", "digest", "root")


def _partners(verified: DataFrame, known: DataFrame, tables: common.Tables) -> DataFrame:
    """node, partner_id, similarity: the most similar of each text's verified links (a, b, similarity), named by its least doc_id (known: node, least)."""
    both = verified.toDF("node", "partner", "similarity")
    both = both.union(both.select("partner", "node", "similarity"))
    best = both.groupBy("node").agg(F.max(F.struct("similarity", "partner")).alias("o"))
    best = tables.write(best.select("node", "o.partner", "o.similarity"), "partners")
    followed = best.groupBy("partner").agg(F.count("*").alias("n"))  # an original may be the partner of a third of all texts
    named = tables.write(followed.join(known.select(F.col("node").alias("partner"), F.col("least").alias("partner_id")), "partner"), "followed")
    return common.attach_stats(best, named, "partner", "n", common.total_of(named, "n"), ["node"]).select("node", "partner_id", "similarity")


def _to_leaders(met: DataFrame, tables: common.Tables, total: int) -> DataFrame:
    """Pairs (a, b) of each member of a bucket and its leader, the member with the largest weight. met: bucket, node, weight."""
    lead = met.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("o"), F.count("*").alias("members"))
    lead = tables.write(lead.select("bucket", "members", F.col("o.node").alias("leader")), "lead")
    pairs = common.attach_stats(met.select("bucket", "node"), lead, "bucket", "members", total, ["node"]).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    return pairs.filter("a <> b").distinct()


def _mixed_buckets(rooted: DataFrame, tables: common.Tables) -> DataFrame:
    """Buckets of over two members in several classes: bucket, members, blocks, q_blocks (of members outside of the largest class), main (that class)."""
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    mixed = sizes.groupBy("bucket").agg(F.sum("m").alias("members"), F.sum("s").alias("s"), F.count("*").alias("classes"), F.max(F.struct("m", "root", "s")).alias("main"))
    blocks = lambda s: F.ceil(s / F.lit(BLOCK)).cast("long")
    mixed = mixed.filter("classes > 1 and members > 2")
    return tables.write(mixed.select("bucket", "members", blocks(F.col("s")).alias("blocks"), blocks(F.col("s") - F.col("main.s")).alias("q_blocks"), F.col("main.root").alias("main")), "mixed")


def _links_apart(rooted: DataFrame, mixed: DataFrame, texts: DataFrame, idf: np.ndarray, total: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of classes that similar texts (x, y) join, of members that aren't in the largest class of their bucket with all others.

    rooted: bucket, node, root. Each block of these members meets each block of the bucket, or, unless `whole`, one. A group
    is two blocks of about BLOCK bytes, and returns fewer rows than it has classes.
    """
    shared = rooted.sparkSession.sparkContext.broadcast(idf)
    rows = common.attach_stats(rooted.select("bucket", "node", "root"), mixed, "bucket", "members", total, ["node"]).filter(F.col("members").isNotNull())
    own, each = lambda k, seed: F.pmod(F.xxhash64("node", F.lit(seed)), k), lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    n, q = F.col("blocks"), F.col("q_blocks")
    against = rows.select("bucket", "node", "root", F.lit(False).alias("asks"), own(n, 1).alias("block"), each(q).alias("q_block"))
    asking = rows.filter(F.col("root") != F.col("main")).withColumn("q_block", own(q, 2))
    asking = asking.select("bucket", "node", "root", F.lit(True).alias("asks"), each(n).alias("block") if whole else F.pmod(F.xxhash64("q_block", "bucket"), n).alias("block"), "q_block")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        out: list = []
        if asks.any() and not asks.all():
            number, roots = pd.factorize(pdf["root"].map(bytes))
            found = list(bags(pdf["text"].tolist()))
            one, other = np.flatnonzero(asks), np.flatnonzero(~asks)
            alike = all_similar([found[i] for i in one], [found[i] for i in other], shared.value)
            node = pdf["node"].to_numpy()
            for pair in joining(alike, number[one], number[other]):
                x, y = joined_by(alike, number[one], number[other], pair)
                x, y = one[x], other[y]
                out.append((roots[pair[0]], roots[pair[1]], node[x], node[y], weighted_jaccard(found[x], found[y], shared.value)))
        return pd.DataFrame(out, columns=["a", "b", "x", "y", "similarity"])

    groups = against.unionByName(asking).join(texts, "node").select("bucket", "block", "q_block", "node", "root", "asks", "text")
    return groups.groupBy("bucket", "block", "q_block").applyInPandas(compare, "a binary, b binary, x binary, y binary, similarity double")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each class the row named by class_id, with all columns.

    Rows leave by an anti-join on (doc_id, digest). Of rows repeated with the same doc_id any one stays.
    """
    judged = common.materialize(classes(docs).select("doc_id", "class_id", "digest", "root"), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    out = docs.withColumn("_vl_digest", _digest())

    def same(found: DataFrame):
        return out["doc_id"].cast("long").eqNullSafe(found["_vl_id"]) & (out["_vl_digest"] == found["_vl_own"])

    keepers = judged.filter(stays).groupBy("root").agg(F.min("digest").alias("_vl_own"), F.min("class_id").alias("_vl_id"), F.count("*").alias("_vl_n"))
    if keepers.filter("_vl_n > 1").isEmpty():
        gone = judged.filter(~stays).select(F.col("doc_id").alias("_vl_id"), F.col("digest").alias("_vl_own"))
        return out.join(gone, same(gone), "left_anti").drop("_vl_digest")
    return out.join(keepers, same(keepers), "left_semi").dropDuplicates(["doc_id", "_vl_digest"]).drop("_vl_digest")
