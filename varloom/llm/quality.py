"""Operator 3, quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of the vectors of its words and character n-grams, each found by hash in one table of BUCKETS
vectors, under a softmax of two classes. Training runs on the driver over at most `per_class` labelled documents of each
class, chosen by a seeded hash of their id and read whole: the one bound on what is learnt from. The classes weigh
the same, so that a score is near 1/2 where the evidence is.

Scoring runs over all whole texts in Arrow batches. The output layer is linear in the mean, so a trained table collapses
to one number a bucket, as integers of 2**-SCALE: a document's score is a sum of integers over its features, the same in
any batch and order. What is sent to the tasks is that table, BUCKETS * 4 bytes whatever the input.

Words are runs between ASCII white space, in UTF-8 as they are, and count alone and in pairs; n-grams are of 3 to 5 bytes. Only the text is
read. Defined cases: a null text counts as empty; a text without features gets a score from the bias alone. Labels that
are null, or whose document is absent, aren't used; with no label of one class all scores are 1/2. Repeated rows are
scored each. An empty table gives an empty result. Extra columns pass through `keep_good` unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import common

BITS, DIM, SCALE = 18, 8, 16
BUCKETS = 1 << BITS
NGRAMS = (3, 4, 5)
THRESHOLD = 0.3
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    """Bucket numbers of hashes; kind tells words from n-grams of each length."""
    h = (h ^ np.uint64(kind * 0x51ED2701)) * _P
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a byte array: the sum of its bytes, each times a factor by place in the word."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start = edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        inside = np.arange(len(data)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(data)]))))
        factor = (np.minimum(inside, 255).astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _P
        term = (data.astype(np.uint64) + np.uint64(1)) * (factor ^ (factor >> np.uint64(29)))
        term[space] = 0
        return start, np.add.reduceat(term, start)


def features(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first position, last position, bucket) of all features of a byte array, kind by kind; positions ascend.

    Kinds: words, pairs of neighbouring words, then n-grams by length. A word next to itself is one and the same pair whatever the word.
    """
    with np.errstate(over="ignore"):
        start, words = _word_hashes(data)
        yield start, start, _mix(words ^ (words >> np.uint64(31)), 1)
        a, b = words[:-1], words[1:]
        yield start[:-1], start[1:], _mix(np.where(a == b, np.uint64(0), a * np.uint64(3) + b), 2)
        wide, gram = data.astype(np.uint64), np.zeros(len(data), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            if len(data) < n:
                break
            gram = (gram[: len(data) - n + 1] << np.uint64(8)) | wide[n - 1 :]
            if n in NGRAMS:
                at = np.arange(len(gram))
                yield at, at + (n - 1), _mix(gram * np.uint64(0xC2B2AE3D27D4EB4F), n)


def text_features(text: str) -> np.ndarray:
    return np.concatenate([b for _, _, b in features(np.frombuffer(text.encode(), np.uint8))])


@dataclass
class Model:
    """margin: for each bucket its share in the difference of the two classes' outputs, times 2**SCALE; bias likewise."""

    margin: np.ndarray
    bias: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """P(label 1) of each text: all texts of a chunk go through numpy together, apart from each other's features."""
        out, k = np.zeros(len(texts)), 0
        raw = [t.encode() for t in texts]
        while k < len(raw):
            last, size = k, 0
            while last < len(raw) and (last == k or size + len(raw[last]) <= CHUNK):
                size, last = size + len(raw[last]) + max(NGRAMS), last + 1
            out[k:last] = self._chunk(raw[k:last])
            k = last
        return out

    def _chunk(self, raw: list[bytes]) -> np.ndarray:
        gap = b"\n" * max(NGRAMS)  # texts are apart by white space; n-grams that touch it from outside are left out below
        sizes = np.array([len(r) for r in raw])
        begin = np.concatenate(([0], np.cumsum(sizes + len(gap))[:-1]))
        data = np.frombuffer(gap.join(raw) + gap, np.uint8)
        total, count = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        for first, last, bucket in features(data):
            sums = np.concatenate(([0], np.cumsum(self.margin[bucket], dtype=np.int64)))
            lo = np.searchsorted(first, begin)
            hi = np.maximum(lo, np.searchsorted(last, begin + sizes))
            total += sums[hi] - sums[lo]
            count += hi - lo
        z = (total / np.maximum(count, 1) + self.bias) / (1 << SCALE)
        return 1 / (1 + np.exp(-z))


def train(texts: list[str], labels: list[int], epochs: int = 3, rate: float = 4.0, seed: int = 5) -> Model:
    """SGD over documents in a seeded order, the rate falling to zero; both classes weigh the same."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.int32), 0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    weight = {c: len(labels) / (2 * labels.count(c)) for c in (0, 1)}
    done, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)).tolist():
            now, done = rate * (1 - done / steps), done + 1
            bucket = text_features(texts[k])
            if not len(bucket):
                continue
            count = np.bincount(bucket, minlength=0)
            used = np.flatnonzero(count)
            share = (count[used] / len(bucket)).astype(np.float32)
            x = share @ table[used]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]]
            back = out @ p
            out -= now * np.outer(x, p)
            bias -= now * 0.1 * p
            table[used] -= now * np.outer(share, back)
    margin = table @ (out[:, 1] - out[:, 0])
    return Model(np.round(margin * (1 << SCALE)).astype(np.int32), int(round(float(bias[1] - bias[0]) * (1 << SCALE))))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, epochs: int = 3) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality), without held-out documents.

    Ids are chosen among labels alone; texts of the chosen few are then found by a join with that bounded table.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "quality")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(5))
    chosen = known.filter("quality = 0").orderBy(order, "doc_id").limit(per_class).unionByName(known.filter("quality = 1").orderBy(order, "doc_id").limit(per_class))
    chosen = common.materialize(chosen, "chosen")  # at most 2 * per_class rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.plain_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality")).orderBy("doc_id").collect()
    return train([r["text"] for r in rows], [r["quality"] for r in rows], epochs)


def score_column(model: Model, spark):
    """A column function of text: P(label 1), rounded to 6 digits."""
    common.ship(spark)
    shared = spark.sparkContext.broadcast((model.margin, model.bias))

    @pandas_udf("double")
    def score(texts):
        return texts.__class__(np.round(Model(*shared.value).scores(texts.tolist()), 6))

    return lambda text: score(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = fit(docs, labels, per_class)
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(own.scores(part.column(1).to_pylist()), 6))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.plain_text().alias("text")).mapInArrow(tasks, "doc_id long, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a score of at least THRESHOLD, with all their columns."""
    scored = score_column(model, docs.sparkSession)
    return docs.withColumn("_vl_score", scored(F.col("text"))).filter(F.col("_vl_score") >= THRESHOLD).drop("_vl_score")
