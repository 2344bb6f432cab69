"""Operator 13, cross-tokenizer alignment: external spill counting of linked token pairs.

Tokenizer A is byte-level BPE, B is sentencepiece BPE with byte fallback. Both cover the bytes of a space and the text. Where a token of A and one of B
end at the same byte they cut the text into groups; a token of A and one of B whose bytes overlap are a link. The ends of both, merged, cut the
bytes into ranges that belong to one token of A and one of B each, so that ranges are links, and common ends are groups.

1. Map: documents are aligned in blocks of about `block_links` links. A block's pair-document records (pair of ids, document, how often) are sorted by pair and
   radix-partitioned by the low bits of A's id; each part is one zstd run: its pairs with the number of documents that hold them, and
   apart from these the documents. Runs and the rows of documents go to one table in the shared folder.
2. Reduce: a radix's runs are merged by a heap over their next ids of A (side-major order): slices of the same id come together, equal pairs are added
   up, and when the heap goes on to the next id the highest count of the last one is known. A merge takes at most `fan_in` runs; where there are more,
   merged runs are merged again, so that no task holds more. Each run names a pair once, so that a pair that all documents share is a
   record a run.
3. Back: a radix's counted pairs meet its runs; each run streams its documents' shares (count sums and links with the best count), which are
   added up by block and joined with the documents' rows.

A token of A never reaches over a space that follows a character other than white space, and neither does one of B (checked for the vocabulary when it is
loaded), so that words between such spaces have the same ids in every text. A worker aligns the new words of many texts at once, and keeps a bounded
number of words.

Defined cases: texts that are null or empty, or whose joined tokens differ from the space and the text in bytes (as with U+2581), have no tokens: zeros and an
empty digest. Strings of special tokens are ordinary text. Texts of any length are aligned whole, white space of any length included. Repeated rows and repeated
ids are documents of their own. A null doc_id is kept. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing

#: B's ids fit these bits; a pair is a * 2^15 + b.
B_BITS = 15
RADIX = 64
#: A worker forgets its words beyond this number, or this number of characters; texts are aligned so many characters at a time.
WORDS, CHARS, CHUNK = 300_000, 8_000_000, 1_000_000
#: A space that follows something other than white space.
BOUNDARY = re.compile(r"(?<=\S)(?= )")
ODD = re.compile(r"\s ")
TABLE = "block long, radix int, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary, docs binary, times binary"
LONG = "<i8"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def squeeze(x: np.ndarray, kind: str = "<i4") -> bytes:
    """An array of whole numbers as a zstd frame of its differences. Without kind, numbers are from 0 to below 2^31."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x.astype("<i8"), prepend=0).astype(kind).tobytes())


def spread(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind).cumsum(dtype=np.int64)


class Aligner:
    """Both tokenizers, once a Python worker, and the words it has met, with their tokens, groups, links and the groups' text.

    a_path, b_path: the tokenizers' files; the public vocabularies if None. A word is what follows a space, up to the next boundary.
    """

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.a = packing.encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.max_token_value + 1)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << B_BITS:
            raise ValueError("ids of B need more bits")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.by_words = not any(re.search(r"[^▁]▁", p) for p, byte in pieces if not byte)
        self.blank = self.b.piece_to_id("▁")
        n, m = len(self.a_bytes), len(pieces)
        self.names = np.array([f"{i}{end}" for size, ends in ((n, ",|"), (m, ",;")) for end in ends for i in range(size)], dtype=object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.texts = 0, []
        self.pairs, self.cuts, self.numbers = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, 3), np.int64)

    def split(self, text: str) -> list[str] | None:
        """The words of a text; None for one that B can't give back."""
        if "▁" in text:
            return None
        full = " " + text
        if not self.by_words:
            return [text]
        return [p[1:] for p in BOUNDARY.split(full)] if ODD.search(full) else full.split(" ")[1:]

    def learn(self, words: list[str]) -> None:
        """Align words that aren't known. Those that end in white space can't be joined with others."""
        joined = [w for w in words if w and not w[-1].isspace()] if self.by_words else []
        if joined:
            self._add(joined)
        for w in words if len(joined) < len(words) else ():
            if w not in self.known:
                self._add([w])

    def _add(self, words: list[str]) -> None:
        text = " " + " ".join(words)
        ids_a, ids_b, data = packing.plain_ids(text, self.a), self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.blank], text.encode()
        good = b"".join(map(self.a_bytes.__getitem__, ids_a)) == data == b"".join(map(self.b_bytes.__getitem__, ids_b))
        if not good and len(words) > 1:
            self._add(words[: len(words) // 2])
            self._add(words[len(words) // 2 :])
            return
        if not good:
            self.known[words[0]] = -1
            return
        a, b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = self.a_sizes[a].cumsum(), self.b_sizes[b].cumsum()
        ends = np.union1d(ends_a, ends_b)  # of links: ranges of bytes that belong to one token of each side
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = ends[(ends_a[at_a] == ends) & (ends_b[at_b] == ends)]  # of groups
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        links, n_a, n_b, groups = (np.searchsorted(x, word_ends, "right") for x in (ends, ends_a, ends_b, both))
        pairs = (a[at_a] << B_BITS) + b[at_b]
        # text: A's and then B's ids of each group, with what separates them
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        of_a, of_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        before_a, before_b = of_a.cumsum() - of_a, of_b.cumsum() - of_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before_b[group_a]] = a + len(self.a_bytes) * (ends_a == both[group_a])
        codes[np.arange(len(b)) + (before_a + of_a)[group_b]] = 2 * len(self.a_bytes) + b + len(self.b_bytes) * (ends_b == both[group_b])
        names, at = self.names[codes].tolist(), 0
        for w, end in zip(words, (n_a + n_b).tolist(), strict=True):
            self.known[w] = len(self.texts)
            self.texts.append("".join(names[at:end])[:-1])
            at = end
        self.chars += len(text)
        self.numbers = np.concatenate([self.numbers, np.diff(np.stack([n_a, n_b, groups], 1), axis=0, prepend=0)])
        self.cuts, self.pairs = np.concatenate([self.cuts, len(self.pairs) + links]), np.concatenate([self.pairs, pairs])

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, str] | None], np.ndarray, np.ndarray]:
        """(tokens of A, of B, groups, the groups' text) of each text or None, and all links: the text's number and the pair."""
        words = [self.split(t) if t else None for t in texts]
        distinct = set().union(*[w for w in words if w])
        if len(self.known) > WORDS or self.chars > CHARS:
            self.forget()
        self.learn([w for w in distinct if w not in self.known])
        out, every, counts = [], [], []
        for ws in words:
            at = list(map(self.known.__getitem__, ws)) if ws else [-1]
            if min(at) < 0:
                out.append(None)
                counts.append(0)
                continue
            every += at
            counts.append(len(at))
            out.append((*self.numbers[at].sum(0).tolist(), ";".join(map(self.texts.__getitem__, at))))
        at = np.array(every, np.int64)
        first, size = self.cuts[at], self.cuts[at + 1] - self.cuts[at]
        places = np.repeat(first - (size.cumsum() - size), size) + np.arange(size.sum())
        return out, np.repeat(np.repeat(np.arange(len(texts)), counts), size), self.pairs[places]


_aligners: dict = {}


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def runs_of(keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, dict]]:
    """By radix, the columns of a run: keys are (pair << 24) + document, sorted."""
    pair, doc = keys >> 24, keys & 0xFFFFFF
    radix = (pair >> B_BITS) % RADIX
    order = np.argsort(radix, kind="stable")
    cuts = np.searchsorted(radix[order], np.arange(RADIX + 1))
    for r in range(RADIX):
        own = order[cuts[r] : cuts[r + 1]]
        if len(own):
            starts = np.flatnonzero(np.diff(pair[own], prepend=-1))
            n = np.diff(starts, append=len(own))
            yield r, {"pairs": squeeze(pair[own][starts]), "counts": squeeze(n, LONG), "docs": squeeze(doc[own]), "times": squeeze(times[own])}


def _aligned(docs: DataFrame, block_links: int, a_path: str | None, b_path: str | None) -> DataFrame:
    """TABLE: a row a document (radix is null) and a row a run."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = {c.split()[0]: types[c.split()[1]] for c in TABLE.split(", ")}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields.items()], list(fields))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, chars = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars >= CHUNK or len(ids) == 1 << 14:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
        yield ids, texts

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        block, rows, keys, links = TaskContext.get().partitionId() << 32, [], [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            yield batch(rows)
            if links:
                for radix, run in runs_of(*np.unique(np.concatenate(keys), return_counts=True)):
                    yield batch([{"block": block, "radix": radix} | run])

        for ids, texts in chunks(batches):
            found, doc, pair = both.align(texts)
            keys.append((pair << 24) + doc + len(rows))
            n_links = np.bincount(doc, minlength=len(texts)).tolist()
            for doc_id, f, n in zip(ids, found, n_links, strict=True):
                n_a, n_b, groups, text = f or (0, 0, 0, "")
                digest = hashlib.sha256(text.encode()).hexdigest() if f else ""
                rows.append({"block": block, "pos": len(rows), "doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": n, "groups_sha256": digest})
            links += len(pair)
            if links >= block_links or len(rows) >= 1 << 16:
                yield from finished()
                block, rows, keys, links = block + 1, [], [], 0
        if rows:
            yield from finished()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.plain_text().alias("text")).mapInArrow(tasks, TABLE)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of an id of A with their counts, id after id: a heap holds each run's next id, and equal pairs are added up."""
    heads = [np.flatnonzero(np.diff(pairs >> B_BITS, prepend=-1, append=-1)).tolist() for pairs, _ in runs]
    heap = [(int(pairs[0] >> B_BITS), k, 0) for k, (pairs, _) in enumerate(runs) if len(pairs)]
    heapq.heapify(heap)
    while heap:
        a, slices = heap[0][0], []
        while heap and heap[0][0] == a:
            _, k, i = heap[0]
            pairs, counts = runs[k]
            start, end = heads[k][i], heads[k][i + 1]
            slices.append((pairs[start:end], counts[start:end]))
            if end < len(pairs):
                heapq.heapreplace(heap, (int(pairs[end] >> B_BITS), k, i + 1))
            else:
                heapq.heappop(heap)
        if len(slices) == 1:
            yield slices[0]
            continue
        pairs, at = np.unique(np.concatenate([s[0] for s in slices]), return_inverse=True)
        yield pairs, np.bincount(at, np.concatenate([s[1] for s in slices])).astype(np.int64)


def _merge(runs: DataFrame, merges: int) -> DataFrame:
    """radix, seq, pairs, counts and best of runs (radix, seq, pairs, counts): those of a radix in `merges` merges, by seq.

    best is 1 where a pair has the highest count of its id of A in its merge.
    """
    schema = "radix int, seq long, pairs binary, counts binary, best binary"

    def one(key: tuple, runs: pa.Table) -> pa.Table:
        slices = list(merged([(spread(p), spread(c, LONG)) for p, c in zip(runs["pairs"].to_pylist(), runs["counts"].to_pylist(), strict=True)]))
        pairs, counts = (np.concatenate(c) for c in zip(*slices, strict=True))
        best = np.concatenate([c == c.max() for _, c in slices])
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "seq": pa.array([key[1].as_py()], pa.int64()), "pairs": [squeeze(pairs)], "counts": [squeeze(counts, LONG)], "best": [squeeze(best)]})

    dealt = runs.select("radix", F.pmod(F.col("seq"), F.lit(merges)).alias("seq"), "pairs", "counts")
    return dealt.groupBy("radix", "seq").applyInArrow(one, schema)


def count_pairs(runs: DataFrame, blocks: int, tables: common.Tables, fan_in: int) -> DataFrame:
    """radix, pairs, counts, best: one row a radix, from the runs of so many blocks."""
    out, left = runs.select("radix", F.xxhash64("block").alias("seq"), "pairs", "counts"), blocks
    while True:
        left = -(-left // fan_in)
        out = tables.write(_merge(out, left), "merged")
        if left <= 1:
            return out.select("radix", "pairs", "counts", "best")


def shares(runs: DataFrame, counted: DataFrame, salts: int) -> DataFrame:
    """block, docs, sums, bests: what a run's documents get from its pairs. A radix's runs are dealt by `salts`, to each of which its counted pairs go."""
    schema = "block long, docs binary, sums binary, bests binary"

    def one(counted: pa.Table, runs: pa.Table) -> pa.Table:
        out = {"block": [], "docs": [], "sums": [], "bests": []}
        if counted.num_rows and runs.num_rows:
            every, count, best = spread(counted["pairs"][0].as_py()), spread(counted["counts"][0].as_py(), LONG), spread(counted["best"][0].as_py())
            for block, *run in zip(*[runs[c].to_pylist() for c in ("block", "pairs", "counts", "docs", "times")], strict=True):
                pairs, n, doc, times = spread(run[0]), spread(run[1], LONG), spread(run[2]), spread(run[3])
                at = np.repeat(np.searchsorted(every, pairs), n)
                docs, of = np.unique(doc, return_inverse=True)
                sums, bests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(sums, of, times * count[at])
                np.add.at(bests, of, times * best[at])
                for c, v in zip(out, (block, squeeze(docs), squeeze(sums, LONG), squeeze(bests, LONG)), strict=True):
                    out[c].append(v)
        return pa.table({"block": pa.array(out["block"], pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in ("docs", "sums", "bests")}})

    left = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = runs.select("block", F.col("radix").alias("radix"), "pairs", "counts", "docs", "times").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    return left.groupBy("radix", "salt").cogroup(right.groupBy("radix", "salt")).applyInArrow(one, schema)


def _summed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The documents' rows with n_best and count_sum, added up by block."""
    schema = ", ".join(["doc_id long", *[f"{n} long" for n in NUMBERS], "n_best long", "count_sum long", "groups_sha256 string"])

    def one(rows: pa.Table, parts: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        best, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        for docs, sums, bests in zip(*[parts[c].to_pylist() for c in ("docs", "sums", "bests")], strict=True):
            at = spread(docs)
            total[at] += spread(sums, LONG)
            best[at] += spread(bests, LONG)
        out = {c: rows[c] for c in ("doc_id", *NUMBERS)}
        return pa.table({**out, "n_best": best, "count_sum": total, "groups_sha256": rows["groups_sha256"]})

    return rows.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(one, schema)


def align(docs: DataFrame, block_links: int = 4_000_000, fan_in: int = 64, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of docs (doc_id, text).

    n_best: links whose pair is in as many documents as any pair of its id of A; count_sum: the sum over links of their pair's number of documents. Paths:
    a tiktoken rank file and a sentencepiece model. The result lies in the shared folder; the tables on the way are dropped.
    """
    spark = docs.sparkSession
    common.ship(spark)
    tables = common.Tables(spark)
    aligned = tables.write(_aligned(docs, block_links, a_path, b_path), "aligned", codec="none")
    rows = aligned.filter("radix IS NULL").select("block", "pos", "doc_id", *NUMBERS, "groups_sha256")
    runs = aligned.filter("radix IS NOT NULL")
    blocks = runs.agg(F.countDistinct("block")).first()[0]
    counted = count_pairs(runs, blocks, tables, fan_in)
    parts = tables.write(shares(runs, counted, max(1, -(-blocks // fan_in))), "shares", codec="none")
    out = tables.write(_summed(rows, parts), "alignment", keep=True)
    tables.drop()
    return out
