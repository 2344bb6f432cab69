"""Operator 5, packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

A document is its tokens and an end token. Full sequences are cut from its front; what remains (fewer than `capacity`
tokens) is packed with others. Remainders are dealt at random, by a seeded hash, into groups of about `group_tokens`
tokens. A group is packed by itself in one task, so that groups need nothing from each other, and no task gets
more than its group. A group wastes part of its last bins only, a few parts in a thousand of its tokens.

First fit: the leftmost bin with room for a piece is found by a walk down a tournament tree whose inner nodes hold the
largest free capacity below them, in log2(bins) steps.

Tokens come from byte-level BPE with the ranks of byte_bpe_50k (the tiktoken file of that vocabulary, whose ids equal those
of the JSON file for `tokenizers`, and which is three times as fast). A special token's string in a text gets that token's
id, as `tokenizers` gives it with add_special_tokens=False; with special_as_text it is ordinary text, which is safer for
texts that nobody vouches for.

No padding is stored: a sequence ends with its last piece, and whoever pads it goes up to `capacity`, but leaves one whose
fill is a power of two. Pieces of equal length go in the order of their numbers; which group a piece is dealt to depends on
its number alone, so that groups have no ties.

Defined cases: a null or empty text is its end token alone. Repeated rows, also with the same doc_id, are packed as
documents of their own. A null doc_id is kept. Texts of any length are cut as often as need be, runs of white space of any length included. An empty table gives
an empty result. Other columns aren't read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The special token of the vocabulary, and the characters that count as white space.
SPECIAL = ("<|endoftext|>", 50256)
SPACES = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LONG_RUN = re.compile(f"[{SPACES}]{{10000,}}")
CAPACITY, END_ID, GROUP_TOKENS = 2048, 1, 4 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_encoders: dict = {}


def encoder(path: str | None = None):
    """The byte-level BPE encoder, once a Python worker. path: a tiktoken rank file; the public 50k vocabulary if None."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def plain_ids(text: str, bpe) -> list[int]:
    """Ids of text by the encoder bpe, special tokens' strings being ordinary text.

    The encoder's pattern gives up on runs of white space of some 900,000 characters. In front of another character such a run
    is one word but for its last character, which may belong to the next word; at the end it is one word. So long runs
    are encoded as the words that they are, and what lies between goes through the pattern.
    """
    ids, at = [], 0
    for run in LONG_RUN.finditer(text):
        ids += bpe.encode_ordinary(text[at : run.start()])
        at = run.end() - (run.end() < len(text))
        ids += bpe._encode_single_piece(text[run.start() : at])
    return ids + bpe.encode_ordinary(text[at:])


def token_ids(text: str, path: str | None = None, special_as_text: bool = False) -> np.ndarray:
    """The document's ids as unsigned 32-bit integers, with the end token."""
    bpe, ids = encoder(path), []
    for k, part in enumerate([text] if special_as_text else text.split(SPECIAL[0])):
        ids += [SPECIAL[1]] * (k > 0) + plain_ids(part, bpe)
    return np.array([*ids, END_ID], dtype="<u4")


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32 of the ids) of a document's pieces."""
    for start in range(0, len(ids), capacity):
        part = ids[start : start + capacity]
        yield start, len(part), zlib.crc32(part.tobytes())


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """PIECES of docs (doc_id, text)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = token_ids(text.as_py(), path, special_as_text)
                rows += [(doc_id, start, length, crc, len(ids)) for start, length, crc in cut(ids, capacity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.plain_text().alias("text")).mapInArrow(tasks, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, none above capacity; equal lengths go in their given order."""
    n = len(lengths)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)  # node i has children 2i and 2i + 1; leaves are the bins
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size, i = int(lengths[k]), 1
        while i < width:
            i *= 2
            if tree[i] < size:
                i += 1
        bins[k], offsets[k] = i - width, capacity - tree[i]
        tree[i] -= size
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, seed: int = 17, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """PIECES with sequence_id and offset for docs (doc_id, text).

    The pieces are written once with a number of their own, by which they are dealt: repeated ids fall into different
    groups, and a group that is packed again gets the same pieces in the same order.
    """
    common.ship(docs.sparkSession)
    cut_up = common.materialize(pieces(docs, capacity, path, special_as_text).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    loose = cut_up.filter(F.col("length") < capacity)
    tokens = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // group_tokens))
    full = cut_up.filter(F.col("length") == capacity).select("*", (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # even numbers are free for packed sequences: those of a group follow each other with a stride of the number of groups

    def one_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.drop(columns=["group"]).assign(sequence_id=2 * (bins * groups + key[0]), offset=offsets)

    schema = f"{PIECES}, piece long, sequence_id long, offset long"
    dealt = loose.withColumn("group", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(one_group, schema)
    return packed.unionByName(full).drop("piece")
