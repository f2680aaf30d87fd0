"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every pre-token starts as a linked list of single bytes.  Each adjacent pair that
the vocabulary knows is queued under its merge rank: a bucket per rank holds list
positions, and a bitmap of non-empty ranks, with a summary bitmap over its words,
finds the least rank by two find-first-set steps.  Entries made stale by a
neighbouring merge are skipped when popped.  A pre-token of n bytes therefore
costs O(n log n) at worst, however long it is.

Defined results: a null text encodes like an empty one (no ids, empty bytes); ids
of any text decode to its UTF-8 bytes; repeated rows each give their own row;
columns other than the id and the text are ignored, so names cannot clash.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import BatchCache, claim, id_text, int_lists, slices

_WORD_BITS = 8  # 256 ranks to a bitmap word
_LOW = (1 << _WORD_BITS) - 1
CACHE_BYTES = 128 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Merges pre-tokens; its queue is empty between calls and so is used again.

    ``buckets`` maps a rank to its one waiting position, or to a heap of several, so
    the leftmost leaves first.  ``words`` is the bitmap of ranks with a bucket and
    the summary the bitmap of words in use.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.two = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self.buckets: dict[int, int | list[int]] = {}
        self.words = [0] * ((max(ranks.values()) >> _WORD_BITS) + 1)
        self.masks = [1 << i for i in range(max(1 << _WORD_BITS, len(self.words)))]

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always merge the leftmost pair of least rank."""
        ranks, two, buckets, words, masks = self.ranks, self.two, self.buckets, self.words, self.masks
        find = ranks.get
        whole = find(piece)
        if whole is not None:
            return [whole]
        n, summary = len(piece), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [two[a << 8 | b] for a, b in pairwise(piece)]
        current.append(None)
        for i, rank in enumerate(current):
            if rank is not None:
                if rank in buckets:
                    _add(buckets, rank, i)
                else:
                    buckets[rank] = i
                    w = rank >> _WORD_BITS
                    if not words[w]:
                        summary |= masks[w]
                    words[w] |= masks[rank & _LOW]
        while summary:
            # find-first-set over the summary, then over its word
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = w << _WORD_BITS | (bits & -bits).bit_length() - 1
            i = buckets[rank]
            if i.__class__ is list:
                bucket, i = i, heappop(i)
                if not bucket:
                    bucket = None
            else:
                bucket = None
            if bucket is None:
                del buckets[rank]
                words[w] = bits & (bits - 1)
                if not words[w]:
                    summary &= summary - 1
            if current[i] != rank:
                continue  # stale: a neighbour was merged since
            j = after[i]
            k = after[i] = after[j]
            current[j] = None
            p = before[i]
            if p >= 0:
                current[p] = rank = find(piece[p:k])
                if rank is not None:
                    if rank in buckets:
                        _add(buckets, rank, p)
                    else:
                        buckets[rank] = p
                        w = rank >> _WORD_BITS
                        if not words[w]:
                            summary |= masks[w]
                        words[w] |= masks[rank & _LOW]
            if k < n:
                before[k] = i
                current[i] = rank = find(piece[i : after[k]])
                if rank is not None:
                    if rank in buckets:
                        _add(buckets, rank, i)
                    else:
                        buckets[rank] = i
                        w = rank >> _WORD_BITS
                        if not words[w]:
                            summary |= masks[w]
                        words[w] |= masks[rank & _LOW]
            else:
                current[i] = None
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(ranks[piece[i:k]])
            i = k
        return out


def _add(buckets: dict, rank: int, position: int) -> None:
    """A further position for a rank that has one."""
    bucket = buckets[rank]
    if bucket.__class__ is not list:
        bucket = buckets[rank] = [bucket]
    heappush(bucket, position)


class ByteBpe:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.token_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.merge = Merger(self.ranks).ids
        self.memo = BatchCache(self._packed, CACHE_BYTES)

    def _packed(self, pieces: list[str]) -> list[bytes]:
        merge = self.merge
        return [array("i", merge(p.encode())).tobytes() for p in pieces]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        pieces = self.split(text)
        return np.frombuffer(b"".join(map(self.memo.get(pieces).__getitem__, pieces)), "<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec per Python worker."""
    return ByteBpe(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """``doc_id, ids array<int>`` for every row; with ``check`` also ``decoded``, what the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        bpe = codec(path, pattern)
        for batch in batches:
            for small in slices(batch):
                parts = [bpe.encode(t) for t in small.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, parts)])
                columns = [small.column(0), int_lists(np.concatenate(parts), offsets)]
                if check:
                    columns.append(pa.array([bpe.decode(ids.tolist()) for ids in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * check)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded binary`` from ``doc_id, ids``; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        bpe = codec(path, pattern)
        for batch in batches:
            for small in slices(batch):
                column = small.column(1).fill_null([])
                flat, ends = column.flatten().to_numpy().tolist(), np.cumsum([0, *column.value_lengths().to_pylist()]).tolist()
                decoded = [bpe.decode(flat[a:b]) for a, b in pairwise(ends)]
                yield pa.RecordBatch.from_arrays([*small.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
