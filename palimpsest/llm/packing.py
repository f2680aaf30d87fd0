"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

Each document's token ids are cut into full sequences and one remainder.  Rows go
to randomised groups of bounded expected size; within a group, the remainders are
placed, longest first, into the first bin with room.  The tree keeps, at every
inner node, the largest free capacity below it, so a first fit is one descent.

Defined results: a null text is empty and holds the end id alone; repeated rows,
null ids included, are packed like any other row; an empty table gives none.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BatchCache, claim, id_text, slices, split_words, text_bytes

SEQUENCE = 2048
DOCUMENTS_PER_GROUP = 4096
CACHE_BYTES = 128 << 20


class WordTokenizer:
    """Ids of a tokenizer that drops white space, memoised by word.

    Such a tokenizer never joins what white space separates, so a text's ids are
    its words' ids in order.  Unknown words are tokenized together, parted by a
    character that is always one token of its own.
    """

    #: A digit: the tokenizer takes every digit by itself, so it parts any two words.
    SEPARATOR = "²"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(self.SEPARATOR)
        self.memo = BatchCache(self._packed, CACHE_BYTES)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _packed(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        ids = np.array(self._ids(self.SEPARATOR.join(texts)), "<u4")
        cuts = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) != 1 or len(cuts) != len(words) - 1:  # a word holds the separator itself
            return [array("I", self._ids(t)).tobytes() for t in texts]
        data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]

    def encode(self, text: bytes | None) -> bytes:
        words = split_words(text)
        return b"".join(map(self.memo.get(words).__getitem__, words))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(df: DataFrame, path: str, end_id: int = 1, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, shuffle_key``: pieces of at most ``sequence`` ids.

    ``ids`` holds little-endian unsigned 32-bit ids; ``shuffle_key`` is one random
    but repeatable number per input row, whatever its id.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("packing")
        tokenizer, rng = word_tokenizer(path), np.random.default_rng(TaskContext.get().partitionId())
        for part in (p for batch in batches for p in slices(batch)):
            rows: list[tuple] = []
            for doc, text, key in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), rng.integers(0, 1 << 62, part.num_rows).tolist(), strict=True):
                data = tokenizer.encode(text) + end
                total = len(data) // 4
                rows += [(doc, s, min(sequence, total - s), total, data[4 * s : 4 * (s + sequence)], key) for s in range(0, total, sequence)]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids", "shuffle_key"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, shuffle_key long")


class TournamentTree:
    """Free capacity of ``n`` bins; finds the first bin that has room."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; the bin and its capacity left before."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        room = free[node]
        free[node] = room - size
        place = node - self.leaves
        while node > 1:
            node >>= 1
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left >= right else right
        return place, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items no longer than the capacity, order of ties kept."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = TournamentTree(len(lengths), capacity)
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[i], room = tree.place(size)
        offsets[i] = capacity - room
    return bins, offsets


def pack(pieces: DataFrame, documents: int, sequence: int = SEQUENCE, per_group: int = DOCUMENTS_PER_GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; every other column is carried along.

    ``documents`` is the number of documents the pieces come from; it sets the
    number of groups, so a group's size does not grow with the table.
    """
    groups = max(1, -(-documents // per_group))
    keyed = pieces.withColumn("pack_group", F.pmod(F.col("shuffle_key"), F.lit(groups)))
    names = [f for f in keyed.schema.fields if f.name not in ("shuffle_key", "pack_group")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in names] + ["sequence_id long", "offset long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["pack_group"].iloc[0])
        pdf = pdf.sort_values(["shuffle_key", "start"], kind="stable", ignore_index=True)
        full = pdf["length"].to_numpy() >= sequence
        bins, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        if (~full).any():
            bins[~full], offsets[~full] = first_fit_decreasing(pdf["length"].to_numpy()[~full], sequence)
        used = int(bins[~full].max()) + 1 if (~full).any() else 0
        bins[full] = used + np.arange(int(full.sum()))
        out = pdf.drop(columns=["shuffle_key", "pack_group"])
        out["sequence_id"], out["offset"] = (group << 32) + bins, offsets
        return out

    return keyed.groupBy("pack_group").applyInPandas(run, schema)
