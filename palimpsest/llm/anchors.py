"""Exact repeats of long windows, found through content-chosen anchors.

Shared by the substring operators.  A document is a sequence of symbols (bytes or
word hashes); a window is ``length`` consecutive symbols.  In every window the gram
of ``gram`` symbols with the least hash is its anchor, so equal windows have equal
anchors at equal offsets, wherever they stand.  Around an anchor lies a segment:
all symbols of all windows that hold it.

1. One shuffle by (gram, segment) brings equal segments together: a class, whose
   first place stands for it.  Within a slice of documents, equal segments are
   merged first, so a passage that a third of all documents share arrives as a few
   rows, and a common gram with unequal neighbours is dealt over all tasks.
2. Segments of a class repeat as a whole: the later ones from the first.  Classes of
   one gram are counted with partial sums; where there are several, the first
   segments of each are open.
3. Open segments are compared by the operator's own method, in blocks of bounded
   size.  Anchors with more classes than a block holds take another exact way:
   their windows' hashes are counted and joined, which no key can skew.

Defined results: a null text has no symbols and an empty table no spans; a text of
any length is read whole; equal windows of one document count as well as those of
two; among places that tie, the one of the lesser key, then of the lesser start, is
the first; keys must be unique, so rows that repeat are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import claim, slices, stored, text_bytes
from palimpsest.llm.jaccard import mix

#: Open segments of a block, and classes of one anchor that go to one.
BLOCK_SEGMENTS, MOST_SEGMENTS = 16_384, 16_384
#: Grams ranked at once: positions take the low bits of what is ranked.
RANKED = 1 << 26
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POSITION = np.uint64((1 << 28) - 1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(12, n.bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base & _MASK, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.multiply.accumulate(factors))
        return cls.up, cls.down


class RangeHash:
    """Hashes of any range of a symbol sequence, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        up, self.down = _Powers.get(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64), 5) * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64), salt)

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: self.n - size + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


@dataclass(frozen=True)
class Windows:
    """Window and gram length; ``symbols`` turns UTF-8 text into a symbol array.

    ``earlier``: a window counts as repeated if it also starts earlier (less key, or
    same key and less start); otherwise if it also starts anywhere else.
    """

    length: int
    gram: int
    symbols: Callable[[bytes | None], np.ndarray]
    earlier: bool

    def anchors(self, hashes: RangeHash) -> tuple[np.ndarray, np.ndarray]:
        """Positions and gram hashes of all anchors, ascending."""
        if hashes.n < self.length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams, width = hashes.grams(self.gram), self.length - self.gram + 1
        parts = []
        for begin in range(0, len(grams) - width + 1, RANKED):  # the windows of each part reach into the next
            some = grams[begin : begin + RANKED + width - 1]
            marked = (some & ~_POSITION) | np.arange(len(some), dtype=np.uint64)
            parts.append(begin + (sliding_min(marked, width) & _POSITION).astype(np.int64))
        least = np.concatenate(parts)
        at = least[np.concatenate([[True], least[1:] != least[:-1]])]
        return at, grams[at]

    def segment(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(0, at - (self.length - self.gram)), np.minimum(n, at + self.length)


def _anchor_rows(docs: DataFrame, how: Windows) -> DataFrame:
    """``fp, seg, key, at, copies, hi, src``: an anchor for each class of a slice of documents,
    with its number of ``copies`` there; the other copies (``copies`` 0) as whole spans
    ``at .. hi``, whose source starts at ``src`` of document ``seg``, under a name of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for batch in batches:
            for part in slices(batch, 1000):
                rows = []
                for text, key in zip(text_bytes(part.column(1)), part.column(0).to_pylist(), strict=True):
                    hashes = RangeHash(how.symbols(text))
                    at, fp = how.anchors(hashes)
                    lo, hi = how.segment(at, hashes.n)
                    rows.append((fp, hashes.of(lo, hi, 9) + (at - lo).astype(np.uint64), np.full(len(at), key, np.int64), at, lo, hi))
                fp, seg, key, at, lo, hi = (np.concatenate(x) for x in zip(*rows, strict=True))
                order = np.lexsort((at, key, seg, fp))
                again = np.zeros(len(fp), bool)
                again[1:] = (np.diff(fp[order]) == 0) & (np.diff(seg[order]) == 0)
                once = order[~again]
                copies = np.diff(np.append(np.flatnonzero(~again), len(order)))
                lead = np.empty(len(fp), np.int64)
                lead[order] = np.repeat(once, copies)
                rest = np.sort(order[again])  # by document and place; from one source, spans join
                key2, lo2, hi2, src_key, src = key[rest], lo[rest], hi[rest], key[lead[rest]], lo[lead[rest]]
                if not how.earlier:
                    src_key, src = np.zeros_like(key2), lo2  # any other place will do
                starts = np.empty(0, np.int64)
                if len(rest):
                    part_at = (np.diff(key2) != 0) | (lo2[1:] > hi2[:-1]) | (np.diff(src_key) != 0) | (np.diff(src - lo2) != 0)
                    starts = np.flatnonzero(np.concatenate([[True], part_at]))
                ends = np.append(starts[1:], len(rest))[: len(starts)] - 1
                names = mix(mix(key2[starts].view(np.uint64), 8) + lo2[starts].astype(np.uint64), 8)
                none = np.zeros(len(once), np.int32)
                columns = (
                    np.concatenate([fp[once], names]).view(np.int64),
                    np.concatenate([seg[once].view(np.int64), src_key[starts]]),
                    np.concatenate([key[once], key2[starts]]),
                    np.concatenate([at[once], lo2[starts]]).astype(np.int32),
                    np.concatenate([copies, np.zeros(len(starts), np.int64)]).astype(np.int32),
                    np.concatenate([none, hi2[ends]]).astype(np.int32),
                    np.concatenate([none, src[starts]]).astype(np.int32),
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["fp", "seg", "key", "at", "copies", "hi", "src"])

    return docs.select("key", "text").mapInArrow(run, "fp long, seg long, key long, at int, copies int, hi int, src int")


def met_classes(docs: DataFrame, how: Windows) -> DataFrame:
    """``fp, key, at, n, lo, hi, src_key, src_lo``: every anchor and known span, written down.

    ``n`` counts a class at its first place and is null elsewhere; ``src_key`` is null
    at first places.  ``hi`` may lie beyond the text's end; whoever uses it stops there.
    """
    same, place = W.partitionBy("fp", "seg"), F.struct("key", "at")
    seen = _anchor_rows(docs, how).withColumn("first", F.min(place).over(same)).withColumn("n", F.sum("copies").over(same))
    whole, left = F.col("copies") == 0, how.length - how.gram
    lead = ~whole & (F.col("first") == place)
    lo = F.when(whole, F.col("at")).otherwise(F.greatest(F.lit(0), F.col("at") - left))
    return stored(
        seen.select(
            "fp", "key", "at", F.when(lead, F.col("n")).alias("n"), lo.alias("lo"),
            F.when(whole, F.col("hi")).otherwise(F.col("at") + how.length).alias("hi"),
            F.when(whole, F.col("seg")).when(~lead, F.col("first.key")).alias("src_key"),
            F.when(whole, F.col("src")).when(~lead, F.col("first.at") - F.col("at") + lo).alias("src_lo"),
        )
    )


def open_classes(met: DataFrame, most: int) -> DataFrame:
    """``fp, key, at, n, crowded``: the first places of classes whose gram has several, written down."""
    classes = met.filter("n is not null").select("fp", "key", "at", "n")
    several = classes.groupBy("fp").agg(F.count("*").alias("classes")).filter("classes > 1")
    return stored(classes.join(several, "fp").select("fp", "key", "at", "n", (F.col("classes") > most).alias("crowded")))


def marked_texts(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """``key, text, marks`` of the documents with open places, and what else they carry.

    These are the columns and the filter that ``with_spans`` has too, so the texts are shuffled once for both.
    """
    marks = opened.groupBy("key").agg(F.collect_list(F.struct("at", "fp", "n", "crowded")).alias("marks"))
    return docs.join(marks, "key").select("key", "text", "marks", *[c for c in docs.columns if c not in ("key", "text")])


def repeated_spans(docs: DataFrame, how: Windows, compare: Callable[[pd.DataFrame], pd.DataFrame], most: int = MOST_SEGMENTS) -> DataFrame:
    """``key, lo, hi, src_key, src_lo``: spans that together cover every repeated window, and nothing else.

    ``docs``: key, text, and columns to be carried along.  ``compare`` gets a block of
    open segments (fp, key, lo, at, n, symbols) and returns the spans it finds in them.
    The source is an earlier place with the same symbols; null or meaningless unless
    ``how.earlier``.
    """
    met = met_classes(docs, how)
    known = F.col("src_key").isNotNull() if how.earlier else F.col("src_key").isNotNull() | (F.col("n") > 1)
    columns = ["key", "lo", "hi", "src_key", "src_lo"]
    out = met.filter(known).select(*columns)
    opened = open_classes(met, most)
    counts = opened.agg(F.count_if(~F.col("crowded")), F.count_if("crowded")).first()
    if counts[0] or counts[1]:
        wanted = marked_texts(docs, opened)
        if counts[0]:
            out = out.unionByName(in_blocks(wanted, how, counts[0]).applyInPandas(compare, SPANS))
        if counts[1]:
            out = out.unionByName(_crowded(wanted, how).select(*columns))
    return out


SPANS = "key long, lo int, hi int, src_key long, src_lo int"


def in_blocks(wanted: DataFrame, how: Windows, segments: int):
    """Open segments that are not crowded, grouped into blocks by their grams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                rows = []
                for key, text, marks in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    symbols = how.symbols(text)
                    for m in marks:
                        if not m["crowded"]:
                            lo, hi = how.segment(np.array(m["at"]), len(symbols))
                            rows.append((m["fp"], key, int(lo), m["at"], m["n"], symbols[lo:hi].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["fp", "key", "lo", "at", "n", "symbols"])

    blocks = max(1, -(-segments // BLOCK_SEGMENTS))
    cuts = wanted.mapInArrow(cut, "fp long, key long, lo int, at int, n long, symbols binary")
    return cuts.groupBy(F.pmod(F.xxhash64("fp"), F.lit(blocks)).alias("block"))


def _crowded_windows(wanted: DataFrame, how: Windows) -> DataFrame:
    """``window, key, start``: the windows of crowded anchors, named by their hashes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, marks in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                at = np.array([m["at"] for m in marks if m["crowded"]], np.int64)
                if not len(at):
                    continue
                hashes = RangeHash(how.symbols(text))
                lo, hi = how.segment(at, hashes.n)
                start = np.unique(np.concatenate([np.arange(a, b - how.length + 1) for a, b in zip(lo, hi, strict=True)]))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.of(start, start + how.length, 3).view(np.int64)), pa.array(np.full(len(start), key, np.int64)), pa.array(start.astype(np.int32))], ["window", "key", "start"])

    return wanted.mapInArrow(windows, "window long, key long, start int")


def window_groups(wanted: DataFrame, how: Windows) -> DataFrame:
    """``window, first, copies``: the repeated windows of crowded anchors, counted with partial sums."""
    return _crowded_windows(wanted, how).groupBy("window").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")


def _crowded(wanted: DataFrame, how: Windows) -> DataFrame:
    """The spans of crowded anchors: an equi-join of windows with the repeated ones."""
    met = _crowded_windows(wanted, how).join(window_groups(wanted, how), "window")
    if how.earlier:
        met = met.filter(F.struct("key", "start") != F.col("first"))
    return met.select("key", F.col("start").alias("lo"), (F.col("start") + how.length).cast("int").alias("hi"), F.col("first.key").alias("src_key"), F.col("first.start").alias("src_lo"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def with_spans(docs: DataFrame, spans: DataFrame, key: str = "key", name: str = "spans", columns: tuple[str, ...] = ("lo", "hi")) -> DataFrame:
    """All columns of the documents plus the spans; null where there are none."""
    # what a document collects is bounded by its own length
    marked = spans.groupBy("key").agg(F.collect_set(F.struct(*columns)).alias(name)).withColumnRenamed("key", key)
    return docs.join(marked, key, "left")
