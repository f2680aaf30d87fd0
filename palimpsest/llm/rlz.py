"""Substring dedup by relative Lempel-Ziv parsing over words.

Open segments (see ``anchors``) go to reference blocks by their grams.  A block is one
string: the parts of all its documents, in document order, each ended by a mark of
its own, indexed by a suffix array with its common prefixes.  From the array, every
position's longest earlier match is taken over all earlier places (the nearest
earlier suffix above and below it in the array).  Each part is factored greedily
against the whole block; after a factor, parsing resumes at the first window that
crosses its boundary, so a window that another place continues is not missed.

A document meets every block that holds one of its grams, and the first segment of
every class it repeats.  The matches it gets there, with their sources, are put
together along their diagonals and the whole document is parsed once more, greedily
and with the same check at factor boundaries: its factors of a window or more are its
duplicate spans.

Defined results: a null text has no words; a text shorter than the window keeps
all; of rows that repeat an id, the one with the lesser text is the earlier; of equal
matches the earliest source is named first; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.anchors import MOST_SEGMENTS, Windows, merged, repeated_spans, with_spans
from palimpsest.llm.common import id_text, row_keys, slices, split_words, text_bytes
from palimpsest.llm.jaccard import _memo

LENGTH, GRAM = 20, 8
Match = tuple[int, int, int, int]


def word_symbols(text: bytes | None) -> np.ndarray:
    words = split_words(text)
    return np.frombuffer(b"".join(map(_memo().get(words).__getitem__, words)), "<u8")


class ReferenceBlock:
    """Parts of documents, in order, as one string with a suffix array by prefix doubling."""

    def __init__(self, parts: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in parts])
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        total = int((self.sizes + 1).sum())
        names, numbers = np.unique(np.concatenate(parts), return_inverse=True)
        rank = np.empty(total, np.int64)
        inside = np.ones(total, bool)
        inside[self.starts + self.sizes] = False
        rank[inside] = numbers
        rank[~inside] = len(names) + np.arange(len(parts))  # no two ends are equal, so no match runs over one
        self.ranks, step = [rank], 1
        while int(self.ranks[-1].max()) < total - 1:
            last = self.ranks[-1]
            ahead = np.full(total, -1, np.int64)
            ahead[:-step] = last[step:]
            self.ranks.append(np.unique(last * (total + 1) + ahead + 1, return_inverse=True)[1])
            step *= 2
        self.order = np.empty(total, np.int64)
        self.order[self.ranks[-1]] = np.arange(total)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of different suffixes, by the ranks of their doubling steps."""
        a, b = a.copy(), b.copy()
        size = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            same = (self.ranks[level][a] == self.ranks[level][b]) << level
            a, b, size = a + same, b + same, size + same
        return size

    def earlier(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose longest earlier match is ``least`` or more, its length and its place."""
        order = self.order
        near = self.common(order[:-1], order[1:]) >= least  # only neighbours this close lie in one interval
        some = np.flatnonzero(np.concatenate([[False], near]) | np.concatenate([near, [False]]))
        place = order[some].tolist()
        opens = np.concatenate([[True], ~near])[some].tolist()
        above, below = [-1] * len(place), [-1] * len(place)
        stack: list[int] = []
        for i, (p, new) in enumerate(zip(place, opens, strict=True)):
            if new:
                stack.clear()
            while stack and place[stack[-1]] > p:
                below[stack.pop()] = p
            if stack:
                above[i] = place[stack[-1]]
            stack.append(i)
        at = np.array(place, np.int64)
        size, source = np.zeros(len(at), np.int64), np.full(len(at), -1)
        for other in (np.array(above, np.int64), np.array(below, np.int64)):
            rows = np.flatnonzero(other >= 0)
            found = self.common(at[rows], other[rows])
            better = (found > size[rows]) | ((found == size[rows]) & (other[rows] < source[rows]))
            size[rows[better]], source[rows[better]] = found[better], other[rows[better]]
        use = np.flatnonzero(size >= least)
        use = use[np.argsort(at[use])]
        return at[use], size[use], source[use]

    def factors(self, least: int) -> list[list[Match]]:
        """Greedy factors of every part: start and end in it, source part and start there."""
        at, size, source = self.earlier(least)
        out: list[list[Match]] = [[] for _ in self.sizes]
        owner, of = np.searchsorted(self.starts, at, "right") - 1, np.searchsorted(self.starts, source, "right") - 1
        columns = (owner, at - self.starts[owner], size, of, source - self.starts[of])
        part, resume = -1, 0
        for p, i, n, q, j in zip(*(c.tolist() for c in columns), strict=True):
            if p != part:
                part, resume = p, 0
            if i >= resume:
                out[p].append((i, i + n, q, j))
                resume = i + n - least + 1  # the first window across the factor's end
        return out


def document_parts(pdf: pd.DataFrame) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Key and start, and symbols, of the stretches that a block's segments make of each document."""
    pdf = pdf.sort_values(["key", "lo", "at"], kind="stable")
    places, parts = [], []
    for key, lo, data in zip(pdf["key"].tolist(), pdf["lo"].tolist(), pdf["symbols"].tolist(), strict=True):
        symbols = np.frombuffer(data, "<u8")
        if places and places[-1][0] == key and lo <= (end := places[-1][1] + sum(map(len, parts[-1]))):
            parts[-1].append(symbols[end - lo :])
        else:
            places.append((key, lo))
            parts.append([symbols])
    return places, [np.concatenate(p) for p in parts]


def compare_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    places, parts = document_parts(pdf)
    rows = []
    for (key, lo), factors in zip(places, ReferenceBlock(parts).factors(LENGTH), strict=True):
        rows += [(key, lo + a, lo + b, places[q][0], places[q][1] + j) for a, b, q, j in factors]
    return pd.DataFrame(rows, columns=["key", "lo", "hi", "src_key", "src_lo"]).astype({"key": "int64", "lo": "int32", "hi": "int32", "src_key": "int64", "src_lo": "int32"})


WINDOWS = Windows(LENGTH, GRAM, word_symbols, earlier=True)


def parsed(matches: list[Match], n: int, least: int = LENGTH) -> list[Match]:
    """A document of ``n`` words, greedily factored by matches (start, end, source, start there).

    Matches that continue one another from the same source are one.  A factor takes
    the match that reaches farthest; words that no factor holds stay.
    """
    lines: list[list[int]] = []
    for lo, hi, key, src in sorted(matches, key=lambda m: (m[2], m[3] - m[0], m[0])):
        hi = min(hi, n)
        if lines and (lines[-1][2], lines[-1][3] - lines[-1][0]) == (key, src - lo) and lo <= lines[-1][1]:
            lines[-1][1] = max(lines[-1][1], hi)
        else:
            lines.append([lo, hi, key, src])
    lines.sort(key=lambda m: (m[0], m[2], m[3]))
    out: list[Match] = []
    i, at, best = 0, 0, None
    while True:
        while at < len(lines) and lines[at][0] <= i:
            if best is None or lines[at][1] > best[1]:
                best = lines[at]
            at += 1
        if best is not None and best[1] - i >= least:
            out.append((i, best[1], best[2], best[3] + i - best[0]))
            i = best[1] - least + 1
        elif at < len(lines):
            i = lines[at][0]
        else:
            return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SEGMENTS) -> DataFrame:
    """``doc_id, n_words, factors, spans, kept``: the parse (start, end, source's key and start),
    the words it removes as maximal runs, and the kept words joined by a space."""
    docs = row_keys(id_text(df, id_col, text_col), "key")
    spans = repeated_spans(docs, WINDOWS, compare_segments, most)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("src_key", pa.int64()), ("src_lo", pa.int32())]))
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for part in (p for batch in batches for p in slices(batch)):
            sizes, parses, cuts, kept = [], [], [], []
            for text, marks in zip(text_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                words = split_words(text)
                factors = parsed([(m["lo"], m["hi"], m["src_key"], m["src_lo"]) for m in marks or ()], len(words))
                runs = merged([(a, b) for a, b, *_ in factors])
                edges = [0, *(x for run in runs for x in run), len(words)]
                sizes.append(len(words))
                parses.append([dict(zip(("lo", "hi", "src_key", "src_lo"), f, strict=True)) for f in factors])
                cuts.append([{"lo": a, "hi": b} for a, b in runs])
                kept.append(b" ".join([w for a, b in list(pairwise(edges))[::2] for w in words[a:b]]).decode())
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(parses, factor), pa.array(cuts, span), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "factors", "spans", "kept"])

    placed = with_spans(docs, spans, columns=("lo", "hi", "src_key", "src_lo")).select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, factors array<struct<lo: int, hi: int, src_key: bigint, src_lo: int>>, spans array<struct<lo: int, hi: int>>, kept string"
    return placed.mapInArrow(apply, schema)
