"""Suffix-array dedup: maximal repeats from a common-prefix interval tree.

Texts are UTF-8 bytes.  Open segments (see ``anchors``) are the occurrences of one
gram with what surrounds it; equal ones come as one, with their number of copies.
The suffixes that start at the gram are sorted into an enhanced suffix array with the
common prefixes of neighbours; a stack scan lists its common-prefix intervals, the
nodes of the interval tree.  An interval of depth d holds every occurrence of a
d-byte string.  Within it, occurrences are grouped by what stands to their left:
where the left extensions differ, each class that shares ``length - d`` bytes or more
there is a repeat group with all its occurrences, not only neighbours; a group that
a deeper interval holds as well is named there.  A leaf with several copies is a
group of its own.  ``repeat_groups`` lists the groups; ``dedup`` covers each occurrence
by the groups it belongs to.

Defined results: a null text has no bytes; a text shorter than the window keeps
all; rows that repeat an id are documents of their own; all places of a tie count
alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.anchors import MOST_SEGMENTS, Windows, in_blocks, marked_texts, merged, met_classes, open_classes, repeated_spans, window_groups, with_spans
from palimpsest.llm.common import id_text, map_rows, row_keys, slices, text_bytes, with_text

LENGTH, GRAM = 200, 100


def byte_symbols(text: bytes | None) -> np.ndarray:
    return np.frombuffer(text or b"", np.uint8)


def common_prefix(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of two byte matrices."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(a_len, b_len))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Depth, first and last place of every common-prefix interval of depth over 0.

    ``lcp[i]`` is the common prefix of places i - 1 and i; children come before parents.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth, start = lcp[i] if i < len(lcp) else 0, i - 1
        while stack and stack[-1][0] > depth:
            d, start = stack.pop()
            yield d, start, i - 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def _rows(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(p[:width].ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width), np.array([min(len(p), width) for p in parts])


def maximal_repeats(grams: list[int], before: list[bytes], after: list[bytes], copies: list[int], length: int = LENGTH, left_most: int = LENGTH - GRAM) -> Iterator[tuple[np.ndarray, int, int]]:
    """Repeat groups: all their members, and the bytes these share left of the gram and from it on.

    Members start with the same gram; ``before`` is what stands left of it, reversed;
    ``after`` starts with the gram.  A member stands for ``copies`` places with the same
    bytes: a leaf of the tree with several copies is a group of its own.
    """
    for i, n in enumerate(copies):
        if n > 1:
            yield np.array([i]), len(before[i]), len(after[i])
    n = len(grams)
    if n < 2:
        return
    order = np.array(sorted(range(n), key=lambda i: (grams[i], after[i])))
    rows, lens = _rows(after, length)
    lefts, left_lens = _rows(before, max(1, left_most))
    left_place, place = np.empty(n, np.int64), np.empty(n, np.int64)
    left_place[sorted(range(n), key=before.__getitem__)] = np.arange(n)
    place[order] = np.arange(n)
    a, b = order[:-1], order[1:]
    of = np.array(grams)
    lcp = np.concatenate([[0], np.where(of[a] == of[b], common_prefix(rows[a], rows[b], lens[a], lens[b]), 0)])
    for depth, first, last in intervals(lcp.tolist()):
        members = order[first : last + 1]
        members = members[np.argsort(left_place[members])]
        shared = common_prefix(lefts[members[:-1]], lefts[members[1:]], left_lens[members[:-1]], left_lens[members[1:]])
        if int(shared.max()) + depth < length:
            continue
        # where left extensions differ, classes part; those that share enough there are groups
        for extent, low, high in left_classes(shared.tolist()):
            if extent + depth >= length:
                group = members[low : high + 1]
                places = place[group]
                if int(lcp[places.min() + 1 : places.max() + 1].min()) == depth:  # else a deeper interval has it
                    yield group, extent, depth


def left_classes(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """All members with what they share, be it nothing, and every class within that shares more."""
    yield min(shared), 0, len(shared)
    for extent, low, high in intervals([0, *shared]):
        if high - low < len(shared):
            yield extent, low, high


def shared_extents(groups: Iterable[tuple[np.ndarray, int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes left and right of each occurrence's gram that some group of it shares (0, 0 if none).

    All of an occurrence's groups hold its gram, so together they cover one span.
    """
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for members, before, after in groups:
        left[members] = np.maximum(left[members], before)
        right[members] = np.maximum(right[members], after)
    return left, right


def _groups(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, int, int]]:
    data, off = pdf["symbols"].tolist(), (pdf["at"] - pdf["lo"]).tolist()
    return maximal_repeats(pdf["fp"].tolist(), [d[:o][::-1] for d, o in zip(data, off, strict=True)], [d[o:] for d, o in zip(data, off, strict=True)], pdf["n"].tolist())


def compare_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans that a block's repeat groups cover; each gram is a tree of its own."""
    left, right = shared_extents(_groups(pdf), len(pdf))
    hit, at = right > 0, pdf["at"].to_numpy()
    out = pd.DataFrame({"key": pdf["key"].to_numpy()[hit], "lo": (at - left)[hit].astype(np.int32), "hi": (at + right)[hit].astype(np.int32)})
    return out.assign(src_key=0, src_lo=np.int32(0))


def list_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for each member of each of a block's repeat groups."""
    fp, key, at, n = (pdf[c].to_numpy() for c in ("fp", "key", "at", "n"))
    parts = []
    for members, left, right in _groups(pdf):
        lead = members[np.lexsort((at[members], key[members]))[0]]
        columns = {"fp": fp[lead], "lead_key": key[lead], "lead_at": at[lead], "left": left, "right": right}
        parts.append(pd.DataFrame({**columns, "key": key[members], "lo": at[members] - left, "hi": at[members] + right, "copies": n[members]}))
    return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("fp", "lead_key", "lead_at", "left", "right", "key", "lo", "hi", "copies")})


WINDOWS = Windows(LENGTH, GRAM, byte_symbols, earlier=False)


def without(text: bytes, marks: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the remaining bytes."""
    runs = merged([(m["lo"], min(m["hi"], len(text))) for m in marks or ()])
    ends = [0, *(hi for _, hi in runs)]
    return runs, b"".join(text[a:b] for a, b in zip(ends, [*(lo for lo, _ in runs), len(text)], strict=True))


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SEGMENTS) -> DataFrame:
    """``group_id, length, doc_id, lo, hi, copies``: the repeated strings and all their occurrences.

    Equal segments are one occurrence, the first, with its number of ``copies``.  Of
    anchors with more classes than ``most``, each repeated window is a group.
    """
    docs = row_keys(id_text(df, id_col, text_col), "key")
    met = met_classes(docs, WINDOWS)
    opened = open_classes(met, most)
    # a gram with one class is a tree with one leaf, and so is each class of a crowded one
    alone = met.filter("n > 1").join(opened.filter(~F.col("crowded")).select("fp").distinct(), "fp", "left_anti")
    names = alone.select(F.xxhash64("fp", "key", "at").alias("group_id"), "key", "lo", "hi", F.col("n").alias("copies"))
    wanted = marked_texts(docs, opened)
    listed = in_blocks(wanted, WINDOWS, opened.count()).applyInPandas(list_groups, "fp long, lead_key long, lead_at int, left int, right int, key long, lo int, hi int, copies long")
    found = listed.select(F.xxhash64("fp", "lead_key", "lead_at", "left", "right").alias("group_id"), "key", "lo", "hi", "copies")
    crowded = window_groups(wanted, WINDOWS).select(F.col("window").alias("group_id"), F.col("first.key").alias("key"), F.col("first.start").alias("lo"), (F.col("first.start") + LENGTH).cast("int").alias("hi"), "copies")
    ends = docs.select("key", "doc_id", F.octet_length("text").alias("n_bytes"))
    placed = names.unionByName(found).unionByName(crowded).join(ends, "key").withColumn("hi", F.least("hi", "n_bytes"))
    return placed.select("group_id", (F.col("hi") - F.col("lo")).alias("length"), "doc_id", "lo", "hi", "copies")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SEGMENTS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte spans and the remaining bytes of every row."""
    docs = row_keys(id_text(df, id_col, text_col), "key")
    spans = repeated_spans(docs, WINDOWS, compare_segments, most)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for part in (p for batch in batches for p in slices(batch)):
            sizes, cuts, kept = [], [], []
            for text, marks in zip(text_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                runs, rest = without(text or b"", marks)
                sizes.append(len(text or b""))
                cuts.append([{"lo": a, "hi": b} for a, b in runs])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(cuts, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return with_spans(docs, spans).select("doc_id", "text", "spans").mapInArrow(apply, "doc_id long, n_bytes long, spans array<struct<lo: int, hi: int>>, kept binary")


def deduped_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without repeated strings; rows left with no text go.

    A character cut in part goes as a whole; a null text stays null.
    """
    others = [c for c in df.columns if c != text_col]
    rest = F.struct(*[F.col(c) for c in others]) if others else F.lit(None).cast("int")
    docs = row_keys(df, "__suffix_key", id_col, text_col).select(F.col("__suffix_key").alias("key"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    joined = with_spans(docs, repeated_spans(docs, WINDOWS, compare_segments))
    marked = joined.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns], F.col("spans").alias("__suffix_spans"))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, marks = batch.schema.names.index(text_col), batch.column(batch.schema.names.index("__suffix_spans")).to_pylist()
        texts = [None if t is None else without(t, m)[1].decode(errors="ignore") if m else t.decode() for t, m in zip(text_bytes(batch.column(at)), marks, strict=True)]
        return with_text(batch, text_col, texts).filter(pa.array([not m or bool(t and t.strip()) for t, m in zip(texts, marks, strict=True)]))

    return map_rows(marked, apply).select(*df.columns)
