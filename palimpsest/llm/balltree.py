"""Hard-negative mining by ball trees.

Rows fall to the nearest of a bounded number of pivots; a pivot's rows are dealt into
cells of bounded size, and each cell holds a ball tree: a node knows the centre and the
radius of its rows, so every inner product of a query q with one of them lies within
``q.c -+ |q| r``.  Both bounds prune: a node is left out for a query's window when all
its scores lie above or below the window, or strictly beneath the k-th score found so
far (one that equals it may still win by its id).  Nodes also know their labels: a node
of other labels holds no positive, and one of the query's label alone no negative.

Two searches over the same cells: an anchor's positives (its own label, no window),
then for each positive the negatives whose score lies in the window the positive sets,
all of an anchor's windows at once.  Before anchors are sent to cells in the second
search, the balls of the pivots (a row each) are held against the windows.  Anchors are
dealt into blocks, so that a task holds a cell and a block, both of bounded size; cell
results are merged by rank, a few rows a cell.

Vectors become integers floor(scale * x); scores are exact while they stay below 2**53.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part; shorter vectors count as padded with zeros; a row that repeats
an anchor's id is no partner of it, and a repeated anchor id is one anchor, the row of
the least label and vector; otherwise repeated ids are partners of their own; ties go to
the smaller id; an anchor without positives, or a positive without negatives in its
window, gives no row; a window around a negative score is empty; other columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed
from palimpsest.llm.voronoi import MAX_PIVOTS, pivots_of

#: Rows of a cell, anchors of a block, rows of a leaf, and queries scored at once.
CELL_ROWS, ANCHOR_BLOCK, LEAF_ROWS, QUERY_ROWS = 32_768, 8_192, 64, 1_024


@dataclass
class Tree:
    """Nodes in arrays: a node's rows lie from ``start`` to ``end``; leaves have no ``left``."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least_label: np.ndarray
    most_label: np.ndarray


def ball_tree(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Halves at the median of the direction between two far rows, down to small leaves."""
    order = np.arange(len(ids))
    nodes: list[list[int]] = [[0, len(ids), -1, -1]]
    at = 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        if end - start > leaf_rows:
            rows = x[order[start:end]]
            first = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
            second = rows[((rows - first) ** 2).sum(1).argmax()]
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows @ (second - first), middle)]
            nodes[at][2:] = [len(nodes), len(nodes) + 1]
            nodes += [[start, start + middle, -1, -1], [start + middle, end, -1, -1]]
        at += 1
    x, ids, labels = x[order], ids[order], labels[order]
    start, end, left, right = np.array(nodes).T
    centre = np.array([x[a:b].mean(0) for a, b in zip(start, end, strict=True)])
    radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(start, end, centre, strict=True)])
    low, high = (np.array([f(labels[a:b]) for a, b in zip(start, end, strict=True)]) for f in (np.min, np.max))
    return Tree(x, ids, labels, start, end, left, right, centre, radius, low, high)


class Best:
    """The k best (score, id) of every query and window so far."""

    def __init__(self, queries: int, windows: int, k: int):
        self.k, self.windows = k, windows
        self.slot = np.empty(0, np.int64)  # query * windows + window
        self.score, self.id = np.empty(0), np.empty(0, np.int64)
        self.kth = np.full(queries * windows, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        self.kth[slot[last]] = score[last]
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def search(tree: Tree, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[Best, int]:
    """The k best rows of each query's windows, and how many scores were computed.

    ``low, high``: (queries, windows), inclusive; an unused window has low above high.
    """
    windows = low.shape[1]
    best, length = Best(len(q), windows, k), np.sqrt((q**2).sum(1))
    slack = 1e-9 * (length * np.sqrt((tree.x**2).sum(1).max()) + 1)
    computed = 0

    def score(node: int, rows: np.ndarray) -> None:
        nonlocal computed
        part = slice(tree.start[node], tree.end[node])
        for at in range(0, len(rows), QUERY_ROWS):
            some = rows[at : at + QUERY_ROWS]
            found = q[some] @ tree.x[part].T
            computed += found.size
            fits = ((tree.labels[part] == labels[some, None]) == same) & (tree.ids[part] != ids[some, None])
            added = []
            for w in range(windows):
                kth = best.kth[some * windows + w]
                row, column = np.nonzero(fits & (found >= np.maximum(low[some, w], kth)[:, None]) & (found <= high[some, w][:, None]))
                added.append((some[row] * windows + w, found[row, column], tree.ids[part][column]))
            best.add(*(np.concatenate(p) for p in zip(*added, strict=True)))

    def useful(node: int, rows: np.ndarray) -> np.ndarray:
        own = (tree.least_label[node] <= labels[rows]) & (labels[rows] <= tree.most_label[node]) if same else ~((tree.least_label[node] == labels[rows]) & (labels[rows] == tree.most_label[node]))
        rows = rows[own]
        middle, reach = q[rows] @ tree.centre[node], length[rows] * tree.radius[node] + slack[rows]
        top, bottom = (middle + reach)[:, None], (middle - reach)[:, None]
        kth = best.kth.reshape(-1, windows)[rows]
        return rows[((top >= np.maximum(low[rows], kth)) & (bottom <= high[rows])).any(1)]

    # each query's likeliest leaf first, so that there is a k-th score to prune by
    at, dived = np.zeros(len(q), np.int64), np.full(len(q), -1)
    while (inner := np.flatnonzero(tree.left[at] >= 0)).size:
        a, b = tree.left[at[inner]], tree.right[at[inner]]
        at[inner] = np.where((q[inner] * tree.centre[a]).sum(1) >= (q[inner] * tree.centre[b]).sum(1), a, b)
    for leaf in np.unique(at):
        rows = np.flatnonzero(at == leaf)
        dived[rows] = leaf
        score(leaf, rows)
    stack = [(0, np.arange(len(q)))]
    while stack:
        node, rows = stack.pop()
        rows = useful(node, rows)
        if not len(rows):
            continue
        if tree.left[node] < 0:
            score(node, rows[dived[rows] != node])
        else:
            near = [int(tree.left[node]), int(tree.right[node])]
            near.sort(key=lambda c: float((q[rows] @ tree.centre[c]).sum()))
            stack += [(c, rows) for c in near]
    return best, computed


def _vectors(df: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, label, v array<bigint>`` of the rows that take part."""
    chosen = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = chosen.filter("id is not null and label is not null and x is not null").filter(sound)
    return kept.select("id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as the rows of a matrix, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return x


def _rows(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, width)


@dataclass
class Cells:
    """Rows by cell, and the pivots' balls."""

    rows: DataFrame  # id, label, v binary, pivot, salt
    pivots: np.ndarray
    radius: np.ndarray
    counts: np.ndarray  # cells of each pivot, none where it has no rows

    @property
    def width(self) -> int:
        return self.pivots.shape[1]


def cells_of(vectors: DataFrame, n: int, width: int, pivots: int | None) -> Cells:
    chosen = pivots_of(vectors, pivots or max(4, min(MAX_PIVOTS, n // CELL_ROWS)), width)
    norms = (chosen**2).sum(1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), width)
            near = (norms - 2 * x @ chosen.T).argmin(1)
            far = np.sqrt(((x - chosen[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near.astype(np.int32)), pa.array(far)], ["id", "label", "v", "pivot", "far"])

    placed = checkpointed(vectors.mapInArrow(place, "id long, label long, v binary, pivot int, far double"))
    radius, counts = np.zeros(len(chosen)), np.zeros(len(chosen), np.int64)
    for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():  # a row a pivot
        radius[r.pivot], counts[r.pivot] = r.r, -(-r.n // CELL_ROWS)
    times = F.element_at(F.array(*[F.lit(int(c)) for c in np.maximum(1, counts)]), F.col("pivot") + 1)
    return Cells(placed.select("id", "label", "v", "pivot", F.pmod(F.xxhash64("id", "v"), times.cast("long")).cast("int").alias("salt")), chosen, radius, counts)


def _found(cells: Cells, anchors: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """``anchor_id, window, id, score``: every cell's k best rows of each anchor's windows.

    ``anchors``: id, label, v, low and high (arrays, one element a window).
    """
    pivots, radius, counts, width = cells.pivots, cells.radius, cells.counts, cells.width
    schema = "anchor_id long, window int, id long, score long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(-1, width)
            low, high = (np.array([f(w) for w in batch.column(c).to_pylist()], np.float64) for c, f in ((3, min), (4, max)))
            middle, reach = q @ pivots.T, np.sqrt((q**2).sum(1))[:, None] * radius * (1 + 1e-9) + 1e-3
            row, group = np.nonzero((middle + reach >= low[:, None]) & (middle - reach <= high[:, None]) & (counts > 0))
            times = counts[group]
            salt = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            sent = batch.take(pa.array(np.repeat(row, times)))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(np.repeat(group, times).astype(np.int32)), pa.array(salt.astype(np.int32))], [*sent.schema.names, "pivot", "salt"])

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    wanted = anchors.select("id", "label", "v", "low", "high").mapInArrow(send, "id long, label long, v binary, low array<bigint>, high array<bigint>, pivot int, salt int").withColumn("block", block)
    data = cells.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"anchor_id": [], "window": [], "id": [], "score": []}).astype({"anchor_id": "int64", "window": "int32", "id": "int64", "score": "int64"})
        tree = ball_tree(_rows(right["v"], width), right["id"].to_numpy(), right["label"].to_numpy())
        most = max(map(len, left["low"]))
        low, high = np.full((len(left), most), 1.0), np.full((len(left), most), 0.0)  # unused windows are empty
        for i, (a, b) in enumerate(zip(left["low"], left["high"], strict=True)):
            low[i, : len(a)], high[i, : len(b)] = a, b
        ids = left["id"].to_numpy()
        best, _ = search(tree, _rows(left["v"], width), ids, left["label"].to_numpy(), low, high, k, same)
        return pd.DataFrame({"anchor_id": ids[best.slot // most], "window": (best.slot % most).astype(np.int32), "id": best.id, "score": best.score.astype(np.int64)})

    keys = ["pivot", "salt", "block"]
    return wanted.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, schema)


def hard_negatives(
    df: DataFrame,
    is_anchor: Callable[[Column], Column],
    label: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int, int] = (80, 100, 100),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``window`` (low, high, of): a negative's score times ``of`` lies between the positive's
    score times ``low`` and times ``high``.
    """
    spark, (least, most, of) = df.sparkSession, window
    vectors = _vectors(df, label, scale, id_col, vector_col)
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = cells_of(vectors, n, max(1, width), pivots)
    chosen = cells.rows.filter(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    anchors = checkpointed(chosen)
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    everything = [F.array(F.lit(x)).alias(c) for c, x in (("low", -(1 << 62)), ("high", 1 << 62))]
    near = _found(cells, anchors.select("*", *everything), blocks, positives, same=True)
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = near.withColumn("window", F.row_number().over(order) - 1).filter(F.col("window") < positives)
    best = checkpointed(best.select("anchor_id", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")

    def floored(x: Column) -> Column:
        """x / of, rounded down."""
        return F.call_function("floor", (x - F.pmod(x, F.lit(of))).cast("decimal(20,0)") / F.lit(of)).cast("long")

    bounds = F.struct("window", (-floored(-least * score)).alias("low"), floored(most * score).alias("high"))
    windows = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(bounds)).alias("w"))  # a few windows an anchor
    asked = anchors.join(windows, anchors["id"] == windows["anchor_id"]).select("id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    mined = _found(cells, asked, blocks, negatives, same=False)
    order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = ranked.join(best, ["anchor_id", "window"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), score, F.col("score").alias("negative_score"))
