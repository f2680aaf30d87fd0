"""Exact top-k inner-product search as a Voronoi join.

Rows fall to the nearest of a bounded number of pivots.  Each group is summed up
by its size, its radius and the k + 1 smallest distances to its pivot, a table of a
few numbers a pivot.  With them a query q knows that a row at distance d from pivot
p scores within ``q.p -+ |q| d``: the summaries' lower bounds guarantee a k-th best
score.  Groups whose best possible score ``q.p + |q| r`` is below it are left out; to
the other groups' cells the query is sent, the queries being the far smaller side,
with the least distance from the pivot that a useful row has.  Large groups are
split into cells of bounded size by a hash of the row; each cell is solved with
matrix products over its rows that lie far enough out for a block's queries, and
each query's cell results are merged, a few rows a cell.

Vectors become integers floor(scale * x); scores are exact while they stay below
2**53.

Defined results: vectors that are null, or hold a null or a non-finite component,
take no part, as query or candidate; shorter vectors count as padded with zeros;
rows with a null id take no part; repeated ids are candidates of their own, and a
query leaves out every row with its own id; a repeated query id is one query, with
the row of the least vector; ties go to the smaller id; with fewer candidates than
k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed

#: Rows of a cell, pivots at most, and queries multiplied at once.
CELL_ROWS, MAX_PIVOTS, QUERY_BLOCK = 32_768, 256, 256


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, v array<bigint>`` of the rows that take part."""
    x = F.col("x")
    sound = x.isNotNull() & F.col("id").isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return chosen.filter(sound).select("id", F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, width)


def pivots_of(vectors: DataFrame, count: int, width: int) -> np.ndarray:
    """A repeatable sample of ``count`` distinct vectors (bounded by MAX_PIVOTS)."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(min(count, MAX_PIVOTS)).select("v").collect()
    return np.unique(np.array([r.v + [0] * (width - len(r.v)) for r in rows], np.float64).reshape(-1, width), axis=0)


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, v binary, pivot, distance``: the nearest pivot; ``v`` holds doubles."""
    width, norms = pivots.shape[1], (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, width))
            for i, v in enumerate(batch.column(1)):
                values = v.values.to_numpy(zero_copy_only=False)
                x[i, : len(values)] = values
            near = (norms - 2 * x @ pivots.T).argmin(1)
            distance = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near.astype(np.int32)), pa.array(distance)], ["id", "v", "pivot", "distance"])

    return vectors.mapInArrow(run, "id long, v binary, pivot int, distance double")


def needed_groups(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int, own: int | np.ndarray = 1, nearest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query and group: whether it may hold one of the k best scores, and the
    least distance from the pivot of a row that may.

    ``nearest``: the smallest distances of each group, ascending, padded with infinity.
    The ``own`` rows of the query's id may all be counted in a guarantee, so k + own
    rows must reach it.
    """
    least = k + np.broadcast_to(own, len(q))
    nearest = np.empty((len(pivots), 0)) if nearest is None else nearest
    known = np.isfinite(nearest)
    length, middle = np.sqrt((q**2).sum(1))[:, None], q @ pivots.T
    # a guarantee for each row named by its distance, and one for the others of a group
    counts = np.concatenate([np.ones(int(known.sum()), np.int64), size - known.sum(1)])
    group = np.concatenate([np.nonzero(known)[0], np.arange(len(pivots))])
    distance = np.concatenate([nearest[known], radius])
    low, high = middle[:, group] - length * distance, middle + length * radius
    order = np.argsort(-low, axis=1)
    enough = (np.cumsum(counts[order], axis=1) >= least[:, None]).argmax(1)
    sure = np.take_along_axis(low, order, 1)[np.arange(len(q)), enough]
    sure[size.sum() < least] = -np.inf
    sure = (sure - 1e-6 * (np.abs(high).max(1, initial=1.0) + 1))[:, None]
    out = np.divide(sure - middle, length, out=np.zeros_like(middle), where=(length > 0) & np.isfinite(sure))
    return (high >= sure) & (size > 0), out


def top_k(df: DataFrame, is_query, k: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query(id column)`` holds."""
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = integer_vectors(df, scale, id_col, vector_col)
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    width = max(1, width)
    chosen = pivots_of(vectors, pivots or max(8, min(MAX_PIVOTS, round(n**0.5 / 4))), width)
    placed = checkpointed(assign(vectors, chosen))
    size, radius = np.zeros(len(chosen), np.int64), np.zeros(len(chosen))
    for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect():  # a row a pivot
        size[r.pivot], radius[r.pivot] = r.n, r.r
    cells = np.maximum(1, -(-size // CELL_ROWS))
    nearest = np.full((len(chosen), k + 1), np.inf)
    close = placed.withColumn("n", F.row_number().over(W.partitionBy("pivot").orderBy("distance"))).filter(F.col("n") <= k + 1)
    for r in close.select("pivot", "n", "distance").collect():  # k + 1 rows a pivot
        nearest[r.pivot, r.n - 1] = r.distance

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data, own = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for at in range(0, len(ids), QUERY_BLOCK):
                q = np.frombuffer(b"".join(data[at : at + QUERY_BLOCK]), "<f8").reshape(-1, width)
                needed, out = needed_groups(q, chosen, radius, size, k, own[at : at + QUERY_BLOCK], nearest)
                row, group = np.nonzero(needed)
                times = cells[group]
                row, group = np.repeat(row, times), np.repeat(group, times)
                salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                columns = [pa.array(ids[at + row]), pa.array([data[at + i] for i in row], pa.binary()), pa.array(group.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(out[row, group])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "pivot", "salt", "out"])

    asking = placed.filter(is_query(F.col("id")))
    blocks = max(1, -(-asking.count() // CELL_ROWS))  # a task holds one cell's rows and one block's queries
    queries = asking.groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    asked = queries.mapInArrow(send, "query_id long, q binary, pivot int, salt int, out double").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    spread = F.create_map(*[F.lit(x) for i, c in enumerate(cells.tolist()) if c > 1 for x in (i, c)]) if (cells > 1).any() else F.create_map(F.lit(-1), F.lit(1))
    salted = placed.select("id", "v", "pivot", "distance", F.pmod(F.xxhash64("id", "v"), F.coalesce(F.element_at(spread, F.col("pivot")), F.lit(1)).cast("long")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        right, left = right.sort_values("distance", ascending=False, ignore_index=True), left.sort_values("out", ignore_index=True)
        every, x, parts, inward = right["id"].to_numpy(), _matrix(right["v"], width), [], -right["distance"].to_numpy()
        for at in range(0, len(left), QUERY_BLOCK):
            some = left.iloc[at : at + QUERY_BLOCK]
            # rows nearer to the pivot than any of these queries needs are not read
            ids = every[: int(np.searchsorted(inward, -some["out"].iloc[0], "right"))]
            scores = _matrix(some["q"], width) @ x[: len(ids)].T
            for query, row in zip(some["query_id"].tolist(), scores, strict=True):
                row = np.where(ids == query, -np.inf, row)
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    best = np.flatnonzero(row >= least)
                else:
                    best = np.arange(len(row))
                best = best[np.lexsort((ids[best], -row[best]))][:k]
                best = best[np.isfinite(row[best])]
                parts.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": row[best].astype(np.int64)}))
        return pd.concat(parts).astype("int64") if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["pivot", "salt", "block"]
    local = asked.groupBy(*keys).cogroup(salted.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
