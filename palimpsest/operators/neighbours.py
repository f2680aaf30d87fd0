"""A kept table of nearest neighbours, extended by what is appended, and searches under a mask.

The table holds each row's first ``depth`` neighbours by inner product.  Rows that come
later meet all rows once, and the rows that were there meet the new ones only; old pairs
are never compared again.  A search for the nearest row that is not used yet reads the
first k neighbours, drops the used ones by an anti-join, and goes on with twice as many for
those seeds alone that found none; seeds whose whole list is used meet the unused rows
themselves, so every answer is exact.

Vectors are compared in packed blocks that lie in stored files.  A task keeps the lists of a
few blocks of queries while it reads the other blocks one after another, so no vector is
copied or shuffled for a comparison, and what is written grows with the rows, not with
their pairs.

Defined results: null vectors and vectors with a null or non-finite component take no part;
ties go to the smaller id; a row is not its own neighbour; a seed for which no row is left
has none; seeds that are in no table are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.common import checkpointed
from palimpsest.sources.snapshots import SnapshotTable

FOUND = "query_id long, neighbour_id long, similarity double"
LISTS = ("query_id", "rank", "neighbour_id", "similarity")
#: Rows of a block, queries scored at once, tasks of a comparison (where there are as many pairs of blocks), and query blocks of a task at most.
BLOCK_ROWS, SCORED_ROWS, TASKS, TASK_BLOCKS = 2048, 512, 32, 8


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: the rows that can be compared."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query's candidates."""
    place = W.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(*LISTS)


def packed(rows: DataFrame, n: int) -> DataFrame:
    """``block, ids, v``: ``n`` rows ``id, v`` as blocks of bounded size, with their ids and doubles as binaries."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        if pc.count_distinct(pa.chunked_array([pc.list_value_length(p.column(1)) for p in parts])).as_py() > 1:
            raise ValueError("vectors of one length are compared")
        ids, v = (b"".join(x.to_numpy(zero_copy_only=False).tobytes() for x in c) for c in ([p.column(0) for p in parts], [p.column(1).flatten() for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([v], pa.binary())], ["ids", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                parts.append(batch.slice(at, BLOCK_ROWS))
                if sum(p.num_rows for p in parts) >= 2 * BLOCK_ROWS:  # a partition is one block, unless an id repeats
                    yield joined(parts)
                    parts = []
        if parts:
            yield joined(parts)

    blocks = rows.select("id", "v").repartition(max(1, -(-n // BLOCK_ROWS)), "id").mapInArrow(pack, "ids binary, v binary")
    return checkpointed(blocks.select(F.monotonically_increasing_id().alias("block"), "ids", "v"))


class Nearest:
    """The k rows nearest to each query of a block, among the rows it has met; scores that are not finite count for nothing."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.near, self.similarity = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)

    def meet(self, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> None:
        """``x``: the queries' vectors; ``others, y``: a block of rows."""
        shared = np.flatnonzero(np.isin(others, self.ids))
        for at in range(0, len(x), SCORED_ROWS):
            ids, least = self.ids[at : at + SCORED_ROWS], self.similarity[at : at + SCORED_ROWS, -1]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = x[at : at + SCORED_ROWS] @ y.T
            row, col = np.nonzero(ids[:, None] == others[shared])
            scores[row, shared[col]] = -np.inf
            if len(others) > self.k and np.isneginf(least).any():
                scores[~np.isfinite(scores)] = -np.inf
                least = np.maximum(least, np.partition(scores, len(others) - self.k, axis=1)[:, len(others) - self.k])
            row, col = np.divmod(np.flatnonzero(scores >= least[:, None] - 2e-9), len(others))  # rounding moves a score by 5e-10 at most
            score = scores[row, col]
            sound = np.isfinite(score)
            self._take(row[sound] + at, others[col[sound]], np.round(score[sound], 9))

    def _take(self, row: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
        worst = self.similarity[row, -1]
        better = (score > worst) | ((score == worst) & (near < self.near[row, -1]))
        listed = np.unique(row[better])
        row = np.concatenate([np.repeat(listed, self.k), row[better]])
        near, score = np.concatenate([self.near[listed].ravel(), near[better]]), np.concatenate([self.similarity[listed].ravel(), score[better]])
        order = np.lexsort((near, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.near[row[best], place[best]], self.similarity[row[best], place[best]] = near[order[best]], score[order[best]]

    def rows(self) -> pa.RecordBatch:
        found = np.isfinite(self.similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, found.sum(1))), pa.array(self.near[found]), pa.array(self.similarity[found])], ["query_id", "neighbour_id", "similarity"])


def nearest_of(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """``query_id, neighbour_id, similarity``: for packed rows, k candidates or more among other packed rows.

    Pairs of blocks are made by a Cartesian product of stored partitions, which shuffles
    nothing: a task holds up to ``TASK_BLOCKS`` blocks of queries and reads a part of the
    data, all of it once the queries alone make enough tasks, and returns k candidates a query.
    """
    blocks = queries.count()
    groups = max(1, min(blocks, max(TASKS, -(-blocks // TASK_BLOCKS))))
    asked = queries.coalesce(groups)
    held = data.select(F.col("ids").alias("others"), F.col("v").alias("w")).coalesce(max(1, min(data.count(), -(-TASKS // groups))))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, Nearest] = {}
        for batch in batches:
            for block, *binaries in zip(*batch.columns, strict=True):
                ids, others = (np.frombuffer(x.as_buffer(), np.int64) for x in binaries[:2])
                x, y = (np.frombuffer(v.as_buffer()).reshape(len(i), -1) for i, v in zip((ids, others), binaries[2:], strict=True))
                if block.as_py() not in lists:
                    lists[block.as_py()] = Nearest(ids.copy(), k)
                lists[block.as_py()].meet(x, others, y)
        for found in lists.values():
            yield found.rows()

    pairs = held.crossJoin(asked.hint("shuffle_replicate_nl")).select("block", "ids", "others", "v", "w")
    return pairs.mapInArrow(solve, FOUND)


class NeighbourTable:
    """Neighbour lists and the vectors they were made from, below ``path``; both change in one commit."""

    def __init__(self, spark: SparkSession, path: str, depth: int):
        self.spark, self.depth = spark, depth
        self.table = SnapshotTable(spark, f"{path}/depth-{depth}", "kind")

    def rows(self) -> DataFrame:
        return self.table.read().filter("kind = 'row'").select("id", "v")

    def lists(self) -> DataFrame:
        return self.table.read().filter("kind = 'list'").select(F.col("id").alias("query_id"), *LISTS[1:])

    def _commit(self, rows: DataFrame, lists: DataFrame, based: int) -> None:
        held = rows.select(F.lit("row").alias("kind"), "id", "v")
        near = lists.select(F.lit("list").alias("kind"), F.col("query_id").alias("id"), *LISTS[1:])
        self.table.replace(held.unionByName(near, allowMissingColumns=True), based_on=based)

    def extend(self, vectors: DataFrame) -> int:
        """Add the ``id, v`` rows that are not there yet, by id, and vectors of one length; how many.

        Of two callers at once one raises ``Conflict`` and changes nothing.
        """
        based = self.table.version()
        had = self.rows() if based else None
        new = checkpointed(vectors if had is None else vectors.join(had, "id", "left_anti"))
        n_new = new.count()
        if had is None:
            blocks = packed(new, n_new)
            self._commit(new, ranked(nearest_of(blocks, blocks, self.depth), self.depth), based)
        elif n_new:
            there, come = packed(had, had.count()), packed(new, n_new)
            met = nearest_of(there, come, self.depth).unionByName(nearest_of(come, there.unionByName(come), self.depth))
            self._commit(had.unionByName(new), ranked(self.lists().drop("rank").unionByName(met), self.depth), based)
        return n_new

    def neighbours(self, k: int) -> DataFrame:
        if k > self.depth:
            raise ValueError(f"the table holds {self.depth} neighbours")
        return self.lists().filter(F.col("rank") <= k)

    def nearest_unused(self, seeds: DataFrame, used: DataFrame, k: int = 4) -> DataFrame:
        """``seed_id, nearest_id, similarity, round``: for ``seed_id`` rows, the nearest row that is not ``used_id``.

        ``round``: how often the list was doubled; -1 where it was used up and the unused
        rows themselves were searched.
        """
        rows, masked = self.rows(), used.select(F.col("used_id").alias("neighbour_id")).distinct()
        asked = seeds.select("seed_id").distinct()
        left, done, number, before = checkpointed(asked.join(rows.select(F.col("id").alias("seed_id")), "seed_id", "left_semi")), [], 0, 0
        while before < self.depth and not left.isEmpty():
            k = min(k, self.depth)
            band = self.lists().filter((F.col("rank") > before) & (F.col("rank") <= k))  # the first half of the list is known to be used
            open_rows = band.join(left, band["query_id"] == left["seed_id"], "left_semi").join(masked, "neighbour_id", "left_anti")
            best = F.min_by(F.struct("neighbour_id", "similarity"), "rank").alias("b")
            found = checkpointed(open_rows.groupBy(F.col("query_id").alias("seed_id")).agg(best))
            done.append(found.select("seed_id", F.col("b.neighbour_id").alias("nearest_id"), F.col("b.similarity").alias("similarity"), F.lit(number).alias("round")))
            left = checkpointed(left.join(found, "seed_id", "left_anti"))
            number, before, k = number + 1, k, 2 * k
        if (n := left.count()) > 0:
            free = rows.join(masked, rows["id"] == masked["neighbour_id"], "left_anti")
            last = ranked(nearest_of(packed(rows.join(left, rows["id"] == left["seed_id"], "left_semi"), n), packed(free, free.count()), 1), 1)
            done.append(last.select(F.col("query_id").alias("seed_id"), F.col("neighbour_id").alias("nearest_id"), "similarity", F.lit(-1).alias("round")))
        return _union(self.spark, done)


def _union(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "seed_id long, nearest_id long, similarity double, round int")
    for part in parts:
        out = out.unionByName(part)
    return out
