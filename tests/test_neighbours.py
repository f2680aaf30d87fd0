"""Kept neighbour lists, their extension, and searches under a mask, against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import neighbours as N
from palimpsest.sources.snapshots import Conflict


def vectors(spark, n, seed=0, copies=0):
    draws = np.random.default_rng(seed).normal(size=(n, 6)).round(3)
    draws[n - copies :] = draws[:copies]
    return draws, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draws)], "vec_id long, embedding array<double>")


def order(draws, i, allowed):
    scores = np.round(draws @ draws[i], 9)
    return sorted((j for j in allowed if j != i), key=lambda j: (-scores[j], j))


def test_extended_lists_equal_those_made_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)  # several blocks of each side
    draws, df = vectors(spark, 150, copies=10)
    rows = N.usable(df)
    table = N.NeighbourTable(spark, f"{tmp_path}/n", 5)
    assert table.extend(rows.filter("id < 70")) == 70
    assert table.extend(rows.filter("id % 2 = 0")) == 40 and table.extend(rows) == 40 and table.extend(rows) == 0
    got = {}
    for r in table.neighbours(5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    assert got == {i: order(draws, i, range(150))[:5] for i in range(150)}
    with pytest.raises(ValueError):
        table.neighbours(6)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 0.99, 1.0])
def test_nearest_unused_is_exact_at_every_share_of_used_rows(spark, tmp_path, share):
    draws, df = vectors(spark, 120, seed=1, copies=12)
    table = N.NeighbourTable(spark, f"{tmp_path}/n", 8)
    table.extend(N.usable(df))
    used = set(np.random.default_rng(2).permutation(120)[: round(120 * share)].tolist())
    mask = spark.createDataFrame([(i,) for i in [*used, *used, 10**6]], "used_id long")
    seeds = spark.createDataFrame([(i,) for i in [*range(0, 120, 3), 0, 999]], "seed_id long")
    found = table.nearest_unused(seeds, mask, k=2).collect()
    want = {i: order(draws, i, set(range(120)) - used)[:1] for i in range(0, 120, 3)}
    assert {r.seed_id: r.nearest_id for r in found} == {i: w[0] for i, w in want.items() if w}
    rounds = {r.round for r in found}
    assert rounds == {0.0: {0}, 1.0: set()}.get(share, rounds) and (share != 0.5 or {0, 1} <= rounds) and (share != 0.99 or -1 in rounds)


def test_rows_that_cannot_be_compared_and_empty_tables(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0])]
    rows = N.usable(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    table = N.NeighbourTable(spark, f"{tmp_path}/n", 3)
    assert table.extend(rows.limit(0)) == 0 and table.neighbours(3).count() == 0
    assert table.nearest_unused(spark.createDataFrame([(1,)], "seed_id long"), spark.createDataFrame([], "used_id long")).count() == 0
    assert table.extend(rows) == 2
    assert [(r.query_id, r.neighbour_id) for r in table.neighbours(3).orderBy("query_id").collect()] == [(1, 6), (6, 1)]


def test_of_two_extensions_one_changes_nothing(spark, tmp_path, monkeypatch):
    _, df = vectors(spark, 30)
    rows, first, second = N.usable(df), *(N.NeighbourTable(spark, f"{tmp_path}/n", 3) for _ in range(2))
    first.extend(rows.filter("id < 10"))
    commit = N.NeighbourTable._commit

    def late(self, *args):
        monkeypatch.setattr(N.NeighbourTable, "_commit", commit)
        second.extend(rows.filter("id < 20"))
        commit(self, *args)

    monkeypatch.setattr(N.NeighbourTable, "_commit", late)
    with pytest.raises(Conflict):
        first.extend(rows)
    assert first.rows().count() == 20 and first.neighbours(3).select("query_id").distinct().count() == 20


def test_only_near_rows_are_rounded_and_sorted(monkeypatch):
    """A block's rows are not all sorted for each query (F6, F7); ties and copies come out by id."""
    from palimpsest.operators import stitching as K

    rng, sizes, whole = np.random.default_rng(3), [], np.round
    v = rng.normal(size=(700, 8))
    v[100:140] = v[100]
    rows = pd.DataFrame({"id": np.arange(700) * 3, "v": list(v)})
    monkeypatch.setattr(np, "round", lambda x, n: sizes.append(np.size(x)) or whole(x, n))
    got = K.nearest_among(rows, rows, 5)
    scores = whole(v @ v.T, 9)
    np.fill_diagonal(scores, -np.inf)
    want = [(3 * i, 3 * j) for i in range(700) for j in np.lexsort((np.arange(700), -scores[i]))[:5]]
    assert list(zip(got["query_id"], got["neighbour_id"], strict=True)) == want
    assert sum(sizes) < 700 * 60
    assert len(K.nearest_among(rows[:3], rows[:3].reset_index(drop=True), 5)) == 6


def test_what_is_shuffled_grows_with_the_rows_and_not_with_their_pairs(spark, tmp_path, monkeypatch):
    """Vectors are not copied to every block they meet (F1)."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    monkeypatch.setattr(N, "TASKS", 4, raising=False)
    context, shuffled = spark.sparkContext._jsc.sc(), []

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    for n in (200, 800):
        draws, df = vectors(spark, n, seed=4, copies=30)
        table, rows, before = N.NeighbourTable(spark, f"{tmp_path}/{n}", 4), N.usable(df), written()
        table.extend(rows.filter("id % 10 <> 3"))
        table.extend(rows)
        shuffled.append(written() - before)
        got = {i: [] for i in range(n)}
        for r in table.neighbours(4).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.neighbour_id)
        assert got == {i: order(draws, i, range(n))[:4] for i in range(n)}
    assert shuffled[1] < 6 * shuffled[0]


def test_lists_of_a_block_with_common_copies_repeated_ids_and_scores_that_overflow():
    rng = np.random.default_rng(5)
    v, ids = rng.normal(size=(900, 4)).round(2), np.arange(900) * 7 % 900
    v[100:700] = v[100]
    found = N.Nearest(ids[:600], 5)
    for at in (0, 300, 302, 600):
        end = {0: 300, 300: 302, 302: 600, 600: 900}[at]
        found.meet(v[:600], ids[at:end], v[at:end])
    scores = np.round(v[:600] @ v.T, 9)
    scores[np.arange(600), np.arange(600)] = -np.inf
    assert found.near.tolist() == [ids[np.lexsort((ids, -s))[:5]].tolist() for s in scores]
    few = N.Nearest(np.array([1, 2]), 3)
    few.meet(np.array([[1e200, 0.0], [1.0, 0.0]]), np.array([1, 1, 2, 3, 4]), np.array([[1e200, 0.0], [1e200, 0.0], [1.0, 0.0], [2.0, 1.0], [1e200, 1.0]]))
    assert few.rows().to_pydict() == {"query_id": [1, 1, 2, 2, 2], "neighbour_id": [3, 2, 1, 1, 4], "similarity": [2e200, 1e200, 1e200, 1e200, 1e200]}
