"""Hard negatives, phrases and chosen paths against brute force and on hard rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import balltree, chosenpath, jaccard, phrases, queries
from tests.llm.test_groups import brute_components, docs, fixture_texts, prose  # noqa: F401

VECTORS = "vec_id long, embedding array<float>, label int, id string, score int"


def brute_negatives(rows, every, scale, positives, negatives, low, high):
    """The contract, row by row; of an id that repeats as an anchor, the least label and vector counts."""
    sound = [(i, label, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors, out = {}, []
    for i, label, v in sound:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in sound if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(n, i) for n, i, other in scored if other != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def vector_rows(n, seed, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 8))
    rows = [(i, (centres[rng.integers(clusters)] + rng.normal(size=8) * 0.15).round(2).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(i, rows[i][1], rows[i][2]) for i in range(0, n, 10)]  # repeats, anchors among them
    rows += [(0, rows[5][1], 3), (n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], 2), (n + 2, rows[0][1][:3], 1), (n + 3, [], 1)]
    return [*rows, (None, rows[1][1], 1), (n + 4, None, 1), (n + 5, rows[2][1], None), (n + 6, [1.0, None], 1), (n + 7, [float("nan")] * 8, 1), (n + 8, [float("inf")] * 8, 1)]


@pytest.mark.parametrize(("clusters", "pivots", "cell", "block"), [(1, None, 32_768, 8_192), (6, 5, 40, 7)])
def test_hard_negatives_are_brute_force(spark, monkeypatch, clusters, pivots, cell, block):
    monkeypatch.setattr(balltree, "CELL_ROWS", cell)
    monkeypatch.setattr(balltree, "ANCHOR_BLOCK", block)
    rows = vector_rows(300, clusters, clusters)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    for low, high in ((80, 100), (50, 90)):
        got = balltree.hard_negatives(df, lambda i: i % 10 == 0, F.col("label"), scale=64, positives=3, negatives=4, window=(low, high, 100), pivots=pivots)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 64, 3, 4, low, high)


def test_hard_negative_query_moves_labels_and_takes_empty_tables(spark, tmp_path):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))], i % 3) for i in range(400)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    got = queries.op11_ball_tree(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == brute_negatives(moved, 100, 256, 5, 5, 80, 100)
    for name, some in (("none", []), ("nulls", [(None, None, None, None, None), (0, None, None, None, None)])):
        spark.createDataFrame(some, VECTORS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert queries.op11_ball_tree(spark, f"{tmp_path}/{name}").collect() == [] and queries.op11_ball_tree(spark, f"{tmp_path}/{name}").columns == got.columns


def test_trees_prune_by_window_and_kth_score():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(30, 8))[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 8)) * 0.05))
    tree = balltree.ball_tree(x, np.arange(6000), rng.integers(0, 3, 6000))
    q = tree.x[:40]
    for low, high in ((-np.inf, np.inf), (1e5, 2e5)):
        best, computed = balltree.search(tree, q, tree.ids[:40], tree.labels[:40], np.full((40, 1), low), np.full((40, 1), high), 5, False)
        assert computed < 0.5 * 40 * 6000 and len(best.slot)


def brute_phrases(rows, longest, least, top):
    """``lang, rank, phrase, a, l, r, n, score`` from whole counts in plain Python."""
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f, n = Counter(), 0
        for _, own, text in rows:
            if (own or "und") == lang:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
                for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                    w = re.findall("[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        f = {p: c for p, c in f.items() if c >= least}
        covered = {q for p, c in f.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) for q in [p[i:j]] if c >= f[q]}
        scored = []
        for p, a in f.items():
            if len(p) > 1 and p not in covered:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng, words = random.Random(4), "Sea sea salt wind élan über a b  c".split(" ")
    rows = [(i, rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    return [*rows, (None, "en", "red red red red red red red"), (None, "en", "red red red red red red red"), (7, "fr", None), (8, "fr", ""), (9, "fr", " .,; "), (10, "en", "one-word"), (11, "xx", "x y z. " * 40 + " x y　z")]


@pytest.mark.parametrize("places", [1_000_000, 50])
def test_phrases_are_brute_force(spark, monkeypatch, places):
    monkeypatch.setattr(phrases, "SLICE_PLACES", places)
    df = spark.createDataFrame(phrase_rows(), "doc_id long, lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "n", "slice", "k")}).repartition(3)
    for longest, least, top in ((5, 3, 2000), (3, 5, 4)):
        got = phrases.collocations(df, longest, least, top)
        assert sorted(map(tuple, got.collect())) == brute_phrases(phrase_rows(), longest, least, top)


@pytest.mark.parametrize(("keys", "least"), [(1, 3), (5, 3), (1 << 24, 3), (1 << 24, 300)])
def test_phrases_whose_hashes_meet_are_brute_force(spark, monkeypatch, keys, least):
    """Few different hashes in many parts let rare phrases through, which exact sums take out; lengths may pass a byte."""
    for name, value in (("SLICE_PLACES", 50), ("PART_PLACES", 400), ("PART_KEYS", keys)):
        monkeypatch.setattr(phrases, name, value)
    rows = [*phrase_rows(), (12, "de", "so so far " * 350), (13, "de", "so far off, " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    tables = len(spark.catalog.listTables())
    got = phrases.collocations(df, 4, least, 50)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, least, 50)
    assert phrases.collocations(df.limit(0), 4, least, 50).collect() == []
    assert len(spark.catalog.listTables()) == tables


def test_rare_phrases_of_frequent_words_shuffle_few_bytes(spark, tmp_path, monkeypatch):
    """Most pairs of frequent words are rare: each takes some bytes in a slice, not a spelled row; place lists stay where they are."""
    monkeypatch.setattr(phrases, "SLICE_PLACES", 20_000)
    rng = np.random.default_rng(9)
    texts = [" ".join(f"frequent{w}" for w in rng.integers(0, 150, 1000)) for _ in range(80)]
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    every = phrases.frequent_phrases(df, 2, 100)[0].collect()
    assert sorted({r.k for r in every}) == [1] and len(every) == 150
    assert shuffled() - before < 6 * 80_000  # bytes a word


def test_places_round_trip():
    rng = np.random.default_rng(2)
    for most in (2, 200, 10**5, 2**31 - 1):
        x = rng.integers(0, most, 3000)
        assert (phrases.unpacked(phrases.packed(x)) == x).all()
    assert len(phrases.unpacked(phrases.packed(np.empty(0, np.int64)))) == 0


@pytest.mark.parametrize(("k", "num"), [(5, 85), (2, 50)])
def test_chosen_paths_are_brute_force(docs, k, num):  # noqa: F811
    want = brute_components(list(enumerate(fixture_texts())), k, num, 100)
    got = chosenpath.near_duplicates(docs, k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chosen_paths_through_all_levels(spark, monkeypatch):
    """Tree nodes branch from three members on, dense ones are compared in small blocks."""
    for name, value in (("SMALL", 2), ("SKETCH_BLOCK", 900), ("SET_BLOCK", 500)):
        monkeypatch.setattr(chosenpath, name, value)
    rng = random.Random(8)
    passage, base = prose(rng, 60), prose(rng, 120)
    texts = [" ".join(prose(rng, 40) + passage) for _ in range(30)]  # far from each other, but for a passage
    for _ in range(25):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(df, 5, 85, 100).collect()}
    assert got == brute_components(list(enumerate(texts)), 5, 85, 100)


def test_recall_of_the_trees():
    """Pairs at the threshold meet in a tree about as often as ``survival`` says at least."""
    rng, met, pairs = np.random.default_rng(3), 0, 400
    for _ in range(pairs):
        sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (340, 30, 30)]
        a, b = (np.unique(np.concatenate([sets[0], s])) for s in sets[1:])
        met += int(chosenpath.minwise(a, 1)[0] == chosenpath.minwise(b, 1)[0])
    assert abs(met / pairs - 0.85) < 0.07
    assert chosenpath.survival(85, 100) > 0.8 and chosenpath.trees_for(1 - 1e-9, 85, 100) <= 12


def test_ids_that_repeat_or_are_null(spark):
    base = " ".join(prose(random.Random(5), 50))
    rows = [(1, base), (1, "other words entirely here now"), (None, base), (None, "alone with a null id"), (2, base + " x"), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosenpath.near_duplicates(df, 5, 85, 100).collect()), key=str)
    want = sorted([(1, 46, 1, True), (1, 1, 1, True), (None, 46, 1, False), (None, 1, None, False), (2, 47, 1, False), (3, 0, 3, True), (None, 0, None, False)], key=str)
    assert got == want
    left = chosenpath.one_of_each(df.withColumn("node", F.lit(1)), 5, 85, 100)
    assert left.columns == ["doc_id", "text", "node"] and left.count() == 5
    assert chosenpath.near_duplicates(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(1_500_000)]
    long = " ".join(words)  # about 9 MB
    near = " ".join([*words[:700_000], "edit", *words[700_001:]])
    df = spark.createDataFrame([(0, "en", long), (1, "en", near), (2, "en", "short text")], "doc_id long, lang string, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in chosenpath.near_duplicates(df, 5, 85, 100).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    total = phrases.frequent_phrases(df, 1, 100)[1].collect()
    assert [(r.lang, r.n) for r in total] == [("en", 3_000_002)]


@pytest.mark.parametrize("name", ["op11_ball_tree", "op12_phrase_collocations"])
def test_queries_match_their_sql(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())


def test_chosen_path_query_finds_what_the_sketch_join_finds(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), 5, 85, 100).collect()}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op13_chosen_path(spark, sf).collect()} == want
