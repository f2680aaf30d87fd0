"""Operators across documents: similarity join, substring dedup, search, links, the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import anchors, graph, jaccard, queries, rlz, suffix, urlrank, voronoi

SF = "/root/testdata/sf0.001"
WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch marsh north ocean pines quarry ridge shore thorn upland vale willow yarrow zenith".split()


def prose(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)]


def fixture_texts(seed=1):
    """Copies, near copies of all degrees, shared passages, repeats inside a text, and edge cases."""
    rng, texts = random.Random(seed), []
    base, passage, other = prose(rng, 160), prose(rng, 45), prose(rng, 90)
    for edits in (0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for k in range(8):
        texts.append(" ".join(prose(rng, rng.randrange(0, 60)) + passage + prose(rng, rng.randrange(0, 60))))
    texts += [" ".join(other + other[:40]), " ".join(other), "same words " * 60, "é" * 300, "xy" * 250]
    texts += [" ".join(prose(rng, n)) for n in (1, 2, 3, 4, 5, 7, 11, 15, 30)]
    texts += ["one two three", "ONE two Three", "one two three four", "", " \n", None, "a b c d e f g h", "a b c d e f g i"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(fixture_texts()))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit(7) for c in ("key", "node", "root", "spans", "component_id", "n_shingles", "lo", "hi")})


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, k, num, den):
    sets, root = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_components_are_brute_force(docs, k, num, den):
    want = brute_components(list(enumerate(fixture_texts())), k, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, k, num, den).collect()}
    assert got == want


def test_components_from_many_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", 700)
    monkeypatch.setattr(jaccard, "SET_BLOCK", 300)
    want = brute_components(list(enumerate(fixture_texts())), 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, 4, 85, 100).collect()} == want


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[5:], rng.integers(0, 2**63, 9).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard.whole_sketch(s), np.uint64) for s in (a, b))
        width = min(len(x), len(y))
        assert np.bitwise_count(jaccard.folded(x, width) ^ jaccard.folded(y, width)).sum() <= len(np.setxor1d(a, b))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 400), st.integers(0, 50), st.integers(0, 50), st.integers(0, 10**6), st.sampled_from([50, 80, 85]))
def test_similar_sets_share_a_key(n, gone, new, seed, num):
    rng, threshold = np.random.default_rng(seed), jaccard.Threshold(num, 100)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[min(gone, len(a) - 1) :], rng.integers(0, 2**63, new).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    if 100 * common >= num * (len(a) + len(b) - common):
        assert set(jaccard.chunk_keys(a, threshold).tolist()) & set(jaccard.chunk_keys(b, threshold).tolist())


@pytest.mark.parametrize("n", [6, 12, 50, 100])
def test_no_key_is_common_to_unrelated_sets(n):
    rng, threshold, seen = np.random.default_rng(n), jaccard.Threshold(85, 100), Counter()
    for _ in range(10_000):
        seen.update(set(jaccard.chunk_keys(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), threshold).tolist()))
    assert seen.most_common(1)[0][1] <= 3


def test_bands_reach_every_similar_size():
    for num in (50, 60, 85):
        threshold = jaccard.Threshold(num, 100)
        for small in range(1, 120):
            for large in range(small, small * 100 // num + 1):
                assert set(threshold.bands(small)) & set(threshold.bands(large))


def test_join_edges(spark, docs):
    schema = "doc_id long, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "q r s t u v w"), (2, "other words entirely are here now ok"), (None, "only null ids have this one text")]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter({(1, 1): 2, (None, 1): 1, (2, 2): 2, (None, None): 1})
    near = " ".join(prose(random.Random(4), 120)).split()
    chain = [(7, " ".join(near)), (None, " ".join(near[6:])), (9, " ".join(near[12:])), (3, "b"), (None, None)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(chain, schema), 5, 90, 100).collect())
    assert got == Counter({(7, 7): 1, (None, 7): 1, (9, 7): 1, (3, 3): 1, (None, None): 1})
    kept = jaccard.one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.text for r in kept) == Counter({t: 1 for _, t in rows})
    one = jaccard.one_of_each(docs, 5, 80, 100)
    want = [i for i, (n, c) in brute_components(list(enumerate(fixture_texts())), 5, 80, 100).items() if i == c]
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(want)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (None, 4)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bytes(rows, size=200):
    counts = Counter(b[s : s + size] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - size + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if counts[b[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


def removed(df):
    return Counter((r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("most", [anchors.MOST_SEGMENTS, 1])
def test_repeated_bytes_are_brute_force(docs, most):
    """``most`` 1 sends every open anchor the way of crowded ones."""
    assert removed(suffix.dedup(docs, most=most)) == brute_bytes(list(enumerate(fixture_texts())))


def brute_words(rows, size=20):
    seen, out = set(), []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = bytearray(len(words))
        for s in range(len(words) - size + 1):
            w = tuple(words[s : s + size])
            if w in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(w)
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("most", [anchors.MOST_SEGMENTS, 1])
def test_earlier_words_are_brute_force(docs, most):
    got = Counter((r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), r.kept) for r in rlz.dedup(docs, most=most).collect())
    assert got == brute_words(list(enumerate(fixture_texts())))


def test_dedup_edges(spark, docs):
    schema, long = "doc_id long, text string", " ".join(prose(random.Random(5), 60))
    rows = [(3, long), (3, long), (None, long), (3, None), (1, "short")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    df = spark.createDataFrame(rows, schema)
    assert removed(suffix.dedup(df)) == brute_bytes(ordered)
    got = Counter((r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), r.kept) for r in rlz.dedup(df).collect())
    assert got == brute_words(ordered)
    empty = spark.createDataFrame([], schema)
    assert suffix.dedup(empty).count() == rlz.dedup(empty).count() == 0
    left = suffix.deduped_documents(docs)
    want = {i: kept.decode(errors="ignore") for i, n, k, _, kept in brute_bytes(list(enumerate(fixture_texts())))if not k or kept.strip()}
    assert left.columns == docs.columns
    assert {r.doc_id: r.text or "" for r in left.collect()} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=8), st.integers(1, 2)), min_size=1, max_size=9))
def test_interval_tree_finds_maximal_groups(parts):
    """The groups are the maximal repeats around the gram, each with all its members."""
    length, before, after, copies = 9, [a.encode() for a, *_ in parts], [b"gg" + b.encode() for _, b, _ in parts], [n for *_, n in parts]
    share = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    got = Counter((tuple(sorted(m.tolist())), left, right) for m, left, right in suffix.maximal_repeats([1] * len(parts), before, after, copies, length, 6))
    want = Counter(((i,), len(before[i]), len(after[i])) for i, n in enumerate(copies) if n > 1)
    strings = set()
    for i in range(len(parts)):
        for j in range(i):
            strings.add((before[i][: share(before[i], before[j])], after[i][: min(length, share(after[i], after[j]))]))
    for left, right in strings:
        members = tuple(k for k in range(len(parts)) if before[k].startswith(left) and after[k].startswith(right))
        wide = min(share(before[a], before[b]) for a in members for b in members if a != b), min(length, min(share(after[a], after[b]) for a in members for b in members if a != b))
        if len(left) + len(right) >= length and wide == (len(left), len(right)):
            want[members, len(left), len(right)] = 1
    assert got == want
    left, right = suffix.shared_extents(suffix.maximal_repeats([1] * len(parts), before, after, copies, length, 6), len(parts))
    for i in range(len(parts)):
        good = [(a, b) for (m, a, b) in want if i in m]
        assert (left[i], right[i]) == ((max(a for a, _ in good), max(b for _, b in good)) if good else (0, 0))


@pytest.mark.parametrize("most", [anchors.MOST_SEGMENTS, 1])
def test_repeat_groups_list_repeats_with_all_occurrences(docs, most):
    rows = list(enumerate(fixture_texts()))
    data = {i: (t or "").encode() for i, t in rows}
    groups, seen = defaultdict(list), Counter()
    for r in suffix.repeat_groups(docs, most=most).collect():
        groups[r.group_id].append(r)
    covered = {i: set() for i in data}
    for members in groups.values():
        strings = {data[r.doc_id][r.lo : r.hi] for r in members}
        assert len(strings) == 1 and sum(r.copies for r in members) > 1 and len(strings.pop()) >= suffix.LENGTH
        seen.update((r.doc_id, r.lo, r.hi) for r in members)
        for r in members:
            covered[r.doc_id].update(range(r.lo, r.hi))
    # occurrences that the groups name cover every repeated string's first place at least
    counts, first = Counter(), {}
    for i, b in sorted(data.items()):
        for at in range(len(b) - 199):
            counts[b[at : at + 200]] += 1
            first.setdefault(b[at : at + 200], (i, at))
    assert all(set(range(at, at + 200)) <= covered[i] for w, (i, at) in first.items() if counts[w] > 1)


def brute_longest(parts, least):
    """For each place: the longest match with any earlier place."""
    out = {}
    for p, x in enumerate(parts):
        for i in range(len(x)):
            best = 0
            for q, y in enumerate(parts[: p + 1]):
                for j in range(len(y) if q < p else i):
                    k = 0
                    while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                        k += 1
                    best = max(best, k)
            if best >= least:
                out[p, i] = best
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=6))
def test_reference_block_finds_the_longest_earlier_match(texts):
    parts = [np.array([ord(c) for c in t], np.uint64) for t in texts]
    block = rlz.ReferenceBlock(parts)
    at, size, source = block.earlier(3)
    own = {int(s): (p, 0) for p, s in enumerate(block.starts)}
    assert sorted(own) == block.starts.tolist()
    owner = np.searchsorted(block.starts, at, "right") - 1
    assert {(int(p), int(a - block.starts[p])): int(n) for p, a, n in zip(owner, at, size, strict=True)} == brute_longest(texts, 3)
    assert (source < at).all()
    for p, factors in enumerate(block.factors(3)):
        for a, b, q, j in factors:
            assert (q, j) < (p, a) and texts[p][a:b] == texts[q][j : j + b - a]
        windows = {i for (x, s), n in brute_longest(texts, 3).items() if x == p for i in range(s, s + n)}
        assert {i for a, b, *_ in factors for i in range(a, b)} == windows


def test_factors_take_the_longest_of_all_places():
    numbers = lambda s: np.array([ord(c) for c in s], np.uint64)
    block = rlz.ReferenceBlock([numbers(s) for s in ("abcdX", "abcdefgh", "abcdefgh", "cdefghab")])
    assert block.factors(4) == [[], [(0, 4, 0, 0)], [(0, 8, 1, 0)], [(0, 6, 1, 2)]]


def test_parsing_resumes_at_a_factor_boundary():
    """A match across the end of the farthest one is still found; continued matches are one."""
    matches = [(0, 30, 1, 100), (15, 36, 2, 0), (20, 45, 1, 120), (60, 80, 3, 5), (80, 101, 3, 25)]
    assert rlz.parsed(matches, 100) == [(0, 45, 1, 100), (60, 100, 3, 5)]
    assert rlz.parsed([(0, 25, 1, 0), (10, 40, 2, 0)], 90) == [(0, 25, 1, 0), (10, 40, 2, 0)]
    assert rlz.parsed([], 9) == []


def test_documents_are_parsed_whole(docs):
    """Factors are as long as whole copies, lie in order, and hold what their sources hold."""
    rows = list(enumerate(fixture_texts()))
    words = {i: (t or "").encode().split() for i, t in rows}
    parses = {r.doc_id: r.factors for r in rlz.dedup(docs).collect()}
    for i, factors in parses.items():
        assert all(a.lo < b.lo and a.hi < b.hi for a, b in zip(factors, factors[1:], strict=False))
        for f in factors:
            assert (f.src_key, f.src_lo) < (i, f.lo) and words[i][f.lo : f.hi] == words[f.src_key][f.src_lo : f.src_lo + f.hi - f.lo]
    assert [(f.lo, f.hi) for f in parses[1]] == [(0, 160)]


def test_queries_go_through_their_methods(docs, monkeypatch):
    """Without its index or its tree, an operator finds less."""
    rows, nothing = list(enumerate(fixture_texts())), lambda pdf: pdf[["key", "lo"]].iloc[:0].assign(hi=0, src_key=0, src_lo=0)
    monkeypatch.setattr(rlz, "compare_segments", nothing)
    assert sum(s.hi - s.lo for r in rlz.dedup(docs).collect() for s in r.spans) < sum(row[2] * n for row, n in brute_words(rows).items())
    monkeypatch.setattr(suffix, "compare_segments", nothing)
    assert sum(s.hi - s.lo for r in suffix.dedup(docs).collect() for s in r.spans) < sum(row[2] * n for row, n in brute_bytes(rows).items())


def test_anchors_of_texts_longer_than_what_is_ranked_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 3, 3000).astype(np.uint64)
    hashes = anchors.RangeHash(symbols)
    want = rlz.WINDOWS.anchors(hashes)
    monkeypatch.setattr(anchors, "RANKED", 37)
    got = rlz.WINDOWS.anchors(hashes)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def brute_top(rows, k, every):
    ints = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
        best = sorted(((-dot(ints[q], v), i) for i, v in ints.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "CELL_ROWS", 50)
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] * (1 + i % 3) + 0.05 * rng.standard_normal(8))]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # ties of a hot vector
    rows += [(2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (2040, []), (2050, [1.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "score": F.lit(2), "v": F.lit(3)}).repartition(6)
    got = voronoi.top_k(df, lambda i: i % 10 == 0, 5, 256, pivots=7)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 10)
    assert sorted(map(tuple, voronoi.top_k(df.filter("vec_id < 3"), lambda i: i % 2 == 0, 5, 256).collect())) == brute_top(rows[:3], 5, 2)
    assert voronoi.top_k(df.limit(0), lambda i: i % 2 == 0, 5, 256).count() == 0


def test_groups_are_left_out():
    rng = np.random.default_rng(7)
    pivots = 100 * np.eye(12)
    needed, out = voronoi.needed_groups(pivots[:1] + rng.standard_normal((3, 12)), pivots, np.full(12, 2.0), np.full(12, 20), 5)
    assert needed[:, 0].all() and needed.sum() < 12


def test_groups_of_a_repeated_query_id_are_kept():
    pivots, radius, size = np.array([[10.0, 0.0], [1.0, 0.0]]), np.zeros(2), np.array([6, 50])
    q = np.array([[10.0, 0.0]])
    assert voronoi.needed_groups(q, pivots, radius, size, 5)[0].tolist() == [[True, False]]
    assert voronoi.needed_groups(np.repeat(q, 3, 0), pivots, radius, size, 5, np.array([1, 2, 52]))[0].tolist() == [[True, False], [True, True], [True, True]]


def test_top_k_with_repeated_ids_is_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [40.0, 0.0])] * 8 + [(10, [0.0, 40.0])] * 2 + [(i, [0.0, 40.0]) for i in (11, 12, 13, 14)]
    rows += [(100 + i, [float(x) for x in rng.integers(1, 6, 2)]) for i in range(50)] + [(101, [3.0, 3.0])] * 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q in {i for i, _ in rows if i % 10 == 0}:
        own = min(np.array(v).tobytes() for i, v in rows if i == q)
        best = sorted((-int(256 * 256 * np.dot(np.frombuffer(own), v)), i) for i, v in rows if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for pivots in (3, 7, 60):
        got = voronoi.top_k(df, lambda i: i % 10 == 0, 5, 256, pivots=pivots)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def brute_ranks(seeds, edges, rounds, damping):
    out = {}
    for kind in {k for k, *_ in seeds}:
        seed = {h: s for k, h, s in seeds if k == kind}
        links = defaultdict(list)
        for k, a, b, share in edges:
            if k == kind:
                links[a].append((b, share))
        rank = dict(seed)
        for _ in range(rounds):
            new, rest = defaultdict(float), sum(s for h, s in rank.items() if h not in links)
            for h, s in rank.items():
                for to, share in links.get(h, ()):
                    new[to] += damping * s * share
            for h, s in seed.items():
                new[h] += s * (1 - damping + damping * rest)
            rank = dict(new)
        out |= {(kind, h): s for h, s in rank.items()}
    return out


def test_propagation_is_brute_force(spark):
    rng, hosts = random.Random(8), [f"h{i}" for i in range(12)]
    pairs = {(rng.choice(hosts), rng.choice(hosts)) for _ in range(30)}
    edges = [(k, a, b, 1 / sum(x == a for x, _ in pairs)) for k in ("trust", "distrust") for a, b in pairs]
    seeds = [("trust", "h0", 0.5), ("trust", "h1", 0.5), ("distrust", "h2", 1.0)]
    got = urlrank.propagate(spark.createDataFrame(seeds, "kind string, host string, seed double"), spark.createDataFrame(edges, "kind string, src string, dst string, share double"), rounds=10)
    want = brute_ranks(seeds, edges, 10, urlrank.DAMPING)
    assert {(r.kind, r.host): pytest.approx(r.score) for r in got.collect()} == want


def test_propagation_goes_on_until_it_settles(spark):
    edges = [("trust", f"h{i}", f"h{i + 1}", 1.0) for i in range(24)]
    seeds = [("trust", "h0", 1.0)]
    got = urlrank.propagate(spark.createDataFrame(seeds, "kind string, host string, seed double"), spark.createDataFrame(edges, "kind string, src string, dst string, share double"))
    want = brute_ranks(seeds, edges, 400, urlrank.DAMPING)
    assert {(r.kind, r.host): pytest.approx(r.score, abs=1e-6) for r in got.collect()} == want


def test_links_carry_distrust_and_trust(spark):
    link = lambda *to: " ".join(f'<a href="https://{t}/x">x</a>' for t in to)
    pages = [(1, "https://bad.org/es/1", ""), (2, "http://feeds-bad.site/a", link("bad.org", "bad.org")), (3, "http://fine.site/a", link("good.net")), (4, "https://good.net/de/1", link("near.site")), (5, "http://NEAR.site/q?x#y", None)]
    pages += [(6, None, None), (7, "no scheme", ""), (7, "no scheme", ""), (8, "https:///only/path", ""), (9, "x://sub.example.com/en/77", ""), (10, "x://example.com/en/8?a", ""), (11, "x://com/en/", ""), (12, "x://notcom/en/", ""), (13, "x://a.example.net/de/81", ""), (14, "x://a.example.net/de/7", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "rule": F.lit(0), "trust": F.lit(0)})
    rows = urlrank.judge(df, queries.URL_RULES, threshold=1.5).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(pages) and (by[6].host, by[6].path, by[6].rule, by[6].verdict) == ("", "", None, "allow")
    assert (by[5].host, by[5].path) == ("near.site", "/q") and by[5].trust > 0 and by[5].verdict == "allow"
    assert by[2].distrust > 1.5 and by[2].verdict == "block" and by[3].verdict == "allow"
    assert [(by[i].rule, by[i].verdict) for i in (1, 9, 10, 11, 12, 13, 14)] == [("org/es/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "allow")]
    assert urlrank.judge(df.limit(0), queries.URL_RULES).count() == 0


def brute_judged(pages, rules, threshold):
    """Verdicts of (page_id, url, html) rows from plain dictionaries, iterated until nothing moves."""
    parts = []
    for _, url, html in pages:
        found = re.search("://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
        hits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        parts.append((host, path, max(hits, key=lambda r: len(r.text), default=None), html or ""))
    pages_of, links = Counter(h for h, *_ in parts if h), Counter()
    for host, _, _, html in parts:
        targets = set()
        for link in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?([^"'>\s]+)""", html):
            far = re.match("(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", link)
            if far:
                targets.add(far[1].lower())
            elif not re.match("[A-Za-z][A-Za-z0-9+.-]*:|#|//", link):
                targets.add(host)
        if host:
            links.update((host, t) for t in targets)
    scores = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        seed = Counter(h for h, _, r, _ in parts if h and r and r.verdict == verdict)
        total = sum(seed.values())
        edges = [((a, b) if kind == "trust" else (b, a), n) for (a, b), n in links.items()]
        out = Counter()
        for (a, _), n in edges:
            out[a] += n
        got = brute_ranks([(kind, h, n / total) for h, n in seed.items()], [(kind, a, b, n / out[a]) for (a, b), n in edges], 200, urlrank.DAMPING) if total else {}
        scores[kind] = {h: got.get((kind, h), 0.0) / (n / sum(pages_of.values())) for h, n in pages_of.items()}
    rows = {}
    for (i, *_), (host, path, rule, _) in zip(pages, parts, strict=True):
        t, d = scores["trust"].get(host, 0.0), scores["distrust"].get(host, 0.0)
        rows[i] = (host, path, rule.text if rule else None, rule.verdict if rule else "block" if d >= threshold and d > t else "allow", pytest.approx(t, abs=1e-4), pytest.approx(d, abs=1e-4))
    return rows


def judged_rows(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.trust, r.distrust) for r in df.collect()}


def test_url_query_is_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert judged_rows(queries.QUERIES["op7_link_graph"](spark, SF)) == brute_judged(pages, queries.URL_RULES, urlrank.THRESHOLD)


def test_linked_pages_are_judged_by_brute_force(spark):
    rng, pages = random.Random(12), []
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org', 'site'])}" for i in range(25)]
    for i in range(160):
        host = rng.choice(hosts[: 1 + rng.randrange(25)])
        links = [rng.choice([f"https://{rng.choice(hosts)}/x", f"//{rng.choice(hosts).upper()}/y", "/same", "next.html", "mailto:a@b.c", "#top", "javascript:void(0)"]) for _ in range(rng.randrange(6))]
        pages.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.randrange(99)}?q", " ".join(f'<a href="{x}">' for x in links)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    for threshold in (1.0, 2.0):
        assert judged_rows(urlrank.judge(df, queries.URL_RULES, threshold)) == brute_judged(pages, queries.URL_RULES, threshold)


def test_url_query_goes_through_propagation(spark, monkeypatch):
    called, method = [], urlrank.propagate
    monkeypatch.setattr(urlrank, "propagate", lambda *a, **k: called.append(a[1].count()) or method(*a, **k))
    queries.QUERIES["op7_link_graph"](spark, SF).count()
    assert len(called) == 1 and called[0] > 0


def test_bounds_leave_groups_and_rows_out():
    """On clustered vectors most groups, and of the others the rows near the pivot, are not needed."""
    rng = np.random.default_rng(3)
    pivots = np.round(100 * rng.standard_normal((40, 16)))
    rows = [p + np.round(2 * rng.standard_normal((200, 16))) for p in pivots]
    distances = [np.sort(np.sqrt(((x - p) ** 2).sum(1))) for x, p in zip(rows, pivots, strict=True)]
    radius, size, nearest = np.array([d[-1] for d in distances]), np.array([200] * 40), np.array([d[:6] for d in distances])
    q = np.concatenate([x[:3] for x in rows])
    wide, _ = voronoi.needed_groups(q, pivots, radius, size, 5)
    tight, out = voronoi.needed_groups(q, pivots, radius, size, 5, 1, nearest)
    assert tight.mean() < 0.2 and tight.sum() <= wide.sum() and (tight <= wide).all()
    scores = np.concatenate(rows) @ q.T
    for i in range(len(q)):
        best = np.sort(scores[:, i])[-6]
        for g in np.flatnonzero([(x @ q[i] >= best).any() for x in rows]):
            near = rows[g][rows[g] @ q[i] >= best]
            assert tight[i, g] and (np.sqrt(((near - pivots[g]) ** 2).sum(1)) >= out[i, g] - 1e-6).all()


def brute_pipeline(rows):
    """The stages on plain lists: rows are (doc_id, text, lang, source)."""
    from palimpsest.llm import secrets
    from tests.llm.test_tokens import brute_verdict

    rows = [r for r in rows if brute_verdict(r[1], r[2])[-1]]
    first = {i for i, (_, c) in brute_components([(i, t) for i, t, *_ in rows], 5, 80, 100).items() if i == c}
    rows = [r for r in rows if r[0] in first]
    kept = {i: b.decode(errors="ignore") for i, n, k, _, b in brute_bytes([(i, t) for i, t, *_ in rows]) if not k or b.strip()}
    vocabulary = P.path("byte_bpe_50k.tiktoken")
    forest, words = secrets.default_forest(vocabulary), secrets.lexicon(vocabulary)
    return {i: secrets.findings_of(kept[i], source, forest, words, secrets.THRESHOLD)[2] for i, _, _, source in rows if i in kept}


def test_pipeline_is_brute_force(spark):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_pipeline(sorted((r.doc_id, r.text, r.lang, r.source) for r in table.collect()))
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == table.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r.doc_id: r.text for r in docs.collect()} == want and docs.filter("n_chars <> length(text)").isEmpty()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    totals = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    packed = corpus_pipeline.run(spark, SF).collect()
    got = defaultdict(int)
    for r in packed:
        got[r.doc_id] += r.length
    assert dict(got) == totals
    assert max(Counter({s: sum(r.length for r in packed if r.sequence_id == s) for s in {r.sequence_id for r in packed}}).values()) <= 2048


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_top_k_query_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op6_voronoi_top_k"]).fetchall()
    got = queries.QUERIES["op6_voronoi_top_k"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_digest_queries(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, n, k, r, hashlib.sha256(b).hexdigest()) for i, n, k, r, b in brute_bytes(sorted(texts.items()))}
    got = queries.QUERIES["op10_suffix_array"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert set(map(tuple, got.collect())) == want
    want = {(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_words(sorted(texts.items()))}
    assert set(map(tuple, queries.QUERIES["op3_relative_lz"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want
    want = {(i, n, c) for i, (n, c) in brute_components(sorted(texts.items()), 4, 85, 100).items()}
    assert set(map(tuple, queries.QUERIES["op9_parity_sketch_join"](spark, SF).collect())) == want
