import io
import json
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.functions import messages as M
from palimpsest.functions import stats
from palimpsest.operators import metrics as A
from palimpsest.operators import phases, reports, runs, runtimes
from palimpsest.operators import sampling as S
from palimpsest.operators import stitching as K
from palimpsest.operators.common import row_index
from palimpsest.operators.compactors import RecentMessages
from palimpsest.operators.evaluation import contexts, facts
from palimpsest.operators.extraction import extraction_stats
from palimpsest.sources import adapters, readers, writers
from palimpsest.streaming.extraction import extract_stream, windowed_counts

SF = "/root/testdata/sf0.001"


def exact_p(gains, losses):
    n, k = gains + losses, min(gains, losses)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


@pytest.mark.parametrize(("gains", "losses"), [(0, 0), (1, 0), (5, 5), (3, 12), (1, 700), (40, 22)])
def test_mcnemar_is_exact(spark, gains, losses):
    got = spark.range(1).select(stats.mcnemar_exact(F.lit(gains), F.lit(losses)).alias("p")).first().p
    assert got == pytest.approx(exact_p(gains, losses), rel=1e-9)


def test_kappa_edges(spark):
    rows = spark.createDataFrame([(True, True), (True, True), (None, False)], "a boolean, b boolean")
    got = A.agreement_by(rows, "a", "b").first()
    assert (got.n, got.kappa, got.p_value) == (2, 1.0, 1.0)
    assert A.agreement_by(rows.filter("a is null"), "a", "b").first().kappa is None


def test_effect_retention_has_no_value_without_an_effect(spark):
    one = spark.range(1)
    assert one.select(stats.effect_retention(F.lit(0.5), F.lit(0.3), F.lit(0.3)).alias("x")).first().x is None
    assert one.select(stats.effect_retention(F.lit(0.9), F.lit(0.3), F.lit(0.9)).alias("x")).first().x == pytest.approx(1.0)


def test_cluster_interval_resembles_numpy_and_ignores_partitions(spark):
    v = np.random.default_rng(0).random(200)
    rows = spark.createDataFrame([("g", i, float(x), 1.0) for i, x in enumerate(v)], "k string, slot long, v double, w double")
    a = stats.cluster_interval(rows.repartition(7), ["k"], "v", "w", 400).first()
    assert a == stats.cluster_interval(rows.coalesce(1), ["k"], "v", "w", 400).first()
    half = 1.96 * v.std() / math.sqrt(200)
    assert a.n == 200 and a.low == pytest.approx(v.mean() - half, abs=0.02) and a.high == pytest.approx(v.mean() + half, abs=0.02)
    single = stats.cluster_interval(rows.limit(1), ["k"], "v", "w", 10).first()
    assert single["low"] == single["high"] == pytest.approx(single["mean"], abs=1e-9)


def test_cluster_interval_pools_strata(spark):
    """A replicate adds the sums of all strata; each keeps its number of clusters."""
    rows = [("a", i, 0.0, 1.0) for i in range(30)] + [("b", i, 6.0, 2.0) for i in range(10)]
    out = stats.cluster_interval(spark.createDataFrame(rows, "k string, slot long, v double, w double"), ["k"], "v", "w", 50).first()
    assert (out.n, out["mean"], out.low, out.high) == (40, 1.2, 1.2, 1.2)


def test_few_valued_interval_resembles_resampling(spark):
    rng = np.random.default_rng(5)
    v = rng.choice([-1, 0, 1], 300, p=[0.2, 0.5, 0.3])
    rows = spark.createDataFrame([("g", int(x)) for x in v] + [("g", None), ("one", 1), ("same", 0), ("same", 0)], "k string, v int")
    got = {r.k: r for r in stats.few_valued_interval(rows, ["k"], "v", (-1, 0, 1), 2000).collect()}
    means = np.array([rng.choice(v, len(v)).mean() for _ in range(4000)])
    assert got["g"].n == 300 and got["g"]["mean"] == pytest.approx(v.mean(), abs=1e-9)
    assert (got["g"].low, got["g"].high) == (pytest.approx(np.quantile(means, 0.025), abs=0.01), pytest.approx(np.quantile(means, 0.975), abs=0.01))
    assert (got["one"].low, got["one"].high, got["same"].low, got["same"].high) == (1, 1, 0, 0)
    assert stats.few_valued_interval(rows.filter("v is null"), ["k"], "v", (0, 1), 20).count() == 0
    with pytest.raises(Exception, match="value not listed"):
        stats.few_valued_interval(rows, ["k"], "v", (0, 1), 20).collect()


def test_binomial_tables_are_the_distribution(spark):
    cases = [(1, 0.5), (7, 0.01), (40, 0.3), (3000, 0.9), (100_000, 0.5)]
    df = spark.createDataFrame([("g", n, p) for n, p in cases], "k string, size long, p double")
    for r in stats.binomial_tables(df, ["k", "size"]).collect():
        p, cdf = dict(cases)[r["size"]], np.array(r.cdf)
        terms = [math.exp(math.lgamma(r["size"] + 1) - math.lgamma(x + 1) - math.lgamma(r["size"] - x + 1) + x * math.log(p) + (r["size"] - x) * math.log(1 - p)) for x in range(r["size"] + 1)]
        assert np.abs(cdf - np.cumsum(terms)[r.low : r.low + len(cdf)]).max() < 1e-8 and len(cdf) < 60 + 25 * math.sqrt(r["size"])


def test_decomposition_adds_up(spark):
    parts = A.decomposition(A.four_groups(facts(spark, SF)))
    assert parts.filter("not identity_check").isEmpty() and parts.count() == 12


def test_equal_runs_are_stable(spark):
    rows = facts(spark, SF).filter("position = 'top' and repeat = 1 and explicit and hard")
    twice = rows.unionByName(rows.withColumn("position", F.lit("middle")))
    summary = A.stability_summary(A.stability_pairs(twice)).filter("comparison = 'middle'")
    assert summary.filter("n_disagree > 0 or not consistent").isEmpty()


def test_row_index_is_dense_in_any_partitioning(spark):
    ids = list(range(0, 500, 7))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(9)
    assert [(r.id, r.n) for r in row_index(df, ["id"], "n").orderBy("id").collect()] == [(i, k) for k, i in enumerate(sorted(ids))]


def brute_concat(lengths, target):
    out, cur = [], []
    for n in lengths:
        cur.append(n)
        if sum(cur) >= target:
            while cur and sum(cur) > target / 0.8:
                cur.pop()
            out.append(sum(cur))
            cur = []
    return out


def test_concatenation(spark):
    talks = spark.createDataFrame([(i, [Row(role="user", content="w " * n)]) for i, n in enumerate([5, 5, 40, 3, 9, 1])], f"conv_id long, messages {M.MESSAGES}")
    rows = K.concatenated(talks, 10).orderBy("source_row_index").collect()
    assert [r.token_length for r in rows] == brute_concat([7, 7, 42, 5, 11, 3], 10)
    assert any(r.is_empty for r in rows)
    kept = K.concatenated(talks, 10).filter("not is_empty")
    made = K.stitched_messages(kept, talks).join(kept, "source_row_index")
    assert made.filter(M.total_tokens(F.col("messages")) != F.col("token_length")).isEmpty() and made.count() == kept.count()


def test_topic_rows_use_each_context_once(spark):
    lengths = contexts(spark, SF).withColumn("token_length", M.total_tokens(F.col("messages")))
    for pool in (None, "label"):
        rows = K.topic_cohesive(lengths, spark.read.parquet(f"{SF}/embeddings.parquet"), 300, pool=pool).collect()
        used = [i for r in rows for i in r.sources]
        assert rows and len(used) == len(set(used))


def test_cohesive_pool_takes_the_nearest():
    v = np.array([[1, 0], [0, 1], [0.9, 0.1], [0.8, 0.2]], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert K.cohesive_pool(np.array([0, 1, 2, 3]), v, np.array([5, 5, 5, 5]), 10) == [([0, 2], 10), ([1, 3], 10)]
    # a later row without its system message is shorter, so another is taken, which is too much and given back
    assert K.cohesive_pool(np.array([0, 1, 2, 3]), v, np.array([5, 5, 5, 5]), 10, np.array([4, 4, 4, 4])) == [([0, 2], 9)]


def test_cohesive_pool_makes_so_many_rows_or_fails():
    v, n = np.eye(4), np.array([5, 5, 5, 3])
    assert K.cohesive_pool(np.arange(4), v, n, 10, rows=1) == [([0, 1], 10)]
    assert len(K.cohesive_pool(np.arange(4), v, n, 10)) == 1
    with pytest.raises(K.Unfilled, match="8 of 10 tokens; 1 of 2 rows"):
        K.cohesive_pool(np.arange(4), v, n, 10, rows=2)
    with pytest.raises(K.Unfilled, match="used up"):
        K.cohesive_pool(np.arange(4), v, np.array([5, 5, 5, 5]), 10, rows=3)


def plain_cohesive(vectors, lengths, later, target):
    """The stated steps on plain lists, every free row looked at in each."""
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    free, out = set(range(len(vectors))), []
    while free:
        taken = [min(free)]
        free -= set(taken)
        size = lambda: int(lengths[taken[0]] + sum(later[taken[1:]]))
        while size() < target and free:
            centre = vectors[taken].mean(0)
            rows = np.array(sorted(free))
            taken.append(int(rows[np.argmax(np.round(vectors[rows] @ (centre / max(np.linalg.norm(centre), 1e-12)), 9))]))
            free.remove(taken[-1])
        if size() < target:
            return out
        while len(taken) > 1 and size() > target / K.SLACK:
            free.add(taken.pop())
        out.append((list(taken), size()))


def test_topic_rows_of_a_large_dataset_are_the_plain_ones(spark):
    rng = np.random.default_rng(9)
    x, n = np.round(rng.standard_normal((5200, 4)), 2), rng.integers(1, 300, 5200)
    m = np.maximum(0, n - rng.integers(0, 30, 5200))
    vectors = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    lengths = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(n, m, strict=True))], "conv_id long, token_length long, later_length long")
    rows = K.topic_cohesive(lengths, vectors, 700).orderBy("row").collect()
    assert [(r.sources, r.token_length) for r in rows] == plain_cohesive(x, n, m, 700)


def test_nearest_free_rows_are_found_for_many_centres_at_once():
    """Guessed rows are the plain ones, also with equal scores and copies, and need few products (F3)."""
    from palimpsest.operators import stitching

    rng = np.random.default_rng(4)
    for width, digits in ((64, 9), (3, 1)):
        x, n = np.round(rng.standard_normal((1500, width)), digits), rng.integers(20, 800, 1500)
        x[700:720] = x[3]
        asked, plain = [], stitching.FreeRows.nearest
        stitching.FreeRows.nearest = lambda self, centres, without: (asked.append(len(centres)), plain(self, centres, without))[1]
        try:
            made = K.cohesive_pool(np.arange(1500), x, n, 1000)
        finally:
            stitching.FreeRows.nearest = plain
        assert made == plain_cohesive(x, n, n, 1000)
        assert len(asked) < sum(asked) / 2  # one product a step before


def test_later_lengths_leave_out_a_system_message(spark):
    talks = spark.createDataFrame([(i, [Row(role="system", content="a b c"), Row(role="user", content="w " * 3)]) for i in range(4)], f"conv_id long, messages {M.MESSAGES}")
    sizes = K.stitching_lengths(talks, True)
    assert {(r.token_length, r.later_length) for r in sizes.collect()} == {(10, 5)}
    rows = K.concatenated(talks.join(sizes, "conv_id"), 15)
    assert [(r.sources, r.token_length) for r in rows.orderBy("source_row_index").collect()] == [([0, 1], 15), ([2, 3], 15)]
    made = K.stitched_messages(rows, talks, one_system=True)
    assert {r.t for r in made.select(M.total_tokens(F.col("messages")).alias("t")).collect()} == {15}


def test_oversize_row_is_an_error(spark):
    with pytest.raises(Exception, match="more than a bin"):
        K.byte_bins(spark.createDataFrame([(1, 99)], "i long, s long"), 5, 50, "i", "s").collect()


def test_nearest_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -np.inf)
    for rows in (K.BLOCK_ROWS, 7):
        monkeypatch.setattr(K, "BLOCK_ROWS", rows)
        found = K.nearest(df, 3).collect()
        assert len(found) == 120
        for r in found:
            assert r.neighbour_id == np.argsort(-sims[r.query_id], kind="stable")[r.rank - 1]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(f"{i:04d}", i % 10 == 0) for i in range(300)], "key string, v boolean")
    a = {r.key for r in S.balanced_sample(rows, 50, "v").collect()}
    assert a == {r.key for r in S.balanced_sample(rows.repartition(5), 50, "v").collect()} and len(a) == 50
    short = S.balanced_sample(rows.filter("key < '0100'"), 50, "v").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in short} == {True: 10, False: 40}
    nested = S.nested_sample(rows, rows.limit(5), 20)
    assert nested.count() == 20 and nested.filter("forced").count() == 5
    assert S.parity_sample(["b", "a", "c"], 2, 7) == random.Random(7).sample(["a", "b", "c"], 2)


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, S.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in S.pending(new, old, ["k"]).collect()] == [3]


def test_adapters(spark):
    turns = spark.createDataFrame([Row(conversations=[Row(**{"from": "human", "value": "q"}), Row(**{"from": "gpt", "value": " "})])])
    assert [m.role for m in adapters.normalised(turns, "sharegpt").first().messages] == ["user"]
    uneven = spark.createDataFrame([(["user", "assistant"], ["a"])], "role array<string>, content array<string>")
    assert len(adapters.normalised(uneven, "wildchat").first().messages) == 1
    with pytest.raises(Exception, match="not a JSON list"):
        adapters.normalised(spark.createDataFrame([("[oops",)], "prompt string"), "mrcr").collect()
    qa = spark.createDataFrame([("c", ["q1", "q2"], [["a1", "x"], ["a2"]])], "context string, questions array<string>, answers array<array<string>>")
    assert [m.content for m in adapters.normalised(qa, "memory").first().messages] == ["c", "q1", "a1", "q2", "a2"]
    with pytest.raises(Exception, match="do not match"):
        adapters.normalised(qa.withColumn("questions", F.array(F.lit("q"))), "memory").collect()
    generic = spark.createDataFrame([([], [Row(role="user", content="m")])], "conversations array<struct<from:string,value:string>>, messages array<struct<role:string,content:string>>")
    assert adapters.normalised(generic, "unknown").first().messages[0].content == "m"


def test_sources_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in readers.SOURCES["longbench"].subsets:
            z.writestr(f"data/{name}.jsonl", json.dumps({"input": "", "context": name, "answers": ["x"]}) + "\n\n")
    (tmp_path / "longbench").mkdir()
    (tmp_path / "longbench" / "data.zip").write_bytes(buffer.getvalue())
    got = readers.read_source(spark, root, "longbench")
    assert got.count() == 3 and got.filter("token_length > 0").count() == 3
    with pytest.raises(ValueError, match="no source"):
        readers.source_spec("nowhere")
    with pytest.raises(RuntimeError, match="cannot be read"):
        readers.read_source(spark, root, "wildchat")

    dataset = contexts(spark, SF).select(F.col("conv_id").alias("source_row_index"), "messages")
    saved = writers.write_dataset(dataset, f"{root}/set")
    assert saved.count() == writers.write_dataset(dataset.limit(0), f"{root}/set").count() == 20
    assert readers.read_dataset(spark, f"{root}/set", test=True).count() == 5
    assert readers.first_readable(spark, [f"{root}/none", f"{root}/set"], 7).count() == 7
    with pytest.raises(ValueError, match="not 99"):
        readers.read_dataset(spark, f"{root}/set", 99)

    for run in ("a", "b"):
        spark.createDataFrame([(1, run)], "k long, v string").write.parquet(f"{root}/runs/{run}")
    union = readers.union_runs(spark, root, [{"run_id": "b", "label": "B"}, {"run_id": "a"}, {"run_id": "b"}], "main")
    assert [(r.v, r.run_label, r.manifest_pos) for r in union.orderBy("manifest_pos").collect()] == [("b", "B", 0), ("a", "a", 1)]
    assert readers.run_root(root, "x__test__1", "main").endswith("runs_test/x__test__1")

    (tmp_path / "lines.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, f"{root}/lines.jsonl", "id long").count() == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="FAILFAST|malformed|Malformed"):
        readers.json_lines(spark, f"{root}/bad.jsonl", "id long").collect()

    made = []
    make = lambda: made.append(1) or spark.range(3)
    for identity in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert writers.cached(spark, f"{root}/cache", identity, make).count() == 3
    assert len(made) == 2
    results = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x long")
    writers.write_results(results, f"{root}/results")
    writers.write_results(results.filter("run_id = 'r2'").withColumn("x", F.lit(9)), f"{root}/results")
    assert {r.run_id: r.x for r in spark.read.parquet(f"{root}/results").collect()} == {"r1": 1, "r2": 9}
    assert "| r1 | 1 |" in writers.markdown(results.orderBy("run_id"), "Runs") and r"run\_id & x" in writers.latex(results)
    writers.write_csv(results, f"{root}/csv")
    writers.write_json_lines(results.withColumnRenamed("x", "id"), f"{root}/jsonl")
    assert spark.read.json(f"{root}/jsonl").count() == 2
    blind, key = writers.blind_and_key(results.withColumn("id", F.col("x")), ["run_id"], ["x"])
    assert blind.columns == ["label", "id", "run_id"] and key.columns == ["id", "x"]


def test_run_identity(spark):
    config = {"datasets": ["d_10k", {"e_20k": {"rows": 5}}], "probes": "p", "compactors": ["recent_5", "recent_9"], "evaluator": {"name": "j"}}
    found = runs.expected_runs(config)
    assert len({f["run_id"] for f in found}) == 4 and found == runs.expected_runs(config)
    assert runs.flattened({"a": {"b": 1, "c": {"d": 2}}}) == {"a.b": 1, "a.c.d": 2}
    with pytest.raises(ValueError, match="exactly one"):
        runs.one_evaluator(["a", "b"])
    test = runs.run_spec("eval", True, 1, {"name": "d"}, {}, {"name": "p"}, {"name": "c"}, {"name": "j"})
    assert "__test__" in runs.run_id(test)
    table = runs.runs_table(spark, [f["spec"] for f in found])
    assert readers.find_runs(table, dataset="d_10k", compactor="recent_5").count() == 1
    with pytest.raises(ValueError, match="2 runs match"):
        readers.find_runs(table, dataset="d_10k")
    assert readers.find_runs(table, strict=False, dataset="d_10k").count() == 1


def test_phases_and_resume(spark):
    dataset = contexts(spark, SF).select(F.col("conv_id").alias("source_row_index"), "messages").filter("source_row_index < 4")
    work = phases.pairs(spark, dataset)
    first = phases.evaluated(work.filter("source_row_index < 2"), RecentMessages(3), "stub_letter", "stub_judge").cache()
    assert first.count() == 30 and first.filter("compacted_compliant is null or retention is null").isEmpty()
    both = phases.evaluated(work, RecentMessages(3), "stub_letter", "stub_judge", first)
    assert both.count() == 60 and both.select(*phases.KEYS).distinct().count() == 60
    verdicts = phases.judged(phases.compacted(work, RecentMessages(1)), "stub_judge")
    assert phases.rejudged(both, verdicts, "again").filter("run_id = 'again'").count() == 60
    pairs = phases.prompt_pairs(first, both, ["retention"])
    assert pairs.filter("baseline_retention <> targeted_retention").isEmpty()
    assert phases.retention_only(work).filter("full_with_sssc_output is not null").isEmpty()
    again = phases.reprobed(phases.compacted(work, RecentMessages(3)), "stub_letter", ("compacted",))
    assert again.count() == 60 and "reprobed_compliant" in again.columns
    stats_row = extraction_stats(spark.createDataFrame([([Row(text="a", evidence="e", source_turn_index=0)], True)], "registry array<struct<text:string,evidence:string,source_turn_index:int>>, retention boolean")).first()
    assert (stats_row.avg_items, stats_row.retention_rate, stats_row.n_judged) == (1.0, 1.0, 1)


def test_runtimes():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert runtimes.with_backoff(flaky, sleep=pauses.append) == "ok" and pauses == [1.0, 2.0]
    with pytest.raises(ValueError):
        runtimes.runtime("nowhere")
    assert runtimes.seeded(3).random() == random.Random(3).random()


def test_reports(spark):
    df = spark.createDataFrame([("b", "x", 0.5), ("a", "x", 0.25), ("z", "y", 0.125)], "r string, c string, v double")
    assert [r.r for r in reports.ordered(df, {"r": ["z", "b"]}).collect()] == ["z", "b", "a"]
    wide = reports.with_average(reports.strict_pivot(df, "r", "c", "v", ["x", "y"]), "r")
    assert {r.r: (r.x, r.y) for r in wide.collect()}["Average"] == (0.375, 0.125)
    with pytest.raises(Exception, match="two values"):
        reports.strict_pivot(df.unionByName(df), "r", "c", "v", ["x", "y"]).collect()
    assert df.select(reports.percent("v").alias("p")).first().p == "50.0%"
    assert [r.c for r in reports.blank_repeats(df, "c", ["c", "r"]).orderBy("r").collect()] == ["x", "", "y"]
    assert reports.most_common(df, "c").first().c == "x"
    assert reports.plot_table(df, "r", "v").columns == ["x", "y", "series"]


def test_streamed_extraction_equals_the_batch_fold(spark, tmp_path):
    from palimpsest.operators import constraints as C
    from palimpsest.operators import extraction as E

    m = F.col("messages")
    talks = contexts(spark, SF).select("conv_id", C.injected(m, C.targets(m, F.lit("top"), F.lit(3), F.col("conv_id"), F.lit(1)), C.framed(F.lit(C.CATALOGUE[0].sssc), F.lit(True), F.lit(True))).alias("messages"))
    turns = talks.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", "turn", "m.role", F.col("m.content").alias("text")).cache()
    for part in (0, 1):  # the second file redelivers every conversation's first turns
        turns.filter(F.col("turn") <= 2 if part == 0 else F.lit(True)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    read = spark.readStream.schema("conv_id long, turn int, role string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream = extract_stream(read).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    stream.awaitTermination(120)
    batch = talks.select("conv_id", F.explode(E.registry(m)).alias("i")).select("conv_id", "i.text", "i.source_turn_index")
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, batch.collect()))


def test_a_late_or_repeated_turn_changes_nothing():
    from palimpsest.operators.constraints import EXPLICIT
    from palimpsest.streaming.extraction import fold

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, said = State(), [f"{EXPLICIT}say {w}." for w in ("one", "two", "three")]
    batch = lambda *rows: [pd.DataFrame(rows, columns=["turn", "role", "text"])]
    found = lambda frames: pd.concat(list(fold((7,), frames, state)))["source_turn_index"].tolist()
    assert found(batch((4, "user", said[1]), (2, "user", said[0]))) == [2, 4]
    assert found(batch((4, "user", said[1]), (3, "user", said[2]))) == []  # a repeated delivery, and one that is late
    assert found(batch((5, "assistant", said[2]), (6, "user", said[2] + " " + said[0]))) == [6]


def test_windows_are_the_same_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    read = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    stream = windowed_counts(read).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    stream.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events).collect()))


def test_discovery(spark, tmp_path):
    for root, name in (("a", "x_cat_10k"), ("b", "x_cat_10k"), ("b", "y_cat_20k")):
        spark.range(1).write.parquet(f"{tmp_path}/{root}/{name}")
    (tmp_path / "b" / "z_cat_5k").mkdir()  # not finished
    found = readers.discover_datasets(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()
    assert [(r.dataset, "/a/" in r.path) for r in found] == [("x_cat_10k", True), ("y_cat_20k", False)]
    assert readers.executor_environment({"token_limit": 5, "none": None}) == {"spark.executorEnv.TOKEN_LIMIT": "5"}


def test_resampled_sums_draw_inside_their_tasks(spark, monkeypatch):
    """Draws are rows nowhere: a plan that makes them as rows may broadcast them all (F1, F2)."""
    from hashlib import md5

    monkeypatch.setattr(stats, "SLOTS_TOGETHER", 64)  # groups of several parts
    sizes, replicates = {"a": 150, "b": 3, "c": 64}, 60
    rows = [(k, i, float(i * i % 7), i % 3 if i else None) for k, n in sizes.items() for i in range(n)]
    out = stats.resampled_sums(spark.createDataFrame(rows, "k string, slot long, v double, w long"), ["k"], ("v", "w"), replicates, "seed")
    got = {(r.k, r.replicate): (r.v, r.w) for r in out.collect()}
    want = {}
    for k, n in sizes.items():
        held = [r for r in rows if r[0] == k]
        for rep in range(replicates):
            hashes = [md5(f"seed|{k}|{rep}|{b}".encode()).hexdigest() for b in range(-(-n // 4))]
            drawn = [int(int(hashes[i // 4][8 * (i % 4) : 8 * (i % 4) + 8], 16) / 4294967296.0 * n) for i in range(n)]
            want[k, rep] = (sum(held[s][2] for s in drawn), sum(held[s][3] or 0 for s in drawn))
    assert got == want
    interval = stats.cluster_interval(spark.createDataFrame([(i, 1.0, 2.0) for i in range(40)], "slot long, v double, w double"), [], "v", "w", 50)
    assert interval.first()[:2] == (40, 0.5)
    assert "posexplode" not in interval._jdf.queryExecution().toString()


def test_resampled_means_join_no_distributions(spark):
    """No row carries a distribution, whose length grows with the root of the group's rows (F9)."""
    sizes = spark.createDataFrame([("big", 24_000_000, 6_000_000, 12_000_000, 6_000_000), ("one", 1, 0, 0, 1)], "k string, n long, k0 long, k1 long, k2 long")
    means = stats.resampled_means(sizes, ["k"], (-1, 0, 1), 400, "seed")
    assert "cdf" not in means._jdf.queryExecution().toString()
    got = {k: np.array([r.m for r in means.filter(F.col("k") == k).collect()]) for k in ("big", "one")}
    assert len(got["big"]) == 400 and abs(got["big"].mean()) < 5e-5 and got["big"].std() == pytest.approx((0.5 / 24e6) ** 0.5, rel=0.15)
    assert set(got["one"]) == {1.0} and len(got["one"]) == 400
    whole = stats.few_valued_interval(spark.createDataFrame([(i % 2,) for i in range(50)], "v int"), [], "v", (0, 1), 100).first()
    assert (whole.n, whole["mean"]) == (50, 0.5) and 0.3 < whole.low < 0.5 < whole.high < 0.7


def test_stability_pairs_stay_in_their_buckets(spark):
    """Pairs are compared where facts lie: nothing is shuffled, and a row a compactor and pair is grouped (F11, F12)."""
    pairs = A.stability_pairs(facts(spark, SF))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.groupBy("compactor", "metric").count().count() == 20
