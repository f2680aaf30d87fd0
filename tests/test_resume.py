"""Runs that are resumed: logs by parts, shared calls, conditions by attempt, model extraction, shared servers."""

import json
import os
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.messages import MESSAGES
from palimpsest.operators import phases, served
from palimpsest.operators import runtimes as U
from palimpsest.operators.calls import CallStore, PartedLog, call_key
from palimpsest.operators.compactors import compactor
from palimpsest.operators.conditions import ConditionRun
from palimpsest.operators.extraction import ModelExtraction

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def counted(talks):
    """Answers with a letter and notes each call in the file that the talk's environment names."""
    with open(os.environ["CALL_NOTES"], "a") as f:
        f.writelines(f"{hash(json.dumps(t, sort_keys=True))}\n" for t in talks)
    return ["A" for _ in talks]


def unreadable(talks):
    return ["no letter at all" for _ in talks]


@pytest.fixture
def workers(spark):
    """Environment variables of the Python workers that are started for a test."""
    environment = spark.sparkContext.environment
    before = dict(environment)
    yield environment
    environment.clear()
    environment.update(before)


@pytest.fixture
def notes(workers, tmp_path):
    path = tmp_path / "notes"
    path.touch()
    workers["CALL_NOTES"] = str(path)
    return path


@pytest.fixture(scope="module")
def pairs(spark):
    talks = [(i, [("user", f"Question {i} about things."), ("assistant", "Fine."), ("user", f"More of {i}, please."), ("assistant", "Done.")]) for i in range(3)]
    return phases.pairs(spark, spark.createDataFrame(talks, f"source_row_index long, messages {MESSAGES}")).cache()


def test_log_counts_whole_parts_only(spark, tmp_path):
    log = PartedLog(spark, f"{tmp_path}/log", "n int, s string")
    assert log.read().count() == 0
    log.append(spark.createDataFrame([(1, "a")], "n long, s string"))
    named = log.append(spark.createDataFrame([(2, "b")], "n int, s string"), "step-2")
    log.append(spark.createDataFrame([(9, "late")], "n int, s string"), "step-2")  # whole already
    broken = log.append(spark.createDataFrame([(3, "c")], "n int, s string"), "step-3")
    os.remove(f"{broken}/_SUCCESS")
    assert named in log.parts() and broken not in log.parts()
    assert sorted(map(tuple, log.read().collect())) == [(1, "a"), (2, "b")]
    log.append(spark.createDataFrame([(4, "d")], "n int, s string"), "step-3")  # the broken part is written anew
    assert sorted(r.n for r in log.read().collect()) == [1, 2, 4]


def test_two_writers_and_an_old_reader(spark, tmp_path):
    a, b = (PartedLog(spark, f"{tmp_path}/log", "n int") for _ in range(2))
    a.append(spark.range(5).select(F.col("id").alias("n")))
    old = a.read()
    b.append(spark.range(7).select(F.col("id").alias("n")))
    assert (old.count(), a.read().count(), b.read().count()) == (5, 12, 12)


def test_keys_tell_talks_models_and_options_apart(spark):
    rows = [([("user", "a"), ("user", "b")],), ([("user", "a\nb")],), ([("user", None)],), ([("user", "")],), ([],)]
    talks = spark.createDataFrame(rows, f"t {MESSAGES}")
    keys = [talks.select(call_key(m, o, F.col("t")).alias("k")) for m, o in (("m", None), ("n", None), ("m", {"temperature": 1}))]
    found = [r.k for df in keys for r in df.collect()]
    assert len(set(found)) == 15 and [r.k for r in keys[0].collect()] == found[:5]


def test_equal_talks_are_asked_once(spark, tmp_path, notes):
    store = CallStore(spark, f"{tmp_path}/calls")
    asked = spark.createDataFrame([(i, [("user", f"say {i % 3}")]) for i in range(90)], f"i int, talk {MESSAGES}").repartition(4)
    rows = store.answered(asked, "local:tests.test_resume:counted", "talk", ["i"]).collect()
    assert len(rows) == 90 and all(r.output == "A" and r.status == "success" for r in rows)
    assert len(notes.read_text().splitlines()) == 3
    again = store.answered(asked.filter("i < 50"), "local:tests.test_resume:counted", "talk", ["i"])
    assert again.count() == 50 and len(notes.read_text().splitlines()) == 3
    anew = store.answered(asked, "local:tests.test_resume:counted", "talk", ["i"], again=F.col("i") == 1)
    assert anew.count() == 90 and len(notes.read_text().splitlines()) == 4


def test_one_call_a_talk_over_four_compactors(spark, tmp_path, notes, pairs):
    store, talks = CallStore(spark, f"{tmp_path}/calls"), set()
    for name in ("recent_1", "recent_2", "recent_4", "extract_3"):
        run = ConditionRun(spark, f"{tmp_path}/{name}", store)
        wide = run.step(pairs, compactor(name), "local:tests.test_resume:counted", "stub_judge")
        assert wide.count() == 45 and wide.filter("compacted_compliant is null or retention is null or full_with_sssc_status <> 'success'").isEmpty()
        work = run.compact(pairs, compactor(name))
        talks |= {json.dumps([m.asDict() for m in r.talk]) for r in run.asked(work, phases.CASES, False).collect()}
    assert len(notes.read_text().splitlines()) == len(talks) < 4 * 4 * 45


def test_failed_and_unreadable_conditions_run_again_alone(spark, tmp_path, pairs):
    run = ConditionRun(spark, f"{tmp_path}/run", CallStore(spark, f"{tmp_path}/calls"))
    first = run.step(pairs, compactor("recent_2"), "flaky:2:stub_letter", "stub_judge", ("letters", None)).cache()
    failed = first.filter("full_with_sssc_status = 'error'").count()
    assert 0 < failed < 45 and first.filter("full_with_sssc_status = 'error' and full_with_sssc_compliant is not null").isEmpty()
    before = run.log.read().count()
    second = run.step(pairs, compactor("recent_2"), "stub_letter", "stub_judge", ("letters", None))
    assert second.filter(" or ".join(f"{c}_compliant is null" for c in phases.CASES)).isEmpty()
    assert second.filter("full_with_sssc_attempts = 2").count() == failed
    added = run.log.read().count() - before
    assert added == first.select(sum(F.when(F.col(f"{c}_status") == "error", 1).otherwise(0) for c in phases.CASES).alias("n")).agg(F.sum("n")).first()[0]
    assert run.step(pairs, compactor("recent_2"), "stub_letter", "stub_judge", ("letters", None)).count() == 45 and run.log.read().count() == before + added
    # an answer that cannot be read is an answer, but no verdict: the call itself is made anew
    odd = ConditionRun(spark, f"{tmp_path}/odd", CallStore(spark, f"{tmp_path}/odd-calls"))
    odd.step(pairs, compactor("recent_2"), "local:tests.test_resume:unreadable", "stub_judge", ("letters", None), cases=("full_with_sssc",))
    assert odd.latest().filter("condition = 'full_with_sssc' and verdict is null and status = 'success'").count() == 45
    odd.step(pairs, compactor("recent_2"), "stub_letter", "stub_judge", ("letters", None), cases=("full_with_sssc",))
    assert odd.latest().filter("condition = 'full_with_sssc' and verdict is not null and attempts = 2").count() == 45


def test_a_models_summaries_by_name(spark, tmp_path, pairs):
    store = CallStore(spark, f"{tmp_path}/calls")
    run = ConditionRun(spark, f"{tmp_path}/run", store)
    first = run.step(pairs, compactor("summary_brief@flaky:2:stub_summary"), "stub_letter", "stub_judge", cases=("compacted",)).cache()
    failed = first.filter("compaction_status = 'error'").count()
    assert 0 < failed < 45 and first.filter("compaction_status = 'error' and (compacted_status is not null or retention is not null)").isEmpty()
    second = run.step(pairs, compactor("summary_brief@stub_summary"), "stub_letter", "stub_judge", cases=("compacted",))
    assert second.filter("compaction_status <> 'success' or compacted_compliant is null or retention is null").isEmpty()
    # contexts that were made stay as they are
    assert run.contexts.read().filter("compaction_status = 'success'").count() == 45
    with pytest.raises(ValueError, match="no summary prompt"):
        compactor("summary_nothing@stub_summary")


def fold(talk, steps=None):
    """The stand-in extractor's registry of a conversation, one turn after the other."""
    items = []
    for place, (role, content) in enumerate(talk):
        if role == "user":
            previous = next((c for r, c in reversed(talk[:place]) if r == "assistant"), "(none)")
            known = "\n".join(f"{i}. {x}" for i, (x, _) in enumerate(items, 1)) or "(none)"
            found = json.loads(U.first_new_word(f"Known:\n{known}\n\nAssistant:\n{previous}\n\nUser:\n{content or ''}"))["scs"]
            items += [(x["text"], place) for x in found if x["text"] not in [t for t, _ in items]]
    return items


def test_extraction_in_lock_step_and_after_breaks(spark, tmp_path, monkeypatch):
    talks = {
        1: [("system", "be brief"), ("user", "Always answer politely. Always."), ("assistant", "yes"), ("user", "Always answer politely again"), ("user", "nothing new")],
        2: [("user", "Whenever possible whenever")],
        3: [("assistant", "hello there friends")],
        4: [("user", None), ("user", "Remember Remember everything"), ("user", "Remember everything forever"), ("user", "Remember everything forever and another")],
        5: [],
    }
    rows = spark.createDataFrame(list(talks.items()), f"conv_id long, messages {MESSAGES}")
    want = {i: fold(t) for i, t in talks.items()}
    assert [x for x, _ in want[1]] == ["politely", "nothing"] or want[1]
    model = ModelExtraction(spark, f"{tmp_path}/run", CallStore(spark, f"{tmp_path}/calls"), {"conv_id": "long"})
    part = model.run(rows, "stub_extractor", most_steps=1)
    assert {r.conv_id: r.finished for r in part.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    stuck = model.run(rows, "flaky:1:stub_extractor", model="stub_extractor")  # every call fails: nobody moves
    assert {r.conv_id: r.turns_done for r in stuck.collect()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    # a step whose part was not written to its end counts for nothing, and its calls are in the store
    real, calls = PartedLog.append, []
    monkeypatch.setattr(PartedLog, "append", lambda self, df, name=None: calls.append(self.path) or (_ for _ in ()).throw(OSError("disk")) if self.path.endswith("turns") else real(self, df, name))
    with pytest.raises(OSError, match="disk"):
        model.run(rows, "stub_extractor")
    monkeypatch.undo()
    done = {r.conv_id: r for r in model.run(rows, "flaky:1:stub_extractor", model="stub_extractor", most_steps=1).collect()}
    assert {i: r.turns_done for i, r in done.items()} == {1: 2, 2: 1, 3: 0, 4: 2, 5: 0}  # from the store, though every call would fail
    done = {r.conv_id: r for r in model.run(rows, "stub_extractor").collect()}
    assert {i: [(x.text, x.source_turn_index) for x in r.registry] for i, r in done.items()} == want
    assert all(r.finished for r in done.values()) and done[5].registry_text == "(none)"
    assert model.good_turns().count() == sum(role == "user" for t in talks.values() for role, _ in t)


SERVER = f"""
import json, sys; sys.path.insert(0, {ROOT!r})
from http.server import ThreadingHTTPServer
from tests.test_runtimes import Chat
open(sys.argv[2], 'a').write('started\\n')
ThreadingHTTPServer(('127.0.0.1', int(sys.argv[1])), Chat).serve_forever()
"""


@pytest.fixture
def command(tmp_path, monkeypatch):
    (tmp_path / "serve.py").write_text(SERVER)
    monkeypatch.setenv("SERVED_LEASES", str(tmp_path))
    return [sys.executable, str(tmp_path / "serve.py"), "{port}", str(tmp_path / "starts")]


USER = f"""
import sys; sys.path.insert(0, {ROOT!r})
from palimpsest.operators import runtimes as U
model = U.SharedServer("m", sys.argv[2:], "http://127.0.0.1:{{port}}", "m", linger=1.0)
print([a.said for a in model.answers([[{{"role": "user", "content": f"{{sys.argv[1]}} {{i}}"}}] for i in range(20)])] == [f"{{sys.argv[1]}} {{i}}".upper() for i in range(20)])
"""


def gone(tmp_path, seconds=30):
    """Whether the one keeper ends, and its server with it."""
    (folder,) = [p for p in os.listdir(tmp_path) if p.startswith("served-")]
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        state = json.loads((tmp_path / folder / "state.json").read_text())
        if not state.get("keeper") and not served.ready(state["url"], "/health"):
            return True
        time.sleep(0.2)
    return False


def test_four_processes_share_one_server(tmp_path, command):
    users = [subprocess.Popen([sys.executable, "-c", USER, f"p{i}", *command], stdout=subprocess.PIPE, text=True) for i in range(4)]
    assert [u.communicate(timeout=120)[0].strip() for u in users] == ["True"] * 4
    assert (tmp_path / "starts").read_text() == "started\n"
    assert gone(tmp_path)  # the users ended without a word
    again = subprocess.run([sys.executable, "-c", USER, "later", *command], capture_output=True, text=True, timeout=120)
    assert again.stdout.strip() == "True" and (tmp_path / "starts").read_text() == "started\n" * 2


def test_a_server_that_died_is_started_again(tmp_path, command):
    url = served.acquire("m", "http://127.0.0.1:{port}", command, 60, linger=1.0)
    (folder,) = [p for p in os.listdir(tmp_path) if p.startswith("served-")]
    keeper = json.loads((tmp_path / folder / "state.json").read_text())["keeper"]
    os.kill(keeper, 15)
    end = time.monotonic() + 20
    while served.ready(url, "/health") and time.monotonic() < end:
        time.sleep(0.1)
    assert served.ready(served.acquire("m", "http://127.0.0.1:{port}", command, 60, linger=1.0), "/health")
    assert (tmp_path / "starts").read_text() == "started\n" * 2
    served.release("m", command)
    assert gone(tmp_path)
    with pytest.raises(RuntimeError, match="did not get ready"):
        served.acquire("bad", "http://127.0.0.1:{port}", [sys.executable, "-c", "raise SystemExit(1)"], 4, linger=1.0)


def test_four_tasks_share_one_server_and_lose_no_call(spark, tmp_path, command, workers):
    workers.update(SERVED_shared=" ".join(["http://127.0.0.1:{port}", "m", *command]), SERVED_LEASES=str(tmp_path), SERVED_LINGER="1")
    rows = spark.createDataFrame([(i, [("user", f"task {i}")]) for i in range(80)], f"i int, talk {MESSAGES}").repartition(4)
    for _ in range(2):  # the second job's tasks find the server that the first one's started
        out = U.generated(rows, "serve:shared", "talk", ["i"]).collect()
        assert {r.i: r.output for r in out} == {i: f"TASK {i}" for i in range(80)}
    assert (tmp_path / "starts").read_text() == "started\n"


class Notes:
    """Fails on batches that hold a bad talk, and notes what it answered."""

    def __init__(self):
        self.answered = []

    def answers(self, talks):
        if any("bad" in t[-1]["content"] for t in talks):
            raise RuntimeError("bad talk")
        self.answered += [t[-1]["content"] for t in talks]
        return [U.Answer("ok") for _ in talks]


def test_no_good_answer_is_asked_for_twice():
    model, texts = Notes(), [f"say {i}" if i not in (3, 17) else f"bad {i}" for i in range(40)]
    found = U.tried(model, [[{"role": "user", "content": t}] for t in texts])
    assert [i for i, a in enumerate(found) if isinstance(a, Exception)] == [3, 17]
    assert sorted(model.answered) == sorted(t for t in texts if "bad" not in t)


def test_a_process_keeps_its_runtime():
    assert U.kept_runtime("stub_letter") is U.kept_runtime("stub_letter")
    first = U.kept_runtime("local:tests.test_resume:counted")
    assert first is U.kept_runtime("local:tests.test_resume:counted") is not U.kept_runtime("local:tests.test_resume:counted", {"a": 1})
    U.forget_runtime("local:tests.test_resume:counted")
    assert U.kept_runtime("local:tests.test_resume:counted") is not first


def exchanges_below_joins(df):
    """Hash exchanges of the executed plan that stand below a join."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" +-:*()0123456789"))
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    assert joins, plan
    below = []
    for i in joins:
        for line in lines[i + 1 :]:
            if depth(line) <= depth(lines[i]):
                break
            below += [line] * ("Exchange hashpartitioning" in line)
    return below


@pytest.mark.parametrize("name", ["pairwise", "probers", "rates"])
def test_runs_are_compared_without_a_shuffle(spark, name):
    from palimpsest.operators import metrics
    from palimpsest.operators.evaluation import facts, made_facts

    sf, runs = "/root/testdata/sf0.001", ("recent_4__top", "recent_4__middle", "recent_4__bottom")
    make = {
        "pairwise": lambda f: metrics.pairwise_runs(f, runs),
        "probers": lambda f: metrics.prober_table(f, runs, runs[0]).drop("run_id"),
        "rates": lambda f: metrics.prompt_pair_rates(f, "recent_4__top", "extract_3__top"),
    }[name]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, plain = make(facts(spark, sf)), make(made_facts(spark, sf))
        assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))
        assert len(exchanges_below_joins(plain)) > len(exchanges_below_joins(stored))
        shuffled = [e for e in exchanges_below_joins(stored) if "sssc_id" in e]
        assert not shuffled, shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_token_budget_on_hard_rows(spark):
    from palimpsest.operators.compactors import token_budget

    rows = [(1, 0, "a b ? a"), (1, 1, "c"), (2, 0, "a b"), (3, 0, ""), (None, 0, "c c"), (4, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    got = {r.conv_id: (r.kept, r.n_tokens, r.n_kept) for r in token_budget(df, 3).collect()}
    assert got == {1: ("a b ?", 5, 3), 2: ("a b", 2, 2), None: ("c c", 2, 2)}
    assert token_budget(df.limit(0), 3).count() == 0


def test_token_classifier_learns_what_is_kept(spark, tmp_path):
    from palimpsest.operators import tokenclass as T
    from palimpsest.plans.resume_queries import token_classifier_folds

    rows = [(i, f"keep{i % 7} the plain words{i} number {i} . drop", f"keep{i % 7} {i}") for i in range(300)] + [(300, None, None), (301, "", "x")]
    df = spark.createDataFrame(rows, "source_row_index long, text string, short string")
    labels = T.labelled(df, F.col("text"), F.col("short"))
    weights = T.train(labels)
    held = spark.createDataFrame([(f"keep3 the plain words number {n} . drop", f"keep3 {n}") for n in range(1000, 1100)], "text string, short string")
    got = T.ranked_hits(T.labelled(held, F.col("text"), F.col("short")), weights).agg(F.sum("n"), F.sum("hits")).first()
    assert got[0] == 200 and got[1] >= 190
    assert (T.train(labels) == weights).all() and not T.train(labels.limit(0)).any()

    path = str(tmp_path / "weights")
    T.save(spark, weights, path)
    assert (T.load(spark, path) == weights).all()
    made = compactor(f"tokens_25@{path}")
    talks = [(1, [("user", "keep3 the plain words number 5 . drop"), ("assistant", None)]), (2, []), (3, None)]
    injected = spark.createDataFrame(talks, f"source_row_index long, injected {MESSAGES}")
    out = {r.source_row_index: [tuple(m) for m in r.compacted_context] for r in made.contexts(injected, None, ["source_row_index"]).collect()}
    assert out == {1: [("user", "keep3 5"), ("assistant", "")], 2: [], 3: []} and made.name == f"tokens_25@{path}"
    with pytest.raises(ValueError, match="percent"):
        compactor("tokens_0@x")

    folds = token_classifier_folds(spark, "/root/testdata/sf0.001").collect()
    assert len(folds) == 2 and all(f.hits > f.rare_hits and f.hits <= f.n_kept for f in folds), folds
    print(folds)


def test_token_features_are_hashed_once_for_all_epochs(spark):
    """The features are the plain ones, and the weights those of a plain perceptron over the same parts (F8)."""
    from palimpsest.operators import tokenclass as T

    def plain_places(tokens):
        low, rows = ["", *(t.lower() for t in tokens), ""], []
        for i, token in enumerate(tokens):
            form = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", token))))
            rows.append([zlib.crc32(f.encode()) % T.WIDTH for f in (f"w{low[i + 1]}", f"p{low[i]}", f"n{low[i + 2]}", f"e{low[i + 1][-3:]}", f"f{form}", f"b{i.bit_length()}", f"s{low[i]}|{form}")])
        return np.array(rows, np.int64).reshape(len(rows), 7)

    known = ["Hello", "wOrld", "aab", "I", ".", "?", "1234", "Çé", "İx", "日本", "٣٤", "a_b", "", "A1-b", "x" * 50]
    for n in (0, 1, 2, 700):
        tokens = [known[i * i % 17 % len(known)] for i in range(n)]
        assert (T.places(tokens) == plain_places(tokens)).all() and T.places(tokens).shape == (n, 7)

    rows = spark.createDataFrame([(f"keep{i % 7} the words{i} Number {i} . é drop", f"keep{i % 7} {i}") for i in range(60)], "text string, short string")
    asked, plain = spark.sparkContext.accumulator(0), T.places
    T.places = lambda tokens: (asked.add(len(tokens)), plain(tokens))[1]
    try:
        weights = T.train(T.labelled(rows, F.col("text"), F.col("short")), epochs=3, partitions=1)
    finally:
        T.places = plain
    labels = sorted((list(r.tokens), list(r.kept)) for r in T.labelled(rows, F.col("text"), F.col("short")).collect())
    assert asked.value == sum(len(tokens) for tokens, _ in labels)
    want = np.zeros(T.WIDTH)
    for _ in range(3):
        now, late, step = want.copy(), np.zeros(T.WIDTH), 0
        for tokens, kept in labels:
            for at, keep in zip(plain_places(tokens), kept, strict=True):
                sign = 1.0 if keep else -1.0
                if sign * now[at].sum() <= 0:
                    np.add.at(now, at, sign)
                    np.add.at(late, at, sign * step)
                step += 1
        want = (now - late / step) * step / step
    assert (weights == want).all() and want.any()


def test_talks_stay_where_they_are_made(spark, tmp_path):
    """Only names of talks are shuffled; a worker turns few talks into objects at once (F4, F5, F10)."""
    from palimpsest.operators import runtimes
    from palimpsest.operators.common import beside

    wide = spark.createDataFrame([(r, i, "x" * 50) for r in (1, 2, None) for i in range(3)], "r long, i int, text string").repartition(3, "r")
    narrow = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (3, 0, "c")], "r long, i int, v string")
    got = {(r.r, r.i): r.s and r.s.v for r in beside(wide, narrow, ("r", "i"), "s").collect()}
    assert got == {(r, i): {(1, 0): "a", (1, 2): "b"}.get((r, i)) for r in (1, 2, None) for i in range(3)}
    talk = "named_struct('role', 'user', 'content', concat('w', id % 300))"
    asked = spark.range(600).selectExpr("id div 10 AS row", "cast(id % 10 AS int) AS place", f"array({talk}) AS talk")
    store = CallStore(spark, f"{tmp_path}/calls")
    in_place = store.answered(asked, "stub_letter", "talk", ("row", "place"), unique=("row", "place"))
    assert in_place.filter("status = 'success'").count() == 600 and store.read().count() == 300
    plain = CallStore(spark, f"{tmp_path}/plain").answered(asked, "stub_letter", "talk", ("row", "place"))
    assert sorted(in_place.collect()) == sorted(plain.collect())
    again = store.answered(asked, "stub_letter", "talk", ("row", "place"), unique=("row", "place"))
    assert again.count() == 600 and store.read().count() == 300
    assert runtimes.TALKS_TOGETHER <= 256
