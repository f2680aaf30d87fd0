import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import grading as G
from palimpsest.functions import messages as M
from palimpsest.functions import text as X
from palimpsest.operators import constraints as C
from palimpsest.operators import extraction as E
from palimpsest.operators.compactors import RecentMessages, batch_size, compaction, compactor, model_compaction
from palimpsest.operators.evaluation import COMPACTORS, POSITIONS, facts, judged_contexts

SF = "/root/testdata/sf0.001"


def talk(spark, *turns):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], f"messages {M.MESSAGES}")


def value(df, column):
    return df.select(column.alias("x")).first().x


def test_cleaning_maps_roles_and_drops_empty(spark):
    df = talk(spark, (" Human ", " hi "), ("developer", "d"), ("tool", "t"), ("user", "  "), ("user", None))
    assert [(m.role, m.content) for m in value(df, M.cleaned(F.col("messages")))] == [("user", "hi"), ("system", "d"), ("assistant", "t")]
    assert value(df, M.cleaned(F.col("messages"), nulls_as_text=True))[-1].content == "None"


def test_positions(spark):
    df = talk(spark, ("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d"), ("user", "e"))
    places = M.user_turns(F.col("messages"))
    assert value(df, places) == [1, 3, 4, 5]
    assert [value(df, M.at_position(places, F.lit(p))) for p in POSITIONS] == [1, 4, 5]
    with pytest.raises(Exception, match="no user turn"):
        value(talk(spark, ("system", "s")), M.at_position(M.user_turns(F.col("messages")), F.lit("top")))


def test_late_system_is_an_error(spark):
    with pytest.raises(Exception, match="not first"):
        value(talk(spark, ("user", "a"), ("system", "s")), M.system_only_first(F.col("messages")))
    df = talk(spark, ("system", "s"), ("user", "a"))
    assert len(value(df, M.without_leading_system(F.col("messages")))) == 1
    assert value(talk(spark), M.without_leading_system(F.col("messages"))) == []


def test_trim_reaches_target_or_keeps_all(spark):
    df = talk(spark, *[("user", "one two three")] * 5)  # five tokens a message
    for target, kept in ((1, 1), (5, 1), (6, 2), (25, 5), (99, 5)):
        assert len(value(df, M.trimmed_to(F.col("messages"), target))) == kept


def test_local_context_takes_the_reply(spark):
    df = talk(spark, ("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d"), ("assistant", "e"), ("user", "f"))
    assert [m.content for m in value(df, M.local_context(F.col("messages"), 1))] == ["c", "d", "e", "f"]
    assert value(df, M.local_context(F.col("messages"), 2)) is None


def test_framing_and_injection(spark):
    df = talk(spark, ("user", "a"), ("assistant", "b"), ("user", "c"))
    wrapped = C.framed(F.lit("Do it."), F.lit(True), F.lit(True))
    assert value(df, wrapped) == C.EXPLICIT_HARD + "do it."
    assert value(df, C.framed(F.lit("Do it."), F.lit(False), F.lit(False))) == "Do it."
    full = C.injected(F.col("messages"), C.targets(F.col("messages"), F.lit("bottom"), F.lit(1)), wrapped)
    assert value(df, full)[2].content == C.EXPLICIT_HARD + "do it.\nc"
    assert value(df, M.contains_text(full, F.lit("for the WHOLE session, you must follow this rule - do it"))) is True
    assert value(df, M.contains_text(full, F.lit("something else"))) is False
    assert value(df, M.contains_text(full, wrapped)) is True
    with pytest.raises(Exception, match="at least 1"):
        value(df, C.targets(F.col("messages"), F.lit("top"), F.lit(0)))


def test_catalogue_shape():
    assert [c.id for c in C.CATALOGUE] == list(range(1, 16))
    assert [c.type for c in C.CATALOGUE] == [t for t in C.TYPES for _ in range(3)]


def test_pair_seeds_repeat_a_sequential_generator():
    rng = random.Random(42)
    for row, cid, seed, swap in C.pair_seeds(3):
        assert seed == rng.randint(0, 2**31 - 1)
        assert swap == (random.Random(seed).random() < 0.5)
    assert len(C.pair_seeds(3)) == 45 and (row, cid) == (2, 15)


def test_recent_and_ratio(spark):
    df = talk(spark, ("user", "a"), ("assistant", "b"), ("user", "c"))
    assert [m.content for m in value(df, RecentMessages(2).compact(F.col("messages")))] == ["b", "c"]
    assert len(value(df, RecentMessages(9).compact(F.col("messages")))) == 3
    assert value(talk(spark), compaction(F.col("messages"), F.col("messages"))).compression_ratio == 1.0
    with pytest.raises(ValueError):
        RecentMessages(0)
    with pytest.raises(ValueError):
        compactor("nothing_5")
    assert batch_size(100_000, 0) == 300 and batch_size(10**9, 5) == 1


def test_a_poison_row_is_an_error_row(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("poison")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "source_row_index long, prompt string").coalesce(1)
    rows = {r.source_row_index: r for r in model_compaction(df, model).collect()}
    assert rows[1].summary == "A" and rows[3].summary == "C"
    assert rows[2].status == "error" and rows[2].error == "poison" and rows[2].summary is None


def test_facts_agree_with_the_text_pipeline(spark):
    """The narrow facts' retention is what injecting, compacting and judging texts gives."""
    table = facts(spark, SF).filter("repeat = 1 and explicit and hard and status = 'success'")
    for c in COMPACTORS:
        for p in POSITIONS:
            want = judged_contexts(spark, SF, c, p).select(F.col("conv_id").alias("source_row_index"), "sssc_id", F.col("retention").alias("judged"))
            met = table.filter((F.col("compactor") == c) & (F.col("position") == p)).join(want, ["source_row_index", "sssc_id"])
            assert met.filter("retention <> judged").isEmpty()


def test_verdict_invariants(spark):
    table = facts(spark, SF)
    assert table.filter("status = 'error' and (retention is not null or compacted is not null or post is not null)").isEmpty()
    shared = table.groupBy("source_row_index", "sssc_id").agg(F.countDistinct("uninjected").alias("n"))
    assert shared.filter("n > 1").isEmpty()


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"scs": [{"text": " a ", "evidence": "e"}]}', ["a"]),
        ('```json\n{"scs": [{"text": "b"}]}\n```', ["b"]),
        ('Found: {"scs": [{"text": "c"}]}', ["c"]),
        ('{"x": 1} then {"scs": [{"text": "d"}, {"text": " "}]}', ["d"]),
        ('{"scs": null}', []),
        ("not json", []),
        ("", []),
        (None, []),
    ],
)
def test_extractor_outputs(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert [i.text for i in value(df, G.extracted_constraints(F.col("x")))] == want


def test_grading(spark):
    df = spark.createDataFrame([(" a ",), ("B",), ("A.",), (None,)], "x string")
    assert [r.x for r in df.select(G.letter_grade(F.col("x"), F.lit("A")).alias("x")).collect()] == [True, False, None, None]
    out = spark.createDataFrame([("pre[analysis]\nthink[final]\n A [final]\n B ",)], "x string")
    assert value(out, G.graded_text(F.col("x"))) == "B"
    assert value(out, G.channel(F.col("x"), "text")) == "pre"
    assert value(spark.createDataFrame([("just text",)], "x string"), G.graded_text(F.col("x"))) == "just text"
    stream = spark.createDataFrame([("<|channel|>analysis<|message|>hm<|end|><|channel|>final<|message|>yes",)], "x string")
    assert [(e.label, e.content) for e in value(stream, G.recovered_channels(F.col("x")))] == [("analysis", "hm"), ("final", "yes")]


def test_registry_keeps_each_text_once(spark):
    rule = C.HARD + "be brief."
    df = talk(spark, ("user", f"{rule}\nhi"), ("assistant", rule), ("user", f"x {rule} {C.EXPLICIT}use metres."))
    items = value(df, E.registry(F.col("messages")))
    assert [(i.text, i.source_turn_index) for i in items] == [(rule, 0), (C.EXPLICIT + "use metres.", 2)]
    assert value(df, E.registry_text(E.registry(F.col("messages")))).startswith("1. ")
    assert value(talk(spark, ("assistant", "x")), E.registry_text(E.registry(F.col("messages")))) == "(none)"


def test_labels(spark):
    df = spark.createDataFrame([("hermes_cat_100k",)], "x string")
    assert value(df, X.length_label(F.col("x"))) == "100k" and value(df, X.config_label(F.col("x"))) == "hermes_cat"
    assert value(df, X.context_tokens(F.col("x"))) == 100_000
    assert [value(df, X.token_target(F.lit(t))) for t in ("10k", "1.5m", "2_000", "x")] == [10_000, 1_500_000, 2000, None]
    assert value(df, X.slug(F.lit("--a b/c--"))) == "a_b_c" and value(df, X.slug(F.lit("--"))) == "run"
    assert value(df, X.display_label(F.lit("big_model_plain_prompt"), {"_plain": "Plain"}, {"big_model": "Big"})) == "Big (Plain)"
    assert value(df, X.compactor_name(F.lit("{'name': 'recent_5', 'n': 5}"))) == "recent_5" and value(df, X.compactor_name(F.lit("x"))) == "x"
    assert [value(df, X.human_label(F.lit(t))) for t in (" Yes", "absent", "?")] == [True, False, None]
    flags = (("_explicit_hard", True, True), ("_soft", False, False))
    assert value(df, X.flag_suffix(F.lit("run_soft"), flags)).hard is False
    with pytest.raises(Exception, match="no framing"):
        value(df, X.flag_suffix(F.lit("run"), flags))


def test_tokenizer_files_count_tokens(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from palimpsest.functions.text import vocabulary_token_count

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["one two three", "", None, "naïve 日本語 🙂", "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {i: None if t is None else len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    count = vocabulary_token_count(path)
    assert {r.i: r.n for r in df.select("i", count(F.col("t")).alias("n")).collect()} == want
    talks = spark.createDataFrame([(1, [("user", texts[0]), ("assistant", texts[3])]), (2, [])], f"k int, messages {M.MESSAGES}")
    size = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    assert {r.k: r.token_length for r in M.message_lengths(talks, count, "k").collect()} == {1: size("user") + size(texts[0]) + 1 + size("assistant") + size(texts[3]) + 1, 2: 0}


def test_classified_tokens_keep_the_best_and_the_forced(spark):
    from palimpsest.operators.compactors import classified_tokens

    df = spark.createDataFrame([(1, "a bb ccc? dddd\nee"), (2, None), (3, ""), (4, "same same")], "source_row_index int, text string")
    rows = {r.source_row_index: (r.kept, r.n_tokens, r.n_kept) for r in classified_tokens(df, lambda tokens: [float(len(t)) for t in tokens], 0.3, window=3).collect()}
    assert rows == {1: ("ccc ? dddd \n", 7, 4), 2: (None, 0, 0), 3: ("", 0, 0), 4: ("same", 2, 1)}


def test_tools_have_schemas():
    from palimpsest.operators import constraints as C

    schemas = C.tool_schemas()
    assert len({s["function"]["name"] for s in schemas}) == len(C.TOOLS) == 10
    assert all(set(s["function"]["parameters"]["required"]) <= set(s["function"]["parameters"]["properties"]) for s in schemas)
    assert all(s["function"]["name"] in C.tools_message() for s in schemas)
