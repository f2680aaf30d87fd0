"""Queries over runs that are resumed: model extraction, conditions by attempt, shared calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.calls import CallStore
from palimpsest.operators.common import shared_folder
from palimpsest.operators.compactors import compactor
from palimpsest.operators.conditions import ConditionRun
from palimpsest.operators.constraints import EXPLICIT_HARD
from palimpsest.operators.evaluation import contexts
from palimpsest.functions.text import first_sentence
from palimpsest.operators import tokenclass
from palimpsest.operators.extraction import ModelExtraction
from palimpsest.plans.phase_queries import _ANSWER, _pairs_sql, pairs_of
from palimpsest.plans.registry import query

NEW_WORD = "list_filter(t.words, lambda w: NOT list_contains(f.items, w))"
FULL = ("full_with_sssc", "full_without_sssc")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


@query(f"""WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{7,}}') AS words FROM conversations WHERE role = 'user'),
f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS step, []::VARCHAR[] AS items FROM conversations
  UNION ALL
  SELECT f.conv_id, f.step + 1, CASE WHEN len({NEW_WORD}) > 0 THEN list_append(f.items, {NEW_WORD}[1]) ELSE f.items END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.step = f.step + 1)
SELECT conv_id, step::INTEGER AS turns_done, len(items)::INTEGER AS num_extractions, array_to_string(items, '|') AS items, true AS finished
FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY step DESC) = 1""")
def model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's fold over all conversations: two steps beside a busy server, then resumed to the end.

    What a turn adds depends on the registry so far.
    """
    root, talks = fresh_folder(spark), contexts(spark, sf_dir).select("conv_id", "messages")
    fold = ModelExtraction(spark, root, CallStore(spark, f"{root}/calls"), {"conv_id": "long"})
    fold.run(talks, "flaky:50:stub_extractor", model="stub_extractor", most_steps=2)
    done = fold.run(talks, "stub_extractor")
    return done.select("conv_id", "turns_done", "num_extractions", F.array_join(F.transform("registry", lambda x: x["text"]), "|").alias("items"), "finished")


@query(f"""{_pairs_sql()}, c AS (SELECT unnest(['full_with_sssc', 'full_without_sssc', 'compacted']) AS condition)
SELECT source_row_index, sssc_id, condition, {_ANSWER} = CASE WHEN swapped THEN 'B' ELSE 'A' END AS compliant, 'success' AS status,
  CASE WHEN ('0x' || substr(md5(prompt), 1, 8))::BIGINT % 50 = 0 THEN 2 ELSE 1 END::INTEGER AS attempts FROM pr, c""")
def resumed_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass in which one call in fifty fails, and one that asks for those alone; no nulls are left."""
    root, rows, cases = fresh_folder(spark), pairs_of(spark, sf_dir), (*FULL, "compacted")
    run = ConditionRun(spark, root, CallStore(spark, f"{root}/calls"))
    run.step(rows, compactor("recent_4"), "flaky:50:stub_letter", "stub_judge", ("stub_letter", None), cases, retention=False)
    run.step(rows, compactor("recent_4"), "stub_letter", "stub_judge", cases=cases, retention=False)
    return run.latest().select("source_row_index", "sssc_id", "condition", F.col("verdict").alias("compliant"), "status", "attempts")


@query(f"""{_pairs_sql()}, n AS (SELECT 2 * count(*) AS conditions, 2 * count(DISTINCT (m::VARCHAR, sssc_id, swapped)) AS talks FROM pr)
SELECT compactor, conditions AS n_conditions, CASE WHEN compactor = 'recent_2' THEN talks ELSE 0 END AS n_calls
FROM n, (SELECT unnest(['recent_2', 'recent_4', 'recent_6', 'extract_3']) AS compactor)""")
def shared_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four compactors' runs over one store: the conditions that no compactor changes are asked once."""
    root, rows = fresh_folder(spark), pairs_of(spark, sf_dir)
    store, out, before = CallStore(spark, f"{root}/calls"), None, 0
    for name in ("recent_2", "recent_4", "recent_6", "extract_3"):
        run = ConditionRun(spark, f"{root}/{name}", store)
        run.step(rows, compactor(name), "stub_letter", "stub_judge", cases=FULL, retention=False)
        now = store.read().count()
        counted = run.latest().filter("verdict is not null").agg(F.count("*").alias("n_conditions")).select(F.lit(name).alias("compactor"), "n_conditions", F.lit(now - before).cast("long").alias("n_calls"))
        out, before = counted if out is None else out.unionByName(counted), now
    return out


_JUDGED = f"""{_pairs_sql()}, w AS (SELECT pr.*, '{EXPLICIT_HARD}' || lower(substr(cat.sssc, 1, 1)) || substr(cat.sssc, 2) AS w, len(m) AS n FROM pr JOIN cat ON cat.id = pr.sssc_id),
j AS (SELECT *, 'Instruction:' || chr(10) || w || chr(10) || chr(10) || 'Context:' || chr(10) || array_to_string(list_transform(range(greatest(n - 1, 1), n + 1),
  lambda i: m[i].role || ':' || chr(10) || CASE WHEN u[1] = i - 1 THEN w || chr(10) ELSE '' END || m[i].content), chr(10) || chr(10)) AS asked FROM w)"""


@query(f"""{_JUDGED} SELECT source_row_index, sssc_id, compliant_letter, length(asked) > 400 AS retention, 'success' AS compaction_status,
  CASE WHEN ('0x' || substr(md5(asked), 1, 8))::BIGINT % 50 = 0 THEN 2 ELSE 1 END::INTEGER AS retention_attempts FROM (SELECT *, CASE WHEN swapped THEN 'B' ELSE 'A' END AS compliant_letter FROM j)""")
def judged_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every compacted context judged for its instruction; what a busy judge left open is judged in a second pass."""
    root, rows = fresh_folder(spark), pairs_of(spark, sf_dir)
    run = ConditionRun(spark, root, CallStore(spark, f"{root}/calls"))
    run.step(rows, compactor("recent_2"), "stub_letter", "flaky:50:stub_judge", (None, "stub_judge"), cases=("compacted",))
    done = run.step(rows, compactor("recent_2"), "stub_letter", "stub_judge", cases=("compacted",))
    return done.select("source_row_index", "sssc_id", "compliant_letter", "retention", "compaction_status", "retention_attempts")


@query()
def token_classifier_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token classifier held out: every text is rated by the weights of the other fold, beside its rarest tokens.

    A token counts as kept where its turn's first sentence has it.  ``hits``: kept ones
    among as many best rated tokens; ``rare_hits``: among as many rarest ones.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    folds = [turns.filter(F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == fold) for fold in (0, 1)]
    rows = [tokenclass.labelled(fold, F.col("text"), first_sentence(F.col("text"))) for fold in folds]
    weights = [tokenclass.train(r) for r in rows]
    out = None
    for fold, r in enumerate(rows):
        hits = tokenclass.ranked_hits(r, weights[1 - fold]).agg(F.sum("n").alias("n_kept"), F.sum("hits").alias("hits"))
        named = r.filter(F.size("tokens") > 0).withColumn("id", F.monotonically_increasing_id())
        each = named.select("id", F.posexplode(F.arrays_zip("tokens", "kept")).alias("at", "x")).select("id", "at", F.lower("x.tokens").alias("word"), F.col("x.kept").cast("int").alias("kept"))
        listed = each.groupBy("id", "word").agg(F.collect_list(F.struct("at", "kept")).alias("places"))
        spread = listed.groupBy("word").agg(F.count("*").alias("df"))
        rated = F.transform("places", lambda x: F.struct(F.col("df").alias("df"), x["at"].alias("at"), x["kept"].alias("kept")))
        whole = listed.join(spread, "word").groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(rated))).alias("a"))
        total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x["kept"])
        rare = whole.select(total(F.slice("a", 1, total("a"))).alias("n")).agg(F.sum("n").alias("rare_hits"))
        one = hits.crossJoin(rare).select(F.lit(fold).alias("fold"), "n_kept", "hits", "rare_hits")  # one row each
        out = one if out is None else out.unionByName(one)
    return out
