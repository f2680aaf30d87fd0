"""The evaluation as DataFrame phases: pairs, probes, compaction, judging, re-runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.grading import graded_text, json_verdict, letter_grade, yes_no
from palimpsest.functions.messages import MESSAGES, message, rendered
from palimpsest.functions.text import draw
from palimpsest.operators import constraints as C
from palimpsest.operators.compactors import Compactor, compaction
from palimpsest.operators.runtimes import generated
from palimpsest.operators.sampling import pending, upsert

KEYS = ("source_row_index", "sssc_id")
CASES = ("full_with_sssc", "full_without_sssc", "compacted", "compacted_post_sssc")


def pairs(spark: SparkSession, dataset: DataFrame, position: str = "top", repeat: int = 1, explicit: bool = True, hard: bool = True) -> DataFrame:
    """Every context with every constraint: wrapped text, injected context, probe and letter."""
    # contexts are small and their pairs are not: they are dealt before they are crossed, and stay by their row
    dealt = dataset.select("source_row_index", "messages").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_row_index")
    crossed = dealt.crossJoin(C.catalogue(spark).withColumnRenamed("id", "sssc_id"))
    wrapped = C.framed(F.col("sssc"), F.lit(explicit), F.lit(hard))
    row, cid = F.col("source_row_index"), F.col("sssc_id")
    probe = C.choice_probe(F.col("probe"), F.col("correct_answer"), F.col("incorrect_answer"), draw("swap", row, cid) < 0.5)
    attrs = F.struct(F.lit(position).alias("position"), F.lit(repeat).alias("repeat"), F.lit(explicit).alias("explicitness"), F.lit(hard).alias("hard"))
    made = crossed.withColumn("wrapped", wrapped).withColumn("question", probe)
    return made.select(
        *KEYS, F.col("type").alias("sssc_type"), "wrapped", attrs.alias("sssc_attrs"), F.col("question.prompt").alias("probe_prompt"), F.col("question.letter").alias("compliant_letter"),
        "messages", C.injected(F.col("messages"), C.targets(F.col("messages"), F.lit(position), F.lit(repeat), row, cid), F.col("wrapped")).alias("injected"),
    )


def of_constraints(rows: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The rows of chosen constraints; an id that no constraint has is an error."""
    unknown = set(ids) - {c.id for c in C.CATALOGUE}
    if unknown:
        raise ValueError(f"no constraints {sorted(unknown)}")
    return rows.filter(F.col("sssc_id").isin(*ids))


def retention_only(rows: DataFrame) -> DataFrame:
    """Pairs with the probe conditions left empty."""
    empty = {f"{c}_{f}": F.lit(None).cast("string" if f == "output" else "boolean") for c in CASES[:2] for f in ("output", "compliant")}
    return rows.withColumns(empty)


def compacted(rows: DataFrame, compactor: Compactor) -> DataFrame:
    made = rows.withColumn("compacted_context", compactor.compact(F.col("injected"))).withColumn("stats", compaction(F.col("injected"), F.col("compacted_context")))
    return made.withColumn("compaction_status", F.lit("success")).withColumn("compaction_error", F.lit(None).cast("string"))


def case_context(case: str) -> tuple[Column, Column]:
    """The context a case is probed in, and its last user turn."""
    context = {"full_with_sssc": F.col("injected"), "full_without_sssc": F.col("messages")}.get(case, F.col("compacted_context"))
    probe = C.post_turn(F.col("wrapped"), F.col("probe_prompt")) if case == "compacted_post_sssc" else F.col("probe_prompt")
    return context, probe


def probed(rows: DataFrame, provider: str, cases: Sequence[str] = CASES) -> DataFrame:
    """``keys, case, output, compliant, status``: the cases side by side, one row each, graded."""
    talks = F.array(*[F.struct(F.lit(c).alias("case"), F.concat(case_context(c)[0], F.array(message("user", case_context(c)[1]))).cast(MESSAGES).alias("talk")) for c in cases])
    asked = rows.select(*KEYS, "compliant_letter", F.explode(talks).alias("t")).select(*KEYS, "compliant_letter", "t.case", "t.talk")
    answers = generated(asked, provider, "talk", [*KEYS, "compliant_letter", "case"])
    return answers.withColumn("compliant", letter_grade(graded_text(F.col("output")), F.col("compliant_letter")))


def judged(rows: DataFrame, provider: str) -> DataFrame:
    """``keys, retention, retention_raw``: unreadable judgments are null, and the raw text is kept."""
    prompt = C.judge_prompt(F.col("wrapped"), rendered(F.col("compacted_context")))
    asked = rows.filter("compacted_context is not null").select(*KEYS, F.array(message("system", prompt["system"]), message("user", prompt["user"])).alias("talk"))
    return generated(asked, provider, "talk", KEYS).select(*KEYS, yes_no(F.col("output")).alias("retention"), F.col("output").alias("retention_raw"))


def wide(rows: DataFrame, answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The result table: one row a pair with all its cases."""
    cells = answers.groupBy(*KEYS).agg(*[F.max(F.when(F.col("case") == c, F.col(f))).alias(f"{c}_{f}") for c in CASES for f in ("output", "compliant")])
    kept = rows.select(*KEYS, "sssc_type", "sssc_attrs", "compliant_letter", "compaction_status", "compaction_error", "stats.tokens_before", "stats.tokens_after")
    return kept.join(cells, list(KEYS), "left").join(verdicts, list(KEYS), "left")


def evaluated(rows: DataFrame, compactor: Compactor, prober: str, judge: str, done: DataFrame | None = None) -> DataFrame:
    """All phases for the pairs without a result yet; earlier results are kept."""
    work = compacted(rows if done is None else pending(rows, done, KEYS), compactor)
    made = wide(work, probed(work, prober), judged(work, judge))
    return made if done is None else upsert(done, made, KEYS)


def reprobed(rows: DataFrame, provider: str, cases: Sequence[str] = CASES) -> DataFrame:
    """Fixed contexts, another prober: the answers' columns anew, in long form."""
    return probed(rows, provider, cases).withColumnRenamed("compliant", "reprobed_compliant")


def regraded_generations(generations: DataFrame, judge: str) -> DataFrame:
    """``keys, case, verdict``: free answers judged as true, false or not enough information."""
    talk = F.array(message("system", F.lit('Does the answer follow the instruction? Reply {"verdict": ...}.')), message("user", F.concat(F.col("wrapped"), F.lit("\n\n"), F.col("output"))))
    asked = generations.select(*KEYS, "case", talk.alias("talk"))
    return generated(asked, judge, "talk", [*KEYS, "case"]).withColumn("verdict", json_verdict(F.col("output")))


def rejudged(results: DataFrame, verdicts: DataFrame, new_run_id: str) -> DataFrame:
    """A copy under a new run id with another judge's two columns."""
    return results.drop("retention", "retention_raw").join(verdicts, list(KEYS), "left").withColumn("run_id", F.lit(new_run_id))


def prompt_pairs(baseline: DataFrame, targeted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two runs side by side on the same pairs, columns prefixed."""
    side = lambda df, name: df.select(*KEYS, *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return side(baseline, "baseline").join(side(targeted, "targeted"), list(KEYS))
