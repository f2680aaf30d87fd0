"""An evaluation run as a log of conditions: what failed or cannot be read is run again, alone.

A run keeps two logs: its compacted contexts, made once for each pair so that all
conditions and all later passes see the same, and its conditions in long form, a row for
each attempt.  A pass asks only for the conditions without a good row; the result table
is the last good row of each (pair, condition), with the status and the attempts beside it.
Calls go through a store (``calls.CallStore``), so the conditions that do not depend on the
compactor are asked once for all compactors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.grading import graded_text, letter_grade, yes_no
from palimpsest.functions.messages import MESSAGES, message, rendered
from palimpsest.operators import constraints as C
from palimpsest.operators.calls import CallStore, PartedLog
from palimpsest.operators.common import beside
from palimpsest.operators.compactors import Compactor, compaction
from palimpsest.operators.phases import CASES, KEYS, case_context, compacted

RETENTION = "retention"
CONTEXTS = f"source_row_index long, sssc_id int, compacted_context {MESSAGES}, tokens_before int, tokens_after int, compaction_status string, compaction_error string"
CONDITIONS = "source_row_index long, sssc_id int, condition string, output string, verdict boolean, status string, error string, attempt int"


class ConditionRun:
    """A run below ``root``: its contexts, its conditions, and the store of calls it shares."""

    def __init__(self, spark: SparkSession, root: str, store: CallStore):
        self.spark, self.store = spark, store
        self.contexts = PartedLog(spark, f"{root}/contexts", CONTEXTS)
        self.log = PartedLog(spark, f"{root}/conditions", CONDITIONS)

    def compact(self, rows: DataFrame, compactor: Compactor, needed: bool = True) -> DataFrame:
        """``rows`` with their contexts, where those are ``needed``; only pairs without a good one are compacted."""
        done = self.contexts.read().filter("compaction_status = 'success'").select(*KEYS).distinct().withColumn("done", F.lit(True))
        todo = beside(rows, done, KEYS, "__done").filter("__done is null").drop("__done") if self.contexts.parts() else rows
        if hasattr(compactor, "contexts"):
            made = todo.join(compactor.contexts(todo, self.store, KEYS), list(KEYS)).withColumn("stats", compaction(F.col("injected"), F.col("compacted_context")))
        else:
            made = compacted(todo, compactor)
        failed = F.col("compacted_context").isNull()
        status = {"compaction_status": F.when(failed, "error").otherwise("success"), "compaction_error": F.when(failed, "no context was made")}
        self.contexts.append(made.select("*", "stats.tokens_before", "stats.tokens_after").withColumns(status))
        if not needed:
            return rows
        # all contexts of a row meet its pairs: neighbours in the log, much alike, that shuffle as little more than one
        row, *rest = KEYS
        fields = ("compacted_context", "tokens_before", "tokens_after", "compaction_status", "compaction_error")
        listed = self.contexts.read().groupBy(row).agg(F.collect_list(F.struct(*rest, *fields)).alias("__contexts"))
        mine = F.filter("__contexts", lambda x: x["sssc_id"] == F.col("sssc_id"))
        good = F.filter(mine, lambda x: x["compaction_status"] == "success")
        found = rows.join(listed, row).withColumn("c", F.coalesce(F.get(good, F.lit(0)), F.get(mine, F.lit(0)))).filter("c is not null").drop("__contexts")
        return found.select("*", *[F.col(f"c.{f}").alias(f) for f in fields]).drop("c")

    def latest(self) -> DataFrame:
        """A row for each pair and condition: the last good one, else the last."""
        good = (F.col("status") == "success") & F.col("verdict").isNotNull()
        best = F.max_by(F.struct("output", "verdict", "status", "error"), F.struct(good, "attempt")).alias("b")
        return self.log.read().groupBy(*KEYS, "condition").agg(best, F.max("attempt").alias("attempts")).select(*KEYS, "condition", "b.*", "attempts")

    def asked(self, work: DataFrame, cases: Sequence[str], retention: bool) -> DataFrame:
        """``keys, condition, compliant_letter, talk`` of everything to be asked."""
        talks = [F.struct(F.lit(c).alias("condition"), F.concat(case_context(c)[0], F.array(message("user", case_context(c)[1]))).cast(MESSAGES).alias("talk")) for c in cases]
        if retention:
            prompt = C.judge_prompt(F.col("wrapped"), rendered(F.col("compacted_context")))
            talk = F.when(F.col("compacted_context").isNotNull(), F.array(message("system", prompt["system"]), message("user", prompt["user"])).cast(MESSAGES))
            talks.append(F.struct(F.lit(RETENTION).alias("condition"), talk.alias("talk")))
        long = work.select(*KEYS, "compliant_letter", F.explode(F.array(*talks)).alias("t")).select(*KEYS, "compliant_letter", "t.condition", "t.talk")
        return long.filter("talk is not null")

    def step(self, rows: DataFrame, compactor: Compactor, prober: str, judge: str, models: tuple[str | None, str | None] = (None, None), cases: Sequence[str] = CASES, retention: bool = True) -> DataFrame:
        """One pass over what is open; gives the wide table of all pairs.

        ``models``: what the prober's and the judge's calls are stored as, where that is not the provider's name.
        """
        work = self.compact(rows, compactor, retention or any(c not in CASES[:2] for c in cases))
        before = self.latest().select(*KEYS, "condition", F.col("attempts").alias("__before"), ((F.col("status") == "success") & F.col("verdict").isNotNull()).alias("__good"), (F.col("status") == "success").alias("__unread"))
        asked = self.asked(work, cases, retention)
        asked = beside(asked, before, [*KEYS, "condition"], "__b").select("*", "__b.__before", "__b.__good", "__b.__unread") if self.log.parts() else asked.withColumns({"__before": F.lit(0), "__good": F.lit(False), "__unread": F.lit(False)})
        todo = asked.filter("not coalesce(__good, false)").withColumn("attempt", F.coalesce("__before", F.lit(0)) + 1)
        ids = [*KEYS, "condition", "compliant_letter", "attempt"]
        sides = [(prober, models[0], F.col("condition") != RETENTION, letter_grade(graded_text(F.col("output")), F.col("compliant_letter")))]
        if retention:
            sides.append((judge, models[1], F.col("condition") == RETENTION, yes_no(F.col("output"))))
        made = None
        for provider, model, mine, verdict in sides:
            answers = self.store.answered(todo.filter(mine), provider, "talk", ids, model, again=F.coalesce("__unread", F.lit(False)), unique=(*KEYS, "condition")).withColumn("verdict", verdict)
            made = answers if made is None else made.unionByName(answers)
        self.log.append(made)
        return self.wide(rows, cases)

    def wide(self, rows: DataFrame, cases: Sequence[str] = CASES) -> DataFrame:
        """The result table: one row a pair, each condition's answer, verdict, status and attempts side by side."""
        of = lambda condition, field: F.max(F.when(F.col("condition") == condition, F.col(field)))
        columns = [of(c, f).alias(f"{c}_{'compliant' if f == 'verdict' else f}") for c in cases for f in ("output", "verdict", "status", "attempts")]
        columns += [of(RETENTION, "verdict").alias("retention"), of(RETENTION, "output").alias("retention_raw"), of(RETENTION, "status").alias("retention_status"), of(RETENTION, "attempts").alias("retention_attempts")]
        cells = self.latest().groupBy(*KEYS).agg(*columns)
        kept = self.contexts.read().groupBy(*KEYS).agg(F.max_by(F.struct("tokens_before", "tokens_after", "compaction_status", "compaction_error"), F.col("compaction_status") == "success").alias("c"))
        return rows.select(*KEYS, "sssc_type", "sssc_attrs", "compliant_letter").join(kept.select(*KEYS, "c.*"), list(KEYS), "left").join(cells, list(KEYS), "left")
