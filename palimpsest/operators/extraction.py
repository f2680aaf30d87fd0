"""Online constraint extraction: a registry that grows turn by turn.

By rules (``registry``) it is one column; by a model (``ModelExtraction``) it is a fold in
lock step: at each step every pair whose last call was good asks about its next user turn
with the registry so far, all pairs' calls together.  Each step's turns are logged, so a run
that broke off, or a call that failed, is taken up where the pair stands.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.grading import extracted_constraints
from palimpsest.functions.messages import MESSAGES, message, numbered, total_tokens
from palimpsest.operators.calls import CallStore, PartedLog
from palimpsest.operators.common import checkpointed
from palimpsest.operators.constraints import EXPLICIT, EXPLICIT_HARD, HARD, extractor_prompt

#: The rule detector finds framed sentences; a model's output is parsed by ``grading`` instead.
DETECTOR = "(?:" + "|".join(re.escape(p) for p in (EXPLICIT_HARD, EXPLICIT, HARD)) + r")[^.\n]*\."
REGISTRY = "array<struct<text: string, evidence: string, source_turn_index: int>>"


def detected(content: Column) -> Column:
    """Framed sentences of a user turn, in order."""
    return F.regexp_extract_all(content, F.lit(DETECTOR), 0)


def registry(messages: Column) -> Column:
    """The fold over user turns in order: new texts are added once, with the turn they came from."""
    turns = F.filter(F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), m["content"].alias("content"))), lambda t: t["role"] == "user")

    def add(state: Column, turn: Column) -> Column:
        known = F.transform(state, lambda s: s["text"])
        fresh = F.filter(F.array_distinct(detected(turn["content"])), lambda x: ~F.array_contains(known, x))
        return F.concat(state, F.transform(fresh, lambda x: F.struct(x.alias("text"), turn["content"].alias("evidence"), turn["i"].cast("int").alias("source_turn_index"))))

    return F.aggregate(turns, F.array().cast(REGISTRY), add)


def registry_text(items: Column) -> Column:
    return numbered(F.transform(items, lambda x: x["text"]))


def augmented(context: Column, items: Column) -> Column:
    """A compacted context with the running list as a last user message."""
    return F.concat(context, F.array(message("user", registry_text(items))))


def user_steps(rows: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    """``keys, step, turn_index, turn, previous``: a row a user turn, with the assistant turn before it."""
    m = F.col(messages)
    places = F.filter(F.transform(m, lambda x, i: F.when(x["role"] == "user", i)), lambda i: i.isNotNull())
    at = rows.select(*keys, messages, F.posexplode(places).alias("step", "turn_index"))
    before = F.filter(F.slice(m, F.lit(1), F.col("turn_index")), lambda x: x["role"] == "assistant")
    return at.select(*keys, "step", "turn_index", F.get(m, F.col("turn_index"))["content"].alias("turn"), F.try_element_at(before, F.lit(-1))["content"].alias("previous"))


class ModelExtraction:
    """A model's registries of many pairs, by steps; ``root`` keeps the log of turns.

    The log is the state: a pair's registry is what its good turns added, in order, and
    its next step is the number of those.  A pair whose call fails stands still until the
    next run.  Pairs leave when their turns are through, so later steps hold fewer rows.
    """

    def __init__(self, spark: SparkSession, root: str, store: CallStore, keys: dict[str, str]):
        self.keys, self.store = list(keys), store
        names = ", ".join(f"{k} {kind}" for k, kind in keys.items())
        self.turns = PartedLog(spark, f"{root}/turns", f"{names}, step int, turn_index int, raw_output string, added array<struct<text: string, evidence: string>>, status string, error string")

    def good_turns(self) -> DataFrame:
        return self.turns.read().filter("status = 'success'").dropDuplicates([*self.keys, "step"])

    def state(self) -> DataFrame:
        """``keys, done, registry``: how many turns are through, and what they added, in order."""
        added = F.transform("added", lambda x: F.struct(x["text"].alias("text"), x["evidence"].alias("evidence"), F.col("turn_index").alias("source_turn_index")))
        listed = self.good_turns().select(*self.keys, F.struct("step", added.alias("items")).alias("t")).groupBy(*self.keys).agg(F.count("*").cast("int").alias("done"), F.array_sort(F.collect_list("t")).alias("ts"))
        return listed.select(*self.keys, "done", F.flatten(F.transform("ts", lambda t: t["items"])).cast(REGISTRY).alias("registry"))

    def run(self, rows: DataFrame, provider: str, model: str | None = None, messages: str = "messages", most_steps: int | None = None) -> DataFrame:
        """Take every pair as far as its calls succeed (or ``most_steps`` further); gives ``results``."""
        steps = checkpointed(user_steps(rows, self.keys, messages))
        empty = F.array().cast(REGISTRY)
        start = steps.select(*self.keys).distinct().join(self.state(), self.keys, "left")
        now = checkpointed(start.select(*self.keys, F.coalesce("done", F.lit(0)).alias("step"), F.coalesce("registry", empty).alias("registry")))
        taken = 0
        while most_steps is None or taken < most_steps:
            active = checkpointed(now.join(steps, [*self.keys, "step"]))
            if active.isEmpty():
                break
            prompt = extractor_prompt(registry_text(F.col("registry")), F.col("previous"), F.coalesce("turn", F.lit("")))
            talk = F.array(message("system", prompt["system"]), message("user", prompt["user"])).cast(MESSAGES)
            answers = self.store.answered(active.select(*self.keys, "step", talk.alias("talk")), provider, "talk", [*self.keys, "step"], model)
            joined = active.join(answers, [*self.keys, "step"])
            known = F.transform("registry", lambda x: x["text"])
            items = F.filter(extracted_constraints(F.trim(F.col("output"))), lambda x: ~F.array_contains(known, x["text"]))
            # the first of the items that repeat a text
            fresh = F.filter(items, lambda x, i: F.array_position(F.transform(items, lambda y: y["text"]), x["text"]) == i + 1)
            seen = checkpointed(joined.select(*self.keys, "step", "turn_index", "registry", F.col("output").alias("raw_output"), F.when(F.col("status") == "success", fresh).alias("added"), "status", "error"))
            self.turns.append(seen)
            grown = F.concat("registry", F.transform("added", lambda x: F.struct(x["text"].alias("text"), x["evidence"].alias("evidence"), F.col("turn_index").alias("source_turn_index"))))
            now = seen.filter("status = 'success'").select(*self.keys, (F.col("step") + 1).alias("step"), grown.cast(REGISTRY).alias("registry"))
            taken += 1
        return self.results(rows, messages)

    def results(self, rows: DataFrame, messages: str = "messages") -> DataFrame:
        """``keys, registry, registry_text, num_extractions, turns_done, finished`` of all pairs."""
        users = F.size(F.filter(messages, lambda m: m["role"] == "user"))
        found = rows.select(*self.keys, users.alias("users")).join(self.state(), self.keys, "left")
        items = F.coalesce("registry", F.array().cast(REGISTRY))
        done = F.coalesce("done", F.lit(0))
        return found.select(*self.keys, items.alias("registry"), registry_text(items).alias("registry_text"), F.size(items).alias("num_extractions"), done.alias("turns_done"), (done >= F.col("users")).alias("finished"))


def extraction_stats(rows: DataFrame, items: str = "registry", verdict: str = "retention") -> DataFrame:
    """Items and tokens of the registries, and the rate over judged rows."""
    text = registry_text(F.col(items))
    counted = rows.select(F.size(items).alias("n"), total_tokens(F.array(message("user", text))).alias("t"), F.col(verdict).cast("double").alias("v"))
    return counted.agg(*[f(c).alias(f"{name}_{label}") for c, label in (("n", "items"), ("t", "tokens")) for f, name in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))], F.avg("v").alias("retention_rate"), F.count("v").alias("n_judged"))
