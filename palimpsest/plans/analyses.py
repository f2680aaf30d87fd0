"""Analyses of an evaluation: each makes its own named tables from the facts.

``settings`` names what an analysis compares: ``runs``, ``left``, ``right``, ``focal``, ``home``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.stats import few_valued_interval
from palimpsest.functions.text import config_label, context_tokens, family
from palimpsest.operators import metrics as A
from palimpsest.operators import reports

Tables = dict[str, DataFrame]


def main_experiment(facts: DataFrame, settings: dict) -> Tables:
    return {"headline": A.headline(facts), "per_run": A.per_run(facts), "grouping_sets": A.grouping_sets(facts), "by_compactor": A.retention_by(facts, "compactor"), "null_cases": A.null_cases(facts)}


def compact_rate(facts: DataFrame, settings: dict) -> Tables:
    return {"compression": A.compression(facts), "summary_length": A.summary_length(facts)}


def compliance_decomposition(facts: DataFrame, settings: dict) -> Tables:
    groups = A.four_groups(facts)
    compliant = A.success(facts).withColumn("v", F.col("compacted").cast("int"))
    return {
        "four_groups": groups, "decomposition": A.decomposition(groups), "compliance_ci": few_valued_interval(compliant, ["compactor"], "v", (0, 1), 2000, seed="mean"),
        "paired_loss": A.paired_loss(facts), "confusion": A.confusion(facts), "complied_without": A.complied_without(facts),
    }


def input_size(facts: DataFrame, settings: dict) -> Tables:
    sized = facts.withColumn("context_tokens", context_tokens(F.col("dataset"))).withColumn("source", config_label(F.col("dataset")))
    return {"by_length": A.retention_by(sized, "context_tokens"), "by_source_and_length": A.retention_by(sized, "source", "context_tokens"), "by_compactor_and_length": A.retention_by(sized, "compactor", "context_tokens")}


def framing(facts: DataFrame, settings: dict) -> Tables:
    summary = A.group_local(facts.filter("position = 'top' and repeat = 1"), "dataset", "compactor", "explicit", "hard")
    return {"framing": summary, **{f"framing_{v}": reports.framing_table(summary, v) for v in ("retention", "compacted", "effect_retention")}}


def constraint_types(facts: DataFrame, settings: dict) -> Tables:
    by_set = A.retention_by(facts, "sssc_type", "dataset")
    collapsed = by_set.groupBy("sssc_type").agg((F.sum("n_retained") / F.sum("n_rows")).alias("micro_rate"), F.avg(F.col("n_retained") / F.col("n_rows")).alias("macro_rate"))
    return {"by_type": A.retention_by(facts, "sssc_type"), "by_type_and_dataset": by_set, "by_type_and_compactor": A.retention_by(facts, "compactor", "sssc_type"), "collapsed": collapsed}


def positions(facts: DataFrame, settings: dict) -> Tables:
    pairs = A.stability_pairs(facts)
    return {"by_position": A.retention_by(facts, "dataset", "position"), "by_compactor_and_position": A.retention_by(facts, "compactor", "position"), "stability": A.stability_summary(pairs)}


def repeats(facts: DataFrame, settings: dict) -> Tables:
    return {"repeat": A.group_local(facts.filter("explicit and hard"), "dataset", "compactor", "repeat")}


def style_match(facts: DataFrame, settings: dict) -> Tables:
    focal, home = settings["focal"], settings["home"]
    return {"cells": A.cells(facts), "residuals": A.additive_residuals(facts), "home_field": A.home_field(facts, focal, home), "home_field_ci": A.home_field_interval(facts, focal, home)}


def prober_swap(facts: DataFrame, settings: dict) -> Tables:
    runs = settings["runs"]
    return {"probers": A.prober_table(facts, runs, settings.get("reference", runs[0])), "pairwise": A.pairwise_runs(facts, runs)}


def prompt_targeting(facts: DataFrame, settings: dict) -> Tables:
    left, right = settings["left"], settings["right"]
    return {"paired": A.paired_metrics(facts, left, right), "rates": A.prompt_pair_rates(facts, left, right), "delta_ci": A.clustered_delta(facts, left, right)}


def condition_contrasts(facts: DataFrame, settings: dict) -> Tables:
    tables = {"contrasts": A.contrasts(facts)}
    if {"verdict", "compliant"} <= set(facts.columns):  # free generations were judged too
        tables |= {"generative": A.generative_agreement(facts, "compactor"), "relationship": A.retention_relationship(facts)}
    return tables


def judge_families(facts: DataFrame, settings: dict) -> Tables:
    """``settings``: ``second``, another judge's column, and ``markers`` of families in run ids."""
    second, markers = settings["second"], tuple(map(tuple, settings["markers"]))
    tagged = A.success(facts).withColumn("family", family(F.col("run_id"), markers))
    return {"families": A.agreement_by(tagged, "retention", second, "family"), "by_run": A.rejudge_report(tagged, "retention", second)}


#: Name, function, and the settings it needs.
ANALYSES: dict[str, tuple[Callable[[DataFrame, dict], Tables], tuple[str, ...]]] = {
    "main_experiment": (main_experiment, ()),
    "compact_rate": (compact_rate, ()),
    "compliance_decomposition": (compliance_decomposition, ()),
    "input_size": (input_size, ()),
    "framing": (framing, ()),
    "constraint_types": (constraint_types, ()),
    "positions": (positions, ()),
    "repeats": (repeats, ()),
    "condition_contrasts": (condition_contrasts, ()),
    "style_match": (style_match, ("focal", "home")),
    "prober_swap": (prober_swap, ("runs",)),
    "prompt_targeting": (prompt_targeting, ("left", "right")),
    "judge_families": (judge_families, ("second", "markers")),
}


def tables_of(facts: DataFrame, names: list[str] | None, settings: dict) -> dict[str, Tables]:
    """The tables of the named analyses; without names, of all whose settings are given."""
    for name in names or ():
        if name not in ANALYSES:
            raise ValueError(f"no analysis {name}; there are {', '.join(ANALYSES)}")
        if missing := [s for s in ANALYSES[name][1] if s not in settings]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
    chosen = names or [n for n, (_, needs) in ANALYSES.items() if all(s in settings for s in needs)]
    return {name: ANALYSES[name][0](facts, settings) for name in chosen}
