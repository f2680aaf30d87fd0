"""Jobs: build a dataset, evaluate it, analyse runs.  ``python -m palimpsest.plans.jobs <job> <config.json>``."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.messages import MESSAGES, embedding_text, total_tokens, user_turns
from palimpsest.functions.text import hashed_vector
from palimpsest.operators import extraction as E
from palimpsest.operators import phases, runs
from palimpsest.operators import stitching as K
from palimpsest.operators.common import released, row_index
from palimpsest.operators.calls import CallStore
from palimpsest.operators.compactors import compactor
from palimpsest.operators.conditions import ConditionRun
from palimpsest.plans.analyses import tables_of
from palimpsest.sources import readers, writers
from palimpsest.sources.snapshots import SnapshotTable

#: A pair of trimmed halves is built for this target, as one context seldom reaches it.
PAIRED_TARGET = 220_000
#: Numbers of a hashed vector, where a dataset brings no vectors of a model.
VECTOR_WIDTH = 256


def generate_dataset(spark: SparkSession, config: dict) -> DataFrame:
    """Read a source, stitch it to a target length, save it once, and write its manifest.

    ``method``: trim, vanilla or topic.  Topic stitching compares the vectors of ``vectors``
    (conv_id, embedding; conv_id counts the source's rows from 0 in its files' order), or
    hashed token counts where none are given; ``pool`` names a column of ``vectors``
    whose values are stitched apart.
    """
    target, rows = int(config["target_size"]), 5 if config.get("test") else config.get("num_convo")
    source = readers.in_file_order(readers.read_source(spark, config["root"], config["dataset"]), "conv_id")
    if config["method"] == "trim" and target == PAIRED_TARGET:
        made = K.paired_rows(source, target // 2)
    elif config["method"] == "trim":
        made = row_index(K.trimmed_rows(source, target, num_rows=rows), ["conv_id"]).withColumn("source_conversation_count", F.lit(1))
    else:
        one_system = "hermes" in config["dataset"]
        sizes = K.stitching_lengths(source, one_system)
        if config["method"] == "vanilla":
            placed = K.concatenated(sizes, target, num_rows=rows)
        else:
            if "vectors" in config:
                vectors = spark.read.parquet(config["vectors"]).withColumnRenamed("conv_id", "vec_id")
            else:
                vectors = source.select(F.col("conv_id").alias("vec_id"), hashed_vector(embedding_text(F.col("messages")), VECTOR_WIDTH).alias("embedding"))
            placed = row_index(K.topic_cohesive(sizes, vectors, target, pool=config.get("pool"), rows=rows), ["pool", "row"])
        lists = K.stitched_messages(placed, source, one_system=one_system)
        counts = placed.select("source_row_index", F.size("sources").alias("source_conversation_count"))
        made = counts.join(lists, "source_row_index", "left").withColumn("messages", F.coalesce("messages", F.array().cast(MESSAGES)))  # a row may be cropped to nothing
        made = made.withColumn("token_length", total_tokens(F.col("messages")))
    if rows is not None:
        made = made.filter(F.col("source_row_index") < rows)
    saved = writers.write_dataset(made, config["out"])
    writers.write_json(spark, writers.generation_manifest(config["dataset"], bool(config.get("test")), rows or saved.count(), target, config["method"]), config["out"] + ".manifest.json")
    return saved


def dataset_summary(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Tokens, turns, user turns and sources by dataset, longest names last."""
    out = None
    for name, path in paths.items():
        rows = readers.read_dataset(spark, path)
        one = rows.agg(
            F.count("*").alias("n_rows"), F.avg("token_length").alias("avg_tokens"), F.avg(F.size("messages")).alias("avg_turns"),
            F.avg(F.size(user_turns(F.col("messages")))).alias("avg_users"), F.avg("source_conversation_count").alias("avg_sources"),
        ).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(spark: SparkSession, config: dict) -> list[str]:
    """Run every expected run of a configuration on its datasets.

    Only conditions without a readable answer are run, and calls that any run of the same
    root has made are not made again.  ``snapshots``: a table that every run's rows are
    committed to as well, for readers who must not see a table while it is replaced.
    """
    done = []
    for run in runs.expected_runs(config):
        spec, root = run["spec"], runs.results_dir(config["root"], bool(config.get("test")))
        attrs = spec["sssc_attrs"]
        data = readers.read_dataset(spark, spec["dataset"]["path"], spec["dataset"].get("rows"), bool(config.get("test")))
        work = phases.pairs(spark, data, attrs.get("position", "top"), attrs.get("repeat", 1), attrs.get("explicitness", True), attrs.get("hard", True))
        path = f"{root}/{run['run_id']}"
        conditions = ConditionRun(spark, f"{path}__log", CallStore(spark, f"{root}/calls"))
        made = conditions.step(work, compactor(spec["compactor"]["name"]), spec["probe"]["runtime"], spec["evaluator"]["runtime"])
        table = writers.replace_table(made, path)
        writers.write_json(spark, spec, f"{path}.json")
        if "snapshots" in config:
            SnapshotTable(spark, config["snapshots"], "run_id").replace_values(table.withColumn("run_id", F.lit(run["run_id"])))
        done.append(run["run_id"])
    return done


def analyse(spark: SparkSession, config: dict) -> dict[str, list[str]]:
    """The tables of analyses as CSV, and a report of the main experiment's headline.

    ``facts``: a Parquet table of facts, or ``snapshots``: a table of committed ones (at its
    newest ``version``, if none is named), or ``root`` and ``manifest``: finished runs to be
    joined.  ``out``; ``analyses`` (all that can be made, if absent); ``settings``.
    """
    if "facts" in config:
        facts = spark.read.parquet(config["facts"])
    elif "snapshots" in config:
        facts = SnapshotTable(spark, config["snapshots"], "run_id").read(config.get("version"))
    else:
        facts = readers.union_runs(spark, config["root"], config["manifest"], config.get("experiment", "main"), config.get("missing", "raise"))
    done = {}
    for name, tables in tables_of(facts, config.get("analyses"), config.get("settings", {})).items():
        for table, rows in tables.items():
            writers.write_csv(rows, f"{config['out']}/{name}/{table}")
        done[name] = sorted(tables)
        if name == "main_experiment":
            report = writers.markdown(tables["headline"].orderBy("dataset", "compactor"), "Headline")
            writers.write_bytes(spark, report.encode(), f"{config['out']}/report.md")
    return done


def summarise_datasets(spark: SparkSession, config: dict) -> DataFrame:
    """``roots`` to look in, ``out``: tokens, turns and sources of every saved dataset, as CSV."""
    found = readers.discover_datasets(spark, config["roots"], config.get("pattern", "*_cat_*"))
    table = dataset_summary(spark, {r.dataset: r.path for r in found.collect()})  # a row a dataset
    writers.write_csv(table.orderBy("avg_tokens", "dataset"), config["out"])
    return table


def reprobe(spark: SparkSession, config: dict) -> DataFrame:
    """Probe a run's fixed contexts anew: ``contexts``, ``runtime``, ``cases``, ``out``; with ``judge``, free
    generations are judged as true, false or undecided."""
    rows, cases = spark.read.parquet(config["contexts"]), tuple(config.get("cases", phases.CASES))
    answers = phases.reprobed(rows, config["runtime"], cases)
    if "judge" in config:
        asked = answers.drop("status", "error").join(rows.select(*phases.KEYS, "wrapped"), list(phases.KEYS))
        answers = phases.regraded_generations(asked, config["judge"])
    return writers.replace_table(answers, config["out"])


def extract(spark: SparkSession, config: dict) -> DataFrame:
    """Run the extractor over a saved dataset's pairs: ``dataset``, ``out``; registries, and whether each was found.

    ``runtime``: a model to extract with, turn by turn; rules without it.
    """
    data = readers.read_dataset(spark, config["dataset"], config.get("rows"), bool(config.get("test")))
    work = phases.pairs(spark, data, config.get("position", "top"))
    identity = runs.extractor_run_id(config["name"], config.get("runtime", "rules"), "lexical")
    if "runtime" in config:
        fold = E.ModelExtraction(spark, f"{config['out']}/{identity}__log", CallStore(spark, f"{config['out']}/calls"), {"source_row_index": "long", "sssc_id": "int"})
        found = fold.run(work.select(*phases.KEYS, F.col("injected").alias("messages")), config["runtime"])
        work = work.select(*phases.KEYS, "sssc_type", "wrapped").join(found.select(*phases.KEYS, "registry", "finished"), list(phases.KEYS))
    else:
        work = work.select(*phases.KEYS, "sssc_type", "wrapped", E.registry(F.col("injected")).alias("registry"))
    kept = F.exists("registry", lambda x: F.contains(x["text"], F.col("wrapped")) | F.contains(F.col("wrapped"), x["text"]))
    return writers.replace_table(work.withColumn("retention", kept).withColumn("run_id", F.lit(identity)).drop("wrapped"), f"{config['out']}/{identity}")


JOBS: dict[str, Callable] = {"generate_dataset": generate_dataset, "evaluate": evaluate, "analyse": analyse, "summarise_datasets": summarise_datasets, "reprobe": reprobe, "extract": extract}


def main(args: list[str]) -> None:
    if len(args) != 2 or args[0] not in JOBS:
        sys.exit(f"{__doc__}\nJobs: {', '.join(JOBS)}")
    spark = SparkSession.builder.appName(args[0]).getOrCreate()
    with open(args[1]) as config:
        settings = json.load(config)
    try:
        JOBS[args[0]](spark, settings)
    finally:
        released(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
