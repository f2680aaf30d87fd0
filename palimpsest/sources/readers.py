"""Reading sources, saved datasets, run tables, manifests and JSON lines."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.messages import projected, total_tokens
from palimpsest.operators.common import row_index
from palimpsest.sources.adapters import normalised
from palimpsest.sources.writers import exists


@dataclass(frozen=True)
class SourceSpec:
    """Where a source lies below a root, and how it is read."""

    name: str
    path: str
    format: str = "parquet"
    split: str = "train"
    config: str | None = None
    subsets: tuple[str, ...] = ()
    preserve: tuple[str, ...] = field(default=())


SOURCES = {
    s.name: s
    for s in (
        SourceSpec("sharegpt", "sharegpt", "json"),
        SourceSpec("wildchat", "wildchat"),
        SourceSpec("ultrachat", "ultrachat", split="train_sft"),
        SourceSpec("mrcr", "mrcr"),
        SourceSpec("lmsyschat", "lmsyschat"),
        SourceSpec("hermes", "hermes", preserve=("task",)),
        SourceSpec("longbench", "longbench", "zip", subsets=("gov_report", "qmsum", "multi_news")),
        SourceSpec("openresearcher", "openresearcher", "shards", config="seed_42"),
    )
}


def source_spec(name: str) -> SourceSpec:
    if name.lower() not in SOURCES:
        raise ValueError(f"no source named {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name.lower()]


def zipped_json_lines(spark: SparkSession, path: str, members: Sequence[str], schema: str) -> DataFrame:
    """Members ``data/<name>.jsonl`` of ZIP files, in the members' order, with ``member`` and ``line``.

    Files are read by Spark as binaries and unpacked on the executors, member by member.
    """
    wanted = tuple(members)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in wanted:
                        with archive.open(f"data/{name}.jsonl") as lines:
                            rows = []
                            for i, line in enumerate(lines):
                                if line.strip():
                                    rows.append((name, i, line.decode()))
                                if len(rows) == 1000:
                                    yield pd.DataFrame(rows, columns=["member", "line", "json"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["member", "line", "json"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "member string, line long, json string")
    return lines.select("member", "line", F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("member", "line", "r.*")


def sharded_parquet(spark: SparkSession, path: str, config: str, split: str, columns: Sequence[str] = ("messages",)) -> DataFrame:
    """All shards below ``<config>/<split>``; only the columns asked for are read."""
    return spark.read.parquet(f"{path}/{config}/{split}").select(*columns)


def read_source(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``messages, token_length`` and preserved columns of a source; an empty one is an error."""
    spec = source_spec(name)
    path = f"{root}/{spec.path}"
    try:
        if spec.format == "zip":
            raw = zipped_json_lines(spark, path, spec.subsets, "input string, context string, answers array<string>")
        elif spec.format == "shards":
            raw = sharded_parquet(spark, path, spec.config, spec.split)
        else:
            raw = spark.read.format(spec.format).load(path)
    except Exception as e:
        raise RuntimeError(f"source {name} cannot be read from {path}") from e
    made = normalised(raw, spec.name, tuple(c for c in spec.preserve if c in raw.columns))
    if made.filter(F.size("messages") > 0).limit(1).isEmpty():
        raise ValueError(f"source {name} has no messages")
    return with_token_length(made)


def with_token_length(df: DataFrame) -> DataFrame:
    return df if "token_length" in df.columns else df.withColumn("token_length", total_tokens(F.col("messages")))


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Numbers rows from 0 on in the order of their files' names and of the rows in each, as they are read."""
    placed = df.withColumn("__file", F.input_file_name()).withColumn("__row", F.monotonically_increasing_id())
    return row_index(placed, ["__file", "__row"], name).drop("__file", "__row")


def read_dataset(spark: SparkSession, path: str, num_rows: int | None = None, test: bool = False) -> DataFrame:
    """A saved dataset by ``source_row_index``; a test takes five rows at most, too few rows are an error."""
    df = spark.read.parquet(path)
    if "source_row_index" not in df.columns:
        df = in_file_order(df, "source_row_index")
    df = df.withColumn("messages", projected(F.col("messages")))
    if test:
        num_rows = min(5, num_rows or 5)
    if num_rows is None:
        return df
    kept = df.filter(F.col("source_row_index") < num_rows)
    if not test and (found := kept.count()) < num_rows:
        raise ValueError(f"{path} has {found} rows, not {num_rows}")
    return kept


def first_readable(spark: SparkSession, paths: Sequence[str], num_rows: int | None = None) -> DataFrame:
    """The first of several roots that can be read."""
    problems = []
    for path in paths:
        try:
            return read_dataset(spark, path, num_rows)
        except Exception as e:
            problems.append(f"{path}: {e}")
    raise FileNotFoundError("; ".join(problems))


def manifest_table(spark: SparkSession, runs: Sequence[dict], experiment: str) -> DataFrame:
    """``manifest_pos, run_id, run_label, experiment`` in the manifest's order."""
    rows = [(i, r["run_id"], r.get("label", r["run_id"]), experiment) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, "manifest_pos int, run_id string, run_label string, experiment string")


def run_root(root: str, run_id: str, experiment: str) -> str:
    """Test runs lie apart from the others."""
    return f"{root}/{'runs_test' if experiment == 'test' or '__test__' in run_id else 'runs'}/{run_id}"


def union_runs(spark: SparkSession, root: str, runs: Sequence[dict], experiment: str, missing: str = "raise") -> DataFrame:
    """The tables of a manifest's runs, each with its id, label and place; a run listed twice is read once."""
    tables, seen = [], set()
    for i, r in enumerate(runs):
        if r["run_id"] in seen:
            continue
        seen.add(r["run_id"])
        path = run_root(root, r["run_id"], experiment)
        if missing == "skip" and not exists(spark, path):
            continue  # any other failure to read shows
        table = spark.read.parquet(path)
        tables.append(table.withColumns({"run_id": F.lit(r["run_id"]), "run_label": F.lit(r.get("label", r["run_id"])), "experiment": F.lit(experiment), "manifest_pos": F.lit(i)}))
    if not tables:
        raise FileNotFoundError(f"no run of the manifest is below {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Strict: a line that is not JSON of the schema stops the job; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def find_runs(runs: DataFrame, strict: bool = True, **wanted: object) -> DataFrame:
    """Runs whose columns equal the given values; strict: exactly one, else the first by id."""
    for name, value in wanted.items():
        runs = runs.filter(F.col(name).eqNullSafe(F.lit(value)))
    if not strict:
        return runs.orderBy("run_id").limit(1)
    if (found := runs.count()) != 1:
        raise ValueError(f"{found} runs match {json.dumps(wanted, default=str, sort_keys=True)}")
    return runs


def discover_datasets(spark: SparkSession, roots: Sequence[str], pattern: str = "*_cat_*") -> DataFrame:
    """``dataset, path`` of saved datasets below several roots; the first root that has one counts."""
    jvm, found = spark.sparkContext._jvm, {}
    for root in roots:
        where = jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.globStatus(where) or []:
            path = status.getPath()
            if files.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                found.setdefault(path.getName(), path.toString())
    return spark.createDataFrame(sorted(found.items()), "dataset string, path string")


def executor_environment(config: dict[str, object]) -> dict[str, str]:
    """Session settings that give every executor the environment a runtime needs."""
    return {f"spark.executorEnv.{k.upper()}": str(v) for k, v in config.items() if v is not None}
