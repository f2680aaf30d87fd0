"""Writing result tables, datasets, manifests, reports and caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it names it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def moved(files, source, target) -> None:
    """Rename, or raise: a file system tells a refused rename by its result alone, and moves into a folder that exists."""
    if files.exists(target):
        raise FileExistsError(f"{target} is in the way of {source}")
    if not files.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: the committer's mark is there."""
    return exists(spark, f"{path}/_SUCCESS")


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table beside its place and move it there when it is whole.

    The table may be read by ``df`` itself.  Whatever breaks off leaves a whole table:
    the old one, or, between the two moves, the new one under its staged name, which
    ``recovered`` puts in place.
    """
    spark = df.sparkSession
    staged, old = f"{path}__new", f"{path}__old"
    files, where = file_system(spark, path)
    df.write.mode("overwrite").parquet(staged)
    if files.exists(where):
        files.delete(file_system(spark, old)[1], True)
        moved(files, where, file_system(spark, old)[1])
    moved(files, file_system(spark, staged)[1], where)
    files.delete(file_system(spark, old)[1], True)
    return spark.read.parquet(path)


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is a whole table at ``path``, after finishing a replacement that broke off."""
    files, where = file_system(spark, path)
    staged, old = f"{path}__new", f"{path}__old"
    if not complete(spark, path):
        for other in (staged, old):
            if complete(spark, other):
                files.delete(where, True)
                moved(files, file_system(spark, other)[1], where)
                break
    for other in (staged, old):
        files.delete(file_system(spark, other)[1], True)
    return complete(spark, path)


def write_results(df: DataFrame, path: str) -> None:
    """Replace the partitions of the runs in ``df``; other runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_dataset(df: DataFrame, path: str, columns: Sequence[str] = ("source_row_index", "messages", "token_length", "source_conversation_count")) -> DataFrame:
    """Write once; a whole table that is there already is read back instead, a broken one is written anew."""
    spark = df.sparkSession
    if not recovered(spark, path):
        return replace_table(df.select(*[c for c in columns if c in df.columns]), path)
    return spark.read.parquet(path)


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """A small file, through Spark's file system."""
    files, where = file_system(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document, through Spark's file system."""
    write_bytes(spark, json.dumps(value, indent=2, sort_keys=True, default=str).encode(), path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header; for result tables, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, order: str = "id") -> None:
    df.orderBy(order).write.mode("overwrite").json(path)


def blind_and_key(rows: DataFrame, shown: Sequence[str], hidden: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A reviewer's file with an empty label and no verdict, and the key that is held aside."""
    return rows.select(F.lit("").alias("label"), "id", *shown), rows.select("id", *hidden)


def generation_manifest(dataset: str, test: bool, num_convo: int, target_size: int, stitching_method: str) -> dict:
    return {"dataset": dataset, "test": test, "num_convo": num_convo, "target_size": target_size, "stitching_method": stitching_method}


def cached(spark: SparkSession, path: str, identity: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under its identity's hash, made where it is not there yet."""
    name = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:16]
    where, note = f"{path}/{name}", f"{path}/{name}.json"
    if not (exists(spark, note) and complete(spark, where) and read_json(spark, note) == json.loads(json.dumps(identity))):
        make().write.mode("overwrite").parquet(where)
        write_json(spark, identity, note)
    return spark.read.parquet(where)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report of a small result table; more rows than ``most`` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def latex(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")
    clean = lambda v: "" if v is None else str(v).replace("_", r"\_").replace("%", r"\%")
    body = [" & ".join(clean(v) for v in r) + r" \\" for r in (df.columns, *rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"]) + "\n"
