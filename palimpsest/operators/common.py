"""Shared relational helpers: lineage cuts, dense row numbers, ordered folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stored tables, from ``spark.checkpoint.dir``.

    A local folder is made only where the session names none and the master is local.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: What ``stored`` and ``stored_in_buckets`` have written, by application: paths, and names in the catalog.
_WRITTEN: dict[str, list[tuple[str, str | None]]] = {}


def released(spark: SparkSession) -> int:
    """Remove what this application has stored on the way; how many tables.  For the end of a job."""
    written = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path, name in written:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(written)


def stored(df: DataFrame, *partitions: str) -> tuple[str, DataFrame]:
    """The rows as a written table in the shared folder: its path, and the table read back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append((path, None))
    df.write.partitionBy(*partitions).parquet(path)
    return path, read_stored(df.sparkSession, path, df.schema)


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


#: What names a verdict's pair of context and constraint; facts are stored by its hash.
PAIR = ("dataset", "source_row_index", "sssc_id")


def stored_in_buckets(df: DataFrame, keys: Sequence[str], buckets: int, *partitions: str) -> tuple[str, str]:
    """The rows as a table laid out by the hash of ``keys``: its path in the shared folder, and its name in the catalog.

    One shuffle brings each bucket into one file a partition; joins, windows and groups on
    all of ``keys`` then read the table without another.
    """
    name = f"palimpsest_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{name}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append((path, name))
    df.repartition(buckets, *keys).write.partitionBy(*partitions).bucketBy(buckets, *keys).option("path", path).saveAsTable(name, format="parquet")
    return path, name


def beside(wide: DataFrame, narrow: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``wide`` with the struct ``name`` of the one ``narrow`` row of its keys, or null.

    The join is on the first key alone, for which few narrow rows are listed (what a run
    knows of one context), so wide rows that lie by it are not shuffled.
    """
    first, *rest = keys
    others = [c for c in narrow.columns if c != first]
    listed = narrow.groupBy(first).agg(F.collect_list(F.struct(*others)).alias("__listed"))
    same = lambda x: reduce(lambda a, b: a & b, [x[k] == F.col(k) for k in rest], F.lit(True))
    return wide.join(listed, first, "left").withColumn(name, F.get(F.filter("__listed", same), F.lit(0))).drop("__listed")


def row_index(df: DataFrame, order: Sequence[str], name: str = "source_row_index") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order, without gathering the rows in one task.

    Rows are range-partitioned and sorted; only the partitions' sizes meet.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__at"), 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a partition
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__before", "__at")


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "slot") -> DataFrame:
    """Adds 0, 1, 2, ... within each key in the given order; no task holds a key's rows."""
    rows = row_index(df, [*keys, *order], "__row")
    first = rows.groupBy(*keys).agg(F.min("__row").alias("__first"))
    joined = rows.join(first, list(keys)) if keys else rows.crossJoin(first)
    return joined.withColumn(name, F.col("__row") - F.col("__first")).drop("__row", "__first")


def ordered_fold(df: DataFrame, order: Sequence[str], fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A sequential pass over the rows in order.

    For folds whose every step needs the one before.  It streams through one task, so
    give it narrow rows only (keys and sizes); its memory is one batch.
    """
    return df.repartition(1).sortWithinPartitions(*order).mapInPandas(fold, schema)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    place = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(place)).filter("__n = 1").drop("__n")


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in order, as a top-n and never an arbitrary limit."""
    return df.orderBy(*order).limit(n)
