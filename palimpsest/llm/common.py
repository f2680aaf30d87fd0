"""Shared helpers of the corpus operators: word splitting, caches, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: ASCII white space separates words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, split at ASCII white space only; a null text has none.

    ``bytes.split`` separates at exactly the characters WORD_PATTERN excludes.
    """
    return text.split() if text else []


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 500, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows and few bytes of text, so that what is made from one stays small."""
    ends = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(ends), 0
    while at < batch.num_rows:
        most = size + (int(ends[at - 1]) if at else 0)
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """Set the folder for checkpoints from ``spark.checkpoint.dir``, unless it is set.

    A local folder is made only where the session names none and the master is
    local (tests on one machine).
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table beside the checkpoints: columns compress, unlike a checkpoint's rows."""
    checkpoint_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, key: str) -> tuple[str, DataFrame]:
    """The rows as a written table, each in its key's bucket, so that joins on the key leave them there: its name and rows."""
    spark, name = df.sparkSession, f"palimpsest_{uuid.uuid4().hex}"
    checkpoint_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name, format="parquet")
    return name, spark.table(name)


def removed(spark: SparkSession, name: str) -> None:
    """Remove what ``stored_in_buckets`` has written under this name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CACHES: weakref.WeakSet = weakref.WeakSet()
_OWNER: list[str] = [""]


def claim(owner: str) -> None:
    """Called where an operator's work begins in a Python worker.

    Workers are used again by other operators; what those remember is let go, so a
    worker holds one operator's caches at a time.
    """
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for cache in list(_CACHES):
            cache.forget()


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Rows of the same columns, batch by batch in Python; batches are small."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield function(part)

    return df.mapInArrow(run, schema)


def with_text(batch: pa.RecordBatch, text_col: str, texts: list[str | None], length_col: str = "n_chars") -> pa.RecordBatch:
    """The batch with other texts, and their lengths where it has such a column."""
    at = batch.schema.names.index(text_col)
    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    if length_col in batch.schema.names:
        at = batch.schema.names.index(length_col)
        lengths = [None if t is None else len(t) for t in texts]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(lengths, batch.schema.field(at).type))
    return batch


def ids_are_keys(df: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no id is null or repeated."""
    ids = df.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.max("n"), F.count_if(F.col(id_col).isNull())).first()
    return (ids[0] or 0) <= 1 and not ids[1]


def row_keys(df: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns plus ``name``: unique, and ascending with the id.

    Unique ids are their own keys.  Where ids repeat or are null, rows are numbered
    in the order of id and text (nulls first), and that numbering is written down.
    """
    if ids_are_keys(df, id_col):
        return df.withColumn(name, F.col(id_col).cast("long")).filter(F.col(name).isNotNull())
    return checkpointed(df.repartitionByRange(id_col, text_col).sortWithinPartitions(id_col, text_col).withColumn(name, F.monotonically_increasing_id()))


def int_lists(flat: Any, offsets: Any) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


class BatchCache:
    """A memo bounded in bytes, filled for many keys at once.

    ``get(keys)`` returns the mapping to look the keys up in; ``make`` is called
    once with the keys not yet known.  Between calls at most two generations of
    ``capacity`` bytes (and one call's keys) are kept; keys over ``LONGEST`` are
    never remembered, as long ones seldom come again.
    """

    #: Bytes of an entry beside its key and value, about.
    OVERHEAD, LONGEST = 170, 64

    def __init__(self, make: Callable[[list], list], capacity: int):
        self.make, self.capacity = make, capacity
        self.forget()
        _CACHES.add(self)

    def forget(self) -> None:
        self.young, self.older, self.size, self.passing = {}, {}, 0, []

    def _take(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self._weigh(keys, values, 1)

    def _weigh(self, keys: list, values: list, sign: int) -> None:
        if keys:
            data = sum(map(len, values)) if isinstance(values[0], bytes) else 8 * len(values)
            self.size += sign * (self.OVERHEAD * len(keys) + sum(map(len, keys)) + data)

    def get(self, keys: Iterable) -> dict:
        for key in self.passing:
            del self.young[key]
        self.passing = []
        if self.size >= self.capacity:
            self.older, self.young, self.size = self.young, {}, 0
        new = set(keys).difference(self.young)
        if new and self.older:
            old = self.older
            known = [k for k in new if k in old]
            self._take(known, [old[k] for k in known])
            new.difference_update(known)
        if new:
            missing = list(new)
            self._take(missing, self.make(missing))
            if max(map(len, missing)) > self.LONGEST:
                self.passing = [k for k in missing if len(k) > self.LONGEST]
                self._weigh(self.passing, [self.young[k] for k in self.passing], -1)
        return self.young
