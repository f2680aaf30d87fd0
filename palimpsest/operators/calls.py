"""Logs that grow by whole parts, and a content-addressed store of model calls.

A part is a folder of its own, written once and counted from its ``_SUCCESS`` mark on, so a
writer that breaks off leaves nothing a reader sees, readers are never disturbed, and two
writers do not touch each other's parts.  Nothing is renamed.

The store names a call by what is asked: the model, its options and the whole talk.  Equal
talks are asked once, over all pairs, compactors and runs that share a store; failed
calls stay in it as attempts and are asked again by the next run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.common import beside, checkpointed
from palimpsest.operators.runtimes import generated
from palimpsest.sources.writers import complete, file_system

CALLS = "call_key string, model string, output string, status string, error string, attempt int"


class PartedLog:
    """Rows of one schema below a path, one folder a part."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def parts(self) -> list[str]:
        """The whole parts, by name."""
        files, where = file_system(self.spark, self.path)
        if not files.exists(where):
            return []
        found = sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory())
        return [f"{self.path}/{name}" for name in found if complete(self.spark, f"{self.path}/{name}")]

    def append(self, rows: DataFrame, name: str | None = None) -> str:
        """Write a part; one of a given name that is whole already stays as it is."""
        part = f"{self.path}/{name or uuid.uuid4().hex}"
        if not complete(self.spark, part):
            fields = self.spark.createDataFrame([], self.schema).schema
            rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").parquet(part)
        return part

    def read(self) -> DataFrame:
        parts = self.parts()
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)


def call_key(model: str, options: dict | None, talk: Column) -> Column:
    """The name of a call: a digest of model, options and every message's role and content."""
    said = F.to_json(F.transform(talk, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(json.dumps(options or {}, sort_keys=True)), said), 256)


class CallStore(PartedLog):
    """Answers by call, over all who share the path."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, CALLS)

    def latest(self) -> DataFrame:
        """A row a call: its last good answer, else its last failure; ``attempt`` counts how often it was asked."""
        fields = [c for c in self.read().columns if c not in ("call_key", "attempt")]
        best = F.max_by(F.struct(*fields), F.struct(F.col("status") == "success", "attempt")).alias("best")
        return self.read().groupBy("call_key").agg(best, F.max("attempt").alias("attempt")).select("call_key", "best.*", "attempt")

    def answered(self, asked: DataFrame, provider: str, messages: str, id_cols: Sequence[str], model: str | None = None, options: dict | None = None, again: Column | None = None, partitions: int | None = None, unique: Sequence[str] | None = None) -> DataFrame:
        """``id_cols, output, status, error``: what the store knows is not asked, the rest once for each distinct talk.

        ``model`` names what answers, where the provider is only the way to it.  ``again``
        marks rows whose good answer is of no use, such as one that cannot be read: their
        calls are made anew, and the new answer counts.  ``unique``: columns of ``id_cols``
        that name a row; then talks are sent from where they are made, and only their names
        are shuffled.
        """
        name = model or provider
        if unique:
            return self._answered_in_place(asked, provider, messages, id_cols, name, options, again, partitions, unique)
        keyed = asked.withColumn("call_key", call_key(name, options, F.col(messages))).withColumn("__again", F.lit(False) if again is None else again)
        known = self.latest().select("call_key", F.col("attempt").alias("__before"), (F.col("status") == "success").alias("__good"))
        # equal talks are put together before they are sent
        distinct = keyed.groupBy("call_key").agg(F.first(messages).alias(messages), F.max("__again").alias("__again"))
        open_calls = distinct.join(known, "call_key", "left").filter("__again or not coalesce(__good, false)")
        made = generated(open_calls.withColumn("attempt", F.coalesce("__before", F.lit(0)) + 1), provider, messages, ["call_key", "attempt"], partitions, options=options)
        self.append(made.withColumn("model", F.lit(name)))
        return keyed.select(*id_cols, "call_key").join(self.latest().select("call_key", "output", "status", "error"), "call_key", "left").drop("call_key")

    def _answered_in_place(self, asked: DataFrame, provider: str, messages: str, id_cols: Sequence[str], name: str, options: dict | None, again: Column | None, partitions: int | None, unique: Sequence[str]) -> DataFrame:
        keyed = asked.select(*id_cols, call_key(name, options, F.col(messages)).alias("call_key"), (F.lit(False) if again is None else again).alias("__again"))
        keyed = checkpointed(keyed)  # names of talks
        known = self.latest().select("call_key", F.col("attempt").alias("__before"), (F.col("status") == "success").alias("__good"))
        # of equal talks the first row sends its own
        senders = keyed.groupBy("call_key").agg(F.min(F.struct(*unique)).alias("__row"), F.max("__again").alias("__again"))
        if self.parts():
            senders = senders.join(known, "call_key", "left").filter("__again or not coalesce(__good, false)").withColumn("attempt", F.coalesce("__before", F.lit(0)) + 1)
        else:
            senders = senders.withColumn("attempt", F.lit(1))
        open_calls = beside(asked.select(*unique, messages), senders.select("__row.*", "call_key", "attempt"), unique, "__sends").filter("__sends is not null")
        made = generated(open_calls.select("__sends.*", messages), provider, messages, ["call_key", "attempt"], partitions, options=options)
        self.append(made.withColumn("model", F.lit(name)))
        return keyed.select(*id_cols, "call_key").join(self.latest().select("call_key", "output", "status", "error"), "call_key", "left").drop("call_key")
