"""Deterministic samples, keyed rows, and incremental results."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.common import checkpointed


def stable_key(*parts: Column) -> Column:
    """Sixteen hexadecimal digits fixed by a row's identity."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 16)


def seeded_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def key_sample(rows: DataFrame, n: int, seed: int = 0, key: str = "key") -> DataFrame:
    """The n rows that come first in a seeded order of their keys."""
    return rows.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def balanced_sample(rows: DataFrame, n: int, verdict: str, seed: int = 0, key: str = "key") -> DataFrame:
    """Half of each verdict where there are enough; the other side fills up what is missing.

    One pass: every task passes on at most n rows of each verdict, by a seeded order.
    """
    order = [seeded_order(seed, F.col(key)), F.col(key)]
    known = rows.filter(F.col(verdict).isNotNull())
    first = known.withColumn("__rank", F.row_number().over(W.partitionBy(verdict).orderBy(*order))).filter(F.col("__rank") <= n)
    every = W.partitionBy(F.lit(0))  # 2 n rows at most
    yes_n, no_n = F.count_if(F.col(verdict)).over(every), F.count_if(~F.col(verdict)).over(every)
    yes = F.least(yes_n, F.greatest(F.lit(n // 2), F.lit(n) - F.least(no_n, F.lit(n - n // 2))))
    wanted = first.withColumn("__yes", yes).withColumn("__no", F.least(no_n, F.lit(n) - F.col("__yes")))
    return wanted.filter(F.col("__rank") <= F.when(F.col(verdict), F.col("__yes")).otherwise(F.col("__no"))).select(*rows.columns)


def nested_sample(rows: DataFrame, forced: DataFrame, n: int, seed: int = 1, key: str = "key") -> DataFrame:
    """The forced rows and a seeded sample of the others, n in all; ``forced`` marks the former.

    The forced keys are a sample's, so they are written down once and come first in one top-n.
    """
    ids = checkpointed(forced.select(key).distinct())
    marked = rows.join(ids.withColumn("forced", F.lit(True)), key, "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    return marked.orderBy(F.desc("forced"), seeded_order(seed, F.col(key)), key).limit(max(n, ids.count())).select(*rows.columns, "forced")


def parity_sample(keys: Sequence[str], n: int, seed: int) -> list[str]:
    """What a sequential generator draws from the sorted keys; for samples that must repeat one."""
    return random.Random(seed).sample(sorted(keys), min(n, len(keys)))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work without a result yet."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def pending_conditions(work: DataFrame, done: DataFrame, keys: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """Work with a flag for each condition that has no verdict yet; finished work is left out."""
    joined = work.join(done.select(*keys, *conditions, F.lit(True).alias("__seen")), list(keys), "left")
    flags = joined.select(*keys, *[F.col(c).isNull().alias(f"need_{c}") for c in conditions])
    return flags.filter(" or ".join(f"need_{c}" for c in conditions))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new rows, and the old ones whose keys are not among them."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
