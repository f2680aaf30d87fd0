"""Statistics as Spark columns: rates, kappa, exact tests, resampled intervals."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from palimpsest.functions.text import draw


def rate(verdict: Column) -> Column:
    """Mean of the verdicts that are not null; null if there are none."""
    return F.avg(verdict.cast("double"))


def invalid_rate(verdict: Column) -> Column:
    return F.avg(verdict.isNull().cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def effect_retention(compacted: Column, base: Column, upper: Column) -> Column:
    """How much of the injected effect is left; null where there is none to keep."""
    return ratio(compacted - base, F.nullif(F.round(upper - base, 12), F.lit(0)))


def kappa_of(agree: Column, left: Column, right: Column) -> Column:
    """Cohen's kappa from the agreement and the marginal rates; 1 where chance alone agrees fully."""
    chance = left * right + (1 - left) * (1 - right)
    return F.when(F.round(chance, 12) == 1, 1.0).otherwise((agree - chance) / (1 - chance))


def agreement(a: Column, b: Column) -> dict[str, Column]:
    """Aggregates over rows where both verdicts are known."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    agree = F.avg(F.when(both, (a == b).cast("double")))
    return {
        "n": F.count(x),
        "n_agree": F.count_if(both & (a == b)),
        "yes_yes": F.count_if(both & a & b),
        "yes_no": F.count_if(both & a & ~b),
        "no_yes": F.count_if(both & ~a & b),
        "no_no": F.count_if(both & ~a & ~b),
        "left_rate": F.round(F.avg(x), 10),
        "right_rate": F.round(F.avg(y), 10),
        "agree_rate": F.round(agree, 10),
        "kappa": F.round(kappa_of(agree, F.avg(x), F.avg(y)), 10),
    }


def mcnemar_exact(gains: Column, losses: Column) -> Column:
    """Two-sided binomial p of the discordant pairs at one half; 1 if there are none.

    Terms are summed in log space by the recurrence between neighbouring coefficients.
    """
    n, least = gains + losses, F.least(gains, losses)
    half = n.cast("double") * F.log(F.lit(0.5))
    start = F.struct(half.alias("term"), F.exp(half).alias("total"))
    step = lambda a, i: F.struct((a["term"] + F.log((n - i + 1) / i)).alias("term"), (a["total"] + F.exp(a["term"] + F.log((n - i + 1) / i))).alias("total"))
    places = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(places, start, step, lambda a: a["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


#: Replicates that a task draws together, and slots of one stratum that it holds at once.
REPLICATES_TOGETHER, SLOTS_TOGETHER = 50, 1 << 21


def drawn_slots(prefix: bytes, n: int) -> np.ndarray:
    """``n`` slots below ``n``, drawn with replacement; a hash of the prefix and a block's number gives four draws."""
    start = md5(prefix, usedforsecurity=False)

    def digest(block: int) -> bytes:
        hashed = start.copy()
        hashed.update(b"%d" % block)
        return hashed.digest()

    words = np.frombuffer(b"".join(map(digest, range(-(-n // 4)))), ">u4")[:n]
    return np.floor(words / 4294967296.0 * n).astype(np.int64)


def resampled_sums(slots: DataFrame, keys: Sequence[str], columns: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """``keys, replicate`` and, for each of ``columns``, its sum over as many slots as the group has, drawn with replacement.

    ``slots``: rows with their places ``slot`` (from 0 on) in the group of ``keys``; nulls
    add nothing.  Draws depend on the seed, the group, the replicate and the place only, so
    any partitioning gives the same.  They are made where they are summed: a task gets some
    replicates and a bounded part of one group's slots, and no draw is a row, shuffled or
    sent anywhere.  A group of several parts is drawn anew for each.
    """
    keys, columns = list(keys), list(columns)
    sizes = slots.groupBy(*keys).agg(F.count("*").alias("__n"))
    named = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    rows = slots.select(*keys, F.col("slot").cast("long").alias("__slot"), *values, named.alias("__name"))
    rows = rows.join(sizes, keys) if keys else rows.crossJoin(sizes)
    batches = -(-replicates // REPLICATES_TOGETHER)
    part = F.floor(F.col("__slot") / SLOTS_TOGETHER).cast("long")
    dealt = rows.withColumn("__part", part).withColumn("__batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    group = [*keys, "__part", "__batch"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, low, name = int(first["__n"]), int(first["__part"]) * SLOTS_TOGETHER, str(first["__name"])
        held = np.zeros((len(columns), min(SLOTS_TOGETHER, n - low)))
        held[:, pdf["__slot"].to_numpy() - low] = pdf[columns].to_numpy(float).T
        of = range(int(first["__batch"]) * REPLICATES_TOGETHER, min(replicates, (int(first["__batch"]) + 1) * REPLICATES_TOGETHER))
        sums = []
        for replicate in of:
            drawn = drawn_slots(f"{name}|{replicate}|".encode(), n) - low
            if held.shape[1] < n:
                drawn = drawn[(drawn >= 0) & (drawn < held.shape[1])]
            sums.append([row[drawn].sum() for row in held])
        return pd.DataFrame({**{k: [first[k]] * len(of) for k in keys}, "replicate": list(of), **{c: [row[i] for row in sums] for i, c in enumerate(columns)}})

    schema = StructType([*[slots.schema[k] for k in keys], StructField("replicate", IntegerType()), *[StructField(c, DoubleType()) for c in columns]])
    found = dealt.repartition(2 * batches, *group).groupBy(*group).applyInPandas(solve, schema)
    return found.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in columns])


def bounds(column: str, level: float) -> list[Column]:
    tail = (1 - level) / 2
    return [F.round(F.percentile(column, F.lit(q)), 9).alias(name) for name, q in (("low", tail), ("high", 1 - tail))]


def cluster_interval(clusters: DataFrame, strata: Sequence[str], value: str, weight: str, replicates: int = 5000, level: float = 0.95, seed: str = "cluster") -> DataFrame:
    """``n, mean, low, high`` of the pooled ratio of sums: clusters are resampled whole within each stratum.

    Rows are cluster sums of ``value`` over ``weight``, with their places ``slot`` (from 0
    on) in the stratum; a replicate pools the sums of all strata.
    """
    strata = list(strata)
    known = clusters.select(*strata, "slot", F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    means = resampled_sums(known, strata, ("v", "w"), replicates, seed).groupBy("replicate").agg((F.sum("v") / F.sum("w")).alias("m"))
    whole = known.agg(F.count("*").alias("n"), F.round(F.sum("v") / F.sum("w"), 9).alias("mean"))
    return whole.crossJoin(means.agg(*bounds("m", level)))  # one row each


def binomial_tables(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, low, cdf``: from ``keys, size, p`` the distribution of successes, from ``low`` on.

    ``size`` is one of the keys.  Terms come from the recurrence between neighbours, in
    logarithms, within seven deviations of the mean and a little more; what lies beyond is
    less than any draw of 32 bits can tell.
    """
    size, p, k = F.col("size"), F.col("p"), F.col("__k")
    reach = 7 * F.sqrt(size * p * (1 - p)) + 9
    low, high = F.greatest(F.lit(0), F.floor(size * p - reach)), F.least(size, F.ceil(size * p + reach))
    rows = cases.withColumn("low", low.cast("long")).withColumn("__k", F.explode(F.sequence(F.col("low"), high.cast("long"))))
    upto, whole = W.partitionBy(*keys).orderBy("__k"), W.partitionBy(*keys)
    step = F.when(k == F.col("low"), 0.0).otherwise(F.log((size - k + 1) / k) + F.log(p / (1 - p)))
    logs = rows.withColumn("log", F.sum(step).over(upto))
    weights = logs.withColumn("weight", F.exp(F.col("log") - F.max("log").over(whole)))
    summed = weights.withColumn("c", F.sum("weight").over(upto) / F.sum("weight").over(whole))
    return summed.groupBy(*keys).agg(F.min("__k").alias("low"), F.array_sort(F.collect_list("c")).alias("cdf"))


def binomial_quantiles(size: int, p: float, draws: np.ndarray) -> np.ndarray:
    """The successes of ``size`` tries at each draw of the inverse distribution, by the terms of ``binomial_tables``."""
    reach = 7 * np.sqrt(size * p * (1 - p)) + 9
    low, high = max(0, int(np.floor(size * p - reach))), min(size, int(np.ceil(size * p + reach)))
    k = np.arange(low + 1, high + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((size - k + 1) / k) + np.log(p / (1 - p)))])
    summed = np.cumsum(np.exp(logs - logs.max()))
    return low + np.searchsorted(summed / summed[-1], draws)


def resampled_means(sizes: DataFrame, keys: Sequence[str], values: Sequence[float], replicates: int, seed: str) -> DataFrame:
    """``keys, replicate, m``: means of resampled groups that hold few different values.

    ``sizes``: ``n`` and the count ``k<i>`` of each value.  Drawing n rows with replacement
    gives multinomial counts of the values; they are drawn as such, one binomial after the
    other by its inverse distribution, so no replicate visits the rows.  Where replicates
    have different numbers left to draw, each draws for the least of them and for its own
    rest apart, which is the same in distribution and needs small tables only.  A task
    holds a group's replicates and one distribution at a time, whatever the group's rows.
    """
    keys, last = list(keys), len(values) - 1
    rows = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = {f"u{i}_{part}": draw(seed, *[F.col(c) for c in keys], F.col("replicate"), i, part) for i in range(last) for part in (1, 2)}
    schema = StructType([*[sizes.schema[k] for k in keys], StructField("replicate", IntegerType()), StructField("m", DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        rest, left, total = n, np.full(len(pdf), n), np.zeros(len(pdf))
        for i, value in enumerate(values[:-1]):
            k, got = int(pdf[f"k{i}"].iloc[0]), np.zeros(len(pdf), np.int64)
            if rest and k >= rest:
                got = left.copy()
            elif rest and k > 0:
                least = int(left.min())
                got += binomial_quantiles(least, k / rest, pdf[f"u{i}_1"].to_numpy())
                more = left - least
                order = np.argsort(more, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(more[order])) + 1):
                    if more[at[0]] > 0:
                        got[at] += binomial_quantiles(int(more[at[0]]), k / rest, pdf[f"u{i}_2"].to_numpy()[at])
            total, left, rest = total + got * float(value), left - got, rest - k
        return pdf[keys].assign(replicate=pdf["replicate"], m=(total + left * float(values[-1])) / n if n else np.nan)

    return rows.withColumns(draws).groupBy(*keys).applyInPandas(solve, schema)


def value_counts(value: Column, values: Sequence[float]) -> list[Column]:
    """What ``resampled_means`` needs to know of a group, as aggregates."""
    return [F.count(value).alias("n"), *[F.count_if(value == v).alias(f"k{i}") for i, v in enumerate(values)]]


def few_valued_interval(rows: DataFrame, keys: Sequence[str], value: str, values: Sequence[float] = (0, 1), replicates: int = 2000, level: float = 0.95, seed: str = "boot") -> DataFrame:
    """``keys, n, mean, low, high``: percentile interval of the resampled mean of a column with few values.

    Nulls are dropped; a group without rows has no interval, one with a single row is
    certain.  A value that is not listed is an error.
    """
    v = F.col(value)
    listed = F.when(v.isin(*values), v.cast("double")).when(v.isNotNull(), F.raise_error(F.concat(F.lit("value not listed: "), v.cast("string"))).cast("double"))
    known = rows.withColumn("__v", listed).filter("__v is not null")
    sizes = known.groupBy(*keys).agg(*value_counts(F.col("__v"), values), F.round(F.avg("__v"), 9).alias("mean"))
    means = resampled_means(sizes.drop("mean"), keys, values, replicates, seed).groupBy(*keys).agg(*bounds("m", level))
    joined = sizes.select(*keys, "n", "mean").join(means, list(keys)) if keys else sizes.select("n", "mean").crossJoin(means)
    return joined.select(*keys, "n", "mean", "low", "high")
