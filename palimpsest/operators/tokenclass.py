"""A trained token classifier, and the compactor that keeps the tokens it rates best.

An averaged perceptron over a window of tokens is trained by mixing: in each epoch every
partition goes through its own rows from the mixed weights, and the partitions' averages
are mixed by their numbers of tokens.  Features are hashed into ``WIDTH`` places, so what
reaches the driver and goes back to the tasks is bounded by that, whatever the corpus.

Defined results: a null or empty text trains nothing and keeps nothing; a text without
kept tokens trains as one that keeps none; without any token all weights are 0 and the
earlier tokens are kept; the weights depend on the rows and ``partitions`` alone.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.messages import MESSAGES
from palimpsest.functions.text import TOKEN_PATTERN
from palimpsest.operators.common import checkpointed

#: Places of the hashed features: 512 KB of weights.
WIDTH = 1 << 16
#: Tokens whose features a worker remembers.
KNOWN_TOKENS = 1 << 16


_PLAIN = {**dict.fromkeys(range(ord("0"), ord("9") + 1), "0"), **dict.fromkeys([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)], "a")}


@functools.lru_cache(KNOWN_TOKENS)
def token_places(token: str) -> tuple[int, int, int, int, int, int, bytes]:
    """The hashed features a token gives: to itself, to the one after it, to the one before; ending and form.

    The feature of form and earlier token is hashed from the last two: the earlier one's half, then the form.
    """
    low = token.lower()
    plain = token.translate(_PLAIN) if token.isascii() else re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", token))
    form = re.sub(r"(.)\1+", r"\1", plain).encode()
    w, p, n, e = (zlib.crc32(f.encode()) % WIDTH for f in (f"w{low}", f"p{low}", f"n{low}", f"e{low[-3:]}"))
    return w, p, n, e, zlib.crc32(b"f" + form) % WIDTH, zlib.crc32(f"s{low}|".encode()), form


#: The hashed place of a token, by the bit length of its number in the text.
_AT = np.array([zlib.crc32(f"b{b}".encode()) % WIDTH for b in range(64)], np.int64)


def places(tokens: Sequence[str]) -> np.ndarray:
    """The hashed features of each token: itself, its neighbours, its form and its place."""
    if not len(tokens):
        return np.empty((0, 7), np.int64)
    known = [token_places(""), *map(token_places, tokens), token_places("")]
    w, p, n, e, f, half, form = zip(*known, strict=True)
    after = list(map(zlib.crc32, form[1:-1], half[:-2]))
    out = np.array([w[1:-1], p[:-2], n[2:], e[1:-1], f[1:-1], f[1:-1], after], np.int64).T
    out[:, 5] = _AT[np.frexp(np.arange(len(tokens)))[1]]  # the exponent is the bit length
    out[:, 6] %= WIDTH
    return out


def scores(tokens: Sequence[str], weights: np.ndarray) -> np.ndarray:
    return weights[places(tokens)].sum(1)


def labelled(df: DataFrame, text: Column, short: Column) -> DataFrame:
    """``tokens, kept``: a token of a text is kept where its shorter version has it too."""
    tokens = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_PATTERN), 0)
    rows = df.select(tokens(text).alias("tokens"), tokens(short).alias("short"))
    return rows.select("tokens", F.transform("tokens", lambda t: F.array_contains("short", t)).alias("kept"))


def train(rows: DataFrame, epochs: int = 4, partitions: int = 8) -> np.ndarray:
    """Weights from all rows of ``tokens, kept``."""
    ordered = rows.filter(F.size("tokens") > 0).select("tokens", "kept").repartition(partitions, F.xxhash64("tokens")).sortWithinPartitions("tokens", "kept")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"places": [places(t).astype(np.uint16).tobytes() for t in batch["tokens"]], "kept": [np.asarray(k, bool).tobytes() for k in batch["kept"]]})

    dealt = checkpointed(ordered.mapInPandas(hashed, "places binary, kept binary"))  # hashed once for all epochs
    weights = np.zeros(WIDTH)
    for _ in range(epochs):
        start = weights

        def epoch(batches: Iterator[pd.DataFrame], start: np.ndarray = start) -> Iterator[pd.DataFrame]:
            # single numbers are read and changed faster in lists than in arrays; late: each change times the steps before it
            now, late, step = start.tolist(), [0.0] * WIDTH, 0
            for batch in batches:
                for hashes, kept in zip(batch["places"], batch["kept"], strict=True):
                    for at, keep in zip(np.frombuffer(hashes, np.uint16).reshape(-1, 7).tolist(), kept, strict=True):
                        a, b, c, d, e, f, g = at
                        score = now[a] + now[b] + now[c] + now[d] + now[e] + now[f] + now[g]
                        if score <= 0 if keep else score >= 0:
                            sign = 1.0 if keep else -1.0
                            for i in at:
                                now[i] += sign
                                late[i] += sign * step
                        step += 1
            if step:
                mean = np.array(now) - np.array(late) / step
                used = np.flatnonzero(mean)
                yield pd.DataFrame({"place": np.append(used, -1), "total": np.append(mean[used] * step, step)})

        sums = dealt.mapInPandas(epoch, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).toPandas()  # WIDTH + 1 rows at most
        if sums.empty:
            return weights
        total = dict(zip(sums["place"], sums["total"], strict=True))
        steps, weights = total.pop(-1), np.zeros(WIDTH)
        weights[list(total)] = np.array(list(total.values())) / steps
    return weights


def save(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    used = np.flatnonzero(weights)
    spark.createDataFrame(pd.DataFrame({"place": used, "weight": weights[used]}), "place long, weight double").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> np.ndarray:
    rows, weights = spark.read.parquet(path).toPandas(), np.zeros(WIDTH)
    weights[rows["place"]] = rows["weight"]
    return weights


def ranked_hits(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``n, hits`` of each row of ``tokens, kept``: of the best rated tokens, as many as are kept, how many are kept ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tokens, kept in zip(batch["tokens"], batch["kept"], strict=True):
                n = int(np.sum(kept))
                best = np.argsort(-scores(tokens, weights), kind="stable")[:n]
                out.append((n, int(np.sum(np.asarray(kept, bool)[best]))))
            yield pd.DataFrame(out, columns=["n", "hits"])

    return rows.select("tokens", "kept").mapInPandas(run, "n long, hits long")


@dataclass(frozen=True)
class TokenClassifier:
    """Keeps the best rated ``percent`` of each message's tokens, by the weights saved at ``path``."""

    percent: int
    path: str

    def __post_init__(self) -> None:
        if not 1 <= self.percent <= 100:
            raise ValueError("a token classifier keeps 1 to 100 percent")

    @property
    def name(self) -> str:
        return f"tokens_{self.percent}@{self.path}"

    def compact(self, messages: Column) -> Column:
        raise TypeError(f"{self.name} compacts rows, by contexts()")

    def contexts(self, rows: DataFrame, store, keys: Sequence[str]) -> DataFrame:
        """``keys, compacted_context`` of rows with ``injected`` messages; each message is a row while it is rated."""
        from palimpsest.operators.compactors import classified_tokens

        weights = load(rows.sparkSession, self.path)
        said = rows.select(*keys, F.posexplode_outer("injected").alias("place", "m")).select(*keys, "place", F.col("m.role").alias("role"), F.col("m.content").alias("text"))
        kept = classified_tokens(said, lambda tokens: scores(tokens, weights).tolist(), self.percent / 100, id_cols=(*keys, "place", "role"))
        listed = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "role", F.coalesce("kept", F.lit("")).alias("content")))))
        return kept.groupBy(*keys).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).cast(MESSAGES).alias("compacted_context"))
