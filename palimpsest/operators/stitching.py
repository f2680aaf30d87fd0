"""Dataset construction: trimming, pairing, concatenation, neighbours, topic stitching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.messages import total_tokens, trimmed_to, without_leading_system, without_system
from palimpsest.operators.common import ordered_fold, row_index

#: A stitched row may exceed its target by this factor before its tail is cropped.
SLACK = 0.8
BLOCK_ROWS = 4096
#: Rows of a block that is scored at once by the greedy stitching, and seeds that are looked at ahead of their turn.
SCORED_ROWS, MOST_GUESSED = 1024, 256


def trimmed_rows(context: DataFrame, target: int, key: str = "conv_id", num_rows: int | None = None) -> DataFrame:
    """Contexts that reach the target, trimmed to it; an error if fewer than ``num_rows`` do."""
    long = context.withColumn("token_length", total_tokens(F.col("messages"))).filter(F.col("token_length") >= target)
    cut = long.withColumn("messages", trimmed_to(F.col("messages"), target)).withColumn("token_length", total_tokens(F.col("messages")))
    if num_rows is None:
        return cut
    chosen = cut.orderBy(key).limit(num_rows)
    if (found := chosen.count()) < num_rows:
        raise ValueError(f"{found} of {num_rows} rows reach {target} tokens")
    return chosen


def paired_rows(context: DataFrame, target: int, key: str = "conv_id") -> DataFrame:
    """Neighbouring trimmed rows joined in pairs; the second loses its system messages; an odd row goes."""
    rows = row_index(trimmed_rows(context, target, key), [key], "rn")
    second = F.col("rn") % 2 == 1
    rows = rows.withColumn("messages", F.when(second, without_system(F.col("messages"))).otherwise(F.col("messages")))
    pairs = rows.groupBy(F.floor(F.col("rn") / 2).alias("source_row_index")).agg(F.array_sort(F.collect_list(F.struct("rn", "messages"))).alias("p"))
    joined = F.flatten(F.transform("p", lambda x: x["messages"]))
    return pairs.filter(F.size("p") == 2).select("source_row_index", joined.alias("messages"), total_tokens(joined).alias("token_length"), F.lit(2).alias("source_conversation_count"))


def joined_messages(lists: Column, one_system: Column) -> Column:
    """Message lists in order; where told, only the first keeps its leading system message."""
    return F.flatten(F.transform(lists, lambda x, i: F.when(one_system & (i > 0), without_leading_system(x)).otherwise(x)))


def stitching_lengths(context: DataFrame, one_system: bool, key: str = "conv_id") -> DataFrame:
    """``key, token_length, later_length``: what a context adds to a row as its first and as a later part."""
    whole = total_tokens(F.col("messages"))
    later = total_tokens(without_leading_system(F.col("messages"))) if one_system else whole
    return context.select(key, whole.alias("token_length"), later.alias("later_length"))


def concatenated(context: DataFrame, target: int, key: str = "conv_id", num_rows: int | None = None) -> DataFrame:
    """``source_row_index, sources, token_length, is_empty``: rows of consecutive contexts.

    Lengths add up in key order until the target; the tail is then cropped to
    ``target / SLACK``, which may leave nothing.  The last row is dropped if short.  A
    context that is not its row's first counts ``later_length``, where there is one.
    """
    most = target / SLACK

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, ids, lengths = 0, [], []
        for batch in batches:
            rows = []
            for i, n, m in zip(batch["id"].tolist(), batch["n"].tolist(), batch["m"].tolist(), strict=True):
                lengths.append(m if ids else n)
                ids.append(i)
                if sum(lengths) >= target:
                    while lengths and sum(lengths) > most:
                        ids.pop(), lengths.pop()
                    if num_rows is None or index < num_rows:
                        rows.append((index, ids, sum(lengths), not ids))
                    index, ids, lengths = index + 1, [], []
            yield pd.DataFrame(rows, columns=["source_row_index", "sources", "token_length", "is_empty"])

    size = F.col("token_length") if "token_length" in context.columns else total_tokens(F.col("messages"))
    later = F.col("later_length") if "later_length" in context.columns else size
    narrow = context.select(F.col(key).cast("long").alias("id"), size.cast("long").alias("n"), later.cast("long").alias("m"))
    return ordered_fold(narrow, ["id"], fold, "source_row_index long, sources array<long>, token_length long, is_empty boolean")


def stitched_messages(rows: DataFrame, context: DataFrame, key: str = "conv_id", one_system: bool = False) -> DataFrame:
    """The message lists of ``concatenated`` rows: ``source_row_index, messages``."""
    places = rows.select("source_row_index", F.posexplode("sources").alias("pos", key))
    lists = places.join(context.select(key, "messages"), key).groupBy("source_row_index").agg(F.array_sort(F.collect_list(F.struct("pos", "messages"))).alias("l"))
    return lists.select("source_row_index", joined_messages(F.transform("l", lambda x: x["messages"]), F.lit(one_system)).alias("messages"))


def normalised(vector: Column) -> Column:
    """Divided by its length; a zero vector has none and gives nulls."""
    x = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y))
    return F.transform(x, lambda y: y / F.nullif(norm, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def nearest_among(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k rows of ``b`` nearest to each of ``a``, itself left out; ``b`` is sorted by id.

    Only rows that can be among the k by their rounded scores are rounded and sorted.
    """
    x, y, parts = np.stack(a["v"]).astype(float), np.stack(b["v"]).astype(float), []
    others, k = b["id"].to_numpy(), min(k, len(b))
    for at in range(0, len(a), 512):
        ids = a["id"].to_numpy()[at : at + 512]
        scores = x[at : at + 512] @ y.T
        scores[np.isnan(scores) | (ids[:, None] == others[None])] = -np.inf
        least = np.partition(scores, len(b) - k, axis=1)[:, len(b) - k]
        row, col = np.nonzero(scores >= least[:, None] - 2e-9)  # rounding moves a score by 5e-10 at most
        rounded = np.round(scores[row, col], 9)
        order = np.lexsort((col, -rounded, row))
        row, col, rounded = row[order], col[order], rounded[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        parts.append(pd.DataFrame({"query_id": ids[row[best]], "neighbour_id": others[col[best]], "similarity": rounded[best]}))
    out = pd.concat(parts)
    return out[np.isfinite(out["similarity"])]


def nearest(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, neighbour_id, similarity``: every row's k nearest by inner product.

    Rows are dealt to blocks of bounded size; each pair of blocks meets once, in a task
    that returns k candidates for every row of both, and a row's candidates are merged.
    """
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("b"))
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "v", "b", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        low, high = pdf[pdf["b"] == pdf["low"]], pdf[pdf["b"] == pdf["high"]]
        sides = [(low, high)] if len(low) == len(high) == len(pdf) else [(low, high), (high, low)]
        parts = [nearest_among(a.reset_index(drop=True), b.reset_index(drop=True), k) for a, b in sides if len(a) and len(b)]
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "neighbour_id": [], "similarity": []})

    found = met.groupBy("low", "high").applyInPandas(solve, "query_id long, neighbour_id long, similarity double")
    place = W.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", F.round("similarity", 6).alias("similarity"))


def nearest_to_seed(vectors: DataFrame) -> DataFrame:
    """``label, seed_id, nearest_id``: each label's first row and the nearest other one."""
    seeds = vectors.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("s"))
    others = vectors.join(seeds, "label").filter(F.col("vec_id") != F.col("s.vec_id"))
    near = F.struct((-F.round(dot(F.col("embedding"), F.col("s.embedding")), 9)).alias("d"), F.col("vec_id").alias("i"))
    return others.groupBy("label", F.col("s.vec_id").alias("seed_id")).agg(F.min_by("vec_id", near).alias("nearest_id"))


class FreeRows:
    """Unused rows, and the nearest of them to many centres at once.

    A block of rows is scored against all centres in one product of single precision;
    rows that can be a centre's best, by that product's error, are scored once more in
    double precision, so the nearest is exact.  Used rows are packed away by ``pack``.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.free, self.left = vectors, np.ones(len(vectors), bool), len(vectors)
        self.error = 4 * (vectors.shape[1] + 4) * float(np.finfo(np.float32).eps)  # of two scores' difference, for lengths of at most 1
        self.rows, self.single = np.arange(len(vectors)), vectors.astype(np.float32)

    def take(self, row: int) -> None:
        self.free[row], self.left = False, self.left - 1

    def put_back(self, row: int) -> None:
        self.free[row], self.left = True, self.left + 1

    def pack(self) -> None:
        keep = self.free[self.rows]
        self.rows, self.single = self.rows[keep], self.single[keep]

    def nearest(self, centres: np.ndarray, without: list[list[int]]) -> list[int]:
        """Each centre's nearest free row that is not in its list, or -1: best rounded score, then smallest row."""
        used = np.flatnonzero(~self.free[self.rows])
        owner = np.repeat(np.arange(len(without)), [len(w) for w in without])
        barred = np.concatenate([np.asarray(w, np.int64) for w in without])
        place = np.searchsorted(self.rows, barred)
        there = np.append(self.rows, -1)[place] == barred
        order = np.argsort(place[there], kind="stable")
        place, owner = place[there][order], owner[there][order]
        single, starts = centres.astype(np.float32), np.arange(0, len(self.rows), SCORED_ROWS)
        most = np.full((len(centres), len(starts)), -np.inf, np.float32)
        gone, own = (np.searchsorted(x, np.append(starts, len(self.rows))) for x in (used, place))
        for i, at in enumerate(starts):
            scores = single @ self.single[at : at + SCORED_ROWS].T
            scores[:, used[gone[i] : gone[i + 1]] - at] = -np.inf
            scores[owner[own[i] : own[i + 1]], place[own[i] : own[i + 1]] - at] = -np.inf
            most[:, i] = scores.max(1)
        found, least = [], most.max(1, initial=-np.inf) - np.float32(self.error)
        for c, barred_rows in enumerate(without):
            rows = []
            for at in starts[most[c] >= least[c]] if np.isfinite(least[c]) else ():
                close = np.flatnonzero(self.single[at : at + SCORED_ROWS] @ single[c] >= least[c] - self.error)
                rows += [r for r in self.rows[at + close].tolist() if self.free[r] and r not in barred_rows]
            scores = np.round(self.vectors[rows] @ centres[c], 9) if rows else np.empty(0)
            found.append(rows[int(scores.argmax())] if rows else -1)  # rows ascend
        return found


class Unfilled(ValueError):
    """The rows left cannot fill another row, or fewer rows were made than asked for."""


def cohesive_pool(ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, target: int, later: np.ndarray | None = None, rows: int | None = None) -> list[tuple[list[int], int]]:
    """Greedy rows of one pool: seeds in id order, then the nearest unused to the centroid.

    The next seeds' rows are guessed together, each as if it came next; a row taken by an
    earlier seed meanwhile ends a guess, and the steps from there are made one by one.
    ``later``: lengths of rows that do not come first, without their leading system
    message.  Past ``target / SLACK`` the latest rows are put back, never the seed.  With
    ``rows``, so many are made, and it is an error if the pool cannot fill them; without,
    as many as it fills.
    """
    order = np.argsort(ids)
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    later = lengths if later is None else later[order]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    index, out, seed, most = FreeRows(vectors), [], 0, int(target / SLACK)
    free, guessed, batch, wrong, used = index.free, {}, 1, 0, 0

    def centre(taken: list[int]) -> np.ndarray:
        mean = vectors[taken].mean(0)
        return mean / max(np.linalg.norm(mean), 1e-12)

    def guesses(seeds: list[int]) -> dict[int, list[int]]:
        """What each seed would take if it came next."""
        chains = {s: [s] for s in seeds}
        totals = {s: int(lengths[s]) for s in seeds}
        while open_seeds := [s for s, total in totals.items() if total < target]:
            for s, row in zip(open_seeds, index.nearest(np.stack([centre(chains[s]) for s in open_seeds]), [chains[s] for s in open_seeds]), strict=True):
                if row < 0:
                    del totals[s]
                else:
                    chains[s].append(row)
                    totals[s] += int(later[row])
        return {s: chain[1:] for s, chain in chains.items()}

    while index.left if rows is None else len(out) < rows:
        while seed < len(free) and not free[seed]:
            seed += 1
        if seed == len(free):
            raise Unfilled(f"{len(out)} of {rows} rows were made before the pool was used up")
        if seed not in guessed:
            batch = max(1, batch // 2) if 4 * wrong > used else min(MOST_GUESSED, 2 * batch) if 8 * wrong <= used else batch
            index.pack()
            seeds = index.rows[: batch if rows is None else min(batch, rows - len(out))].tolist()
            guessed, wrong, used = guesses(seeds) if len(seeds) > 1 else {seed: []}, 0, 0
        # a guessed row that is still free is the nearest of what is free now
        taken, total, guess = [seed], int(lengths[seed]), guessed[seed][::-1]
        hoped = bool(guess)
        index.take(seed)
        while total < target and index.left:
            if guess and not free[guess[-1]]:
                guess, wrong = [], wrong + 1
            taken.append(guess.pop() if guess else index.nearest(centre(taken)[None], [taken])[0])
            index.take(taken[-1])
            total += int(later[taken[-1]])
        used += hoped
        if total < target:
            if rows is None:
                break
            raise Unfilled(f"the rows left hold {total} of {target} tokens; {len(out)} of {rows} rows were made")
        while len(taken) > 1 and total > most:
            total -= int(later[taken[-1]])
            index.put_back(taken.pop())
        out.append((ids[taken].tolist(), total))
    return out


def topic_cohesive(lengths: DataFrame, vectors: DataFrame, target: int, key: str = "conv_id", pool: str | None = None, rows: int | None = None) -> DataFrame:
    """``pool, row, sources, token_length``: greedy topic rows over all of the dataset.

    ``lengths``: key, ``token_length`` and, where leading system messages are dropped from
    later rows, ``later_length``.  Every step needs the one before, over all rows: the
    dataset's ids, lengths and vectors, not its texts, are solved in one task.  For a
    dataset too large for that, ``pool`` names a column of ``vectors`` (a topic label)
    whose values are solved apart, each in a task; rows then never mix labels.
    """
    joined = vectors.join(lengths, vectors["vec_id"] == lengths[key])
    later = F.col("later_length") if "later_length" in lengths.columns else F.col("token_length")
    narrow = joined.select((F.col(pool) if pool else F.lit(0)).cast("long").alias("pool"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("token_length").alias("n"), later.alias("m"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        made = cohesive_pool(pdf["id"].to_numpy(), np.stack(pdf["v"]).astype(float), pdf["n"].to_numpy(), target, pdf["m"].to_numpy(), rows)
        return pd.DataFrame([(pdf["pool"].iloc[0], i, s, t) for i, (s, t) in enumerate(made)], columns=["pool", "row", "sources", "token_length"])

    return narrow.groupBy("pool").applyInPandas(solve, "pool long, row int, sources array<long>, token_length long")


def byte_bins(rows: DataFrame, most_rows: int, most_bytes: int, id_col: str, size_col: str) -> DataFrame:
    """``id, bin``: contiguous bins of bounded rows and bytes; a single oversize row is an error."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, count, total = 0, 0, 0
        for batch in batches:
            bins = []
            for i, size in zip(batch["id"].tolist(), batch["size"].tolist(), strict=True):
                if size > most_bytes:
                    raise ValueError(f"row {i} has {size} bytes, more than a bin")
                if count and (count == most_rows or total + size > most_bytes):
                    number, count, total = number + 1, 0, 0
                count, total = count + 1, total + size
                bins.append(number)
            yield pd.DataFrame({"id": batch["id"], "bin": bins})

    narrow = rows.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("long").alias("size"))
    return ordered_fold(narrow, ["id"], fold, "id long, bin long")
