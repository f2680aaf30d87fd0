"""Compactors: transforms from a message list to a shorter one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.messages import MESSAGES, message, total_tokens, transcript, user_turns
from palimpsest.functions.text import TOKEN_PATTERN, first_sentence
from palimpsest.operators.constraints import summary_prompt
from palimpsest.operators.tokenclass import TokenClassifier


class Compactor(Protocol):
    """A named column transform; ``compact`` returns a message list."""

    name: str

    def compact(self, messages: Column) -> Column: ...


@dataclass(frozen=True)
class RecentMessages:
    """The last ``n`` messages, whoever speaks."""

    n: int

    def __post_init__(self) -> None:
        if self.n < 1:
            raise ValueError("a recent-messages compactor keeps at least one message")

    @property
    def name(self) -> str:
        return f"recent_{self.n}"

    def compact(self, messages: Column) -> Column:
        return F.slice(messages, F.greatest(F.size(messages) - self.n, F.lit(0)) + 1, F.lit(self.n))


@dataclass(frozen=True)
class FirstSentences:
    """Extractive stand-in for a summariser: the first sentences of the first user turns."""

    turns: int = 3

    @property
    def name(self) -> str:
        return f"extract_{self.turns}"

    def compact(self, messages: Column) -> Column:
        places = F.slice(user_turns(messages), 1, self.turns)
        said = F.transform(places, lambda i: first_sentence(F.get(messages, i)["content"]))
        return F.array(message("assistant", F.array_join(said, " ")))


@dataclass(frozen=True)
class ModelSummary:
    """A model's summary of the transcript, as one assistant message, asked for in a style of ``SUMMARY_PROMPTS``.

    It works on rows, not on a column: ``contexts`` asks through a store of calls, so an
    equal transcript is summarised once, and a call that failed has no context until it is
    asked again.
    """

    style: str
    provider: str

    def __post_init__(self) -> None:
        summary_prompt(self.style, F.lit(""))  # an unknown style is an error here

    @property
    def name(self) -> str:
        return f"summary_{self.style}@{self.provider}"

    def compact(self, messages: Column) -> Column:
        raise TypeError(f"{self.name} compacts rows, by contexts()")

    def contexts(self, rows: DataFrame, store, keys: Sequence[str]) -> DataFrame:
        """``keys, compacted_context`` of rows with ``injected`` messages; null where the call failed or said nothing."""
        prompt = summary_prompt(self.style, transcript(F.col("injected")))
        asked = rows.select(*keys, F.array(message("user", prompt)).cast(MESSAGES).alias("talk"))
        said = F.trim("output")
        answers = store.answered(asked, self.provider, "talk", keys)
        return answers.select(*keys, F.when((F.col("status") == "success") & (said != ""), F.array(message("assistant", said)).cast(MESSAGES)).alias("compacted_context"))


def compactor(name: str) -> Compactor:
    """By name: ``recent_<n>``, ``extract_<n>``, ``summary_<style>@<provider>`` or ``tokens_<percent>@<weights>``."""
    if classifier := re.fullmatch(r"tokens_(\d+)@(.+)", name):
        return TokenClassifier(int(classifier[1]), classifier[2])
    if summary := re.fullmatch(r"summary_(\w+)@(.+)", name):
        return ModelSummary(summary[1], summary[2])
    found = re.fullmatch(r"(recent|extract)_(\d+)", name)
    if not found:
        raise ValueError(f"no compactor named {name}")
    return RecentMessages(int(found[2])) if found[1] == "recent" else FirstSentences(int(found[2]))


def compaction(before: Column, after: Column) -> Column:
    """Tokens before and after and their ratio, which is 1 for an empty input."""
    b, a = total_tokens(before), total_tokens(after)
    return F.struct(b.alias("tokens_before"), a.alias("tokens_after"), F.when(b == 0, 1.0).otherwise(a / b).alias("compression_ratio"))


def token_budget(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``key, kept, n_tokens, n_kept``: the rarest tokens of a conversation, in order, up to a budget.

    Rarity is the number of conversations a token occurs in; ties go to the earlier
    token, and newline-like force tokens are ``?``, always kept first.
    """
    tokens = turns.select(key, order, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)).alias("at", "token")).withColumn("word", F.lower("token"))
    listed = tokens.groupBy(key, "word").agg(F.collect_list(F.struct(order, "at", "token")).alias("places"))  # a row for each different word of a conversation
    spread = listed.groupBy("word").agg(F.count("*").alias("df"))
    ranked = F.transform("places", lambda x: F.struct((x["token"] != "?").cast("int").alias("late"), F.col("df").alias("df"), x[order].alias("turn"), x["at"].alias("at"), x["token"].alias("token")))
    whole = listed.join(spread, "word").groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(ranked))).alias("all"))
    best = F.transform(F.slice("all", 1, budget), lambda x: F.struct(x["turn"].alias("turn"), x["at"].alias("at"), x["token"].alias("token")))
    return whole.select(key, F.array_join(F.transform(F.array_sort(best), lambda x: x["token"]), " ").alias("kept"), F.size("all").cast("long").alias("n_tokens"), F.least(F.size("all"), F.lit(budget)).cast("long").alias("n_kept"))


def classified_tokens(df: DataFrame, scores: Callable[[list[str]], list[float]], rate: float, text: str = "text", id_cols: tuple[str, ...] = ("source_row_index",), force: tuple[str, ...] = ("\n", "?"), window: int = 512) -> DataFrame:
    """``id_cols, kept, n_tokens, n_kept``: what a token classifier keeps of each text, in order.

    ``scores`` gives, for a window of tokens, how much each is worth keeping; the best
    ``rate`` of a text's tokens stay (at least one), ties to the earlier, and ``force``
    tokens besides.  A null text stays null.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    pieces = re.compile(r"\n|\w+|[^\w\s]")

    def keep(value: str | None) -> tuple[str | None, int, int]:
        if value is None:
            return None, 0, 0
        tokens = pieces.findall(value)
        worth = [s for at in range(0, len(tokens), window) for s in scores(tokens[at : at + window])]
        best = sorted(range(len(tokens)), key=lambda i: (-worth[i], i))[: max(1, int(rate * len(tokens)))]
        chosen = sorted({*best, *(i for i, t in enumerate(tokens) if t in force)}) if tokens else []
        return " ".join(tokens[i] for i in chosen), len(tokens), len(chosen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([keep(v) for v in batch[text]], columns=["kept", "n_tokens", "n_kept"])
            yield pd.concat([batch[list(id_cols)].reset_index(drop=True), made], axis=1)

    return df.select(*id_cols, text).mapInPandas(run, f"{fields}, kept string, n_tokens long, n_kept long")


def model_compaction(df: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", retries: int = 3, id_cols: tuple[str, ...] = ("source_row_index",)) -> DataFrame:
    """Summaries by a model: ``id_cols, summary, status, error``.

    A batch is tried ``retries`` times, then each of its rows as often; a row that
    still fails becomes status ``error`` with its message and never fails the task.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def attempt(prompts: list[str]) -> list[str] | Exception:
        last: Exception = RuntimeError("no attempt was made")
        for _ in range(retries):
            try:
                out = model(prompts)
                if len(out) != len(prompts):
                    raise ValueError(f"{len(out)} outputs for {len(prompts)} prompts")
                return out
            except Exception as e:  # a poison row must not stop the others
                last = e
        return last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts, out = batch[prompt].tolist(), attempt(batch[prompt].tolist())
            rows = [(o, "success", None) for o in out] if isinstance(out, list) else []
            if not rows:
                for p in prompts:
                    one = attempt([p])
                    rows.append((one[0], "success", None) if isinstance(one, list) else (None, "error", str(one)))
            yield pd.concat([batch[list(id_cols)].reset_index(drop=True), pd.DataFrame(rows, columns=["summary", "status", "error"])], axis=1)

    return df.select(*id_cols, prompt).mapInPandas(run, f"{fields}, summary string, status string, error string")


def batch_size(context_tokens: int, output_tokens: int, most: int = 30_000_000) -> int:
    """How many requests of a size fit a batch's token limit, one at least."""
    return max(1, most // max(1, context_tokens + output_tokens))
