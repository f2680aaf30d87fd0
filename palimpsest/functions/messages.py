"""Functions over message lists: arrays of (role, content) structs in turn order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import token_count

MESSAGES = "array<struct<role: string, content: string>>"


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def assemble(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its messages in turn order.

    A conversation's turns meet in one row, so its size is bounded by one context.
    """
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return listed.select(key, F.transform("m", lambda m: message(m["role"], m["content"])).alias("messages"))


def mapped_role(role: Column) -> Column:
    """user, system or assistant; anything unknown speaks as the assistant."""
    low = F.lower(F.trim(role))
    return F.when(low.isin("user", "human"), "user").when(low.isin("system", "developer"), "system").otherwise("assistant")


def runtime_role(role: Column) -> Column:
    """human and ai are renamed, other roles pass in lower case."""
    low = F.lower(F.trim(role))
    return F.when(low == "human", "user").when(low == "ai", "assistant").otherwise(low)


def cleaned(messages: Column, nulls_as_text: bool = False) -> Column:
    """Trimmed, mapped messages without empty ones; null contents go, or become ``None`` as text."""
    text = lambda m: F.trim(F.coalesce(m["content"], F.lit("None")) if nulls_as_text else m["content"])
    return F.filter(F.transform(messages, lambda m: message(mapped_role(m["role"]), text(m))), lambda m: m["content"] != "")


def projected(messages: Column) -> Column:
    return F.transform(messages, lambda m: message(m["role"], m["content"]))


def message_tokens(m: Column) -> Column:
    """Tokens of a role and a content, and one for the message."""
    return token_count(m["role"]) + token_count(m["content"]) + 1


def total_tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda total, m: total + message_tokens(m))


def message_lengths(df: DataFrame, count: Callable[[Column], Column], key: str, messages: str = "messages", name: str = "token_length") -> DataFrame:
    """``key, token_length``: as ``total_tokens``, with another counter, such as a tokenizer file's.

    Texts go to the counter one message a row, so no row holds more than a message.
    """
    said = df.select(key, F.explode_outer(messages).alias("m"))
    each = F.when(F.col("m").isNotNull(), count(F.col("m.role")) + count(F.col("m.content")) + 1).otherwise(0)
    return said.groupBy(key).agg(F.sum(each).cast("int").alias(name))


def user_turns(messages: Column) -> Column:
    """Zero-based places of user messages."""
    return F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())


def at_position(places: Column, position: Column) -> Column:
    """First, middle (``n // 2``) or last of the places; an empty list is an error."""
    n = F.size(places)
    at = F.when(position == "top", 1).when(position == "middle", F.floor(n / 2).cast("int") + 1).when(position == "bottom", n)
    return F.when(n > 0, F.get(places, at - 1)).otherwise(F.raise_error(F.lit("the context has no user turn")).cast("int"))


def system_only_first(messages: Column) -> Column:
    """The messages; a system message after the first place is an error."""
    late = F.exists(F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))), lambda m: m["role"] == "system")
    return F.when(late, F.raise_error(F.lit("a system message is not first")).cast(MESSAGES)).otherwise(messages)


def without_leading_system(messages: Column) -> Column:
    leads = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    return F.when(leads, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def without_system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def prefix_sums(values: Column) -> Column:
    """Running totals of an integer array."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    step = lambda a, v: F.struct((a["total"] + v).alias("total"), F.concat(a["sums"], F.array(a["total"] + v)).alias("sums"))
    return F.aggregate(values, start, step, lambda a: a["sums"])


def least_prefix(sums: Column, target: Column | int) -> Column:
    """Length of the shortest prefix (one at least) whose total reaches the target; all if none does."""
    target = F.lit(target) if isinstance(target, int) else target
    below = F.size(F.filter(sums, lambda s: s < target))
    return F.least(below + 1, F.size(sums))


def trimmed_to(messages: Column, target: Column | int) -> Column:
    """Last messages popped while the rest still reaches the target."""
    sums = prefix_sums(F.transform(messages, lambda m: message_tokens(m).cast("long")))
    return F.slice(messages, F.lit(1), least_prefix(sums, target))


def local_context(messages: Column, radius: int) -> Column:
    """Messages from ``radius`` user turns before the middle one to as many after it, with a
    following assistant reply; null with fewer than ``2 * radius + 1`` user turns."""
    places = user_turns(messages)
    n = F.size(places)
    middle = F.floor(n / 2).cast("int")
    first, last = F.get(places, middle - radius), F.get(places, middle + radius)
    reply = F.coalesce(F.get(messages, last + 1)["role"] == "assistant", F.lit(False)).cast("int")
    return F.when(n >= 2 * radius + 1, F.slice(messages, first + 1, last - first + 1 + reply))


def rendered(messages: Column) -> Column:
    """Judge form: role, colon, newline, content; blank lines between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":\n"), m["content"])), "\n\n")


def transcript(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), m["content"])), "\n")


def numbered(items: Column, empty: str = "(none)") -> Column:
    lines = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(empty)


def embedding_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n\n")


def probing_conversation(system: Column, tools: Column, context: Column, probe: Column) -> Column:
    """System prompt, tool description, the context, and the probe as the last user turn."""
    return F.concat(F.array(message("system", system), message("developer", tools)), projected(context), F.array(message("user", probe)))


def contains_text(messages: Column, text: Column) -> Column:
    """The lexical judge: some message holds the text, compared without case and punctuation."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return F.exists(messages, lambda m: F.contains(plain(m["content"]), F.trim(plain(text))))
