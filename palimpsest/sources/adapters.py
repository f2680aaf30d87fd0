"""Source record shapes turned into one message list, as Spark columns.

Each adapter takes the columns a source has and gives ``messages``; ``normalised``
trims, maps roles and drops empty messages.  Columns a source lacks are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.messages import MESSAGES, cleaned, message

DEFAULT_QUESTION = "Please work through the following text."
#: Sources whose records name a language; only English ones are kept.
LANGUAGE_FILTERED = ("wildchat", "lmsyschat")


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def zipped(roles: Column, contents: Column) -> Column:
    """Parallel arrays as messages, as long as the shorter one."""
    n = F.least(F.size(roles), F.size(contents))
    pairs = F.arrays_zip(F.slice(roles, F.lit(1), n).alias("role"), F.slice(contents, F.lit(1), n).alias("content"))
    return F.transform(pairs, lambda p: message(p["role"], p["content"]))


def listed(turns: Column, kind: T.DataType) -> Column:
    """An array of structs: role else from, content else value, by which fields exist."""
    fields = kind.elementType.fieldNames()
    pick = lambda t, a, b: t[a] if a in fields else t[b] if b in fields else F.lit(None).cast("string")
    return F.transform(F.filter(turns, lambda t: t.isNotNull()), lambda t: message(pick(t, "role", "from"), pick(t, "content", "value")))


def _lists(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def from_turns(df: DataFrame) -> Column:
    """``conversations`` as a list of turns or a struct of lists, else record-level from and value."""
    if _has(df, "conversations"):
        kind = _kind(df, "conversations")
        if _lists(kind):
            return listed(F.col("conversations"), kind)
        if isinstance(kind, T.StructType):
            return zipped(F.col("conversations")["from"], F.col("conversations")["value"])
    if _has(df, "from", "value"):
        if isinstance(_kind(df, "from"), T.ArrayType):
            return zipped(F.col("from"), F.col("value"))
        return F.array(message(F.col("from"), F.col("value")))
    return F.array().cast(MESSAGES)


def from_messages(df: DataFrame) -> Column:
    """The first list among ``messages`` and ``conversation``, else parallel or single role and content."""
    found = [listed(F.col(c), _kind(df, c)) for c in ("messages", "conversation") if _has(df, c) and _lists(_kind(df, c))]
    if _has(df, "role", "content"):
        arrays = isinstance(_kind(df, "role"), T.ArrayType)
        found.append(zipped(F.col("role"), F.col("content")) if arrays else F.array(message(F.col("role"), F.col("content"))))
    return F.coalesce(*found) if found else F.array().cast(MESSAGES)


def from_json_prompt(df: DataFrame) -> Column:
    """``prompt`` holds JSON: a list of messages or one of them; anything else is an error."""
    prompt = F.trim("prompt")
    many, one = F.from_json(prompt, MESSAGES), F.from_json(prompt, "struct<role: string, content: string>")
    parsed = F.when(prompt.startswith("["), many).when(prompt.startswith("{"), F.array(one))
    sound = parsed.isNotNull() & (F.size(parsed) > 0)
    return F.when(sound, parsed).otherwise(F.raise_error(F.lit("the prompt is not a JSON list of messages")).cast(MESSAGES))


def from_question(df: DataFrame) -> Column:
    """A question (or the default one), its context, and the first answer; nothing is dropped."""
    question = F.coalesce(F.nullif(F.trim("input"), F.lit("")), F.lit(DEFAULT_QUESTION))
    return F.array(message("user", question), message("user", F.trim("context")), message("assistant", F.coalesce(F.trim(F.get("answers", F.lit(0))), F.lit(""))))


def from_parts(df: DataFrame) -> Column:
    """Contents are text, or lists of parts whose texts are joined by newlines."""
    kind = _kind(df, "messages")
    parts = isinstance(kind.elementType["content"].dataType, T.ArrayType)
    join = lambda c: F.array_join(F.filter(F.transform(c, lambda p: F.trim(p["text"])), lambda t: t != ""), "\n")
    text = lambda c: F.coalesce(join(c) if parts else c, F.lit(""))
    return F.transform("messages", lambda m: message(m["role"], text(m["content"])))


def from_memory_questions(df: DataFrame) -> Column:
    """A context message, then question and answer turns; of several answers the first counts."""
    answers = F.col("answers")
    if isinstance(_kind(df, "answers").elementType, T.ArrayType):
        answers = F.transform(answers, lambda a: F.get(a, F.lit(0)))
    turns = F.flatten(F.transform(F.arrays_zip(F.col("questions").alias("q"), answers.alias("a")), lambda p: F.array(message("user", p["q"]), message("assistant", p["a"]))))
    fits = (F.size("questions") == F.size(answers)) & (F.size("questions") > 0)
    made = F.concat(F.array(message("user", F.col("context"))), turns)
    return F.when(fits, made).otherwise(F.raise_error(F.lit("questions and answers do not match")).cast(MESSAGES))


def from_anything(df: DataFrame) -> Column:
    """Turns where a record has any, else messages."""
    turns = from_turns(df)
    return F.when(F.size(turns) > 0, turns).otherwise(from_messages(df))


ADAPTERS: dict[str, Callable[[DataFrame], Column]] = {
    "sharegpt": from_turns,
    "wildchat": from_messages,
    "ultrachat": from_messages,
    "lmsyschat": from_messages,
    "mrcr": from_json_prompt,
    "longbench": from_question,
    "openresearcher": from_parts,
    "memory": from_memory_questions,
}
#: Adapters whose messages are kept as they are.
VERBATIM = ("longbench",)


def normalised(df: DataFrame, source: str, preserve: tuple[str, ...] = (), nulls_as_text: bool = False) -> DataFrame:
    """``messages`` and the preserved columns; an unknown source takes any shape."""
    name = source.lower()
    if name in LANGUAGE_FILTERED and "language" in df.columns:
        df = df.filter(F.col("language") == "English")
    messages = ADAPTERS.get(name, from_anything)(df)
    return df.select((messages if name in VERBATIM else cleaned(messages, nulls_as_text)).alias("messages"), *preserve)
