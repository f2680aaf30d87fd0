"""Parsers of model outputs as Spark columns; whatever cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def letter_grade(output: Column, letter: Column) -> Column:
    """Whether a bare A or B equals the right letter; null for any other output."""
    given = F.upper(stripped(output))
    return F.when(given.isin("A", "B"), given == letter)


def yes_no(output: Column) -> Column:
    given = F.upper(stripped(output))
    return F.when(given.startswith("YES"), True).when(given.startswith("NO"), False)


def channel_entries(output: Column) -> Column:
    """(label, content) for each ``[word]`` line, and ``text`` for what stands before the first."""
    marks = F.regexp_extract_all(output, F.lit(r"\[(\w+)\]\n"), 1)
    parts = F.transform(F.split(output, r"\[\w+\]\n"), stripped)
    named = F.arrays_zip(F.concat(F.array(F.lit("text")), marks).alias("label"), parts.alias("content"))
    return F.filter(named, lambda e: (e["label"] != "text") | (e["content"] != ""))


def channel(output: Column, label: str) -> Column:
    """Content of a channel; of several with one label the last counts."""
    found = F.filter(channel_entries(output), lambda e: e["label"] == label)
    return F.try_element_at(found, F.lit(-1))["content"]


def graded_text(output: Column) -> Column:
    """The final channel, else the text channel, else nothing; empty ones fall through."""
    return F.coalesce(F.nullif(channel(output, "final"), F.lit("")), F.nullif(channel(output, "text"), F.lit("")), F.lit(""))


def log_text(output: Column) -> Column:
    return F.concat_ws("\n", channel(output, "analysis"), graded_text(output))


EXTRACTED = "struct<scs: array<struct<text: string, evidence: string>>>"


def extracted_constraints(output: Column) -> Column:
    """Items of ``{"scs": [...]}`` in a fenced block, the last open brace block, or the whole text."""
    fenced = F.nullif(F.regexp_extract(output, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(output, r'(?s).*(\{\s*"scs".*\})', 1), F.lit(""))
    lists = [F.from_json(c, EXTRACTED)["scs"] for c in (fenced, last, F.trim(output))]
    items = F.filter(F.coalesce(*lists), lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) != "")
    trimmed = F.transform(items, lambda x: F.struct(F.trim(x["text"]).alias("text"), F.coalesce(x["evidence"], F.lit("")).alias("evidence")))
    return F.coalesce(trimmed, F.array().cast("array<struct<text: string, evidence: string>>"))


def json_verdict(output: Column) -> Column:
    """``true``, ``false`` or ``not_enough_information``; null otherwise."""
    found = F.lower(F.get_json_object(output, "$.verdict"))
    return F.when(found.isin("true", "false", "not_enough_information"), found)


def thinking_split(output: Column) -> Column:
    """(thinking, answer): balanced tags, or all before a lone closing tag."""
    balanced = F.regexp_extract(output, r"(?s)<think>(.*?)</think>", 1)
    lone = F.regexp_extract(output, r"(?s)^(.*?)</think>", 1)
    closes = output.contains("</think>")
    thinking = F.when(output.contains("<think>") & closes, balanced).when(closes, lone)
    answer = F.when(closes, F.regexp_replace(output, r"(?s)^.*?</think>", "")).otherwise(output)
    return F.struct(F.trim(thinking).alias("thinking"), F.trim(answer).alias("answer"))


def recovered_channels(stream: Column) -> Column:
    """(label, content) pairs of a raw ``<|channel|>name<|message|>text`` token stream."""
    names = F.regexp_extract_all(stream, F.lit(r"(?s)<\|channel\|>(\w+)[^<]*<\|message\|>(.*?)(?=<\||$)"), 1)
    texts = F.regexp_extract_all(stream, F.lit(r"(?s)<\|channel\|>(\w+)[^<]*<\|message\|>(.*?)(?=<\||$)"), 2)
    return F.arrays_zip(names.alias("label"), F.transform(texts, lambda x: F.trim(x)).alias("content"))


def recovered_calls(stream: Column) -> Column:
    """Names of tools called in a raw token stream, in order."""
    return F.regexp_extract_all(stream, F.lit(r"to=functions\.(\w+)"), 1)


RESPONSE = "array<struct<type: string, text: string, name: string, arguments: string, call_id: string>>"


def decoded_response(items: Column) -> Column:
    """(text, thinking, tool_calls) of a JSON list of typed items."""
    parsed = F.from_json(items, RESPONSE)
    of = lambda kind: F.filter(parsed, lambda x: x["type"] == kind)
    joined = lambda kind: F.array_join(F.transform(of(kind), lambda x: x["text"]), "")
    calls = F.transform(of("function_call"), lambda x: F.struct(x["name"].alias("name"), x["arguments"].alias("arguments"), x["call_id"].alias("call_id")))
    return F.struct(joined("message").alias("text"), joined("reasoning").alias("thinking"), calls.alias("tool_calls"))


def tool_names(calls: Column) -> Column:
    return F.transform(calls, lambda c: c["name"])
