"""Scalar text functions as Spark columns: tokens, draws, labels, slugs."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits and underscores, or one other visible character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
FIRST_SENTENCE = r"^[^.!?\n]*[.!?]?"


def token_count(text: Column) -> Column:
    """Tokens of a text; null for null."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def vocabulary_token_count(path: str, special: bool = False) -> Callable[[Column], Column]:
    """Counts tokens by a tokenizer file instead of the pattern; null for null.

    The file is read once in each Python worker; texts come to it in Arrow batches.
    """

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(path)
        known = texts.notna()
        found = pd.Series(0, index=texts.index, dtype="float").where(known)
        lengths = [len(e.ids) for at in range(0, int(known.sum()), 256) for e in tokenizer.encode_batch_fast(texts[known].iloc[at : at + 256].tolist(), add_special_tokens=special)]
        found[known] = lengths
        return found.astype("Int32")

    return count


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def draw(*parts: Column | str | int) -> Column:
    """A uniform number in [0, 1) fixed by the parts, joined with bars."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, FIRST_SENTENCE, 0)


def ordered_rank(value: Column, order: Sequence[str]) -> Column:
    """Place in a preferred order; values not listed come after it."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def length_label(name: Column) -> Column:
    """What follows the last underscore, or the whole name."""
    return F.substring_index(name, "_", -1)


def config_label(name: Column) -> Column:
    """The name without its last underscore part."""
    return F.regexp_replace(name, "_[^_]*$", "")


def token_target(text: Column) -> Column:
    """``10k``, ``1.5m``, ``2_000`` or plain digits as a whole number of tokens; null if none."""
    clean = F.lower(F.replace(F.trim(text), F.lit("_"), F.lit("")))
    digits = F.nullif(F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)[km]?$", 1), F.lit("")).cast("decimal(20,6)")
    unit = F.when(clean.endswith("k"), 1000).when(clean.endswith("m"), 1_000_000).otherwise(1)
    return F.floor(digits * unit).cast("long")


def context_tokens(name: Column) -> Column:
    """Thousands named by a part of a dataset name such as ``10k``, as tokens; null if no part is one.

    Parts stand between underscores or dashes; a part counts if it ends in digits and a ``k``.
    """
    parts = F.transform(F.split(F.lower(name), "[_-]"), lambda part: F.regexp_extract(part, "([0-9]+)k$", 1))
    return F.get(F.filter(parts, lambda digits: digits != ""), F.lit(0)).cast("long") * 1000


def slug(text: Column, default: str = "run") -> Column:
    """Runs of other characters than letters and digits become one underscore."""
    plain = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", default).otherwise(plain)


def display_label(name: Column, suffixes: dict[str, str], models: dict[str, str]) -> Column:
    """A compactor's shown name: prompt suffixes are tried longest first, then the model map."""
    base = F.regexp_replace(name, "_prompt$", "")
    shown = _model_label(base, models)
    for suffix in sorted(suffixes, key=len):  # the longest is tested first
        cut = F.substring(base, F.lit(1), F.length(base) - len(suffix))
        shown = F.when(base.endswith(suffix), F.concat(_model_label(cut, models), F.lit(f" ({suffixes[suffix]})"))).otherwise(shown)
    return shown


def _model_label(name: Column, models: dict[str, str]) -> Column:
    shown = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    for key, label in models.items():
        shown = F.when(name == key, label).otherwise(shown)
    return shown


def family(name: Column, markers: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The first marker contained in the lower-cased name decides."""
    low, found = F.lower(name), F.lit(default)
    for marker, label in reversed(markers):
        found = F.when(low.contains(marker), label).otherwise(found)
    return found


def flag_suffix(label: Column, flags: Sequence[tuple[str, bool, bool]]) -> Column:
    """(explicit, hard) by ordered label suffixes; an unknown label is an error."""
    found = F.raise_error(F.concat(F.lit("no framing in label "), label)).cast("struct<explicit: boolean, hard: boolean>")
    for suffix, explicit, hard in reversed(flags):
        found = F.when(label.endswith(suffix), F.struct(F.lit(explicit).alias("explicit"), F.lit(hard).alias("hard"))).otherwise(found)
    return found


def verdict_number(verdict: Column) -> Column:
    """``true`` is 1, ``false`` 0, anything else null."""
    low = F.lower(verdict.cast("string"))
    return F.when(low == "true", 1.0).when(low == "false", 0.0)


def human_label(answer: Column) -> Column:
    """A reviewer's answer as a boolean; null if not recognised."""
    low = F.lower(F.trim(answer))
    return F.when(low.isin("yes", "y", "true", "1", "present"), True).when(low.isin("no", "n", "false", "0", "absent"), False)


def compactor_name(config: Column) -> Column:
    """The name out of a JSON or single-quoted configuration; other text is the name itself."""
    json = F.replace(config, F.lit("'"), F.lit('"'))
    return F.when(config.startswith("{"), F.get_json_object(json, "$.name")).otherwise(config)


def abbreviated(dataset: Column, compactor: Column) -> Column:
    """Capitals of the shown dataset, and the compactor with its variant's initial."""
    capitals = F.regexp_replace(F.initcap(F.replace(dataset, F.lit("_"), F.lit(" "))), "[^A-Z0-9]", "")
    short = F.regexp_replace(compactor, r"\s*\(([A-Za-z])[^)]*\)", "-$1")
    return F.concat_ws(" ", capitals, short)


def hashed_vector(text: Column, width: int) -> Column:
    """Token counts by hash bucket: an embedder that needs no model; divide by its length to compare."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)
    buckets = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(width)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.size(F.filter(buckets, lambda x: x == b)).cast("double"))
