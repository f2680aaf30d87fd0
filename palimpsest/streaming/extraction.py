"""The extraction fold over a stream of turns, keyed by conversation.

A conversation's state is its registry, and the last turn folded in.  Turns of one
micro-batch are folded in turn order.  A turn at or before the last one folded has
come late and is left out, so a repeated delivery changes nothing; registries equal
the batch fold's wherever turns arrive in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.extraction import DETECTOR

OUTPUT = "conv_id long, text string, source_turn_index int"
STATE = "last int, texts array<string>"


def fold(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """New registry items of one conversation."""
    last, texts = state.get if state.exists else (-1, [])
    texts, rows = list(texts), []
    for turn, role, text in sorted((int(t), r, x) for f in frames for t, r, x in zip(f["turn"], f["role"], f["text"], strict=True)):
        if turn <= last:
            continue
        last = turn
        for found in re.findall(DETECTOR, text or "") if role == "user" else ():
            if found not in texts:
                texts.append(found)
                rows.append((key[0], found, turn))
    state.update((last, texts))
    yield pd.DataFrame(rows, columns=["conv_id", "text", "source_turn_index"])


def extract_stream(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` in, registry items out as they are found."""
    return turns.groupBy("conv_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts and means in tumbling windows; works on a stream, where it bounds lateness, and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if timed.isStreaming else timed
    counts = marked.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n", F.round("mean_value", 9).alias("mean_value"))
