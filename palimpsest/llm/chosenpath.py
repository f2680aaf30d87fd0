"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles; equal sets are one node.  A set's minwise
tokens are its least shingles under independent hash functions, so two sets of
similarity s hold the same token at a place with probability s.  A tree begins with one
minwise token of each set: the sets that hold it are a tree node.  A small tree node is
compared exhaustively.  A large one is branched: two places that its path selects send
each of its sets on to the tree nodes of its tokens there, and so on.  A large tree
node whose sets agree for the most part at probe places would never come apart; it is
compared as well, in pairs of blocks of bounded size.  So is one at the last level.

A pair at the threshold s survives a tree with probability of at least s (1 - x), where
x is the least root of ``x = (1 - s + s x)**2`` (Threshold.survival); independent trees
are repeated until the chance to miss a pair is below ``1 - recall``.

The first tree is compared alone, and each set takes the least set that it was found
connected to as its label; in the other trees a tree node whose sets have one label is left
out, and sets of one label are not compared again, so a large group of copies is compared
once and not in every tree.  Comparing means: Hamming distance of whole parity sketches, which bounds the sets'
difference from below and never loses a link; then full shingle sets.

Defined results: a text without words, or null, has an empty set and is linked with
nothing; with fewer words than a shingle, the word sequence is its only shingle; repeated
rows are documents of equal sets, and rows that repeat an id each have their own text's
links; a row with a null id is linked like any other, but names its component only if all
ids there are null, and then is not kept; a similarity that equals the threshold links; a
text of any length is one set, whole; of a component the least id is kept, on every row
that has it; columns beside id and text, whatever their names, are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed, claim, id_text, ids_are_keys, row_keys, slices, stored, text_bytes
from palimpsest.llm.graph import components
from palimpsest.llm.jaccard import Threshold, fingerprint, folded, mix, shingle_set, whole_sketch

#: Sets of a tree node that is compared at once, levels below a tree's first, places for each level, and probe places.
SMALL, LEVELS, PLACES, PROBES = 1024, 5, 4, 4
#: A large tree node is dense where its sets agree at this share of the probe places or more.
DENSE = 0.5
#: Shingles of a block, and about as many of a task of small tree nodes, when sketches and when full sets are compared.
SKETCH_BLOCK, SET_BLOCK = 8_000_000, 1_000_000


def survival(num: int, den: int) -> float:
    """The least probability that a pair of similarity num / den meets in a given tree."""
    s, x = num / den, 0.0
    for _ in range(LEVELS):  # a pair dies out in all branches below
        x = (1 - s + s * x) ** 2
    return s * (1 - x)


def trees_for(recall: float, num: int, den: int) -> int:
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - survival(num, den))))


def minwise(shingles: np.ndarray, places: int) -> np.ndarray:
    """The least hash of the shingles under each of ``places`` functions."""
    base, out = mix(shingles, 81), np.full(places, np.iinfo(np.uint64).max, np.uint64)
    functions = ((2 * np.arange(places, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for at in range(0, len(base), 2048):
        x = base[at : at + 2048] ^ functions
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        np.minimum(out, x.min(1), out=out)
    return out


def profiles(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """``doc_id, n_shingles, node, sketch, roots, tokens`` for every row.

    ``roots``: the path of each tree's first node.  ``tokens``: the minwise tokens below,
    in 32 bits each, as paths tell them apart; probe places first.
    """
    places = trees + PROBES + LEVELS * PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for batch in batches:
            for part in slices(batch, 1000):
                sizes, nodes, sketches, roots, tokens = [], [], [], [], []
                known: dict[int, tuple] = {}
                for text in text_bytes(part.column(1)):
                    s = shingle_set(text, k)
                    sizes.append(len(s))
                    if not len(s):
                        made = (None, None, None, None)
                    elif (name := fingerprint(s)) in known:
                        made = known[name]
                    else:
                        least = minwise(s, places)
                        first = mix(least[:trees] + np.arange(trees, dtype=np.uint64), 82).view(np.int64)
                        made = known[name] = (name, whole_sketch(s), first.tolist(), (least[trees:] >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist())
                    for column, value in zip((nodes, sketches, roots, tokens), made, strict=True):
                        column.append(value)
                arrays = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_shingles", "node", "sketch", "roots", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary, roots array<bigint>, tokens array<int>")


def branched(rows: DataFrame, level: int) -> DataFrame:
    """``tree, path, node, tokens`` of the children: two places of the level's own, selected by the path."""
    first = F.pmod(F.xxhash64("path"), F.lit(PLACES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(1)), F.lit(PLACES - 1)), F.lit(PLACES))
    start = PROBES + level * PLACES

    def child(place: Column) -> Column:
        return F.xxhash64("path", place, F.element_at("tokens", (place + start + 1).cast("int")))

    return rows.select("tree", F.explode(F.array(child(first), child(second))).alias("path"), "node", "tokens")


def tree_nodes(start: DataFrame) -> DataFrame:
    """``tree, path, node``: the members of every tree node to compare, from the first nodes' and ``tokens``.

    A level's sizes are a stored table, so that the join of members with them can be split
    where one path holds many.
    """
    leaves, now = [], start
    for level in range(LEVELS + 1):
        sizes = checkpointed(now.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"))
        big = sizes.filter(F.col("n") > SMALL)
        if level == LEVELS or big.isEmpty():
            leaves.append(now.join(sizes.select("path"), "path").select("tree", "path", "node"))
            break
        leaves.append(now.join(sizes.filter(F.col("n") <= SMALL).select("path"), "path").select("tree", "path", "node"))
        large = checkpointed(now.join(big, "path"))
        probes = F.posexplode(F.slice("tokens", 1, PROBES)).alias("place", "token")
        same = large.select("path", "n", probes).groupBy("path", "n", "place", "token").agg(F.count("*").alias("m"))
        agree = same.groupBy("path", "n").agg((F.sum(F.col("m").cast("double") * (F.col("m") - 1)) / (PROBES * F.col("n") * (F.col("n") - 1.0))).alias("share"))
        dense = checkpointed(agree.select("path", (F.col("share") >= DENSE).alias("dense")))
        marked = large.join(dense, "path")
        leaves.append(marked.filter("dense").select("tree", "path", "node"))
        now = checkpointed(branched(marked.filter("not dense"), level))
    return reduce(DataFrame.unionByName, leaves)


def dealt(members: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """Members (path, node, n_shingles) dealt to tasks of about ``block`` shingles: ``task, low, high`` and the block's number.

    Tree nodes of one block share tasks; in larger ones every pair of blocks is a task.
    """
    total = checkpointed(members.groupBy("path").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("blocks")))
    tasks = F.lit(max(1, -(-(members.agg(F.sum("n_shingles")).first()[0] or 0) // block)))
    placed = members.join(total, "path").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("path"), tasks)).otherwise(F.xxhash64("path", F.lit(1)))
    return placed.select("path", "node", "n_shingles", "label", "block", task.alias("task"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *columns)


def possible_pairs(label: np.ndarray, block: np.ndarray, i: int, upto: int, between: bool) -> np.ndarray:
    """Which of the members i + 1 to upto are to be compared with member i."""
    other = label[i + 1 : upto] != label[i]
    return other & (block[i + 1 : upto] != block[i]) if between else other


def sketch_partners(pdf: pd.DataFrame, threshold: Threshold) -> pd.DataFrame:
    """Members that the whole sketches leave a possible partner in their tree node."""
    gain, loss = threshold.den + threshold.num, threshold.den - threshold.num
    pdf = pdf.sort_values(["path", "n_shingles", "node"], ignore_index=True)
    path, nodes, sizes, block, label = (pdf[c].to_numpy() for c in ("path", "node", "n_shingles", "block", "label"))
    data, hit = pdf["sketch"].tolist(), np.zeros(len(pdf), bool)
    twice = np.concatenate([[False], (nodes[1:] == nodes[:-1]) & (path[1:] == path[:-1])])
    starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(path)], strict=True):
        own = slice(start, end)
        ends = start + np.searchsorted(sizes[own], sizes[own] * threshold.den // threshold.num, "right")
        if (ends <= np.arange(start + 1, end + 1)).all():
            continue
        between = bool((block[own] != block[start]).any())
        widths = np.array([len(d) // 8 for d in data[own]])
        width, first, sketches = 0, 0, None
        for i, upto in enumerate(ends.tolist(), start):
            if upto <= i + 1 or twice[i]:
                continue
            if (now := int(widths[i - start])) != width:  # members from here on, folded to this width
                width, first, last = now, i, int(ends[np.flatnonzero(widths == now)[-1]])
                sketches = np.concatenate([folded(np.frombuffer(d, np.uint64), width)[None] for d in data[i:last]])
            differ = np.bitwise_count(sketches[i + 1 - first : upto - first] ^ sketches[i - first]).sum(1)
            near = possible_pairs(label, block, i, upto, between) & ~twice[i + 1 : upto] & (differ * gain <= loss * (sizes[i + 1 : upto] + sizes[i]))
            if near.any():
                hit[i] = True
                hit[i + 1 : upto] |= near
    return pdf.loc[hit, ["path", "node", "label"]]


def similar_pairs(sets: list[np.ndarray], names: np.ndarray, label: np.ndarray, block: np.ndarray, threshold: Threshold) -> list[tuple[int, int]]:
    """Each set that is similar to others, or connected by them, with the least set of those.

    Full sets are compared by inverted lists of their shared shingles; pairs of one label,
    or connected by earlier pairs, are left out.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, names, label, block = [sets[i] for i in order], names[order], label[order], block[order]
    sizes, between = np.array([len(s) for s in sets]), len(set(block.tolist())) > 1
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = counts[column] > 1
    owner, column = owner[keep], column[keep]
    by_shingle = np.argsort(column, kind="stable")
    lists, starts = owner[by_shingle], np.searchsorted(column[by_shingle], np.arange(len(counts) + 1))
    mine = np.searchsorted(owner, np.arange(len(sets) + 1))
    group, linked_any = np.unique(label, return_inverse=True)[1], np.zeros(len(sets), bool)
    for i in range(len(sets)):
        own = column[mine[i] : mine[i + 1]]
        upto = int(np.searchsorted(sizes, sizes[i] * threshold.den // threshold.num, "right"))
        if not len(own) or upto <= i + 1:
            continue
        open_pairs = group[i + 1 : upto] != group[i]
        if between:
            open_pairs &= block[i + 1 : upto] != block[i]
        if not open_pairs.any():
            continue
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        common = np.bincount(lists[at], minlength=len(sets))[i + 1 : upto]
        for j in (np.flatnonzero(open_pairs & threshold.similar(common, int(sizes[i]), sizes[i + 1 : upto])) + i + 1).tolist():
            if group[j] != group[i]:
                linked_any |= (group == group[j]) | (group == group[i])
                group[group == group[j]] = group[i]
    return [(int(names[group == g].min()), int(x)) for g in np.unique(group[linked_any]) for x in names[group == g]]


def compared(members: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """``a, b``: the similar sets of each tree node, connected ones with the least of them.

    ``members``: path, node, label.  ``nodes``: node, doc_id, n_shingles, sketch.
    """
    group = ["task", "low", "high"]
    sized = checkpointed(members.join(nodes.select("node", "n_shingles"), "node"))
    sketched = dealt(sized, SKETCH_BLOCK, []).join(nodes.select("node", "sketch"), "node")
    near = sketched.groupBy(*group).applyInPandas(lambda pdf: sketch_partners(pdf, threshold), "path long, node long, label long").distinct()
    left = checkpointed(near.join(nodes.select("node", "n_shingles", "doc_id"), "node"))
    texts = dealt(left, SET_BLOCK, ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("words")
        found = []
        for _, rows in pdf.groupby("path", sort=False):
            rows = rows.drop_duplicates("node")
            if len(rows) > 1:
                sets = [shingle_set(t.encode(), k) for t in rows["text"]]
                found += similar_pairs(sets, *(rows[c].to_numpy() for c in ("node", "label", "block")), threshold)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return texts.select("path", "node", "label", "block", *group, "text").groupBy(*group).applyInPandas(verify, "a long, b long")


def linked(docs: DataFrame, k: int, num: int, den: int, recall: float) -> DataFrame:
    """As ``near_duplicates`` without ``kept``, of ``doc_id, text`` whose ids are keys."""
    threshold, trees = Threshold(num, den), trees_for(recall, num, den)
    rows = stored(profiles(docs, k, trees))
    first = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens"))
    nodes = stored(first)
    every = nodes.select(F.posexplode("roots").alias("tree", "path"), "node")
    shared = checkpointed(every.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path"))
    members = every.join(shared, "path").join(nodes.select("node", "tokens"), "node")
    met = checkpointed(tree_nodes(checkpointed(members.select("tree", "path", "node", "tokens"))))
    links = checkpointed(compared(met.filter("tree = 0").select("path", "node", F.col("node").alias("label")), nodes, docs, k, threshold))
    # connected to its label, each: sets of one label are of one component
    label = checkpointed(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
    others = checkpointed(met.filter("tree > 0").select("path", "node").join(label, "node", "left").select("path", "node", F.coalesce("label", "node").alias("label")))
    mixed = checkpointed(others.groupBy("path").agg((F.min("label") < F.max("label")).alias("mixed")).filter("mixed").select("path"))
    more = compared(others.join(mixed, "path"), nodes, docs, k, threshold)
    joined = components(links.unionByName(more))
    least = joined.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = nodes.select("node", "doc_id").join(joined, "node", "left").join(least, "root", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    # nodes are unique here; the rows of a very frequent set can be split by the join
    return rows.select("doc_id", "n_shingles", "node").join(stored(named), "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, recall: float = 1 - 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    ``num / den`` is the least similarity; ``recall`` the share of the pairs there that the
    trees find on average, more similar ones more often.
    """
    docs = id_text(df, id_col, text_col)
    if ids_are_keys(docs):
        found = linked(docs, k, num, den, recall)
    else:
        keyed = row_keys(docs, "row")
        rows = linked(keyed.select(F.col("row").alias("doc_id"), "text"), k, num, den, recall).withColumnRenamed("doc_id", "row")
        named = checkpointed(keyed.select("row", "doc_id").join(rows, "row"))
        least = checkpointed(named.groupBy("component_id").agg(F.min("doc_id").alias("least")))
        found = named.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, recall: float = 1 - 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that come first in their component; texts without words all stay."""
    key = "__path_key"
    docs = row_keys(df, key, id_col, text_col)
    first = linked(id_text(docs, key, text_col), k, num, den, recall).filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    return docs.join(first, key, "left_semi").select(*df.columns)
