"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles.  Equal sets are one node.  Each set is
dealt into chunks by a hash; a chunk's shingles flip bits of that chunk's sketch,
so two sketches differ in no more chunks than the sets differ in elements.  Sets
of one size band whose similarity reaches the threshold differ in at most D
elements: of D + 1 + 2q chunks they agree in 2q + 1, and still in one after each
set has left out its q lightest chunks.  Chunks that agree are found by one
shuffle of (chunk key, node) pairs.  A chunk without shingles says nothing and has no
key.  A set with at most 2q such chunks agrees with a similar one in another chunk as
well, which both keep: chunks without shingles are the lightest, so they are left out
first.  Sets with more of them also take part by their D + 1 shingles of least hash, of
which sets that differ in at most D elements share one.

The nodes of a key belong to its least node's cluster, so each pair that shares a
key meets in a cluster, and a cluster is a row for each member, not for each pair.
Clusters are compared twice, in blocks of bounded size: first whole sketches of
about a bit for each shingle, whose Hamming distance bounds the sets' difference
from below; then, for nodes with a partner left, the true sets.  A task returns no
more links than a spanning forest, so no pair list of a group is ever made.

Defined results: a text without words, or null, has an empty set and is linked
with nothing; with fewer words than a shingle, the word sequence is its only
shingle; repeated rows are documents of equal sets, and rows that repeat an id each
have their own text's links; a row with a null id is linked like any other, but names
its component only if all ids there are null; a similarity that equals the threshold
links; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BatchCache, checkpointed, claim, id_text, ids_are_keys, row_keys, slices, split_words, text_bytes
from palimpsest.llm.graph import components

CACHE_BYTES = 56 << 20
#: One in LIGHT_SHARE of the elements that may differ, and at least one from LIGHT_FROM on, is the number of chunks left out.
BAND_RATIO, LIGHT_SHARE, LIGHT_FROM = 1.5, 12, 5
#: Shingles of a block, and about as many of a task of small clusters, when sketches and when true sets are compared.
SKETCH_BLOCK, SET_BLOCK = 8_000_000, 1_000_000
_BITS = 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_64_digest(w) for w in words]


@lru_cache(maxsize=1)
def _memo() -> BatchCache:
    return BatchCache(_word_hashes, CACHE_BYTES)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased."""
    words = split_words(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(_memo().get(words).__getitem__, words)), "<u8")
    width = min(k, len(hashes))
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        total += mix(hashes[i : i + len(total)], i + 1) * _MULTIPLIERS[i % 8]
    return np.unique(mix(total, 100 + width))


class Threshold:
    """Similarity ``num / den`` or more; size bands and what they allow to differ."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND_RATIO)))
        self.bounds = np.array(self.starts)

    def bands(self, n: int) -> list[int]:
        """The size's own band, and all above where a partner could be similar enough."""
        own = int(np.searchsorted(self.bounds, n, "right")) - 1
        last = int(np.searchsorted(self.bounds, n * self.den // max(1, self.num), "right")) - 1
        return list(range(own, max(own, last) + 1))

    def chunks(self, band: int) -> tuple[int, int, int]:
        """Number of chunks, how many of the lightest a set leaves out, and how many elements may differ."""
        most = self.starts[band + 1] - 1
        differ = (self.den - self.num) * 2 * most // (self.den + self.num)
        left_out = max(differ // LIGHT_SHARE, int(differ >= LIGHT_FROM))
        return differ + 1 + 2 * left_out, left_out, differ

    def similar(self, common: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return common * self.den >= self.num * (a + b - common)


def chunk_keys(shingles: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of the sketch chunks that a set takes part with."""
    zobrist = mix(mix(shingles, 21) & np.uint64((1 << _BITS) - 1), 22)
    keys = []
    for band in threshold.bands(len(shingles)):
        count, left_out, differ = threshold.chunks(band)
        chunk = (mix(shingles, 31 + band) % np.uint64(count)).astype(np.int64)
        order = np.argsort(chunk)
        weight = np.bincount(chunk, minlength=count)
        sketch, full = np.zeros(count, np.uint64), np.flatnonzero(weight)
        sketch[full] = np.bitwise_xor.reduceat(zobrist[order], np.concatenate([[0], np.cumsum(weight)[full][:-1]]))
        chosen = np.sort(np.argsort(weight, kind="stable")[left_out:]) if left_out else np.arange(count)
        told = chosen[weight[chosen] > 0]
        keys.append(mix(sketch[told] + mix(told.astype(np.uint64), 41), 51 + band))
        if np.count_nonzero(weight == 0) > 2 * left_out:
            ranked = mix(shingles, 42)
            first = np.partition(ranked, differ)[: differ + 1] if differ + 1 < len(ranked) else ranked
            keys.append(mix(first, 151 + band))
    return np.concatenate(keys)


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    total = mix(shingles, 61).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total]), 62).view(np.int64)[0])


def whole_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles by hash position, in 64 * 2**i bits, about one a shingle.

    Positions are hashes modulo a power of two, so halves of a sketch fold by XOR.
    """
    bits = 64 << max(0, (len(shingles) - 1) // 64).bit_length()
    flips = np.bincount((mix(shingles, 71) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool)).tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def profiles(df: DataFrame, k: int, threshold: Threshold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, node, sketch, keys`` for every row.

    An empty set has no node; of equal sets in a slice of rows only the first carries keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for batch in batches:
            for part in slices(batch, 1000):
                sizes, nodes, sketches, keys, seen = [], [], [], [], set()
                for text in text_bytes(part.column(1)):
                    s = shingle_set(text, k)
                    node = fingerprint(s) if len(s) else None
                    fresh = node is not None and node not in seen
                    seen.add(node)
                    sizes.append(len(s))
                    nodes.append(node)
                    sketches.append(whole_sketch(s) if len(s) else None)
                    keys.append(chunk_keys(s, threshold).view(np.int64) if fresh else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), lists], ["doc_id", "n_shingles", "node", "sketch", "keys"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary, keys array<bigint>")


def stars(rows: DataFrame) -> DataFrame:
    """``root, node``: the nodes of each key with the key's least node, that one included."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, head = None, 0  # a key's rows may span batches
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            heads = np.where(start < 0, head, node[start])
            last_key, head = key[-1], heads[-1]
            other = heads != node
            links = np.unique(np.stack([heads[other], node[other]], 1), axis=0)
            roots = np.unique(links[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([links[:, 0], roots])), pa.array(np.concatenate([links[:, 1], roots]))], ["root", "node"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.explode("keys").alias("key"), "node")
    return dealt.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(meet, "root long, node long").distinct()


def in_blocks(members: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """Members (root, node, n_shingles) dealt to tasks: ``task, low, high`` and the block's number.

    Clusters of one block share tasks; in larger ones every pair of blocks is a task.
    """
    total = members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("blocks"))
    tasks = F.lit(max(1, -(-(members.agg(F.sum("n_shingles")).first()[0] or 0) // block)))
    placed = members.join(total, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), tasks)).otherwise(F.xxhash64("root", F.lit(1)))
    return placed.select("root", "node", "n_shingles", "block", task.alias("task"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *columns)


def sketch_partners(pdf: pd.DataFrame, threshold: Threshold) -> pd.DataFrame:
    """Cluster members that the whole sketches leave a possible partner."""
    out = []
    for root, members in pdf.groupby("root", sort=False):
        members = members.drop_duplicates("node")
        if len(members) < 2:
            continue
        members = members.sort_values("n_shingles", kind="stable")
        sizes, nodes, block = members["n_shingles"].to_numpy(), members["node"].to_numpy(), members["block"].to_numpy()
        between = len(set(block)) > 1
        data = members["sketch"].tolist()
        widths = np.array([len(d) // 8 for d in data])
        hit, at = np.zeros(len(sizes), bool), 0
        while at < len(sizes):  # one width at a time; partners are this wide or up to twice
            end = int(np.searchsorted(widths, widths[at], "right"))
            far = int(np.searchsorted(sizes, sizes[end - 1] * threshold.den // threshold.num, "right"))
            mine = np.frombuffer(b"".join(data[at:end]), np.uint64).reshape(end - at, -1)
            rest = [mine]
            for w in np.unique(widths[end:far]).tolist():
                some = [d for d, x in zip(data[end:far], widths[end:far], strict=True) if x == w]
                rest.append(folded(np.frombuffer(b"".join(some), np.uint64).reshape(len(some), -1), mine.shape[1]))
            wide = np.concatenate(rest)
            for i in range(at, end):
                upto = int(np.searchsorted(sizes, sizes[i] * threshold.den // threshold.num, "right"))
                if upto <= i + 1:
                    continue
                differ = np.bitwise_count(wide[i + 1 - at : upto - at] ^ wide[i - at]).sum(1)
                near = differ * (threshold.den + threshold.num) <= (threshold.den - threshold.num) * (sizes[i + 1 : upto] + sizes[i])
                if between:
                    near &= block[i + 1 : upto] != block[i]
                if near.any():
                    hit[i] = True
                    hit[i + 1 : upto] |= near
            at = end
        out.append(pd.DataFrame({"root": root, "node": nodes[hit]}))
    return pd.concat(out).astype("int64") if out else pd.DataFrame({"root": [], "node": []}, dtype="int64")


def spanning_links(sets: list[np.ndarray], names: np.ndarray, block: np.ndarray, threshold: Threshold) -> list[tuple[int, int]]:
    """Spanning links of the similar pairs; of two blocks, only pairs across them are compared."""
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, column = np.repeat(np.arange(len(sets)), sizes)[keep], shared[inverse[keep]]
    starts = np.searchsorted(owner, np.arange(len(sets) + 1))
    root, between, out = np.arange(len(sets)), len(set(block)) > 1, []
    mine = np.zeros(int((counts > 1).sum()) + 1, bool)
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, len(sets))
        possible = (root[others] != root[i]) & (np.minimum(sizes[others], sizes[i]) * threshold.den >= threshold.num * np.maximum(sizes[others], sizes[i]))
        if between:
            possible &= block[others] != block[i]
        others = others[possible]
        if not len(others):
            continue
        own = column[starts[i] : starts[i + 1]]
        mine[own] = True
        for at in range(0, len(others), 512):
            some = others[at : at + 512]
            lengths = starts[some + 1] - starts[some]
            index = np.repeat(starts[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            common = np.bincount(np.repeat(np.arange(len(some)), lengths), weights=mine[column[index]], minlength=len(some)).astype(np.int64)
            for j in some[threshold.similar(common, int(sizes[i]), sizes[some])].tolist():
                if root[j] != root[i]:
                    out.append((int(names[i]), int(names[j])))
                    root[root == root[j]] = root[i]
        mine[own] = False
    return out


def verified_links(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """``a, b``: spanning links of the similar nodes of each cluster.

    ``clusters``: root, node.  ``nodes``: node, doc_id, n_shingles, sketch, with one document for each.
    """
    group = ["task", "low", "high"]
    members = checkpointed(clusters.join(nodes.select("node", "n_shingles"), "node"))
    sketched = in_blocks(members, SKETCH_BLOCK, []).join(nodes.select("node", "sketch"), "node")
    near = sketched.groupBy(*group).applyInPandas(lambda pdf: sketch_partners(pdf, threshold), "root long, node long").distinct()
    left = checkpointed(near.join(nodes.select("node", "n_shingles", "doc_id"), "node"))
    texts = in_blocks(left, SET_BLOCK, ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("words")
        found = []
        for _, rows in pdf.groupby("root", sort=False):
            sets, at = [], []
            for i, (node, text) in enumerate(zip(rows["node"].tolist(), rows["text"].tolist(), strict=True)):
                s = shingle_set(text.encode(), k) if text else ()
                if len(s) and fingerprint(s) == node:
                    sets.append(s)
                    at.append(i)
            rows = rows.iloc[at]
            first = ~rows.duplicated("node").to_numpy()
            if first.sum() > 1:
                found += spanning_links([s for s, f in zip(sets, first, strict=True) if f], rows["node"].to_numpy()[first], rows["block"].to_numpy()[first], threshold)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return texts.select("root", "node", "block", *group, "text").groupBy(*group).applyInPandas(verify, "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; ``num / den`` is the least similarity."""
    docs = id_text(df, id_col, text_col)
    if ids_are_keys(docs):
        return linked(docs, k, num, den)
    # rows are linked by keys of their own, and named by ids afterwards
    keyed = row_keys(docs, "row")
    found = linked(keyed.select(F.col("row").alias("doc_id"), "text"), k, num, den).withColumnRenamed("doc_id", "row")
    named = keyed.select("row", "doc_id").join(found, "row")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def linked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """As ``near_duplicates``, of ``doc_id, text`` whose ids are keys."""
    threshold = Threshold(num, den)
    rows = checkpointed(profiles(docs, k, threshold))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    joined = components(verified_links(stars(rows), nodes, docs, k, threshold))
    named = joined.join(nodes, "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    chosen = nodes.join(joined, "node", "left").join(named, "root", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    # nodes are unique here; the rows of a very frequent set can be split by the join
    return rows.join(chosen, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that come first in their component; texts without words all stay."""
    key = "__jaccard_key"
    docs = row_keys(df, key, id_col, text_col)
    found = linked(id_text(docs, key, text_col), k, num, den)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    return docs.join(first, key, "left_semi").select(*df.columns)
