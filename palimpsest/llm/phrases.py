"""Phrase collocations from vertical positional inverted lists.

Documents are read in slices of one language each.  A slice numbers its word places, with
a gap between pieces of text, and keeps for every word the ascending list of its places.
Frequent phrases of k words are lengthened level by level: their lists are merge-joined,
all at once, with the postings of the word k places further on, where the phrase of the
last k words is frequent too; the places at which both are found are the longer phrase's
list, and its length is the exact frequency in the slice.  Slices tell hashes of candidates
and list lengths, packed in a row for each part of the hashes: three bytes and one, about, a
candidate.  Lengths are summed over all slices by hash, and a slice gets back a mark for each
of its candidates: those whose hash reaches the threshold go on.  A hash never has less than
a phrase it stands for, so no frequent phrase is lost; the few rare ones that share a hash
with others are taken out by exact sums of the lengths of spelled phrases, which only those
that go on have, in a row for each part too.  Lists themselves stay in their slice's row, and rows in their bucket: those
that go on are made a second time, so that candidates' lists are never written down, and marks
are brought to the rows, so that no list is shuffled.

A candidate's score is that of its weakest cut, from exact frequencies in integers of 38
digits.  A phrase that lies inside a longer candidate of the same frequency is dropped; as
frequencies never rise with length, looking one word further on either side is enough.

Defined results: a null text is empty and counts nothing; a null language is ``und``;
occurrences overlap and repeat, within a piece only; rows that repeat, null ids included,
are texts of their own; a text of any length is read whole (one longer than a slice makes
a slice of its own); ties of cuts go to the shorter first part, ties of rank to the
greater frequency, then to the phrase by bytes; other columns, whatever their names, are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import removed, slices, stored, stored_in_buckets, text_bytes

#: Word places of a slice, about, and parts into which a language's ranking is dealt first.
SLICE_PLACES, RANK_PARTS = 1_000_000, 128
#: Word places of the whole table to a part of the hashes, and different hashes in a part (three bytes).
PART_PLACES, PART_KEYS = 4_000_000, 1 << 24
#: Fixed values of the contract: what ends a piece; space and tab part words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TO_MARK = bytes(ord(".") if c in PIECE_ENDS else c for c in range(256))
_STATE = "slice long, lang string, places long, phrases array<string>, n array<int>, lists binary, words array<string>, word_n array<int>, word_lists binary"


def split_pieces(text: bytes) -> list[bytes]:
    """Words in order, A-Z lower-cased, with a full stop where a piece ends.

    Splitting at white space is splitting at space and tab here: the rest ends pieces.
    """
    return text.lower().translate(_TO_MARK).replace(b".", b" . ").split()


class Words(dict):
    """Numbers for words as they come; a piece's end is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def packed(places: np.ndarray) -> bytes:
    """Places as differences of one to five bytes; a list's first is told from the one before, so it may go back."""
    step = np.diff(places, prepend=0)
    value = ((step << 1) ^ (step >> 63)).astype(np.uint64)
    size = 1 + sum((value >> np.uint64(7 * b) > 0).astype(np.int64) for b in range(1, 5))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for b in range(5):
        has = size > b
        out[start[has] + b] = (value[has] >> np.uint64(7 * b)).astype(np.uint8) & 127 | (size[has] > b + 1).astype(np.uint8) << 7
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8)
    if not len(part):
        return np.empty(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(part < 128)[:-1] + 1])
    at = np.arange(len(part)) - np.repeat(start, np.diff(start, append=len(part)))
    value = np.add.reduceat((part & 127).astype(np.int64) << (7 * at), start)
    return np.cumsum((value >> 1) ^ -(value & 1))


def by_list(number: np.ndarray, place: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, each ascending as ``place`` is, and their lengths."""
    return place[np.argsort(number, kind="stable")], np.bincount(number, minlength=count)


def _row(slice_id: int, lang: str, places: int, phrases: pa.Array, n: np.ndarray, lists: np.ndarray, words: pa.Array, word_n: np.ndarray, word_lists: np.ndarray) -> pa.RecordBatch:
    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    arrays = [pa.array([slice_id], pa.int64()), pa.array([lang]), pa.array([places], pa.int64()), one(phrases), one(pa.array(n, pa.int32())), pa.array([packed(lists)]), one(words), one(pa.array(word_n, pa.int32())), pa.array([packed(word_lists)])]
    return pa.RecordBatch.from_arrays(arrays, ["slice", "lang", "places", "phrases", "n", "lists", "words", "word_n", "word_lists"])


_NONE = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)


def word_postings(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Every slice's words with their lists; ``places`` is the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        texts: dict[str, list[np.ndarray]] = {}
        numbers: dict[str, Words] = {}
        held: Counter[str] = Counter()

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang in langs:
                number = np.concatenate(texts.pop(lang))
                place = np.flatnonzero(number)
                lists, n = by_list(number[place] - 1, place, len(numbers[lang]) - 1)
                words = pa.array(list(numbers.pop(lang))[1:], pa.binary()).cast(pa.string())
                yield _row((task << 32) + made, lang, len(place), words, n, lists, *_NONE)
                made += 1
                del held[lang]

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                    found = split_pieces(text) if text else []
                    if not found:
                        continue
                    known = numbers.setdefault(lang, Words())
                    found.append(b".")  # texts do not meet
                    texts.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    held[lang] += len(found)
                    if held[lang] >= SLICE_PLACES:
                        yield from flush([lang])
                    elif held.total() >= 4 * SLICE_PLACES:
                        yield from flush(list(held))
        yield from flush(list(held))

    chosen = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, _STATE)


def chosen_lists(n: np.ndarray, lists: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the kept lists, in ascending order: place, and the list's number among those kept."""
    number = np.full(len(n), -1, np.int64)
    number[kept] = np.arange(len(kept))
    owner = np.repeat(number, n)
    place, owner = lists[owner >= 0], owner[owner >= 0]
    order = np.argsort(place, kind="stable")
    return place[order], owner[order]


def merged(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ascending ``left`` meets the ascending ``right``: a mark and an index."""
    at = np.minimum(np.searchsorted(right, left), max(0, len(right) - 1))
    return (right[at] == left if len(right) else np.zeros(len(left), bool)), at


def cut(data: np.ndarray, count: np.ndarray) -> pa.Array:
    """The rows of ``data`` as binary values, each of as many rows as ``count`` says."""
    ends = np.concatenate([[0], np.cumsum(count)]) * data[:1].nbytes if len(data) else np.zeros(len(count) + 1)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash of two."""
    h = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.view(np.uint64)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Slice:
    """A slice's row: its frequent phrases of k words, and the postings of the words that may follow them."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.id, self.lang, self.places = (batch.column(c)[row].as_py() for c in (0, 1, 2))
        self.phrases, n, self.words, word_n, phrase_hash, word_hash = (batch.column(c)[row].values for c in (3, 4, 6, 7, 9, 10))
        lists, word_lists = (unpacked(batch.column(c)[row].as_py()) for c in (5, 8))
        self.n, self.lists = n.to_numpy(), lists
        self.word_n, self.word_lists = word_n.to_numpy(), word_lists
        self.phrase_hash, self.word_hash = phrase_hash.to_numpy(), word_hash.to_numpy()

    def only(self, kept: np.ndarray) -> pa.RecordBatch:
        """The row with the kept lists alone."""
        number = np.full(len(self.n), False)
        number[kept] = True
        return _row(self.id, self.lang, self.places, self.phrases.take(pa.array(np.flatnonzero(number))), self.n[number], self.lists[np.repeat(number, self.n)], *_NONE)

    def candidates(self, k: int) -> None:
        """The lists of k + 1 words, in a fixed order, from the merge of lists with adjacent words' postings."""
        place, phrase = chosen_lists(self.n, self.lists, np.arange(len(self.n)))
        self.word_place, self.word = place, phrase
        if k == 1:
            self.words, self.word_hash = self.phrases, self.phrase_hash
        else:
            self.word_place, self.word = chosen_lists(self.word_n, self.word_lists, np.arange(len(self.word_n)))
        follows, at = merged(place + k, self.word_place)
        frequent, _ = merged(place + 1, place)  # the phrase of the last k words
        follows &= frequent
        width = max(1, len(self.words))
        pairs, number = np.unique(phrase[follows] * np.int64(width) + self.word[at[follows]], return_inverse=True)
        self.first, self.last = np.divmod(pairs, width)
        self.lists, self.n = by_list(number, place[follows], len(pairs))

    def dealt(self, k: int, parts: int, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The candidates of k words by part of their hashes, those hashes in that order, and how many a part has."""
        if k == 1:
            h = mixed(self.phrase_hash, self.phrase_hash)
        else:
            self.candidates(k - 1)
            h = mixed(self.phrase_hash[self.first], self.word_hash[self.last])
        rest, key = np.divmod(h, np.uint64(keys))
        part = (rest % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, key[order].astype(np.uint32), np.bincount(part, minlength=parts)

    def longer(self, k: int, kept: np.ndarray, last: bool) -> pa.RecordBatch:
        """The row for k + 1 words: the kept candidates, and the words that may follow them; after the ``last`` nothing is merged."""
        number = np.full(len(self.n), False)
        number[kept] = True
        phrases = pc.binary_join_element_wise(self.phrases.take(pa.array(self.first[kept])), self.words.take(pa.array(self.last[kept])), " ")
        if last:
            return _row(self.id, self.lang, self.places, phrases, self.n[kept], np.empty(0, np.int64), *_NONE)
        lists = self.lists[np.repeat(number, self.n)]
        useful, _ = merged(self.word_place, np.unique(lists + k + 1))
        used, renamed = np.unique(self.word[useful], return_inverse=True)
        word_lists, word_n = by_list(renamed, self.word_place[useful], len(used))
        return _row(self.id, self.lang, self.places, phrases, self.n[kept], lists, self.words.take(pa.array(used)), word_n, word_lists)


def _hashed(state: DataFrame) -> DataFrame:
    return state.withColumns({f"{c}_hash": F.transform(c, lambda x: F.xxhash64(x)) for c in ("phrases", "words")})


def hashed_counts(state: DataFrame, k: int, parts: int, least: int) -> DataFrame:
    """``slice, lang, part, keys, n``: hashes and list lengths (``least`` at most) of a slice's candidates of k words."""
    wide = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Slice(batch, row)
                order, key, count = own.dealt(k, parts, PART_KEYS)
                some = np.flatnonzero(count)
                key = key.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                arrays = [pa.repeat(pa.scalar(own.id, pa.int64()), len(some)), pa.repeat(pa.scalar(own.lang), len(some)), pa.array(some.astype(np.int32)), cut(key, count[some]), cut(np.minimum(own.n[order], least).astype(wide), count[some])]
                yield pa.RecordBatch.from_arrays(arrays, ["slice", "lang", "part", "keys", "n"])

    return _hashed(state).mapInArrow(run, "slice long, lang string, part int, keys binary, n binary")


def marked(counts: DataFrame, least: int) -> DataFrame:
    """``slice, part, marks``: a byte for each candidate, 1 where all with its hash come to ``least``; a part without any is left out."""
    wide = np.min_scalar_type(least)

    def run(rows: pa.Table) -> pa.Table:
        n = np.frombuffer(b"".join(rows["n"].to_pylist()), wide)
        data = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint8).reshape(-1, 3)
        key = np.zeros((len(data), 4), np.uint8)
        key[:, :3] = data
        key = key.view("<u4").ravel()
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
        enough = np.add.reduceat(n[order], np.flatnonzero(new), dtype=np.int64) >= least
        marks = np.empty(len(key), np.uint8)
        marks[order] = enough[np.cumsum(new) - 1]
        count = pc.binary_length(rows["keys"]).to_numpy() // 3
        some = pa.array(np.logical_or.reduceat(marks, np.cumsum(count) - count))
        return pa.table({"slice": rows["slice"], "part": rows["part"], "marks": cut(marks, count)}).filter(some)

    return counts.groupBy("lang", "part").applyInArrow(run, "slice long, part int, marks binary")


def going_on(state: DataFrame, marks: DataFrame, k: int, parts: int, last: bool = False) -> DataFrame:
    """A slice's row for k words from the one for k - 1 and its candidates' marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, told = Slice(batch, row), batch.column(11)[row].values
                order, _, count = own.dealt(k, parts, PART_KEYS)
                start, good = np.cumsum(count) - count, np.full(len(order), False)
                for part, mark in zip(told.field(0).to_pylist(), told.field(1).to_pylist(), strict=True):
                    good[start[part] : start[part] + count[part]] = np.frombuffer(mark, bool)
                kept = np.sort(order[good])
                yield own.only(kept) if k == 1 else own.longer(k - 1, kept, last)

    own = marks.groupBy("slice").agg(F.collect_list(F.struct("part", "marks")).alias("marks"))  # a row a part of one slice's hashes
    joined = _hashed(state.join(own, "slice"))
    return joined.select(*state.columns, "phrases_hash", "words_hash", "marks").mapInArrow(run, _STATE)


def spelled_counts(state: DataFrame, parts: int) -> DataFrame:
    """``lang, part, phrases, n``: a slice's phrases by part of their hashes, with their list lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                phrases, n, h = (batch.column(c)[row].values for c in (1, 2, 3))
                part = (h.to_numpy().view(np.uint64) % np.uint64(parts)).astype(np.int64)
                order, count = pa.array(np.argsort(part, kind="stable")), np.bincount(part, minlength=parts)
                some = np.flatnonzero(count)
                ends = pa.array(np.concatenate([[0], np.cumsum(count[some])]), pa.int32())
                arrays = [pa.repeat(batch.column(0)[row], len(some)), pa.array(some.astype(np.int32)), *(pa.ListArray.from_arrays(ends, x.take(order)) for x in (phrases, n))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "part", "phrases", "n"])

    return _hashed(state).select("lang", "phrases", "n", "phrases_hash").mapInArrow(run, "lang string, part int, phrases array<string>, n array<int>")


def summed(spelled: DataFrame, k: int, least: int) -> DataFrame:
    """``lang, k, phrase, f``: phrases found ``least`` times over all slices."""

    def run(rows: pa.Table) -> pa.Table:
        told = pa.table({"phrase": pc.list_flatten(rows["phrases"]), "n": pc.list_flatten(rows["n"]).cast(pa.int64())})
        f = told.group_by("phrase", use_threads=False).aggregate([("n", "sum")]).filter(pc.field("n_sum") >= least)
        return pa.table({"lang": pa.repeat(rows["lang"][0], len(f)), "k": pa.repeat(pa.scalar(k, pa.int32()), len(f)), "phrase": f["phrase"], "f": f["n_sum"]})

    return spelled.groupBy("lang", "part").applyInArrow(run, "lang string, k int, phrase string, f long")


def frequent_phrases(df: DataFrame, longest: int, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, f`` of all phrases of up to ``longest`` words found ``least`` times, and ``lang, n``."""
    (name, state), levels = stored_in_buckets(word_postings(df, lang_col, text_col), "slice"), []
    totals = stored(state.groupBy("lang").agg(F.sum("places").alias("n")))
    parts = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // PART_PLACES
    for k in range(1, longest + 1):
        marks, before = marked(hashed_counts(state, k, parts, least), least), name
        name, state = stored_in_buckets(going_on(state, marks, k, parts, k == longest), "slice")
        removed(df.sparkSession, before)
        found = stored(summed(spelled_counts(state, parts), k, least))
        levels.append(found)
        if found.isEmpty():
            break
    removed(df.sparkSession, name)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, totals


def _part(start: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, count), " ")


def collocations(df: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases by score."""
    every, totals = frequent_phrases(df, longest, least, lang_col, text_col)
    candidates = every.filter("k >= 2")
    # one word less on either side: what is no rarer inside a longer candidate goes
    longer = candidates.filter("k > 2").select("lang", "f", F.explode(F.array(_part(1, F.col("k") - 1), _part(2, F.col("k") - 1))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    maximal = candidates.join(inside, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * f").select("lang", "k", "phrase", F.col("f").alias("a"))
    cuts = maximal.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select("*", _part(1, F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = every.select("lang", "phrase", "f")
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"]).join(totals, "lang")
    # below 2**63 singly; products in 38 digits, and the floored quotient is at most 10 n
    big = "cast({} as decimal(19, 0))"
    score = F.expr(f"({big.format('1000 * a')} * {big.format('n')}) div ({big.format('l')} * {big.format('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))], ["lang"]):  # each part's first, then the first of those
        scored = scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
