"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots: word starts and word continuations.
Each node has a failure link, the node reached after the longest match so far is
popped as tokens, and the *number* of tokens that link pops.  Reading a word
costs one step per character plus the failure steps, which pops pay for, and no
piece is ever built.  A word that cannot be covered counts as one unknown token.

Defined results: a null or empty text has no words and no tokens; repeated rows
each give their own row; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import BatchCache, claim, id_text, slices, split_words, text_bytes

CACHE_BYTES = 88 << 20
_START, _CONTINUED, _NONE = 0, 1, -1
#: The mark of a word start in the piece vocabulary.
WORD_START = "▁"


class MatchAutomaton:
    """``starts`` are pieces that begin a word, ``continuations`` those that go on."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.moves: list[dict[str, int]] = [{}, {}]
        final: set[int] = set()
        for root, pieces in ((_START, starts), (_CONTINUED, continuations)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.moves[node].setdefault(c, len(self.moves))
                    if node == len(self.moves):
                        self.moves.append({})
                if piece:
                    final.add(node)
        self.fail, self.popped = [_NONE] * len(self.moves), [0] * len(self.moves)
        waiting = deque([_START, _CONTINUED])
        while waiting:
            node = waiting.popleft()
            for c, child in self.moves[node].items():
                if child in final:
                    self.fail[child], self.popped[child] = _CONTINUED, 1
                else:
                    link, popped = self.fail[node], self.popped[node]
                    while link != _NONE and c not in self.moves[link]:
                        popped += self.popped[link]
                        link = self.fail[link]
                    if link != _NONE:
                        self.fail[child], self.popped[child] = self.moves[link][c], popped
                waiting.append(child)

    def count(self, word: str) -> int:
        """Number of greedy pieces of a non-empty word; 0 where some rest is not covered."""
        moves, fail, popped = self.moves, self.fail, self.popped
        node, total = _START, 0
        for c in word:
            while c not in moves[node]:
                total += popped[node]
                node = fail[node]
                if node == _NONE:
                    return 0
            node = moves[node][c]
        while node != _CONTINUED:
            total += popped[node]
            node = fail[node]
            if node == _NONE:
                return 0
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> MatchAutomaton:
    """From a public piece model: marked pieces start words, unmarked ones continue them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return MatchAutomaton([p[1:] for p in plain if p.startswith(WORD_START)], [p for p in plain if not p.startswith(WORD_START)])


@lru_cache(maxsize=2)
def _memo(path: str) -> BatchCache:
    counter = automaton(path)
    return BatchCache(lambda words: [counter.count(w.decode()) for w in words], CACHE_BYTES)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown``; an unknown word is one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("wordpiece")
        memo = _memo(path)
        for part in (p for batch in batches for p in slices(batch)):
            words_n, tokens_n, unknown_n = [], [], []
            for text in text_bytes(part.column(1)):
                words = split_words(text)
                counts = list(map(memo.get(words).__getitem__, words))
                unknown = counts.count(0)
                words_n.append(len(words))
                tokens_n.append(sum(counts) + unknown)
                unknown_n.append(unknown)
            counted = [pa.array(np.array(x, np.int64)) for x in (words_n, tokens_n, unknown_n)]
            yield pa.RecordBatch.from_arrays([part.column(0), *counted], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
