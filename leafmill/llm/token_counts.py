"""Greedy word-piece lengths by a linear longest-match automaton.

A trie of the vocabulary carries, at each node, a failure link and the number of pieces that are popped on the way
over it, both computed once.  A word's number of greedy longest-match pieces is then the sum of the popped counts in
one pass over its characters; no piece is ever built and no character is read twice.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, words_of


class Automaton:
    """``initial`` pieces may open a word, ``following`` pieces may continue one (without their continuation mark)."""

    def __init__(self, initial: Iterable[str], following: Iterable[str]):
        self.goto: list[dict[str, int]] = [{}, {}]
        ends: set[int] = set()
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.goto[node].setdefault(c, len(self.goto))
                    if node == len(self.goto):
                        self.goto.append({})
                if node > 1:
                    ends.add(node)
        self.fail, self.popped = [-1] * len(self.goto), [0] * len(self.goto)
        queue = [0, 1]
        for node in queue:
            for c, child in self.goto[node].items():
                queue.append(child)
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, popped = self.fail[node], self.popped[node]
                while at >= 0 and c not in self.goto[at]:
                    popped, at = popped + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.goto[at][c], popped

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 if greedy matching leaves a rest that no piece covers."""
        goto, fail, popped, node, n = self.goto, self.fail, self.popped, 0, 0
        for c in word:
            while c not in goto[node]:
                n, node = n + popped[node], fail[node]
                if node < 0:
                    return 0
            node = goto[node][c]
        while node != 1:
            n, node = n + popped[node], fail[node]
            if node < 0:
                return 0
        return n


class Counts(dict):
    """Pieces by word (UTF-8), filled on demand; an uncovered word is one unknown piece, held as -1."""

    def __init__(self, automaton: Automaton, mark: str, most: int = 1_000_000):
        super().__init__()
        self.automaton, self.mark, self.most = automaton, mark, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word.decode("utf-8", "replace")) or -1
        if len(word) <= 64:
            self[word] = n
        return n


def spaced_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Word-opening pieces (they begin with the space mark) and the rest of a sentencepiece model's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p for p in ordinary if p[0] == "▁" and "▁" not in p[1:]}, {p for p in ordinary if "▁" not in p}


_COUNTS: dict[str, Counts] = {}


def _counts(path: str) -> Counts:
    if path not in _COUNTS:
        _COUNTS[path] = Counts(Automaton(*spaced_vocabulary(path)), "▁")
    return _COUNTS[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for every row.

    A word that the vocabulary cannot cover counts as one token and one unknown word.  Null and empty texts have no
    words and no tokens; repeated rows and null ids come out as they are; an empty table gives an empty result.
    """

    def run(batches):
        counts = _counts(model)
        for batch in slices(batches, weigh="text"):
            if len(counts) > counts.most:
                counts.clear()
            out = []
            for x in batch.column(1).to_pylist():
                n = np.fromiter(map(counts.__getitem__, w := words_of(x)), dtype=np.int64, count=len(w))
                out.append((len(n), int(np.abs(n).sum()), int((n < 0).sum())))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
