"""Token counts of whole texts by a longest-match automaton, without pieces.

A word is a run of characters other than ASCII white space.  Its pieces are
greedy: from where the last one ended, the longest entry of the vocabulary.
Entries are byte strings; one that begins a word is marked by a leading space
byte, so " word" is matched against one trie.  Every single byte counts as an
entry, so a word always comes apart.

The trie's nodes carry what happens when no longer entry fits: ``popped``, how
many pieces are complete by then, and ``fail``, the node for the bytes that are
left over.  Reading a word then takes one step a byte plus one for each failure,
and each failure pops a piece at least: linear in the word's length.

A worker counts each distinct word once and remembers the count within a bound.

Defined cases: null, empty and blank texts have no tokens; rows that repeat an
id are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces
from tillroll.llm.memo import Memo


def vocabulary(path: str) -> list[bytes]:
    """The entries of a byte-level vocabulary file as bytes."""
    from tillroll.llm.encoding import _SHOWN

    shown = {c: b for b, c in _SHOWN.items()}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    return [bytes(shown[c] for c in token) for token in model["model"]["vocab"] if token not in special]


class Automaton(Memo):
    """word -> number of pieces."""

    def __init__(self, entries: list[bytes]) -> None:
        super().__init__(self.word)
        # node 0 is the root; step[node] maps a byte to the next node
        self.step: list[dict[int, int]] = [{}]
        ends = [False]
        for entry in (*(bytes([b]) for b in range(256)), *entries):
            node = 0
            for b in entry:
                following = self.step[node].get(b)
                if following is None:
                    following = self.step[node][b] = len(self.step)
                    self.step.append({})
                    ends.append(False)
                node = following
            ends[node] = True
        self.fail = [0] * len(self.step)
        self.popped = [0] * len(self.step)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in self.step[node].items():
                queue.append(child)
                if ends[child]:  # what was read is one piece, nothing is left over
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                # as the parent would fail, then on with this byte
                at, n = self.fail[node], self.popped[node]
                while b not in self.step[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                self.fail[child], self.popped[child] = self.step[at][b], n

    def pieces(self, data: bytes) -> int:
        """Number of greedy pieces of a byte string."""
        step, fail, popped = self.step, self.fail, self.popped
        node = count = 0
        for b in data:
            while b not in step[node]:
                count += popped[node]
                node = fail[node]
            node = step[node][b]
        while node:
            count += popped[node]
            node = fail[node]
        return count

    def word(self, word: str) -> int:
        return self.pieces(b" " + word.encode("utf-8", "surrogatepass"))


_automata: dict[str, Automaton] = {}
_BLANK = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def automaton(path: str) -> Automaton:
    """The worker's automaton for a vocabulary file; kept between tasks."""
    if path not in _automata:
        _automata[path] = Automaton(vocabulary(path))
    return _automata[path]


def words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_BLANK).split(" ") if w]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_tokens``."""

    def count(batches):
        known = automaton(vocabulary_path)
        for batch in pieces(batches, 1):
            listed = [words(t) for t in batch.column(1).to_pylist()]
            sums = [sum(map(known.__getitem__, w)) for w in listed]
            columns = [batch.column(0), pa.array([len(w) for w in listed], pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
