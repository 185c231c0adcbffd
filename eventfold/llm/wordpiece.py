"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Every node has a failure link and the number of pieces that are
popped on the way along it, worked out once for the vocabulary: a node that is a piece pops
itself and falls back to the root, any other node pops what its parent pops and falls back
along its parent's links until the letter fits. A word is then read once, letter by letter,
adding popped counts; no piece is built.

Words are read as bytes with a leading space, as vocabularies of byte-level pieces write
the beginning of a word, so a piece at the start and one inside a word are kept apart.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from eventfold.llm.common import WordCache, texts

_automata: dict[str, WordCache] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return letters


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces as bytes from a ``tokenizers`` file; special tokens are left out."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = {t["content"] for t in found.get("added_tokens", [])}
    return [bytes(letters[c] for c in piece) for piece in found["model"]["vocab"] if piece not in special]


class LongestMatch:
    """The trie with failure links and popped counts of a vocabulary of byte strings."""

    def __init__(self, pieces: list[bytes]):
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        ends, nodes, order = set(), 1, []
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.edges:
                    self.edges[key] = nodes
                    order.append(key)
                    nodes += 1
                node = self.edges[key]
            ends.add(node)
        self.fail, self.pops, depth = [-1] * nodes, [0] * nodes, [0] * nodes
        for key in order:  # a parent comes before its children
            depth[self.edges[key]] = depth[key >> 8] + 1
        for key in sorted(order, key=lambda k: depth[k >> 8]):
            node, parent, byte = self.edges[key], key >> 8, key & 255
            if node in ends:
                self.fail[node], self.pops[node] = 0, 1
                continue
            back, popped = self.fail[parent], self.pops[parent]
            while back >= 0 and back << 8 | byte not in self.edges:
                back, popped = self.fail[back], popped + self.pops[back]
            if back >= 0:
                self.fail[node], self.pops[node] = self.edges[back << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; 1, the unknown piece, if none covers the word."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (following := edges.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
            node = following
        while node:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total


def counter(path: str) -> WordCache:
    if path not in _automata:
        automaton = LongestMatch(read_vocabulary(path))
        _automata[path] = WordCache(lambda word: automaton.count(b" " + word))
    return _automata[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` for each row.

    Null and empty texts have none of either; repeated rows have equal counts; other
    columns are ignored. ``path`` is a vocabulary file that every executor can open.
    """
    path = path or default_path()

    def run(batches):
        pieces = counter(path)
        for b in batches:
            words = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            tokens = [sum([pieces[w] for w in text]) for text in words]
            columns = [pa.array(list(map(len, words)), pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_tokens"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
