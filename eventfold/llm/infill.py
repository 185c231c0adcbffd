"""Fill-in-the-middle: texts cut into prefix, middle and suffix between tokens.

A token is a word with the white space in front of it, or the white space that ends a text.
Every byte gets a class: does it begin a code point, is it white space, does white space or
the end of the text follow. A wavelet matrix holds the classes of a batch of texts. Tokens
in front of a position are the ranks of two classes put together (a word ends in a lone byte
or in the last byte of a longer code point), and code points are the rank of the highest bit.
Cuts are found for all texts at once by bisection on these ranks.

Whole texts are used. Null texts count as empty; empty ones are ``plain``. A null id hashes
as ``42:``. Rows with equal ids and texts have equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventfold.llm.common import texts
from eventfold.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are cut, and of those that begin with the suffix.
CUT_SHARE, SUFFIX_FIRST = 50, 80
SEED = "42"
#: Bytes of text that share a matrix; a longer text has one of its own.
MATRIX_BYTES = 1 << 22

BEGINS, SPACE, LAST = 4, 2, 1
_CLASS = np.full(256, BEGINS, np.uint8)
_CLASS[0x80:0xC0] = 0  # continues a code point
_CLASS[[0x20, *range(0x09, 0x0E)]] = BEGINS | SPACE


class Boundaries:
    """Token ends and code points of texts that lie one after the other."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """``data``: the bytes of all texts; ``ends``: where each text ends."""
        self.starts, self.ends = np.concatenate([[0], ends[:-1]]), ends
        classes = _CLASS[data]
        last = np.zeros(len(data), bool)
        last[:-1] = classes[1:] & SPACE > 0
        filled = ends > self.starts
        last[ends[filled] - 1] = True
        self.open_end = np.zeros(len(ends), bool)  # ends in white space
        self.open_end[filled] = classes[ends[filled] - 1] & SPACE > 0
        self.matrix = WaveletMatrix(classes | last * np.uint8(LAST), 3)
        self.words = self.words_before(ends) - self.words_before(self.starts)
        self.tokens = self.words + self.open_end

    def words_before(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(BEGINS | LAST, at) + self.matrix.rank(LAST, at)

    def chars_before(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(1, at, bits=1)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The position behind the first ``k`` tokens of each text."""
        low, high = self.starts.copy(), self.ends.copy()
        wanted = self.words_before(self.starts) + k
        while (low < high).any():  # least position with that many words in front
            middle = (low + high) >> 1
            enough = self.words_before(middle) >= wanted
            high, low = np.where(enough, middle, high), np.where(enough | (low >= high), low, middle + 1)
        return np.where(k > self.words, self.ends, low)


def draws(doc_id) -> list[int]:
    """Four numbers that hang on the id alone."""
    hashed = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hashed[i : i + 8], 16) for i in (0, 8, 16, 24)]


def restored(output: bytes, form: str) -> bytes:
    """The text behind an output, from the output and its form alone."""
    if form == "plain":
        return output
    if form == "psm":
        head, _, rest = output[len(PREFIX) :].partition(SUFFIX)
        tail, _, middle = rest.partition(MIDDLE)
    else:
        tail, _, rest = output[len(SUFFIX) :].partition(PREFIX)
        head, _, middle = rest.partition(MIDDLE)
    return head + middle + tail


def _transformed(ids: list, data: bytes, ends: np.ndarray) -> list[tuple]:
    found = Boundaries(np.frombuffer(data, np.uint8), ends)
    drawn = np.array([draws(i) for i in ids], np.int64).reshape(-1, 4)
    first, second = drawn[:, 0] % (found.tokens + 1), drawn[:, 1] % (found.tokens + 1)
    cuts = [found.cut(np.minimum(first, second)), found.cut(np.maximum(first, second))]
    chars = [found.chars_before(x) for x in (found.starts, *cuts)]
    rows = []
    for i in range(len(ids)):
        start, one, two, end = int(found.starts[i]), int(cuts[0][i]), int(cuts[1][i]), int(ends[i])
        text = data[start:end]
        if not text or drawn[i, 2] % 100 >= CUT_SHARE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            form, output, lengths = "plain", text, (None, None)
        else:
            head, middle, tail = data[start:one], data[one:two], data[two:end]
            if drawn[i, 3] % 100 < SUFFIX_FIRST:
                form, output = "spm", SUFFIX + tail + PREFIX + head + MIDDLE + middle
            else:
                form, output = "psm", PREFIX + head + SUFFIX + tail + MIDDLE + middle
            lengths = int(chars[1][i] - chars[0][i]), int(chars[2][i] - chars[1][i])
        rows.append((form, int(found.tokens[i]), *lengths, output))
    return rows


def _batches(docs: DataFrame, schema: str, column) -> DataFrame:
    """Applies ``column(rows) -> arrays`` to the texts; results stand beside the ids."""

    def run(batches):
        for b in batches:
            ids, whole = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(whole):
                to, held = at, 0
                while to < len(whole) and (to == at or held + len(whole[to]) <= MATRIX_BYTES):
                    held += len(whole[to])
                    to += 1
                ends = np.cumsum([len(t) for t in whole[at:to]])
                rows = _transformed(ids[at:to], b"".join(whole[at:to]), ends)
                arrays = column(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *arrays.values()], ["doc_id", *arrays])
                at = to

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def _lengths(rows: list[tuple]) -> dict:
    forms, *numbers = zip(*[r[:4] for r in rows], strict=True)
    return {"form": pa.array(forms, pa.string())} | {
        name: pa.array(values, pa.int64()) for name, values in zip(("n", "prefix_chars", "middle_chars"), numbers, strict=True)
    }


def transformed(docs: DataFrame) -> DataFrame:
    """``(doc_id, form, n, prefix_chars, middle_chars, output)`` for each row.

    ``n`` counts the tokens; the lengths are in code points and null where ``form`` is plain.
    """
    return _batches(
        docs,
        "form string, n long, prefix_chars long, middle_chars long, output string",
        lambda rows: _lengths(rows) | {"output": pa.array([r[4].decode() for r in rows], pa.string())},
    )


def digests(docs: DataFrame) -> DataFrame:
    """As ``transformed``, with hashes of the output and of the text rebuilt from it."""

    def hashed(values):
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    return _batches(
        docs,
        "form string, n long, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
        lambda rows: _lengths(rows)
        | {"output_sha256": hashed(r[4] for r in rows), "restored_sha256": hashed(restored(r[4], r[0]) for r in rows)},
    )


def rebuilt(outputs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, form, output)``: the way back."""

    def run(batches):
        for b in batches:
            pairs = zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True)
            made = [restored(o, f).decode() for o, f in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    rows = outputs.select("doc_id", "form", "output")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
