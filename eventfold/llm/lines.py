"""Line-first cleaning: rules judge lines, documents fall when they lose too much.

Every line with a word is judged by three rules. *Punctuation*: no word ends a sentence,
or three in ten words end in exclamation or other symbols. *Navigation*: separators that
stand alone, at least two and one for five words. *Boilerplate*: a short line with a stock
phrase. Lines that fail are removed, and a document that loses more than a given share of
its word characters is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import texts

# Fixed marks and phrases of the rules.
ENDINGS = (".", "?", "!", "…", ".\"", "?\"", "!\"", ".”", "?”", "!”", ".»", "?»", "!»", ".)", "?)", "!)")
SYMBOLS = ("!", "#", "*", "$", "%", "&")
SEPARATORS = ("|", ">", "<", "»", "«", "›", "•", "·", "/", "::")
PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript",
    "lorem ipsum", "click here", "sign up", "subscribe", "powered by", "copyright", "licensed under",
    "skip to content", "read more",
)
PHRASE_WORDS = 25
MAX_LOST = 0.3
MIN_WORDS, MAX_REPEATED = 20, 0.3

_END = tuple(e.encode() for e in ENDINGS)
_SYM = tuple(s.encode() for s in SYMBOLS)
_SEP = frozenset(s.encode() for s in SEPARATORS)
_PHRASES = tuple(p.encode() for p in PHRASES)
_SPACE = b" \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars"]


def line_rule(line: bytes, words: list[bytes]) -> str | None:
    """The rule that the line fails, if any."""
    n = len(words)
    separators = sum(w in _SEP for w in words)
    if separators >= 2 and 5 * separators >= n:
        return "navigation"
    if n <= PHRASE_WORDS:
        low = line.lower()
        if any(p in low for p in _PHRASES):
            return "boilerplate"
    if 10 * sum(w.endswith(_SYM) for w in words) >= 3 * n or not any(w.endswith(_END) for w in words):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in windows found twice or more in the text, the first included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    width = 1
    while width < window:  # numbers of runs twice as long
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        width *= 2
    again = (counts[ids] > 1).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[window:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _chars(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


def measure(text: bytes) -> list[int]:
    """The ``COUNTS`` of one text."""
    words = text.split()
    n_symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    word_chars = _chars(text.translate(None, _SPACE))
    seen: set[bytes] = set()
    again = lost = lines = 0
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split(b"\n"):
        in_line = line.split()
        if not in_line:
            continue
        lines += 1
        if line in seen:
            again += 1
        seen.add(line)
        rule = line_rule(line, in_line)
        if rule:
            failed[rule] += 1
            lost += _chars(b"".join(in_line))
    return [len(words), word_chars, n_symbols, again, repeated_words(words), lines, *failed.values(), lost]


def judged(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``(doc_id, <COUNTS>, base_failed, kept)`` for each row.

    Null and empty texts have no words and fail; repeated rows have equal results; other
    columns are ignored.
    """

    def run(batches):
        for b in batches:
            counts = [measure(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *COUNTS])

    rows = texts(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    # Ratios are compared as whole numbers, so nothing hangs on rounding.
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * round(100 * MAX_REPEATED)
    )
    kept = F.col("lost_chars") * 100 <= F.col("word_chars") * round(100 * max_lost)
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & kept)


def cleaned(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``(doc_id, text)`` of kept rows without the lines that failed; line ends as they were."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                m = dict(zip(COUNTS, measure(t), strict=True))
                low = m["n_words"] < MIN_WORDS or m["n_repeat_words"] * 100 > m["n_words"] * round(100 * MAX_REPEATED)
                if low or m["lost_chars"] * 100 > m["word_chars"] * round(100 * max_lost):
                    continue
                lines = [x for x in t.split(b"\n") if not x.split() or not line_rule(x, x.split())]
                ids.append(i)
                out.append(b"\n".join(lines).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int32())), pa.array(out, pa.string())], ["doc_id", "text"]
            )

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
