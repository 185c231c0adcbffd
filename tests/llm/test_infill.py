"""Fill-in-the-middle against cuts made with a regular expression."""

import hashlib
import random
import re

import numpy as np
import pytest

from eventfold.llm import infill
from eventfold.llm.wavelet import WaveletMatrix

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_ranks_are_counts():
    symbols = np.random.default_rng(2).integers(0, 8, 1000).astype(np.uint8)
    matrix, at = WaveletMatrix(symbols, 3), np.arange(1001)
    for s in range(8):
        assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]
    assert matrix.rank(1, at, bits=1).tolist() == [0, *np.cumsum(symbols >= 4).tolist()]


def slow(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, middle, tail = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return ("plain", n, None, None, text)
    if h4 % 100 < 80:
        return ("spm", n, len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}")
    return ("psm", n, len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}")


def texts_of(count, seed):
    r = random.Random(seed)
    pieces = ["a", "word", "é", "漢字", "😀x", " ", "\n", "\t ", "\x0b", " ", " ", "\x1c", "<", "<S", "P>", "<P>", "\x00"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(count)]


@pytest.mark.parametrize("matrix_bytes", [1, 300, 1 << 22])
def test_texts_are_cut_as_by_expression(spark, make, monkeypatch, matrix_bytes):
    monkeypatch.setattr(infill, "MATRIX_BYTES", matrix_bytes)
    long = "some words é and more\n" * 20_000
    given = [None, "", " \n", *texts_of(400, 3), (3, "twice"), (3, "twice"), (None, "no id here"), long, (7, " x " + long)]
    rows = infill.transformed(make(*given)).collect()
    want = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(given)]
    key = repr
    got = sorted(((r.doc_id, r.form, r.n, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=key)
    assert got == sorted(((i, *slow(i, t)) for i, t in want), key=key)
    assert {"plain", "spm", "psm"} == {r.form for r in rows}
    for r in rows:
        assert infill.restored(r.output.encode(), r.form).decode() in {t or "" for i, t in want if i == r.doc_id}


def test_texts_come_back_and_hashes_agree(make, empty):
    given = [t for t in texts_of(200, 4)]
    docs = make(*given)
    out = infill.transformed(docs)
    assert {r.doc_id: r.text for r in infill.rebuilt(out).collect()} == dict(enumerate(given))
    outputs = {r.doc_id: r.output for r in out.collect()}
    for r in infill.digests(docs).collect():
        assert r.restored_sha256 == hashlib.sha256(given[r.doc_id].encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(outputs[r.doc_id].encode()).hexdigest()
    assert infill.transformed(empty).count() == 0 and infill.digests(empty).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("id one", "a b c"), ("x", " d ")], "doc_id string, text string")
    assert {r.doc_id: r.n for r in infill.transformed(docs).collect()} == {"id one": 3, "x": 2}
