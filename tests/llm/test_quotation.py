"""Quotation apart from abuse."""

import pytest

from eventfold.llm.toxicity import Matcher, quotations

CASES = [
    ('the "nice" idiot "friend" went', False),
    ("he wrote well but. you idiot", False),
    ("she said that. Later you idiot went", False),
    ("they called him an idiot today", True),
    ('he cried "you total idiot here" loud', True),
    ("« quel idiot », dit-il", True),  # marks may stand apart from the words
    ("«quel idiot», dit-il", True),
    ("er rief „du idiot“ und ging", True),
    ('an "open mark and then you idiot without an end', False),
    ('"' + "word " * 60 + 'idiot" at last', False),
    ("dogs' owners, you idiot", False),
    ("", None),
]


@pytest.mark.parametrize(("text", "quoted"), CASES)
def test_marks_are_paired_and_sentences_end(text, quoted):
    words = [w.encode() for w in text.split()]
    hits = [i for i, w in enumerate(words) if b"idiot" in w]
    got = [Matcher._quoted(words, i, quotations(words)) for i in hits]
    assert got == ([] if quoted is None else [quoted])
