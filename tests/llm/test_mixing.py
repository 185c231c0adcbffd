"""Mixed texts where documents are taken more than twice."""

from eventfold.llm import mixing
from tests.llm.test_operators import prose


def test_mixed_texts_hold_the_words_of_every_pass(make):
    docs = make(*[prose(90, i) for i in range(12)], sources=("a", "b", "c"))
    taken = {r.doc_id: r.taken for r in mixing.taken(*mixing.mix(docs, cap=3)).collect() if r.taken}
    assert max(taken.values()) > 2 * 90
    assert {r.doc_id: len(r.text.split()) for r in mixing.mixed_texts(docs, cap=3).collect()} == taken


def test_equal_rows_have_pieces_of_their_own(make):
    docs = make(*[(7, "one two three four five six seven eight")] * 2, *[(i, prose(40, i)) for i in range(20, 24)])
    size = {7: 8} | {i: 40 for i in range(20, 24)}
    rows = mixing.mixed_texts(docs).collect()
    for r in rows:
        for one in r.text.split("\n"):
            assert len(one.split()) <= size[r.doc_id]
    twins = [r for r in rows if r.doc_id == 7]
    taken = sorted(r.taken for r in mixing.taken(*mixing.mix(docs)).collect() if r.doc_id == 7 and r.taken)
    assert sorted(len(r.text.split()) for r in twins) == taken and len(taken) <= 2
