"""Passages: repeated rows, short pieces, near paragraphs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventfold.llm import passages
from eventfold.session import shared_folder
from tests.llm.test_operators import prose


def found(make, *texts, **kw):
    rows = passages.repeats(make(*texts), **kw).collect()
    return sorted((r.doc_id, r.start, r.end, r.n_words, r.first_doc, r.removed) for r in rows)


@pytest.mark.parametrize("times", [2, 3])
def test_repeated_rows_are_one_document(make, times):
    shared = prose(90, 7)
    one = [(0, shared + "\n" + prose(40, 1)), (1, prose(40, 2) + "\n" + shared)]
    want = found(make, *one)
    assert {r[0] for r in want} == {0, 1}
    assert found(make, *[t for t in one for _ in range(times)]) == want


def test_short_pieces_are_part_of_a_run(make):
    r = random.Random(3)
    verse = "\n".join(prose(r.randint(1, 4), 500 + i) for i in range(30))
    mixed = "\n".join(prose(n, 600 + i) for i, n in enumerate((9, 2, 9, 3, 1, 8)))
    for i, shared in enumerate((verse, mixed)):
        texts = [prose(60, 10 * i) + "\n" + shared + "\n" + prose(50, 10 * i + 1), prose(70, 10 * i + 2) + "\n" + shared]
        want = [(d, t.index(shared), t.index(shared) + len(shared), len(shared.split()), 0, d > 0) for d, t in enumerate(texts)]
        assert found(make, *texts) == want


def test_chance_words_are_no_passage(make):
    lines = ["a b", "c", "d e f", "g h", "i", "j k l m"]
    texts = []
    for i in range(6):
        r = random.Random(i)
        texts.append("\n".join(f"{x} own{i}x{k}" if r.random() < 0.5 else f"{x}\nown{i}y{k} own" for k, x in enumerate(lines * 3)))
    assert found(make, *texts) == []


def edited(text, at):
    words = text.split()
    for i in at:
        words[i] = f"new{i}"
    return " ".join(words)


@pytest.mark.parametrize("leaders", [(), (1, 3)])
def test_classes_of_links_are_those_of_all_near_pairs(make, spark, leaders):
    texts = [edited(prose(100, i % 3), [5 * i % 40 + k for k in (0, 20, 40)][: i % 4]) for i in range(24)]
    chain = prose(60, 9)
    for i in range(8):  # ends of the chain aren't near
        texts.append(chain)
        chain = edited(chain, [6 * i + 3])
    docs = make(*texts)
    rows = passages.paragraphs(docs).withColumnRenamed("doc_id", "home").dropDuplicates(["whole"])
    links = {(r.a, r.b) for r in passages._links(docs, rows, leaders).collect()}
    sets = {}
    for t in texts:
        cuts = passages.Cuts(t.encode())
        sets[int(cuts.whole().view("i8")[0])] = set(cuts.shingle_set(0))
    near = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert {tuple(sorted(x)) for x in links} <= near and near

    def classes(pairs):
        names = {x: x for x in sets}
        for a, b in pairs:
            low = min(names[a], names[b])
            names = {x: low if n in (names[a], names[b]) else n for x, n in names.items()}
        return names

    assert classes(links) == classes(near)


def test_near_paragraphs_are_found_whole(make):
    base = prose(100, 40)
    texts = [base + "\n" + prose(30, 1), prose(30, 2) + "\n" + edited(base, (30, 70))]
    want = [(0, 0, len(base), 100, 0, False), (1, texts[1].index("\n") + 1, len(texts[1]), 100, 0, True)]
    assert found(make, *texts) == want


def test_lines_do_not_meet_in_half_a_key(make, monkeypatch):
    docs = make(*[prose(40, i) for i in range(4)])
    rows = passages.paragraphs(docs).withColumnRenamed("doc_id", "home")
    # Equal upper halves, as millions of keys have them by chance; the lower ones differ.
    keys = F.transform("bands", lambda key: key.bitwiseAND(0x7FFFFFFF) + F.lit(5 << 32))
    asked, sets = [], passages.shingle_sets
    monkeypatch.setattr(passages, "shingle_sets", lambda docs, wanted: asked.append(wanted.count()) or sets(docs, wanted))
    assert passages._links(docs, rows.withColumn("bands", keys), (1, 3)).count() == 0
    assert asked == [0]


def test_what_is_read_does_not_stay(make, spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    shared = prose(60, 5)
    assert passages.repeats(make(shared, shared + "\n" + prose(30, 1), prose(70, 2))).count() == 2
    left = [p for p in set(folder.iterdir()) - before if "bands" in spark.read.parquet(str(p)).columns]
    assert not left


def test_texts_cut_together_are_cut_as_alone(make, monkeypatch):
    r = random.Random(8)
    lines = ["a b", "é à ü " * 9, "", " x ", "one\x0btwo\x1cthree four five six", prose(9, 3), prose(3, 4), prose(70, 5), "a " * 60]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 6))) for _ in range(60)]

    def rows():
        found = passages.pieces_and_paragraphs(make(*texts)).collect()
        return sorted((tuple(x if x is not None else () for x in r) for r in found), key=repr)

    together = rows()
    monkeypatch.setattr(passages._joined, "__defaults__", (1,))
    assert rows() == together and together
