"""Near copies at a likeness of 0.8 against brute force."""

import random

import pytest

import corpus_pipeline
from eventfold.llm import alike
from tests.llm.test_operators import ODD, prose


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return 10 * len(a & b) >= 8 * len(a | b)


def edited(text, times, seed):
    r, words = random.Random(seed), text.split()
    for i in range(times):
        words[r.randrange(len(words))] = f"new{seed}x{i}"
    return " ".join(words)


def classes(n, pairs):
    names = list(range(n))
    for a, b in pairs:
        names = [min(names[a], names[b]) if x in (names[a], names[b]) else x for x in names]
    return names


@pytest.mark.parametrize("leaders", [(), alike.LEADERS])
def test_one_of_each_class_stays(make, spark, leaders):
    texts = [edited(prose(200, i % 4), i % 7, i) for i in range(40)]
    chain = prose(120, 30)
    for i in range(12):  # each is near the one before, the last not near the first
        texts.append(chain)
        chain = edited(chain, 1, 100 + i)
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if near(texts[a], texts[b])]
    want = sorted(set(classes(len(texts), pairs)))
    got = sorted(r.doc_id for r in alike.keep_one(make(*texts), leaders).collect())
    assert got == want and len(got) < len(texts)


def test_stage_drops_near_copies(make, spark, empty):
    base = prose(300, 3)
    docs = make(*ODD, base, edited(base, 4, 1), prose(300, 4))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "6", "7", "9", "None"]
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


@pytest.mark.parametrize("longs", [1, 4, 16])
def test_bits_that_differ_are_shingles_that_differ(longs):
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = (set(r.integers(0, 2**64, r.integers(1, 300), dtype=np.uint64).tolist()) for _ in range(2))
        b |= set(list(a)[: len(a) * 9 // 10])
        both = [np.array(sorted(v), np.uint64) for v in (a, b)]
        of = np.repeat([0, 1], [len(a), len(b)])
        x, y = alike.bit_maps(np.concatenate(both), of, 2, longs).view(np.uint64)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)


def test_texts_that_share_a_passage_stay(make):
    """They meet in many bands without being alike."""
    shared = prose(60, 5)
    texts = [shared + " " + prose(90, 1000 + i) for i in range(60)]
    kept = alike.keep_one(make(*texts, texts[0] + " more"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_stage_drops_what_simhash_links(make, spark):
    # One shingle makes up most of both texts: one fingerprint, though few five-word shingles are common.
    docs = make("x " * 30, "x " * 30 + "one two three four five six", prose(300, 5))
    assert sorted(r.doc_id for r in alike.keep_one(docs).collect()) == [0, 1, 2]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and kept.columns == docs.columns
