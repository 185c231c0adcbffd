"""The source audit against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from eventfold.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, kept = defaultdict(Counter), defaultdict(Counter), {}
    for text, lang, source in rows:
        words = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        counts[lang, None].update(words)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = sorted({r[2] for r in rows if r[1] == lang})

        def shares(group):
            total = sum(counts[group][t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[group][t] + 1) // (total + len(kept)) for t in kept}

        q = shares((lang, None))
        p = {s: shares((lang, s)) for s in sources}
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            term = [
                (-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]
            ]
            for part, found in (("pair", pair), ("term", sorted(term)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(sorted(found), 1)]
    return sorted(out)


def made(spark, rows):
    schema = "text string, lang string, source string, digest int, n string, docs int, term string"
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], schema).repartition(3)


def audited(spark, rows, **given):
    return sorted(tuple(r) for r in divergence.audit(made(spark, rows), **given).collect())


def texts_of(n, seed):
    r = random.Random(seed)
    words = ["the", "The", "ÉTÉ", "été", "naïve", "a1b", "x-y", "漢字", "don't", " ", "\x00z", *(f"w{chr(97 + i)}" for i in range(20))]
    return [" ".join(r.choice(words[: r.randint(2, len(words))]) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("held", [1, 300_000])
def test_all_sums_agree(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    r = random.Random(1)
    texts = texts_of(120, 2)
    rows = [(t, r.choice(["en", "en", "de", ""]), r.choice("abcdé")) for t in texts]
    rows += [(texts[0], "en", s) for s in "aaaaaaaabbcz"]  # copies within and across sources
    rows += [(None, "en", "a"), ("only nulls", None, None), ("", "fr", "a"), ("", "fr", "b"), ("x", None, "b")]
    rows += [("long " * 30_000, "en", "long")]
    assert audited(spark, rows) == slow(rows)


def test_ranks_end_and_ties_go_by_bytes(spark):
    rows = [(f"{a} {b}", "en", s) for a, b, s in [("é", "z", "a"), ("z", "é", "a"), ("a", "Z É", "a"), ("a b", "a", "b"), ("q q", "a é z", "c")]]
    assert audited(spark, rows, top_terms=1) == slow(rows, 1)


def test_no_rows_and_no_terms(spark):
    assert audited(spark, []) == []
    rows = [("1 2 3", "en", "a"), ("", "en", "b"), ("once", "en", "c")]
    assert audited(spark, rows) == slow(rows) and len(slow(rows)) == 6


def test_identical_texts_are_one_row(spark):
    rows = [("same text", "en", s) for s in "aab"] + [("same text", "de", "a"), ("other", "en", "a")]
    found = divergence.distinct_texts(made(spark, rows)).collect()
    held = {(r.lang, r.text): {s.source: s.copies for s in r.sources} for r in found}
    assert held == {("en", "same text"): {"a": 2, "b": 1}, ("de", "same text"): {"a": 1}, ("en", "other"): {"a": 1}}


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**12, 3 * 10**13), (0, 7), (6, 7), (89_999_999_999_999, 90_000_000_000_000)], "c long, t long")
    for r in df.select("c", "t", divergence.share("c", "t").alias("p")).collect():
        assert r.p == 1 + 1_000_000_000 * (r.c + 1) // r.t
