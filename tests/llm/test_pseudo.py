"""Scores against a plain computation from the corpus's counts and the fitted weights."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from motionspark.llm import pseudo
from motionspark.llm.words import hash_word

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "ru", "so") for b in ("ba", "den", "fi", "gor", "hul", "jas")]


def corpus() -> list[tuple[int, str]]:
    rng = random.Random(5)
    return [(i, " ".join(rng.choice(WORDS[: rng.randrange(2, 36)]) + rng.choice(["", "", rng.choice(WORDS)]) for _ in range(rng.randrange(80)))) for i in range(60)]


@pytest.mark.parametrize("listed", [0, 20, 1 << 16])
def test_scores_against_plain_counts(spark, monkeypatch, listed):
    monkeypatch.setattr(pseudo, "LISTED", listed)
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    counts = Counter(w for _, t in docs for w in re.findall(r"\w+", t.lower()))
    hashes = {w: hash_word(w) for w in counts}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ranked = sorted(counts, key=lambda w: (-counts[w], signed(hashes[w])))[:listed]
    of = {w: pseudo.OWN + (h >> 40) % (pseudo.CLASSES - pseudo.OWN) for w, h in hashes.items()}
    of |= {w: i for i, w in enumerate(ranked[: pseudo.OWN])}
    total = Counter()
    for w, n in counts.items():
        total[of[w]] += n
    assert math.isclose(sum(counts[w] / total[of[w]] for w in counts), len(total))  # shares of a class add up to one
    known = spark.sparkContext.broadcast(pseudo.vocabulary(pseudo.word_counts(table)))
    net = pseudo.Network(pseudo.shaped(pseudo.fit(table, known)))
    got = {r.doc_id: r for r in pseudo.score_documents(table).collect()}
    for i, t in docs:
        found = re.findall(r"\w+", t.lower())
        classes = np.array([of[w] for w in found], np.int64)
        around = pseudo.windows(classes, np.zeros(len(found), np.int64))
        want = net.log_likelihood(classes, around).sum() + sum(math.log(counts[w] / total[of[w]]) for w in found)
        assert got[i].n_words == len(found)
        assert abs(got[i].pll - want) < 1e-3 * max(1, len(found))


def test_copies_score_alike(spark):
    docs = [*corpus(), (100, "zzyzx qqfoo vvbar xxbaz"), (101, "zzyzx qqfoo vvbar xxbaz")]
    got = {r.doc_id: r.score for r in pseudo.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100] == got[101]
