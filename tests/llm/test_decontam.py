"""Leaks of items of every length, against a comparison of every document with every item."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from motionspark.llm import decontam

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "ru", "so", "ta", "vü") for b in ("ba", "den", "fi", "gor", "hul")]


def test_masks_cover_every_substitution_that_counts():
    for n in range(1, 20):
        size = min(n, decontam.STRETCH)
        differ = size - int(np.ceil(decontam.AGREE * size))
        masks = decontam.masks_of(n)
        for changed in combinations(range(size), differ):
            places = [(m, at) for m in masks for at in (range(size - m[-1]) if n >= decontam.STRETCH else [0])]
            assert any(not {at + i for i in m} & set(changed) for m, at in places), (n, changed)


def plainly(doc: list[str], item: list[str]) -> bool:
    size = min(len(item), decontam.STRETCH)
    least = int(np.ceil(decontam.AGREE * size))
    return any(sum(a == b for a, b in zip(doc[i : i + size], item[k : k + size], strict=False)) >= least for i in range(len(doc) - size + 1) for k in range(len(item) - size + 1))


def test_all_overlaps_are_found(spark):
    rng = random.Random(9)
    items = [[rng.choice(WORDS) for _ in range(n)] for n in [*range(1, 16), *range(5, 16), 30]]
    docs = []
    for item in items:
        for changes in range(3):
            for _ in range(3):
                text = item.copy()
                for at in rng.sample(range(len(item)), min(changes, len(item))):
                    text[at] = "zz" + rng.choice(WORDS)
                docs.append([rng.choice(WORDS) for _ in range(rng.randrange(12))] + text + [rng.choice(WORDS) for _ in range(rng.randrange(12))])
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if plainly(doc, item)}
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{name} long, text string")
    documents, benchmark = table(docs, "doc_id"), table(items, "item_id")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents, benchmark).collect()} == want
    assert {len(items[i]) for _, i in want} >= set(range(1, 16))
    clashing = documents.selectExpr("doc_id", "text", "1 AS item_id", "2 AS _0", "3 AS _leaky")
    kept = decontam.keep_clean(clashing, benchmark)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, i in want if len(items[i]) >= 5}


def test_a_passage_that_many_documents_hold(spark):
    rng = random.Random(1)
    item = [rng.choice(WORDS) for _ in range(14)]
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('d', id, ' ', '{' '.join(item)}') AS text")
    found = decontam.find_leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert found.count() == 3000
    assert found.filter("matched_words = 14").count() == 3000


def test_repeats_in_both_texts_make_no_products(spark):
    """A repeated text against a repeated item: a row a window, and every difference of places once."""
    docs = spark.createDataFrame([(1, "la di da dum " * 5000), (2, "quite another text of some words that stand alone " * 3)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "la di da dum " * 300)], "item_id long, text string")
    got = decontam.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.matched_words, r.item_words) for r in got] == [(1, 7, 1200, 1200)]
    seeds = decontam.benchmark_seeds(items)
    windows = decontam.candidates(docs, seeds).selectExpr("inline(windows)")
    assert windows.count() < 50


def test_differences_of_places():
    rng = np.random.default_rng(2)
    places = [(rng.integers(0, 50, 9), rng.integers(0, 20, 4)) for _ in range(5)]
    lines, n = decontam.diagonals(places, 50, 20)
    assert lines.tolist() == sorted({int(d - i) for p, q in places for d in p for i in q}) and n == 180
