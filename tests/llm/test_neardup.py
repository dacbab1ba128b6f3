"""Classes of documents with repeated runs, against all pairs of bags."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

from motionspark.llm import neardup

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "ru", "so", "ta", "vü") for b in ("ba", "den", "fi", "gor", "hul", "jas", "kem")]


def bag(text: str) -> Counter:
    found = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return Counter(zip(*(found[i:] for i in range(5)), strict=False))


def near(a: Counter, b: Counter) -> bool:
    return 10 * (a & b).total() >= 8 * (a | b).total()


def test_weighted_classes_against_all_pairs(spark):
    rng, docs = random.Random(4), []
    for _ in range(25):
        line = [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randrange(5, 30))) for _ in range(3)]
        times = rng.randrange(1, 12)
        for _ in range(rng.randrange(2, 5)):
            docs.append("\n".join([line[0]] * max(1, times + rng.randrange(-2, 3)) + line[1:] * rng.randrange(1, 3)))
    docs.append("a b c d e " * 5000)
    docs.append("a b c d e " * 5001)
    docs.append("a b c d e " * 3000)
    bags = [bag(t) for t in docs]
    label = list(range(len(docs)))
    links = 0
    for i, j in combinations(range(len(docs)), 2):
        if near(bags[i], bags[j]):
            links += 1
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert links > 20
    assert label[-2:] == [len(docs) - 3, len(docs) - 1]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(label))


def test_a_band_that_many_documents_share(spark):
    rng = random.Random(8)
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(400)]
    docs = []
    for i in range(900):
        words[rng.randrange(400)] = f"w{i}"
        docs.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 900
    # neighbours in the chain differ in a word: 10 of 396 runs
    assert {r.class_id for r in got} == {0}
