"""Importance resampling against a plain version of its definition."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionspark.llm import resample
from motionspark.llm.words import slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None) -> list[str]:
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def n_words(text: str | None) -> int:
    return len(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def plain(docs, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for text in (d[1] for d in docs):
        for f in features(text):
            s[bucket(f)] += 1
    for text in target:
        for f in features(text):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        own = features(text)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words(text)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(tuple(r) for r in rows)


def texts(rng: random.Random, n: int) -> list[str | None]:
    pool = ["Ka", "lo", "né", "ÜBER", "x" * 70, "y" * 64, "z" * 65, "日本語", "9", "a1", "the", "of", "𝒳𝒴", "Z"]
    out: list[str | None] = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "-", "\t", "\x00", "_"]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for _ in range(n)]
    return [*out, None, "", "  ", "w" * 100_000, "a b " * 20_000]


def test_buckets_of_features():
    got = []
    given = texts(random.Random(1), 60)
    for part in slices(pa.array(given, pa.string()), 500):
        runs, _ = resample.feature_buckets(part)
        for row in range(part.rows):
            got.append(sorted(int(b) for bucket, of in runs for b in bucket[of == row]))
    assert got == [sorted(zlib.crc32(f.encode()) % 10000 for f in features(t)) for t in given]


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_against_plain(spark, percent):
    rng = random.Random(percent)
    docs = [(i * 7, t) for i, t in enumerate(texts(rng, 300))]
    target = texts(rng, 5)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS weight", "3 AS rank").repartition(5)
    got = resample.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()) == plain(docs, target, percent)


def test_the_query(spark, tmp_path):
    rng = random.Random(9)
    docs, target = [(i, t) for i, t in enumerate(texts(rng, 200))], texts(rng, 3)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = resample.op11_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, target)


@pytest.mark.parametrize("margin", [0.0, 1e-9, 0.3])
def test_any_bracket_gives_the_same_draw(spark, margin):
    rows = [(i if i % 17 else None, (i * i) % 23 if i % 3 else 5, i % 11 > 0) for i in range(2000)]
    scored = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean")
    got = resample.draw(scored, 20, margin or 0.0001).collect()
    assert len(got) == 2000
    able = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    k = len(able) * 20 // 100
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, k + 1))
    assert [(r["doc_id"], r["score"]) for r in drawn] == [(r[0], r[1]) for r in able[:k]]


def test_defined_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(None, "a " * 30), (None, "a " * 30), (3, "a " * 30), (3, "a " * 30), (4, None)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    got = resample.resample(some, none, 75).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert {r["doc_id"]: (r["n_features"], r["weight"]) for r in got}[4] == (0, 0)
    assert got[0]["score"] is not None
    assert resample.draw(some.select("doc_id", F.lit(1).alias("score"), F.lit(False).alias("eligible")), 50).filter("rank IS NOT NULL").count() == 0
