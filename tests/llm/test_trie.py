"""The prefix trie against a plain one of dictionaries, and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from motionspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, borrow=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members[built[:d]].add(c)
        ends[built].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, tokens = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            tokens[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((str(x) for x in ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], tokens[p], sha(p)) for p, m in members.items())))


def made(rng: random.Random, n: int):
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(-250, 600), rng.randrange(0, 130), 100 * rng.randrange(5)])
        start = len([r for r in rows if r[0] == c])
        for t in range(start, start + rng.randrange(0, 9)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é𝒳", "", None, "long " * rng.randrange(4)])))
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS base", "2 AS depth", "'x' AS own").repartition(3)


def got_rows(frame):
    return sorted(str(tuple(r)) for r in frame.select(COLUMNS).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_the_query_against_plain_and_sql(spark, tmp_path, seed):
    rows = made(random.Random(seed), 300) + [(None, 1, "user", "x")]
    rows += [(c, t, "user", f"shared {t}") for c in range(1000, 1400) for t in range(7)]  # copies, many in one node
    rows += [(c, 0, "user", "hello") for c in range(5000, 5200)] + rows[:20]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain(rows)
    assert got_rows(trie.op12_prefix_trie(spark, str(tmp_path))) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(str(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.OP12_SQL})").fetchall()) == want


def test_small_shards_and_pieces_give_the_same(spark, monkeypatch):
    rows = made(random.Random(5), 200) + [(7000, t, "user", str(t % 3)) for t in range(700)] + [(c, 0, "user", "hello") for c in range(8000, 8100)]
    small = trie.small_batches
    monkeypatch.setattr(trie, "small_batches", lambda session, n: small(session, 20))
    assert got_rows(trie.prefix_trie(table(spark, rows), borrow=False, shard_rows=50, piece=7)) == plain(rows, False)


def test_defined_cases(spark):
    assert trie.prefix_trie(table(spark, [(1, 1, "u", "x")]).limit(0)).count() == 0
    rows = [(3, None, None, None), (3, 2, "user", "x" * 300_000), (3, 2, "user", "x" * 300_000), (105, 0, "a", "b"), (None, 0, "a", "b")]
    assert got_rows(trie.prefix_trie(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_slots_are_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, (n, 2)), axis=0)
    if n > 2:
        keys[: n // 2, 0] = 5  # digests may agree in one half
    held = trie.SlotTable(keys[:, 0].copy(), keys[:, 1].copy())
    slots = held.slots(keys[:, 0].copy(), keys[:, 1].copy())
    assert sorted(slots.tolist()) == list(range(len(keys)))
    other = rng.integers(-(2**63), 2**63 - 1, (50, 2))
    assert (held.slots(other[:, 0].copy(), other[:, 1].copy()) == -1).all()
