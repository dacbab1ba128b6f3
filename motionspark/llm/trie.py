"""Operator 12: the prefix trie of conversations.

A node is a distinct sequence of the first d turns (role and text) of some conversation; its digest is 128 bits of BLAKE2b
over its parent's digest and its last turn's. Conversations pass by in order as (conv_id, depth, digest) rows; then

1. *Nodes.* Each shard of rows keeps its distinct digests in a table behind a minimal perfect hash: a digest's slot is
   computed, and held against the digest stored there. Counts and least members are scattered into flat arrays by
   slot; the shards' tables are added up by digest.
2. *Owners.* A node belongs to its least member, so what one conversation owns is the lower end of its path.
3. *Sums.* Shards of whole conversations put what each node adds (a leaf; tokens saved) into its slot, once, and add slots
   to those of their parents, deepest first. A node that paths in several shards share has a partial sum in each.
   So no shard need hold a whole subtree, and a first turn that a third of all conversations share is no hot key.
4. *Ends.* The ids that end at a node are range-sorted, joined in pieces, and hashed piece by piece.

Defined cases: a null role or text is empty; null turns come first; turns of the same number are ordered by role, then
text, and repeated rows stay; rows without a conv_id belong to no conversation and are left out; an empty table gives no
nodes; further columns are ignored. One conversation's path (some tens of bytes a turn) is held by one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import dealt_join, saved, small_batches
from .words import U64, mix

#: Conversations that share their first turns, and how many of them at most.
GROUP = 100
BORROWED = 6
#: Rows of a shard, unless one conversation alone has more.
SHARD_ROWS = 1 << 18
#: Ids joined to one piece before they are hashed.
PIECE = 2048
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_STEP = U64(0x9E3779B97F4A7C15)
STEPS = "conv_id long, depth int, hi long, lo long, p_hi long, p_lo long, chars long"
_STEPS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), *((n, pa.int64()) for n in ("hi", "lo", "p_hi", "p_lo", "chars"))])


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: each level places the digests that meet no other there."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # which places are taken, how many before each, slots before
        left, used = np.arange(len(hi)), 0
        slot = np.empty(len(hi), np.int64)
        while len(left):
            size = 2 * len(left) + 1
            at = self._place(hi[left], lo[left], len(self.levels), size)
            taken = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(taken) - taken
            alone = taken[at]
            slot[left[alone]] = used + rank[at[alone]]
            self.levels.append((taken, rank, used))
            used += int(taken.sum())
            left = left[~alone]
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[slot], self.lo[slot] = hi, lo

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(mix(hi.view(np.uint64) + U64((level + 1) * int(_STEP) % 2**64)) ^ lo.view(np.uint64)) % U64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.hi)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the table does not hold it."""
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, (taken, rank, used) in enumerate(self.levels):
            at = self._place(hi[left], lo[left], level, len(taken))
            here = taken[at]
            out[left[here]] = used + rank[at[here]]
            left = left[~here]
        known = out >= 0
        known[known] = (self.hi[out[known]] == hi[known]) & (self.lo[out[known]] == lo[known])
        return np.where(known, out, -1)


def _distinct(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The index of one row of each digest."""
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    return order[new]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def paths(turns: DataFrame, borrow: bool = True) -> DataFrame:
    """A row for each conversation and depth from 0: digest, parent's digest and the code points of the last text.

    ``borrow``: conversation c begins with the first h turns of conversation c - c % GROUP, and goes on with its own
    after its first h; h is the CRC-32 of c's decimal digits modulo BORROWED.
    """
    small_batches(turns.sparkSession, 8192)
    empty = F.lit("")
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP if borrow else F.col("conv_id"))
    keys = ("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.repartition("base").sortWithinPartitions(*keys)
    own = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("base", "conv_id", own.alias("own"), F.length("text").cast("long").alias("chars"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = conv = None
        first: list[tuple[bytes, int]] = []  # the base conversation's
        out: list[list[int]] = [[] for _ in _STEPS]
        digest, depth, skip = bytes(16), 0, 0

        def put(own: bytes | None, chars: int) -> None:
            nonlocal digest, depth
            if own is None:
                digest, depth = bytes(16), 0
                row = (conv, 0, 0, 0, None, None, 0)
            else:
                parent, digest, depth = digest, hashlib.blake2b(digest + own, digest_size=16).digest(), depth + 1
                row = (conv, depth, *_halves(digest), *_halves(parent), chars)
            for column, value in zip(out, row, strict=True):
                column.append(value)

        for batch in batches:
            for b, c, own, chars in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if b != base:
                    base, conv, first = b, None, []
                if c != conv:
                    conv, skip = c, zlib.crc32(str(c).encode()) % BORROWED if borrow else 0
                    put(None, 0)
                    if c != b:
                        for turn in first[:skip]:
                            put(*turn)
                    nth = 0
                if c == b and len(first) < BORROWED:
                    first.append((own, chars))
                nth += 1
                if nth > skip or c == b:  # the base borrows from itself
                    put(own, chars)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _STEPS, strict=True)], schema=_STEPS)
            out = [[] for _ in _STEPS]

    return rows.mapInArrow(walk, STEPS)


def _numpy(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for n in names]


def _shards(batches: Iterator[pa.RecordBatch], most: int, whole: str | None = None) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows; with ``whole``, rows of one value of that column, which stand together, stay together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= most:
            table = pa.Table.from_batches(held)
            cut = n
            if whole:
                values = table[whole].combine_chunks().to_numpy()
                cut = int(np.searchsorted(values == values[-1], True))  # the last value may go on
            if not cut:
                break
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def node_table(steps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each distinct prefix: digest, parent's digest, depth, chars, n_convs and conv_id, its least member."""
    schema = "hi long, lo long, p_hi long, p_lo long, depth int, chars long, n long, conv_id long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, shard_rows):
            hi, lo, p_hi, p_lo, depth, chars, conv = _numpy(table, "hi", "lo", "p_hi", "p_lo", "depth", "chars", "conv_id")
            one = _distinct(hi, lo)
            nodes = SlotTable(hi[one], lo[one])
            slot = nodes.slots(hi, lo)
            if (slot < 0).any():
                raise AssertionError("a digest without a slot")
            least = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(least, slot, conv)
            at = np.empty(len(nodes), np.int64)
            at[slot] = np.arange(len(slot))  # any row of the node
            yield from pa.table([hi[at], lo[at], p_hi[at], p_lo[at], depth[at], chars[at], np.bincount(slot, minlength=len(nodes)), least], ["hi", "lo", "p_hi", "p_lo", "depth", "chars", "n", "conv_id"]).to_batches()

    same = ("p_hi", "p_lo", "depth", "chars")
    return steps.mapInArrow(count, schema).groupBy("hi", "lo").agg(*[F.max(c).alias(c) for c in same], F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def subtree_sums(steps: DataFrame, nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Digest, n_leaves and saved_tokens of each node, over its subtree; ``nodes`` with their ``n_children``."""
    mine = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    zero = F.lit(0).cast("long")
    owned = steps.join(mine, ["conv_id", "depth"], "left").select("conv_id", "depth", "hi", "lo", "p_hi", "p_lo", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saved", zero).alias("saved"))
    owned = owned.repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, shard_rows, "conv_id"):
            hi, lo, p_hi, p_lo, depth, leaf, saved_ = _numpy(table, "hi", "lo", "p_hi", "p_lo", "depth", "leaf", "saved")
            one = _distinct(hi, lo)
            nodes = SlotTable(hi[one], lo[one])
            slot_one = nodes.slots(hi[one], lo[one])
            parent, level = np.full(len(nodes), -1), np.empty(len(nodes), np.int64)
            parent[slot_one], level[slot_one] = nodes.slots(p_hi[one], p_lo[one]), depth[one]
            if (parent[level > 0] < 0).any():
                raise AssertionError("a node without its parent")
            slot = nodes.slots(hi, lo)
            leaves, tokens = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
            np.add.at(leaves, slot, leaf)
            np.add.at(tokens, slot, saved_)
            order = np.argsort(-level, kind="stable")
            edge = np.searchsorted(-level[order], -np.arange(level.max(initial=0), -2, -1))
            for a, b in zip(edge, edge[1:], strict=False):
                deep = order[a:b]
                if len(deep) and level[deep[0]] > 0:
                    np.add.at(leaves, parent[deep], leaves[deep])
                    np.add.at(tokens, parent[deep], tokens[deep])
            some = (leaves != 0) | (tokens != 0)
            yield from pa.table([nodes.hi[some], nodes.lo[some], leaves[some], tokens[some]], ["hi", "lo", "leaves", "tokens"]).to_batches()

    return owned.mapInArrow(add, "hi long, lo long, leaves long, tokens long").groupBy("hi", "lo").agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """hi, lo and ends_sha256: the SHA-256 of each digest's ids, ascending and joined by commas; ``ends`` (hi, lo, conv_id)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hi", "lo", "first", "ids"]
        for batch in batches:
            hi, lo, conv = (x.to_numpy() for x in batch.columns)
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(hi))
            cuts = [(k, min(k + piece, b)) for a, b in zip(start.tolist(), end.tolist(), strict=True) for k in range(a, b, piece)]
            ids = list(map(str, conv.tolist()))
            at = [a for a, _ in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(hi[at]), pa.array(lo[at]), pa.array(conv[at]), pa.array([",".join(ids[a:b]) for a, b in cuts], pa.string())], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for hi, lo, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (hi, lo) == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (hi, lo), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(("hi", "lo", "ends_sha256"))}, _ENDS)
        if key:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("hi", "lo", "ends_sha256"), (*key, state.hexdigest()), strict=True)}, _ENDS)

    small_batches(ends.sparkSession, 8192)
    order = ("hi", "lo", "conv_id")
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "hi long, lo long, first long, ids string")
    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").select("hi", "lo", "ids").mapInArrow(digest, "hi long, lo long, ends_sha256 string")


_ENDS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(turns: DataFrame, borrow: bool = True, shard_rows: int = SHARD_ROWS, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, turn, role, text); ``borrow``: see :func:`paths`."""
    steps = saved(paths(turns, borrow), "steps")
    counted = saved(node_table(steps, shard_rows), "nodes")
    inner = counted.filter("depth > 0")
    children = inner.groupBy(F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = saved(counted.join(children, ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie")
    last = steps.groupBy("conv_id").agg(F.max_by(F.struct("hi", "lo"), "depth").alias("end")).select("conv_id", "end.*")
    parents = nodes.filter("n_children > 0").select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("parent_conv_id"))
    sizes = nodes.filter("n_children > 0").select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("n_children").alias("n"))
    named = dealt_join(nodes.filter("depth > 0"), parents, ["p_hi", "p_lo"], sizes, "hi")
    named = named.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    zero: Column = F.lit(0).cast("long")
    out = named.join(subtree_sums(steps, nodes, shard_rows), ["hi", "lo"], "left").join(end_digests(last, piece), ["hi", "lo"], "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


_SQL_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)"

OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_SQL_CRC} % {BORROWED} AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, nth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND nth <= h
  UNION ALL SELECT c.conv_id, 1, nth, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND nth > h
), placed AS (
  SELECT conv_id, text, md5(length(role) || ':' || role || text) AS own, row_number() OVER (PARTITION BY conv_id ORDER BY part, nth) AS depth FROM rebuilt
), digests AS (
  SELECT conv_id, depth, length(text) AS chars, md5(string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM placed
), steps AS (
  SELECT conv_id, depth, chars, prefix, coalesce(lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM digests
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs
), nodes AS (
  SELECT prefix, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id FROM steps GROUP BY prefix
), children AS (
  SELECT parent AS prefix, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT s.prefix, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n LEFT JOIN children c USING (prefix) JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.prefix
), ends AS (
  SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max_by(prefix, depth) AS prefix FROM steps GROUP BY conv_id) GROUP BY prefix
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.prefix = n.parent LEFT JOIN children c ON c.prefix = n.prefix JOIN sums s ON s.prefix = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix
"""
