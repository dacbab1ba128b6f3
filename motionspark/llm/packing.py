"""Operator 5: best-fit packing with certified bounds.

Documents become token ids; longer ones are cut from the back, so only a first piece is short. Pieces are
dealt to groups of bounded size and packed there by best-fit decreasing. A group's lower bound is the best
of several dual-feasible functions over its lengths; a group that meets it is certified: no packing of its own
pieces needs fewer sequences. A group with a gap between the two gives back the pieces of all its unfilled
sequences, a certified one only those of its emptiest, which is what rounding its bound up may have cost. They
are dealt anew, to fewer groups, and packed again. Once that saves nothing more, all unfilled sequences of all
groups exchange their pieces, as certificates say nothing across groups. It ends when the total meets the bound
over all lengths (a table of at most ``capacity`` rows) or such a round, too, saves nothing.

Defined cases: null text counts as empty (the end id alone makes one piece of length 1); repeated rows are
packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import saved, small_batches
from .tokens import default_path, encoder

CAPACITY = 2048
GROUP_PIECES = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PLACED = PIECES + ", sequence_id long, offset long, filled long, gap long, again boolean"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The least number of bins any packing needs: the largest sum over dual-feasible functions, rounded up."""
    if not len(lengths):
        return 0
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, lengths, counts)
    size = np.arange(capacity + 1)
    n, total = np.cumsum(hist), np.cumsum(hist * size)
    cut = np.arange(0, capacity // 2 + 1)  # lengths over capacity - cut count as a whole bin, those under cut as nothing
    large = n[-1] - n[capacity - cut]
    middle = total[capacity - cut] - np.where(cut > 0, total[np.maximum(cut - 1, 0)], 0)
    best = int(-(-(large * capacity + middle) // capacity).max())
    for k in range(1, 33):  # lengths rounded down to multiples of 1 / k of a bin
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((hist * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the fullest bin with room takes each, longest items first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0  # bit r of rooms: some bin has r left
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        if fits := rooms >> need:
            room = need + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            chosen, room, opened = opened, capacity, opened + 1
        bins[item], offsets[item] = chosen, capacity - room
        if left := room - need:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: its place in its document, its length and the checksum of its ids. ``deal``: an even number to deal it by."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            encoded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    nth += 1
                    out.append((doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), (part * 0x9E3779B1 + nth * 0x85EBCA77) & 0x7FFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, [pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def _pack(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Each group's packing: a piece's sequence, its offset there, how full that is, the group's gap, and whether the piece is given back."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths).astype(np.int64)
        gap = len(filled) - lower_bound(lengths, np.ones(len(lengths), np.int64), capacity)
        again = filled < capacity
        if not gap:
            again &= np.arange(len(filled)) == filled.argmin()
        return group[_NAMES].assign(sequence_id=(turn << 56) + (int(key[0]) << 24) + bins, offset=offsets, filled=filled[bins], gap=gap, again=again[bins])

    dealt = pieces.select(*_NAMES, F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(groups)).alias("dealt_to"))
    return dealt.groupBy("dealt_to").applyInPandas(pack, PLACED)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give each piece a sequence and an offset in it. Every round but two saves a sequence at least, so it ends."""
    lengths = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    n = sum(r["count"] for r in lengths)
    bound = lower_bound(np.array([r["length"] for r in lengths], np.int64), np.array([r["count"] for r in lengths], np.int64), capacity)
    # a sequence has one piece at offset 0, so those pieces count sequences
    counts = [F.count_if(F.col("offset") == 0).alias("sequences"), F.count_if("again").alias("again"), F.count_if(F.col("filled") < capacity).alias("unfilled")]
    rest = pieces  # pieces to pack in this round
    kept: DataFrame | None = None  # and those that keep their sequences
    best: DataFrame | None = None
    fewest, turn, wide = 0, 0, False
    while True:
        placed = saved(_pack(rest, max(1, -(-n // group_pieces)), turn, capacity), f"packed-{turn}")
        everything = placed if kept is None else kept.unionByName(placed)
        now = everything.agg(*counts).first()
        if best is None or now["sequences"] < fewest:
            best, fewest, left, wide = everything, now["sequences"], now, False  # a narrow round comes next
        elif wide:
            return best
        else:
            wide = True
        if fewest == bound or not left["unfilled"]:
            return best
        again = F.col("filled") < capacity if wide else F.col("again")
        rest, kept, n, turn = best.filter(again), best.filter(~again), left["unfilled"] if wide else left["again"], turn + 1


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    small_batches(spark)
    pieces = saved(cut_pieces(docs, tokenizer or default_path()), "pieces")
    return pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
