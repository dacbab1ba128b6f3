"""Operator 7: benchmark decontamination by spaced seeds.

A spaced seed is a window of words of which a fixed mask selects some; two windows with the same selected
words have the same hash whatever stands at the ignored places. Hashes of all windows of the benchmark and
of all documents are joined. Around a hit, document and item are laid over one another along the hit's
diagonal, and an overlap counts if some stretch of ``STRETCH`` words (the whole item, if it is shorter)
agrees in at least 80 % of its places, so single substituted words do not hide a leak.

``MASKS`` find every stretch of 13 words with up to two substitutions. A shorter item has masks of its own that
are laid over it whole: its places are dealt to two parts more than words may differ, and each mask leaves out
as many parts as words may differ, so wherever those words stand some mask ignores them all. So every overlap
that counts has a hit, whatever the item's length.

The documents' hashes are first put to a bitmap of the benchmark's, of a fixed size whatever the benchmark; it
only spares the join rows that cannot match. A benchmark of over a million windows fills it more and more: then
more windows of documents are written and joined (all of them at worst), and the result is the same. Hashes
that very many windows of documents share are dealt to several tasks.

Defined cases: words are runs of letters and digits with A-Z lowered; null texts count as empty; an item
without words is ignored, as are rows without an item id; items of one to four words must stand verbatim,
and :func:`keep_clean` takes them for too short to be a leak; rows of one document id are one document; an empty
table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import dealt_join, saved, small_batches
from .words import ALNUM, U64, Words, hashes, mix, slices, words

#: Selected places of each mask, over at most ``SPAN`` words. Any 13 words with two substitutions hold a hit of one.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 2, 3, 5, 6, 8), (0, 1, 3, 6, 8, 9), (0, 1, 2, 3, 4, 5), (0, 3, 4, 5, 8, 9))
#: Items of fewer words are no leaks by themselves.
SHORTEST = 5
STRETCH = 13
AGREE = 0.8
BITS = 24
_BLOCK = 15
_STEP = U64(0x9E3779B97F4A7C15)


def seed_hashes(h: np.ndarray, row: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window that lies in one text, and the index of its first word."""
    size = max(0, len(h) - mask[-1])
    at = np.flatnonzero(row[:size] == row[mask[-1] :][:size])
    out = np.full(size, sum(1 << i for i in mask), np.uint64)
    for i in mask:
        out = out * _STEP + h[i : i + size]
    return mix(out[at]), at


def masks_of(n: int) -> list[tuple[int, ...]]:
    """The masks for an item of ``n`` words."""
    if n >= STRETCH:
        return list(MASKS)
    differ = n - int(np.ceil(AGREE * n))
    if not differ:
        return [tuple(range(n))]
    parts = differ + 2
    return [tuple(i for i in range(n) if i % parts not in out) for out in combinations(range(parts), differ)]


def bit_places(h: np.ndarray) -> list[np.ndarray]:
    """Three places of each hash in the bitmap."""
    return [((h >> U64(s)) & U64((1 << BITS) - 1)).astype(np.int64) for s in (0, 20, 40)]


_SEED = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, place of the window's first word and, for an item that has masks of its own, its size (else 0)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("item_id").to_pylist(), np.int64)
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                h, sizes = hashes(part, found), found.per_row
                there = sorted(set(np.minimum(sizes[sizes > 0], STRETCH).tolist()))
                for n, mask in ((n, mask) for n in there for mask in masks_of(n)):
                    seeds, at = seed_hashes(h, found.row, mask)
                    row = found.row[at]
                    # a mask of a short item is laid over it from its first word on
                    own = (sizes[row] == n) & (at == found.first[row]) if n < STRETCH else sizes[row] >= STRETCH
                    size = n if n < STRETCH else 0
                    yield pa.RecordBatch.from_arrays([pa.array(seeds[own].view(np.int64)), pa.array(ids[part.first + row[own]]), pa.array((at - found.first[row])[own].astype(np.int32)), pa.array(np.full(own.sum(), size, np.int32))], schema=_SEED)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").mapInArrow(make, "hash long, item_id long, at int, size int")


def word_lists(texts: DataFrame, id_col: str) -> DataFrame:
    """The id and its words' hashes, 32 bits each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(part.first, part.rows), _lists(hashes(part, found), found.first)], [id_col, "words"])

    return texts.select(F.col(id_col).cast("long").alias(id_col), "text").mapInArrow(make, f"{id_col} long, words array<int>")


def _lists(h: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array((h >> U64(32)).astype(np.uint32).view(np.int32)))


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITS bits over the seeds' hashes; it comes to the driver in blocks, 2 MB in all."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << _BLOCK, bool)
        block[group["place"].to_numpy()] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(block).tobytes()]})

    masked = [F.shiftrightunsigned("hash", s).bitwiseAND((1 << BITS) - 1) for s in (0, 20, 40)]
    places = seeds.select(F.explode(F.array(*masked)).alias("p")).distinct()
    blocks = places.select((F.shiftright("p", _BLOCK)).cast("int").alias("block"), F.col("p").bitwiseAND((1 << _BLOCK) - 1).cast("int").alias("place"))
    out = np.zeros(1 << BITS, bool)
    for row in blocks.groupBy("block").applyInPandas(merge, "block int, bits binary").collect():
        out[row["block"] << _BLOCK : (row["block"] + 1) << _BLOCK] = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
    return np.packbits(out)


def _sought(h: np.ndarray, found: Words, masks: list[tuple[int, ...]], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows that the bitmap may hold, and their first words' indices."""
    got_h, got_at = [], []
    for mask in masks:
        seeds, at = seed_hashes(h, found.row, mask)
        for place in range(3):
            p = bit_places(seeds)[place]
            may = (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
            seeds, at = seeds[may], at[may]
        got_h.append(seeds)
        got_at.append(at)
    return np.concatenate([*got_h, np.zeros(0, np.uint64)]), np.concatenate([*got_at, np.zeros(0, np.int64)])


def candidates(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Documents with a window the bitmap may hold: uid (of the row), doc_id, words and those windows, the places of equal ones together."""
    lengths = [r[0] for r in seeds.select("size").distinct().collect()]  # fewer than STRETCH values
    masks = sorted({mask for n in lengths for mask in masks_of(n or STRETCH)})
    shared = docs.sparkSession.sparkContext.broadcast(seed_bitmap(seeds))  # 2 MB whatever the benchmark
    window = pa.list_(pa.struct([("hash", pa.int64()), ("places", pa.list_(pa.int32()))]))
    fields = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("windows", window)])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, nth, task = shared.value, 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                h = hashes(part, found)
                got, at = _sought(h, found, masks, bits)
                if not len(got):
                    continue
                row = found.row[at]
                order = np.lexsort((at, got, row))
                got, at, row = got[order], at[order], row[order]
                new = np.ones(len(got), bool)
                new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(new)
                rows, first = np.unique(row[start], return_index=True)
                places = pa.ListArray.from_arrays(pa.array(np.append(start, len(at)).astype(np.int32)), pa.array((at - found.first[row]).astype(np.int32)))
                pairs = pa.StructArray.from_arrays([pa.array(got[start].view(np.int64)), places], ["hash", "places"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)).astype(np.int32)), pairs)
                mine = _lists(h, found.first).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array((task << 36) + nth + np.arange(len(rows))), ids.take(pa.array(rows + part.first)), mine, lists], schema=fields)
                nth += len(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(seek, "uid long, doc_id long, words array<int>, windows array<struct<hash:long,places:array<int>>>")


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(matched words, start, end in the document) of the agreeing stretches along a diagonal, if there are any."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    size = min(STRETCH, len(item))
    if high - low < size:
        return None
    same = doc[diagonal + low : diagonal + high] == item[low:high]
    running = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(running[size:] - running[:-size] >= np.ceil(AGREE * size))
    if not len(good):
        return None
    covered = np.zeros(len(same), bool)
    for i in good:
        covered[i : i + size] = True
    return int((covered & same).sum()), int(diagonal + low + good[0]), int(diagonal + low + good[-1] + size)


def diagonals(places: list[tuple[np.ndarray, np.ndarray]], doc_words: int, item_words: int) -> tuple[np.ndarray, int]:
    """The distinct differences of places (document's, item's) of equal windows, and how many pairs of places there are.

    The differences are marked in an array of the texts' length, so repeats in both texts cost no memory.
    """
    seen, n = np.zeros(doc_words + item_words + 1, bool), 0
    for doc_at, item_at in places:
        n += len(doc_at) * len(item_at)
        for at in item_at:
            seen[doc_at - at + item_words] = True
    return np.flatnonzero(seen) - item_words, n


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, matched_words, item_words, doc_start, doc_end (in words) and coverage."""
    small_batches(docs.sparkSession)
    seeds = saved(benchmark_seeds(benchmark), "seeds")
    found = saved(candidates(docs, seeds), "windows")
    windows = found.select("uid", F.inline("windows"))
    sizes = saved(windows.groupBy("hash").agg(F.count("*").alias("n")), "window-counts")
    # one row a document, item and hash, however often the window repeats in either
    sought = seeds.groupBy("hash", "item_id").agg(F.collect_set("at").alias("item_places"))
    hits = dealt_join(windows, sought, "hash", sizes, "uid")
    pairs = hits.groupBy("uid", "item_id").agg(F.collect_list(F.struct("places", "item_places")).alias("hits"))  # a document's windows at most
    items = word_lists(benchmark.filter("item_id IS NOT NULL"), "item_id").withColumnRenamed("words", "item")
    laid = pairs.join(found.select("uid", "doc_id", "words"), "uid").join(items, "item_id")
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("doc_start", pa.int64()), ("doc_end", pa.int64()), ("n_seeds", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc, item = batch.column("words")[i].values.to_numpy(), batch.column("item")[i].values.to_numpy()
                hits = batch.column("hits")[i].values
                lines, n = diagonals([(p.values.to_numpy(), q.values.to_numpy()) for p, q in zip(hits.field("places"), hits.field("item_places"), strict=True)], len(doc), len(item))
                tried = [o for d in lines.tolist() if (o := overlap(doc, item, d))]
                if tried:
                    matched, start, end = max(tried, key=lambda o: (o[0], -o[1]))
                    out.append({"doc_id": batch.column("doc_id")[i].as_py(), "item_id": batch.column("item_id")[i].as_py(), "matched_words": matched, "item_words": len(item), "doc_start": start, "doc_end": end, "n_seeds": n})
            yield pa.RecordBatch.from_pylist(out, fields)

    checked = laid.select("doc_id", "item_id", "words", "item", "hits").mapInArrow(verify, "doc_id long, item_id long, matched_words long, item_words long, doc_start long, doc_end long, n_seeds long")
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched_words", "n_seeds", "item_words", "doc_start", "doc_end")).alias("b")).select("doc_id", "item_id", "b.*")
    return best.withColumn("coverage", F.col("matched_words") / F.col("item_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The documents without any leak of an item of at least ``shortest`` words; all their columns stay, whatever their names."""
    leaky = find_leaks(docs, benchmark).filter(F.col("item_words") >= shortest).select("doc_id").distinct()
    numbered = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    doc_id = F.col(f"_{docs.columns.index('doc_id')}").cast("long")
    return numbered.join(leaky, doc_id.eqNullSafe(F.col("doc_id")), "left_anti").toDF(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
