"""Operator 3: near-duplicate classes by DartMinHash.

A document is the bag of its runs of five words (letters and digits, A-Z lowered): each run's weight is how
often it occurs. Two documents are linked if the weighted Jaccard similarity of their bags (the sum of the
lesser weights over that of the greater ones) is at least 0.8; without repeated runs that is the similarity of
sets. Classes are the connected components. Per document:

1. *Signature.* Hashed darts fall on the plane of each element's weight and rank; per coordinate the dart of
   the least rank that lies below the element's weight is kept. Only regions under a rank bound that leaves
   few coordinates empty are looked at (the bound doubles for the rest), so a signature costs
   O(elements + k log k). Signatures agree in a coordinate with the weighted Jaccard similarity's probability.
2. *Bands.* 24 bands of 5 coordinates; at similarity 0.8 a pair shares none with probability 8e-5.
3. *Copies.* Documents with the same bag of runs are one node of the graph, its least id, before any pair is made.
4. *Links.* In each bucket every member is compared exactly with one centre, not with every other member. The
   links' components are found, and buckets that still hold several components take another centre, for
   pairs across components only. The first round looks at one band, later ones at more, so a large group is
   one component before most of its buckets are looked at. In the end all pairs across components that share
   a bucket are compared, by parities in blocks and then exactly, so no link between components that
   any bucket shows is lost; pairs within a component are never made.

Components are found by contracting stars: each round connects every node's neighbours to the least of them.

To compare bags exactly, the second, third and further occurrences of a run count as elements of their own;
the bags' weighted similarity is then the plain one of those sets. Joins on a band deal the rows of a hot band
to several tasks. A hot bucket of n documents in several components makes n * n / 512 rows of parities in the
last round, as each of its blocks meets all its members; components that earlier rounds join make none.

Defined cases: null text counts as empty; texts of one to four words are one run; texts without words are
alike if they are equal; a null id gives a null class and joins no other; rows of one id are one document
and share a class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import dealt_join, forget, saved, small_batches
from .words import ALNUM, U64, Slice, hashes, mix, shingles, slices, text_hashes, words

RUN = 5
BANDS = 24
ROWS = 5
TENTHS = 8  # similarity in tenths
#: Bands whose buckets take part in each round of stars.
STAR_BANDS = (2, 24)
#: Members of a bucket that one task compares with all others, and places of a set's parities.
BLOCK = 512
PLACES = 2048
_STEP = U64(0x9E3779B97F4A7C15)
_SALT = U64(0xD6E8FEB86659FD93)
#: Cumulative Poisson(1) probabilities, scaled to 32 bits.
_POISSON = np.floor(np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 13.0)]))) * 2.0**32).astype(np.uint64)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(float) * 2.0**-53


def dart_signatures(element: np.ndarray, row: np.ndarray, rows: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """A (rows, k) array of dart hashes; 0 in rows without elements.

    ``weight``: of each element, over 0; 1 if absent (an element given twice then counts once).
    """
    out = np.zeros(rows * k, np.uint64)
    mass = np.bincount(row, weight, minlength=rows)
    bound = (np.log(k) + 4) * k / np.maximum(mass, 1e-12)
    todo = mass > 0
    while todo.any():
        best = np.full(rows * k, np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, width, level = 0.0, 1.0, 0
        while True:  # weight intervals [0, 1), [1, 2), [2, 4), ...
            mine = todo[row] if weight is None else todo[row] & (weight > low)
            if not mine.any():
                break
            e, r = element[mine], row[mine]
            regions = np.ceil(bound[r] * width).astype(np.int64)
            of = np.repeat(np.arange(len(e)), regions)
            step = np.arange(len(of)) - np.repeat(np.cumsum(regions) - regions, regions)
            seed = mix(e[of] + U64((level + 1) * int(_SALT) % 2**64) + step.astype(np.uint64) * _STEP)
            darts = np.searchsorted(_POISSON, seed >> U64(32), "right")
            at = np.repeat(np.arange(len(of)), darts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(seed[at] + (nth + 1).astype(np.uint64) * _STEP)
            rank = (step[at] + _unit(mix(dart ^ _SALT))) / width
            hit = rank < bound[r[of[at]]]
            if weight is not None:
                hit &= low + width * _unit(mix(dart ^ _STEP)) < weight[mine][of[at]]
            dart, rank = dart[hit], rank[hit]
            slot = r[of[at[hit]]] * k + (dart % U64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            kept.append((slot, rank, dart))
            if weight is None:
                break
            low, width, level = (1.0 if low == 0 else low * 2), (1.0 if low == 0 else low * 2), level + 1
        for slot, rank, dart in kept:
            first = best[slot] == rank
            out[slot[first]] = dart[first]
        full = np.isfinite(best.reshape(rows, k)).all(1)
        todo &= ~full
        bound[todo] *= 2
    return out.reshape(rows, k)


def occurrences(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs and rows sorted by row, then run, and how often the run has occurred in its row before."""
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    return grams, row, np.arange(len(grams)) - np.repeat(start, np.diff(np.append(start, len(grams))))


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SALT, parts.shape[:2]).copy()
    for i in range(rows):
        out = mix(out + parts[:, :, i] * _STEP)
    return out


def bag_keys(grams: np.ndarray, row: np.ndarray, part: Slice, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's bag of runs; of the whole text where there are none."""
    first = np.searchsorted(row, np.arange(part.rows + 1))
    out = []
    for salt in (_STEP, _SALT):
        running = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ salt), out=running[1:])
        key = running[first[1:]] - running[first[:-1]]
        out.append(np.where(first[1:] == first[:-1], mix(empty ^ salt), key))
    return out[0], out[1]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key1, key2 (of the bag of runs) and bands (empty for texts without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                grams, row = shingles(hashes(part, found), found, RUN)
                key1, key2 = bag_keys(grams, row, part, text_hashes(part))
                grams, row, before = occurrences(grams, row)
                first = np.flatnonzero(before == 0)
                weight = np.diff(np.append(first, len(grams))).astype(float)
                bands = band_hashes(dart_signatures(grams[first], row[first], part.rows, BANDS * ROWS, weight))
                some = found.per_row > 0
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, part.rows), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), _lists(bands[some].ravel().view(np.int64), some * BANDS, pa.int64())], ["doc_id", "key1", "key2", "bands"])

    return docs.mapInArrow(sign, "doc_id long, key1 long, key2 long, bands array<long>")


def run_sets(docs: DataFrame) -> DataFrame:
    """node (the id), runs (the hashes of the runs' occurrences, 32 bits each) and parity: per place, given by a
    hash's last bits, whether an odd number of the hashes fall there, 64 places a number."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                found = words(part, ALNUM)
                grams, row = shingles(hashes(part, found), found, RUN)
                grams, row, before = occurrences(grams, row)
                grams = np.where(before > 0, mix(grams + before.astype(np.uint64) * _STEP), grams)
                distinct = np.unique((row.astype(np.uint64) << U64(32)) | (grams >> U64(32)))
                sizes = np.bincount((distinct >> U64(32)).astype(np.int64), minlength=part.rows)
                place = (distinct >> U64(32)).astype(np.int64) * PLACES + (distinct & U64(PLACES - 1)).astype(np.int64)
                odd = np.packbits((np.bincount(place, minlength=part.rows * PLACES) & 1).astype(bool)).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, part.rows), _lists(distinct.astype(np.uint32).view(np.int32), sizes, pa.int32()), _lists(odd, np.full(part.rows, PLACES // 64), pa.int64())], ["node", "runs", "parity"])

    return docs.mapInArrow(gather, "node long, runs array<int>, parity array<long>")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of at least TENTHS / 10."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("runs_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("runs_b")), "b")
    common, total = F.size(F.array_intersect("runs_a", "runs_b")), F.size("runs_a") + F.size("runs_b")
    near = F.least(F.size("runs_a"), F.size("runs_b")) * 10 >= F.greatest(F.size("runs_a"), F.size("runs_b")) * TENTHS
    return both.filter(near & (common * (10 + TENTHS) >= total * TENTHS)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for every node of ``edges`` (a, b) that isn't that least node."""
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = tuple(now)
        both = edges.unionAll(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").select(F.col("v"), "m").unionAll(least.select(F.col("u").alias("v"), "m"))
        edges, old = saved(moved.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).filter("a <> b").distinct(), "edges"), edges
        forget(old)


def _pair(a: str, b: str):
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one ``key`` each, which stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if held and (k or held[-1].column(key)[0].as_py() != values[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _square(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length as an array of two dimensions."""
    return table[name].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _share(lists: pa.Array, i: int, at: np.ndarray) -> np.ndarray:
    """Which of the lists ``at`` hold a value of list ``i``."""
    own = lists[i].values.to_numpy()
    some = lists.take(pa.array(at))
    hits = np.isin(some.flatten().to_numpy(), own)
    return np.bincount(np.repeat(np.arange(len(at)), some.value_lengths().to_numpy()), hits, minlength=len(at)) > 0


def near_in_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The indices of pairs of different labels, of different blocks if there are two, that share no earlier band and may be near:
    sets that differ in d hashes differ in d places of their parities at most, so none that is near is lost."""
    block, label, size = (table[c].to_numpy() for c in ("block", "label", "size"))
    parity, earlier = _square(table, "parity").view(np.uint64), table["earlier"].combine_chunks()
    two, found = block.min() != block.max(), []
    for i in range(table.num_rows):
        at = np.flatnonzero((label[i + 1 :] != label[i]) & ((block[i + 1 :] != block[i]) | (not two))) + i + 1
        differ = np.bitwise_count(parity[at] ^ parity[i]).sum(1, dtype=np.int64)
        at = at[differ * (10 + TENTHS) <= (size[at] + size[i]) * (10 - TENTHS)]
        at = at[~_share(earlier, i, at)] if len(at) else at
        found.append(np.stack([np.full(len(at), i), at]))
    return tuple(np.concatenate(found, 1))


def across(named: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of different labels that share a band and whose parities may be near.

    Buckets of two members are settled by the rounds before. A large bucket is dealt in blocks, and each two blocks meet in a
    group of their own. Pairs are compared there by their parities, and are rows only if they may be near, once, for the
    least band they share.
    """
    size = saved(named.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high AND n > 2"), "sizes")
    outlines = sets.select("node", F.size("runs").cast("long").alias("size"), "parity")
    blocks = size.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mixed = dealt_join(named, blocks, "band", size.select("band", "n"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    bands = mixed.groupBy("node").agg(F.sort_array(F.collect_list("band")).alias("bands"))  # BANDS at most
    earlier = F.filter("bands", lambda x: x < F.col("band"))
    rest = saved(mixed.join(bands, "node").join(outlines, "node").select("band", "blocks", "block", "node", "label", "size", "parity", earlier.alias("earlier")), "mixed")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    group = F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))
    dealt = rest.select("*", other).withColumn("group", group).repartition("group").sortWithinPartitions("group").select("group", "block", "node", "label", "size", "parity", "earlier")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "group"):
            i, j = near_in_block(table)
            node = table["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def links(members: DataFrame, sets: DataFrame, star_bands: tuple[int, ...] = STAR_BANDS) -> DataFrame:
    """The labels of the components over ``members`` (nth, band, node), as :func:`components` gives them."""
    rounds = len(star_bands)
    found: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(rounds + 1):
        some = members.filter(F.col("nth") < star_bands[turn]) if turn < rounds else members
        if labels is None:
            named = some.select("band", "node", F.col("node").alias("label"))
        else:
            named = some.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        centre = F.min_by(F.struct("node", "label"), F.struct(F.xxhash64("node", "band", F.lit(turn)), "node"))
        if turn < rounds:
            mixed = saved(named.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), centre.alias("centre")).filter("low <> high"), "stars")
            centres = mixed.select("band", F.col("centre.node").alias("c"), F.col("centre.label").alias("c_label"))
            pairs = dealt_join(named, centres, "band", mixed.select("band", "n"), "node").filter("label <> c_label").select(*_pair("node", "c"))
        else:
            pairs = across(named, sets)
        new = saved(linked(pairs.distinct(), sets), f"links-{turn}")
        found = new if found is None else found.unionAll(new)
        if turn and new.isEmpty():
            continue
        labels = components(found)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the least id of the class), a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = saved(signatures(docs), "signatures")
    some = signed.filter("doc_id IS NOT NULL")
    nodes = saved(some.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("nth", "band"))
    shared = saved(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("band", "n"), "shared")
    members = saved(dealt_join(banded, shared.select("band"), "band", shared, "node"), "members")
    involved = members.select(F.col("node").alias("doc_id")).distinct()
    sets = saved(run_sets(docs.join(involved, "doc_id", "left_semi")), "runs")
    labels = links(members, sets)
    # an id with several texts is a node of several bags: they share the least label of them all
    of_id = some.join(nodes.select("key1", "key2", "node"), ["key1", "key2"]).select("doc_id", "node")
    if not of_id.filter("doc_id <> node").groupBy("doc_id").agg(F.countDistinct("node").alias("n")).filter("n > 1").isEmpty():
        again = of_id.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(again))
    classes = of_id.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
    return classes.unionAll(signed.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of the least id of each class, one row of each id; rows without an id stay."""
    gone = near_duplicates(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = docs.select("doc_id").filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
