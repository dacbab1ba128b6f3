"""Operator 11: importance resampling of documents towards a target distribution.

Features are runs of one to three words, hashed by CRC-32 into buckets. Both sides are counted whole; a bucket's
gain is its scaled log-ratio of target to corpus, and a document's weight the sum of its features' gains, read
off an array. Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

The cutoff of the draw is found by bracketing: a mergeable quantile sketch proposes two scores around it, exact counts
of the rows above and between them show whether it lies there (if not, the bracket widens), and only the rows
between them are sorted to find it. A run's CRC follows from its words' CRCs, as CRC-32 is linear over GF(2).

Defined cases: a null text has no words, features 0 and weight 0; a null id is hashed as an empty one and comes last
among ties; rows that agree in score and id are drawn in any order, as many as there is room for; an empty table
gives no rows, an empty target draws by noise and the corpus's own counts; only the id and the text are read, so
further columns may have any name. Words of any length count whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import saved, small_batches
from .words import ALNUM, BYTE, Slice, slices, words

BUCKETS = 10_000
LONGEST = 3
SCALE = 1000
SEED = 42
LEAST_WORDS = 20
#: Half the width of the first bracket, as a share of the rows, and the sketch's accuracy (its rank error is 1 over this).
MARGIN = 0.002
ACCURACY = 5_000

_FOLD = np.where((BYTE >= 65) & (BYTE <= 90), BYTE + 32, BYTE).astype(np.uint8)
#: Words up to this many bytes are hashed together, longer ones one by one.
_REACH = 64
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_STEP = _crc_table()


def _zeros() -> np.ndarray:
    """[n, k, v]: what n zero bytes make of a register that holds byte v at place k."""
    out = np.empty((_REACH + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _REACH + 1):
        out[n] = _STEP[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_ZEROS = _zeros()


def _crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word."""
    size = end - start
    crc = np.full(len(start), _ONES)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_REACH) :]  # the longer ones stand first
    left = -size[order]
    for j in range(int(-left[0]) if len(order) else 0):
        at = order[: np.searchsorted(left, -j)]
        crc[at] = _STEP[(crc[at] ^ data[start[at] + j]) & 255] ^ (crc[at] >> 8)
    crc ^= _ONES
    for i in np.flatnonzero(size > _REACH):
        crc[i] = zlib.crc32(data[start[i] : end[i]])
    return crc


def _extended(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The CRC of what ``crc`` stands for, a space and the words at ``start``, whose own CRCs are ``own``."""
    crc = crc ^ _ONES
    crc = _STEP[(crc ^ 32) & 255] ^ (crc >> 8) ^ _ONES
    size = end - start
    long = np.flatnonzero(size > _REACH)
    n = np.minimum(size, _REACH)
    out = own ^ _ZEROS[n, 0, crc & 255] ^ _ZEROS[n, 1, (crc >> 8) & 255] ^ _ZEROS[n, 2, (crc >> 16) & 255] ^ _ZEROS[n, 3, crc >> 24]
    for i in long:
        out[i] = zlib.crc32(data[start[i] : end[i]], int(crc[i]))
    return out


def feature_buckets(part: Slice, buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For runs of one, two and three words: each run's bucket and row, in row order; and the words of each row."""
    data = _FOLD[part.data]
    found = words(part, ALNUM)
    own = _crcs(data, found.start, found.end)
    crc, out = own, [((own % buckets).astype(np.int64), found.row)]
    for n in range(1, LONGEST):
        crc = _extended(crc[:-1], data, found.start[n:], found.end[n:], own[n:])
        whole = found.row[n:] == found.row[: len(found.row) - n] if n < len(found.row) else np.zeros(0, bool)
        out.append(((crc[whole] % buckets).astype(np.int64), found.row[n:][whole]))
    return out, found.per_row


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of the column ``text`` fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column("text")):
                for bucket, _ in feature_buckets(part, buckets)[0]:
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(int)] = rows["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The scaled log-ratio of each bucket, with one added to every count."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(SCALE * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A scaled Gumbel variate from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    table, buckets = spark.sparkContext.broadcast(gain), len(gain)  # 8 bytes a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for part in slices(batch.column("text")):
                mine = slice(part.first, part.first + part.rows)
                runs, n_words[mine] = feature_buckets(part, buckets)
                for bucket, row in runs:
                    edge = np.searchsorted(row, np.arange(part.rows + 1))
                    n_features[mine] += np.diff(edge)
                    weight[mine] += np.diff(np.concatenate([[0], np.cumsum(table.value[bucket])])[edge])
            ids = batch.column("doc_id")
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_features), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in the order of all: sorted range partitions and the sizes of those before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = saved(dealt, "numbered")
    part, before, starts = F.shiftright("_at", 33), 0, []
    for r in sorted(dealt.groupBy(part.alias("part")).count().collect()):  # one row a partition
        starts.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long"))
    return dealt.join(starts, part == F.col("_part")).withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def draw(scored: DataFrame, percent: int, margin: float = MARGIN) -> DataFrame:
    """``scored`` (a table read twice or more) with ``rank``: 1, 2, 3 ... for the highest scores, ``percent`` of all rows with
    ``eligible``, and null for the rest."""
    able = scored.filter("eligible")
    score, share, k = F.col("score"), percent / 100, 0
    while True:
        ends = [max(0.0, 1 - share - margin), min(1.0, 1 - share + margin)]
        low, high = able.agg(F.percentile_approx("score", ends, ACCURACY)).first()[0] or (0, 0)
        n, above, inside = able.agg(F.count("*"), F.count_if(score > high), F.count_if(score.between(low, high))).first()
        k = percent * n // 100
        if not k or above < k <= above + inside:
            break
        margin *= 4  # at its widest the bracket holds all rows
    none = F.lit(None).cast("long")
    if not k:
        return scored.withColumn("rank", none)
    order = (score.desc(), F.col("doc_id").asc_nulls_last())
    first = numbered(able.filter(score > high), *order).withColumnRenamed("place", "rank")
    bracket = numbered(able.filter(score.between(low, high)), *order).withColumn("rank", F.when(F.col("place") <= k - above, F.col("place") + above)).drop("place")
    rest = scored.filter(~F.col("eligible") | (score < low)).withColumn("rank", none)
    return first.unionByName(bracket).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, eligible and rank of every row of ``docs`` (doc_id, text); ``target``: (text)."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = saved(scores(docs, gain, seed).withColumn("eligible", F.col("n_words") >= least_words), "scores")
    return draw(scored, percent)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
