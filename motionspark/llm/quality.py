"""Operator 9: quality rules.

Each document gets plain counts, two hard rules over them, and a score: the mean, over its byte 4-grams
hashed to 65,536 buckets, of the log-ratio of two smoothed multinomials, the trusted documents' and the
raw corpus's. Byte n-grams suit texts whose words are mostly seen once. A document is kept if it passes the
hard rules and its score is at least ``LEAST_SCORE``.

The raw multinomial counts every document. The trusted one counts labelled documents (quality 1, toxic 0),
at most ``TRUSTED_ROWS`` of them, those with the smallest hashes of their ids. Ratios are rounded to integers
before they are summed, so a score does not depend on how rows are dealt to tasks.

Defined cases: null text has no words and so fails the hard rules; texts under four bytes score 0; without
trusted rows all scores are 0; repeated rows are each judged; an empty table gives no rows; further columns
stay in :func:`keep_good` and go from the query's result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import small_batches
from .words import BYTE, LEADS, NOT_SPACE, Slice, Words, hashes, mix, ngrams, slices, words

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
LEAST_SCORE = -0.5
SCALE = 1 << 16
SMOOTH = 0.5
MIN_WORDS = 50
_SYMBOL = np.isin(BYTE, list(b"#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, part: Slice) -> np.ndarray:
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return np.diff(running[part.offsets])


def gram_buckets(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte 4-gram that lies in one text, and for each row the index of its first one (rows + 1)."""
    d, size = part.data.astype(np.uint32), np.diff(part.offsets)
    if len(d) < 4:
        return np.zeros(0, np.int64), np.zeros(part.rows + 1, np.int64)
    value = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    bucket = (value * np.uint32(2654435761)) >> np.uint32(16)
    whole = np.ones(len(bucket), bool)
    for k in range(1, 4):  # grams that would run over the end of a text
        at = part.offsets[1:] - k
        whole[at[(at >= 0) & (at < len(whole))]] = False
    first = np.zeros(part.rows + 1, np.int64)
    np.cumsum(np.maximum(size - 3, 0), out=first[1:])
    return bucket[whole].astype(np.int64), first


def plain_counts(part: Slice) -> dict[str, np.ndarray]:
    found = words(part, NOT_SPACE)
    inside = NOT_SPACE[part.data]
    out = {"n_words": found.per_row, "word_chars": _per_row(inside & LEADS[part.data], part), "n_symbols": _per_row(_SYMBOL[part.data], part)}
    # lines with a word
    feeds = np.flatnonzero(part.data == 10)
    starts = np.unique(np.concatenate([part.offsets[:-1], feeds + 1]))
    starts = starts[starts < len(part.data)]
    row = np.searchsorted(part.offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(part.data)), part.offsets[row + 1])
    ends -= (ends > starts) & (part.data[np.maximum(ends - 1, 0)] == 10)
    running = np.concatenate([[0], np.cumsum(inside)])
    has = running[ends] > running[starts]
    lines = Words(starts[has], ends[has], row[has], np.zeros(0, np.int64))
    keys = mix(hashes(part, lines, fold=False) ^ mix(lines.row.astype(np.uint64)))
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    out["n_dup_lines"] = np.bincount(lines.row[order[again]], minlength=part.rows)
    # words in 3-word windows found twice or more
    grams, at = ngrams(hashes(part, found, fold=False), found.row, 3)
    grams = mix(grams ^ mix(found.row[at].astype(np.uint64)))
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(found.row), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(found.row[covered], minlength=part.rows)
    return out


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_ratio(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_ROWS) -> np.ndarray:
    """The scaled log-ratio of each bucket (an array of ``BUCKETS`` integers)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            trusted = np.array(batch.column("trusted").to_pylist(), bool)
            for part in slices(batch.column("text")):
                bucket, first = gram_buckets(part)
                raw += np.bincount(bucket, minlength=BUCKETS)
                mine = trusted[part.first : part.first + part.rows]
                if mine.any():
                    good += np.bincount(bucket[np.repeat(mine, np.diff(first))], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen])], ["bucket", "raw", "good"])

    chosen = F.broadcast(trusted_ids(labels, most).select("doc_id", F.lit(True).alias("trusted")))  # at most `most` ids
    marked = docs.select("doc_id", "text").join(chosen, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = marked.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()  # at most BUCKETS rows
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    if not good.sum():
        return np.zeros(BUCKETS, np.int64)
    log = lambda n: np.log((n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS))
    return np.rint((log(good) - log(raw)) * SCALE).astype(np.int64)


def judge(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE, most: int = TRUSTED_ROWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with its counts, ``score``, ``base_failed`` and ``kept``; columns of ``docs`` of these names give way."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(fit_ratio(narrow, labels, most))  # 512 KB whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            columns: dict[str, list[np.ndarray]] = {k: [] for k in (*COUNTS, "score")}
            for part in slices(batch.column(text_col)):
                for k, v in plain_counts(part).items():
                    columns[k].append(v)
                bucket, first = gram_buckets(part)
                total = np.concatenate([[0], np.cumsum(ratio[bucket])])[first]
                columns["score"].append(np.diff(total) / (SCALE * np.maximum(np.diff(first), 1)))
            flat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in columns.items()}
            failed = (flat["n_words"] < MIN_WORDS) | (100 * flat["n_repeat_words"] > 50 * flat["n_words"])
            new = [pa.array(flat[k].astype(np.int64)) for k in COUNTS] + [pa.array(flat["score"].astype(float)), pa.array(failed.astype(bool)), pa.array(~failed.astype(bool) & (flat["score"] >= least))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *COUNTS, "score", "base_failed", "kept"])

    new = [T.StructField(k, T.LongType()) for k in COUNTS] + [T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    plain = docs.select(*[c for c in docs.columns if c not in {f.name for f in new}])
    return plain.mapInArrow(score, T.StructType([*plain.schema.fields, *new]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names."""
    numbered = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    text_col, id_col = (f"_{docs.columns.index(c)}" for c in ("text", "doc_id"))
    return judge(numbered, labels, text_col=text_col, id_col=id_col).filter("kept").select(*numbered.columns).toDF(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
