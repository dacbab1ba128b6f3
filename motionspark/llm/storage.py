"""Shared-folder storage: every cut of lineage is a written table that all executors can read."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are dealt to several tasks, at most: what is broadcast about them has fewer rows than this.
HOT_KEYS = 10_000
#: Rows of one key that one task may take, at least.
HOT_ROWS = 512

_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="motionspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame of :func:`saved`, once nothing reads it any more."""
    from pyarrow import fs

    if df is not None and (path := _WRITTEN.pop(df, None)):
        store, inner = fs.FileSystem.from_uri(path)
        store.delete_dir(inner)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds: texts differ in size by four orders of magnitude. It stays set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def dealt_join(many: DataFrame, few: DataFrame, key: str | list[str], sizes: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """The join (inner or left) on ``key``, where rows of a hot key of ``many`` go to several tasks and ``few``'s are copied to each.

    ``sizes`` (key, n): rows of ``many`` a key. A key is hot if it holds over 1 / HOT_KEYS of all rows (and over
    HOT_ROWS), so hot keys are fewer than HOT_KEYS however large the tables. ``by``: what a hot key is dealt by.
    """
    keys = [key] if isinstance(key, str) else key
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(sizes.filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_deals")))  # fewer than HOT_KEYS rows
    left = many.join(hot, keys, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(by), F.col("_deals")).cast("int"), F.lit(0))).drop("_deals")
    right = few.join(hot, keys, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_deals"), F.lit(1)) - 1))).drop("_deals")
    return left.join(right, [*keys, "_deal"], how).drop("_deal")
