"""Readers, sinks and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="motionspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """End the lineage: write to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, n: int) -> DataFrame:
    """``df`` by keys, in tasks of about half a million of ``n`` rows, however many there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // 500_000)), *keys)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """None where there is no such path; whatever else is wrong raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several tables that is there."""
    for path in paths:
        if (df := read_or_none(spark, path)) is not None:
            return df
    raise FileNotFoundError(", ".join(paths))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, kind: str | None = None) -> DataFrame:
    """JSON lines. Strict: a bad line raises; else it is dropped. ``kind``: only records of this artifact_type."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.filter(F.col("artifact_type") == kind) if kind else df


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as compact JSON with sorted keys, nulls written."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, append: bool = False, compression: str = "none") -> None:
    """JSON lines. A compressed file is read by one task, so none is larger than a million lines."""
    writer = canonical_json(df).write.mode("append" if append else "overwrite")
    (writer if compression == "none" else writer.option("maxRecordsPerFile", 1_000_000)).text(path, compression=compression)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def files(spark: SparkSession, root: str, pattern: str, leave_out: str | None = None) -> DataFrame:
    """path, length and modificationTime of the files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    return df.filter(~F.col("path").contains(leave_out)) if leave_out else df


def path_parts(path: Column) -> Column:
    """gym (may be null), camera, date and hour of ``[gym/]camera/YYYY-MM-DD/HH/name``, and the clip id, the name's stem."""
    part = r"(?:^|.*/)(?:([^/]+)/)?([^/]+)/(\d{4}-\d{2}-\d{2})/(\d{2})/([^/]+)\.[^./]+$"
    get = lambda i: F.nullif(F.regexp_extract(path, part, i), F.lit(""))
    return F.struct(get(1).alias("gym_id"), get(2).alias("camera_id"), get(3).alias("date"), get(4).alias("hour"), get(5).alias("clip_id"))


def path_fault(parts: Column, camera: Column) -> Column:
    """Why a file of a camera does not belong where it lies (``parts`` of :func:`path_parts`); null if it does."""
    return F.when(parts["clip_id"].isNull(), "unknown_layout").when(parts["camera_id"] != camera, "camera_mismatch").when(parts["hour"].cast("int") > 23, "bad_hour")


def pending(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What was found and is not yet done."""
    return found.join(done.select(key).distinct(), key, "left_anti")


def ingest(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append what is new by its key; of repeated keys in ``new`` one stays."""
    return known.unionByName(new.dropDuplicates([key]).join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def union_shifted(parts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per-clip tables as one session table: ids get their clip before them, frames are shifted by the clip's offset."""
    return parts.join(offsets, "clip_id").withColumn("tracklet_id", F.concat_ws(":", "clip_id", "tracklet_id")).withColumn("frame_index", F.col("frame_index") + F.col("offset")).drop("offset")
