"""A table of rows by key that is changed in place: merges rewrite only the buckets they touch.

Rows lie in buckets by a hash of their key. A merge reads the buckets that its changes fall into, writes their new rows
beside the old ones, and then puts down one commit file that names the live folder of every bucket. Readers take the last
commit, so a merge that fails half-way, or loses executors, changes nothing; one that is run again under its id, after it was
committed, changes nothing either. One merge runs at a time: a second one that finds its version taken raises.

Defined cases: of several changes of one key the last by ``order`` counts (of equal ones the greatest of their values' hashes);
changes with a null key part are left out; columns that the changes lack keep their values, and take their defaults (else
null) in new rows; a merge without changes commits nothing; a bucket may hold no rows.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """The table at ``path``, a URI of a shared folder, with its ``key`` columns."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.store, self.inner = fs.FileSystem.from_uri(self.path)

    def _commits(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.inner}/commits", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def _last(self) -> dict:
        names = self._commits()
        if not names:
            raise FileNotFoundError(f"{self.path} holds no commit")
        with self.store.open_input_file(f"{self.inner}/commits/{names[-1]}") as f:
            return json.loads(f.read())

    def _commit(self, state: dict) -> None:
        self.store.create_dir(f"{self.inner}/commits", recursive=True)
        if any(n.startswith(f"{state['version']:010d}-") for n in self._commits()):
            raise RuntimeError(f"version {state['version']} of {self.path} is taken by another merge")
        name = f"{self.inner}/commits/{state['version']:010d}-{state['merge_id']}.json"
        with self.store.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(state).encode())
        self.store.move(f"{name}.part", name)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows by bucket into a new folder; the folder of each bucket that has any."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        found = self.store.get_file_info(fs.FileSelector(f"{self.inner}/{folder}"))
        return {f.base_name.removeprefix("_bucket="): f"{folder}/{f.base_name}" for f in found if f.base_name.startswith("_bucket=")}

    def _read(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in folders))

    def create(self, rows: DataFrame, buckets: int = 64) -> None:
        """The first version: ``rows``, whose keys are distinct."""
        if self._commits():
            raise FileExistsError(f"{self.path} holds a table")
        live = self._write(rows, buckets)
        self._commit({"version": 0, "merge_id": "create", "buckets": buckets, "schema": rows.schema.jsonValue(), "live": live})

    def read(self) -> DataFrame:
        state = self._last()
        return self._read(T.StructType.fromJson(state["schema"]), sorted(state["live"].values()))

    def version(self) -> int:
        return self._last()["version"]

    def merge(self, changes: DataFrame, merge_id: str, order: str | None = None, insert: bool = True, update: bool = True, defaults: dict[str, Column] | None = None, triggers: dict[str, Column] | None = None) -> int:
        """Put ``changes`` (the key and any of the other columns) into the table; returns the version it then has.

        ``insert``: rows of new keys; ``update``: those of known ones. ``triggers``: what columns become in rows that are new or
        differ from before, as expressions over ``old.*`` (null in new rows), ``new.*`` and ``is_new``.
        """
        state = self._last()
        if any(n[11:] == f"{merge_id}.json" for n in self._commits()):
            return state["version"]
        schema, buckets = T.StructType.fromJson(state["schema"]), state["buckets"]
        names = [c for c in schema.names if c in changes.columns]
        if strange := [c for c in changes.columns if c not in schema.names and c != order]:
            raise ValueError(f"columns that the table has not got: {strange}")
        typed = changes.dropna(subset=self.key).select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in names], (F.col(order) if order else F.lit(0)).alias("_order"))
        last = typed.groupBy(*self.key).agg(F.max_by(F.struct(*names), F.struct("_order", F.xxhash64(*names))).alias("change"))
        last = last.withColumn("_bucket", self._bucket(buckets))
        touched = {str(r[0]) for r in last.select("_bucket").distinct().collect()}  # as many as there are buckets, at most
        if not touched:
            return state["version"]
        before = self._read(schema, sorted(f for b, f in state["live"].items() if b in touched))
        both = before.select(*self.key, F.struct(*schema.names).alias("old")).join(last.select(*self.key, "change"), self.key, "full")
        both = both.withColumn("is_new", F.col("old").isNull()).filter("NOT is_new" if not insert else "true")
        use = F.col("change").isNotNull() & (F.col("is_new") | F.lit(update))
        given = lambda c: F.col(f"change.{c}") if c in names else F.when(F.col("is_new"), (defaults or {}).get(c, F.lit(None)).cast(schema[c].dataType)).otherwise(F.col(f"old.{c}"))
        both = both.withColumn("new", F.when(use, F.struct(*[given(c).alias(c) for c in schema.names])).otherwise(F.col("old")))
        changed = F.col("is_new") | ~F.col("new").eqNullSafe(F.col("old"))
        fired = lambda c: F.when(changed, triggers[c].cast(schema[c].dataType)).otherwise(F.col(f"new.{c}")) if triggers and c in triggers else F.col(f"new.{c}")
        live = {b: f for b, f in state["live"].items() if b not in touched} | self._write(both.select(*[fired(c).alias(c) for c in schema.names]), buckets)
        self._commit({**state, "version": state["version"] + 1, "merge_id": merge_id, "live": live})
        return state["version"] + 1

    def update_from(self, other: DataFrame, on: dict[str, str], values: dict[str, str], merge_id: str, **more) -> int:
        """Set ``values`` (column: the other's column) where the table's columns equal the other's (``on``); rows without a partner stay.

        Of several partners the one of the greatest values counts.
        """
        right = other.groupBy(*[F.col(o).alias(f"_on_{c}") for c, o in on.items()]).agg(F.max(F.struct(*[F.col(v).alias(c) for c, v in values.items()])).alias("_v"))
        here = self.read().select(*dict.fromkeys([*self.key, *on]))
        joined = here.join(right, [F.col(c) == F.col(f"_on_{c}") for c in on]).select(*self.key, *[F.col(f"_v.{c}").alias(c) for c in values])
        return self.merge(joined, merge_id, insert=False, **more)

    def vacuum(self) -> int:
        """Delete the folders that the last commit does not name; how many there were. Nobody may read older versions any more."""
        used = {f.split("/")[1] for f in self._last()["live"].values()}
        found = [f for f in self.store.get_file_info(fs.FileSelector(f"{self.inner}/data", allow_not_found=True)) if f.base_name not in used]
        for f in found:
            self.store.delete_dir(f.path)
        return len(found)
