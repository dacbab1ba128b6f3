"""Streaming twins of the state machines, and a sink that writes each key once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.machines import CADENCE, Cadence
from ..sources.io import read_or_none

_STATE = "state string, last_try long, last_trigger long, ramp_until long"


def cadence(rows: DataFrame, **params: int) -> DataFrame:
    """The cadence of each tracklet over a stream (tracklet_id, frame_index, trigger, tag_hit).

    A tracklet's frames come in order from one micro-batch to the next; within one they are sorted here. The
    state is four values a tracklet.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Cadence(**params)
        if state.exists:
            machine.unpack(state.get)
        batch = pd.concat(list(parts)).sort_values("frame_index")  # one key's rows of one micro-batch
        out = [(*key, f, *machine.step(f, t is True, s is True)) for f, t, s in zip(batch["frame_index"].tolist(), batch["trigger"].tolist(), batch["tag_hit"].tolist(), strict=True)]
        state.update(machine.packed())
        yield pd.DataFrame(out, columns=["tracklet_id", "frame_index", "due", "state"])

    narrow = rows.select("tracklet_id", "frame_index", "trigger", "tag_hit")
    return narrow.groupBy("tracklet_id").applyInPandasWithState(run, CADENCE, _STATE, "append", GroupStateTimeout.NoTimeout)


def votes(rows: DataFrame, time: str, late: str, window: str) -> DataFrame:
    """Tag votes per tracklet and time window; rows later than ``late`` are dropped, windows are given once closed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "tracklet_id", "tag_id").agg(F.count("*").alias("votes"), F.sum("confidence").alias("weight"), F.max("confidence").alias("max_conf")).select("window.start", "window.end", "tracklet_id", "tag_id", "votes", "weight", "max_conf")


def write_once(rows: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key the table at ``path`` does not hold yet; a micro-batch that is run again adds nothing.

    Each micro-batch has a folder of its own, named by the stream's checkpoint and its number, and overwrites that; of the rest of
    the table it reads the keys. The table has that folder's name as its last column, ``batch``.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def put(batch: DataFrame, batch_id: int) -> None:
        mine, new = f"{stream}-{batch_id}", batch.dropDuplicates([key])
        if (held := read_or_none(batch.sparkSession, path)) is not None and "batch" in held.columns:
            new = new.join(held.filter(F.col("batch") != mine).select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{path}/batch={mine}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
