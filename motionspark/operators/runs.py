"""What a run came to, in rows of (camera_id, metric, value), how parameter settings rank, and bounds and clocks of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHOLE = ""  # the camera_id of what holds for the whole run


def metrics(frames: DataFrame, persons: DataFrame, assignments: DataFrame, identities: DataFrame, matches: DataFrame, audit: DataFrame) -> DataFrame:
    """The metrics of a run. Each camera of ``frames`` has every camera metric, 0 where its tables have no row.

    ``frames``: camera_id, tracklet_id, on_mat; ``persons``: camera_id, person_id; ``assignments``: camera_id, tag_id, assignment_confidence; ``identities``:
    global_person_id, camera_id; ``matches``: camera_id; ``audit``: event_type, n (how many things an event tells of). Distinct
    values are found by grouping first, so that no row is copied for each count.
    """
    count = F.count("*").cast("double")

    def distinct(df: DataFrame, what: str, name: str) -> DataFrame:
        return df.filter(F.col(what).isNotNull() & (F.col(what).cast("string") != "")).groupBy("camera_id", what).count().groupBy("camera_id").agg(count.alias(name))

    share = F.coalesce(F.round(100.0 * F.avg(F.col("on_mat").cast("int")), 2), F.lit(0.0))
    per = [
        frames.groupBy("camera_id").agg(share.alias("on_mat_pct")),
        distinct(frames, "tracklet_id", "tracklet_count"),
        distinct(persons, "person_id", "person_id_count"),
        persons.groupBy("camera_id").agg(count.alias("person_track_rows")),
        assignments.groupBy("camera_id").agg(count.alias("identity_assignments"), F.coalesce(F.round(F.avg("assignment_confidence"), 4), F.lit(0.0)).alias("mean_confidence")),
        distinct(assignments, "tag_id", "unique_tags"),
        matches.groupBy("camera_id").agg(count.alias("matches")),
    ]
    cams = frames.select("camera_id").distinct()
    for part in per:
        cams = cams.join(part, "camera_id", "left")
    names = [c for c in cams.columns if c != "camera_id"]
    camera = cams.select("camera_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names)).unpivot("camera_id", names, "metric", "value")
    seen = identities.filter("global_person_id <> '' AND camera_id <> ''").groupBy("global_person_id", "camera_id").count().groupBy("global_person_id").agg(F.count("*").alias("n"))
    told = lambda event, of: F.sum(F.when(F.col("event_type") == event, of).otherwise(0)).cast("double")
    whole = [
        assignments.agg(count.alias("identity_assignments_total"), F.avg("assignment_confidence").alias("c")).withColumn("mean_confidence_all", F.coalesce(F.round("c", 4), F.lit(0.0))).drop("c"),
        seen.agg(count.alias("global_person_ids"), F.count_if(F.col("n") >= 2).cast("double").alias("linked_ids"), F.count_if(F.col("n") == 1).cast("double").alias("standalone_ids")),
        matches.agg(count.alias("total_matches")),
        audit.agg(told("cp17_pass2_evidence", F.col("n")).alias("tag_corroborated"), told("cp17_coordinate_evidence", F.col("n")).alias("coordinate_corroborated"), told("coordinate_conflict", F.lit(1)).alias("coordinate_conflicts")),
    ]
    for part in whole:
        camera = camera.unionByName(part.select(F.lit(WHOLE).alias("camera_id"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in part.columns)).unpivot("camera_id", part.columns, "metric", "value"))
    return camera


def ranked_sweep(rows: DataFrame, settings: dict[str, Column], label: Column) -> DataFrame:
    """How each setting's predictions meet the labels (tp, fp, fn, precision, recall), and its place by recall, precision and name.

    All settings are counted in one pass with partial sums; a row a setting. A prediction or label that is null is no; shares of nothing are null
    and come last.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    each = []
    for name, predicted in settings.items():
        p, t = yes(predicted), yes(label)
        each.append(F.struct(F.lit(name).alias("setting"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")))
    flat = rows.agg(F.array(*each).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")
    out = flat.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    place = Window.orderBy(F.desc_nulls_last("recall"), F.desc_nulls_last("precision"), "setting")  # a row a setting
    return out.withColumn("place", F.row_number().over(place))


def frame_bounds(spans: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """The first and last frame of a session in its spans (start_frame, end_frame) and tracks (frame_index); both 0 if either end is unknown."""
    a = spans.groupBy(*keys).agg(F.min("start_frame").alias("lo"), F.max("end_frame").alias("hi"))
    b = tracks.groupBy(*keys).agg(F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"))
    both = a.unionByName(b).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return both.select(*keys, F.when(known, F.col("lo")).otherwise(0).alias("first_frame"), F.when(known, F.col("hi")).otherwise(0).alias("last_frame"))


def frame_clock(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """The time of each frame: the least one told."""
    return tracks.dropna(subset=["frame_index", "timestamp_ms"]).groupBy(*keys, "frame_index").agg(F.min("timestamp_ms").alias("timestamp_ms"))


def clip_offset(clip_start: Column, session_start: Column, fps: float) -> Column:
    """How many frames a clip starts after its session (times in milliseconds), to the nearest even one in doubt; 0 if it is unknown or before it."""
    late = (clip_start - session_start) / 1000.0
    return F.when((late >= 0) & (F.lit(float(fps)) > 0), F.bround(late * fps).cast("long")).otherwise(F.lit(0).cast("long"))


def velocity(rows: DataFrame, key: str, at_ms: str) -> DataFrame:
    """Adds vx, vy and speed (a second) from the row before it in time; null at a first row, without time between, or without places."""
    w = Window.partitionBy(key).orderBy(at_ms)
    dt = (F.col(at_ms) - F.lag(at_ms).over(w)) / 1000.0
    step = lambda c: F.when(F.col("_dt") > 0, (F.col(c) - F.col(f"_{c}")) / F.col("_dt"))
    out = rows.withColumns({"_dt": dt, "_x_m": F.lag("x_m").over(w), "_y_m": F.lag("y_m").over(w)}).withColumns({"vx": step("x_m"), "vy": step("y_m")})
    return out.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).drop("_dt", "_x_m", "_y_m")
