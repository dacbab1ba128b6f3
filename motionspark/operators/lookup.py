"""Lookups and updates over clips, videos, check-ins and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import sphere_km


def claimable(clips: DataFrame, videos: DataFrame, tag: int, gym: int, now: Column, hours: int = 24) -> DataFrame:
    """Recent clips of a gym in which a tag's side is not yet resolved. The side is 'a' wherever the a-tag matches."""
    recent = F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS")
    open_ = ((F.col("a_tag") == tag) & F.col("a_profile").isNull()) | ((F.col("b_tag") == tag) & F.col("b_profile").isNull())
    return clips.filter(recent & open_).join(videos.filter(F.col("gym_id") == gym).select("video_id", "gym_id"), "video_id").select("clip_id", "video_id", F.when(F.col("a_tag") == tag, "a").otherwise("b").alias("side"), "created_at")


def claim(clips: DataFrame, clip_id: str, side: str, profile: int) -> DataFrame:
    """Set a side's profile if it has none, and then the status, where there is one; another side than a or b raises."""
    if side not in ("a", "b"):
        raise ValueError(f"side must be a or b, not {side}")
    mine = (F.col("clip_id") == clip_id) & F.col(f"{side}_profile").isNull()
    if "status" in clips.columns:
        clips = clips.withColumn("status", F.when(mine, F.lit("uploaded")).otherwise(F.col("status")))
    return clips.withColumn(f"{side}_profile", F.when(mine, F.lit(profile)).otherwise(F.col(f"{side}_profile")))


def my_clips(clips: DataFrame, profile: int) -> DataFrame:
    return clips.filter((F.col("a_profile") == profile) | (F.col("b_profile") == profile)).orderBy(F.desc("created_at"), "clip_id")


def near(places: DataFrame, lat: float, lng: float, radius_km: float = 50) -> DataFrame:
    """Places nearer than the radius, nearest first; places without coordinates are left out."""
    found = places.dropna(subset=["lat", "lng"]).withColumn("distance_km", sphere_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
    return found.filter(F.col("distance_km") < radius_km).orderBy("distance_km", "gym_id")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Upserts: the last write of each key wins; ``by`` ends in something that makes it total."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in by))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def active(checkins: DataFrame, now: Column, hours: int = 3) -> DataFrame:
    """Check-ins that have not run out; each write renews them."""
    return checkins.filter(F.col("checked_in_at") + F.expr(f"INTERVAL {hours} HOURS") > now)


def resolve(clips: DataFrame, checkins: DataFrame) -> DataFrame:
    """Profiles of both sides of a clip from active check-ins of its gym.

    A collision, the same tag on both sides or several check-ins for a tag, leaves both empty and is flagged.
    """
    per = checkins.groupBy("gym_id", "tag_id").agg(F.count("*").alias("n"), F.min("profile_id").alias("profile"))
    side = lambda s: per.select("gym_id", F.col("tag_id").alias(f"{s}_tag"), F.col("n").alias(f"n_{s}"), F.col("profile").alias(f"{s}_found"))
    both = clips.join(side("a"), ["gym_id", "a_tag"], "left").join(side("b"), ["gym_id", "b_tag"], "left")
    clash = (F.col("a_tag") == F.col("b_tag")) | (F.coalesce("n_a", F.lit(0)) > 1) | (F.coalesce("n_b", F.lit(0)) > 1)
    return both.select("clip_id", F.when(~clash, F.col("a_found")).alias("a_profile"), F.when(~clash, F.col("b_found")).alias("b_profile"), F.when(clash, "collision_flagged").otherwise("created").alias("status"))


def visible(rows: DataFrame, *policies: Column) -> DataFrame:
    """Rows that some policy permits."""
    out = F.lit(False)
    for p in policies:
        out = out | F.coalesce(p, F.lit(False))
    return rows.filter(out)


def cycling(rows: DataFrame, order: list[str], size: int = 587, start: int = 0) -> DataFrame:
    """Numbers 0 .. size - 1 in turn. Rows are numbered within ordered ranges and the ranges' counts added up, so no task sorts them all."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from ..sources.io import cut

    ranged = cut(ranged)
    w = Window.partitionBy("_p").orderBy("_i")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_o", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row a range
    return ranged.withColumn("_n", F.row_number().over(w)).join(before.select("_p", F.coalesce("_o", F.lit(0)).alias("_o")), "_p").withColumn("tag_id", F.pmod(F.col("_n") + F.col("_o") - 1 + start, F.lit(size))).drop("_p", "_i", "_n", "_o")


def session_of(clips: DataFrame, schedule: DataFrame, zone: str, before_minutes: int = 30) -> DataFrame:
    """The first schedule entry whose weekday window, from some minutes before it on, holds a clip's local time.

    ``schedule``: entry, weekday (Mon .. Sun), start_min and end_min of the day; a window that ends before it
    starts runs past midnight.
    """
    local = F.from_utc_timestamp(F.col("at").cast("timestamp"), zone)
    minute = F.hour("_local") * 60 + F.minute("_local")
    timed = clips.withColumn("_local", local).withColumn("_minute", minute).withColumn("_day", F.date_format("_local", "E")).withColumn("_before", F.date_format(F.date_sub("_local", 1), "E")).withColumn("_after", F.date_format(F.date_add("_local", 1), "E"))
    start, end = F.col("start_min") - before_minutes, F.col("end_min") + F.when(F.col("end_min") < F.col("start_min"), 1440).otherwise(0)
    hits = [(F.col("_day"), 0), (F.col("_before"), 1440), (F.col("_after"), -1440)]
    each = timed.select("*", F.explode(F.array(*(F.struct(d.alias("weekday"), (F.col("_minute") + m).alias("m")) for d, m in hits))).alias("_h")).select("*", "_h.weekday", "_h.m")
    found = each.join(schedule, "weekday").filter((F.col("m") >= start) & (F.col("m") <= end))
    return found.groupBy(*clips.columns).agg(F.min("entry").alias("entry"))


def session_windows(clips: DataFrame, schedule: DataFrame, before_minutes: int = 30) -> DataFrame:
    """The session each clip belongs to: the first entry of its place's schedule for the clip's weekday there, whose window, from some
    minutes before it on, holds the clip's time on the wall there. Clips outside every window have no row.

    ``clips``: gym_id, at (UTC, without zone); ``schedule``: gym_id, zone, entry, weekday (Mon .. Sun), start_min, end_min of the day; an end not after
    the start is on the next day, and a clip after midnight belongs to the windows of its own day only. Adds session_date, session_id
    and session_end (UTC, by the zone's rules on that day). Clips meet entries by place and weekday.
    """
    zones = schedule.groupBy("gym_id").agg(F.min("zone").alias("zone"))
    copies = clips.groupBy(*clips.columns).agg(F.count("*").alias("_n"))  # repeated clips are as many again
    local = copies.select(F.struct(*clips.columns).alias("_row"), "_n", "gym_id", "at").join(zones, "gym_id").withColumn("_local", F.expr("convert_timezone('UTC', zone, at)")).withColumn("weekday", F.date_format("_local", "E"))
    entries = schedule.select("gym_id", "weekday", "entry", "start_min", F.when(F.col("end_min") <= F.col("start_min"), F.col("end_min") + 1440).otherwise(F.col("end_min")).alias("end_min"))
    # of entries with one window only the first can win, so a clip meets each window once, however many entries a place has
    entries = entries.groupBy("gym_id", "weekday", "start_min", "end_min").agg(F.min("entry").alias("entry"))
    day = "date_trunc('DAY', _local)"
    at = lambda minutes: F.expr(f"CAST(timestampadd(MINUTE, {minutes}, {day}) AS TIMESTAMP_NTZ)")
    met = local.join(entries, ["gym_id", "weekday"]).filter((F.col("_local") >= at(f"start_min - {before_minutes}")) & (F.col("_local") <= at("end_min")))
    end = F.expr(f"convert_timezone(zone, 'UTC', CAST(timestampadd(MINUTE, end_min, {day}) AS TIMESTAMP_NTZ))")
    name = F.concat(F.date_format("_local", "yyyy-MM-dd"), F.lit("T"), F.lpad(F.floor(F.col("start_min") / 60).cast("string"), 2, "0"), F.lpad((F.col("start_min") % 60).cast("string"), 2, "0"))
    hit = F.struct("entry", F.date_format("_local", "yyyy-MM-dd").alias("session_date"), name.alias("session_id"), end.alias("session_end"))
    first = met.withColumn("_hit", hit).groupBy("_row", "_n").agg(F.min("_hit").alias("_hit"))
    return first.select(F.explode(F.array_repeat(F.col("_row"), F.col("_n").cast("int"))).alias("_row"), "_hit").select("_row.*", "_hit.*")


def registered_videos(known: DataFrame, paths: DataFrame) -> DataFrame:
    """Videos after an upload: every known one, and one made for each path that none has (its id from the path), with the gym
    that the last upload of its path names; an upload without a gym changes none.

    ``known``: video_id (text), path, gym_id; ``paths``: path, gym_id, position (total). Of several known videos of a path only the
    least id is found and given a gym. Adds created.
    """
    said = paths.dropna(subset=["path"]).groupBy("path").agg(F.max_by("gym_id", F.when(F.col("gym_id").isNotNull(), F.col("position"))).alias("_said"))
    found = known.groupBy("path").agg(F.min("video_id").alias("_found"))
    old = known.join(found, "path", "left").join(said, "path", "left")
    kept = old.select("video_id", "path", F.when(F.col("video_id") == F.col("_found"), F.coalesce("_said", "gym_id")).otherwise(F.col("gym_id")).alias("gym_id"), F.lit(False).alias("created"))
    new = said.join(found, "path", "left_anti").select(F.substring(F.sha2("path", 256), 1, 16).alias("video_id"), "path", F.col("_said").alias("gym_id"), F.lit(True).alias("created"))
    return kept.unionByName(new)


def push_tokens(told: DataFrame, tokens: DataFrame) -> DataFrame:
    """The devices (clip_id, token) of those who are told of a clip (:func:`audience`), each once; who has none is left out."""
    return told.join(tokens.dropna(subset=["token"]).select("profile_id", "token"), "profile_id").select("clip_id", "token").distinct()


def network_place(requests: DataFrame, networks: DataFrame) -> DataFrame:
    """For each request (ssid, bssid) the place with that very station, else the least place of the network; null if there is none.

    Both answers are looked up by key, so the places of a common network name never meet all its requests.
    """
    station = networks.dropna(subset=["bssid"]).groupBy("ssid", "bssid").agg(F.min("gym_id").alias("_station"))
    named = networks.groupBy("ssid").agg(F.min("gym_id").alias("_named"))
    return requests.join(station, ["ssid", "bssid"], "left").join(named, "ssid", "left").withColumn("gym_id", F.coalesce("_station", "_named")).drop("_station", "_named")


def source_ids(clips: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The ids of a clip's source paths, in their order: known ones by lookup, new ones made from the path.

    ``clips``: key, position, path; ``known``: path, video_id (text). A clip's list is as long as its sources.
    """
    one = known.groupBy("path").agg(F.min("video_id").alias("video_id"))
    made = F.substring(F.sha2("path", 256), 1, 16)
    found = clips.join(one, "path", "left").withColumn("created", F.col("video_id").isNull()).withColumn("video_id", F.coalesce("video_id", made))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "video_id"))), lambda x: x["video_id"])
    return found.groupBy(key).agg(ids.alias("ids"), F.count_if("created").alias("n_created"))


def audience(clips: DataFrame, checkins: DataFrame) -> DataFrame:
    """Whom to tell of a clip, each profile once: of a flagged one those checked in at its gym under either tag, else its resolved sides."""
    wanted, people, sides = _audience(clips, checkins)
    # who is checked in once can be told of a clip once only; the others' rows alone are looked through for repeats
    keys = people.groupBy("profile_id").agg((F.count("*") > 1).alias("_again"))
    marked = people.join(keys, "profile_id")
    there = lambda df: wanted.join(df, ["gym_id", "tag_id"]).select("clip_id", "profile_id")
    return there(marked.filter("NOT _again")).unionByName(there(marked.filter("_again")).distinct()).unionByName(sides)


def _audience(clips: DataFrame, checkins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clip_id, gym_id, tag_id) of flagged clips, (gym_id, tag_id, profile_id) checked in, and (clip_id, profile_id) of the others' sides."""
    flagged = F.col("status") == "collision_flagged"
    tags = F.explode(F.array_distinct(F.array_compact(F.array("a_tag", "b_tag"))))
    wanted = clips.filter(flagged).select("clip_id", "gym_id", tags.alias("tag_id")).distinct()
    sides = F.explode(F.array_distinct(F.array_compact(F.array("a_profile", "b_profile"))))
    people = checkins.dropna(subset=["gym_id", "tag_id"]).select("gym_id", "tag_id", "profile_id").distinct()
    return wanted, people, clips.filter(~F.coalesce(flagged, F.lit(False))).select("clip_id", sides.alias("profile_id")).distinct()


def audience_tokens(clips: DataFrame, checkins: DataFrame, tokens: DataFrame) -> DataFrame:
    """:func:`push_tokens` of :func:`audience`: a clip's devices meet as the lists of its places' tags and sides, not as a row each.

    A list is as long as one tag has devices at one place.
    """
    wanted, people, sides = _audience(clips, checkins)
    own = tokens.dropna(subset=["token"]).select("profile_id", "token")
    of = lambda df, *keys: df.groupBy(*keys).agg(F.collect_set("token").alias("_tokens"))
    there = wanted.join(of(people.join(own, "profile_id"), "gym_id", "tag_id"), ["gym_id", "tag_id"]).select("clip_id", "_tokens")
    both = there.unionByName(sides.join(of(own, "profile_id"), "profile_id").select("clip_id", "_tokens"))
    return both.groupBy("clip_id").agg(F.array_distinct(F.flatten(F.collect_list("_tokens"))).alias("_tokens")).select("clip_id", F.explode("_tokens").alias("token"))


def next_open(clips: DataFrame, done: DataFrame, key: str, camera: str, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` clips of each camera that are not done."""
    w = Window.partitionBy(camera).orderBy(*order)
    return clips.join(done.select(key).distinct(), key, "left_anti").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def readiness(events: DataFrame, buffer_ms: int) -> DataFrame:
    """When each session may go on, in the rule of :class:`motionspark.streaming.ordered.Readiness`, over all its events.

    ``events``: session_id, cam_id, clip_id, at, done, tag_bytes, end_ms (one for a session). A session is decided at its end
    and a buffer if some camera has done all clips seen by then, else once one has; a session without such a moment gives no row.
    """
    known = events.dropna(subset=["session_id", "at"])
    bells = known.groupBy("session_id").agg((F.max("end_ms") + buffer_ms).alias("bell"))
    clip = known.dropna(subset=["cam_id", "clip_id"]).groupBy("session_id", "cam_id", "clip_id").agg(F.min("at").alias("seen"), F.min(F.when(F.col("done"), F.col("at"))).alias("finished"))
    change = clip.select("session_id", "cam_id", F.explode(F.array(F.struct(F.col("seen").alias("at"), F.lit(1).alias("d")), F.struct(F.col("finished").alias("at"), F.lit(-1).alias("d")))).alias("c"))
    change = change.filter("c.at IS NOT NULL").groupBy("session_id", "cam_id", F.col("c.at").alias("at")).agg(F.sum("c.d").alias("d"))
    w = Window.partitionBy("session_id", "cam_id").orderBy("at")
    state = change.select("session_id", "cam_id", "at", (F.sum("d").over(w) == 0).alias("whole"), F.lead("at").over(w).alias("until")).join(bells, "session_id")
    decided = state.filter("bell IS NOT NULL AND whole AND (until IS NULL OR until > bell)").groupBy("session_id").agg(F.min(F.greatest("at", "bell")).alias("decided_at"))
    then = state.join(decided, "session_id").filter("at <= decided_at AND (until IS NULL OR until > decided_at)").groupBy("session_id", "decided_at")
    names = lambda whole: F.array_join(F.array_sort(F.collect_list(F.when(F.col("whole") == whole, F.col("cam_id")))), ",")
    cameras = then.agg(names(True).alias("cameras_done"), names(False).alias("cameras_timed_out"))  # as many as a session has cameras
    first_tag = known.filter("tag_bytes > 0").groupBy("session_id").agg(F.min("at").alias("first_tag"))
    decision = F.when(F.col("first_tag") <= F.col("decided_at"), "ready").otherwise("tag_required")
    return cameras.join(first_tag, "session_id", "left").select("session_id", "decided_at", decision.alias("decision"), "cameras_done", "cameras_timed_out")
