"""Queries over sessions of clips: a day's events of some users, three cameras, a clip a user."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup
from ..sources.io import shared_dir
from ..sources.keyed_table import KeyedTable
from ..sources.views import table
from .registry import query

BUFFER_MS = 600_000
_EVENTS = """ev AS (
  SELECT strftime(ts, '%Y-%m-%d') || '-' || (user_id % 20) AS session_id, 'c' || (user_id % 3) AS cam_id, 'u' || user_id AS clip_id, epoch_us(ts) // 1000 AS at_,
         event_type = 'purchase' AS done, CASE WHEN event_type = 'error' THEN floor(value)::BIGINT ELSE 0 END AS tag_bytes, epoch_ms(date_trunc('day', ts)) + 43200000 AS end_ms
  FROM events)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")
    ts = "CAST(ts AS TIMESTAMP_NTZ)"
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.date_format(F.expr(ts), "yyyy-MM-dd"), (F.col("user_id") % 20).cast("string")).alias("session_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cam_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("clip_id"),
        ms(ts).alias("at"),
        (F.col("event_type") == "purchase").alias("done"),
        F.when(F.col("event_type") == "error", F.floor("value").cast("long")).otherwise(0).alias("tag_bytes"),
        (ms(f"date_trunc('DAY', {ts})") + 43_200_000).alias("end_ms"),
    )


@query(f"""WITH {_EVENTS}, bells AS (SELECT session_id, max(end_ms) + {BUFFER_MS} AS bell FROM ev GROUP BY 1),
clip AS (SELECT session_id, cam_id, clip_id, min(at_) AS seen, min(at_) FILTER (done) AS finished FROM ev GROUP BY 1, 2, 3),
change AS (SELECT session_id, cam_id, at_, sum(d) AS d FROM (SELECT session_id, cam_id, seen AS at_, 1 AS d FROM clip UNION ALL SELECT session_id, cam_id, finished, -1 FROM clip WHERE finished IS NOT NULL) GROUP BY 1, 2, 3),
state AS (SELECT session_id, cam_id, at_, sum(d) OVER w = 0 AS whole, lead(at_) OVER w AS until_, bell FROM change JOIN bells USING (session_id) WINDOW w AS (PARTITION BY session_id, cam_id ORDER BY at_)),
decided AS (SELECT session_id, min(greatest(at_, bell)) AS decided_at FROM state WHERE whole AND (until_ IS NULL OR until_ > bell) GROUP BY 1)
SELECT session_id, decided_at, CASE WHEN (SELECT min(at_) FROM ev WHERE tag_bytes > 0 AND ev.session_id = s.session_id) <= decided_at THEN 'ready' ELSE 'tag_required' END AS decision,
       coalesce(string_agg(cam_id, ',' ORDER BY cam_id) FILTER (whole), '') AS cameras_done, coalesce(string_agg(cam_id, ',' ORDER BY cam_id) FILTER (NOT whole), '') AS cameras_timed_out
FROM state s JOIN decided USING (session_id) WHERE at_ <= decided_at AND (until_ IS NULL OR until_ > decided_at) GROUP BY session_id, decided_at""")
def session_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each session of the day may go on, and which cameras it waited for in vain."""
    return lookup.readiness(session_events(spark, sf_dir), BUFFER_MS)


@query("""WITH o AS (SELECT o_orderkey AS video_id, 'path/' || o_orderkey AS source_path, o_custkey % 25 AS gym_id, 'ready' AS status, 0 AS version FROM orders WHERE o_orderkey % 3 > 0),
l AS (SELECT l_orderkey AS video_id, CASE WHEN max(l_returnflag) = 'R' THEN 'expired' ELSE 'ready' END AS status FROM lineitem GROUP BY 1),
m AS (SELECT video_id, coalesce(source_path, 'made/' || video_id) AS source_path, gym_id, l.status AS s_new, o.status AS s_old, o.video_id IS NULL AS is_new, l.video_id IS NOT NULL AS hit FROM o FULL JOIN l USING (video_id)),
t AS (SELECT video_id, source_path, gym_id, coalesce(s_new, s_old) AS status, CASE WHEN is_new THEN 1 WHEN hit AND s_new IS DISTINCT FROM s_old THEN 1 ELSE 0 END AS version FROM m)
SELECT video_id, source_path, coalesce(g.place, t.gym_id) AS gym_id, status, version + CASE WHEN g.place IS NOT NULL AND g.place IS DISTINCT FROM t.gym_id THEN 1 ELSE 0 END AS version
FROM t LEFT JOIN (SELECT o_orderkey AS v, 100 + o_custkey % 7 AS place FROM orders WHERE o_orderstatus = 'F') g ON g.v = t.video_id""")
def merged_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of videos (two in three orders), merged with what their lines say, then given their gyms by an update from a join."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    videos = KeyedTable(spark, f"{shared_dir(spark)}/videos-{uuid.uuid4().hex}", ["video_id"])
    videos.create(o.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("video_id"), F.concat(F.lit("path/"), F.col("o_orderkey").cast("string")).alias("source_path"), (F.col("o_custkey") % 25).alias("gym_id"), F.lit("ready").alias("status"), F.lit(0).alias("version")), 16)
    touched = {"version": F.coalesce("old.version", F.lit(0)) + 1}
    said = li.groupBy(F.col("l_orderkey").alias("video_id")).agg(F.when(F.max("l_returnflag") == "R", "expired").otherwise("ready").alias("status"))
    videos.merge(said, "lines", defaults={"source_path": F.concat(F.lit("made/"), F.col("change.video_id").cast("string"))}, triggers=touched)
    places = o.filter("o_orderstatus = 'F'").select("o_orderkey", (100 + F.col("o_custkey") % 7).alias("place"))
    videos.update_from(places, {"video_id": "o_orderkey"}, {"gym_id": "place"}, "gyms", triggers=touched)
    return videos.read()
