"""Queries over identities: votes, evidence, lookups, metrics, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_id, tag_key
from ..operators import contracts, identity, joins, lookup, matches, pairs, windows
from ..operators.quantiles import exact_quantiles
from ..sources.views import BANK, CLIPS, FRAMES, HISTS, PLACES, VIDEOS, bank, boxes, clips, frames, histograms, places, table, videos
from .registry import query

_OBS = FRAMES + ", obs AS (SELECT tracklet_id || '-d' || (frame_index // 24) AS tracklet_id, tag_id, confidence, frame_index, camera_id, detection_id FROM frames)"
_VOTES = _OBS + """, votes AS (
  SELECT tracklet_id, tag_id, count(*) AS votes, round(sum(confidence), 6) AS weight, max(confidence) AS max_conf, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
         string_agg(frame_index::VARCHAR, ',' ORDER BY frame_index) AS frames,
         count(*) >= 1 AND round(sum(confidence), 6) >= 0.7 AND max(confidence) >= 0.7 AND (count(*) > 1 OR max(confidence) >= 0.9) AS gated
  FROM obs GROUP BY 1, 2)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag readings of a track's days."""
    f = frames(spark, sf_dir)
    return f.withColumn("tracklet_id", F.concat_ws("-d", "tracklet_id", F.floor(F.col("frame_index") / 24).cast("string"))).select("tracklet_id", "tag_id", "confidence", "frame_index", "camera_id", "detection_id")


@query(f"WITH {_VOTES} SELECT tracklet_id, tag_id, votes, weight, max_conf, first_frame, last_frame, frames FROM votes")
def tag_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.tag_votes(observations(spark, sf_dir)).withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ","))


@query(f"""WITH {_VOTES}, r AS (SELECT *, row_number() OVER w AS n, lead(weight) OVER w AS up FROM votes WINDOW w AS (PARTITION BY tracklet_id ORDER BY weight DESC, max_conf DESC, first_frame, tag_id))
SELECT tracklet_id, tag_id, votes, least(greatest(weight, 0.0), 1.0)::DOUBLE AS confidence, CASE WHEN votes >= 2 THEN 'strong' ELSE 'tentative' END AS strength
FROM r WHERE n = 1 AND gated AND (up IS NULL OR round(weight - up, 6) >= 0.15)""")
def tag_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.tag_winners(identity.tag_votes(observations(spark, sf_dir)))


@query(f"""WITH {_VOTES}, g AS (SELECT * FROM votes WHERE gated)
SELECT a.tag_id, a.tracklet_id, b.tracklet_id AS other_id FROM g a JOIN g b ON a.tag_id = b.tag_id AND a.tracklet_id <> b.tracklet_id AND a.first_frame <= b.last_frame AND b.first_frame <= a.last_frame""")
def tag_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.tag_conflicts(identity.tag_votes(observations(spark, sf_dir)), lambda s: joins.interval_overlaps(s, ["tag_id"], "tracklet_id", 1))


@query(f"""WITH {FRAMES}, h AS (SELECT tracklet_id, tag_id AS constraint_, floor(confidence * 1000)::BIGINT AS pm, 'tag:' || (user_id % 10) AS anchor, detection_id::VARCHAR AS ev FROM frames)
SELECT tracklet_id, count(*) AS n_hints, '[' || string_agg('{{"anchor_key":"' || anchor || '","confidence_pm":' || pm || ',"constraint":"' || constraint_ || '","evidence":"' || ev || '"}}', ',' ORDER BY constraint_, pm DESC, anchor, ev) || ']' AS hints
FROM h GROUP BY tracklet_id""")
def hints_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("tracklet_id", F.col("tag_id").alias("constraint"), F.floor(F.col("confidence") * 1000).cast("long").alias("confidence_pm"), tag_key((F.col("user_id") % 10).cast("string")).alias("anchor_key"), F.col("detection_id").cast("string").alias("evidence"))
    return identity.hints_json(f)


@query(f"""WITH {_VOTES}, p AS (SELECT regexp_extract(tracklet_id, '^[^-]+') AS person_id, tag_id, max_conf AS confidence FROM votes),
r AS (SELECT *, count(*) OVER (PARTITION BY person_id) AS n_assignments, row_number() OVER (PARTITION BY person_id ORDER BY confidence DESC, tag_id) AS n FROM p)
SELECT person_id, tag_id, confidence, n_assignments FROM r WHERE n = 1""")
def enrich_best_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = identity.tag_votes(observations(spark, sf_dir))
    return identity.best_assignment(votes.select(F.substring_index("tracklet_id", "-", 1).alias("person_id"), "tag_id", F.col("max_conf").alias("confidence")))


@query(f"""WITH {FRAMES}, s AS (SELECT user_id % 40 AS person_id, tag_id AS label, count(*) AS score FROM frames GROUP BY 1, 2),
t AS (SELECT person_id, sum(score) AS total FROM s GROUP BY 1),
r AS (SELECT s.*, total, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, label) AS n FROM s JOIN t USING (person_id))
SELECT person_id, label, score, round(score / total, 6) AS confidence, coalesce((SELECT string_agg(o.label, ',' ORDER BY o.label) FROM s o WHERE o.person_id = r.person_id AND o.label <> r.label), '') AS conflicts FROM r WHERE n = 1""")
def dominant_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = frames(spark, sf_dir).groupBy("tracklet_id", (F.col("user_id") % 40).alias("person_id"), F.col("tag_id").alias("label")).agg(F.count("*").alias("n_frames"))
    return identity.dominant_label(parts)


@query(f"""WITH {FRAMES}, p AS (SELECT tag_id, camera_id, count(DISTINCT tracklet_id) AS n FROM frames GROUP BY 1, 2)
SELECT tag_id, count(*) AS n_cameras, sum(n)::BIGINT AS n_persons, string_agg(camera_id || ':' || n, ',' ORDER BY camera_id || ':' || n) AS per_camera, count(*) >= 2 AS corroborated FROM p GROUP BY tag_id""")
def tag_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.tag_evidence(frames(spark, sf_dir))


@query(f"""WITH {FRAMES}, p AS (SELECT tag_id, tracklet_id, frame_index, max(confidence) AS confidence, count(*) AS n_raw FROM frames GROUP BY 1, 2, 3)
SELECT tag_id, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT tracklet_id AS t FROM p q WHERE q.tag_id = p.tag_id)) AS members, count(*) AS n_pings, sum(n_raw)::BIGINT AS n_raw, count(*) FILTER (confidence IS NULL) AS n_missing FROM p GROUP BY tag_id""")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.constraints(frames(spark, sf_dir))


@query(f"""WITH {BANK}, pairs AS (
  SELECT a.frame_index, a.tracklet_id AS person_a, b.tracklet_id AS person_b, sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS dist_m,
         min(a.frame_index) OVER (PARTITION BY a.tracklet_id, b.tracklet_id) AS first_
  FROM bank a JOIN bank b ON a.frame_index = b.frame_index AND a.tracklet_id < b.tracklet_id AND a.camera_id <> b.camera_id),
w AS (SELECT *, unnest(range(greatest(0, floor((frame_index - first_ - 48) / 24)::BIGINT + 1), floor((frame_index - first_) / 24)::BIGINT + 1)) AS win FROM pairs),
m AS (SELECT person_a, person_b, win, median(dist_m) AS med FROM w GROUP BY 1, 2, 3)
SELECT person_a, person_b, count(*) AS n_windows, round_even(avg((med <= 120)::INT), 4) AS ratio, round_even(avg(med), 4) AS mean_median FROM m GROUP BY 1, 2""")
def coordinate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.window_agreement(bank(spark, sf_dir), 48, 120.0, "camera_id")


_MEAN = HISTS + """, flat AS (SELECT camera, person_id, unnest(hist) AS v, unnest(range(len(hist))) AS bin FROM hists),
means AS (SELECT camera, person_id, bin, sum(v) / sum(sum(v)) OVER (PARTITION BY camera, person_id) AS v FROM flat GROUP BY 1, 2, 3)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.mean_histogram(histograms(spark, sf_dir), ["camera", "person_id"], F.lit(1.0))


@query(f"WITH {_MEAN} SELECT camera, person_id, bin, round(v, 9) AS v FROM means")
def hist_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("camera", "person_id", F.posexplode("hist").alias("bin", "v")).withColumn("bin", F.col("bin").cast("long")).withColumn("v", F.round("v", 9))


@query(f"""WITH {_MEAN} SELECT a.person_id AS person_a, b.person_id AS person_b, round(sqrt(greatest(0.0, 1 - sum(sqrt(a.v * b.v)) / sqrt(sum(a.v) * sum(b.v)))), 6) AS dist
FROM means a JOIN means b ON a.bin = b.bin AND a.camera = 0 AND b.camera = 1 GROUP BY 1, 2""")
def hist_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the (few) persons of two cameras, as the evidence is defined over their product."""
    m = _means(spark, sf_dir)
    a, b = m.filter("camera = 0").select(F.col("person_id").alias("person_a"), F.col("hist").alias("ha")), m.filter("camera = 1").select(F.col("person_id").alias("person_b"), F.col("hist").alias("hb"))
    return a.join(b, on=F.lit(True)).select("person_a", "person_b", F.round(identity.histogram_distance(F.col("ha"), F.col("hb")), 6).alias("dist"))


@query("SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.foreign_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")), table(spark, sf_dir, "events"), ["user_id"])


@query(f"""WITH {FRAMES} SELECT 'confidence_range' AS rule, detection_id::VARCHAR AS key FROM frames WHERE NOT coalesce(confidence BETWEEN 0.05 AND 1, true)
UNION ALL SELECT 'in_frame', detection_id::VARCHAR FROM frames WHERE NOT (x_m + 10 <= 480)
UNION ALL SELECT 'y_low', detection_id::VARCHAR FROM frames WHERE NOT (y_m >= 2)""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(frames(spark, sf_dir))
    rules = contracts.box_rules() | {"confidence_range": F.col("confidence").isNull() | F.col("confidence").between(0.05, 1), "in_frame": F.col("x2") <= 480, "y_low": F.col("y1") >= 2}
    return contracts.violations(b, F.col("detection_id"), **rules)


_NOW = "1995-06-17 00:00:00"


@query(f"""WITH {CLIPS}, {VIDEOS} SELECT clip_id, video_id, CASE WHEN a_tag = 100 THEN 'a' ELSE 'b' END AS side, created_at::TIMESTAMP AS created_at FROM clips JOIN videos USING (video_id)
WHERE gym_id = 3 AND ((a_tag = 100 AND a_profile IS NULL) OR (b_tag = 100 AND b_profile IS NULL)) AND created_at > TIMESTAMP '{_NOW}' - INTERVAL 40000 HOUR""")
def claimable_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.claimable(clips(spark, sf_dir), videos(spark, sf_dir), 100, 3, F.expr(f"TIMESTAMP_NTZ '{_NOW}'"), hours=40000)


@query(f"WITH {CLIPS} SELECT clip_id, video_id, created_at::TIMESTAMP AS created_at FROM clips WHERE a_profile = 7 OR b_profile = 7")
def my_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.my_clips(clips(spark, sf_dir), 7).select("clip_id", "video_id", "created_at")


@query(f"""WITH {PLACES}, d AS (SELECT *, acos(least(1.0, greatest(-1.0, cos(radians(10.0)) * cos(radians(lat)) * cos(radians(lng) - radians(20.0)) + sin(radians(10.0)) * sin(radians(lat))))) * 6371.0 AS km FROM places)
SELECT gym_id, lat, lng, round(km, 3) AS distance_km FROM d WHERE km < 5000""")
def gyms_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.near(places(spark, sf_dir), 10.0, 20.0, 5000).select("gym_id", "lat", "lng", F.round("distance_km", 3).alias("distance_km"))


@query(f"""WITH {CLIPS}, {VIDEOS}, c AS (SELECT clip_id, gym_id, a_tag, b_tag FROM clips JOIN videos USING (video_id)),
k AS (SELECT c_custkey % 25 AS gym_id, c_custkey % 587 AS tag_id, count(*) AS n, min(c_custkey) AS profile FROM customer GROUP BY 1, 2),
j AS (SELECT c.*, a.n AS na, b.n AS nb, a.profile AS pa, b.profile AS pb, a_tag = b_tag OR coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 AS clash
  FROM c LEFT JOIN k a ON c.gym_id = a.gym_id AND c.a_tag = a.tag_id LEFT JOIN k b ON c.gym_id = b.gym_id AND c.b_tag = b.tag_id)
SELECT clip_id, CASE WHEN NOT clash THEN pa END AS a_profile, CASE WHEN NOT clash THEN pb END AS b_profile, CASE WHEN clash THEN 'collision_flagged' ELSE 'created' END AS status FROM j""")
def resolve_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).select("clip_id", "video_id", "a_tag", "b_tag").join(videos(spark, sf_dir).select("video_id", "gym_id"), "video_id")
    checkins = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).alias("gym_id"), (F.col("c_custkey") % 587).alias("tag_id"), F.col("c_custkey").alias("profile_id"))
    return lookup.resolve(c, checkins)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


_SCHEDULE = [(1, "Mon", 360, 480), (2, "Wed", 1080, 1200), (3, "Fri", 1380, 60), (4, "Sat", 600, 720), (5, "Wed", 1140, 1260)]


@query(f"""WITH s AS (SELECT * FROM (VALUES {", ".join(map(str, _SCHEDULE))}) t(entry, weekday, start_min, end_min)),
c AS (SELECT event_id, ts, hour(ts) * 60 + minute(ts) AS m FROM events),
h AS (SELECT event_id, strftime(ts, '%a') AS weekday, m FROM c UNION ALL SELECT event_id, strftime(ts - INTERVAL 1 DAY, '%a'), m + 1440 FROM c UNION ALL SELECT event_id, strftime(ts + INTERVAL 1 DAY, '%a'), m - 1440 FROM c)
SELECT event_id, min(entry) AS entry FROM h JOIN s USING (weekday) WHERE m >= start_min - 30 AND m <= end_min + CASE WHEN end_min < start_min THEN 1440 ELSE 0 END GROUP BY event_id""")
def session_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule = spark.createDataFrame(_SCHEDULE, "entry int, weekday string, start_min int, end_min int")
    zone = "UTC"
    return lookup.session_of(table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at")), schedule, zone).select("event_id", "entry")


_METRICS = """SELECT '{run}' AS run, camera_id, count(*)::DOUBLE AS n_rows, count(DISTINCT tracklet_id)::DOUBLE AS n_persons, round(100.0 * avg((x_m BETWEEN 50 AND 250)::INT), 6) AS on_mat_pct, round(avg(confidence), 6) AS mean_confidence FROM {rows} GROUP BY camera_id"""


def _metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("camera_id").agg(F.count("*").cast("double").alias("n_rows"), F.countDistinct("tracklet_id").cast("double").alias("n_persons"), F.round(100.0 * F.avg(F.col("x_m").between(50, 250).cast("int")), 6).alias("on_mat_pct"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"WITH {FRAMES}, a AS ({_METRICS.format(run='all', rows='frames')}) SELECT * EXCLUDE (run) FROM a")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(frames(spark, sf_dir))


@query(f"""WITH {BANK}, a AS ({_METRICS.format(run='a', rows='frames')}), b AS ({_METRICS.format(run='b', rows='bank')}),
l AS (UNPIVOT a ON n_rows, n_persons, on_mat_pct, mean_confidence INTO NAME metric VALUE value), r AS (UNPIVOT b ON n_rows, n_persons, on_mat_pct, mean_confidence INTO NAME metric VALUE value)
SELECT camera_id, metric, l.value AS baseline, r.value AS experiment, round(r.value - l.value, 6) AS delta FROM l FULL JOIN r USING (camera_id, metric)""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["camera_id"]
    out = matches.compare(matches.unpivot(_metrics(frames(spark, sf_dir)), keys), matches.unpivot(_metrics(bank(spark, sf_dir)), keys), [*keys, "metric"])
    return out.withColumn("delta", F.round("delta", 6))


@query(f"""WITH {FRAMES}, t AS (SELECT unnest([50, 100, 200, 300, 400]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (x_m > threshold AND y_m > 50) AS tp, count(*) FILTER (x_m > threshold AND NOT y_m > 50) AS fp, count(*) FILTER (NOT x_m > threshold AND y_m > 50) AS fn FROM frames CROSS JOIN t GROUP BY 1)
SELECT threshold, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def pr_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("x_m", "y_m", F.explode(F.array(*map(F.lit, (50, 100, 200, 300, 400)))).alias("threshold"))
    return matches.precision_recall(rows, ["threshold"], F.col("x_m") > F.col("threshold"), F.col("y_m") > 50)


@query(f"""WITH {FRAMES} SELECT tag_id, floor(x_m / 50)::BIGINT AS bin, count(*) AS n, round(avg(y_m), 6) AS mean, median(y_m) AS median, round(stddev_samp(y_m), 6) AS std FROM frames GROUP BY 1, 2""")
def binned_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("tag_id", F.floor(F.col("x_m") / 50).cast("long").alias("bin"), "y_m")
    stats = rows.groupBy("tag_id", "bin").agg(F.count("*").alias("n"), F.round(F.avg("y_m"), 6).alias("mean"), F.round(F.stddev_samp("y_m"), 6).alias("std"))
    middle = exact_quantiles(rows, ["tag_id", "bin"], "y_m", {"median": 0.5})
    same = F.col("s.tag_id").eqNullSafe(F.col("m.tag_id")) & F.col("s.bin").eqNullSafe(F.col("m.bin"))
    return stats.alias("s").join(middle.alias("m"), same, "left").select("s.*", "m.median")


@query(f"""WITH {BANK}, t AS (SELECT tracklet_id, frame_index::DOUBLE AS s FROM bank WHERE x_m > 60),
g AS (SELECT tracklet_id, round(lead(s) OVER (PARTITION BY tracklet_id ORDER BY s) - s, 1) AS g FROM t),
a AS (SELECT tracklet_id, count(*) AS n_tones, round(avg(g), 6) AS mean_s, round(stddev_pop(g) / nullif(avg(g), 0), 6) AS cv FROM g GROUP BY 1)
SELECT tracklet_id, n_tones, mean_s, cv, coalesce(cv < 0.6, false) AS periodic FROM a WHERE n_tones >= 3""")
def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.periodicity(bank(spark, sf_dir).filter("x_m > 60"), ["tracklet_id"], F.col("frame_index").cast("double"), 0.6)


@query(f"""WITH {CLIPS}, {VIDEOS} SELECT clip_id, c.video_id FROM clips c WHERE a_profile = 7 OR b_profile = 7 OR video_id IN (SELECT video_id FROM videos WHERE gym_id = 3 AND status = 'P')""")
def rls_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own clips on either side, or clips of one's gym."""
    own = videos(spark, sf_dir).filter("gym_id = 3 AND status = 'P'").select("video_id", F.lit(True).alias("own_gym"))
    rows = clips(spark, sf_dir).join(own, "video_id", "left")
    return lookup.visible(rows, F.col("a_profile") == 7, F.col("b_profile") == 7, F.col("own_gym")).select("clip_id", "video_id")


@query(f"WITH {CLIPS} SELECT clip_id, substring(sha256(concat_ws('|', video_id, a_tag, b_tag)), 1, 16) AS match_id FROM clips")
def match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return clips(spark, sf_dir).select("clip_id", short_id(16, s("video_id"), s("a_tag"), s("b_tag")).alias("match_id"))


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) % 587)::BIGINT AS tag_id FROM events")
def cycling_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.cycling(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "tag_id")


@query(f"""WITH {BANK}, f AS (SELECT tracklet_id, frame_index, x_m > 250 AS flag, row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS n FROM bank),
r AS (SELECT *, n - row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_index) AS run FROM f WHERE flag)
SELECT tracklet_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS n_rows FROM r GROUP BY tracklet_id, run""")
def true_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.true_runs(bank(spark, sf_dir), ["tracklet_id"], "frame_index", F.col("x_m") > 250)
