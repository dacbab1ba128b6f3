"""Sessions in zones that change their clocks, videos after uploads, devices; order over range partitions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from motionspark.operators import contracts, lookup

DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def plain_session(at, zone, entries):
    local = at.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone))
    for entry, weekday, start, end in sorted(entries):
        if DAYS[local.weekday()] != weekday:
            continue
        midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
        a, b = midnight + timedelta(minutes=start), midnight + timedelta(minutes=end if end > start else end + 1440)
        if a - timedelta(minutes=30) <= local <= b:
            day = local.strftime("%Y-%m-%d")
            return entry, day, f"{day}T{start // 60:02d}{start % 60:02d}", b.astimezone(timezone.utc).replace(tzinfo=None)
    return None


def test_sessions_over_changes_of_clocks(spark):
    rng = random.Random(2)
    zones = {1: "America/New_York", 2: "Europe/Berlin", 3: "Asia/Tokyo"}
    entries = {g: [(i, rng.choice(DAYS), s, (s + rng.choice([90, 150, 400])) % 1440) for i, s in enumerate(rng.choice([360, 555, 1080, 1200, 1320]) for _ in range(9))] for g in zones}
    clips = []
    for day in (datetime(2024, 3, 8), datetime(2024, 3, 29), datetime(2024, 10, 25), datetime(2024, 11, 1)):
        clips += [(len(clips) + i, rng.randint(1, 4), day + timedelta(minutes=rng.randint(0, 5 * 1440), seconds=rng.choice([0, 30]))) for i in range(150)]
    clips += [clips[0], clips[0], (None, 2, None)]
    schedule = [(g, zones[g], *e) for g in zones for e in entries[g]]
    df = spark.createDataFrame(clips, "clip long, gym_id long, at timestamp_ntz")
    got = lookup.session_windows(df, spark.createDataFrame(schedule + schedule[:3], "gym_id long, zone string, entry long, weekday string, start_min long, end_min long")).collect()
    want = [(c, plain_session(at, zones[g], entries[g])) for c, g, at in clips if g in zones and at is not None]
    want = sorted((c, *s) for c, s in want if s)
    assert sorted((r.clip, r.entry, r.session_date, r.session_id, r.session_end) for r in got) == want and len(want) > 50


def test_videos_after_uploads(spark):
    known = spark.createDataFrame([("v1", "p", 1), ("v2", "p", 1), ("v3", "q", 2), ("v4", "r", None), ("v5", None, 4)], "video_id string, path string, gym_id long")
    paths = spark.createDataFrame([("p", 7, 1), ("p", 8, 2), ("p", None, 3), ("q", None, 4), ("r", 5, 5), ("new", None, 6), ("new", 9, 7), ("bare", None, 8), (None, 3, 9)], "path string, gym_id long, position long")
    got = {(r.video_id if not r.created else "made", r.path, r.gym_id) for r in lookup.registered_videos(known, paths).collect()}
    assert got == {("v1", "p", 8), ("v2", "p", 1), ("v3", "q", 2), ("v4", "r", 5), ("v5", None, 4), ("made", "new", 9), ("made", "bare", None)}
    assert lookup.registered_videos(known.limit(0), paths.limit(0)).count() == 0


def test_devices(spark):
    told = spark.createDataFrame([("c", 1), ("c", 2), ("d", 3), ("c", 4)], "clip_id string, profile_id long")
    tokens = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, None), (9, "z")], "profile_id long, token string")
    assert sorted(map(tuple, lookup.push_tokens(told, tokens).collect())) == [("c", "x"), ("c", "y")]


def test_unsorted_rows_across_ranges(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randint(0, 40) + i // 40, rng.randint(0, 3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, s string, v long, w long").repartition(9)
    last, want = {}, set()
    for i, s, v, w in rows:
        if s in last and (v, w) < last[s]:
            want.add(i)
        last[s] = (v, w)
    assert {r.id for r in contracts.unsorted(df, "s", ["v", "w"], "id").collect()} == want
    assert contracts.unsorted(df.limit(0), "s", ["v", "w"], "id").count() == 0
