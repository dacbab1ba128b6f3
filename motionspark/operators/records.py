"""Validators of JSON records and annotations, and bundles of a stage's checks; violations are rows, nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contracts

# fixed values: what every record carries, and what each kind carries besides
BASE = ("schema_version", "artifact_type", "clip_id", "camera_id", "pipeline_version", "created_at_ms")
KINDS = {
    "identity_hint": ("tracklet_id", "anchor_key", "constraint", "confidence", "evidence"),
    "tag_observation": ("frame_index", "timestamp_ms", "detection_id", "tag_id", "tag_family", "confidence", "roi_method"),
    "identity_assignment": ("person_id", "tag_id", "assignment_confidence", "evidence"),
    "match_session": ("match_id", "person_id_a", "person_id_b", "start_frame", "end_frame", "start_ts_ms", "end_ts_ms", "method", "confidence", "evidence"),
    "export_manifest": ("export_id", "match_id", "output_video_path", "crop_mode", "privacy", "inputs"),
}
NAMED = {  # fields that must not be empty text
    "identity_hint": ("tracklet_id", "anchor_key"),
    "tag_observation": ("detection_id", "tag_id", "tag_family"),
    "identity_assignment": ("person_id", "tag_id"),
    "export_manifest": ("output_video_path",),
}
CONFIDENCE = {"identity_hint": "confidence", "tag_observation": "confidence", "identity_assignment": "assignment_confidence", "match_session": "confidence"}
CONSTRAINTS = ("must_link", "cannot_link")
TAG_FAMILY = "36h11"
# fixed values: seventeen keypoints; left and right ones by their number, and those of the torso
KEYPOINTS = 17
LEFT_RIGHT = ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16))
TORSO = (5, 6, 11, 12)


def _rules(kind: str, m: Column, clip: str | None, family: str) -> dict[str, Column]:
    """Rules by name for a record's fields (a map of names to JSON or text). A rule about a field that is not there is left to ``missing_*``."""
    get = lambda f: m[f]
    unless_missing = lambda f, ok: get(f).isNull() | F.coalesce(ok, F.lit(False))
    rules = {f"missing_{f}": get(f).isNotNull() for f in (*BASE, *KINDS[kind])}
    if clip is not None:
        rules["clip_mismatch"] = unless_missing("clip_id", get("clip_id") == clip)
    for f in NAMED.get(kind, ()):
        rules[f"empty_{f}"] = unless_missing(f, F.trim(get(f)) != "")
    if kind in CONFIDENCE:
        f = CONFIDENCE[kind]
        rules["confidence_range"] = unless_missing(f, get(f).try_cast("double").between(0.0, 1.0))
    if kind == "identity_hint":
        rules["anchor_without_namespace"] = unless_missing("anchor_key", get("anchor_key").contains(":"))
        rules["unknown_constraint"] = unless_missing("constraint", get("constraint").isin(*CONSTRAINTS))
        rules["evidence_no_object"] = unless_missing("evidence", F.json_object_keys(get("evidence")).isNotNull())
    if kind == "tag_observation":
        rules["tag_family_mismatch"] = unless_missing("tag_family", get("tag_family") == family)
    if kind == "match_session":
        whole = lambda f: get(f).try_cast("double").cast("long")
        rules["end_before_start"] = get("start_frame").isNull() | unless_missing("end_frame", whole("end_frame") >= whole("start_frame"))
        for f in ("partial_start", "partial_end"):
            rules[f"{f}_no_bool"] = unless_missing(f, get(f).isin("true", "false"))
        sources = F.get_json_object(get("evidence"), "$.sources")
        rules["sources_no_list"] = sources.isNull() | F.json_array_length(sources).isNotNull()
    return rules


def record_faults(lines: DataFrame, key: str, value: str = "value", clip: str | None = None, family: str = TAG_FAMILY) -> DataFrame:
    """Faults (kind, rule, key) of JSON lines, each by its own ``artifact_type``; a line that is no JSON object is ``not_json``,
    one of another type or none ``unknown_kind``, both under the kind ''. Blank and null lines have none.

    Fields are read as text: a null field is a missing one, and a boolean is not told from its name in quotes.
    """
    text = F.trim(F.col(value))
    parsed = lines.filter(text != "").select(F.col(key).cast("string").alias("_k"), F.when(F.json_object_keys(text).isNotNull(), F.from_json(text, "map<string,string>")).alias("_m"))
    kind = F.col("_m")["artifact_type"]
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    broken = [F.when(F.col("_m").isNull(), F.struct(F.lit("").alias("kind"), F.lit("not_json").alias("rule"))), F.when(F.col("_m").isNotNull() & ~known, F.struct(F.lit("").alias("kind"), F.lit("unknown_kind").alias("rule")))]
    for k in KINDS:
        wrong = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(name).alias("rule"))) for name, ok in _rules(k, F.col("_m"), clip, family).items()]
        broken += [F.when(kind == k, w) for w in wrong]
    return parsed.select("_k", F.explode(F.array_compact(F.array(*broken))).alias("_f")).select("_f.kind", "_f.rule", F.col("_k").alias("key"))


def annotation_faults(rows: DataFrame, margin: float = 0.2) -> DataFrame:
    """Issues of keypoint annotations: image_id, annotation_id, issue, severity, keypoint (its number; of a pair the left one; null for the torso).

    ``rows``: annotation_id, image_id, bbox (x, y, w, h), keypoints (x, y, visibility for each; a list may end early), num_keypoints. A visible
    keypoint outside its box and a margin is an error, so are fewer than two visible torso points of an annotation with
    any keypoints; a left point to the right of its partner is a warning. A null box or list gives none of the issues that need it.
    """
    k = F.col("keypoints")
    point = lambda i: (F.get(k, 3 * i), F.get(k, 3 * i + 1), F.get(k, 3 * i + 2))
    bx, by, bw, bh = (F.get("bbox", F.lit(i)) for i in range(4))
    issue = lambda name, severity, i: F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), (i if isinstance(i, Column) else F.lit(i)).cast("int").alias("keypoint"))

    def outside(i: Column) -> Column:
        x, y, v = point(i)
        off = (x < bx - bw * margin) | (x > bx + bw + bw * margin) | (y < by - bh * margin) | (y > by + bh + bh * margin)
        return F.when(F.coalesce((v != 0) & off, F.lit(False)), issue("keypoint_outside_bbox", "error", i))

    found = F.transform(F.sequence(F.lit(0), F.lit(KEYPOINTS - 1)), outside)
    crossed = []
    for left, right in LEFT_RIGHT:
        (lx, _, lv), (rx, _, rv) = point(F.lit(left)), point(F.lit(right))
        crossed.append(F.when(F.coalesce((lv > 0) & (rv > 0) & (lx > rx), F.lit(False)), issue("skeleton_crossing", "warning", left)))
    seen = sum((F.coalesce((F.get(k, F.lit(3 * i + 2)) > 0).cast("int"), F.lit(0)) for i in TORSO), F.lit(0))
    torso = F.when((seen < 2) & (F.coalesce("num_keypoints", F.lit(0)) > 0), issue("missing_keypoints", "error", None))
    every = F.array_compact(F.concat(found, F.array(*crossed, torso)))
    return rows.select("image_id", "annotation_id", F.explode(every).alias("_i")).select("image_id", "annotation_id", "_i.*")


def _named(table: str, faults: DataFrame) -> DataFrame:
    return faults.select(F.lit(table).alias("table"), "rule", F.col("key").cast("string").alias("key"))


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def _not_single(df: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns that should hold one value and hold several."""
    several = df.agg(*(F.when(F.min(c) < F.max(c), F.lit(c)).alias(c) for c in columns))
    return several.select(F.lit(table).alias("table"), F.lit("several_values").alias("rule"), F.explode(F.array_compact(F.array(*columns))).alias("key"))


def _missing_keys(child: DataFrame, parent: DataFrame, keys: list[str], table: str, rule: str) -> DataFrame:
    gone = contracts.foreign_keys(child, parent, keys)
    return gone.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key"))


PLACE = ["clip_id", "camera_id", "frame_index", "detection_id"]


def detection_stage_faults(detections: DataFrame, frames: DataFrame, summaries: DataFrame, contacts: DataFrame | None) -> DataFrame:
    """Faults (table, rule, key) of the first stage's tables together: one clip and camera a table, boxes, ids and paths of detections, spans and
    counts of summaries, confidences of contacts, every track of the frames summed up, every frame and contact of some detection.

    Without contacts there is one row, ``table_missing``. The tables are looked at once a rule family, with partial aggregates and anti joins.
    """
    out = [
        _named("detections", contracts.violations(detections, F.col("detection_id"), **contracts.box_rules(), id_empty=_filled("detection_id"), **({"path_absolute": contracts.relative_path(F.col("mask_ref"))} if "mask_ref" in detections.columns else {}))),
        _named("tracklet_summaries", contracts.violations(summaries, F.col("tracklet_id"), span_order=F.col("end_frame") >= F.col("start_frame"), no_frames=F.col("n_frames") >= 1)),
        _missing_keys(frames, summaries, ["tracklet_id"], "tracklet_frames", "no_summary"),
        _missing_keys(frames, detections, PLACE, "tracklet_frames", "no_detection"),
        *(_not_single(df, name, ("clip_id", "camera_id")) for name, df in (("detections", detections), ("tracklet_frames", frames), ("tracklet_summaries", summaries))),
    ]
    if contacts is None:
        out.append(detections.sparkSession.createDataFrame([("contact_points", "table_missing", None)], "table string, rule string, key string"))
    else:
        conf = F.col("contact_conf")
        out.append(_named("contact_points", contracts.violations(contacts, F.col("detection_id"), confidence_range=conf.isNull() | conf.between(0, 1), id_empty=_filled("detection_id"))))
        out += [_missing_keys(contacts, detections, PLACE, "contact_points", "no_detection"), _not_single(contacts, "contact_points", ("clip_id", "camera_id"))]
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


def person_stage_faults(persons: DataFrame, detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Faults (table, rule, key) of person tracks: a clip in every row, one camera, boxes, and every row traced back to a detection and
    to a track of its clip."""
    rules = {"clip_null": F.col("clip_id").isNotNull(), "x_order": F.col("x2") >= F.col("x1"), "y_order": F.col("y2") >= F.col("y1")}
    out = _named("person_tracks", contracts.violations(persons, F.concat_ws("/", F.col("person_id"), F.col("frame_index").cast("string")), **rules)).unionByName(_not_single(persons, "person_tracks", ("camera_id",)))
    out = out.unionByName(_missing_keys(persons, detections, PLACE, "person_tracks", "no_detection"))
    return out.unionByName(_missing_keys(persons, frames, ["clip_id", "camera_id", "tracklet_id"], "person_tracks", "no_tracklet"))


MANIFEST = "export_id string, camera_id string, gym_id string, status string, collision_hints string, inputs struct<input_video_path: string, uploader_contract: struct<clip_row: struct<storage_bucket: string, storage_object_path: string, source_video_paths: array<string>, metadata: struct<local_output_path: string>>, log_events: array<string>>>"


def manifest_clips(lines: DataFrame, value: str = "value") -> DataFrame:
    """The clips of export manifests, a row a JSON line: ids, paths and what to upload where. Blank lines and records that say
    ``no_matches`` are left out; a line without inputs keeps its ids, the rest null; a missing list of events is an empty one."""
    r = lines.filter(F.trim(F.col(value)) != "").select(F.from_json(F.trim(F.col(value)), MANIFEST).alias("r")).select("r.*")
    row = "inputs.uploader_contract.clip_row"
    kept = r.filter(F.coalesce(F.col("status") != "no_matches", F.lit(True)))
    return kept.select("export_id", "camera_id", "gym_id", "collision_hints", "inputs.input_video_path", f"{row}.metadata.local_output_path", f"{row}.storage_bucket", f"{row}.storage_object_path", f"{row}.source_video_paths", F.coalesce("inputs.uploader_contract.log_events", F.array().cast("array<string>")).alias("log_events"))
