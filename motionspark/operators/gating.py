"""Gates before a reading: the region to read, a chain of checks that stops at the first failure, and the quality of masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, iou

# fixed values: why a box is not read, in the order of the checks
REASONS = ("skip_det_conf_low", "skip_roi_too_small", "skip_off_mat", "skip_low_prior", "skip_blurry", "skip_low_contrast")


def padded_roi(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float) -> Column:
    """struct(x1, y1, x2, y2): a whole-pixel box with a share of its size added on each side, cut to the frame, at least one pixel
    wide and high where the frame allows it; null if a corner is."""
    px = F.bround(F.greatest(F.lit(1), x2 - x1) * F.lit(pad)).cast("long")
    py = F.bround(F.greatest(F.lit(1), y2 - y1) * F.lit(pad)).cast("long")
    left, top = F.greatest(F.lit(0), x1 - px).cast("long"), F.greatest(F.lit(0), y1 - py).cast("long")

    def far(low: Column, edge: Column, size: Column) -> Column:
        cut = F.least(size - 1, edge).cast("long")
        return F.when(cut > low, cut).otherwise(F.least(size - 1, low + 1).cast("long"))

    whole = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(whole, F.struct(left.alias("x1"), top.alias("y1"), far(left, x2 + px, width).alias("x2"), far(top, y2 + py, height).alias("y2")))


def grid_cell(at: Column, size: Column, cells: int) -> Column:
    """The cell of a grid whose nodes run from the first to the last pixel that is nearest to a place, which is moved into the image."""
    share = F.try_divide(F.greatest(F.lit(0.0), F.least(size - 1, at)).cast("double"), (size - 1).cast("double"))
    return F.bround(F.coalesce(share, F.lit(0.0)) * F.lit(float(cells - 1))).cast("int")


def with_prior(rows: DataFrame, grid: DataFrame, shape: tuple[int, int], pad: float = 0.15) -> DataFrame:
    """Boxes with the ``prior`` of the grid cell (camera_id, gx, gy, prior) at the centre of their padded region, between 0 and 1.

    Cells that the grid lacks give null, which no check holds against a box. An equi join on camera and cell; the grid is a
    cell a row, and Spark broadcasts it only while its size is under the session's threshold.
    """
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "frame_w", "frame_h")}
    roi = padded_roi(c["x1"], c["y1"], c["x2"], c["y2"], c["frame_w"], c["frame_h"], pad)
    at = rows.withColumn("_roi", roi)
    at = at.withColumn("gx", grid_cell((F.col("_roi.x1") + F.col("_roi.x2")) * 0.5, c["frame_w"], shape[0])).withColumn("gy", grid_cell((F.col("_roi.y1") + F.col("_roi.y2")) * 0.5, c["frame_h"], shape[1]))
    clamped = grid.select("camera_id", "gx", "gy", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prior"))).alias("prior"))
    return at.join(clamped, ["camera_id", "gx", "gy"], "left").drop("_roi", "gx", "gy")


def scannability(rows: DataFrame, *, min_conf: float = 0.0, pad: float = 0.15, min_side: int = 0, min_area: int = 0, require_on_mat: bool = False, min_prior: float | None = None, min_blur: float = 0.0, min_contrast: float = 0.0) -> DataFrame:
    """Whether a box is worth reading, and the first check that it fails: confidence, size of the padded region, mat, prior,
    sharpness (variance of the Laplacian), contrast (deviation of grey values).

    ``rows``: x1, y1, x2, y2 (whole pixels), det_conf, frame_w, frame_h, on_mat, prior, blur_var, contrast_std. Adds scannable,
    reason ('ok' if none fails), roi (the box itself if confidence fails), roi_w, roi_h, roi_area; measures behind the
    failing check become null, as they would not have been taken. An unknown mat or prior is held against no box; a
    null confidence, corner, sharpness or contrast fails its check.
    """
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "frame_w", "frame_h")}
    out = rows.withColumn("_roi", padded_roi(c["x1"], c["y1"], c["x2"], c["y2"], c["frame_w"], c["frame_h"], pad))
    w, h = (F.greatest(F.lit(1), F.col(f"_roi.{a}2") - F.col(f"_roi.{a}1")).cast("long") for a in "xy")
    checks = (
        F.col("det_conf") >= min_conf,
        F.col("_roi").isNotNull() & (w >= min_side) & (h >= min_side) & (w * h >= min_area),
        F.coalesce(F.col("on_mat"), F.lit(True)) if require_on_mat else F.lit(True),
        F.lit(True) if min_prior is None else F.coalesce(F.col("prior") >= min_prior, F.lit(True)),
        F.col("blur_var") >= min_blur,
        F.col("contrast_std") >= min_contrast,
    )
    stop = F.lit(len(checks))
    for i in reversed(range(len(checks))):
        stop = F.when(~F.coalesce(checks[i], F.lit(False)), i).otherwise(stop)
    out = out.withColumn("_stop", stop)
    raw = F.struct(*(c[k].cast("long").alias(k) for k in ("x1", "y1", "x2", "y2")))
    early = F.col("_stop") == 0
    out = out.withColumn("roi_w", F.when(early, c["x2"] - c["x1"]).when(F.col("_roi").isNotNull(), w).cast("long")).withColumn("roi_h", F.when(early, c["y2"] - c["y1"]).when(F.col("_roi").isNotNull(), h).cast("long"))
    out = out.withColumn("roi", F.when(early, raw).otherwise(F.col("_roi"))).withColumn("roi_area", F.col("roi_w") * F.col("roi_h"))
    seen = {"prior": 3, "blur_var": 4, "contrast_std": 5}
    for name, i in seen.items():
        skipped = name == "prior" and min_prior is None
        out = out.withColumn(name, F.lit(None).cast("double") if skipped else F.when(F.col("_stop") >= i, F.col(name)))
    reason = F.element_at(F.array(*map(F.lit, (*REASONS, "ok"))), F.col("_stop") + 1)
    return out.withColumn("scannable", F.col("_stop") == len(checks)).withColumn("reason", reason).drop("_roi", "_stop")


def mask_quality(mask_area: Column, mask_box: Column, box: Column, least: float = 0.10, most: float = 1.10) -> Column:
    """0 to 1: a quarter for an area that suits the box (falling off below ``least`` and from ``most`` to twice that), three for the
    overlap of the mask's own box with it; 0 for an empty or missing mask or box."""
    ratio = F.try_divide(mask_area.cast("double"), area(box))
    fits = F.when(ratio < least, ratio / least).when(ratio > most, F.greatest(F.lit(0.0), 1 - (ratio - most) / most)).otherwise(1.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 * fits + 0.75 * iou(box, mask_box)))
    return F.when((mask_area > 0) & mask_box.isNotNull() & (area(box) > 0), score).otherwise(0.0)


def mask_passes(confidence: Column, quality: Column, min_conf: float, min_quality: float) -> Column:
    return F.coalesce((confidence >= min_conf) & (quality >= min_quality), F.lit(False))
