"""Anchor cameras, masks and distractor objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benchspark.functions.geometry import (
    DISTRACTOR_MAX_AREA,
    DISTRACTOR_MIN_AREA,
    anchor_score,
    at,
    box_area,
    distractor_score,
)
from benchspark.functions.labels import (
    BAD_GENERIC_WORDS,
    BAD_OBJECTS,
    MASK_MAX_AREA,
    MASK_MIN_AREA,
    SMALL_CONTEXT_AREA,
    is_ambiguous,
    is_generic,
    is_person_like,
)
from benchspark.functions.text import any_word, col, half_even, strip, text, words
from benchspark.operators.frames import has_coord
from benchspark.operators.rig import hash_order

# Mask gates and distractor geometry.
PERSON_OVERLAP = 0.5
MASKS_TRIED = 3
MIN_BOX_PX = 25
MIN_DIST_RATIO = 0.02818 * 3.14
MAX_DIST_RATIO = 0.95
EDGE_PAD = 20.0
RANDOM_POINTS = 40
POINTS_KEPT = 18
BAD_DISTRACTOR_WORDS = ["grid", "pattern", "texture", "tiles", "tile", "carpet", "rug", "mat", "floor", "ceiling", "wall",
                        "ground", "surface"]
FRAME = ("split", "seq", "frame_id")


def rank_anchors(cams: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Cameras that can anchor a frame, best first: with a point, not invisible, with an image.

    Order is distance bucket, score, camera order. Cameras are made unique, so a window holds at most the camera domain.
    """
    usable = cams.where(has_coord() & F.coalesce("visible", F.lit(True)) & F.col("image_path").isNotNull())
    one = usable.groupBy(*keys, "cam").agg(F.max(F.struct("cam_pos", "coord", "body")).alias("v"))
    scored = one.select(*keys, "cam", F.col("v.cam_pos").alias("cam_pos"), anchor_score("v.coord", "v.body").alias("a"))
    w = W.partitionBy(*keys).orderBy(F.col("a.priority"), F.col("a.score").desc(), "cam_pos")
    return scored.select(
        *keys, "cam", "a.score", "a.distance_norm", "a.bucket", "a.priority", F.row_number().over(w).alias("anchor_rank")
    )


# --- masks from pixels ---------------------------------------------------------------------------------------------

def mask_stats(pixels: DataFrame, dims: DataFrame | None = None, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Box, pixel count, centroid and, with image sizes, area share of each mask."""
    stats = pixels.groupBy(*keys).agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"),
        F.count("*").alias("area_px"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )
    if dims is None:
        return stats
    return stats.join(dims, list(keys)).withColumn("area_ratio", F.col("area_px") / F.greatest(F.lit(1), F.col("img_w") * F.col("img_h")))


def mask_overlap(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Share of each mask's pixels inside the person box, both ends included (B25); one box per mask."""
    right, bottom = F.col("img_w") - 1, F.col("img_h") - 1

    def edge(v, high):
        return F.greatest(F.lit(0), F.least(high, v.cast("int")))

    corners = boxes.select(
        *keys,
        edge(at("body", 0), right).alias("bx1"), edge(at("body", 1), bottom).alias("by1"),
        edge(at("body", 0) + at("body", 2), right).alias("bx2"), edge(at("body", 1) + at("body", 3), bottom).alias("by2"),
    )
    real = (F.col("bx2") > F.col("bx1")) & (F.col("by2") > F.col("by1"))
    inside = real & F.col("x").between(F.col("bx1"), F.col("bx2")) & F.col("y").between(F.col("by1"), F.col("by2"))
    return pixels.join(corners, list(keys)).groupBy(*keys).agg(
        (F.count_if(inside) / (F.count("*") + F.lit(1e-6))).alias("overlap")
    )


def mean_conf(pixels: DataFrame, points: DataFrame, radius: int, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Mean soft confidence in the square about a point; pixels without a row count as 0."""
    r = max(1, int(radius))
    px, py = half_even(at("point", 0), 0).cast("int"), half_even(at("point", 1), 0).cast("int")
    square = points.select(
        *keys,
        F.greatest(F.lit(0), px - r).alias("qx1"), F.least(F.col("img_w") - 1, px + r).alias("qx2"),
        F.greatest(F.lit(0), py - r).alias("qy1"), F.least(F.col("img_h") - 1, py + r).alias("qy2"),
        ((px >= 0) & (py >= 0) & (px < F.col("img_w")) & (py < F.col("img_h"))).alias("in_image"),
    )
    size = (F.col("qx2") - F.col("qx1") + 1) * (F.col("qy2") - F.col("qy1") + 1)
    hit = F.col("x").between(F.col("qx1"), F.col("qx2")) & F.col("y").between(F.col("qy1"), F.col("qy2"))
    sums = pixels.join(square, list(keys)).where(hit).groupBy(*keys).agg(F.sum("p").alias("total"))
    return square.join(sums, list(keys), "left").select(
        *keys, F.when(F.col("in_image"), F.coalesce("total", F.lit(0.0)) / size).alias("mean_conf")
    )


def select_mask(candidates: DataFrame, min_conf: float = 0.0, keys: Sequence[str] = ("key",)) -> DataFrame:
    """First of the three best-scored masks that passes the area, confidence and overlap gates.

    Without one, the reason is ``overlap_reject`` if the person box refused a mask, else ``total_fail``.
    """
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), "idx")
    top = candidates.withColumn("try", F.row_number().over(w)).where(F.col("try") <= MASKS_TRIED)
    area_ok = F.col("area_ratio").between(MASK_MIN_AREA, MASK_MAX_AREA)
    conf_ok = F.col("conf").isNull() | (F.col("conf") >= min_conf) if min_conf > 0 else F.lit(True)
    refused = area_ok & conf_ok & F.coalesce(F.col("overlap") >= PERSON_OVERLAP, F.lit(False))
    passed = area_ok & conf_ok & ~refused
    best = F.min_by(F.struct("idx", "score", "area_ratio"), F.when(passed, F.col("try")))
    return top.groupBy(*keys).agg(
        F.when(F.max(passed), best).alias("m"), F.max(refused).alias("refused"), F.max(passed).alias("passed")
    ).select(
        *keys, F.col("m.idx").alias("idx"), F.col("m.score").alias("score"), F.col("m.area_ratio").alias("area_ratio"),
        F.when(~F.col("passed"), F.when(F.col("refused"), "overlap_reject").otherwise("total_fail")).alias("reject_reason"),
    )


def large_mask_refine(stats: DataFrame, trigger_ratio: float = 1.0, max_share: float = 0.85) -> DataFrame:
    """Masks at least as large as the person, and whether a refined mask is accepted in place."""
    person = box_area("body")
    triggered = F.coalesce((person > 1) & (F.col("area_px") >= trigger_ratio * person), F.lit(False))
    share = F.when(F.col("area_px") > 0, F.col("refined_area_px") / F.col("area_px"))
    usable = triggered & (share > 0) & (share <= max_share) & ~is_generic("refined_label")
    return stats.select(
        "*", triggered.alias("refine_triggered"), F.when(triggered, share).alias("refine_share"),
        F.coalesce(usable, F.lit(False)).alias("refine_used"),
    )


def needs_context(area, label) -> Column:
    """A small mask or an ambiguous label asks for a crop with context."""
    a = F.coalesce(col(area), F.lit(0.0))
    return ((a > 0) & (a <= SMALL_CONTEXT_AREA)) | is_ambiguous(label)


def person_guard(candidates: DataFrame, labels: Sequence[str] = ("mask_label", "overlay_label", "refined_label")) -> DataFrame:
    """Drop candidates with a person-like label whose mask overlaps the person box."""
    person = F.lit(False)
    for name in labels:
        if name in candidates.columns:
            person = person | is_person_like(name)
    limit = max(0.2, PERSON_OVERLAP * 0.5)
    return candidates.where(~(person & F.coalesce(F.col("overlap") >= limit, F.lit(False))))


# --- distractors ---------------------------------------------------------------------------------------------------

def distractor_points(frames: DataFrame, seed: int = 42, w: int = 1000, h: int = 750, keys: Sequence[str] = FRAME,
                      keep: Sequence[str] = ()) -> DataFrame:
    """Points away from the gaze point: nine fixed and forty by hash, in the distance band, off the edge and off the
    person; the first eighteen (B31). All is done inside the row; ``keep`` names further columns of it to return."""
    gx, gy = at("coord", 0), at("coord", 1)
    fixed = [(F.lit(float(w)) - gx, F.lit(float(h)) - gy)]
    shares = [(0.1, 0.1), (0.9, 0.1), (0.1, 0.9), (0.9, 0.9), (0.5, 0.1), (0.5, 0.9), (0.1, 0.5), (0.9, 0.5)]
    fixed += [(F.lit(w * a), F.lit(h * b)) for a, b in shares]

    def uniform(i, side, size):
        share = F.pmod(hash_order(seed, F.lit(side), i, *keys), F.lit(1 << 31)) / float(1 << 31)
        return F.lit(EDGE_PAD) + share * F.lit(max(0.0, size - 1 - 2 * EDGE_PAD))

    drawn = F.transform(
        F.sequence(F.lit(1), F.lit(RANDOM_POINTS)), lambda i: F.struct(uniform(i, "x", w).alias("x"), uniform(i, "y", h).alias("y"))
    )
    points = F.concat(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in fixed]), drawn)
    low, high = MIN_DIST_RATIO * max(w, h), MAX_DIST_RATIO * max(w, h)
    right, bottom = at("body", 0) + F.greatest(F.lit(0.0), at("body", 2)), at("body", 1) + F.greatest(F.lit(0.0), at("body", 3))

    def usable(p):
        off = F.hypot(p["x"] - gx, p["y"] - gy).between(low, high)
        safe = p["x"].between(EDGE_PAD, w - 1 - EDGE_PAD) & p["y"].between(EDGE_PAD, h - 1 - EDGE_PAD)
        on_person = p["x"].between(at("body", 0), right) & p["y"].between(at("body", 1), bottom)
        return off & safe & ~F.coalesce(on_person, F.lit(False))

    kept = F.slice(F.filter(points, usable), 1, POINTS_KEPT)
    return frames.where(has_coord()).select(*keys, *keep, F.posexplode(kept).alias("point_idx", "p")).select(
        *keys, *keep, "point_idx", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def distractor_gates(candidates: DataFrame) -> DataFrame:
    """First gate that refuses each segmented candidate, or ``candidate_pass``."""
    low = F.lower(strip(text("label")))
    toks = words(low)
    area = F.col("area_ratio")
    reason = (
        F.when(area < DISTRACTOR_MIN_AREA, "area_too_small")
        .when(area > DISTRACTOR_MAX_AREA, "area_too_large")
        .when(F.least("box_w", "box_h") < MIN_BOX_PX, "bbox_too_small")
        .when(low == "", "label_empty")
        .when(low.isin(*BAD_OBJECTS) | any_word(toks, BAD_GENERIC_WORDS), "label_generic_or_bad")
        .when(any_word(toks, BAD_DISTRACTOR_WORDS), "label_bad_distractor_words")
        .when(text("verify_crop") != "YES", "verify_crop_no")
        .when(text("verify_full") != "YES", "verify_full_no")
        .when(text("tangible") != "YES", "tangible_no")
        .otherwise("candidate_pass")
    )
    return candidates.withColumn("reason", reason)


def gate_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("reason").agg(F.count("*").alias("n"))


def best_distractor(gated: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Best-scored passing candidate per frame; the earlier point wins a tie."""
    scored = gated.where("reason = 'candidate_pass'").withColumn("score", distractor_score("area_ratio"))
    pick = F.max(F.struct("score", (-F.col("point_idx")).alias("first"), "label", "area_ratio", "box_w", "box_h"))
    return scored.groupBy(*keys).agg(pick.alias("b")).select(
        *keys, "b.label", "b.score", "b.area_ratio", "b.box_w", "b.box_h", (-F.col("b.first")).alias("point_idx")
    )
