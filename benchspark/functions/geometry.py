"""Points, boxes and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchspark.functions.text import col, half_even, let

# Preferred distance of an anchor camera, in person-box diagonals.
ANCHOR_TARGET = 0.6
ANCHOR_SIGMA = 0.2
ANCHOR_BAND = 0.18
# Distractor scoring.
DISTRACTOR_MIN_AREA = 0.0015
DISTRACTOR_MAX_AREA = 0.3
DISTRACTOR_TARGET_AREA = 0.02
DISTRACTOR_LOG_SIGMA = 0.9
DISTRACTOR_AREA_WEIGHT = 0.15
# Which coordinates of a 3-D point span a plane.
PLANES = {"xz": (0, 2), "xy": (0, 1), "yz": (1, 2)}


def at(c, i: int) -> Column:
    return F.get(col(c), F.lit(i))


def _max0(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


# --- angles --------------------------------------------------------------------------------------------------------

def azimuth(center, pivot, plane: str = "xz") -> Column:
    """Direction of ``center`` seen from ``pivot`` in a plane, in degrees."""
    i, j = PLANES[plane]
    return F.degrees(F.atan2(at(center, j) - at(pivot, j), at(center, i) - at(pivot, i)))


def wrap_angle(a) -> Column:
    """Angle in (-180, 180]."""
    a = col(a)
    return a - F.lit(360.0) * F.ceil((a - 180.0) / 360.0)


def relative_rotation(c1, c2, pivot, plane: str = "xz") -> Column:
    """STRUCT of signed and absolute rotation from camera 1 to camera 2 about the pivot, and its direction."""
    signed = wrap_angle(azimuth(c2, pivot, plane) - azimuth(c1, pivot, plane))
    still = F.abs(signed) < 1e-6
    return F.struct(
        signed.alias("signed_deg"),
        F.abs(signed).alias("deg"),
        F.when(still, "no rotation").when(signed > 0, "counterclockwise").otherwise("clockwise").alias("direction"),
    )


def distance3(a, b) -> Column:
    return F.sqrt(sum((F.pow(at(a, i) - at(b, i), 2) for i in range(3)), F.lit(0.0)))


# --- points and boxes ----------------------------------------------------------------------------------------------

def point_box_distance(point, xywh) -> Column:
    """Distance of a point to an [x, y, w, h] box, 0 inside."""
    px, py, x, y = at(point, 0), at(point, 1), at(xywh, 0), at(xywh, 1)
    dx = F.greatest(x - px, F.lit(0.0), px - (x + _max0(at(xywh, 2))))
    dy = F.greatest(y - py, F.lit(0.0), py - (y + _max0(at(xywh, 3))))
    return F.when((F.size(col(point)) == 2) & (F.size(col(xywh)) == 4), F.hypot(dx, dy))


def box_diagonal(xywh) -> Column:
    one = F.lit(1.0)
    return F.greatest(one, F.hypot(F.greatest(one, at(xywh, 2)), F.greatest(one, at(xywh, 3))))


def point_box_distance_norm(point, xywh) -> Column:
    """The same in box diagonals."""
    return point_box_distance(point, xywh) / box_diagonal(xywh)


def anchor_score(point="coord", body="body") -> Column:
    """STRUCT(score, distance_norm, bucket, priority): medium distance is best, then large, then small."""
    norm = point_box_distance_norm(point, body)
    diff = norm - ANCHOR_TARGET
    score = F.lit(1.0) - F.least(F.lit(1.0), F.abs(diff) / ANCHOR_SIGMA)
    bucket = (
        F.when(norm.isNull(), "unknown").when(F.abs(diff) <= ANCHOR_BAND, "medium").when(diff > 0, "large").otherwise("small")
    )
    rank = F.when(norm.isNull(), 9).when(F.abs(diff) <= ANCHOR_BAND, 0).when(diff > 0, 1).otherwise(2)
    return F.struct(
        F.coalesce(F.when(norm.isNotNull(), score), F.lit(-1.0)).alias("score"),
        norm.alias("distance_norm"), bucket.alias("bucket"), rank.alias("priority"),
    )


def valid_box(xywh) -> Column:
    return F.coalesce((F.size(col(xywh)) == 4) & (at(xywh, 2) > 1) & (at(xywh, 3) > 1), F.lit(False))


def box_area(xywh) -> Column:
    return F.when(F.size(col(xywh)) == 4, _max0(at(xywh, 2)) * _max0(at(xywh, 3))).otherwise(0.0)


def clip_box(xyxy, w, h) -> Column:
    """Corner box moved inside the image."""
    right, bottom = col(w) - 1, col(h) - 1

    def inside(v, high):
        return F.greatest(F.lit(0.0), F.least(high.cast("double"), v))

    return F.array(inside(at(xyxy, 0), right), inside(at(xyxy, 1), bottom), inside(at(xyxy, 2), right), inside(at(xyxy, 3), bottom))


def point_to_box(point, size: float = 120.0) -> Column:
    """Square corner box of a side length about a point."""
    half = size / 2
    return F.array(at(point, 0) - half, at(point, 1) - half, at(point, 0) + half, at(point, 1) + half)


def expand_box(xyxy, w, h, ratio: float = 2.0) -> Column:
    """Corner box grown about its centre and kept in the image; NULL if nothing is left."""
    width, height = col(w), col(h)
    bw = F.greatest(F.lit(1.0), at(xyxy, 2) - at(xyxy, 0) + 1)
    bh = F.greatest(F.lit(1.0), at(xyxy, 3) - at(xyxy, 1) + 1)
    cx, cy = (at(xyxy, 0) + at(xyxy, 2)) * 0.5, (at(xyxy, 1) + at(xyxy, 3)) * 0.5
    nw, nh = F.greatest(F.lit(2.0), bw * ratio) * 0.5, F.greatest(F.lit(2.0), bh * ratio) * 0.5

    def edge(v, size):
        return let(v, lambda x: F.greatest(F.lit(0), F.least(size - 1, half_even(x, 0).cast("int"))).cast("int"))

    grown = F.struct(edge(cx - nw, width).alias("x1"), edge(cy - nh, height).alias("y1"),
                     edge(cx + nw, width).alias("x2"), edge(cy + nh, height).alias("y2"))

    def keep(g):
        usable = (width > 1) & (height > 1) & (g["x2"] > g["x1"]) & (g["y2"] > g["y1"])
        return F.when(usable, F.array(g["x1"], g["y1"], g["x2"], g["y2"]))

    return let(grown, keep)


def padded_box(x1, y1, x2, y2, w, h, pad: int = 30, ratio: float = 0.12, cap: int = 50) -> Column:
    """Mask box with padding that grows with the box up to a cap, kept in the image."""
    side = F.greatest(F.lit(1), col(x2) - col(x1) + 1, col(y2) - col(y1) + 1)
    grown = F.greatest(F.lit(pad), half_even(side * F.lit(float(ratio)), 0).cast("int")) if ratio > 0 else F.lit(pad)
    p = F.least(grown, F.lit(cap))
    return F.array(
        F.greatest(F.lit(0), col(x1) - p), F.greatest(F.lit(0), col(y1) - p),
        F.least(col(w) - 1, col(x2) + p), F.least(col(h) - 1, col(y2) + p),
    )


def distractor_score(area) -> Column:
    """Closeness of a mask's area to the preferred one on a log scale, plus a small bonus for size."""
    a = F.greatest(col(area), F.lit(1e-12))
    d = F.ln(a) - F.ln(F.lit(DISTRACTOR_TARGET_AREA))
    return F.exp(-(d * d) / (2 * DISTRACTOR_LOG_SIGMA**2)) + DISTRACTOR_AREA_WEIGHT * F.least(
        F.lit(1.0), col(area) / DISTRACTOR_TARGET_AREA
    )
