"""Frame annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.text import base_name, col, strip

# Camera order, size to which images are rescaled, visibility words.
CAMERAS = [f"Cam{i}" for i in range(1, 7)]
TARGET_SIZE = (1000, 750)
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]


def frame_index(c) -> Column:
    """Frame number of a text with or without leading zeros; NULL if it is none."""
    digits = F.regexp_replace(strip(col(c)), r"^0+(?=\d)", "")
    return digits.try_cast("int")


def frame_id_from_filename(c) -> Column:
    """Frame number of a file name: its base name up to the first dot (B2)."""
    return frame_index(F.substring_index(base_name(c), ".", 1))


def frame_id_text(index: Column) -> Column:
    """At least four digits; longer numbers are not cut."""
    return F.format_string("%04d", index)


def normalize_frames(raw: DataFrame, json: str = "value") -> DataFrame:
    """Annotation documents (list or map of frames) to one row per frame with its data as JSON text (B1).

    A map may sit under ``frames`` or ``data`` if that entry is itself a map; entries without a frame number are dropped.
    """
    keep = [c for c in raw.columns if c != json]
    body = F.ltrim(F.col(json))
    listed = raw.where(body.startswith("[")).select(*keep, F.explode(F.from_json(json, "array<string>")).alias("data"))
    fid = F.get_json_object("data", "$.frame_id")
    from_list = listed.where(F.ltrim(F.col("data")).startswith("{")).withColumn(
        "frame_idx",
        F.when(fid.isNotNull(), frame_index(fid)).otherwise(frame_id_from_filename(F.get_json_object("data", "$.filename"))),
    )
    top = F.from_json(json, "map<string,string>")
    inner = F.coalesce(
        *[
            F.when(F.ltrim(F.get_json_object(json, f"$.{k}")).startswith("{"), F.from_json(F.get_json_object(json, f"$.{k}"), "map<string,string>"))
            for k in ("frames", "data")
        ],
        top,
    )
    mapped = raw.where(body.startswith("{")).select(*keep, F.explode(inner).alias("k", "data"))
    from_map = mapped.where(F.ltrim(F.col("data")).startswith("{")).withColumn("frame_idx", frame_index("k")).drop("k")
    rows = from_list.unionByName(from_map.select(from_list.columns)).where("frame_idx is not null")
    return rows.select(*keep, frame_id_text(F.col("frame_idx")).alias("frame_id"), "frame_idx", "data")


def explode_cameras(frames: DataFrame, data: str = "data") -> DataFrame:
    """One row per frame and present camera in camera order, with typed annotation fields."""
    keep = [c for c in frames.columns if c != data]
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.get_json_object(data, f"$.{c}").isNotNull(),
                    F.struct(F.lit(i).alias("cam_pos"), F.lit(c).alias("cam"), F.get_json_object(data, f"$.{c}").alias("anno")),
                )
                for i, c in enumerate(CAMERAS)
            ]
        )
    )
    rows = frames.select(*keep, F.inline(entries))
    field = lambda k: F.get_json_object("anno", f"$.{k}")
    return rows.select(
        *keep,
        "cam_pos",
        "cam",
        parse_visibility(field("visibility")).alias("visible"),
        F.from_json(field("coordinate"), "array<double>").alias("coord"),
        F.from_json(field("body"), "array<double>").alias("body"),
        F.from_json(field("head"), "array<double>").alias("head"),
        F.from_json(field("eye"), "array<array<double>>").alias("eyes"),
    )


def parse_visibility(c) -> Column:
    """Boolean of a visibility value given as text: numbers are truncated, then 1 is true and 0 false."""
    low = F.lower(strip(col(c).cast("string")))
    number = F.when(low.rlike(r"^[-+]?[0-9.]+(e[-+]?\d+)?$"), low.try_cast("double").cast("bigint"))
    return (
        F.when(low.isin(*TRUE_WORDS), True)
        .when(low.isin(*FALSE_WORDS), False)
        .when(number == 1, True)
        .when(number == 0, False)
    )


def has_coord(c="coord") -> Column:
    return F.coalesce(F.size(col(c)) == 2, F.lit(False))


def box(c) -> Column:
    """The [x, y, w, h] box, or NULL unless it has four numbers."""
    return F.when(F.size(col(c)) == 4, col(c))


def _clamp(v: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, high))


def rescale(annos: DataFrame, width: int = TARGET_SIZE[0], height: int = TARGET_SIZE[1], size=("img_w", "img_h")) -> DataFrame:
    """Point, boxes and eye points in a new image size, clamped to it; the point before and after is kept."""
    ow, oh = F.col(size[0]).cast("double"), F.col(size[1]).cast("double")
    valid = (ow > 0) & (oh > 0)
    sx, sy = F.lit(float(width)) / ow, F.lit(float(height)) / oh
    right, bottom = F.lit(float(width - 1)), F.lit(float(height - 1))
    at = lambda c, i: F.get(F.col(c), F.lit(i))

    def scaled_box(c):
        x, y = _clamp(at(c, 0) * sx, right), _clamp(at(c, 1) * sy, bottom)
        return F.when(
            valid & (F.size(c) == 4), F.array(x, y, _clamp(at(c, 2) * sx, right - x), _clamp(at(c, 3) * sy, bottom - y))
        ).otherwise(F.col(c))

    point = F.when(
        valid & has_coord(), F.array(_clamp(at("coord", 0) * sx, right), _clamp(at("coord", 1) * sy, bottom))
    )
    eyes = F.transform(
        F.filter("eyes", lambda e: F.size(e) >= 2), lambda e: F.array(F.get(e, F.lit(0)) * sx, F.get(e, F.lit(1)) * sy)
    )
    out = {
        "gaze_point_orig": F.when(valid & has_coord(), F.col("coord")),
        "gaze_point_resized": point,
        "coord": F.coalesce(point, F.col("coord")),
    }
    out |= {c: scaled_box(c) for c in ("body", "head") if c in annos.columns}
    if "eyes" in annos.columns:
        out["eyes"] = F.when(valid & (F.size(eyes) > 0), eyes).otherwise(F.col("eyes"))
    return annos.withColumns(out)


def dataset_stats(cams: DataFrame, keys=("split", "seq", "frame_id")) -> DataFrame:
    """Sequences, frames, frames with a gaze point, gaze points.

    Frames are reduced first, so distinct sequences are counted over one row per sequence.
    """
    per_frame = cams.groupBy(*keys).agg(F.count_if(has_coord()).alias("points"))
    per_seq = per_frame.groupBy(*keys[:-1]).agg(
        F.count("*").alias("frames"), F.count_if(F.col("points") > 0).alias("with_gaze"), F.sum("points").alias("points")
    )
    return per_seq.agg(
        F.count("*").alias("total_sequences"),
        F.coalesce(F.sum("frames"), F.lit(0)).alias("total_frames"),
        F.coalesce(F.sum("with_gaze"), F.lit(0)).alias("frames_with_gaze"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("total_gaze_points"),
    )


def min_views(resolved: DataFrame, n: int = 2, keys=("split", "seq", "frame_id")) -> DataFrame:
    """Frames with at least ``n`` cameras that have an image."""
    per_cam = resolved.groupBy(*keys, "cam").agg(F.lit(1).alias("one"))
    return per_cam.groupBy(*keys).agg(F.count("*").alias("views")).where(F.col("views") >= n)
