"""Operators over a table of member paths: sequences, camera images, calibration choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchspark.functions.text import base_name

# Path layout and the order in which image extensions are preferred.
ANNOTATION_PATH = r"^Annotations/([^/]+)/([^/]+)\.json$"
IMAGE_PATH = r"^Data/([^/]+)/([^/]+)/Images/([^/]+)/([^/.]+)\.([^/.]+)$"
EXTENSION_ORDER = ["JPG", "jpg", "jpeg", "JPEG"]
PARAMETER_WORDS = ["calib", "calibration", "extri", "extr", "camera", "param", "pose"]


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and two order-free sums of row hashes: equal tables give equal rows, whatever their file layout.

    A row's hash is the first 60 bits of the SHA-256 of its JSON with sorted names; NULLs and the borders of lists show in it.
    """
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    row = F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("bigint")
    # the sum is taken over a reduced hash so that it cannot overflow
    return df.select(row.alias("h")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.pmod(F.col("h"), F.lit(1_000_000_007))), F.lit(0)).alias("hash_sum"),
    )


def list_sequences(inventory: DataFrame, path: str = "path") -> DataFrame:
    """(split, seq, annotation path) of every annotation file, in path order."""
    p = F.col(path)
    return (
        inventory.where(p.rlike(ANNOTATION_PATH))
        .select(
            F.regexp_extract(p, ANNOTATION_PATH, 1).alias("split"),
            F.regexp_extract(p, ANNOTATION_PATH, 2).alias("seq"),
            p.alias("annotation_path"),
        )
        .orderBy("split", "seq", "annotation_path")
    )


def parse_images(inventory: DataFrame, path: str = "path") -> DataFrame:
    """Image members as (split, seq, cam, frame_id, ext, path)."""
    p = F.col(path)
    parts = ["split", "seq", "cam", "frame_id", "ext"]
    return inventory.where(p.rlike(IMAGE_PATH)).select(
        *[F.regexp_extract(p, IMAGE_PATH, i + 1).alias(n) for i, n in enumerate(parts)], p.alias("path")
    )


def resolve_images(frames: DataFrame, images: DataFrame) -> DataFrame:
    """The image of each (split, seq, cam, frame_id): the first existing one by extension preference.

    One row per image after the aggregate, so the join side is unique and a hot frame cannot multiply it.
    """
    place = F.array_position(F.array(*[F.lit(e) for e in EXTENSION_ORDER]), F.col("ext"))
    best = (
        images.where(place > 0)
        .groupBy("split", "seq", "cam", "frame_id")
        .agg(F.min_by("path", place).alias("image_path"))
    )
    return frames.join(best, ["split", "seq", "cam", "frame_id"], "inner")


def raw_image_name() -> F.Column:
    """Name under which a camera image is kept."""
    return F.concat(F.concat_ws("_", "split", "seq", "frame_id", "cam"), F.lit("_raw.jpg"))


def image_list(resolved: DataFrame) -> DataFrame:
    """Per frame the (cam, image) list in camera order; cameras are a fixed domain, so a list has few entries."""
    one = resolved.groupBy("split", "seq", "frame_id", "cam").agg(F.first(raw_image_name()).alias("image"))
    return one.groupBy("split", "seq", "frame_id").agg(
        F.sort_array(F.collect_list(F.struct("cam", "image"))).alias("input_images")
    )


def _named_sequences(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs (split, seq, path) where a path names the sequence.

    A path names a sequence when the name equals a run of ``_``- or ``.``-separated pieces of one path part, so the
    match is an equi-join on the run and no path is compared with every sequence. ``1`` does not match ``10``.
    """
    part = F.explode(F.split(F.lower("path"), "/")).alias("part")
    parts = paths.select("path", part).withColumn("p", F.split("part", r"[_.]"))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("p")),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.size("p") - i + 1), lambda n: F.array_join(F.slice("p", i, n), "_")
            ),
        )
    )
    named = parts.select("path", F.explode(F.array_distinct(runs)).alias("token")).distinct()
    seqs = sequences.select("split", "seq", F.lower("seq").alias("token"))
    return seqs.join(named, "token").select("split", "seq", "path")


def choose_tri_path(inventory: DataFrame, sequences: DataFrame) -> DataFrame:
    """Triangulation file per sequence: split and sequence named in the path, else the sequence alone, else the only
    such file there is, else none."""
    low = F.lower("path")
    tri = inventory.where(low.contains("triangulate_3d")).select("path")
    prio = F.when(low.contains(F.lower("split")), 0).when(low.endswith(".json"), 1)
    best = (
        _named_sequences(tri, sequences)
        .select("split", "seq", F.struct(prio.alias("prio"), F.col("path")).alias("c"))
        .where("c.prio is not null")
        .groupBy("split", "seq")
        .agg(F.min("c").getField("path").alias("hit"))
    )
    single = tri.where(low.endswith(".json")).agg(F.when(F.count("*") == 1, F.min("path")).alias("p")).scalar()
    return sequences.select("split", "seq").join(best, ["split", "seq"], "left").select(
        "split", "seq", F.coalesce("hit", single).alias("tri_path")
    )


def choose_calib(inventory: DataFrame, kind: str) -> DataFrame:
    """Calibration file per sequence for ``kind`` extri or intri: exact base name first, then the shallower path."""
    pattern = r"(?i)^data/([^/]+)/([^/]+)/calibration/"
    p, low, base = F.col("path"), F.lower("path"), F.lower(base_name("path"))
    if kind == "extri":
        wanted = low.contains("extri") | base.startswith("rot_")
    else:
        wanted = low.contains("intri") | base.contains("intr")
    exact = base.isin(f"{kind}.yml", f"{kind}.yaml")
    rank = F.struct((~exact).alias("not_exact"), F.size(F.split(p, "/")).alias("depth"), p.alias("path"))
    return (
        inventory.where(p.rlike(pattern) & wanted)
        .groupBy(F.regexp_extract(p, pattern, 1).alias("split"), F.regexp_extract(p, pattern, 2).alias("seq"))
        .agg(F.min(rank).getField("path").alias(f"{kind}_path"))
    )


def choose_param_json(inventory: DataFrame, sequences: DataFrame) -> DataFrame:
    """Fallback camera-parameter JSON per sequence: first path that names it and carries a parameter word."""
    low = F.lower("path")
    files = inventory.where(F.col("path").endswith(".json") & low.rlike("|".join(PARAMETER_WORDS))).select("path")
    return (
        _named_sequences(files, sequences)
        .where(low.contains(F.lower("split")))
        .groupBy("split", "seq")
        .agg(F.min("path").alias("param_path"))
    )
