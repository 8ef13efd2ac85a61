"""Camera rigs and eye points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benchspark.functions.geometry import PLANES, at, azimuth, distance3, wrap_angle
from benchspark.functions.text import col, let, portable_hash
from benchspark.operators.frames import CAMERAS, frame_id_from_filename, frame_id_text, frame_index

# Limits of a usable rig.
DISTANCE_MIN, DISTANCE_MAX = 1e-6, 1e5
NO_SCORE = 1e18
MIN_DIAG_CAMS = 4


def eye_points(raw: DataFrame, json: str = "value", src: str = "src") -> DataFrame:
    """3-D eye points of triangulation documents (list, map, or either under ``frames``); the last entry of a frame
    counts and an eye that is no 3-vector gives NULL (B10)."""
    keep = [c for c in raw.columns if c not in (json, src)]
    framed = F.get_json_object(json, "$.frames")
    body = F.ltrim(F.coalesce(F.when(F.ltrim(F.col(json)).startswith("{"), framed), F.col(json)))
    docs = raw.select(*keep, F.col(src).alias("src"), body.alias("body"))
    listed = docs.where(F.col("body").startswith("[")).select(
        *keep, "src", F.posexplode(F.from_json("body", "array<string>")).alias("pos", "e")
    )
    fid = F.get_json_object("e", "$.frame_id")
    listed = listed.withColumn(
        "frame_idx", F.when(fid.isNotNull(), frame_index(fid)).otherwise(frame_id_from_filename(F.get_json_object("e", "$.filename")))
    )
    mapped = docs.where(F.col("body").startswith("{")).select(
        *keep, "src", F.posexplode(F.map_entries(F.from_json("body", "map<string,string>"))).alias("pos", "kv")
    ).select(*keep, "src", "pos", F.col("kv.value").alias("e"), frame_index("kv.key").alias("frame_idx"))
    rows = listed.unionByName(mapped.select(listed.columns)).where(
        F.col("frame_idx").isNotNull() & F.ltrim(F.col("e")).startswith("{")
    )
    given = F.coalesce(
        F.nullif(F.get_json_object("e", "$.eye3d"), F.lit("[]")), F.get_json_object("e", "$.eye")
    )
    eye = F.from_json(given, "array<double>")
    entry = F.struct(
        F.when(F.size(eye) == 3, eye).alias("eye3d"),
        F.get_json_object("e", "$.eye_err").try_cast("double").alias("eye_err"),
        F.get_json_object("e", "$.target_err").try_cast("double").alias("target_err"),
        F.col("src"),
    )
    return rows.groupBy(*keep, frame_id_text(F.col("frame_idx")).alias("frame_id")).agg(F.max_by(entry, "pos").alias("p")).select(
        *keep, "frame_id", "p.*"
    )


def split_extrinsic(matrix) -> Column:
    """STRUCT(r, t) of a row-major 4x4 matrix given as 16 numbers."""
    m = col(matrix)
    r = F.concat(F.slice(m, 1, 3), F.slice(m, 5, 3), F.slice(m, 9, 3))
    return F.when(F.size(m) == 16, F.struct(r.alias("r"), F.array(at(m, 3), at(m, 7), at(m, 11)).alias("t")))


def camera_centers(extrinsics: DataFrame) -> DataFrame:
    """Camera centre under both readings of (R, t): -R'T if world-to-camera, T if camera-to-world."""
    r, t = F.col("r"), F.col("t")

    def turned(i):
        return -(at(r, i) * at(t, 0) + at(r, i + 3) * at(t, 1) + at(r, i + 6) * at(t, 2))

    keys = [c for c in extrinsics.columns if c not in ("r", "t")]
    return extrinsics.select(*keys, F.array(turned(0), turned(1), turned(2)).alias("world_to_cam"), t.alias("cam_to_world"))


def rig_scores(centers: DataFrame, keys=("split", "seq")) -> DataFrame:
    """Plausibility of each reading from the spread of camera distances; smaller is better.

    Cameras are a fixed domain, so the centres of one rig fit in one small array and its pairs are built in the row.
    """
    rig = centers.groupBy(*keys, "cam").agg(
        F.first("world_to_cam").alias("world_to_cam"), F.first("cam_to_world").alias("cam_to_world")
    )
    packed = rig.groupBy(*keys).agg(
        F.count("*").alias("cams"),
        *[F.sort_array(F.collect_list(F.struct("cam", F.col(m).alias("c")))).alias(m) for m in ("world_to_cam", "cam_to_world")],
    )

    def stats(m):
        def pair_distances(cs):
            rest = lambda i: F.slice(cs, i + 2, F.greatest(F.size(cs) - i - 1, F.lit(0)))
            return F.flatten(F.transform(cs, lambda a, i: F.transform(rest(i), lambda b: distance3(a, b))))

        def spread(ds, mean):
            var = F.aggregate(ds, F.lit(0.0), lambda s, d: s + F.pow(d - mean, 2)) / F.size(ds)
            return F.struct(F.array_min(ds).alias("lo"), F.array_max(ds).alias("hi"), mean.alias("mean"), F.sqrt(var).alias("std"))

        def summary(ds):
            return let(F.aggregate(ds, F.lit(0.0), lambda s, d: s + d) / F.size(ds), lambda mean: spread(ds, mean))

        return let(F.transform(m, lambda e: e["c"]), lambda cs: let(pair_distances(cs), summary))

    def score(s):
        floor = F.lit(1e-6)
        penalty = (
            F.when(s["lo"] < 1e-6, 1e6).otherwise(0.0) + F.when(s["hi"] > 1e6, 1e6).otherwise(0.0)
            + F.when(s["std"] < 1e-6, 1e4).otherwise(0.0)
        )
        value = penalty + 1.0 / F.greatest(s["mean"], floor) + 1.0 / F.greatest(s["std"], floor)
        return F.when(F.col("cams") < 2, NO_SCORE).otherwise(value)

    d = packed.withColumn("sa", F.when(F.col("cams") >= 2, stats("world_to_cam"))).withColumn(
        "sb", F.when(F.col("cams") >= 2, stats("cam_to_world"))
    )
    return d.select(*keys, "cams", "sa", "sb", score(F.col("sa")).alias("score_a"), score(F.col("sb")).alias("score_b"))


def choose_convention(centers: DataFrame, source: str = "calibration", keys=("split", "seq")) -> DataFrame:
    """Centres of the more plausible reading with its mode and the ratio of the two scores.

    On equal scores calibration files prefer world-to-camera, parameter JSON camera-to-world.
    """
    scores = rig_scores(centers, keys)
    a_wins = F.col("score_a") <= F.col("score_b") if source == "calibration" else F.col("score_a") < F.col("score_b")
    lo, hi = F.least("score_a", "score_b"), F.greatest("score_a", "score_b")
    picked = scores.select(
        *keys,
        F.when(a_wins, "world_to_cam").otherwise("cam_to_world").alias("mode"),
        F.when(hi > 0, lo / hi).otherwise(0.0).alias("score_ratio"),
    )
    center = F.when(F.col("mode") == "world_to_cam", F.col("world_to_cam")).otherwise(F.col("cam_to_world"))
    return centers.join(picked, list(keys)).select(*keys, "cam", center.alias("center"), "mode", "score_ratio")


def resolve_centers(sequences: DataFrame, primary: DataFrame, fallback: DataFrame, keys=("split", "seq")) -> DataFrame:
    """Centres of each sequence from calibration, else from parameter JSON; one row with a reason where neither has
    any (B15)."""
    k = list(keys)
    first = primary.select(*k, "cam", "center", "mode", F.lit("calibration").alias("source"))
    has_first = primary.select(*k).distinct()
    second = fallback.join(has_first, k, "left_anti").select(*k, "cam", "center", "mode", F.lit("parameter_json").alias("source"))
    found = first.unionByName(second)
    none = F.lit(None)
    missing = sequences.select(*k).join(found.select(*k).distinct(), k, "left_anti").select(
        *k, none.cast("string").alias("cam"), none.cast("array<double>").alias("center"),
        F.lit("not_found_or_parse_failed").alias("mode"), none.cast("string").alias("source"),
    )
    return found.unionByName(missing)


def eye_distances(centers: DataFrame, eyes: DataFrame, keys=("split", "seq"), frame: str = "frame_id") -> DataFrame:
    """Camera-to-eye distance per frame and camera."""
    usable = eyes.where(F.col("eye3d").isNotNull())
    return centers.join(usable, list(keys)).select(
        *keys, frame, "cam", "center", "eye3d", distance3("center", "eye3d").alias("distance")
    )


def distance_gate(distances: DataFrame, keys=("split", "seq", "frame_id")) -> DataFrame:
    """Median camera distance per frame (a handful of cameras) and whether it lies in the accepted band."""
    per_cam = distances.groupBy(*keys, "cam").agg(F.first("distance").alias("distance"))
    med = per_cam.groupBy(*keys).agg(F.percentile("distance", 0.5).alias("median_distance"))
    return med.withColumn("accepted", F.col("median_distance").between(DISTANCE_MIN, DISTANCE_MAX))


def axis_diag(distances: DataFrame, keys=("split", "seq", "frame_id")) -> DataFrame:
    """Mean azimuth gap of neighbouring and of opposite cameras per plane; needs four cameras."""
    order = {c: i for i, c in enumerate(CAMERAS)}
    cam_pos = F.create_map(*[F.lit(x) for p in order.items() for x in p])[F.col("cam")]
    one = distances.groupBy(*keys, "cam").agg(F.first("center").alias("center"), F.first("eye3d").alias("eye3d"))
    angles = F.struct(cam_pos.alias("pos"), *[azimuth("center", "eye3d", p).alias(p) for p in PLANES])
    packed = one.groupBy(*keys).agg(F.sort_array(F.collect_list(angles)).alias("a")).where(F.size("a") >= MIN_DIAG_CAMS)
    rows = packed.select(*keys, "a", F.explode(F.array(*[F.lit(p) for p in PLANES])).alias("plane"))
    az = F.transform(
        "a", lambda e: F.when(F.col("plane") == "xz", e["xz"]).when(F.col("plane") == "xy", e["xy"]).otherwise(e["yz"])
    )

    def gaps(a):
        n = F.size(a)
        half = (n / 2).cast("int")

        def gap(i, step):
            return F.abs(wrap_angle(F.get(a, (i + step) % n) - F.get(a, i)))

        def mean(arr):
            return let(arr, lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))

        return F.struct(
            n.alias("cams"),
            mean(F.transform(F.sequence(F.lit(0), n - 1), lambda i: gap(i, F.lit(1)))).alias("adjacent_mean_deg"),
            F.when(n % 2 == 0, mean(F.transform(F.sequence(F.lit(0), half - 1), lambda i: gap(i, half)))).alias("opposite_mean_deg"),
        )

    ratio = F.col("adjacent_mean_deg") / F.greatest(F.col("opposite_mean_deg"), F.lit(1e-6))
    return rows.select(*keys, "plane", let(az, gaps).alias("g")).select(*keys, "plane", "g.*").withColumn(
        "adjacent_over_opposite", F.when(F.col("opposite_mean_deg").isNotNull(), ratio)
    )


def hash_order(seed: int, *keys) -> Column:
    """Reproducible stand-in for a random order: a hash of the seed and the row's own keys that other engines can repeat."""
    return portable_hash(F.lit(seed), *keys)


def sample_pair(cams: DataFrame, seed: int = 42, keys=("split", "seq", "frame_id")) -> DataFrame:
    """Two different cameras per frame, chosen by hash (B19); cameras are made unique first."""
    one = cams.groupBy(*keys, "cam").agg(*[F.first(c).alias(c) for c in cams.columns if c not in (*keys, "cam")])
    order = hash_order(seed, *keys, "cam")
    w = W.partitionBy(*keys).orderBy(order, "cam")
    ranked = one.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= 2)
    values = [c for c in ranked.columns if c not in (*keys, "pick")]
    wide = ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("pick") == p, F.struct(*values))).alias(f"c{p}") for p in (1, 2)]
    )
    return wide.where("c2 is not null").select(
        *keys, *[F.col(f"c{p}.{v}").alias(f"{v}{p}") for p in (1, 2) for v in values]
    )
