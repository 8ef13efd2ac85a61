"""Labels of one object over attempts and camera views.

Views are first made unique per frame and camera, attempts per camera and stage, so the ordered folds below run over
arrays no longer than those fixed domains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.labels import (
    CLOSE_DISTANCE,
    CLOSE_DOWNSCALE,
    EARLY_ACCEPT_AREA,
    is_ambiguous,
    mask_quality,
    most_specific,
    sanitize,
    specificity,
    subset_match,
)
from benchspark.functions.text import let, text

KEYS = ("frame_key",)
ATTEMPT = "struct<stage:string,label:string,mode:string,area:double,clean:string,bad:boolean,spec:double>"


def _arr_append(arr: Column, x: Column) -> Column:
    return F.array_append(arr, x)


def select_attempt(attempts: DataFrame, keys: Sequence[str] = ("frame_key", "cam")) -> DataFrame:
    """Chosen segmentation attempt per camera.

    Attempts run in ``stage_pos`` order. Loose ones only improve a baseline; the first early-accepted or strict one
    ends the search, and a strict label that does not refine the baseline gives way to it. If none is accepted, the
    baseline counts, else the last attempt.
    """
    last = attempts.groupBy(*keys, "stage", "stage_pos").agg(
        F.max(F.struct("cue_hits", "mask_area_ratio", "label", "mode")).alias("v")
    )
    clean = sanitize("v.label")
    item = F.struct(
        "stage_pos", "stage", F.col("v.label").alias("label"), F.col("v.mode").alias("mode"),
        F.coalesce("v.mask_area_ratio", F.lit(0.0)).alias("area"), F.col("v.cue_hits").alias("hits"),
        clean.alias("clean"), is_ambiguous(clean).alias("bad"), specificity(clean).alias("spec"),
    )
    runs = last.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("runs"))

    def as_attempt(x):
        return F.struct(*[x[n].alias(n) for n in ("stage", "label", "mode", "area", "clean", "bad", "spec")]).cast(ATTEMPT)

    def better_baseline(cur, new):
        return (
            F.when(cur.isNull(), new)
            .when(cur["bad"] & ~new["bad"], new)
            .when(new["bad"] & ~cur["bad"], cur)
            .when(new["area"] > cur["area"] * 1.05, new)
            .when(cur["area"] > new["area"] * 1.05, cur)
            .when(new["spec"] > cur["spec"], new)
            .otherwise(cur)
        )

    def refines(strict, loose):
        return F.coalesce(
            F.when(strict["clean"].isNull(), False)
            .when(loose["clean"].isNull() | (strict["clean"] == loose["clean"]), True)
            .when(strict["bad"], False)
            .otherwise(subset_match(strict["clean"], loose["clean"]) | (strict["spec"] >= loose["spec"] + 0.7)),
            F.lit(False),
        )

    def accepted(x):
        is_strict, is_loose = x["stage"] == "strict", x["stage"].startswith("loose")
        early = (x["area"] >= EARLY_ACCEPT_AREA) & ~((text(x["label"]) != "") & x["bad"]) & (x["hits"] > 0)
        return is_strict | (~is_loose & early)

    def step(acc, x):
        new = as_attempt(x)
        base = F.when(x["stage"].startswith("loose"), better_baseline(acc["base"], new)).otherwise(acc["base"])

        def settle(b):
            keep_base = (x["stage"] == "strict") & b.isNotNull() & ~refines(new, b)
            take = F.when(
                keep_base,
                F.struct(
                    b["stage"].alias("stage"), b["label"].alias("label"),
                    F.concat_ws("+", F.nullif(b["mode"], F.lit("")), F.lit("prefer_loose_baseline")).alias("mode"),
                    b["area"].alias("area"), b["clean"].alias("clean"), b["bad"].alias("bad"), b["spec"].alias("spec"),
                ).cast(ATTEMPT),
            ).otherwise(new)
            hit = accepted(x)
            return F.struct(
                b.alias("base"), F.when(hit, take).alias("chosen"), new.alias("last"), hit.alias("done")
            )

        return F.when(acc["done"], acc).otherwise(let(base, settle))

    none = F.lit(None).cast(ATTEMPT)
    start = F.struct(none.alias("base"), none.alias("chosen"), none.alias("last"), F.lit(False).alias("done"))
    folded = runs.select(*keys, F.aggregate("runs", start, step).alias("r"))
    # an accepted attempt without a label is no choice
    pick = F.when(text("r.chosen.label") != "", F.col("r.chosen")).otherwise(F.coalesce("r.base", "r.last"))
    return folded.select(*keys, pick.alias("p")).select(
        *keys, F.col("p.stage").alias("stage"), F.col("p.label").alias("label"), F.col("p.mode").alias("mode"),
        F.col("p.area").alias("mask_area_ratio"),
    )


def one_view_per_camera(views: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last view (by ``pos``) of each camera."""
    rest = [c for c in views.columns if c not in (*keys, "cam")]
    order = ["pos", *[c for c in rest if c != "pos"]]
    return views.groupBy(*keys, "cam").agg(F.max(F.struct(*order)).alias("v")).select(
        *keys, "cam", *[F.col(f"v.{c}").alias(c) for c in rest]
    )


def camera_weights(views: DataFrame, anchor: str = "anchor_cam", keys: Sequence[str] = KEYS) -> DataFrame:
    """Vote weight per view: anchor 2, others 1; the closest view counts less if it is very close."""
    dist = F.when(~F.isnan("bbox_gaze_dist_norm"), F.col("bbox_gaze_dist_norm"))
    order = F.struct(dist.alias("d"), (F.col("cam") != F.col(anchor)).alias("o"), "cam_pos", "cam")
    closest = views.groupBy(*keys).agg(F.min(F.when(dist.isNotNull(), order)).getField("cam").alias("closest_cam"))
    base = F.when(F.col("cam") == F.col(anchor), 2.0).otherwise(1.0)
    near = (F.col("cam") == F.col("closest_cam")) & (dist <= CLOSE_DISTANCE)
    return views.join(closest, list(keys)).withColumn(
        "weight", base * F.when(F.coalesce(near, F.lit(False)), CLOSE_DOWNSCALE).otherwise(1.0)
    )


def multiview_vote(weighted: DataFrame, anchor: str = "anchor_cam", same: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Label of the heaviest cluster of views.

    Views come anchor first, then in camera order; each joins the first cluster whose first label it matches, or for
    which ``same`` (an array column of "label||cluster label" texts) holds a recorded yes. Equal weights fall to the
    more specific label, then to the earlier cluster.
    """
    # nothing but the fields of the fold is packed
    item = F.struct((F.col("cam") != F.col(anchor)).alias("o"), "cam_pos", "cam", "label", "weight")
    aggs = [F.sort_array(F.collect_list(item)).alias("items")]
    if same:
        aggs.append(F.first(same).alias("same"))
    packed = weighted.where(text("label") != "").groupBy(*keys).agg(*aggs)
    cluster = "struct<rep:string,labels:array<string>,weight:double>"

    def step(cs, x):
        hits = F.transform(
            cs,
            lambda c: subset_match(x["label"], c["rep"])
            | (F.array_contains("same", F.concat_ws("||", x["label"], c["rep"])) if same else F.lit(False)),
        )

        def place(at):
            grown = F.transform(
                cs,
                lambda c, i: F.when(
                    i == at - 1,
                    F.struct(c["rep"].alias("rep"), _arr_append(c["labels"], x["label"]).alias("labels"),
                             (c["weight"] + x["weight"]).alias("weight")),
                ).otherwise(c),
            )
            fresh = F.struct(x["label"].alias("rep"), F.array(x["label"]).alias("labels"), x["weight"].alias("weight"))
            return F.when(at > 0, grown).otherwise(_arr_append(cs, fresh.cast(cluster)))

        return let(F.array_position(hits, True), place)

    clusters = F.aggregate("items", F.array().cast(f"array<{cluster}>"), step)
    ranked = F.transform(
        clusters,
        lambda c, i: let(
            most_specific(c["labels"]),
            lambda cand: F.struct(
                F.round(c["weight"], 6).alias("w"), specificity(cand).alias("spec"), (-i).alias("first"), cand.alias("label")
            ),
        ),
    )
    return packed.withColumn("best", F.array_max(ranked)).select(
        *keys,
        F.when(F.size("items") == 1, F.col("items")[0]["label"]).otherwise(F.col("best.label")).alias("mv_label"),
        F.when(F.size("items") == 1, "mv_single").otherwise("mv_weighted").alias("mv_mode"),
        F.size("items").alias("mv_views"),
        F.when(F.size("items") > 1, F.col("best.w")).alias("mv_weight"),
    )


def _agrees(label, canon) -> Column:
    return F.coalesce(F.col(label) == F.col(canon), F.lit(False)) | subset_match(label, canon)


def override_decision(views: DataFrame, voted: DataFrame, anchor: str = "anchor_cam", keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether the vote replaces the anchor's own label, and why."""
    clean = sanitize("label")
    j = views.join(voted.select(*keys, "mv_label"), list(keys), "left").withColumn("clean", clean)
    is_anchor = F.col("cam") == F.col(anchor)
    other = ~is_anchor & F.col("clean").isNotNull()
    agree = other & _agrees("clean", "mv_label")
    strong = agree & ~F.lower(text("mode")).contains("mask_small_skip")
    g = j.groupBy(*keys).agg(
        F.max("mv_label").alias("voted"),
        F.max(F.when(is_anchor, F.struct("label", F.lower(text("mode")).alias("mode")))).alias("a"),
        F.count_if(other).alias("others"), F.count_if(agree).alias("agree"), F.count_if(strong).alias("strong"),
    ).withColumns({"al": F.col("a.label"), "mv_label": F.col("voted")})
    locked = ~is_ambiguous("al") & ~F.coalesce(F.col("a.mode").contains("mask_small_skip"), F.lit(False))
    match = F.coalesce(F.col("al") == F.col("mv_label"), F.lit(False)) | subset_match("al", "mv_label")
    reason = (
        F.when(text("mv_label") == "", "mv_missing")
        .when(text("al") == "", "no_anchor")
        .when(match, "anchor_match")
        .when(~locked & (F.col("agree") >= 1), "anchor_uncertain_mv_support")
        .when(~locked, "anchor_uncertain_no_support")
        .when(F.col("strong") >= 2, "mv_strong_consensus")
        .otherwise("mv_consensus_weak")
    )
    yes = ["no_anchor", "anchor_match", "anchor_uncertain_mv_support", "mv_strong_consensus"]
    return g.select(
        *keys, F.col("al").alias("anchor_label"), "mv_label", reason.alias("override_reason")
    ).withColumn("override", F.col("override_reason").isin(*yes))


CUES = ["mask_label", "overlay_label", "refined_label", "dot_label", "dot_overlay_label", "ray_label"]


def confidence(views: DataFrame, canon: str = "canonical", anchor: str = "anchor_cam", pose: str | None = None,
               threshold: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Confidence of the canonical label with its components (C24); frames below ``threshold`` are marked, not kept."""
    cues = [c for c in CUES if c in views.columns]
    hits = sum((F.when((text(c) != "") & _agrees(c, canon), 1).otherwise(0) for c in cues), F.lit(0))
    given = sum((F.when(text(c) != "", 1).otherwise(0) for c in cues), F.lit(0))
    is_anchor = F.col("cam") == F.col(anchor)
    labelled = text("label") != ""
    g = views.groupBy(*keys).agg(
        F.max(canon).alias("__canon"),
        F.count_if(labelled).alias("views"),
        F.count_if(labelled & _agrees("label", canon)).alias("agree"),
        F.max(F.when(is_anchor, F.col("mask_area_ratio"))).alias("area"),
        F.max(F.when(is_anchor & (given > 0), hits / given)).alias("cue"),
        (F.max(pose) if pose else F.lit(None).cast("string")).alias("__pose"),
    ).withColumnsRenamed({"__canon": "canonical", "__pose": "pose"})
    none = (F.col("views") == 0) | (text("canonical") == "")
    spec = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (specificity("canonical") + 1.5) / 6.0))
    parts = g.select(
        *keys, "canonical", "pose",
        F.when(none, 0.0).otherwise(F.col("agree") / F.greatest(F.lit(1), F.col("views"))).alias("consensus"),
        F.when(none, 0.0).otherwise(spec).alias("specificity"),
        mask_quality("area").alias("mask_quality"),
        F.when(none, 0.0).otherwise(F.coalesce("cue", F.lit(0.0))).alias("cue_agreement"),
        F.when(none, 0.0).otherwise(F.least(F.lit(1.0), F.col("views") / 2.0)).alias("view_factor"),
    )
    raw = 0.45 * F.col("consensus") + 0.25 * F.col("specificity") + 0.20 * F.col("mask_quality") + 0.10 * F.col("cue_agreement")
    penal = F.when(F.col("pose") == "NO", 0.6).otherwise(1.0)
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * F.col("view_factor") * penal))
    out = parts.withColumn("confidence", conf)
    return out.withColumn("below_threshold", (F.lit(threshold) > 0) & (F.col("confidence") < threshold))
