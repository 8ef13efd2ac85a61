"""Human review of a manifest by frame bundle.

A bundle is the set of samples of one frame. Its samples and images stay rows (ordered by a position), never one
nested list, so a bundle of any size is handled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.text import lower_strip, strip, text

# Decision words. Anything else is undecided.
APPROVE_WORDS = ["approve", "approved", "accept", "accepted", "yes", "y", "1", "true"]
REJECT_WORDS = ["reject", "rejected", "drop", "no", "n", "0", "false"]


def bundle_id(scene="scene", seq="seq", frame="frame") -> Column:
    """``scene||seq||frame`` with blanks as ``unknown``."""

    def part(c, lower=False):
        clean = lower_strip(text(c)) if lower else strip(text(c))
        return F.when(clean == "", "unknown").otherwise(clean)

    return F.concat_ws("||", part(scene, lower=True), part(seq), part(frame))


def review_items(manifest: DataFrame) -> DataFrame:
    """One row per bundle: keys, sample and flag counts, tasks present."""
    flagged = F.size("review_flags") > 0
    b = manifest.withColumn("bundle_id", bundle_id())
    parts = F.split("bundle_id", r"\|\|")
    # text with the separator inside a part cannot be taken apart again
    three = F.size(parts) == 3
    named = [F.when(three, parts[i]).otherwise("unknown").alias(n) for i, n in enumerate(("scene", "seq", "frame"))]
    return (
        b.groupBy("bundle_id")
        .agg(
            F.count("*").alias("sample_count"),
            F.count_if(flagged).alias("flagged_count"),
            F.min("task_id").alias("first_task"),
            F.max("task_id").alias("last_task"),
        )
        .select("bundle_id", *named, "sample_count", "flagged_count", "first_task", "last_task")
    )


def item_samples(manifest: DataFrame, pos: str = "idx") -> DataFrame:
    """Samples with their bundle; order within a bundle is (task_id, pos)."""
    return manifest.select(
        bundle_id().alias("bundle_id"), "task_id", pos, "sample_uid", "task_type", "question", "groundtruth_answer", "review_flags"
    )


def item_images(manifest: DataFrame, pos: str = "idx") -> DataFrame:
    """Distinct images per bundle with the place of their first use (task, sample, image)."""
    uses = manifest.select(
        bundle_id().alias("bundle_id"), "task_id", F.col(pos).alias("pos"), F.posexplode("image_paths").alias("n", "image_path")
    )
    return uses.groupBy("bundle_id", "image_path").agg(F.min(F.struct("task_id", "pos", "n")).alias("first_use"))


def decision_template(items: DataFrame) -> DataFrame:
    """One undecided row per bundle."""
    blank = [F.lit("").alias(c) for c in ("note", "reviewer", "updated_at")]
    return items.select("bundle_id", F.lit("undecided").alias("decision"), *blank)


def filter_items(
    manifest: DataFrame, scene: str | None = None, flagged_only: bool = False, search: str = ""
) -> DataFrame:
    """Bundles of a scene, with flags, or whose bundle or sample text contains ``search``."""
    needle = search.strip().lower()
    rows = manifest.withColumn("bundle_id", bundle_id())
    sample_text = F.concat_ws(
        " ", "bundle_id", "scene", "seq", "frame", "task_type", "question", "groundtruth_answer",
        F.array_join("review_flags", " "),
    )
    hit = F.lower(sample_text).contains(needle) if needle else F.lit(True)
    picked = rows.groupBy("bundle_id").agg(
        F.count("*").alias("sample_count"),
        F.max(F.size("review_flags") > 0).alias("flagged"),
        F.max(hit).alias("hit"),
    )
    keep = F.col("hit")
    if flagged_only:
        keep = keep & F.col("flagged")
    if scene:
        keep = keep & (F.split("bundle_id", r"\|\|")[0] == scene)
    return picked.where(keep).select("bundle_id", "sample_count", "flagged")


def page(items: DataFrame, number: int, size: int = 200) -> DataFrame:
    """Rows of one page, 1-based, in bundle order."""
    return items.orderBy("bundle_id").offset((number - 1) * size).limit(size)


def normalize_decision(c) -> Column:
    low = lower_strip(text(c))
    return (
        F.when(low.isin(*APPROVE_WORDS), "approve").when(low.isin(*REJECT_WORDS), "reject").otherwise("undecided")
    )


def normalize_decisions(decisions: DataFrame, pos: str = "pos") -> DataFrame:
    """Last decision per bundle."""
    fields = [normalize_decision("decision").alias("decision")] + [
        text(c).alias(c) for c in ("note", "reviewer", "updated_at") if c in decisions.columns
    ]
    names = ["decision"] + [c for c in ("note", "reviewer", "updated_at") if c in decisions.columns]
    rows = decisions.select(strip(text("bundle_id")).alias("bundle_id"), F.col(pos).alias("pos"), *fields)
    last = rows.where("bundle_id <> ''").groupBy("bundle_id").agg(F.max(F.struct("pos", *names)).alias("d"))
    return last.select("bundle_id", *[F.col(f"d.{n}").alias(n) for n in names])


def apply_review(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manifest without the rejected bundles (H15); ``decisions`` from ``normalize_decisions``."""
    rejected = decisions.where("decision = 'reject'").select("bundle_id")
    return manifest.withColumn("bundle_id", bundle_id()).join(rejected, "bundle_id", "left_anti")


def review_report(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """Bundle and sample counts of a review (H16); samples are counted per bundle before the join."""
    bundles = manifest.groupBy(bundle_id().alias("bundle_id")).agg(F.count("*").alias("n"))
    d = bundles.join(decisions.select("bundle_id", F.col("decision").alias("found")), "bundle_id", "left")
    decision = F.coalesce(F.col("found"), F.lit("undecided"))
    rejected = decision == "reject"
    return d.agg(
        F.count("*").alias("bundles_total"),
        F.count_if(decision == "approve").alias("bundles_approved"),
        F.count_if(rejected).alias("bundles_rejected"),
        F.count_if(decision == "undecided").alias("bundles_undecided"),
        F.count_if(F.col("found").isNull()).alias("missing_decision_rows"),
        F.count_if(~rejected).alias("bundles_kept"),
        F.count_if(rejected).alias("bundles_removed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples_total"),
        F.coalesce(F.sum(F.when(~rejected, F.col("n"))), F.lit(0)).alias("samples_kept"),
        F.coalesce(F.sum(F.when(rejected, F.col("n"))), F.lit(0)).alias("samples_removed"),
    )
