"""Decision rules over recorded answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.labels import (
    CONFIDENCE_RANK,
    conf_rank,
    cue_agreement,
    equivalent,
    is_ambiguous,
    relaxed_match,
    safe_reasoning,
    sanitize,
    teacher_valid,
)
from benchspark.functions.text import col, text
from benchspark.operators.rig import hash_order

FRAME = ("split", "seq", "frame_id")

# Cue words of explanations.
SPATIAL_CUES = ["left", "right", "front", "behind", "in front", "back", "occluded", "out of view", "outside"]
VIEW_CUES = ["field of view", "line of sight", "fov", "gaze", "head", "torso", "shoulder", "body"]
CONTRA_NEGATIVE = ["behind", "outside", "out of view", "occluded", "not in front"]
CONTRA_POSITIVE = ["in front", "within", "forward field of view", "line of sight"]
SOFT_POSITIVE = ["visible", "in front", "line of sight", "can see"]
SOFT_NEGATIVE = ["not visible", "behind", "outside", "out of view", "blocked"]


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- task-1 label decisions ----------------------------------------------------------------------------------------

def teacher_final(student: DataFrame, pass1: DataFrame, pass2: DataFrame, strict: bool = True, min_conf: str = "MEDIUM",
                  second_call: bool = True, keys: Sequence[str] = ("frame_key",)) -> DataFrame:
    """Final label from the student and up to two teacher answers.

    A valid first answer replaces the student's label; on a mismatch a valid second one replaces both. In strict mode a
    frame whose needed answer could not be read is dropped. Answer tables hold one row per frame.
    """
    def answers(df, n):
        fields = ["final_label", "confidence", "qwen_verdict", "rationale", "parse_ok"]
        return df.select(*keys, *[F.col(f).alias(f"{f}{n}") for f in fields])

    j = student.join(answers(pass1, 1), list(keys), "left").join(answers(pass2, 2), list(keys), "left")
    j = j.withColumns({"s": sanitize("student_label"), "l1": sanitize("final_label1"), "l2": sanitize("final_label2")})
    both = F.col("s").isNotNull() & F.col("l1").isNotNull()
    j = j.withColumn("mismatch", both & ~equivalent("s", "l1") if second_call else F.lit(False))
    valid1 = _false(teacher_valid("l1", "confidence1", min_conf))
    valid2 = F.col("mismatch") & _false(teacher_valid("l2", "confidence2", min_conf))
    lost1 = ~_false(F.col("parse_ok1"))
    lost2 = F.col("mismatch") & ~_false(F.col("parse_ok2"))
    label = F.when(valid2, F.col("l2")).when(valid1, F.col("l1")).otherwise(F.col("s"))
    drop = F.when(lost1, "pass1_parse_fail").when(lost2, "pass2_parse_fail") if strict else F.lit(None).cast("string")
    chosen = F.when(valid2, "teacher_pass2").when(valid1, "teacher_pass1").otherwise("student_fallback")
    return j.select(
        *keys, "student_label", label.alias("final_label"), chosen.alias("final_source"),
        F.when(valid2, "teacher_pass2_conflict_resolved").when(valid1, "teacher_pass1_valid").otherwise(
            "teacher_invalid_or_low_conf").alias("reason"),
        "mismatch",
        _false(label.isNotNull() & ~F.equal_null(label, F.col("student_label"))).alias("applied"),
        F.when(valid2, F.col("rationale2")).otherwise(F.col("rationale1")).alias("rationale"),
        drop.alias("drop_reason"),
    )


def apply_arbiter(current, proposed, confidence, min_conf: str = "MEDIUM") -> Column:
    """STRUCT(label, applied): the arbiter's label if it is sure enough or the current label is weak."""
    p = sanitize(proposed)
    sure = conf_rank(confidence) >= CONFIDENCE_RANK.index(min_conf)
    take = p.isNotNull() & (sure | is_ambiguous(current))
    return F.struct(F.when(take, p).otherwise(col(current)).alias("label"), take.alias("applied"))


def guardrail_gate(df: DataFrame, min_conf: str = "MEDIUM", scene_check: bool = True) -> DataFrame:
    """Guardrail proposal and refined label applied to the current label, or the reason for which not.

    Reads ``current, dot, ray, allowed`` (array), the guardrail's ``proposed, confidence, decision, scene_fit_current,
    scene_fit_proposed`` and the refined ``refined_label, refined_confidence``.
    """
    p, weak = sanitize("proposed"), is_ambiguous("current")
    sure = conf_rank("confidence") >= CONFIDENCE_RANK.index(min_conf)
    worse = _false((F.upper("scene_fit_current") == "YES") & (F.upper("scene_fit_proposed") == "NO"))
    better = cue_agreement(p, "dot", "ray") > cue_agreement("current", "dot", "ray")
    d = F.upper(F.trim(text("decision")))
    switch = d.startswith("SWITCH") | (d == "REFINE")
    passed = p.isNotNull() & (~worse if scene_check else F.lit(True)) & (sure | weak) & (better | switch | weak)
    j = df.withColumns({"proposed_label": p, "gate_passed": passed, "refined": sanitize("refined_label"), "weak": weak})
    allowed = _false(F.exists("allowed", lambda a: relaxed_match(F.col("refined"), a)))
    reason = (
        F.when(~F.col("gate_passed"), "proposal_gate_fail")
        .when(F.col("refined").isNull(), "qwen_missing_label")
        .when(~allowed, "qwen_no_match")
        .when(~((conf_rank("refined_confidence") >= 1) | F.col("weak")), "qwen_low_conf")
    )
    out = j.withColumn("blocked_reason", reason)
    take = F.col("blocked_reason").isNull() & ~F.equal_null(F.col("refined"), F.col("current"))
    return out.select(
        *df.columns, "proposed_label", "gate_passed", "blocked_reason", take.alias("applied"),
        F.when(take, F.col("refined")).otherwise(F.col("current")).alias("final_label"),
    )


def choose_anchor(attempts: DataFrame, keys: Sequence[str] = FRAME, conf_threshold: float = 0.0) -> DataFrame:
    """Anchor per frame from ranked attempts (E13): the first with a concrete label and no person overlap; an ambiguous
    label is taken only from the last one. Frames without any keep their last failure code.

    One aggregate per frame does it; no attempts are sorted or gathered.
    """
    usable = (text("label") != "") & ~_false(F.col("person_overlap"))
    weak = is_ambiguous("label")
    code = F.when(_false(F.col("person_overlap")), "sam2_overlap_reject").when(text("label") == "", "canonical_fail")
    row = F.struct("anchor_rank", "cam", "label", "confidence")
    g = attempts.groupBy(*keys).agg(
        F.max("anchor_rank").alias("last_rank"),
        F.min(F.when(usable & ~weak, row)).alias("clear"),
        F.max(F.when(usable & weak, row)).alias("vague"),
        F.max_by(code, "anchor_rank").alias("code"),
    )
    vague_last = F.when(F.col("vague.anchor_rank") == F.col("last_rank"), F.col("vague"))
    picked = g.withColumn("p", F.coalesce("clear", vague_last))
    low = (F.lit(conf_threshold) > 0) & (F.col("p.confidence") < conf_threshold)
    return picked.select(
        *keys,
        F.when(~_false(low), F.col("p.cam")).alias("anchor_cam"), F.when(~_false(low), F.col("p.label")).alias("label"),
        F.col("p.anchor_rank").alias("anchor_rank"),
        F.when(_false(low), "conf_below_threshold").when(F.col("p").isNull(), F.coalesce("code", F.lit("canonical_fail"))).alias("fail_code"),
    )


# --- task-4 decisions ----------------------------------------------------------------------------------------------

def verify_visibility(answer="answer", prediction="prediction", presence="presence", person_presence="person_presence",
                      confidence="confidence", parse_ok="parse_ok", strict: bool = True, min_flip: str = "HIGH",
                      reject_uncertain: bool = True) -> Column:
    """STRUCT(answer, action, reject_reason) of a recorded visibility answer against the verifier's.

    The rules run in order; the ones about the prediction see the answer as flipped by the presence rule.
    """
    first, pred = col(answer), F.upper(text(prediction))
    absent = F.upper(text(presence)) == "NOT_PRESENT"
    unread = (
        ~_false(col(parse_ok)) | ~pred.isin("YES", "NO")
        | ~F.upper(text(presence)).isin("PRESENT", "NOT_PRESENT", "UNCLEAR")
        | ~F.upper(text(person_presence)).isin("PRESENT", "NOT_PRESENT", "UNCLEAR")
    )
    no_person = F.upper(text(person_presence)) == "NOT_PRESENT"
    sure = conf_rank(confidence) >= CONFIDENCE_RANK.index(min_flip)
    flips_absent = absent & (first == "YES") & sure
    rejects_absent = absent & (first == "YES") & ~sure & F.lit(reject_uncertain)
    now = F.when(flips_absent, "NO").otherwise(first)
    differs = pred != now

    def out(a, action, reason=None):
        return F.struct(a.alias("answer"), F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reject_reason"))

    none = F.lit(None).cast("string")
    return (
        F.when(unread & F.lit(strict), out(none, "reject", "parse_fail"))
        .when(unread, out(first, "keep_non_strict"))
        .when(no_person, out(none, "reject_person_not_present", "person_not_present"))
        .when(rejects_absent, out(none, "reject", "presence_conflict"))
        .when(absent & (pred == "YES"), out(none, "reject", "presence_prediction_conflict"))
        .when(differs & sure, out(pred, "flip"))
        .when(differs & F.lit(reject_uncertain), out(none, "reject", "uncertain_conflict"))
        .when(differs, out(now, "keep"))
        .when(flips_absent, out(now, "flip_presence_not_present"))
        .otherwise(out(now, "keep"))
    )


def pick_query_cam(cams: DataFrame, variant: str = "visible", seed: int = 42, checks: int = 4, keys: Sequence[str] = FRAME) -> DataFrame:
    """One camera per frame to ask about.

    ``visible``: the person is visible; ``any``: an image is enough; ``object``: the recorded answer says that the
    object is visible, at most ``checks`` cameras are looked at. The preferred camera comes first, the others by hash
    (in camera order behind a preferred one, for ``object``).
    """
    if variant not in ("visible", "any", "object"):
        raise ValueError(f"unknown variant {variant}")
    usable = cams.where("image_path is not null")
    if variant != "any":
        usable = usable.where(_false(F.col("visible")))
    preferred = _false(F.col("cam") == F.col("prefer_cam")) if "prefer_cam" in cams.columns else F.lit(False)
    order = hash_order(seed, *keys, "cam")
    cols = [(~preferred).alias("late"), order.alias("h"), F.col("cam_pos"), F.col("cam")]
    if variant != "object":
        return usable.groupBy(*keys).agg(F.min(F.struct(*cols)).getField("cam").alias("query_cam"))
    one = usable.groupBy(*keys, "cam").agg(
        F.min("cam_pos").alias("cam_pos"), F.max(preferred).alias("pref"), F.max(_false(F.col("object_visible"))).alias("seen")
    )
    item = F.struct((~F.col("pref")).alias("late"), order.alias("h"), "cam_pos", "cam", "seen")
    packed = one.groupBy(*keys).agg(F.collect_list(item).alias("c"), F.max("pref").alias("has_pref"))
    by_cam = F.array_sort(F.transform("c", lambda e: F.struct(e["late"], e["cam_pos"].cast("bigint").alias("o"), e["cam"], e["seen"])))
    by_hash = F.array_sort(F.transform("c", lambda e: F.struct(e["late"], e["h"].alias("o"), e["cam"], e["seen"])))
    tried = F.slice(F.when(F.col("has_pref"), by_cam).otherwise(by_hash), 1, checks)
    first = F.get(F.filter(tried, lambda e: e["seen"]), F.lit(0))
    return packed.select(*keys, first["cam"].alias("query_cam")).where("query_cam is not null")


def sample_views(cams: DataFrame, kmin: int = 2, kmax: int = 6, seed: int = 42, keys: Sequence[str] = FRAME,
                 prefer: str | None = None) -> DataFrame:
    """Between ``kmin`` and ``kmax`` cameras per frame by hash, a preferred camera first."""
    h = hash_order(seed, *keys, "cam")
    pref = _false(F.col("cam") == F.col(prefer)) if prefer else F.lit(False)
    one = cams.groupBy(*keys, "cam").agg(F.max(pref).alias("pref"))
    packed = one.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((~F.col("pref")).alias("late"), h.alias("h"), "cam"))).alias("c")
    )
    n = F.size("c")
    low, high = F.least(F.lit(kmin), n), F.least(F.lit(kmax), n)
    k = (low + F.pmod(hash_order(seed + 1, *keys), (high - low + 1).cast("bigint"))).cast("int")
    return packed.select(*keys, F.posexplode(F.slice("c", F.lit(1), k)).alias("view_pos", "v")).select(
        *keys, "view_pos", F.col("v.cam").alias("cam")
    )


# --- explanations (E11) --------------------------------------------------------------------------------------------

def _any(low: Column, cues: Sequence[str]) -> Column:
    return low.rlike("|".join(cues))


def has_cues(reason) -> Column:
    low = F.lower(text(reason))
    return _any(low, SPATIAL_CUES) & _any(low, VIEW_CUES)


def contradicts(answer, reason) -> Column:
    low = F.lower(text(reason))
    return (low == "") | (_false(col(answer) == "NO") & _any(low, CONTRA_POSITIVE)) | (
        _false(col(answer) == "YES") & _any(low, CONTRA_NEGATIVE)
    )


def soft_verify(answer, reason) -> Column:
    low = F.lower(text(reason))
    pos, neg = _any(low, SOFT_POSITIVE), _any(low, SOFT_NEGATIVE)
    return F.when(low == "", False).when(col(answer) == "YES", pos & ~neg).when(col(answer) == "NO", neg & ~pos).otherwise(False)


def check_reasoning(answer, raw, fallback) -> Column:
    """The model's explanation, or the fallback where it lacks cues or contradicts the answer."""
    reason = safe_reasoning(raw, fallback)
    low = F.lower(reason)
    fb = col(fallback)
    wrong_no = (col(answer) == "NO") & low.rlike("visible|in front")
    wrong_yes = (col(answer) == "YES") & low.rlike("not visible|behind|outside")
    keep = ~_false(wrong_no) & ~_false(wrong_yes) & has_cues(reason) & ~contradicts(answer, reason)
    return F.when(keep, reason).otherwise(fb)
