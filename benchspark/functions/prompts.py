"""Question, prompt and reasoning texts of the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchspark.functions.labels import first_two_sentences, person_ref
from benchspark.functions.text import base_name, col, let, lower_strip, text

# Texts that samples and calls carry word for word.
TASK2_QUESTION = (
    "Two images show the same person from Camera 1 and Camera 2.\n"
    "Camera 1 is the first image. Camera 2 is the second image.\n\n"
    "Your task is to estimate Camera 2's rotation relative to Camera 1, based only on how the person's visible orientation "
    "changes across the two views.\n"
    "1. Infer the body-facing direction in each image (describe qualitatively).\n"
    "2. Based on the difference, estimate how many degrees Camera 2 is rotated around the person relative to Camera 1 "
    "(roughly 0–180°).\n"
    "3. State whether Camera 2 is clockwise or counterclockwise relative to Camera 1.\n\n"
    "Output format:\n"
    "Camera 1 view: <your description>\n"
    "Camera 2 view: <your description>\n"
    "Relative rotation: <~N° clockwise/counterclockwise>\n"
    "Do not rely on background or lighting; use only the visible body orientation."
)
JUDGE_HEAD = (
    "You are a strict evaluator for semantic equivalence of short answers.\n"
    "Decide if the model answer means the same as the groundtruth, allowing paraphrase, synonyms, and minor wording "
    "differences.\n"
    "Mark as wrong if the model misses key objects/relations, contradicts, adds incorrect facts, answers 'I am not sure', "
    "or is off-topic.\n"
    "Respond with only one token: 'correct' or 'wrong'. No explanation.\n\n"
)
OUTSIDE_SUMMARY = " is looking at something outside these multi-view images."


def cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def task1_question(person) -> Column:
    return cat("Using all camera views, what is ", person_ref(person), " looking at?")


def task2_question() -> Column:
    return F.lit(TASK2_QUESTION)


def task3_question(person, label) -> Column:
    return cat(
        "The gaze target is '", lower_strip(text(label)), "'. For each camera view, is it visible to ",
        F.lower(person_ref(person)), "? Answer YES/NO per view.",
    )


def task4_question(cam, label, person) -> Column:
    return cat(
        "In ", col(cam), ", can ", person_ref(person), " see the '", col(label),
        "' from their line of sight? Answer YES or NO and explain briefly using front/behind/occlusion.",
    )


def inference_prompt(cams="camera_ids", paths="image_paths", frame="frame", task_type="task_type", question="question") -> Column:
    """Prompt text of one manifest row: image list by camera, or by file name without cameras."""

    def lines(values, tail):
        return F.array_join(
            F.transform(values, lambda v, i: F.concat(F.lit("- Image "), (i + 1).cast("string"), F.lit(": "), tail(v))), "\n"
        )

    by_cam = lines(F.col(cams), lambda v: F.concat(v, F.lit(" (frame "), F.coalesce(frame, F.lit("unknown")), F.lit(")")))
    by_path = lines(F.coalesce(paths, F.array().cast("array<string>")), base_name)
    section = F.when(F.size(cams) > 0, by_cam).otherwise(by_path)
    return cat(
        "Image order and camera IDs:\n", section, "\n\nTask type: ", F.coalesce(task_type, F.lit("unknown")),
        "\nQuestion: ", F.coalesce(question, F.lit("N/A")), "\n\nRespond in no more than three sentences.",
    )


def judge_prompt(task_type="task_type", question="question", truth="groundtruth_answer", answer="inference_answer") -> Column:
    """Prompt text with which a judge marks one answer."""

    def given(c, other):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))

    return cat(
        JUDGE_HEAD, "Task type: ", given(task_type, "N/A"), "\nQuestion: ", given(question, "N/A"),
        "\nGroundtruth answer: ", given(truth, ""), "\nModel answer: ", given(answer, ""), "\nYour verdict:",
    )


def task1_reasoning(cam, gaze_x, gaze_y, area, anchor_label, label, ray_available, notes: dict[str, Column] | None = None) -> Column:
    """Task-1 reasoning from recorded facts (C29); ``notes`` add "<who>: <rationale>" in order, two sentences kept."""
    gaze = F.when(
        col(gaze_x).isNotNull() & col(gaze_y).isNotNull(), F.format_string("gaze point (%.1f, %.1f)", col(gaze_x), col(gaze_y))
    ).otherwise("gaze point")
    mask = F.when(col(area).isNotNull(), F.format_string("mask area ratio=%.4f", col(area))).otherwise("mask area ratio=N/A")
    anchor, final, camera = col(anchor_label), col(label), col(cam)
    no_ray = ", no valid person bbox is available for a gaze ray, so labeling uses dot/mask evidence"
    differs = F.coalesce(F.nullif(anchor, F.lit("")) != F.nullif(final, F.lit("")), F.lit(False))
    falls = cat("In ", camera, ", the ", gaze, " falls on the segmented mask labeled '")
    out = (
        F.when(
            differs & col(ray_available),
            cat(falls, anchor, "'. Across visible cameras, the majority label is '", final, "'. ", mask, "."),
        )
        .when(
            differs,
            cat("In ", camera, no_ray, ". The segmented mask is '", anchor, "', and cross-view synthesis selects '", final,
                "'. ", mask, "."),
        )
        .when(
            col(ray_available),
            cat(falls, final, "'. The gaze ray from head/eye aligns with that region, and the label is assigned from the mask. ",
                mask, "."),
        )
        .otherwise(cat("In ", camera, no_ray, " around the gaze point for '", final, "'. ", mask, "."))
    )
    for who, why in (notes or {}).items():
        short = F.nullif(first_two_sentences(why), F.lit(""))

        def add(base, who=who, short=short):
            return F.when(short.isNull(), base).otherwise(
                F.coalesce(F.nullif(first_two_sentences(cat(base, f" {who}: ", short, ".")), F.lit("")), base)
            )

        out = let(out, add)
    return out


def task4_reasoning(answer, label, person, cam) -> Column:
    """Reasoning text stated from the recorded visibility."""
    return F.when(
        col(answer) == "YES",
        cat("In ", col(cam), ", the ", col(label), " is within the sight of ", person_ref(person),
            " in this view, so it is physically visible to them."),
    ).otherwise(
        cat("In ", col(cam), ", the ", col(label), " is outside the sight of ", person_ref(person),
            " in this view (e.g., behind, occluded, or out of view), so they cannot physically see it.")
    )


def task4_fallback(answer, label, gaze_target) -> Column:
    """Explanation used where a model's explanation does not hold."""
    obj, yes = lower_strip(text(label)), col(answer) == "YES"
    head = "Given the person's head/torso direction, "
    with_target = cat(
        head, "they are looking toward the ", lower_strip(text(gaze_target)), ", so the queried object '", obj,
        F.when(yes, "' lies in front and within their forward field of view.").otherwise(
            "' is behind or to the side and outside their forward field of view."
        ),
    )
    without = cat(
        head, "the object '", obj, "' is ", F.when(yes, "in front of").otherwise("not in front of"), " the person and ",
        F.when(yes, "within").otherwise("outside"), " their forward field of view.",
    )
    return F.when(text(gaze_target) != "", with_target).otherwise(without)
