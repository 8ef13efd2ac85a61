"""Freezing ground truth and scoring models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benchspark.functions.text import (
    accuracy,
    base_name,
    first_word,
    half_even,
    in_words,
    last_word,
    let,
    lower_strip,
    more_words_than,
    strip,
    text,
)

# Task ids, their types and the order of the accuracy columns.
TASK_TYPES = {
    1: "gaze_target_recognition",
    2: "relative_orientation_reasoning",
    3: "cross_view_visibility_estimation",
    4: "viewpoint_based_accessibility",
}
TASK_ORDER = list(TASK_TYPES.values())

# Words that mark an answer for review.
PREPOSITIONS = ["in", "on", "at", "with", "of", "to", "from", "near", "by", "for"]
HUMAN_WORDS = ["person", "man", "woman", "boy", "girl", "people"]

# Fixed value: models left out of the second set of tables unless the caller says otherwise.
DEFAULT_EXCLUDED = ["gemini30flash"]

# Fixed values: (key, label, group, track, model id, engine, fallback engine, gpus, prompt mode, chat template, listed).
MODELS = [
    ("gpt41", "GPT-4.1", "proprietary", "A", "gpt-4.1", "openai_api", "", 1, None, None, True),
    ("gpt4o", "GPT-4o", "proprietary", "A", "gpt-4o", "openai_api", "", 1, None, None, True),
    ("gemini20flash", "Gemini-2.0-Flash", "proprietary", "A", "gemini-2.0-flash", "gemini_api", "", 1, None, None, True),
    ("gemini25flash", "Gemini-2.5-Flash", "proprietary", "A", "gemini-2.5-flash", "gemini_api", "", 1, None, None, True),
    ("gemini30flash", "Gemini-3-Flash-Preview", "proprietary", "A", "gemini-3-flash-preview", "gemini_api", "", 1, None, None, True),
    ("gemini25pro", "Gemini-2.5-Pro", "proprietary", "A", "gemini-2.5-pro", "gemini_api", "", 1, None, None, True),
    ("gemini30pro", "Gemini-3-Pro-Preview", "proprietary", "A", "gemini-3-pro-preview", "gemini_api", "", 1, None, None, True),
    ("geminiflashlatest", "Gemini-Flash-Latest (legacy alias)", "proprietary", "A", "gemini-2.5-flash", "gemini_api", "", 1, None, None, False),
    ("gemini31propreview", "Gemini-3.1-Pro-Preview (legacy alias)", "proprietary", "A", "gemini-3.1-pro-preview", "gemini_api", "", 1, None, None, False),
    ("qwen3vl_alias", "Qwen3-VL (paper alias)", "open-source", "A", "Qwen/Qwen2.5-VL-7B-Instruct", "sglang", "vllm", 1, "image_multi", None, True),
    ("internvl25", "InternVL2.5", "open-source", "A", "OpenGVLab/InternVL2_5-8B", "vllm", "sglang", 1, "image_multi", None, True),
    ("deepseekvl2", "DeepSeek-VL2", "open-source", "A", "deepseek-ai/deepseek-vl2", "sglang", "vllm", 1, "image_multi", None, True),
    ("llava_video_7b", "LLaVA-Video-7B", "open-source", "A+B", "lmms-lab/LLaVA-Video-7B-Qwen2", "sglang", "vllm", 1, "video_synth", None, True),
    ("llava_ov_7b", "LLaVA-OneVision-7B", "open-source", "A+B", "lmms-lab/llava-onevision-qwen2-7b-ov", "sglang", "vllm", 1, "image_multi", None, True),
    ("llava_video_72b", "LLaVA-Video-72B", "expansion", "B", "lmms-lab/LLaVA-Video-72B-Qwen2", "sglang", "vllm", 4, "video_synth", None, True),
    ("llava_ov_72b", "LLaVA-OneVision-72B", "expansion", "B", "lmms-lab/llava-onevision-qwen2-72b-ov-sft", "sglang", "vllm", 4, "image_multi", None, True),
    ("llava_next_8b", "LLaVA-NeXT-8B", "expansion", "B", "lmms-lab/llama3-llava-next-8b", "sglang", "vllm", 1, "image_multi", "chatml-llava", True),
    ("llava_next_32b", "LLaVA-NeXT-32B", "expansion", "B", "lmms-lab/llava-next-qwen-32b", "sglang", "vllm", 2, "image_multi", "chatml-llava", True),
]
REGISTRY = (
    "pos bigint, key string, label string, `group` string, track string, model_id string, engine string, "
    "engine_fallback string, tensor_parallel_size int, gpus int, max_new_tokens int, temperature double, "
    "top_p double, extra map<string,string>, include_in_default_lists boolean"
)


# --- model registry (H18) ----------------------------------------------------------------------------------------

def default_registry(spark: SparkSession) -> DataFrame:
    rows = []
    for pos, (key, label, group, track, model_id, engine, fallback, gpus, mode, template, listed) in enumerate(MODELS):
        extra = {k: v for k, v in (("prompt_mode", mode), ("chat_template", template)) if v}
        rows.append((pos, key, label, group, track, model_id, engine, fallback, gpus, gpus, 256, 0.0, 1.0, extra, listed))
    return spark.createDataFrame(rows, REGISTRY)


def models_for_track(registry: DataFrame, track: str) -> DataFrame:
    """Listed models of track A or B; ``A+B`` belongs to both."""
    t = track.upper().strip()
    if t not in ("A", "B"):
        raise ValueError(f"Unsupported track: {track}")
    return registry.where(F.col("include_in_default_lists") & F.col("track").isin(t, "A+B"))


def models_for_group(registry: DataFrame, group: str) -> DataFrame:
    """Listed models of ``proprietary``, ``oss`` (open-source and expansion) or ``all``."""
    g = group.strip().lower()
    members = {"proprietary": ["proprietary"], "oss": ["open-source", "expansion"], "all": None}
    if g not in members:
        raise ValueError(f"Unsupported group: {group}")
    listed = registry.where("include_in_default_lists")
    return listed if members[g] is None else listed.where(F.col("group").isin(*members[g]))


def apply_overrides(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """Patch registry rows by key; ``extra`` is merged key by key, other columns are replaced where given."""
    given = [c for c in registry.columns if c in overrides.columns and c != "key"]
    patch = overrides.select("key", *[F.col(c).alias(f"__{c}") for c in given])
    joined = registry.join(patch, "key", "left")

    def merged(c: str) -> Column:
        if c not in given:
            return F.col(c)
        if c == "extra":
            old = F.map_filter("extra", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("__extra"), k), F.lit(False)))
            return F.when(F.col("__extra").isNull(), F.col("extra")).otherwise(F.map_concat(old, F.col("__extra"))).alias(c)
        return F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c)

    return joined.select(*[merged(c) for c in registry.columns])


# --- freezing a benchmark into a manifest (H1-H8) ----------------------------------------------------------------

def image_key(path) -> Column:
    """Scene, sequence and frame from ``<scene>_<seq...>_<frame>_Cam<k>_raw[.jpg]`` (H3)."""
    stem = F.regexp_replace(base_name(path), r"(?i)\.jpg$", "")
    pattern = r"(?i)^([^_]*)_(?:(.*)_)?([^_]*)_cam\d+_raw$"
    parts = F.size(F.split(stem, "_"))
    ok = stem.rlike(pattern) & (parts >= 5)
    seq = F.regexp_extract(stem, pattern, 2)
    unknown = F.lit("unknown")
    return F.struct(
        F.when(ok, F.lower(F.regexp_extract(stem, pattern, 1))).otherwise(unknown).alias("scene"),
        F.when(ok, seq).otherwise(unknown).alias("seq"),
        F.when(ok, F.regexp_extract(stem, pattern, 3)).otherwise(unknown).alias("frame"),
    )


def image_paths(images="input_images") -> Column:
    """Non-blank image paths (H4)."""
    return F.filter(
        F.transform(F.coalesce(F.col(images), F.array()), lambda i: strip(text(i.getField("image")))), lambda p: p != ""
    )


def camera_ids(images="input_images", cams="input_cams") -> Column:
    """Non-blank cameras of the images, else the listed cameras (H4)."""
    named = F.filter(
        F.transform(F.coalesce(F.col(images), F.array()), lambda i: strip(text(i.getField("cam")))), lambda p: p != ""
    )
    return F.when(F.size(named) > 0, named).otherwise(F.coalesce(F.col(cams), F.array().cast("array<string>")))


def row_keys(samples: DataFrame) -> list[str]:
    """Columns that name a sample: its file where several are read, and its place in it."""
    return [c for c in ("source", "idx") if c in samples.columns]


def missing_files(samples: DataFrame, inventory: DataFrame, paths: str = "image_paths") -> DataFrame:
    """Number of image paths per sample that the inventory does not hold; samples without any are absent (H2).

    The inventory is made unique first, so the anti join keeps a row per (sample, path) and a path shared by very
    many samples is split by the adaptive skew rule on the sample side.
    """
    keys = row_keys(samples)
    known = inventory.select(F.col("path").alias("known")).distinct()
    used = samples.select(*keys, F.explode(paths).alias("used"))
    gone = used.join(known, F.col("used") == F.col("known"), "left_anti")
    return gone.groupBy(*keys).agg(F.count("*").alias("missing"))


def review_flags(task_id="task_id", question="question", answer="answer") -> Column:
    """Names of the checks that a sample trips (H6)."""
    task1 = F.coalesce(F.col(task_id) == 1, F.lit(False))

    def flags(ql, a):
        odd = ql.contains("person with wearing") | ql.endswith(" with") | ql.endswith(" wearing")
        return F.array_compact(
            F.array(
                F.when(ql == "", "missing_question"),
                F.when(a == "", "missing_answer"),
                F.when((F.length(a) <= 3) & (a != ""), "short_answer"),
                F.when(in_words(F.lower(last_word(a)), PREPOSITIONS), "trailing_preposition"),
                F.when(task1 & odd, "weird_task1_question"),
                F.when(task1 & in_words(F.lower(first_word(a)), HUMAN_WORDS), "task1_human_label"),
                F.when(task1 & more_words_than(a, 6), "task1_long_label"),
            )
        )

    return let(strip(text(answer)), lambda a: let(lower_strip(text(question)), lambda ql: flags(ql, a)))


def sample_uid(*parts) -> Column:
    """First 20 hex digits of the SHA-1 of the trimmed parts joined by ``||`` (H5)."""
    return F.substring(F.sha1(F.concat_ws("||", *[strip(text(p)) for p in parts])), 1, 20)


def _prepared(samples: DataFrame) -> DataFrame:
    task_name = F.create_map(*[F.lit(x) for pair in TASK_TYPES.items() for x in pair])
    return samples.select(
        *row_keys(samples),
        F.col("is_object") if "is_object" in samples.columns else F.lit(True).alias("is_object"),
        "task_id",
        (F.col("raw_task_id") if "raw_task_id" in samples.columns else F.col("task_id").cast("string")).alias("raw_task_id"),
        strip(
            F.coalesce(
                F.nullif(F.col("task_type"), F.lit("")), F.try_element_at(task_name, F.col("task_id")), F.lit("unknown")
            )
        ).alias("task_type"),
        strip(text("question")).alias("question"),
        strip(text("answer")).alias("answer"),
        lower_strip(text("scene")).alias("scene"),
        image_paths().alias("image_paths"),
        camera_ids().alias("camera_ids"),
    )


def validate(samples: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Samples with the first reason for which they cannot be used, or NULL (H1).

    Without an inventory, image files are not looked for.
    """
    prepared = _prepared(samples)
    if inventory is not None:
        prepared = prepared.join(missing_files(prepared, inventory), row_keys(prepared), "left")
    else:
        prepared = prepared.withColumn("missing", F.lit(None).cast("bigint"))
    reason = (
        F.when(~F.col("is_object"), "sample_not_object")
        .when(F.col("task_id").isNull(), "invalid_task_id")
        .when(F.size("image_paths") == 0, "missing_input_images")
        .when(F.col("missing") > 0, F.concat(F.lit("missing_image_files:"), F.col("missing").cast("string")))
    )
    return prepared.withColumn("reason", reason)


def invalid_rows(validated: DataFrame) -> DataFrame:
    keep = F.col("is_object")
    return validated.where("reason is not null").select(
        F.col("idx").alias("index"),
        "reason",
        F.when(keep, F.col("raw_task_id")).alias("raw_task_id"),
        F.when(keep, F.col("task_type")).alias("raw_task_type"),
        F.when(keep, F.col("question")).alias("raw_question"),
    )


def manifest_rows(validated: DataFrame, benchmark_path: str) -> DataFrame:
    """Valid samples as manifest rows; the benchmark path is part of the uid."""
    keyed = validated.where("reason is null").withColumn("k", image_key(F.get("image_paths", F.lit(0))))
    unknown = F.lit("unknown")
    scene = F.coalesce(F.nullif(F.col("scene"), F.lit("")), F.nullif(F.col("k.scene"), F.lit("")), unknown)
    with_keys = keyed.select(
        "idx", "task_id", "task_type", scene.alias("scene"), F.col("k.seq").alias("seq"), F.col("k.frame").alias("frame"),
        "question", F.col("answer").alias("groundtruth_answer"), "image_paths", "camera_ids",
    )
    return with_keys.select(
        "idx",
        sample_uid(F.lit(benchmark_path), "task_id", "task_type", "scene", "seq", "frame", "question").alias("sample_uid"),
        "task_id", "task_type", "scene", "seq", "frame", "question", "groundtruth_answer", "image_paths", "camera_ids",
        F.lit(benchmark_path).alias("source_benchmark"),
        review_flags(answer="groundtruth_answer").alias("review_flags"),
    )


def review_queue(manifest: DataFrame) -> DataFrame:
    """Flagged rows with their flags joined by ``;`` (H7)."""
    return manifest.where(F.size("review_flags") > 0).select(
        "sample_uid", "task_id", "task_type", "scene", "seq", "frame", "question", "groundtruth_answer",
        F.array_join("review_flags", ";").alias("review_flags"),
    )


def freeze_meta(validated: DataFrame) -> DataFrame:
    """Counts of one freeze in a single pass (H8); table hashes come from ``sources.inventory.fingerprint``."""
    ok = F.col("reason").isNull()
    return validated.agg(
        F.count_if(ok).alias("valid_count"),
        F.count_if(~ok).alias("invalid_count"),
        F.count_if(ok & (F.size(review_flags()) > 0)).alias("review_queue_count"),
    )


# --- answers and verdicts (H19-H26) ------------------------------------------------------------------------------

def pending(
    manifest: DataFrame, predictions: DataFrame, reset: bool = False, retry_errors: bool = False, models: DataFrame | None = None
) -> DataFrame:
    """Samples that have no answer yet; rows with errors count as answered unless ``retry_errors``.

    With ``models`` (unique ``model_key``, a registry's few rows) the work list is each sample for each model, and a sample
    is done for the model that answered it only. A manifest that has ``model_key`` itself is such a list. Without either,
    ``predictions`` must be those of one model.
    """
    todo = manifest.where(F.coalesce(F.col("sample_uid"), F.lit("")) != "")
    if models is not None:
        keys = models.agg(F.array_sort(F.collect_set("model_key")).alias("ks")).scalar()
        todo = todo.withColumn("model_key", F.explode(keys))
    key = ["sample_uid", "model_key"] if "model_key" in todo.columns else ["sample_uid"]
    if reset:
        return todo
    done = predictions.where(text("error") == "") if retry_errors else predictions
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def combine_answers(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Answer of the primary engine, else of the fallback; both errors are kept when both fail.

    Rows meet on sample and, where both sides have it, model. Of several fallback rows of a key the one of the highest
    ``pos`` counts, or of the highest answer where there is no ``pos``, so no primary row is multiplied.
    """
    values = ["inference_answer", "tokens_in", "tokens_out", "error"]
    keys = ["sample_uid"] + ["model_key"] * ("model_key" in primary.columns and "model_key" in fallback.columns)
    last = F.max_by(F.struct(*values), "pos") if "pos" in fallback.columns else F.max(F.struct(*values))
    fb = fallback.groupBy(*keys).agg(last.alias("f")).select(*keys, F.lit(True).alias("fb"), *[F.col(f"f.{v}").alias(f"fb_{v}") for v in values])
    j = primary.join(fb, keys, "left")
    failed = text("error") != ""
    use_fb = failed & F.coalesce(F.col("fb"), F.lit(False)) & (text("fb_error") == "")
    both = failed & F.coalesce(F.col("fb"), F.lit(False)) & ~use_fb
    answer = F.when(use_fb, text("fb_inference_answer")).otherwise(text("inference_answer"))
    error = (
        F.when(use_fb, F.lit(""))
        .when(both, F.concat(text("error"), F.lit(" | fallback:"), text("fb_error")))
        .otherwise(text("error"))
    )
    picked = j.select(
        *[F.col(c) for c in primary.columns if c not in values],
        answer.alias("inference_answer"),
        *[
            F.coalesce(F.when(use_fb, F.col(f"fb_{v}")).otherwise(F.col(v)), F.lit(0)).alias(v)
            for v in ("tokens_in", "tokens_out")
        ],
        error.alias("error"),
    )
    blank = (F.col("inference_answer") == "") & (F.col("error") == "")
    return picked.withColumn("error", F.when(blank, "empty_answer").otherwise(F.col("error")))


def cut_at_fatal(rows: DataFrame, fatal: Column, pos: str = "pos", keys: Sequence[str] = ("model_key",)) -> DataFrame:
    """Rows up to and including the first fatal error of each model.

    The first fatal position is a small aggregate per model joined back, so no model's rows are sorted together.
    """
    first = rows.where(fatal).groupBy(*keys).agg(F.min(pos).alias("first_fatal"))
    return rows.join(first, list(keys), "left").where(F.col("first_fatal").isNull() | (F.col(pos) <= F.col("first_fatal")))


def run_meta(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per model: manifest size, new rows, rows with an error, samples left, total latency."""
    total = manifest.agg(F.count("*")).scalar()
    per_sample = predictions.groupBy("model_key", "sample_uid").agg(
        F.count("*").alias("n"),
        F.count_if(text("error") != "").alias("e"),
        F.sum("latency_s").alias("t"),
    )
    return per_sample.groupBy("model_key").agg(
        F.sum("n").alias("newly_processed"),
        F.sum("e").alias("errors_in_new_rows"),
        F.count("*").alias("samples_done"),
        F.sum("t").alias("latency_total_s"),
    ).select(
        "model_key",
        total.alias("total_manifest_samples"),
        "newly_processed",
        "errors_in_new_rows",
        F.greatest(F.lit(0), total - F.col("samples_done")).alias("remaining_unprocessed"),
        "latency_total_s",
    )


def judge_input(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions with their ground truth; unknown uids are dropped."""
    truth = manifest.select("sample_uid", "task_id", "task_type", "scene", "question", "groundtruth_answer")
    extra = [c for c in ("pos",) if c in predictions.columns]
    answers = predictions.select(
        "sample_uid", *extra, *[text(c).alias(c) for c in ("inference_answer", "model_key", "model_id", "error")]
    )
    return answers.join(truth, "sample_uid")


def judge_pending(judge_rows: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Rows still to be judged; a blank answer is marked wrong at once."""
    todo = judge_rows.where(text("sample_uid") != "")
    if verdicts is not None:
        todo = todo.join(verdicts.select("sample_uid", "model_key").distinct(), ["sample_uid", "model_key"], "left_anti")
    blank = strip(text("inference_answer")) == ""
    return todo.withColumn("preset_verdict", F.when(blank, "wrong")).withColumn(
        "preset_error", F.when(blank, "missing_prediction")
    )


def judge_meta(judge_rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per model how many rows are skipped as judged and how many are left, and errors so far.

    Answers and verdicts go through one aggregate by (uid, model) instead of a join of two. It holds all pairs of its
    partition, so the number of partitions is given: short keys look small to a rule that merges partitions by their bytes.
    """
    parts = int(judge_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["sample_uid", "model_key"]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    answers = judge_rows.select(*keys, one.alias("n"), none.alias("marks"), none.alias("e"))
    marks = verdicts.where(F.col("sample_uid").isNotNull() & F.col("model_key").isNotNull()).select(
        *keys, none.alias("n"), one.alias("marks"), F.when(text("error") != "", one).otherwise(none).alias("e")
    )
    pairs = answers.unionByName(marks).repartition(parts, *keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "marks", "e")])
    judged = F.col("marks") > 0
    return pairs.where("n > 0").groupBy("model_key").agg(
        F.coalesce(F.sum(F.when(judged, F.col("n"))), F.lit(0)).alias("skipped_existing"),
        F.coalesce(F.sum(F.when(~judged, F.col("n"))), F.lit(0)).alias("judged_new"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("errors"),
    )


def latest_verdicts(verdicts: DataFrame, pos: str = "pos") -> DataFrame:
    """Last verdict per sample and model."""
    verdict = lower_strip(text("gemini_judge"))
    return (
        verdicts.where(text("sample_uid") != "")
        .groupBy("sample_uid", "model_key")
        .agg(F.max(F.struct(F.col(pos), verdict.alias("verdict"))).getField("verdict").alias("verdict"))
    )


def latest_manifest(manifest: DataFrame, pos: str = "pos") -> DataFrame:
    """Last manifest row per uid: the highest ``pos``, then the highest content; without ``pos`` the highest content."""
    others = [c for c in manifest.columns if c not in ("sample_uid", pos)]
    order = [F.col(pos).alias("__pos")] if pos in manifest.columns else []
    return manifest.groupBy("sample_uid").agg(F.max(F.struct(*order, *others)).alias("m")).select(
        "sample_uid", *[F.col(f"m.{c}").alias(c) for c in others]
    )


def eval_rows(manifest: DataFrame, predictions: DataFrame, verdicts: DataFrame, verdict_pos: str = "pos") -> DataFrame:
    """Every prediction found in the manifest with its verdict, or the empty text without one.

    Of several manifest rows of a uid the last one counts. Both joins have a unique right side, so a uid with very
    many predictions is only ever split, never multiplied.
    """
    latest = latest_verdicts(verdicts, verdict_pos)
    rows = judge_input(latest_manifest(manifest), predictions).join(latest, ["sample_uid", "model_key"], "left")
    return rows.withColumn("verdict", text("verdict"))


def score_cube(manifest: DataFrame, predictions: DataFrame, verdicts: DataFrame, verdict_pos: str = "pos") -> DataFrame:
    """Right and total answers per (model, task type, scene): all that the accuracy tables need.

    Predictions and verdicts go through one aggregate by (uid, model), which collapses a hot uid on the map side;
    only that narrow result meets the manifest.
    """
    keys = ["sample_uid", "model_key"]
    answers = predictions.select(*keys, F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("p"), F.lit(False).alias("ok"))
    marks = verdicts.select(
        *keys, F.lit(0).alias("n"), F.col(verdict_pos).cast("bigint").alias("p"),
        (lower_strip(text("gemini_judge")) == "correct").alias("ok"),
    )
    pairs = answers.unionByName(marks).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.coalesce(F.max_by("ok", "p"), F.lit(False)).alias("ok")
    )
    known = [c for c in ("pos",) if c in manifest.columns]
    truth = latest_manifest(manifest.select("sample_uid", "task_type", "scene", *known))
    return (
        pairs.where("n > 0")
        .join(truth, "sample_uid")
        .groupBy("model_key", "task_type", "scene")
        .agg(F.sum("n").alias("total"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("correct"))
    )


# --- tables (H27-H32) --------------------------------------------------------------------------------------------

def model_scores(cube: DataFrame, scenes: Sequence[str] = ()) -> DataFrame:
    """Per model in one aggregate: overall accuracy, four task accuracies, their mean over four, counts, and one column
    per scene (NULL where the scene has no answers)."""

    def share(here: Column) -> Column:
        return accuracy(F.sum(F.when(here, F.col("correct"))), F.sum(F.when(here, F.col("total"))))

    per_task = [F.coalesce(share(F.col("task_type") == t), F.lit(0.0)).alias(t) for t in TASK_ORDER]
    names = [f"scene_{s}_accuracy" for s in scenes]
    per_scene = [
        F.when(F.max(F.col("scene") == s), share(F.col("scene") == s)).alias(n) for s, n in zip(scenes, names)
    ]
    sums = cube.groupBy("model_key").agg(*per_task, *per_scene, F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    mean = sum((F.col(t) for t in TASK_ORDER[1:]), F.col(TASK_ORDER[0])) / len(TASK_ORDER)
    return sums.select(
        "model_key",
        accuracy("correct", "total").alias("overall_accuracy"),
        half_even(mean, 4).alias("avg_task_accuracy"),
        *TASK_ORDER,
        *names,
        "correct",
        "total",
    )


def _with_rank(table: DataFrame) -> DataFrame:
    """1..N by mean accuracy, ties in registry order. One row per registered model, so one small window numbers them."""
    place = F.row_number().over(W.orderBy(F.col("avg_task_accuracy").desc(), "pos"))
    return table.withColumn("rank", place.cast("bigint"))


def accuracy_table(cube: DataFrame, registry: DataFrame) -> DataFrame:
    """Ranked accuracy per registered model that has answers."""
    models = registry.select("pos", F.col("key").alias("model_key"), F.col("label").alias("model_label"), "group", "track")
    return _with_rank(model_scores(cube).join(models, "model_key"))


def scene_accuracy(cube: DataFrame) -> DataFrame:
    """Accuracy per model and scene as rows (H28); ``model_scores`` has them as columns."""
    long = cube.groupBy("model_key", "scene").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return long.withColumn("scene_accuracy", accuracy("correct", "total"))


def leaderboard(cube: DataFrame, registry: DataFrame, scenes: Sequence[str]) -> DataFrame:
    """One wide row per model: registry fields, accuracies, scene columns, rank."""
    models = registry.select(
        "pos", F.col("key").alias("model_key"), F.col("label").alias("model_label"), "model_id", "engine", "group", "track"
    )
    return _with_rank(models.join(model_scores(cube, scenes).drop(*TASK_ORDER), "model_key"))


def without_models(registry: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Registry without the given keys; tables built from it are ranked afresh (H31). An empty list excludes none."""
    drop = [k.strip() for k in excluded if k.strip()]
    return registry.where(~F.col("key").isin(*drop)) if drop else registry


def missing_models(registry: DataFrame, predictions: DataFrame) -> DataFrame:
    """Registered models without a single prediction."""
    seen = predictions.select(F.col("model_key").alias("key")).distinct()
    return registry.join(seen, "key", "left_anti").select("pos", F.col("key").alias("model_key"))


def eval_summary(table: DataFrame, registry: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: rows in the table, missing models, top model."""
    missing = missing_models(registry, predictions).agg(F.count("*")).scalar()
    return table.agg(
        F.count("*").alias("table_rows"),
        F.max(F.when(F.col("rank") == 1, F.col("model_key"))).alias("top_model"),
    ).withColumn("missing_model_count", missing)


# --- merging campaigns (H33, H34) --------------------------------------------------------------------------------

def merge_conflicts(registries: DataFrame, predictions: DataFrame) -> DataFrame:
    """Model keys with more than one spec or more than one prediction source.

    ``registries`` and ``predictions`` carry a ``source`` column naming the campaign.
    """
    spec_cols = sorted(c for c in registries.columns if c not in ("source", "pos", "key"))
    spec = F.xxhash64(F.to_json(F.struct(*spec_cols)))
    specs = registries.groupBy(F.col("key").alias("model_key")).agg(F.count_distinct(spec).alias("spec_count"))
    sources = predictions.groupBy("model_key").agg(F.count_distinct("source").alias("source_count"))
    both = specs.join(sources, "model_key", "full")
    return both.where((F.coalesce("spec_count", F.lit(0)) > 1) | (F.coalesce("source_count", F.lit(0)) > 1)).select(
        "model_key",
        F.coalesce("spec_count", F.lit(0)).alias("spec_count"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
    )


def check_merge(campaigns: dict[str, dict[str, DataFrame]], strict_manifest: bool = True) -> None:
    """Raise unless the campaigns can be merged. Each holds ``manifest``, ``registry`` and ``predictions``.

    Runs jobs, but only counts, fingerprints and at most one offending row reach the driver.
    """
    from benchspark.sources.inventory import fingerprint

    if len(campaigns) < 2:
        raise ValueError("merging needs at least two source campaigns")
    if strict_manifest:
        prints = {name: tuple(fingerprint(c["manifest"]).first()) for name, c in campaigns.items()}
        if len(set(prints.values())) != 1:
            raise ValueError(f"Manifest mismatch across campaigns: {prints}")
    registries, predictions = _with_source(campaigns, "registry"), _with_source(campaigns, "predictions")
    bad = merge_conflicts(registries, predictions).orderBy("model_key").first()
    if bad is not None:
        what = "Conflicting model entries" if bad["spec_count"] > 1 else "Duplicate prediction sources"
        raise ValueError(f"{what} for model_key '{bad['model_key']}'")
    if predictions.isEmpty():
        raise ValueError("No predictions found across source campaigns.")


def _with_source(campaigns: dict[str, dict[str, DataFrame]], table: str) -> DataFrame:
    frames = [c[table].withColumn("source", F.lit(name)) for name, c in campaigns.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_campaigns(campaigns: dict[str, dict[str, DataFrame]], strict_manifest: bool = True) -> dict[str, DataFrame]:
    """Checked union of campaigns: first manifest, one registry, all predictions and verdicts with their source."""
    check_merge(campaigns, strict_manifest)
    order = {name: i for i, name in enumerate(campaigns)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("source")]
    registries = _with_source(campaigns, "registry").withColumn("place", F.struct(rank.alias("c"), F.col("pos")))
    first = registries.groupBy("key").agg(F.min_by(F.struct(*registries.columns), "place").alias("r")).select("r.*")
    registry = first.withColumn("pos", F.col("place.c") * F.lit(1 << 32) + F.col("pos")).drop("place", "source")
    return {
        "manifest": next(iter(campaigns.values()))["manifest"],
        "registry": registry,
        "predictions": _with_source(campaigns, "predictions"),
        "verdicts": _with_source(campaigns, "verdicts"),
    }
