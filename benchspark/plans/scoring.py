"""Scoring models: accuracy tables, leaderboards, pending work, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchspark.functions.text import half_even_sql, portable_hash, portable_hash_sql
from benchspark.operators import campaign
from benchspark.plans import bindings as b
from benchspark.plans.registry import query



def _share(where: str = "") -> str:
    """Accuracy of the rows that satisfy ``where``, unrounded."""
    more = f" AND {where}" if where else ""
    rows = f" FILTER (WHERE {where})" if where else ""
    return f"count(*) FILTER (WHERE verdict = 'correct'{more}) / nullif(count(*){rows}, 0)::DOUBLE"


RAW = ",\n".join(f"coalesce({_share(f'task_type = {t!r}')}, 0) AS {t}" for t in campaign.TASK_ORDER)
ROUNDED = ",\n".join(f"{half_even_sql(t, 4)} AS {t}" for t in campaign.TASK_ORDER)
MEAN = half_even_sql("(" + " + ".join(campaign.TASK_ORDER) + ") / 4", 4)
SCENE_COLUMNS = ",\n".join(f"{half_even_sql(_share(f'scene = {s!r}'), 4)} AS scene_{s}_accuracy" for s in b.SCENES)
SCORES = f"""scores AS (SELECT *, {MEAN} AS avg_task_accuracy FROM
  (SELECT model_key, correct, total, {half_even_sql('o', 4)} AS overall_accuracy, {ROUNDED} FROM
    (SELECT model_key, {RAW}, {_share()} AS o, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) AS total
     FROM eval_rows GROUP BY model_key)))"""


def cube(spark, sf):
    return campaign.score_cube(b.manifest(spark, sf), b.predictions(spark, sf), b.verdicts(spark, sf))


@query(
    f"""WITH {SCORES}
SELECT model_key, r.label AS model_label, r."group", r.track, overall_accuracy, avg_task_accuracy,
  {', '.join(campaign.TASK_ORDER)}, correct, total,
  row_number() OVER (ORDER BY avg_task_accuracy DESC, r.pos) AS rank
FROM scores JOIN registry r ON r.key = model_key""",
    b.SCORING,
)
def accuracy_table(spark, sf):
    return campaign.accuracy_table(cube(spark, sf), b.registry(spark, sf)).drop("pos")


@query(
    f"""SELECT model_key, scene, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) AS total,
  {half_even_sql(_share(), 4)} AS scene_accuracy
FROM eval_rows GROUP BY model_key, scene""",
    b.SCORING,
)
def scene_accuracy(spark, sf):
    return campaign.scene_accuracy(cube(spark, sf))


LEADERBOARD = f"""WITH {SCORES},
scenes AS (SELECT model_key, {SCENE_COLUMNS} FROM eval_rows GROUP BY model_key)
SELECT model_key, r.label AS model_label, r.model_id, r.engine, r."group", r.track, overall_accuracy,
  avg_task_accuracy, {', '.join(f'scene_{s}_accuracy' for s in b.SCENES)}, correct, total,
  row_number() OVER (ORDER BY avg_task_accuracy DESC, r.pos) AS rank
FROM scores JOIN scenes USING (model_key) JOIN registry r ON r.key = model_key"""


@query(LEADERBOARD, b.SCORING)
def leaderboard(spark, sf):
    return campaign.leaderboard(cube(spark, sf), b.registry(spark, sf), b.SCENES).drop("pos")


EXCLUDED = ["3", "7"]


@query(LEADERBOARD + " WHERE model_key NOT IN ('3', '7')", b.SCORING)
def leaderboard_excluding(spark, sf):
    kept = campaign.without_models(b.registry(spark, sf), EXCLUDED)
    return campaign.leaderboard(cube(spark, sf), kept, b.SCENES).drop("pos")


@query(
    """SELECT sample_uid, model_key, pos, task_type, scene, inference_answer, error, verdict FROM eval_rows""",
    b.SCORING,
)
def eval_rows(spark, sf):
    rows = campaign.eval_rows(b.manifest(spark, sf), b.predictions(spark, sf), b.verdicts(spark, sf))
    return rows.select("sample_uid", "model_key", "pos", "task_type", "scene", "inference_answer", "error", "verdict")


@query(
    """SELECT pos, key AS model_key FROM registry WHERE key NOT IN (SELECT model_key FROM predictions
WHERE error <> '')""",
    b.SCORING[:2] + ("registry",),
)
def missing_models(spark, sf):
    """Suppliers none of whose line items failed stand for the models without rows."""
    failed = b.predictions(spark, sf).where("error <> ''")
    return campaign.missing_models(b.registry(spark, sf), failed)


@query(
    f"""WITH {SCORES},
ranked AS (SELECT model_key, row_number() OVER (ORDER BY avg_task_accuracy DESC, r.pos) AS rank
  FROM scores JOIN registry r ON r.key = model_key)
SELECT (SELECT count(*) FROM ranked) AS table_rows, (SELECT model_key FROM ranked WHERE rank = 1) AS top_model,
  (SELECT count(*) FROM registry WHERE key NOT IN (SELECT model_key FROM predictions)) AS missing_model_count""",
    b.SCORING,
)
def eval_summary(spark, sf):
    reg = b.registry(spark, sf)
    return campaign.eval_summary(campaign.accuracy_table(cube(spark, sf), reg), reg, b.predictions(spark, sf))


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM registry),
drawn AS (SELECT sample_uid, unnest([{portable_hash_sql("'1'", "sample_uid")}, {portable_hash_sql("'2'", "sample_uid")}]) % n AS spot FROM manifest, n),
ranked AS (SELECT key, row_number() OVER (ORDER BY pos) - 1 AS spot FROM registry),
given AS (SELECT sample_uid, key AS model_key FROM drawn JOIN ranked USING (spot) UNION SELECT sample_uid, model_key FROM predictions)
SELECT sample_uid, model_key, task_type, scene FROM manifest JOIN given USING (sample_uid)
WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.sample_uid = manifest.sample_uid AND p.model_key = given.model_key AND p.error = '')""",
    b.SCORING[:2] + ("registry",),
)
def pending_samples(spark, sf):
    """The work list of a campaign over the whole registry: a sample goes to two drawn models and to those that tried it before."""
    models = b.registry(spark, sf).select("pos", F.col("key").alias("model_key"))
    listed = models.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "model_key"))), lambda m: m["model_key"])).scalar()  # a registry's few rows
    m = b.manifest(spark, sf)
    turns = F.explode(F.array(portable_hash(F.lit(1), "sample_uid"), portable_hash(F.lit(2), "sample_uid")))
    drawn = m.select("sample_uid", turns.alias("at")).withColumn("keys", listed).select("sample_uid", F.get("keys", F.pmod("at", F.size("keys")).cast("int")).alias("model_key"))
    given = drawn.union(b.predictions(spark, sf).select("sample_uid", "model_key")).distinct()
    todo = campaign.pending(m.join(given, "sample_uid"), b.predictions(spark, sf), retry_errors=True)
    return todo.select("sample_uid", "model_key", "task_type", "scene")


@query(
    """SELECT model_key, (SELECT count(*) FROM manifest) AS total_manifest_samples, count(*) AS newly_processed,
  count(*) FILTER (WHERE error <> '') AS errors_in_new_rows,
  (SELECT count(*) FROM manifest) - count(DISTINCT sample_uid) AS remaining_unprocessed,
  round(sum(latency_s), 6) AS latency_total_s
FROM predictions GROUP BY model_key""",
    b.SCORING[:2],
)
def run_meta(spark, sf):
    meta = campaign.run_meta(b.manifest(spark, sf), b.predictions(spark, sf))
    return meta.withColumn("latency_total_s", F.round("latency_total_s", 6))


@query(
    """SELECT p.sample_uid, p.model_key, p.pos, m.task_id, m.scene, m.question, m.groundtruth_answer, p.inference_answer
FROM predictions p JOIN manifest m USING (sample_uid)""",
    b.SCORING[:2],
)
def judge_input(spark, sf):
    rows = campaign.judge_input(b.manifest(spark, sf), b.predictions(spark, sf))
    return rows.select(
        "sample_uid", "model_key", "pos", "task_id", "scene", "question", "groundtruth_answer", "inference_answer"
    )


@query(
    """SELECT p.sample_uid, p.model_key, p.pos, CASE WHEN p.inference_answer = '' THEN 'wrong' END AS preset_verdict,
  CASE WHEN p.inference_answer = '' THEN 'missing_prediction' END AS preset_error
FROM predictions p JOIN manifest m USING (sample_uid)
WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.sample_uid = p.sample_uid AND v.model_key = p.model_key)""",
    b.SCORING[:3],
)
def judge_pending(spark, sf):
    rows = campaign.judge_input(b.manifest(spark, sf), b.predictions(spark, sf))
    return campaign.judge_pending(rows, b.verdicts(spark, sf)).select(
        "sample_uid", "model_key", "pos", "preset_verdict", "preset_error"
    )


@query(
    """WITH done AS (SELECT sample_uid, model_key, count(*) FILTER (WHERE error <> '') AS e FROM verdicts GROUP BY 1, 2),
todo AS (SELECT sample_uid, model_key, count(*) AS n FROM predictions JOIN manifest USING (sample_uid) GROUP BY 1, 2)
SELECT model_key, CAST(coalesce(sum(n) FILTER (WHERE e IS NOT NULL), 0) AS BIGINT) AS skipped_existing,
  CAST(coalesce(sum(n) FILTER (WHERE e IS NULL), 0) AS BIGINT) AS judged_new, CAST(coalesce(sum(e), 0) AS BIGINT) AS errors
FROM todo LEFT JOIN done USING (sample_uid, model_key) GROUP BY model_key""",
    b.SCORING[:3],
)
def judge_meta(spark, sf):
    rows = campaign.judge_input(b.manifest(spark, sf), b.predictions(spark, sf))
    return campaign.judge_meta(rows, b.verdicts(spark, sf))


@query(
    """SELECT p.sample_uid, p.model_key, p.pos FROM predictions p LEFT JOIN
(SELECT model_key, min(pos) AS f FROM predictions WHERE error <> '' GROUP BY 1) x USING (model_key)
WHERE x.f IS NULL OR p.pos <= x.f""",
    b.SCORING[:2],
)
def rows_before_stop(spark, sf):
    """Rows of each model up to its first failed one."""
    rows = b.predictions(spark, sf).select("sample_uid", "model_key", "pos", "error")
    return campaign.cut_at_fatal(rows, F.col("error") != "").select("sample_uid", "model_key", "pos")


@query(
    """WITH last AS (SELECT sample_uid, model_key, arg_max(inference_answer, pos) AS a2, arg_max(error, pos) AS e2
  FROM predictions WHERE pos // 4294967296 % 2 = 0 GROUP BY ALL)
SELECT p.sample_uid, p.model_key, p.pos, CASE WHEN error <> '' AND e2 = '' THEN a2 ELSE inference_answer END AS inference_answer,
  CASE WHEN error = '' OR e2 = '' THEN '' WHEN e2 IS NULL THEN error ELSE error || ' | fallback:' || e2 END AS error
FROM predictions p LEFT JOIN last USING (sample_uid, model_key) WHERE pos // 4294967296 % 2 = 1""",
    b.SCORING[:2],
)
def combined_answers(spark, sf):
    """Odd lines are the primary answers, even ones the fallback of the same model and order, several at times."""
    rows = b.predictions(spark, sf).withColumns({c: F.lit(0) for c in ("tokens_in", "tokens_out")})
    odd = F.floor(F.col("pos") / F.lit(1 << 32)) % 2 == 1
    return campaign.combine_answers(rows.where(odd), rows.where(~odd)).select("sample_uid", "model_key", "pos", "inference_answer", "error")


@query(
    """SELECT pos, key AS model_key, label, track, "group" FROM registry
WHERE include_in_default_lists AND track IN ('B', 'A+B')""",
    ("registry",),
)
def registry_select(spark, sf):
    picked = campaign.models_for_track(b.registry(spark, sf), "b")
    return picked.select("pos", F.col("key").alias("model_key"), "label", "track", "group")


@query(
    """SELECT r.pos, r.key AS model_key, coalesce(n.n_name, r.label) AS label,
  CASE WHEN n.n_name IS NOT NULL THEN 'vllm' ELSE r.engine END AS engine
FROM registry r LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = r.key""",
    ("registry",),
)
def registry_overrides(spark, sf):
    patch = b.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("label"), F.lit("vllm").alias("engine")
    )
    patched = campaign.apply_overrides(b.registry(spark, sf), patch)
    return patched.select("pos", F.col("key").alias("model_key"), "label", "engine")


@query(
    """WITH specs AS (SELECT CAST(s_suppkey AS VARCHAR) AS model_key, count(DISTINCT s_nationkey % 5) AS spec_count
  FROM supplier GROUP BY 1),
src AS (SELECT CAST(l_suppkey AS VARCHAR) AS model_key, count(DISTINCT l_linestatus || l_returnflag) AS source_count
  FROM lineitem GROUP BY 1)
SELECT coalesce(specs.model_key, src.model_key) AS model_key, coalesce(spec_count, 0) AS spec_count,
  coalesce(source_count, 0) AS source_count
FROM specs FULL JOIN src ON specs.model_key = src.model_key
WHERE coalesce(spec_count, 0) > 1 OR coalesce(source_count, 0) > 1"""
)
def merge_checks(spark, sf):
    """Suppliers stand for models, (line status, return flag) for campaigns."""
    reg = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("key"), (F.col("s_nationkey") % 5).alias("spec"), F.lit("a").alias("source")
    )
    preds = (
        b.table(spark, sf, "lineitem")
        .select(F.col("l_suppkey").cast("string").alias("model_key"), F.concat("l_linestatus", "l_returnflag").alias("source"))
    )
    return campaign.merge_conflicts(reg, preds)
