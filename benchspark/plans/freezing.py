"""Freezing a benchmark into a manifest and reviewing it."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchspark.operators import campaign, review
from benchspark.plans import bindings as b
from benchspark.plans.registry import query
from benchspark.sources import inventory as inv

BENCHMARK = "/data/benchmark.json"


def validated(spark, sf):
    return campaign.validate(b.samples(spark, sf), b.inventory(spark, sf))


def manifest(spark, sf):
    return campaign.manifest_rows(validated(spark, sf), BENCHMARK)


@query("SELECT idx, task_type, reason, len(image_paths) AS images FROM checked", b.FREEZING[:4])
def validate_samples(spark, sf):
    return validated(spark, sf).select("idx", "task_type", "reason", F.size("image_paths").alias("images"))


@query(
    """SELECT idx AS index, reason, CAST(task_id AS VARCHAR) AS raw_task_id, task_type AS raw_task_type, q AS raw_question
FROM checked WHERE reason IS NOT NULL""",
    b.FREEZING[:4],
)
def invalid_samples(spark, sf):
    return campaign.invalid_rows(validated(spark, sf))


@query("SELECT idx, missing FROM gone", b.FREEZING[:3])
def missing_files(spark, sf):
    s = b.samples(spark, sf).select("source", "idx", campaign.image_paths().alias("image_paths"))
    return campaign.missing_files(s, b.inventory(spark, sf)).drop("source")


@query(
    f"""SELECT idx, substr(sha1('{BENCHMARK}' || '||' || task_id || '||' || task_type || '||' || scene_key || '||' || seq
  || '||' || frame || '||' || q), 1, 20) AS sample_uid, task_id, scene_key AS scene, seq, frame, len(image_paths) AS images
FROM frozen""",
    b.FREEZING[:5],
)
def sample_uid(spark, sf):
    return manifest(spark, sf).select(
        "idx", "sample_uid", "task_id", "scene", "seq", "frame", F.size("image_paths").alias("images")
    )


@query("SELECT idx, task_id, list_aggregate(flags, 'string_agg', ';') AS flags FROM flagged WHERE len(flags) > 0", b.FREEZING)
def review_queue(spark, sf):
    m = manifest(spark, sf)
    return m.where(F.size("review_flags") > 0).select("idx", "task_id", F.array_join("review_flags", ";").alias("flags"))


@query(
    """SELECT count(*) FILTER (WHERE reason IS NULL) AS valid_count, count(*) FILTER (WHERE reason IS NOT NULL) AS invalid_count,
  (SELECT count(*) FROM flagged WHERE len(flags) > 0) AS review_queue_count FROM checked""",
    b.FREEZING,
)
def freeze_meta(spark, sf):
    return campaign.freeze_meta(validated(spark, sf))


@query(
    """SELECT page_id, CASE WHEN ok THEN lower(regexp_extract(stem, p, 1)) ELSE 'unknown' END AS scene,
  CASE WHEN ok THEN regexp_extract(stem, p, 2) ELSE 'unknown' END AS seq,
  CASE WHEN ok THEN regexp_extract(stem, p, 3) ELSE 'unknown' END AS frame
FROM (SELECT *, regexp_matches(stem, p) AS ok FROM (SELECT page_id, '^([^_]*)_(.*)_([^_]*)_Cam[0-9]+_raw$' AS p,
  regexp_extract(url, '//([^/?#]*)', 1) || '_' || regexp_replace(regexp_extract(url, '//[^/]*(/[^?#]*)', 1), '/', '_', 'g')
  || '_' || page_id || '_Cam1_raw' AS stem FROM pages))"""
)
def image_key(spark, sf):
    """Host, path and page number stand for scene, sequence and frame."""
    pages = b.table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"//[^/]*(/[^?#]*)", 1), "/", "_")
    name = F.concat(
        F.lit("dir/"), F.regexp_extract("url", r"//([^/?#]*)", 1), F.lit("_"), path, F.lit("_"), F.col("page_id"), F.lit("_Cam1_raw.JPG")
    )
    return pages.select("page_id", campaign.image_key(name).alias("k")).select("page_id", "k.*")


@query(
    """SELECT bundle_id, scene_key AS scene, seq, frame, count(*) AS sample_count,
  count(*) FILTER (WHERE len(flags) > 0) AS flagged_count, min(task_id) AS first_task, max(task_id) AS last_task
FROM flagged GROUP BY ALL""",
    b.FREEZING,
)
def review_items(spark, sf):
    return review.review_items(manifest(spark, sf))


@query(
    """SELECT bundle_id, image_path, arg_min(task_id, (task_id, idx, n)) AS first_task, arg_min(idx, (task_id, idx, n)) AS first_idx
FROM (SELECT bundle_id, task_id, idx, unnest(image_paths) AS image_path, generate_subscripts(image_paths, 1) AS n FROM flagged)
GROUP BY 1, 2""",
    b.FREEZING,
)
def item_images(spark, sf):
    images = review.item_images(manifest(spark, sf))
    return images.select(
        "bundle_id", "image_path", F.col("first_use.task_id").alias("first_task"), F.col("first_use.pos").alias("first_idx")
    )


@query("SELECT bundle_id, idx, task_id, len(flags) AS flags FROM flagged", b.FREEZING)
def item_samples(spark, sf):
    rows = review.item_samples(manifest(spark, sf))
    return rows.select("bundle_id", "idx", "task_id", F.size("review_flags").alias("flags"))


@query(
    """SELECT bundle_id, count(*) AS sample_count, bool_or(len(flags) > 0) AS flagged FROM flagged
GROUP BY 1, scene_key HAVING scene_key = 'hall' AND bool_or(len(flags) > 0)
  AND bool_or(contains(lower(concat_ws(' ', bundle_id, scene_key, seq, frame, task_type, q, a, list_aggregate(flags, 'string_agg', ' '))), 'the'))""",
    b.FREEZING,
)
def filter_items(spark, sf):
    return review.filter_items(manifest(spark, sf), scene="hall", flagged_only=True, search=" The ")


@query(
    """SELECT bundle_id, 'undecided' AS decision FROM (SELECT DISTINCT bundle_id FROM flagged)
ORDER BY bundle_id LIMIT 50 OFFSET 50""",
    b.FREEZING,
)
def decision_page(spark, sf):
    """Second page of the decision template, 50 bundles a page."""
    template = review.decision_template(review.review_items(manifest(spark, sf)))
    return review.page(template, 2, 50).select("bundle_id", "decision")


@query("SELECT bundle_id, decision, reviewer FROM last_decisions", ("decisions", "last_decisions"))
def normalize_decisions(spark, sf):
    return review.normalize_decisions(b.decisions(spark, sf)).select("bundle_id", "decision", "reviewer")


@query(
    """SELECT bundle_id, idx, task_id FROM flagged WHERE bundle_id NOT IN
(SELECT bundle_id FROM last_decisions WHERE decision = 'reject')""",
    b.REVIEW,
)
def apply_review(spark, sf):
    d = review.normalize_decisions(b.decisions(spark, sf))
    return review.apply_review(manifest(spark, sf), d).select("bundle_id", "idx", "task_id")


@query(
    """WITH per AS (SELECT f.bundle_id, count(*) AS n, any_value(d.decision) AS found FROM flagged f
  LEFT JOIN last_decisions d USING (bundle_id) GROUP BY 1)
SELECT count(*) AS bundles_total, count(*) FILTER (WHERE found = 'approve') AS bundles_approved,
  count(*) FILTER (WHERE found = 'reject') AS bundles_rejected,
  count(*) FILTER (WHERE coalesce(found, 'undecided') = 'undecided') AS bundles_undecided,
  count(*) FILTER (WHERE found IS NULL) AS missing_decision_rows,
  count(*) FILTER (WHERE found IS DISTINCT FROM 'reject') AS bundles_kept,
  count(*) FILTER (WHERE found = 'reject') AS bundles_removed, CAST(sum(n) AS BIGINT) AS samples_total,
  CAST(coalesce(sum(n) FILTER (WHERE found IS DISTINCT FROM 'reject'), 0) AS BIGINT) AS samples_kept,
  CAST(coalesce(sum(n) FILTER (WHERE found = 'reject'), 0) AS BIGINT) AS samples_removed FROM per""",
    b.REVIEW,
)
def review_report(spark, sf):
    return review.review_report(manifest(spark, sf), review.normalize_decisions(b.decisions(spark, sf)))


@query(
    """WITH h AS (SELECT CAST('0x' || substr(sha256('{"key":' || o_orderkey || ',"note":' || coalesce('"' || CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus END || '"', 'null')
    || ',"parts":["' || o_orderpriority || '"' || CASE WHEN o_custkey % 2 = 0 THEN ',"' || o_orderstatus || '"' ELSE '' END || ']}'), 1, 15) AS BIGINT) AS h FROM orders)
SELECT count(*) AS row_count, bit_xor(h) AS hash_xor, CAST(sum(h % 1000000007) AS BIGINT) AS hash_sum FROM h"""
)
def table_fingerprint(spark, sf):
    """Orders with a field that is often missing and a list of one or two words."""
    status = F.col("o_orderstatus")
    parts = F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderpriority", status)).otherwise(F.array("o_orderpriority"))
    rows = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_custkey") % 3 > 0, status).alias("note"), parts.alias("parts")
    )
    return inv.fingerprint(rows)
