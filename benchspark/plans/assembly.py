"""Sampling, quotas, bundles and run accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchspark.functions.text import portable_hash_sql
from benchspark.operators import assemble
from benchspark.plans import bindings as b
from benchspark.plans.registry import query
from benchspark.session import shared_dir
from benchspark.sources import files
from benchspark.sources.json_ranges import read_head


@query(
    """SELECT split, seq, turn FROM (SELECT lang AS split, doc_id AS seq, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id)
  AS turn FROM documents) WHERE split IN ('en', 'fr', 'de')"""
)
def split_ranks(spark, sf):
    """Rank within a split by text length; slots are (length, run of numbers), so no split or length sits in one task."""
    from benchspark.operators.ranking import global_rank, position_slot

    seqs = b.table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("seq"), "n_chars")
    kept = assemble.filter_splits(seqs, [" EN", "fr", "De"])
    ranked = global_rank(
        kept, order=[F.col("n_chars"), F.col("seq")], slots=[F.col("n_chars"), position_slot("seq")], within=["split"], name="turn"
    )
    return ranked.select("split", "seq", "turn")


@query(
    f"""SELECT lang AS split, doc_id AS seq, row_number() OVER (PARTITION BY lang ORDER BY {portable_hash_sql("'42'", "lang", "doc_id")}, doc_id) AS turn
FROM documents ORDER BY turn, split"""
)
def interleave(spark, sf):
    """Sequences in hash order, one split after the other."""
    seqs = b.table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("seq"))
    return assemble.interleave(seqs).orderBy("turn", "split")


@query("SELECT split, max(turn) AS last_turn, count(DISTINCT turn) AS turns FROM (SELECT lang AS split, row_number() OVER (PARTITION BY lang) AS turn FROM documents) GROUP BY 1")
def interleave_turns(spark, sf):
    """Every split gets the turns 1..n once each."""
    seqs = b.table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("seq"))
    ranked = assemble.interleave(seqs)
    return ranked.groupBy("split").agg(F.max("turn").alias("last_turn"), F.count_distinct("turn").alias("turns"))


TARGET = 130


@query(
    f"""WITH ranked AS (SELECT doc_id AS pos, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
SELECT split, pos FROM ranked WHERE rn <= ceil({TARGET} / 4.0) ORDER BY pos LIMIT {TARGET}"""
)
def balanced_quota(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("pos"))
    return assemble.select_balanced(docs, TARGET, 4)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40")
def capped(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "n_chars", (-F.col("n_chars")).alias("o"))
    return assemble.cap(docs, 40, ["o", "doc_id"]).select("doc_id", "n_chars")


def turns(spark, sf):
    """Conversation turns as task samples: the conversation is the frame, the turn number gives the task."""
    c = b.table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("bundle_key"),
        (F.col("turn") % 4 + 1).cast("int").alias("task_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.col("role").alias("split"),
    )


TURNS = """turns AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS bundle_key, CAST(turn % 4 + 1 AS INTEGER) AS task_id,
  conv_id * 1000 + turn AS pos, role AS split FROM conversations)"""
STATUS = f"""{TURNS}, status AS (SELECT bundle_key, bool_or(task_id = 1) AS has1, bool_or(task_id = 2) AS has2,
  bool_or(task_id = 3) AS has3, bool_or(task_id = 4) AS has4 FROM turns GROUP BY 1)"""
FIRST = "CASE WHEN NOT has1 THEN 1 WHEN NOT has2 THEN 2 WHEN NOT has3 THEN 3 WHEN NOT has4 THEN 4 END"


def unique_turns(spark, sf):
    return turns(spark, sf).distinct()


@query(f"WITH {STATUS} SELECT *, {FIRST} AS first_missing FROM status")
def first_missing(spark, sf):
    return assemble.bundle_status(unique_turns(spark, sf))


@query(f"WITH {STATUS} SELECT bundle_key, task_id, pos FROM turns WHERE bundle_key IN (SELECT bundle_key FROM status WHERE {FIRST} IS NULL)")
def bundles(spark, sf):
    return assemble.complete_bundles(unique_turns(spark, sf)).select("bundle_key", "task_id", "pos")


@query(
    f"""WITH {STATUS} SELECT count(*) AS attempted, count(*) FILTER (WHERE f IS NULL) AS accepted,
  count(*) FILTER (WHERE f IS NOT NULL) AS skipped, round(count(*) FILTER (WHERE f IS NOT NULL) / count(*), 9) AS skip_rate,
  {', '.join(f'count(*) FILTER (WHERE f = {t}) AS first_failed_task{t}' for t in (1, 2, 3, 4))}
FROM (SELECT {FIRST} AS f FROM status)"""
)
def skip_stats(spark, sf):
    s = assemble.bundle_skip_stats(assemble.bundle_status(unique_turns(spark, sf)))
    return s.withColumn("skip_rate", F.round("skip_rate", 9))


PARTIAL = {1: 40, 2: 25, 3: 30, 4: 9}


@query(
    f"""WITH {TURNS}, ok AS (SELECT * FROM turns WHERE task_id < 3
  OR bundle_key IN (SELECT bundle_key FROM turns WHERE task_id = 1)),
capped AS (SELECT *, row_number() OVER (PARTITION BY task_id, split ORDER BY pos) AS rn FROM ok),
kept AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS g FROM capped WHERE rn <= CASE task_id
  WHEN 1 THEN 14 WHEN 2 THEN 9 WHEN 3 THEN 10 ELSE 3 END)
SELECT bundle_key, task_id, split, pos FROM kept WHERE g <= CASE task_id WHEN 1 THEN 40 WHEN 2 THEN 25 WHEN 3 THEN 30 ELSE 9 END"""
)
def partial_quota(spark, sf):
    kept = assemble.select_partial(unique_turns(spark, sf), PARTIAL, 3)
    return kept.select("bundle_key", "task_id", "split", "pos")


@query(
    """SELECT DISTINCT conv_id AS frame FROM conversations
WHERE CAST(conv_id AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""
)
def pending_frames(spark, sf):
    frames = b.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("bundle_key"), "conv_id").distinct()
    accepted = b.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("bundle_key"))
    return assemble.pending_frames(frames, accepted).select(F.col("conv_id").alias("frame"))


@query(
    f"""WITH {TURNS}, n AS (SELECT 'task' || task_id AS counter, count(*) AS n FROM turns GROUP BY 1
  UNION ALL SELECT 'bundle', count(*) FROM (SELECT bundle_key FROM turns UNION SELECT CAST(doc_id AS VARCHAR) FROM labels)
  UNION ALL SELECT 'task' || CAST(quality + 1 AS INTEGER), count(*) * 3 FROM labels GROUP BY 1)
SELECT counter, max(n) AS n FROM n GROUP BY 1"""
)
def recover_counts(spark, sf):
    """Stored counts stand at three times the labels per quality."""
    labels = b.table(spark, sf, "labels")
    state = labels.groupBy(F.concat(F.lit("task"), (F.col("quality") + 1).cast("string")).alias("counter")).agg((F.count("*") * 3).alias("n"))
    logged = labels.select(F.col("doc_id").cast("string").alias("bundle_key"))
    return assemble.recover_counts(unique_turns(spark, sf), logged, state)


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY n DESC, reason LIMIT 3")
def reject_report(spark, sf):
    rejects = b.table(spark, sf, "events").where("event_type <> 'view'").withColumnRenamed("event_type", "reason")
    return assemble.reject_report(rejects, top=3)


@query(
    """SELECT count(*) AS frames_seen, count(*) FILTER (WHERE event_type <> 'error') AS usable,
  count(*) FILTER (WHERE event_type = 'purchase') AS accepted,
  round(count(*) FILTER (WHERE event_type = 'purchase') / greatest(1, count(*) FILTER (WHERE event_type <> 'error')), 9) AS rate,
  count(*) >= 250 AND count(*) FILTER (WHERE event_type = 'purchase') / greatest(1, count(*) FILTER (WHERE event_type <> 'error')) < 0.4 AS warn
FROM (SELECT * FROM events ORDER BY event_id LIMIT 250)"""
)
def early_warning(spark, sf):
    frames = b.table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), (F.col("event_type") != "error").alias("usable"), (F.col("event_type") == "purchase").alias("accepted")
    )
    return assemble.early_warning(frames, rate=0.4).withColumn("rate", F.round("rate", 9))


SNAPSHOTS = """r AS (SELECT pos, accepted, sum(accepted::INT) OVER w AS total_accepts, count(*) FILTER (WHERE accepted AND task_id = 1) OVER w AS task1,
  count(*) FILTER (WHERE accepted AND task_id = 2) OVER w AS task2, count(*) FILTER (WHERE accepted AND task_id = 3) OVER w AS task3,
  count(*) FILTER (WHERE accepted AND task_id = 4) OVER w AS task4, count(*) FILTER (WHERE NOT accepted) OVER w AS rejects
  FROM s WINDOW w AS (ORDER BY pos ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, list(pos) OVER (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS latest FROM r WHERE accepted)"""


@query(
    f"""WITH s AS (SELECT event_id AS pos, user_id % 4 + 1 AS task_id, event_type = 'purchase' AS accepted FROM events WHERE event_type IN ('purchase', 'error')), {SNAPSHOTS}
SELECT pos, CAST(total_accepts AS BIGINT) AS total_accepts, task1, task2, task3, task4, rejects, array_to_string(list_reverse(latest), ',') AS last_samples FROM a WHERE total_accepts % 5 = 0"""
)
def progress(spark, sf):
    """Purchases are accepted samples, errors rejects: counts of both and the last five samples at every fifth sample."""
    e = b.table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") % 4 + 1).cast("int").alias("task_id"), "event_type")
    shots = assemble.progress(e.where("event_type = 'purchase'"), 5, rejects=e.where("event_type = 'error'"), last=5)
    return shots.withColumn("last_samples", F.array_join("last_samples", ","))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 5")
def last_samples(spark, sf):
    s = b.table(spark, sf, "events").select("event_id", "user_id")
    return assemble.last_samples(s, pos="event_id")


def calls(spark, sf):
    """Events as model calls: the type gives provider and model, the user the frame, value and props the tokens."""
    kind = F.col("event_type")
    return b.table(spark, sf, "events").select(
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("f"), F.col("user_id"))).alias("frame_key"),
        F.when(kind.isin("view", "click"), "openai").when(kind == "error", "local").otherwise("gemini").alias("provider"),
        F.when(kind == "view", "GPT-4o-mini-x ").when(kind == "click", "gpt-4o").otherwise("other").alias("model"),
        F.floor("value").cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") / 3).cast("bigint").alias("output_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("cached_input_tokens"),
        F.when(kind == "signup", F.floor("value").cast("bigint") + 7).alias("total_tokens"),
    )


@query(
    """WITH c AS (SELECT CASE WHEN user_id % 10 <> 0 THEN 'f' || user_id ELSE 'NO_FRAME_CONTEXT' END AS frame_key, event_type AS t,
  CAST(floor(value) AS BIGINT) AS i, CAST(floor(value / 3) AS BIGINT) AS o, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
d AS (SELECT *, greatest(i - k, 0) AS billed, CASE t
  WHEN 'view' THEN (greatest(i - k, 0) * 0.15::DOUBLE + k * 0.075::DOUBLE + o * 0.60::DOUBLE) / 1000000
  WHEN 'click' THEN (greatest(i - k, 0) * 2.5::DOUBLE + k * 1.25::DOUBLE + o * 10.0::DOUBLE) / 1000000
  WHEN 'error' THEN 0::DOUBLE ELSE (i * 0.30::DOUBLE + o * 2.50::DOUBLE) / 1000000 END AS cost FROM c)
SELECT frame_key, grouping(frame_key) = 1 AS is_total, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens,
  CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(k) AS BIGINT) AS cached_input_tokens, CAST(sum(billed) AS BIGINT) AS billed_input_tokens,
  CAST(sum(CASE WHEN t = 'signup' THEN i + 7 ELSE i + o END) AS BIGINT) AS total_tokens, round(sum(cost), 10) AS cost_usd_estimate
FROM d GROUP BY ROLLUP (frame_key)"""
)
def usage_cost(spark, sf):
    return assemble.usage_report(calls(spark, sf))


def errors(spark, sf):
    """Events as error records; user number modulo five is the task (0 is unknown)."""
    return b.table(spark, sf, "events").select(
        (F.col("user_id") % 5).cast("int").alias("task_id"),
        F.col("event_type").alias("stage"),
        F.when(F.col("value") > 10, "quota").otherwise("").alias("error_type"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k").cast("int") % 3).alias("model"),
    )


ERRORS = """e AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE CAST(user_id % 5 AS VARCHAR) END AS task, event_type AS stage,
  CASE WHEN value > 10 THEN 'quota' ELSE 'unknown' END AS type, 'm' || CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS model FROM events)"""
ERROR_SUMMARY = f"""WITH {ERRORS} SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM e UNION ALL
SELECT 'task', task, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'stage', stage, count(*) FROM e GROUP BY 2 UNION ALL
SELECT 'type', type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'model', model, count(*) FROM e GROUP BY 2"""


@query(ERROR_SUMMARY)
def error_summary(spark, sf):
    return assemble.error_summary(errors(spark, sf))


def _records(spark, sf):
    e = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), "event_type", "user_id", k.alias("k"),
        (k % 3 != 0).alias("parse_ok"), (k % 4).alias("retry_count"),
        F.when(k % 2 == 0, " stop ").when(k % 5 == 0, "MAX_TOKENS").alias("finish_reason"),
        F.when(k % 7 == 0, "JSON").otherwise("plain").alias("mode"),
        F.when(k % 6 == 0, "m-b").otherwise("m-a").alias("model"), F.lit("M-A").alias("model_requested"),
    )


REC = """r AS (SELECT event_id AS id, event_type, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
c AS (SELECT *, k % 3 <> 0 AS ok, CASE WHEN k % 2 = 0 THEN 'STOP' WHEN k % 5 = 0 THEN 'MAX_TOKENS' END AS fr,
  CASE WHEN k % 7 = 0 THEN 'json' ELSE 'plain' END AS mode, CASE WHEN k % 6 = 0 THEN 'm-b' ELSE 'm-a' END AS model,
  CASE WHEN k % 6 = 0 THEN 'M-A -> m-b' END AS fb, CASE WHEN event_type IN ('view', 'click') THEN 'task1_teacher'
  WHEN event_type = 'purchase' THEN 'task4_verifier' END AS section FROM r)"""


@query(
    f"""WITH {REC}, t AS (SELECT user_id, bool_or(k > 50) AS applied, bool_or(k <= 50) AS fb FROM c WHERE section = 'task1_teacher' GROUP BY 1)
SELECT 'task1_teacher' AS section, 'totals' AS counter, 'samples' AS value, count(*) AS n FROM t UNION ALL
SELECT 'task1_teacher', 'totals', 'applied', count(*) FILTER (WHERE applied) FROM t UNION ALL
SELECT 'task1_teacher', 'totals', 'student_fallback', count(*) FILTER (WHERE fb) FROM t UNION ALL
SELECT section, 'totals', 'parse_attempts', count(*) FROM c WHERE section = 'task1_teacher' GROUP BY 1 UNION ALL
SELECT section, 'totals', 'samples', count(*) FROM c WHERE section = 'task4_verifier' GROUP BY 1 UNION ALL
SELECT section, 'totals', 'parse_success', count(*) FILTER (WHERE ok) FROM c WHERE section IS NOT NULL GROUP BY 1 UNION ALL
SELECT section, 'totals', 'partial_retry_calls', count(*) FILTER (WHERE k % 4 > 0) FROM c WHERE section IS NOT NULL GROUP BY 1 UNION ALL
SELECT section, 'finish_reasons', fr, count(*) FROM c WHERE section IS NOT NULL AND fr IS NOT NULL GROUP BY 1, 3 UNION ALL
SELECT section, 'modes', mode, count(*) FROM c WHERE section IS NOT NULL GROUP BY 1, 3 UNION ALL
SELECT section, 'models_used', model, count(*) FROM c WHERE section IS NOT NULL GROUP BY 1, 3 UNION ALL
SELECT section, 'model_fallback_usage', fb, count(*) FROM c WHERE section IS NOT NULL AND fb IS NOT NULL GROUP BY 1, 3 UNION ALL
SELECT section, 'actions', CASE WHEN k > 80 THEN 'flip' ELSE 'keep' END, count(*) FROM c WHERE section = 'task4_verifier' GROUP BY 1, 3 UNION ALL
SELECT section, 'presence', 'PRESENT', count(*) FROM c WHERE section = 'task4_verifier' GROUP BY 1 UNION ALL
SELECT section, 'person_presence', 'UNCLEAR', count(*) FROM c WHERE section = 'task4_verifier' GROUP BY 1"""
)
def stage_summary(spark, sf):
    """Views and clicks stand for teacher passes of a user's sample, purchases for verifier answers."""
    r = _records(spark, sf)
    passes = r.where("event_type IN ('view', 'click')").select(
        F.col("user_id").alias("sample_id"), (F.col("k") > 50).alias("applied"),
        F.when(F.col("k") <= 50, "student_fallback").otherwise("teacher_pass1").alias("final_source"),
        "parse_ok", "retry_count", "finish_reason", "mode", "model", "model_requested",
    )
    verifiers = r.where("event_type = 'purchase'").select(
        "parse_ok", F.lit("yes").alias("prediction"), "retry_count", F.when(F.col("k") > 80, "Flip").otherwise("keep").alias("action"),
        F.lit("present").alias("presence"), F.lit("unclear ").alias("person_presence"), "finish_reason", "mode", "model", "model_requested",
    )
    return assemble.teacher_verifier_summary(passes, verifiers)


@query(
    """SELECT count(*) AS samples, count(*) FILTER (WHERE l_linenumber % 4 = 1) AS task1, count(*) FILTER (WHERE l_linenumber % 4 = 2) AS task2,
  count(*) FILTER (WHERE l_linenumber % 4 = 3) AS task3, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS task4 FROM lineitem"""
)
def assembled_meta(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("bundle_key"), F.when(F.col("l_linenumber") % 4 == 0, 4).otherwise(F.col("l_linenumber") % 4).alias("task_id")
    )
    return assemble.assemble(rows)["meta"]


@query(
    """SELECT doc_id, substr(md5('doc|' || source || '|' || doc_id), 1, 12) AS object_id FROM documents"""
)
def object_ids(spark, sf):
    from benchspark.functions.text import stable_id

    return b.table(spark, sf, "documents").select("doc_id", stable_id(F.lit("doc"), "source", "doc_id").alias("object_id"))


def assembled(spark, sf) -> str:
    """Line items as a benchmark document: flags are reject reasons, ship modes frame outcomes; returns its folder."""
    lines = b.table(spark, sf, "lineitem")
    task = F.when(F.col("l_linenumber") % 4 == 0, 4).otherwise(F.col("l_linenumber") % 4)
    samples = lines.select(
        F.col("l_orderkey").alias("bundle_key"), task.alias("task_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.concat(F.lit("Which } part \\ of "), F.col("l_orderkey"), F.lit("?")).alias("question"),
        F.col("l_partkey").cast("string").alias("answer"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("Cam1"))).alias("input_cams"),
        F.struct((F.col("l_quantity") / 2).alias("half")).alias("meta"),
    )
    path = shared_dir(spark, "benchmark")
    meta = spark.createDataFrame([("lines", 60)], "dataset string, target int")
    assemble.write_benchmark(
        samples, path, ["bundle_key", "line", "part", "quantity"], meta, lines.select(F.nullif("l_returnflag", F.lit("N")).alias("reason")), lines.select(F.col("l_linestatus").alias("reason"))
    )
    return path


@query(
    """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS idx, CAST(CASE WHEN l_linenumber % 4 = 0 THEN 4 ELSE l_linenumber % 4 END AS INTEGER) AS task_id,
  'Which } part \\ of ' || l_orderkey || '?' AS question, CAST(l_partkey AS VARCHAR) AS answer, CASE WHEN l_returnflag = 'R' THEN 'Cam1' END AS cams, l_quantity / 2 AS half FROM lineitem"""
)
def benchmark_document(spark, sf):
    """A benchmark document written by many tasks and read back by as many as it has blocks, every sample with its place."""
    rows = files.read_benchmark(spark, assembled(spark, sf), folder=True)
    return rows.select("idx", "task_id", "question", "answer", F.array_join("input_cams", ",").alias("cams"), F.get_json_object("meta", "$.half").cast("double").alias("half"))


@query(
    """SELECT 'lines' AS dataset, count(*) AS samples, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS task4, count(*) FILTER (WHERE l_returnflag = 'A') AS rejects_a,
  count(*) FILTER (WHERE l_returnflag = 'R') AS rejects_r, count(*) FILTER (WHERE l_linestatus = 'F') AS frames_f, count(*) FILTER (WHERE l_linestatus = 'O') AS frames_o FROM lineitem"""
)
def benchmark_head(spark, sf):
    """What stands before the samples of that document: settings, counts, reject and frame statistics."""
    stats = "struct<by_reason:map<string,bigint>>"
    head = read_head(spark, assembled(spark, sf), f"meta struct<dataset:string,target:int>, counts struct<samples:bigint,task4:bigint>, reject_stats {stats}, frame_stats {stats}")
    of = lambda part, key: F.col(f"{part}.by_reason")[key]
    return head.select(
        "meta.dataset", "counts.samples", "counts.task4", of("reject_stats", "A").alias("rejects_a"), of("reject_stats", "R").alias("rejects_r"),
        of("frame_stats", "F").alias("frames_f"), of("frame_stats", "O").alias("frames_o"),
    )
