"""Merging benchmark files and checking their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchspark.operators import merge, qa
from benchspark.plans import bindings as b
from benchspark.plans.registry import query


def keyed(spark, sf):
    return merge.with_keys(b.merge_samples(spark, sf))


@query("SELECT source_pos, idx, task_id FROM identities WHERE rn = 1", b.MERGE)
def identity_dedup(spark, sf):
    return merge.dedup_keep_first(keyed(spark, sf)).select("source_pos", "idx", "task_id")


SAME = "answer = kept_answer AND question = kept_question"


@query(
    f"""SELECT count(*) FILTER (WHERE rn = 1) AS merged_sample_count,
  count(*) FILTER (WHERE rn > 1 AND {SAME}) AS exact_duplicates_dropped,
  count(*) FILTER (WHERE rn > 1 AND NOT ({SAME})) AS conflict_duplicates_dropped FROM identities""",
    b.MERGE,
)
def duplicate_counts(spark, sf):
    return merge.duplicate_counts(keyed(spark, sf))


@query(
    f"""SELECT CAST(kept_source AS BIGINT) AS kept_source, kept_index, CAST(source_pos AS BIGINT) AS drop_source, idx AS drop_index
FROM identities WHERE rn > 1 AND NOT ({SAME}) ORDER BY place LIMIT 50""",
    b.MERGE,
)
def dedup_conflicts(spark, sf):
    return merge.conflicts(keyed(spark, sf)).drop("identity_key")


@query(
    f"""SELECT count(*) FILTER (WHERE rn = 1 AND task_id = 1) AS task1, count(*) FILTER (WHERE rn = 1 AND task_id = 2) AS task2,
  count(*) FILTER (WHERE rn = 1 AND task_id = 3) AS task3, count(*) FILTER (WHERE rn = 1 AND task_id = 4) AS task4,
  1 AS bundle, count(*) FILTER (WHERE rn = 1) AS merged_sample_count,
  count(*) FILTER (WHERE rn > 1 AND {SAME}) AS exact_duplicates_dropped,
  count(*) FILTER (WHERE rn > 1 AND NOT ({SAME})) AS conflict_duplicates_dropped FROM identities""",
    b.MERGE,
)
def merge_report(spark, sf):
    return merge.merge_report(keyed(spark, sf))


@query(
    """SELECT count(*) FILTER (WHERE task_id = 1) AS task1, count(*) FILTER (WHERE task_id = 2) AS task2,
  count(*) FILTER (WHERE task_id = 3) AS task3, count(*) FILTER (WHERE task_id = 4) AS task4,
  count(DISTINCT (lower(scene), timestamp)) AS bundle FROM samples""",
    b.MERGE[:1],
)
def merge_counts(spark, sf):
    return merge.recount(b.samples(spark, sf))


@query("SELECT source, count(*) AS sample_count FROM documents GROUP BY 1")
def source_counts(spark, sf):
    return merge.source_counts(b.merge_samples(spark, sf))


@query(
    f"""SELECT idx, row_number() OVER (ORDER BY lower(scene), timestamp, coalesce(task_id, 0), lower({b.norm_sql('question')}), idx) AS place
FROM samples""",
    b.MERGE[:1],
)
def first_ordered(spark, sf):
    """The place of every sample in merge order; a tie falls to the row number instead of the identity hash."""
    return merge.place_samples(b.samples(spark, sf).withColumn("identity_key", F.col("idx"))).select("idx", "place")


@query(
    """WITH maps AS (SELECT source_pos, 'n_' || lang AS key, CAST(sum(n_chars) AS VARCHAR) AS value FROM
  (SELECT CAST(substr(source, 4) AS INTEGER) AS source_pos, lang, n_chars FROM documents) GROUP BY 1, 2
  UNION ALL SELECT DISTINCT CAST(substr(source, 4) AS INTEGER), 'name', source FROM documents)
SELECT key, CASE WHEN key = 'name' THEN arg_min(value, source_pos) ELSE CAST(sum(try_cast(value AS BIGINT)) AS VARCHAR) END AS value
FROM maps GROUP BY key"""
)
def merged_maps(spark, sf):
    """Characters per language and source are the statistics of each input."""
    d = b.table(spark, sf, "documents").select(F.substring("source", 4, 9).cast("int").alias("source_pos"), "source", "lang", "n_chars")
    stats = d.groupBy("source_pos", "source").pivot("lang", b.LANGS).agg(F.sum("n_chars").cast("string"))
    def entry(key, value):
        return F.struct(F.lit(key).alias("k"), F.col(value).alias("v"))

    entries = [F.when(F.col(g).isNotNull(), entry(f"n_{g}", g)) for g in b.LANGS] + [entry("name", "source")]
    return merge.merge_maps(stats.select("source_pos", F.map_from_entries(F.array_compact(F.array(*entries))).alias("stats")))


def provider_flags(spark, sf):
    return qa.qa_flags(b.provider_samples(spark, sf))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE task_id = 1) AS task1, count(*) FILTER (WHERE task_id = 2) AS task2,
  count(*) FILTER (WHERE task_id = 3) AS task3, count(*) FILTER (WHERE task_id = 4) AS task4,
  count(*) FILTER (WHERE question = '') AS missing_question, count(*) FILTER (WHERE answer IS NULL) AS missing_answer,
  count(*) FILTER (WHERE answer IS NOT NULL AND low = '') AS empty_answer,
  count(*) FILTER (WHERE length(low) BETWEEN 1 AND 3) AS short_answer, count(*) FILTER (WHERE trailing_prep) AS trailing_prep,
  count(*) FILTER (WHERE human_label) AS human_label, count(*) FILTER (WHERE noun_phrase_fail) AS noun_phrase_fail,
  count(*) FILTER (WHERE weird_question) AS weird_question, count(*) FILTER (WHERE bad3) AS task3_target_mismatch,
  count(*) FILTER (WHERE bad4) AS task4_target_mismatch FROM qa""",
    b.PROVIDERS,
)
def qa_profile(spark, sf):
    return qa.qa_profile(provider_flags(spark, sf))


@query(
    """WITH hits AS (SELECT idx, task_id, unnest(list_filter([CASE WHEN trailing_prep THEN 'trailing_prep' END,
  CASE WHEN human_label THEN 'human_label' END, CASE WHEN noun_phrase_fail THEN 'noun_phrase_fail' END,
  CASE WHEN weird_question THEN 'weird_question' END, CASE WHEN bad3 THEN 'task3_target_mismatch' END,
  CASE WHEN bad4 THEN 'task4_target_mismatch' END], lambda x: x IS NOT NULL)) AS check_name FROM qa)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY idx) AS rn FROM hits) WHERE rn <= 5""",
    b.PROVIDERS,
)
def qa_examples(spark, sf):
    return qa.examples(provider_flags(spark, sf)).withColumn("rn", F.col("rn").cast("bigint"))


@query(
    """SELECT idx, task_id, q3, a3, q4, a4 FROM qa WHERE bad3 OR bad4""",
    b.PROVIDERS,
)
def target_mismatch(spark, sf):
    f = provider_flags(spark, sf).where("task3_target_mismatch OR task4_target_mismatch")
    return f.select("idx", "task_id", "t.*")


@query(
    """SELECT low AS label, count(*) AS n, (SELECT count(DISTINCT low) FROM qa WHERE task_id = 1 AND answer IS NOT NULL) AS unique_labels
FROM qa WHERE task_id = 1 AND answer IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 10""",
    b.PROVIDERS,
)
def label_diversity(spark, sf):
    return qa.label_diversity(b.provider_samples(spark, sf))


GENERIC = f"""(low = '' OR low IN ({b.word_list(qa.BAD_OBJECTS + qa.BAD_GENERIC_PHRASES)})
  OR coalesce(toks[1] IN ({b.word_list(qa.HUMAN_WORDS)}), false) OR list_has_any(toks, [{b.word_list(qa.BAD_GENERIC_WORDS)}]))"""


@query(
    f"""SELECT provider, count(*) AS total_samples, count(*) FILTER (WHERE task_id = 1) AS task1,
  count(*) FILTER (WHERE task_id = 2) AS task2, count(*) FILTER (WHERE task_id = 3) AS task3,
  count(*) FILTER (WHERE task_id = 4) AS task4, count(*) FILTER (WHERE question = '') AS missing_question,
  count(*) FILTER (WHERE answer IS NULL) AS missing_answer, count(*) FILTER (WHERE answer IS NOT NULL AND low = '') AS empty_answer,
  count(*) FILTER (WHERE lab) AS labels, count(DISTINCT low) FILTER (WHERE lab) AS unique_labels,
  round(avg(confidence) FILTER (WHERE task_id = 1), 10) AS mean_confidence,
  round(count(*) FILTER (WHERE lab AND {GENERIC}) / count(*) FILTER (WHERE lab), 10) AS generic_label_rate,
  round(count(*) FILTER (WHERE lab AND noun_phrase_fail) / count(*) FILTER (WHERE lab), 10) AS noun_phrase_fail_rate,
  count(*) FILTER (WHERE task_id = 3 AND q3 IS NOT NULL AND a3 IS NOT NULL) AS task3_checked,
  count(*) FILTER (WHERE bad3) AS task3_target_mismatches,
  round(count(*) FILTER (WHERE bad3) / count(*) FILTER (WHERE task_id = 3 AND q3 IS NOT NULL AND a3 IS NOT NULL), 10) AS task3_mismatch_rate,
  count(*) FILTER (WHERE task_id = 4 AND q4 IS NOT NULL AND a4 IS NOT NULL) AS task4_checked,
  count(*) FILTER (WHERE bad4) AS task4_target_mismatches,
  round(count(*) FILTER (WHERE bad4) / count(*) FILTER (WHERE task_id = 4 AND q4 IS NOT NULL AND a4 IS NOT NULL), 10) AS task4_mismatch_rate
FROM (SELECT *, task_id = 1 AND answer IS NOT NULL AS lab FROM qa) GROUP BY provider""",
    b.PROVIDERS,
)
def provider_summary(spark, sf):
    s = qa.provider_summary(b.provider_samples(spark, sf))
    rates = ["mean_confidence", "generic_label_rate", "noun_phrase_fail_rate", "task3_mismatch_rate", "task4_mismatch_rate"]
    return s.withColumns({r: F.round(r, 10) for r in rates})


BRANDS = [f"Brand#{i}" for i in range(1, 26)]
CELLS = ", ".join(f"coalesce(max(answer) FILTER (WHERE provider = '{p}'), '') AS \"{p.replace('#', '_')}\"" for p in BRANDS)


@query(
    f"""WITH last AS (SELECT scene, timestamp, provider, arg_max_null(answer, idx) AS answer FROM qa WHERE task_id = 1 GROUP BY 1, 2, 3)
SELECT '1|' || scene || '|' || timestamp || '|' AS sample_key, {CELLS} FROM last GROUP BY scene, timestamp""",
    b.PROVIDERS,
)
def label_matrix(spark, sf):
    m = qa.label_matrix(b.provider_samples(spark, sf), BRANDS, qa.sample_key(None))
    return m.select("sample_key", *[F.col(p).alias(p.replace("#", "_")) for p in BRANDS])


def confidences(spark, sf):
    """Account balances stand for confidences; negative ones are missing."""
    return b.table(spark, sf, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10000).alias("confidence"))


RANKED = """WITH v AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000 END AS c FROM customer),
r AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM v WHERE c IS NOT NULL)"""
MARKS = ", ".join(f"max(c) FILTER (WHERE i = round_even({p / 100} * (n - 1), 0)) AS p{p}" for p in (10, 25, 50, 75, 90))


@query(
    f"""{RANKED} SELECT count(*) AS n, (SELECT count(*) FROM v WHERE c IS NULL) AS missing, min(c) AS min_conf,
  round(avg(c), 8) AS mean_conf, max(c) AS max_conf, round(median(c), 8) AS median_conf, {MARKS} FROM r"""
)
def confidence_report(spark, sf):
    r = qa.confidence_report(confidences(spark, sf))
    return r.withColumns({"mean_conf": F.round("mean_conf", 8), "median_conf": F.round("median_conf", 8)})


@query(
    f"""{RANKED}, s AS (SELECT min(c) AS lo, max(c) AS hi FROM v)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 10, 8) AS bin_lo, round(lo + (b + 1) * (hi - lo) / 10, 8) AS bin_hi,
  (SELECT count(*) FROM v, s WHERE c IS NOT NULL AND least(floor((c - lo) / ((hi - lo) / 10)), 9) = b) AS n FROM s, range(10) t(b)"""
)
def confidence_histogram(spark, sf):
    h = qa.histogram(confidences(spark, sf))
    return h.withColumns({"bin_lo": F.round("bin_lo", 8), "bin_hi": F.round("bin_hi", 8)})
