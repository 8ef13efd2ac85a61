"""Views that read the given tables as the entities the operators work on, in Spark and in SQL.

Every view covers its whole table. The SQL text of a view opens the oracle query of every plan that uses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benchspark.functions.text import WS
from benchspark.operators.campaign import HUMAN_WORDS, PREPOSITIONS, TASK_ORDER

SCENES = ["f", "o", "p"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
CAMERAS = [f"Cam{i}" for i in range(1, 7)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows in as many partitions as a shuffle has, by a unique key.

    A narrow table of millions of rows is one small file, which one or two tasks read; rules that cost much per row must not
    stay in these.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "part"), "p_partkey")


def _case(column: str, pairs, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + f" ELSE {other} END"


TASK_CASE = _case("o_orderpriority", zip(PRIORITIES, TASK_ORDER), "'other_task'")

# --- scoring -----------------------------------------------------------------------------------------------------

def manifest(spark, sf) -> DataFrame:
    """Orders as manifest rows: priority is the task (the fifth is an unknown one), status the scene."""
    task = F.col("o_orderpriority")
    kind = F.lit("other_task")
    number = F.lit(5)
    for i in range(3, -1, -1):
        kind = F.when(task == PRIORITIES[i], TASK_ORDER[i]).otherwise(kind)
        number = F.when(task == PRIORITIES[i], i + 1).otherwise(number)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_uid"),
        number.alias("task_id"),
        kind.alias("task_type"),
        F.lower("o_orderstatus").alias("scene"),
        F.concat(F.lit("What is the status of order "), F.col("o_orderkey"), F.lit("?")).alias("question"),
        F.col("o_orderstatus").alias("groundtruth_answer"),
    )


def _line_pos():
    return F.col("l_linenumber") * F.lit(1 << 32) + F.col("l_partkey") * 2 + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)


def predictions(spark, sf) -> DataFrame:
    """Line items as answers: supplier is the model; flag A means a blank answer with an error."""
    return prediction_columns(table(spark, sf, "lineitem"))


def prediction_columns(lines: DataFrame) -> DataFrame:
    blank = F.col("l_returnflag") == "A"
    return lines.select(
        F.col("l_orderkey").cast("string").alias("sample_uid"),
        F.col("l_suppkey").cast("string").alias("model_key"),
        F.col("l_suppkey").cast("string").alias("model_id"),
        _line_pos().alias("pos"),
        F.when(blank, "").otherwise(F.col("l_returnflag")).alias("inference_answer"),
        F.when(blank, "empty_answer").otherwise("").alias("error"),
        F.col("l_tax").alias("latency_s"),
    )


def verdicts(spark, sf) -> DataFrame:
    """Finished line items carry a verdict, right for flag R; open ones have none."""
    return table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(
        F.col("l_orderkey").cast("string").alias("sample_uid"),
        F.col("l_suppkey").cast("string").alias("model_key"),
        _line_pos().alias("pos"),
        F.when(F.col("l_returnflag") == "R", " Correct ").otherwise("wrong").alias("gemini_judge"),
        F.when(F.col("l_returnflag") == "A", "missing_prediction").otherwise("").alias("error"),
    )


def registry(spark, sf) -> DataFrame:
    """Suppliers as models: region is the group, the key's parity the track."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("pos"),
        F.col("s_suppkey").cast("string").alias("key"),
        F.col("s_name").alias("label"),
        F.col("r_name").alias("group"),
        F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("A+B").alias("track"),
        F.concat(F.lit("id-"), F.col("s_suppkey")).alias("model_id"),
        F.when(F.col("s_acctbal") < 0, "vllm").otherwise("sglang").alias("engine"),
        (F.col("s_suppkey") % 7 != 3).alias("include_in_default_lists"),
    )


CTES = {
    "manifest": f"""SELECT CAST(o_orderkey AS VARCHAR) AS sample_uid,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
    WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS task_id,
  {TASK_CASE} AS task_type, lower(o_orderstatus) AS scene,
  'What is the status of order ' || o_orderkey || '?' AS question, o_orderstatus AS groundtruth_answer
  FROM orders""",
    "predictions": """SELECT CAST(l_orderkey AS VARCHAR) AS sample_uid, CAST(l_suppkey AS VARCHAR) AS model_key,
  l_linenumber * 4294967296 + l_partkey * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS pos,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS inference_answer,
  CASE WHEN l_returnflag = 'A' THEN 'empty_answer' ELSE '' END AS error, l_tax AS latency_s
  FROM lineitem""",
    "verdicts": """SELECT CAST(l_orderkey AS VARCHAR) AS sample_uid, CAST(l_suppkey AS VARCHAR) AS model_key,
  l_linenumber * 4294967296 + l_partkey * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS pos,
  CASE WHEN l_returnflag = 'R' THEN 'correct' ELSE 'wrong' END AS verdict,
  CASE WHEN l_returnflag = 'A' THEN 'missing_prediction' ELSE '' END AS error
  FROM lineitem WHERE l_linestatus = 'F'""",
    "last_verdicts": """SELECT sample_uid, model_key, verdict FROM (SELECT *, row_number() OVER
  (PARTITION BY sample_uid, model_key ORDER BY pos DESC) AS rn FROM verdicts) WHERE rn = 1""",
    "registry": """SELECT s_suppkey AS pos, CAST(s_suppkey AS VARCHAR) AS key, s_name AS label, r_name AS "group",
  CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'A+B' END AS track, 'id-' || s_suppkey AS model_id,
  CASE WHEN s_acctbal < 0 THEN 'vllm' ELSE 'sglang' END AS engine, s_suppkey % 7 <> 3 AS include_in_default_lists
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "eval_rows": """SELECT p.sample_uid, p.model_key, p.pos, m.task_type, m.scene, m.question, m.groundtruth_answer,
  p.inference_answer, p.error, coalesce(v.verdict, '') AS verdict
  FROM predictions p JOIN manifest m USING (sample_uid) LEFT JOIN last_verdicts v USING (sample_uid, model_key)""",
}
SCORING = ("manifest", "predictions", "verdicts", "last_verdicts", "registry", "eval_rows")


# --- text in SQL ---------------------------------------------------------------------------------------------------

def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def word_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- benchmark samples from documents ------------------------------------------------------------------------------

LANGS = ["en", "fr", "de", "es"]


def _image_name(k):
    return F.concat(F.lit("img/hall_03_"), F.lpad(k.cast("string"), 4, "0"), F.lit("_Cam"), (k % 6 + 1).cast("string"), F.lit("_raw.jpg"))


def samples(spark, sf) -> DataFrame:
    """Documents as benchmark samples: the source is the input file, the language the task, the first line the
    question, the whole text the answer. Very short texts get no task or no image."""
    task = F.lit(4)
    for i in (2, 1, 0):
        task = F.when(F.col("lang") == LANGS[i], i + 1).otherwise(task)
    k = F.col("doc_id") % 300
    images = F.array(*[F.struct(F.concat(F.lit("Cam"), (j % 6 + 1).cast("string")).alias("cam"), _image_name(j).alias("image")) for j in (k, k + 100)])
    return table(spark, sf, "documents").select(
        F.col("source"),
        F.substring("source", 4, 9).cast("int").alias("source_pos"),
        F.col("doc_id").alias("idx"),
        F.when(F.col("n_chars") >= 60, task).alias("task_id"),
        F.lit(None).cast("string").alias("task_type"),
        F.split("text", "\n", 2)[0].alias("question"),
        F.col("text").alias("answer"),
        F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise("").alias("scene"),
        F.lpad(k.cast("string"), 4, "0").alias("timestamp"),
        F.array(F.lit("Cam1"), F.lit("Cam2")).alias("input_cams"),
        F.when(F.col("n_chars") >= 80, images).alias("input_images"),
    )


def inventory(spark, sf) -> DataFrame:
    """One stored camera image per page."""
    return table(spark, sf, "pages").select(_image_name(F.col("page_id")).alias("path"))


def decisions(spark, sf) -> DataFrame:
    """Labels as review decisions of the frame that the document belongs to."""
    word = F.when(F.col("quality") == 0, " Drop ").when(F.col("toxic") == 1, "hold").otherwise("Accepted")
    return table(spark, sf, "labels").select(
        F.concat(F.lit("hall||03||"), F.lpad((F.col("doc_id") % 300).cast("string"), 4, "0")).alias("bundle_id"),
        word.alias("decision"),
        F.lit("").alias("note"),
        F.concat(F.lit("r"), F.col("doc_id")).alias("reviewer"),
        F.lit("").alias("updated_at"),
        F.col("doc_id").alias("pos"),
    )


def _name_sql(k: str) -> str:
    return f"'img/hall_03_' || lpad(CAST({k} AS VARCHAR), 4, '0') || '_Cam' || (({k}) % 6 + 1) || '_raw.jpg'"


CTES |= {
    "samples": f"""SELECT source, CAST(substr(source, 4) AS INTEGER) AS source_pos, doc_id AS idx,
  CASE WHEN n_chars >= 60 THEN CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END END AS task_id,
  split_part(text, chr(10), 1) AS question, text AS answer,
  CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE '' END AS scene,
  lpad(CAST(doc_id % 300 AS VARCHAR), 4, '0') AS timestamp,
  CASE WHEN n_chars >= 80 THEN [{_name_sql('doc_id % 300')}, {_name_sql('doc_id % 300 + 100')}] ELSE [] END AS image_paths
  FROM documents""",
    "inventory": f"SELECT {_name_sql('page_id')} AS path FROM pages",
    "gone": """SELECT idx, count(*) AS missing FROM (SELECT idx, unnest(image_paths) AS p FROM samples)
  WHERE p NOT IN (SELECT path FROM inventory) GROUP BY idx""",
    "checked": f"""SELECT s.*, {strip_sql('question')} AS q, {strip_sql('answer')} AS a,
  CASE WHEN task_id IS NULL THEN 'invalid_task_id' WHEN len(image_paths) = 0 THEN 'missing_input_images'
    WHEN missing > 0 THEN 'missing_image_files:' || missing END AS reason,
  CASE task_id {' '.join(f"WHEN {i + 1} THEN '{t}'" for i, t in enumerate(TASK_ORDER))} ELSE 'unknown' END AS task_type
  FROM samples s LEFT JOIN gone USING (idx)""",
    "frozen": f"""SELECT *, '03' AS seq, timestamp AS frame, CASE WHEN scene = '' THEN 'hall' ELSE lower(scene) END AS scene_key,
  {words_sql('lower(a)')} AS toks FROM checked WHERE reason IS NULL""",
    "flagged": f"""SELECT *, list_filter([
   CASE WHEN q = '' THEN 'missing_question' END, CASE WHEN a = '' THEN 'missing_answer' END,
   CASE WHEN length(a) <= 3 AND a <> '' THEN 'short_answer' END,
   CASE WHEN toks[len(toks)] IN ({word_list(PREPOSITIONS)}) THEN 'trailing_preposition' END,
   CASE WHEN task_id = 1 AND (contains(lower(q), 'person with wearing') OR lower(q) LIKE '% with' OR lower(q) LIKE '% wearing')
     THEN 'weird_task1_question' END,
   CASE WHEN task_id = 1 AND toks[1] IN ({word_list(HUMAN_WORDS)}) THEN 'task1_human_label' END,
   CASE WHEN task_id = 1 AND len(toks) > 6 THEN 'task1_long_label' END], lambda f: f IS NOT NULL) AS flags,
  scene_key || '||' || seq || '||' || frame AS bundle_id FROM frozen""",
    "decisions": f"""SELECT 'hall||03||' || lpad(CAST(doc_id % 300 AS VARCHAR), 4, '0') AS bundle_id,
  CASE WHEN quality = 0 THEN 'reject' WHEN toxic = 1 THEN 'undecided' ELSE 'approve' END AS decision,
  'r' || doc_id AS reviewer, doc_id AS pos FROM labels""",
    "last_decisions": """SELECT bundle_id, decision, reviewer FROM (SELECT *, row_number() OVER
  (PARTITION BY bundle_id ORDER BY pos DESC) AS rn FROM decisions) WHERE rn = 1""",
}
FREEZING = ("samples", "inventory", "gone", "checked", "frozen", "flagged")
REVIEW = FREEZING + ("decisions", "last_decisions")


# --- merge inputs, confidences, providers --------------------------------------------------------------------------

def merge_samples(spark, sf) -> DataFrame:
    """Documents as rows of several benchmark files: equal first lines in one language are one identity."""
    return samples(spark, sf).select(
        "source", "source_pos", "idx",
        F.coalesce("task_id", F.lit(0)).alias("task_id"),
        F.lit("t").alias("task_type"),
        F.lit("Hall").alias("scene"),
        F.lit(" ").alias("timestamp"),
        "question",
        "answer",
        # the same content with its keys in either order
        F.when(F.col("idx") % 2 == 0, '{"b":{"y":1,"x":"h"},"a":2}').otherwise('{"a":2,"b":{"x":"h","y":1}}').alias("meta"),
    )


def provider_samples(spark, sf) -> DataFrame:
    """Parts as label samples: brand is the provider, name the label, (type, size) the frame; the size picks the task.
    Questions and answers of tasks 3 and 4 name a target each."""
    p = parts(spark, sf)
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    task = (F.when(F.col("p_size") <= 25, 1).when(F.col("p_size") <= 35, 3).when(F.col("p_size") <= 45, 4).otherwise(2))
    other = F.when(F.col("p_partkey") % 3 == 0, first).otherwise(F.upper(last))
    question = (
        F.when(task == 3, F.concat(F.lit("Whose GAZE target is '"), last, F.lit("'?")))
        .when(task == 4, F.concat(F.lit("Can they see the '"), last, F.lit("' from Cam2?")))
        .when(F.col("p_partkey") % 11 == 0, "What is the person with")
        .otherwise("What is it?")
    )
    answer = (
        F.when(task == 3, F.concat(F.lit(" Gaze target: "), other, F.lit(". Cam1: YES.")))
        .when(task == 4, F.concat(F.lit("YES. In Cam1, the "), other, F.when(F.col("p_partkey") % 2 == 0, " is within view.").otherwise(" is outside.")))
        .when(F.col("p_partkey") % 13 == 0, F.concat(F.col("p_name"), F.lit(" on")))
        .when(F.col("p_partkey") % 17 == 0, F.concat(F.lit("man with "), F.col("p_name")))
        .when(F.col("p_partkey") % 19 == 0, "red object")
        .when(F.col("p_partkey") % 23 == 0, "  ")
        .when(F.col("p_partkey") % 29 == 0, F.lit(None))
        .otherwise(F.col("p_name"))
    )
    return p.select(
        F.col("p_partkey").alias("idx"),
        F.col("p_brand").alias("provider"),
        task.alias("task_id"),
        F.col("p_type").alias("scene"),
        F.col("p_size").cast("string").alias("timestamp"),
        question.alias("question"),
        answer.alias("answer"),
        F.round(F.col("p_retailprice") / 3000, 4).alias("confidence"),
    )


CTES |= {
    "merge_samples": """SELECT source, source_pos, idx, coalesce(task_id, 0) AS task_id, question, answer,
  source_pos * 1099511627776 + idx AS place FROM samples""",
    "identities": f"""SELECT *, row_number() OVER w AS rn, first_value(answer) OVER w AS kept_answer,
  first_value(question) OVER w AS kept_question, first_value(source_pos) OVER w AS kept_source, first_value(idx) OVER w AS kept_index
  FROM merge_samples WINDOW w AS (PARTITION BY task_id, lower({norm_sql('question')}) ORDER BY place)""",
    "providers": """SELECT *, CASE
    WHEN task_id = 3 THEN 'Whose GAZE target is ''' || last || '''?'
    WHEN task_id = 4 THEN 'Can they see the ''' || last || ''' from Cam2?'
    WHEN idx % 11 = 0 THEN 'What is the person with' ELSE 'What is it?' END AS question,
  CASE WHEN task_id = 3 THEN ' Gaze target: ' || other || '. Cam1: YES.'
    WHEN task_id = 4 THEN 'YES. In Cam1, the ' || other || CASE WHEN idx % 2 = 0 THEN ' is within view.' ELSE ' is outside.' END
    WHEN idx % 13 = 0 THEN name || ' on' WHEN idx % 17 = 0 THEN 'man with ' || name WHEN idx % 19 = 0 THEN 'red object'
    WHEN idx % 23 = 0 THEN '  ' WHEN idx % 29 = 0 THEN NULL ELSE name END AS answer
  FROM (SELECT *, CASE WHEN idx % 3 = 0 THEN split_part(name, ' ', 1) ELSE upper(last) END AS other FROM
   (SELECT p_partkey AS idx, p_brand AS provider, p_name AS name, split_part(p_name, ' ', 2) AS last,
    CASE WHEN p_size <= 25 THEN 1 WHEN p_size <= 35 THEN 3 WHEN p_size <= 45 THEN 4 ELSE 2 END AS task_id,
    p_type AS scene, CAST(p_size AS VARCHAR) AS timestamp, round(p_retailprice / 3000, 4) AS confidence FROM part))""",
    "qa": f"""SELECT *, task_id = 1 AND answer IS NOT NULL AND NOT coalesce(len(toks) BETWEEN 1 AND 6
    AND toks[len(toks)] NOT IN ({word_list(PREPOSITIONS)}) AND toks[1] NOT IN ({word_list(HUMAN_WORDS)}), false) AS noun_phrase_fail,
  coalesce(toks[len(toks)] IN ({word_list(PREPOSITIONS)}), false) AS trailing_prep,
  coalesce(toks[1] IN ({word_list(HUMAN_WORDS)}), false) AS human_label,
  task_id = 1 AND (contains(ql, 'person with wearing') OR ql LIKE '% with' OR ql LIKE '% wearing') AS weird_question,
  task_id = 3 AND lower(q3) <> lower(a3) AS bad3, task_id = 4 AND lower(q4) <> lower(a4) AS bad4
  FROM (SELECT *, lower(trim(question)) AS ql, trim(lower(coalesce(answer, ''))) AS low, {words_sql("lower(coalesce(answer, ''))")} AS toks,
    nullif(regexp_extract(lower(question), 'gaze target is ''([^'']+)''', 1), '') AS q3,
    nullif(trim(regexp_extract(answer, '^\\s*Gaze target:\\s*([^.]+)\\.', 1)), '') AS a3,
    nullif(regexp_extract(question, 'see the ''([^'']+)''', 1), '') AS q4,
    nullif(regexp_extract(answer, 'In\\s+Cam\\w+,\\s+the\\s+(\\S.*?)\\s+is\\s+(within|outside)', 1), '') AS a4 FROM providers)""",
}
MERGE = ("samples", "merge_samples", "identities")
PROVIDERS = ("providers", "qa")


# --- frames, cameras and rigs --------------------------------------------------------------------------------------

def camera_rows(spark, sf) -> DataFrame:
    """Parts as camera views: six neighbouring parts are the cameras of a frame, the brand is the sequence."""
    p = parts(spark, sf)
    k = F.col("p_partkey")
    n = F.col("p_retailprice")
    return p.select(
        F.lower("p_type").alias("split"),
        F.col("p_brand").alias("seq"),
        F.lpad(F.floor(k / 6).cast("string"), 4, "0").alias("frame_id"),
        F.floor(k / 6).cast("string").alias("frame_key"),
        F.concat(F.lit("Cam"), (k % 6 + 1).cast("string")).alias("cam"),
        (k % 6).cast("int").alias("cam_pos"),
        k.alias("pos"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(k % 3 != 0).cast("boolean").alias("visible"),
        F.when(k % 11 != 0, F.array((k * 37 % 1000).cast("double"), (k * 91 % 750).cast("double"))).alias("coord"),
        F.when(
            k % 13 != 0, F.array((k * 53 % 800).cast("double"), (k * 29 % 500).cast("double"), (F.col("p_size") * 4).cast("double"), F.lit(200.0))
        ).alias("body"),
        F.when(k % 7 != 0, F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg"))).alias("image_path"),
        F.when(k % 4 == 0, F.substring_index("p_name", " ", -1)).when(k % 9 == 0, "red object").otherwise(F.col("p_name")).alias("label"),
        F.when(k % 8 == 0, "mask_small_skip").otherwise("mask_primary").alias("mode"),
        ((k * 17 % 100) / 500).alias("mask_area_ratio"),
        ((k * 7 % 97) / 100).alias("bbox_gaze_dist_norm"),
        F.substring_index("p_name", " ", -1).alias("mask_label"),
        F.col("p_name").alias("ray_label"),
        F.when(k % 6 == 2, F.lit("Cam1")).alias("prefer_cam"),
        n.alias("price"),
    )


def one_frame(rows: DataFrame) -> DataFrame:
    """Give all six cameras of a frame the split and sequence of the frame number."""
    f = F.floor(F.col("pos") / 6)
    return rows.withColumns({"split": F.concat(F.lit("s"), (f % 3).cast("string")), "seq": F.concat(F.lit("q"), (f % 50).cast("string"))})


def frame_cams(spark, sf) -> DataFrame:
    return one_frame(camera_rows(spark, sf))


def rig_centers(spark, sf) -> DataFrame:
    """Vectors as extrinsics: six neighbouring vectors are the cameras of one rig."""
    v = table(spark, sf, "embeddings")
    e = [F.col("embedding")[i].cast("double") for i in range(16)]
    return v.select(
        F.lit("s").alias("split"),
        F.floor(F.col("vec_id") / 6).cast("string").alias("seq"),
        F.concat(F.lit("Cam"), (F.col("vec_id") % 6 + 1).cast("string")).alias("cam"),
        F.array(*e[:9]).alias("r"),
        F.array(*e[9:12]).alias("t"),
    )


def eye_rows(spark, sf) -> DataFrame:
    """Six frames per rig: the eye point of each comes from one of the rig's vectors."""
    v = table(spark, sf, "embeddings")
    return v.select(
        F.lit("s").alias("split"), F.floor(F.col("vec_id") / 6).cast("string").alias("seq"),
        F.lpad((F.col("vec_id") % 6).cast("string"), 4, "0").alias("frame_id"),
        F.array(*[F.col("embedding")[i].cast("double") for i in range(20, 23)]).alias("eye3d"),
    )


CTES |= {
    "cams": """SELECT *, pos // 6 AS f, 's' || (pos // 6) % 3 AS split, 'q' || (pos // 6) % 50 AS seq, lpad(CAST(pos // 6 AS VARCHAR), 4, '0') AS frame_id,
  CAST(pos // 6 AS VARCHAR) AS frame_key, 'Cam' || (pos % 6 + 1) AS cam, CAST(pos % 6 AS INTEGER) AS cam_pos,
  CASE WHEN pos % 5 = 0 THEN NULL ELSE pos % 3 <> 0 END AS visible,
  CASE WHEN pos % 11 <> 0 THEN CAST(pos * 37 % 1000 AS DOUBLE) END AS cx, CASE WHEN pos % 11 <> 0 THEN CAST(pos * 91 % 750 AS DOUBLE) END AS cy,
  CASE WHEN pos % 13 <> 0 THEN CAST(pos * 53 % 800 AS DOUBLE) END AS bx, CASE WHEN pos % 13 <> 0 THEN CAST(pos * 29 % 500 AS DOUBLE) END AS by_,
  CASE WHEN pos % 13 <> 0 THEN CAST(p_size * 4 AS DOUBLE) END AS bw, CASE WHEN pos % 13 <> 0 THEN 200.0::DOUBLE END AS bh,
  CASE WHEN pos % 7 <> 0 THEN 'img/' || pos || '.jpg' END AS image_path,
  CASE WHEN pos % 4 = 0 THEN noun WHEN pos % 9 = 0 THEN 'red object' ELSE p_name END AS label,
  CASE WHEN pos % 8 = 0 THEN 'mask_small_skip' ELSE 'mask_primary' END AS mode, (pos * 17 % 100) / 500 AS area,
  (pos * 7 % 97) / 100 AS dist, noun AS mask_label, p_name AS ray_label
  FROM (SELECT *, p_partkey AS pos, split_part(p_name, ' ', 2) AS noun FROM part)""",
    "centers": """SELECT vec_id // 6 AS rig, vec_id % 6 AS k, embedding::DOUBLE[] AS e FROM embeddings""",
    "poses": """SELECT rig, k, [-(e[1]*e[10]+e[4]*e[11]+e[7]*e[12]), -(e[2]*e[10]+e[5]*e[11]+e[8]*e[12]), -(e[3]*e[10]+e[6]*e[11]+e[9]*e[12])] AS a,
  [e[10], e[11], e[12]] AS b FROM centers""",
    "rigs": """SELECT rig, count(*) AS pairs, min(da) AS lo_a, max(da) AS hi_a, avg(da) AS mean_a, stddev_pop(da) AS std_a, min(db) AS lo_b,
  max(db) AS hi_b, avg(db) AS mean_b, stddev_pop(db) AS std_b FROM (SELECT p.rig,
   sqrt((p.a[1]-q.a[1])**2 + (p.a[2]-q.a[2])**2 + (p.a[3]-q.a[3])**2) AS da, sqrt((p.b[1]-q.b[1])**2 + (p.b[2]-q.b[2])**2 + (p.b[3]-q.b[3])**2) AS db
   FROM poses p JOIN poses q ON p.rig = q.rig AND p.k < q.k) GROUP BY rig""",
    "scores": """SELECT *, CASE WHEN lo_a < 1e-6 THEN 1e6 ELSE 0 END + CASE WHEN std_a < 1e-6 THEN 1e4 ELSE 0 END + 1 / greatest(mean_a, 1e-6) + 1 / greatest(std_a, 1e-6) AS sa,
  CASE WHEN lo_b < 1e-6 THEN 1e6 ELSE 0 END + CASE WHEN std_b < 1e-6 THEN 1e4 ELSE 0 END + 1 / greatest(mean_b, 1e-6) + 1 / greatest(std_b, 1e-6) AS sb FROM rigs""",
    "picked": """SELECT p.rig, p.k, CASE WHEN coalesce(sa, 1e18) <= coalesce(sb, 1e18) THEN a ELSE b END AS c,
  CASE WHEN coalesce(sa, 1e18) <= coalesce(sb, 1e18) THEN 'world_to_cam' ELSE 'cam_to_world' END AS mode,
  coalesce(least(sa, sb) / greatest(sa, sb), 1) AS score_ratio FROM poses p LEFT JOIN scores USING (rig)""",
    "eyes": """SELECT rig, lpad(CAST(k AS VARCHAR), 4, '0') AS frame_id, [e[21], e[22], e[23]] AS eye FROM centers""",
    "dists": """SELECT p.rig, y.frame_id, p.k, p.c, y.eye, sqrt((c[1]-eye[1])**2 + (c[2]-eye[2])**2 + (c[3]-eye[3])**2) AS d
  FROM picked p JOIN eyes y USING (rig)""",
}
RIG = ("centers", "poses", "rigs", "scores", "picked", "eyes", "dists")
