"""Stored responses, decisions over them, samples and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchspark.functions import geometry as geo
from benchspark.functions import responses as R
from benchspark.functions.labels import sanitize
from benchspark.functions.text import portable_hash_sql
from benchspark.operators import campaign, decisions, metrics, samples
from benchspark.plans import bindings as b
from benchspark.plans.bindings import strip_sql, words_sql
from benchspark.plans.labelling import filter_sql, generic_sql, sanitize_sql
from benchspark.plans.registry import query

# --- responses -----------------------------------------------------------------------------------------------------


def teacher_rows(spark, sf):
    """Part names inside teacher answers of seven shapes; the size gives verdict and confidence."""
    p = b.parts(spark, sf)
    k, lab, size = F.col("p_partkey") % 7, F.col("p_name"), F.col("p_size")
    verdict = F.when(size % 3 == 0, "correct").when(size % 3 == 1, "INCORRECT").otherwise("perhaps")
    conf = F.when(size % 4 == 0, "HIGH").when(size % 4 == 1, "medium").otherwise("sure")
    why = F.lit("It fits. The ray agrees! Nothing else.")
    first = F.to_json(F.struct(lab.alias("final_label"), verdict.alias("qwen_verdict"), conf.alias("confidence"),
                               F.lit("kitchen").alias("scene_setting"), why.alias("rationale")))
    second = F.to_json(F.struct(lab.alias("label"), verdict.alias("verdict"), conf.alias("confidence")))
    raw = (
        F.when(k == 0, first)
        .when(k == 1, F.concat(F.lit("```json\n"), second, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Sure: "), first, F.lit(" done")))
        .when(k == 3, F.concat(F.lit('{"final_label": "'), lab, F.lit('", "qwen_verdict": "'), verdict, F.lit('", "confidence": "MEDI')))
        .when(k == 4, F.concat(F.lit("FINAL_LABEL: "), lab, F.lit("\nQWEN_VERDICT: "), verdict, F.lit("\nCONFIDENCE: "), conf,
                               F.lit("\nDECISION: switch_label\nSCENE_FIT_CURRENT: yes\nSCENE_SETTING: moon\nRATIONALE: "), why))
        .when(k == 5, F.concat(F.lit("The "), lab))
        .otherwise(" ")
    )
    return p.select(F.col("p_partkey").alias("pos"), raw.alias("raw"))


b.CTES["teacher"] = """SELECT p_partkey AS pos, p_partkey % 7 AS k, p_name AS lab, CASE WHEN p_size % 3 = 0 THEN 'CORRECT' WHEN p_size % 3 = 1 THEN 'INCORRECT' ELSE 'UNCLEAR' END AS verdict,
  CASE WHEN p_size % 4 = 0 THEN 'HIGH' WHEN p_size % 4 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS conf, 'It fits. The ray agrees!' AS why FROM part"""


@query(
    """SELECT pos, CASE WHEN k < 5 THEN lab WHEN k = 5 THEN 'The ' || lab END AS final_label, CASE WHEN k < 5 THEN verdict ELSE 'UNCLEAR' END AS qwen_verdict,
  CASE WHEN k IN (0, 1, 2, 4) THEN conf ELSE 'LOW' END AS confidence, CASE WHEN k IN (0, 2) THEN 'KITCHEN' ELSE 'UNCLEAR' END AS scene_setting,
  CASE WHEN k IN (0, 2, 4) THEN why END AS rationale, k < 6 AS parse_ok,
  CASE WHEN k < 3 THEN 'ok' WHEN k = 3 THEN 'partial_recovered' WHEN k < 6 THEN 'invalid' ELSE 'empty' END AS parse_status, k = 3 AS parse_partial,
  CASE WHEN k < 3 THEN 'json_object' WHEN k = 3 THEN 'partial_json_fields' WHEN k < 6 THEN 'non_json_fallback' ELSE 'empty_text' END AS parse_reason FROM teacher""",
    ("teacher",),
)
def parse_teacher(spark, sf):
    return R.parse_teacher(teacher_rows(spark, sf)).drop("raw", "target_local_context")


@query(
    """SELECT pos, CASE k WHEN 0 THEN fields || ' fits The' WHEN 2 THEN 'Sure ' || fields || ' fits' WHEN 3 THEN 'finallabel ' || lab || ' qwenverdict'
    WHEN 4 THEN lab WHEN 5 THEN 'The ' || lab END AS final_label, CASE WHEN k = 4 THEN conf ELSE 'LOW' END AS confidence,
  CASE WHEN k = 4 THEN why END AS rationale, CASE WHEN k = 4 THEN 'SWITCH_LABEL' ELSE 'UNSURE' END AS decision, 'UNCLEAR' AS scene_setting,
  CASE WHEN k = 4 THEN 'YES' ELSE 'UNCLEAR' END AS scene_fit_current, 'UNCLEAR' AS scene_fit_proposed
  FROM (SELECT *, 'finallabel' || lab || 'qwenverdict' || CASE verdict WHEN 'CORRECT' THEN 'correct' WHEN 'UNCLEAR' THEN 'perhaps' ELSE verdict END || 'confidence'
    || CASE conf WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'sure' ELSE conf END || 'scenesettingkitchenrationaleIt' AS fields FROM teacher)""",
    ("teacher",),
)
def parse_keyed(spark, sf):
    """An answer without keyed lines falls back to its first words, whatever they are."""
    return R.parse_keyed(teacher_rows(spark, sf), "guardrail").drop("raw", "target_local_context")


@query(
    """SELECT pos, k IN (0, 1) AS parse_ok, k = 3 AS partial, CASE WHEN k IN (0, 1) THEN 'ok' WHEN k = 6 THEN 'empty' ELSE 'invalid' END AS status FROM teacher""",
    ("teacher",),
)
def parse_health(spark, sf):
    return teacher_rows(spark, sf).select("pos", R.parse_health("raw").alias("h")).select("pos", "h.*")


def verifier_rows(spark, sf):
    """Customers as verifier answers: balance and segment give the fields, the key the shape."""
    c = b.table(spark, sf, "customer")
    k = F.col("c_custkey") % 5
    pred = F.when(F.col("c_acctbal") < 3000, "YES").when(F.col("c_acctbal") < 7000, "no").otherwise("maybe")
    pres = F.when(F.col("c_nationkey") < 10, "PRESENT").when(F.col("c_nationkey") < 20, "not_present").otherwise("UNCLEAR")
    person = F.when(F.col("c_mktsegment") == "BUILDING", "NOT_PRESENT").otherwise("present")
    conf = F.when(F.col("c_nationkey") % 2 == 0, "HIGH").otherwise("MEDIUM")
    fields = F.struct(pred.alias("prediction"), pres.alias("presence"), person.alias("person_presence"), conf.alias("confidence"))
    raw = (
        F.when(k == 0, F.to_json(fields))
        .when(k == 1, F.concat(F.lit("I say "), F.to_json(fields)))
        .when(k == 2, F.concat(F.lit('{"prediction": "'), pred, F.lit('", "presence": "'), pres, F.lit('", "person_presence": "'), person, F.lit('", "confi')))
        .when(k == 3, F.concat(F.lit("PREDICTION: "), pred, F.lit("\nCONFIDENCE: "), conf))
        .otherwise("")
    )
    return c.select(
        F.col("c_custkey").alias("key"), raw.alias("raw"), F.when(F.col("c_custkey") % 2 == 0, "YES").otherwise("NO").alias("answer")
    )


b.CTES["verifier"] = """SELECT *, CASE WHEN k < 4 THEN pred END AS prediction, CASE WHEN k < 3 THEN pres END AS presence,
  CASE WHEN k < 3 THEN person END AS person_presence, CASE WHEN k IN (0, 1, 3) THEN conf ELSE 'LOW' END AS confidence, k < 3 AND pred IS NOT NULL AS parse_ok
  FROM (SELECT c_custkey AS key, c_custkey % 5 AS k, CASE WHEN c_acctbal < 3000 THEN 'YES' WHEN c_acctbal < 7000 THEN 'NO' END AS pred,
   CASE WHEN c_nationkey < 10 THEN 'PRESENT' WHEN c_nationkey < 20 THEN 'NOT_PRESENT' ELSE 'UNCLEAR' END AS pres,
   CASE WHEN c_mktsegment = 'BUILDING' THEN 'NOT_PRESENT' ELSE 'PRESENT' END AS person, CASE WHEN c_nationkey % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS conf,
   CASE WHEN c_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS answer FROM customer)"""


@query(
    """SELECT key, prediction, presence, person_presence, confidence, parse_ok,
  CASE WHEN k < 2 THEN 'ok' WHEN k = 2 THEN 'partial_recovered' WHEN k = 3 THEN 'invalid' ELSE 'empty' END AS parse_status,
  CASE WHEN k < 2 THEN CASE WHEN parse_ok THEN 'json_object' ELSE 'json_missing_required_fields' END WHEN k = 2 THEN 'partial_json_fields'
   WHEN k = 3 THEN 'non_json_fallback' ELSE 'empty_text' END AS parse_reason FROM verifier""",
    ("verifier",),
)
def parse_verifier(spark, sf):
    return R.parse_verifier(verifier_rows(spark, sf)).drop("raw", "answer", "rationale", "parse_partial")


@query(
    """WITH a AS (SELECT *, presence = 'NOT_PRESENT' AND answer = 'YES' AND confidence = 'HIGH' AS flipped FROM verifier),
n AS (SELECT *, CASE WHEN flipped THEN 'NO' ELSE answer END AS now FROM a),
v AS (SELECT *, CASE WHEN NOT parse_ok THEN 'parse_fail' WHEN person_presence = 'NOT_PRESENT' THEN 'person_not_present'
  WHEN presence = 'NOT_PRESENT' AND answer = 'YES' AND confidence <> 'HIGH' THEN 'presence_conflict'
  WHEN presence = 'NOT_PRESENT' AND prediction = 'YES' THEN 'presence_prediction_conflict'
  WHEN prediction <> now AND confidence <> 'HIGH' THEN 'uncertain_conflict' END AS reject_reason FROM n)
SELECT key, reject_reason, CASE WHEN reject_reason IS NULL THEN CASE WHEN prediction <> now THEN prediction ELSE now END END AS final_answer,
  CASE WHEN reject_reason = 'person_not_present' THEN 'reject_person_not_present' WHEN reject_reason IS NOT NULL THEN 'reject'
   WHEN prediction <> now THEN 'flip' WHEN flipped THEN 'flip_presence_not_present' ELSE 'keep' END AS action FROM v""",
    ("verifier",),
)
def verifier_decision(spark, sf):
    v = R.parse_verifier(verifier_rows(spark, sf)).withColumn("v", decisions.verify_visibility())
    return v.select("key", F.col("v.reject_reason").alias("reject_reason"), F.col("v.answer").alias("final_answer"), F.col("v.action").alias("action"))


@query(
    """SELECT p_partkey AS pos, p_size % 3 = 0 AS same, CASE WHEN p_size % 3 = 0 THEN p_name END AS canonical,
  CASE p_size % 4 WHEN 1 THEN 'NO' WHEN 2 THEN 'UNCLEAR' ELSE 'YES' END AS letter,
  CASE WHEN p_size % 5 IN (0, 1) THEN 'correct' ELSE 'wrong' END AS verdict, CASE WHEN p_size % 5 = 0 THEN 'correct' ELSE 'wrong' END AS strict_verdict FROM part"""
)
def short_answers(spark, sf):
    p = b.parts(spark, sf)
    size = F.col("p_size")
    same = F.when(size % 3 == 0, F.concat(F.lit(" Yes, canonical : "), F.col("p_name"))).otherwise(F.concat(F.lit("No. canonical: "), F.col("p_name")))
    letter = F.when(size % 4 == 0, " a.").when(size % 4 == 1, "B").when(size % 4 == 2, "c)").otherwise("?")
    verdict = F.when(size % 5 == 0, "Correct.").when(size % 5 == 1, "incorrect").when(size % 5 == 2, "wrong, not correct").otherwise("")
    return p.select(
        F.col("p_partkey").alias("pos"), R.parse_same_object(same).alias("s"),
        R.choose_by_letter(letter, {"A": "YES", "B": "NO", "C": "UNCLEAR"}).alias("letter"),
        R.parse_verdict(verdict).alias("verdict"), R.parse_verdict(verdict, strict=True).alias("strict_verdict"),
    ).select("pos", "s.*", "letter", "verdict", "strict_verdict")


@query(
    """WITH e AS (SELECT event_id, user_id % 3 AS s, CAST(floor(value) AS BIGINT) AS i, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, i AS input_tokens, CASE WHEN s = 1 THEN 0 WHEN s = 2 THEN CASE WHEN k = 0 THEN 0 ELSE k END ELSE k END AS output_tokens,
  CASE WHEN s = 0 THEN 3 ELSE 0 END AS cached_input_tokens, CASE WHEN s = 1 THEN i + 9 ELSE i + k END AS total_tokens FROM e"""
)
def usage_fields(spark, sf):
    """Token counts in three payload shapes; the last one leaves the written tokens to be worked out."""
    i, k = F.floor("value").cast("bigint"), F.get_json_object("props", "$.k").cast("bigint")
    a = F.to_json(F.struct(F.struct(i.alias("prompt_tokens"), k.alias("completion_tokens"), F.struct(F.lit(3).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage")))
    c = F.to_json(F.struct(F.struct(i.alias("input_tokens"), (i + 9).alias("total_tokens")).alias("usage")))
    d = F.to_json(F.struct(F.struct(i.alias("promptTokenCount"), (i + k).alias("totalTokenCount")).alias("usageMetadata")))
    payload = F.when(F.col("user_id") % 3 == 0, a).when(F.col("user_id") % 3 == 1, c).otherwise(d)
    return b.table(spark, sf, "events").select("event_id", R.extract_usage(payload).alias("u")).select("event_id", "u.*")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN {strip_sql("text || chr(10) || lang")} ELSE {strip_sql('text')} END AS answer,
  CASE doc_id % 5 WHEN 0 THEN 'stop' WHEN 4 THEN 'MAX_TOKENS' ELSE '' END AS finish_reason FROM documents"""
)
def response_texts(spark, sf):
    """Whole documents inside five payload shapes."""
    k = F.col("doc_id") % 5
    part = F.struct(F.col("text"))
    shapes = [
        F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices")),
        F.struct(F.array(F.struct(F.struct(F.array(part, F.struct(F.col("lang").alias("text"))).alias("content")).alias("message"))).alias("choices")),
        F.struct(F.array(part).alias("choices")),
        F.struct(F.array(F.struct(F.array(part).alias("content"))).alias("output")),
        F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"), F.lit("MAX_TOKENS").alias("finishReason"))).alias("candidates")),
    ]
    payload = F.when(k == 0, F.to_json(shapes[0]))
    for i in range(1, 5):
        payload = payload.when(k == i, F.to_json(shapes[i]))
    d = b.table(spark, sf, "documents").select("doc_id", payload.alias("payload"))
    return d.select("doc_id", R.extract_text("payload").alias("t")).select("doc_id", F.col("t.text").alias("answer"), F.col("t.finish_reason").alias("finish_reason"))


MESSAGES = [
    ("429 quota exceeded", "quota", "quota_or_billing_limit"),
    ("insufficient_quota for key", "quota", "insufficient_quota"),
    ("RESOURCE_EXHAUSTED: quota", "quota", "resource_exhausted_quota"),
    ("api error 403: permission denied", "auth", "auth_or_permission_error"),
    ("API error 404 NOT_FOUND", "not_found", ""),
    ("Read timed out", "transient", ""),
    ("api error 503", "transient", ""),
    ("Invalid API key", "unknown", "invalid_api_key"),
    ("No module named x", "unknown", "missing_api_package"),
    ("odd failure", "unknown", ""),
]


def error_rows(spark, sf):
    """Events as failed calls; the number in the props picks the message."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    msg = F.element_at(F.array(*[F.lit(m) for m, _, _ in MESSAGES]), k + 1)
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("pos"), F.col("event_type").alias("model_key"), F.when(F.col("value") > 20, msg).otherwise("").alias("error")
    )


PICK = "CASE CAST(json_extract(props, '$.k') AS INTEGER) % 10 " + "{} END"
CLASS = PICK.format(" ".join(f"WHEN {i} THEN '{c}'" for i, (_, c, _) in enumerate(MESSAGES)))
FATAL = PICK.format(" ".join(f"WHEN {i} THEN '{f}'" for i, (_, _, f) in enumerate(MESSAGES)))
b.CTES["failures"] = f"""SELECT event_id AS pos, event_type AS model_key, CASE WHEN value > 20 THEN {CLASS} ELSE 'unknown' END AS class,
  CASE WHEN value > 20 THEN {FATAL} ELSE '' END AS fatal FROM events"""


@query("SELECT pos, class, class IN ('quota', 'auth', 'not_found') AS hard, fatal FROM failures", ("failures",))
def error_class(spark, sf):
    return error_rows(spark, sf).select(
        "pos", R.classify_error("error").alias("class"), R.is_hard_error("error").alias("hard"), R.fatal_reason("error").alias("fatal")
    )


@query(
    """SELECT pos, model_key FROM failures LEFT JOIN (SELECT model_key, min(pos) AS f FROM failures WHERE fatal <> '' GROUP BY 1) USING (model_key)
WHERE f IS NULL OR pos <= f""",
    ("failures",),
)
def cut_at_fatal(spark, sf):
    return campaign.cut_at_fatal(error_rows(spark, sf), R.fatal_reason("error") != "").select("pos", "model_key")


# --- label decisions -----------------------------------------------------------------------------------------------

@query(
    """WITH t AS (SELECT p_partkey AS pos, p_name AS s, p_size, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN 'blue cup'
  WHEN 3 THEN 'thing' WHEN 4 THEN NULL ELSE 'green jar' END AS l1, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 2 END AS c1,
  p_partkey % 6 <> 4 AS ok1, CASE WHEN p_size % 2 = 0 THEN 'gray lamp' END AS l2, p_partkey % 5 <> 0 AS ok2 FROM part),
m AS (SELECT *, l1 IN ('blue cup', 'thing', 'green jar') AS mis FROM t), v AS (SELECT *, coalesce(l1 <> 'thing' AND c1 >= 1, false) AS v1, coalesce(mis AND l2 IS NOT NULL, false) AS v2 FROM m)
SELECT pos, CASE WHEN v2 THEN l2 WHEN v1 THEN l1 ELSE s END AS final_label, CASE WHEN v2 THEN 'teacher_pass2' WHEN v1 THEN 'teacher_pass1' ELSE 'student_fallback' END AS final_source,
  coalesce(mis, false) AS mismatch, CASE WHEN NOT ok1 THEN 'pass1_parse_fail' WHEN coalesce(mis, false) AND NOT ok2 THEN 'pass2_parse_fail' END AS drop_reason,
  CASE WHEN v2 THEN l2 WHEN v1 THEN l1 ELSE s END <> s AS applied FROM v"""
)
def teacher_decision(spark, sf):
    p = b.parts(spark, sf)
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    l1 = F.when(k == 0, F.col("p_name")).when(k == 1, F.substring_index("p_name", " ", -1)).when(k == 2, "blue cup").when(k == 3, "thing").when(k == 5, "green jar")
    conf = F.when(size % 3 == 0, "LOW").when(size % 3 == 1, "MEDIUM").otherwise("HIGH")
    fields = [F.lit("CORRECT").alias("qwen_verdict"), F.lit("why").alias("rationale")]
    student = p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("student_label"))
    pass1 = p.select(F.col("p_partkey").alias("pos"), l1.alias("final_label"), conf.alias("confidence"), *fields, (k != 4).alias("parse_ok"))
    pass2 = p.select(
        F.col("p_partkey").alias("pos"), F.when(size % 2 == 0, "gray lamp").alias("final_label"), F.lit("HIGH").alias("confidence"), *fields,
        (F.col("p_partkey") % 5 != 0).alias("parse_ok"),
    )
    out = decisions.teacher_final(student, pass1, pass2, keys=("pos",))
    return out.select("pos", "final_label", "final_source", "mismatch", "drop_reason", "applied")


@query(
    f"""SELECT pos, CASE WHEN take THEN sc ELSE a END AS label, take AS applied FROM (SELECT *, sc IS NOT NULL AND (size % 3 <> 0 OR {generic_sql('a')}
  OR coalesce(contains(trim(lower(a)), ' or ') OR contains(trim(lower(a)), ' and ') OR trim(lower(a)) LIKE '% on', false)) AS take
  FROM (SELECT *, {sanitize_sql('cue', 'sc')} FROM texts))""",
    ("texts",),
)
def arbiter_decision(spark, sf):
    from benchspark.plans.labelling import texts

    conf = F.when(F.col("size") % 3 == 0, "LOW").when(F.col("size") % 3 == 1, "MEDIUM").otherwise("HIGH")
    t = texts(spark, sf).withColumn("r", decisions.apply_arbiter("a", "cue", conf))
    return t.select("pos", F.col("r.label").alias("label"), F.col("r.applied").alias("applied"))


@query(
    """WITH g AS (SELECT p_partkey AS pos, p_size, p_name AS cur, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'gray lamp' END AS prop, p_partkey % 3 = 0 AS weak,
  p_size % 3 <> 0 AS sure, p_size % 5 = 0 AS worse, p_partkey % 2 = 0 AS better, p_size % 7 = 0 AS switched,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'odd mug' ELSE 'lamp' END AS ref, p_size % 4 <> 1 AS ref_sure FROM part),
h AS (SELECT *, prop IS NOT NULL AND NOT worse AND (sure OR weak) AND (better OR switched OR weak) AS passed FROM g),
r AS (SELECT *, CASE WHEN NOT passed THEN 'proposal_gate_fail' WHEN ref IS NULL THEN 'qwen_missing_label' WHEN ref <> 'lamp' THEN 'qwen_no_match'
  WHEN NOT ref_sure AND NOT weak THEN 'qwen_low_conf' END AS blocked FROM h)
SELECT pos, passed AS gate_passed, blocked AS blocked_reason, blocked IS NULL AS applied, CASE WHEN blocked IS NULL THEN ref ELSE CASE WHEN weak THEN 'thing' ELSE cur END END AS final_label FROM r"""
)
def guardrail_gate(spark, sf):
    """The dot and ray cues agree with the proposal on even keys, with nothing on odd ones."""
    p = b.parts(spark, sf)
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = p.select(
        k.alias("pos"),
        F.when(k % 3 == 0, "thing").otherwise(F.col("p_name")).alias("current"),
        F.when(k % 4 != 0, "gray lamp").alias("proposed"),
        F.when(size % 3 != 0, "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(size % 7 == 0, "switch_it").otherwise("keep").alias("decision"),
        F.when(size % 5 == 0, "YES").otherwise("NO").alias("scene_fit_current"),
        F.lit("no").alias("scene_fit_proposed"),
        F.when(k % 2 == 0, "lamp").otherwise("zebra").alias("dot"), F.lit("zebra").alias("ray"),
        F.array(F.lit("gray lamp"), F.lit("mask")).alias("allowed"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "odd mug").otherwise("lamp").alias("refined_label"),
        F.when(size % 4 == 1, "LOW").otherwise("HIGH").alias("refined_confidence"),
    )
    return decisions.guardrail_gate(rows).select("pos", "gate_passed", "blocked_reason", "applied", "final_label")


@query(
    """WITH a AS (SELECT pos // 6 AS f, pos % 6 AS r, CASE WHEN pos % 10 = 3 THEN NULL WHEN pos % 10 < 3 THEN 'red object' ELSE label END AS lab, pos % 7 = 0 AS hit, cam, area FROM cams),
b AS (SELECT *, coalesce(lab <> '', false) AND NOT hit AS usable, coalesce(lab = 'red object', true) AS weak, max(r) OVER (PARTITION BY f) AS last_r FROM a),
c AS (SELECT f, min(r) FILTER (WHERE usable AND NOT weak) AS clear, max(r) FILTER (WHERE usable AND weak AND r = last_r) AS vague,
  arg_max(CASE WHEN hit THEN 'sam2_overlap_reject' WHEN lab IS NULL THEN 'canonical_fail' END, r) FILTER (WHERE hit OR lab IS NULL) AS code_any,
  arg_max_null(CASE WHEN hit THEN 'sam2_overlap_reject' WHEN lab IS NULL THEN 'canonical_fail' END, r) AS code FROM b GROUP BY 1),
d AS (SELECT c.*, a.cam, a.lab, a.area FROM c LEFT JOIN a ON a.f = c.f AND a.r = coalesce(c.clear, c.vague))
SELECT CAST(f AS VARCHAR) AS frame_key, CASE WHEN area >= 0.02 THEN cam END AS anchor_cam, CASE WHEN area >= 0.02 THEN lab END AS label,
  CASE WHEN area < 0.02 THEN 'conf_below_threshold' WHEN cam IS NULL THEN coalesce(code, 'canonical_fail') END AS fail_code FROM d""",
    ("cams",),
)
def anchor_choice(spark, sf):
    """Cameras in camera order are the attempts; the mask area stands for the confidence."""
    k = F.col("pos")
    label = F.when(k % 10 == 3, F.lit(None)).when(k % 10 < 3, "red object").otherwise(F.col("label"))
    rows = b.camera_rows(spark, sf).select(
        "frame_key", "cam", F.col("cam_pos").alias("anchor_rank"), label.alias("label"), (k % 7 == 0).alias("person_overlap"),
        F.col("mask_area_ratio").alias("confidence"),
    )
    return decisions.choose_anchor(rows, keys=("frame_key",), conf_threshold=0.02).drop("anchor_rank")


HASHED = portable_hash_sql("'42'", "frame_key", "cam")


@query(
    f"""WITH u AS (SELECT frame_key, cam, row_number() OVER (PARTITION BY frame_key ORDER BY NOT (cam = 'Cam1' AND pos // 6 % 2 = 0), {HASHED}, cam_pos) AS r
  FROM cams WHERE image_path IS NOT NULL AND coalesce(visible, false))
SELECT frame_key, cam AS query_cam FROM u WHERE r = 1""",
    ("cams",),
)
def query_camera(spark, sf):
    """The camera to ask about of every frame that has one."""
    c = b.camera_rows(spark, sf).withColumn("prefer_cam", F.when(F.floor(F.col("pos") / 6) % 2 == 0, "Cam1"))
    return decisions.pick_query_cam(c, keys=("frame_key",))


@query(
    f"""WITH u AS (SELECT frame_key, cam_pos, cam, pos % 4 <> 0 AS seen, {HASHED} AS h, bool_or(cam = 'Cam2') OVER (PARTITION BY frame_key) AS has
  FROM cams WHERE image_path IS NOT NULL AND coalesce(visible, false)),
t AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY cam <> 'Cam2', CASE WHEN has THEN cam_pos ELSE h END) AS r FROM u)
SELECT frame_key, arg_min(cam, r) AS query_cam FROM t WHERE seen AND r <= 2 GROUP BY 1""",
    ("cams",),
)
def object_camera(spark, sf):
    """Two looks per frame: the preferred camera and the next, or two by hash where the preferred one is of no use."""
    c = b.camera_rows(spark, sf).withColumns({"prefer_cam": F.lit("Cam2"), "object_visible": F.col("pos") % 4 != 0})
    return decisions.pick_query_cam(c, "object", checks=2, keys=("frame_key",))


@query(
    f"""WITH k AS (SELECT frame_key, cam, row_number() OVER (PARTITION BY frame_key ORDER BY cam <> 'Cam1', {HASHED}, cam) - 1 AS r, count(*) OVER (PARTITION BY frame_key) AS n FROM cams)
SELECT frame_key, CAST(r AS INTEGER) AS view_pos, cam FROM k
WHERE r < least(2, n) + {portable_hash_sql("'43'", "frame_key")} % (least(5, n) - least(2, n) + 1)""",
    ("cams",),
)
def view_sample(spark, sf):
    """Two to five cameras of every frame, the first camera among them."""
    return decisions.sample_views(b.camera_rows(spark, sf).withColumn("want", F.lit("Cam1")), 2, 5, keys=("frame_key",), prefer="want")


def _any(x: str, cues) -> str:
    return f"regexp_matches({x}, '{'|'.join(cues)}')"


REASONS = [
    "The cup is behind the torso, out of view.", "It lies in front of the body and within the forward field of view.", "The head faces left.",
    "", "It is visible. The line of sight is clear to the left. More text.", "Not visible, blocked.",
]


@query(
    f"""WITH t AS (SELECT p_partkey AS pos, [{', '.join("'" + r + "'" for r in REASONS)}][p_partkey % 6 + 1] AS r, CASE WHEN p_size % 2 = 0 THEN 'YES' ELSE 'NO' END AS a, 'fb about ' || p_name AS fb FROM part),
s AS (SELECT *, lower(CASE WHEN r = '' THEN fb ELSE CASE WHEN pos % 6 = 4 THEN 'It is visible. The line of sight is clear to the left.' ELSE r END END) AS low, lower(r) AS lr FROM t),
k AS (SELECT *, NOT (a = 'NO' AND regexp_matches(low, 'visible|in front')) AND NOT (a = 'YES' AND regexp_matches(low, 'not visible|behind|outside'))
  AND {_any('low', decisions.SPATIAL_CUES)} AND {_any('low', decisions.VIEW_CUES)}
  AND NOT (a = 'NO' AND {_any('low', decisions.CONTRA_POSITIVE)}) AND NOT (a = 'YES' AND {_any('low', decisions.CONTRA_NEGATIVE)}) AS keep FROM s)
SELECT pos, CASE WHEN keep THEN CASE WHEN pos % 6 = 4 THEN 'It is visible. The line of sight is clear to the left.' ELSE r END ELSE fb END AS reasoning,
  r <> '' AND {_any('lr', decisions.SPATIAL_CUES)} AND {_any('lr', decisions.VIEW_CUES)} AS cues,
  r <> '' AND CASE WHEN a = 'YES' THEN {_any('lr', decisions.SOFT_POSITIVE)} AND NOT {_any('lr', decisions.SOFT_NEGATIVE)}
   ELSE {_any('lr', decisions.SOFT_NEGATIVE)} AND NOT {_any('lr', decisions.SOFT_POSITIVE)} END AS soft FROM k"""
)
def reasoning_checks(spark, sf):
    p = b.parts(spark, sf)
    r = F.element_at(F.array(*[F.lit(x) for x in REASONS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    d = p.select(
        F.col("p_partkey").alias("pos"), r.alias("r"), F.when(F.col("p_size") % 2 == 0, "YES").otherwise("NO").alias("a"),
        F.concat(F.lit("fb about "), F.col("p_name")).alias("fb"),
    )
    return d.select(
        "pos", decisions.check_reasoning("a", "r", "fb").alias("reasoning"), decisions.has_cues("r").alias("cues"), decisions.soft_verify("a", "r").alias("soft")
    )


# --- samples -------------------------------------------------------------------------------------------------------

#: The shown frame number is cut to four digits, so the whole one is needed to tell frames apart.
FRAME = ("split", "seq", "frame_id", "frame_key")


def task_views(spark, sf):
    c = b.frame_cams(spark, sf)
    return c.withColumns({"image": F.col("image_path"), "recorded": F.when(F.col("pos") % 10 == 0, "yes")})


VIEWS3 = """v AS (SELECT split, seq, frame_id, f, cam, cam_pos, image_path, CASE WHEN visible THEN 'YES' WHEN NOT visible THEN 'NO' WHEN pos % 10 = 0 THEN 'YES' END AS yn FROM cams),
g AS (SELECT split, seq, frame_id, f, count(*) AS n, count(*) FILTER (WHERE image_path IS NOT NULL AND yn IS NOT NULL) AS used,
  coalesce(bool_or(yn = 'YES') FILTER (WHERE image_path IS NOT NULL AND yn IS NOT NULL), false) AS any_yes,
  coalesce(bool_and(yn = 'YES') FILTER (WHERE image_path IS NOT NULL AND yn IS NOT NULL), false) AS all_yes,
  string_agg(cam || ': ' || yn, '. ' ORDER BY cam_pos) FILTER (WHERE image_path IS NOT NULL AND yn IS NOT NULL) AS listed,
  string_agg(cam, ',' ORDER BY cam_pos) FILTER (WHERE image_path IS NOT NULL AND yn IS NOT NULL) AS cams FROM v GROUP BY ALL)"""


@query(
    f"""WITH {VIEWS3} SELECT split, seq, frame_id, n AS frame_cams, used AS views, any_yes, all_yes,
  CASE WHEN n < 3 THEN 'not_enough_cams' WHEN used < 2 THEN 't3_not_enough_views' END AS reject FROM g""",
    ("cams",),
)
def per_view_answer(spark, sf):
    v = samples.per_view_answers(task_views(spark, sf), keys=FRAME)
    return v.select("split", "seq", "frame_id", "frame_cams", F.size("used").cast("bigint").alias("views"), "any_yes", "all_yes", "reject")


TARGETS = "t AS (SELECT f, max(label) FILTER (WHERE cam = 'Cam1') AS label, max(noun) FILTER (WHERE cam = 'Cam1') || ' hat' AS person FROM cams GROUP BY 1)"


@query(
    f"""WITH {VIEWS3}, {TARGETS} SELECT split, seq, frame_id,
  'The gaze target is ''' || lower(label) || '''. For each camera view, is it visible to the person wearing ' || person || '? Answer YES/NO per view.' AS question,
  'Gaze target: ' || label || '. ' || CASE WHEN any_yes THEN listed || '.' ELSE 'The ' || person || ' is looking at something outside these multi-view images.' END AS answer,
  'Gaze target is ' || label || '. ' || CASE WHEN NOT any_yes THEN 'None of the provided views contain the target object, so the gaze target lies outside these views.'
   WHEN all_yes THEN 'The target object is visible in all provided views.' ELSE 'The target object is visible in some provided views but not others.' END AS reasoning,
  cams AS cams, split AS scene, substr(md5('t3|' || split || '|' || seq || '|' || frame_id || '|' || label || '|' || cams), 1, 12) AS object_id
FROM g JOIN t USING (f) WHERE n >= 3 AND used >= 2""",
    ("cams",),
)
def task3_samples(spark, sf):
    c = task_views(spark, sf)
    targets = c.where("cam = 'Cam1'").select(*FRAME, "label", F.concat("mask_label", F.lit(" hat")).alias("person"))
    s = samples.build_task3(c, targets, keys=FRAME)
    return s.select(
        "split", "seq", "frame_id", "question", "answer", "reasoning", F.array_join("input_cams", ",").alias("cams"), "scene",
        F.get_json_object("meta", "$.object_id").alias("object_id"),
    )


AZ = "degrees(atan2({c}[3] - eye[3], {c}[1] - eye[1]))"


@query(
    f"""WITH p AS (SELECT a.rig, a.frame_id, a.k, {AZ.format(c='a.c').replace('eye', 'a.eye')} AS a1, {AZ.format(c='z.c').replace('eye', 'a.eye')} AS a2
  FROM dists a JOIN dists z ON a.rig = z.rig AND a.frame_id = z.frame_id AND z.k = a.k + 1),
s AS (SELECT *, a2 - a1 - 360 * ceil((a2 - a1 - 180) / 360) AS s FROM p),
t AS (SELECT *, CASE WHEN abs(s) < 1e-6 THEN 'no rotation' WHEN s > 0 THEN 'counterclockwise' ELSE 'clockwise' END AS d, CAST(round_even(abs(s), 0) AS INTEGER) AS n FROM s)
SELECT CAST(rig AS VARCHAR) AS seq, frame_id, 'Cam' || (k + 1) || ',' || 'Cam' || (k + 2) AS cams,
  'Camera 1 view: facing ' || k || chr(10) || 'Camera 2 view: facing ' || (k + 1) || chr(10) || 'Relative rotation: ~' || n || '° ' || d AS answer,
  'Camera 1 shows the person as: facing ' || k || '. Camera 2 shows the person as: facing ' || (k + 1) || '. The body-facing descriptions provide a qualitative check, while the numeric angle is derived from camera-center geometry around the 3D eye point. Relative rotation is ~' || n || '° ' || d || '.' AS reasoning FROM t""",
    b.RIG,
)
def task2_samples(spark, sf):
    """Every camera and the next one of its rig, about each eye point."""
    from benchspark.plans.annotation import distances

    d = distances(spark, sf).withColumn("n", F.substring("cam", 4, 1).cast("int"))

    def side(i, shift):
        return d.select(
            "split", "seq", "frame_id", (F.col("n") - shift).alias("n"), F.col("cam").alias(f"cam{i}"), F.col("center").alias(f"center{i}"),
            F.concat(F.lit("facing "), (F.col("n") - 1).cast("string")).alias(f"desc{i}"), F.concat("cam", F.lit(".jpg")).alias(f"image{i}"),
            *([F.col("eye3d")] if i == 1 else []),
        )

    pairs = side(1, 0).join(side(2, 1), ["split", "seq", "frame_id", "n"])
    s = samples.build_task2(pairs, geometry_reasoning=False)
    return s.select("seq", "frame_id", F.array_join("input_cams", ",").alias("cams"), "answer", "reasoning")


@query(
    f"""WITH {TARGETS}, q AS (SELECT * FROM cams JOIN t USING (f) WHERE cam = 'Cam3'),
v AS (SELECT split, seq, frame_id, t_label AS label, person, image_path, CASE WHEN visible THEN 'YES' WHEN NOT visible THEN 'NO' END AS first, pos FROM (SELECT q.*, t.label AS t_label FROM q JOIN t USING (f))),
d AS (SELECT *, pos % 4 = 0 AS absent, CASE WHEN pos % 3 = 0 THEN 'YES' ELSE 'NO' END AS pred, pos % 8 < 4 AS sure FROM v),
n AS (SELECT *, CASE WHEN absent AND first = 'YES' AND sure THEN 'NO' ELSE first END AS now FROM d),
r AS (SELECT *, CASE WHEN coalesce(label, '') = '' THEN 't4_object_proposal_fail' WHEN first IS NULL THEN 't4_no_visibility' WHEN image_path IS NULL THEN 't4_not_enough_views'
  WHEN absent AND first = 'YES' AND NOT sure THEN 'presence_conflict' WHEN absent AND pred = 'YES' THEN 'presence_prediction_conflict'
  WHEN pred <> now AND NOT sure THEN 'uncertain_conflict' END AS reject, CASE WHEN pred <> now THEN pred ELSE now END AS fin FROM n)
SELECT split, seq, frame_id, fin AS answer, 'In Cam3, can the person wearing ' || person || ' see the ''' || label || ''' from their line of sight? Answer YES or NO and explain briefly using front/behind/occlusion.' AS question,
  'Given the person''s head/torso direction, they are looking toward the ' || lower(label) || ', so the queried object ''' || lower(label) || ''' '
  || CASE WHEN fin = 'YES' THEN 'lies in front and within their forward field of view.' ELSE 'is behind or to the side and outside their forward field of view.' END AS reasoning
FROM r WHERE reject IS NULL""",
    ("cams",),
)
def task4_samples(spark, sf):
    """The third camera is asked about the first camera's label."""
    c = b.frame_cams(spark, sf)
    keys = list(FRAME)
    target = c.where("cam = 'Cam1'").select(*keys, F.col("label").alias("gaze_target"), F.concat("mask_label", F.lit(" hat")).alias("person"))
    k = F.col("pos")
    rows = c.where("cam = 'Cam3'").select(
        *keys, F.col("cam").alias("query_cam"), "visible", F.col("image_path").alias("image"),
        F.when(k % 3 == 0, "YES").otherwise("NO").alias("prediction"), F.when(k % 4 == 0, "NOT_PRESENT").otherwise("PRESENT").alias("presence"),
        F.lit("PRESENT").alias("person_presence"), F.when(k % 8 < 4, "HIGH").otherwise("LOW").alias("confidence"), F.lit(True).alias("parse_ok"),
    ).join(target, keys)
    return samples.build_task4(rows).select("split", "seq", "frame_id", "answer", "question", "reasoning")


@query(
    """WITH l AS (SELECT f, count(*) AS n, string_agg(cam, ',' ORDER BY cam) AS cams FROM cams WHERE image_path IS NOT NULL GROUP BY 1),
r AS (SELECT cams.*, l.cams AS listed FROM cams JOIN l USING (f) WHERE cam = 'Cam1' AND cx IS NOT NULL AND l.n >= 2)
SELECT split, seq, frame_id, label AS answer, 'Using all camera views, what is the person wearing ' || noun || ' hat looking at?' AS question, listed AS cams,
  substr(md5('t1|' || split || '|' || seq || '|' || frame_id || '|Cam1|' || label), 1, 12) AS object_id FROM r""",
    ("cams",),
)
def task1_samples(spark, sf):
    """The first camera anchors every frame in which it has a point and two cameras have images."""
    c, keys = b.frame_cams(spark, sf), list(FRAME)
    one = c.where("image_path is not null").groupBy(*keys, "cam").agg(F.first("image_path").alias("image"))
    images = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cam", "image"))).alias("input_images"))
    anchors = c.where("cam = 'Cam1' and coord is not null").join(images, keys)
    frames = anchors.select(
        *keys, F.col("cam").alias("anchor_cam"), F.concat("mask_label", F.lit(" hat")).alias("person"),
        F.col("label").alias("canonical"), F.col("mask_label").alias("anchor_label"), F.col("bbox_gaze_dist_norm").alias("confidence"),
        geo.at("coord", 0).alias("gaze_x"), geo.at("coord", 1).alias("gaze_y"), "mask_area_ratio", geo.valid_box("body").alias("ray_available"),
        F.transform("input_images", lambda i: i["cam"]).alias("input_cams"), "input_images",
    )
    s = samples.build_task1(frames)
    return s.select(
        "split", "seq", "frame_id", "answer", "question", F.array_join("input_cams", ",").alias("cams"),
        F.get_json_object("meta", "$.object_id").alias("object_id"),
    )


# --- metrics -------------------------------------------------------------------------------------------------------

def pairs(spark, sf):
    """A user turn is the reference of the assistant turn that follows; the conversation picks one of four models."""
    c = b.table(spark, sf, "conversations")
    ask = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    reply = c.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("assistant\n"), F.col("text")).alias("answer"))
    return reply.join(ask, ["conv_id", "turn"]).select(
        F.concat(F.lit("m"), F.col("conv_id") % 4).alias("model_key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "answer", "reference"
    )


b.CTES |= {
    "pairs": f"""SELECT 'm' || (a.conv_id % 4) AS model_key, a.conv_id * 1000 + a.turn AS pair_id, {words_sql('a.text')} AS ta, {words_sql('u.text')} AS tr
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user'""",
    "gram_rows": """SELECT model_key, pair_id, n, unnest(list_transform(range(1, len(ta) - n + 2), lambda i: array_to_string(ta[i:i + n - 1], ' '))) AS gram, 1 AS c, 0 AS r
  FROM pairs, range(1, 5) t(n) UNION ALL
  SELECT model_key, pair_id, n, unnest(list_transform(range(1, len(tr) - n + 2), lambda i: array_to_string(tr[i:i + n - 1], ' '))), 0, 1 FROM pairs, range(1, 5) t(n)""",
    "grams": "SELECT model_key, pair_id, n, gram, sum(c) AS c, sum(r) AS r FROM gram_rows GROUP BY ALL",
    "docs": "SELECT model_key, count(*) AS docs, sum(len(ta)) AS la, sum(len(tr)) AS lr FROM pairs GROUP BY 1",
}
GRAMS = ("pairs", "gram_rows", "grams", "docs")


BLEU = """WITH p AS (SELECT model_key, n, sum(least(c, r)) AS hit, sum(c) AS total FROM grams GROUP BY 1, 2),
q AS (SELECT model_key, count(*) FILTER (WHERE hit > 0) AS orders, sum(CASE WHEN hit > 0 THEN ln(hit / total) END) AS lp FROM p GROUP BY 1)
SELECT model_key, round(CASE WHEN orders = 4 THEN CASE WHEN la >= lr THEN 1 ELSE exp(1 - lr / la) END * exp(lp / 4) ELSE 0 END::DOUBLE, 9) AS bleu FROM q JOIN docs USING (model_key)"""
CIDER = """WITH df AS (SELECT model_key, n, gram, count(*) AS df FROM grams WHERE r > 0 GROUP BY ALL),
v AS (SELECT g.model_key, g.pair_id, g.n, g.c * (ln(docs) - ln(greatest(1, coalesce(df, 0)))) AS h, g.r * (ln(docs) - ln(greatest(1, coalesce(df, 0)))) AS f
  FROM grams g JOIN docs USING (model_key) LEFT JOIN df USING (model_key, n, gram)),
s AS (SELECT model_key, pair_id, n, sum(least(h, f) * f) AS dot, sum(h * h) AS hh, sum(f * f) AS ff FROM v GROUP BY ALL),
p AS (SELECT model_key, pair_id, sum(CASE WHEN hh > 0 AND ff > 0 THEN dot / (sqrt(hh) * sqrt(ff)) ELSE 0 END) / 4 AS sim FROM s GROUP BY ALL)
SELECT model_key, round(avg(10 * coalesce(sim, 0) * exp(-((len(ta) - len(tr))**2) / 72)), 8) AS cider FROM pairs LEFT JOIN p USING (model_key, pair_id) GROUP BY 1"""
# the plain table of lengths, a row of it per token of the answer: each cell is the greatest of what stands left of it
ROUGE = """WITH scored AS (SELECT model_key, la, lr, lcs FROM (
  WITH RECURSIVE t(model_key, pair_id, i, cells) AS (
    SELECT model_key, pair_id, 0, list_transform(range(len(tr) + 1), lambda x: 0) FROM pairs
    UNION ALL
    SELECT model_key, pair_id, i + 1, list_transform(range(1, len(found) + 1), lambda k: list_max(found[1:k])) FROM (
      SELECT t.model_key, t.pair_id, i, [0] || list_transform(range(1, len(tr) + 1), lambda k: CASE WHEN tr[k] = ta[i + 1] THEN cells[k] + 1 ELSE cells[k + 1] END) AS found
      FROM t JOIN pairs p ON t.model_key = p.model_key AND t.pair_id = p.pair_id WHERE i < len(ta)))
  SELECT p.model_key, len(ta) AS la, len(tr) AS lr, list_max(cells) AS lcs FROM t JOIN pairs p ON t.model_key = p.model_key AND t.pair_id = p.pair_id AND i = len(ta)))
SELECT model_key, round(avg(CASE WHEN lcs > 0 THEN 2.44 * (lcs / la) * (lcs / lr) / (lcs / lr + 1.44 * (lcs / la)) ELSE 0 END), 9) AS rouge_l FROM scored GROUP BY 1"""


@query(BLEU, GRAMS)
def bleu4(spark, sf):
    return metrics.bleu(pairs(spark, sf)).withColumn("bleu", F.round("bleu", 9))


@query(ROUGE, GRAMS[:1])
def rouge_l(spark, sf):
    return metrics.rouge_l(pairs(spark, sf)).withColumn("rouge_l", F.round("rouge_l", 9))


@query(CIDER, GRAMS)
def cider(spark, sf):
    return metrics.cider(pairs(spark, sf)).withColumn("cider", F.round("cider", 8))


@query(
    """SELECT 'm' || (a.label % 3) AS model_key, round(avg(CASE WHEN na > 0 AND nb > 0 THEN d / (sqrt(na) * sqrt(nb)) ELSE 0 END), 8) AS sentence_sim FROM
(SELECT a.label, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) AS d,
  list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE**2)) AS na, list_sum(list_transform(range(1, 65), lambda i: b.embedding[i]::DOUBLE**2)) AS nb
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a GROUP BY 1"""
)
def sentence_sim(spark, sf):
    """Each vector against its successor; the label picks one of three models."""
    e = b.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference_vec"))
    rows = e.join(nxt, "vec_id").select(F.concat(F.lit("m"), F.col("label") % 3).alias("model_key"), F.col("embedding").alias("answer_vec"), "reference_vec")
    return metrics.sentence_sim(rows).withColumn("sentence_sim", F.round("sentence_sim", 8))


@query(
    f"""SELECT model_key, docs AS sample_count, cider, round(bleu, 8) AS bleu, round(rouge_l, 8) AS rouge_l, CAST(NULL AS DOUBLE) AS sentence_sim,
  CAST(NULL AS DOUBLE) AS meteor, 'sentence_sim: no vectors | meteor: scorer unavailable' AS metric_errors
FROM docs LEFT JOIN ({CIDER}) USING (model_key) LEFT JOIN ({BLEU}) USING (model_key) LEFT JOIN ({ROUGE}) USING (model_key)""",
    GRAMS,
)
def semantic_table(spark, sf):
    """All metrics in one table."""
    t = metrics.semantic_table(pairs(spark, sf)).withColumns({c: F.round(c, 9) for c in ("bleu", "rouge_l")})
    return t.withColumns({c: F.round(c, 8) for c in ("cider", "bleu", "rouge_l")})
