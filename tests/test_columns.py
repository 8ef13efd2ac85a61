"""Literal rows for the column libraries."""

import random

from pyspark.sql import functions as F

from benchspark.functions import geometry as G
from benchspark.functions import labels as L
from benchspark.functions import responses as R
from benchspark.functions.text import first_word, half_even, last_word, more_words_than, norm_space, stable_id, strip, words
from benchspark.operators import decisions as D
from benchspark.operators.campaign import image_key, review_flags
from benchspark.operators.frames import frame_id_from_filename, frame_id_text, parse_visibility

lit = F.lit


def none():
    return lit(None).cast("string")


def check(values, cases):
    got = values({f"c{i}": c for i, (c, _) in enumerate(cases)})
    for i, (_, want) in enumerate(cases):
        assert got[f"c{i}"] == want, (i, got[f"c{i}"], want)


def test_rounding_is_pythons(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(0, 500) / rnd.randrange(1, 500),) for _ in range(2000)]
    data += [((0.178 + 0.1654 + 0.1642 + 0.1966) / 4,), (1 / 32,), (0.00005,), (2.5,), (0.0,)]
    rows = spark.createDataFrame(data, "x double").select("x", half_even("x", 4).alias("r"), half_even("x", 0).alias("z")).collect()
    for r in rows:
        assert r.r == round(r.x, 4)
        assert r.z == round(r.x)


def test_text_helpers_are_pythons(spark):
    texts = ["", " ", "a", " a b \n", "\x1cx\x0by　", "one two three four five six seven", "tab\there  there"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip("t").alias("s"), words("t").alias("w"), norm_space("t").alias("n"),
        first_word(strip("t")).alias("f"), last_word(strip("t")).alias("l"), more_words_than(strip("t"), 6).alias("m"),
    ).collect()
    for r in rows:
        toks = r.t.split()
        assert r.s == r.t.strip() and r.w == toks and r.n == " ".join(toks)
        assert r.f == (toks[0] if toks else None) and r.l == (toks[-1] if toks else None) and r.m == (len(toks) > 6)


def test_labels(values):
    check(values, [
        (L.clean_label(lit("x\n The (red) chair, big! ")), "The red chair big"),
        (L.clean_label(lit("some object here")), None),
        (L.clean_label(lit("cannot tell")), None),
        (L.strict_noun_phrase(lit("the chair is")), None),
        (L.strict_noun_phrase(lit("red chair")), "red chair"),
        (L.sanitize(lit("cup and bowl or jar")), "cup and bowl"),
        (L.sanitize(lit("cup on table on floor on x")), "cup on table"),
        (L.sanitize(lit("on")), None),
        (L.filter_phrase(lit("gray sofa")), None),
        (L.filter_phrase(lit("gray sofa"), strict=True), "gray sofa"),
        (L.is_generic(lit("red thing box")), False),
        (L.is_generic(lit("thing")), True),
        (L.is_generic(none()), True),
        (L.is_bleeding(lit("cup on")), True),
        (L.specificity(lit("cup on table")), 3.5),
        (L.specificity(none()), -1.0),
        (L.most_specific(F.array(lit("cup"), lit("red cup"), lit("big cup"))), "red cup"),
        (L.subset_match(lit("red cup"), lit("cup")), True),
        (L.subset_match(lit("cup on desk"), lit("cup")), False),
        (L.relaxed_match(lit("cup on desk"), lit("red cup")), True),
        (L.equivalent(lit("couch"), lit("big sofa")), True),
        (L.equivalent(lit("cup"), lit("jar")), False),
        (L.cue_agreement(lit("cup"), lit("red cup"), lit("bag")), 1),
        (L.canonicalize(lit("table"), lit("cup on table"), lit(0.005), lit("cup")),
         {"label": "cup on table", "mode": "dot_tiebreak_ray+mask_small_skip", "small_skip": True}),
        (L.triple_cue(lit("a"), lit("b"), lit("c"), none(), lit("cup"), lit("z")), {"label": "cup", "mode": "judge_mask_dot"}),
        (L.triple_cue(none(), lit("b"), none(), none(), none(), none()), {"label": "b", "mode": "fallback_single"}),
        (L.positional(lit("cup"), lit("desk")), "cup on desk"),
        (L.salvage(lit("red chair near the desk")), "red chair"),
        (L.repair_label(lit("cup on desk"), lit("x"), lit("y"), lit(False)), "cup"),
        (L.person_ref(lit("a person wearing blue shirt black pants white shoes now")),
         "the person wearing blue shirt, black pants, and white shoes"),
        (L.person_ref(lit("person")), "the person"),
        (L.clean_person(lit("The man is wearing blue shirt and")), "blue shirt"),
        (L.first_two_sentences(lit("A b. C d! E f.")), "A b. C d!"),
        (L.mask_quality(lit(1.3)), 0.5),
        (L.teacher_valid(lit("cup"), lit("medium")), True),
        (L.teacher_valid(lit("cup"), lit("LOW")), False),
    ])


def test_annotations_and_geometry(values):
    p = lambda *v: F.array(*[lit(float(x)) for x in v])
    check(values, [
        *[(parse_visibility(lit(t)), w) for t, w in
          [("0.7", False), ("1.9", True), ("2", None), ("Yes", True), ("maybe", None), ("true", True), ("1e0", True)]],
        (frame_id_text(frame_id_from_filename(lit("a/b/00012.x.jpg"))), "0012"),
        (frame_id_from_filename(lit("x/y.jpg")), None),
        (frame_id_text(lit(123456)), "123456"),
        (G.wrap_angle(lit(-180.0)), 180.0),
        (G.wrap_angle(lit(540.0)), 180.0),
        (G.relative_rotation(p(1, 0, 0), p(1, 5, 0), p(0, 0, 0))["direction"], "no rotation"),
        (G.relative_rotation(p(1, 0, 0), p(0, 0, 1), p(0, 0, 0))["direction"], "counterclockwise"),
        (G.point_box_distance(p(0, 0), p(3, 4, 10, 10)), 5.0),
        (G.point_box_distance(p(5, 5), p(3, 4, 10, 10)), 0.0),
        (G.anchor_score(p(0, 0), lit(None).cast("array<double>"))["bucket"], "unknown"),
        (G.expand_box(p(10, 10, 19, 19), lit(100), lit(100), 2.0), [4, 4, 24, 24]),
        (G.padded_box(lit(10), lit(10), lit(19), lit(19), lit(30), lit(30), 3, 0.12, 50), [7, 7, 22, 22]),
        (G.clip_box(p(-3, 2, 200, 300), lit(100), lit(50)), [0.0, 2.0, 99.0, 49.0]),
    ])


def test_responses(values):
    check(values, [
        (R.partial_field(lit('{"final_label": "red cha'), ["final_label"]), "red cha"),
        (R.json_field(R.extract_json(lit('```json\n{"a": "b"}\n```')), "a"), "b"),
        (R.json_field(R.extract_json(lit('so {"a": 3} end')), "a"), "3"),
        (R.extract_json(lit("none")).isNull(), True),
        (R.parse_health(lit('{"a": ')), {"parse_ok": False, "partial": True, "status": "invalid"}),
        (R.parse_health(lit("[1]")), {"parse_ok": True, "partial": False, "status": "ok"}),
        (R.parse_verdict(lit("incorrect")), "correct"),
        (R.parse_verdict(lit("incorrect"), strict=True), "wrong"),
        (R.fatal_reason(lit("429 quota exceeded")), "quota_or_billing_limit"),
        (R.classify_error(lit("API error 503")), "transient"),
        (R.choose_by_letter(lit(" b) "), {"A": "YES", "B": "NO"}), "NO"),
        (R.choose_by_letter(lit(""), {"A": "YES", "B": "NO"}), "YES"),
        (R.extract_usage(lit('{"usageMetadata": {"promptTokenCount": 10, "totalTokenCount": 15}}'))["output_tokens"], 5),
        (R.extract_usage(lit('{"usage": {"input_tokens": 4, "output_tokens": 2}}'))["total_tokens"], 6),
        (R.extract_text(lit('{"candidates": [{"content": {"parts": []}}, {"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]}'))["text"], "x\ny"),
        (R.extract_text(lit('{"choices": [{"message": {"content": " hi "}, "finish_reason": "stop"}]}')), {"text": "hi", "finish_reason": "stop"}),
    ])


def test_rules(values):
    verify = lambda a, p, pres, who, conf, **o: D.verify_visibility(lit(a), lit(p), lit(pres), lit(who), lit(conf), lit(True), **o)
    imgs = lit("/x/Commons_03_27_1_0047_Cam1_raw.jpg")
    check(values, [
        (verify("YES", "YES", "PRESENT", "PRESENT", "LOW")["action"], "keep"),
        (verify("YES", "NO", "NOT_PRESENT", "PRESENT", "HIGH")["action"], "flip_presence_not_present"),
        (verify("YES", "NO", "NOT_PRESENT", "PRESENT", "LOW")["reject_reason"], "presence_conflict"),
        (verify("NO", "YES", "NOT_PRESENT", "PRESENT", "HIGH")["reject_reason"], "presence_prediction_conflict"),
        (verify("NO", "YES", "PRESENT", "PRESENT", "HIGH")["answer"], "YES"),
        (verify("NO", "YES", "PRESENT", "PRESENT", "LOW")["reject_reason"], "uncertain_conflict"),
        (verify("NO", "YES", "PRESENT", "PRESENT", "LOW", reject_uncertain=False)["answer"], "NO"),
        (verify("NO", "YES", "PRESENT", "NOT_PRESENT", "LOW")["reject_reason"], "person_not_present"),
        (verify("NO", "?", "PRESENT", "PRESENT", "LOW", strict=False)["action"], "keep_non_strict"),
        (D.contradicts(lit("YES"), lit("It is behind them")), True),
        (D.soft_verify(lit("NO"), lit("not visible")), False),
        (D.soft_verify(lit("NO"), lit("it is blocked")), True),
        (image_key(imgs), {"scene": "commons", "seq": "03_27_1", "frame": "0047"}),
        (image_key(lit("a_b_Cam1_raw.jpg")), {"scene": "unknown", "seq": "unknown", "frame": "unknown"}),
        (stable_id(lit("a"), lit(1)), __import__("hashlib").md5(b"a|1").hexdigest()[:12]),
    ])


def test_review_flags(spark):
    rows = spark.createDataFrame(
        [(4, "q", "YES"), (1, "", "man in"), (1, "the person with wearing x", "a b c d e f g"), (2, None, None)],
        "task_id int, question string, answer string",
    )
    assert [r.f for r in rows.select(review_flags().alias("f")).collect()] == [
        ["short_answer"],
        ["missing_question", "trailing_preposition", "task1_human_label"],
        ["weird_task1_question", "task1_long_label"],
        ["missing_question", "missing_answer"],
    ]
