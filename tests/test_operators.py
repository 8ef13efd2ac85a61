"""Table operators against plain statements of their rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchspark.operators import assemble, campaign, decisions, masks, merge, metrics, qa, review, rig, samples, views
from benchspark.operators.ranking import exact_quantiles, global_rank, position_slot
from benchspark.sources import inventory as inv

PRED = "sample_uid string, model_key string, model_id string, pos bigint, inference_answer string, error string, latency_s double"
VERD = "sample_uid string, model_key string, pos bigint, gemini_judge string, error string"


def test_global_rank_and_quantiles(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("aaab"), i, rnd.choice([0.5, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, pos bigint, v double")
    got = global_rank(df, [F.col("pos")], [position_slot("pos", 100)], ["g"]).collect()
    for g in "ab":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
    vals = sorted(d[2] for d in data)
    q = exact_quantiles(df, "v", linear={"p25": 0.25, "p50": 0.5}, nearest={"p90": 0.9}, slots=16).first()
    assert math.isclose(q.p25, np.percentile(vals, 25)) and math.isclose(q.p50, np.median(vals))
    assert q.p90 == vals[round(0.9 * (len(vals) - 1))]


def test_nearest_percentile_rounds_half_even(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 7)], "confidence double")
    assert qa.confidence_report(df).first().p10 == 1.0


def test_histogram_one_value(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "confidence double")
    assert [tuple(r) for r in qa.histogram(df).collect()] == [(0, 0.5, 0.5, 2)]


def test_scores(spark):
    manifest = spark.createDataFrame(
        [("s1", 1, campaign.TASK_ORDER[0], "a", "q", "g"), ("s2", 1, "odd", "a", "q", "g")],
        "sample_uid string, task_id int, task_type string, scene string, question string, groundtruth_answer string",
    )
    preds = spark.createDataFrame(
        [("s1", "m1", "", 1, "x", "", 0.1), ("s1", "m2", "", 1, "x", "", 0.1), ("s2", "m3", "", 1, "x", "", 0.1), ("zz", "m3", "", 2, "x", "", 0.1)], PRED
    )
    verdicts = spark.createDataFrame(
        [("s1", "m1", 1, "wrong", ""), ("s1", "m1", 2, " Correct ", ""), ("s1", "m2", 1, "correct", "")], VERD
    )
    reg = spark.createDataFrame(
        [(0, "m2", "M2", "g", "A"), (1, "m1", "M1", "g", "A"), (2, "m3", "M3", "g", "B"), (3, "m4", "M4", "g", "B")],
        "pos bigint, key string, label string, group string, track string",
    )
    cube = campaign.score_cube(manifest, preds, verdicts)
    t = {r.model_key: r for r in campaign.accuracy_table(cube, reg).collect()}
    # one of four tasks answered, one of one right
    assert (t["m1"].avg_task_accuracy, t["m1"].overall_accuracy) == (0.25, 1.0)
    # equal accuracy keeps registry order; no verdict and an unknown task count only in the total
    assert (t["m2"]["rank"], t["m1"]["rank"], t["m3"]["rank"]) == (1, 2, 3)
    assert (t["m3"].total, t["m3"].correct, t["m3"].overall_accuracy) == (1, 0, 0.0)
    assert [r.model_key for r in campaign.missing_models(reg, preds).collect()] == ["m4"]
    rows = campaign.eval_rows(manifest, preds, verdicts).collect()
    assert {(r.model_key, r.verdict) for r in rows} == {("m1", "correct"), ("m2", "correct"), ("m3", "")}


def test_registry(spark):
    reg = campaign.default_registry(spark)
    keys = lambda df: [r.key for r in df.orderBy("pos").collect()]
    assert "geminiflashlatest" not in keys(campaign.models_for_track(reg, "a"))
    assert keys(campaign.models_for_track(reg, "B"))[:2] == ["llava_video_7b", "llava_ov_7b"]
    assert set(keys(campaign.models_for_group(reg, "proprietary"))) < set(keys(campaign.models_for_group(reg, "all")))
    patch = spark.createDataFrame([("gpt4o", "new-id", {"a": "b"}), ("llava_next_8b", None, {"prompt_mode": "x"})],
                                  "key string, model_id string, extra map<string,string>")
    out = {r.key: r for r in campaign.apply_overrides(reg, patch).collect()}
    assert out["gpt4o"].model_id == "new-id" and out["gpt4o"].extra == {"a": "b"}
    assert out["llava_next_8b"].extra == {"prompt_mode": "x", "chat_template": "chatml-llava"}
    with pytest.raises(ValueError):
        campaign.models_for_track(reg, "C")


def test_merge_campaign_checks(spark):
    manifest = spark.createDataFrame([("s1", 1)], "sample_uid string, task_id int")
    reg = lambda mid: spark.createDataFrame([(0, "m1", mid)], "pos bigint, key string, model_id string")
    preds = lambda m: spark.createDataFrame([("s1", m)], "sample_uid string, model_key string")
    make = lambda m, mid="x", man=manifest: {"manifest": man, "registry": reg(mid), "predictions": preds(m), "verdicts": preds(m)}
    out = campaign.merge_campaigns({"a": make("m1"), "b": make("m2")})
    assert out["predictions"].count() == 2 and out["registry"].count() == 1
    with pytest.raises(ValueError, match="Conflicting"):
        campaign.check_merge({"a": make("m1"), "b": make("m2", "y")})
    with pytest.raises(ValueError, match="Duplicate"):
        campaign.check_merge({"a": make("m1"), "b": make("m1")})
    other = spark.createDataFrame([("s9", 1)], "sample_uid string, task_id int")
    with pytest.raises(ValueError, match="mismatch"):
        campaign.check_merge({"a": make("m1"), "b": make("m2", man=other)})
    with pytest.raises(ValueError):
        campaign.check_merge({"a": make("m1")})


def test_review(spark):
    m = spark.createDataFrame(
        [(0, "s1", 1, "t", "Commons", "03", "0047", "q", "a", ["i1"], ["short_answer"]),
         (1, "s2", 4, "t", "commons ", "03", "0047", "q", "YES", ["i1", "i2"], []),
         (2, "s3", 1, "t", None, "", None, "q", "a", [], [])],
        "idx bigint, sample_uid string, task_id int, task_type string, scene string, seq string, frame string, question string, "
        "groundtruth_answer string, image_paths array<string>, review_flags array<string>",
    )
    items = {r.bundle_id: r for r in review.review_items(m).collect()}
    assert items["commons||03||0047"].sample_count == 2 and "unknown||unknown||unknown" in items
    assert review.item_images(m).where("bundle_id = 'commons||03||0047'").count() == 2
    d = spark.createDataFrame(
        [("commons||03||0047", "approve", 1), ("commons||03||0047", "reject", 2), ("x", "later", 3)], "bundle_id string, decision string, pos bigint"
    )
    norm = review.normalize_decisions(d)
    assert {r.bundle_id: r.decision for r in norm.collect()} == {"commons||03||0047": "reject", "x": "undecided"}
    assert [r.sample_uid for r in review.apply_review(m, norm).collect()] == ["s3"]
    rep = review.review_report(m, norm).first()
    assert (rep.bundles_kept, rep.missing_decision_rows, rep.samples_removed) == (1, 1, 2)


def test_dedup_matches_a_plain_loop(spark):
    rnd = random.Random(5)
    data = [(s, i, rnd.choice(["hot"] * 4 + list("abc")), rnd.choice("xy")) for s in range(3) for i in range(120)]
    df = spark.createDataFrame(data, "source_pos int, idx bigint, question string, answer string").select(
        "*", F.lit(1).alias("task_id"), F.lit("t").alias("task_type"), F.lit("s").alias("scene"), F.lit("f").alias("timestamp")
    )
    first, exact, conflict, examples = {}, 0, 0, []
    for s, i, q, a in data:
        if q not in first:
            first[q] = (s, i, a)
        elif first[q][2] == a:
            exact += 1
        else:
            conflict += 1
            examples.append((*first[q][:2], s, i))
    keyed = merge.with_keys(df)
    c = merge.duplicate_counts(keyed).first()
    assert (c.merged_sample_count, c.exact_duplicates_dropped, c.conflict_duplicates_dropped) == (len(first), exact, conflict)
    assert {(r.source_pos, r.idx) for r in merge.dedup_keep_first(keyed).collect()} == {v[:2] for v in first.values()}
    got = [(r.kept_source, r.kept_index, r.drop_source, r.drop_index) for r in merge.conflicts(keyed, 50).collect()]
    assert sorted(got, key=lambda t: t[2:]) == examples[:50]


def test_balanced_quota_matches_the_loop(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        splits = [rnd.choice("aaabc") for _ in range(60)]
        target, names = rnd.randrange(1, 40), sorted(set(splits))
        share, taken, counts = max(1, math.ceil(target / len(names))), [], dict.fromkeys(names, 0)
        for i, s in enumerate(splits):
            if len(taken) < target and (counts[s] < share or all(v >= share for v in counts.values())):
                counts[s] += 1
                taken.append(i)
        df = spark.createDataFrame(list(zip(splits, range(60))), "split string, pos bigint")
        assert sorted(r.pos for r in assemble.select_balanced(df, target, len(names)).collect()) == taken


def test_recover_and_usage(spark):
    s = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 1)], "bundle_key string, task_id int")
    keys = spark.createDataFrame([(" k3 ",), ("",)], "bundle_key string")
    state = spark.createDataFrame([("task1", 1), ("task2", 9)], "counter string, n bigint")
    got = {r.counter: r.n for r in assemble.recover_counts(s, keys, state).collect()}
    assert got == {"task1": 2, "task2": 9, "task3": 0, "task4": 0, "bundle": 3}
    calls = spark.createDataFrame(
        [("f", "openai", "gpt-4o", 1000, 100, 400, None), ("", "gemini", "g", 1000, 100, 400, 2000)],
        "frame_key string, provider string, model string, input_tokens bigint, output_tokens bigint, cached_input_tokens bigint, total_tokens bigint",
    )
    u = {r.frame_key: r for r in assemble.usage_report(calls).collect()}
    assert u["f"].cost_usd_estimate == round((600 * 2.5 + 400 * 1.25 + 100 * 10) / 1e6, 10) and u["f"].total_tokens == 1100
    assert u["NO_FRAME_CONTEXT"].cost_usd_estimate == round((1000 * 0.3 + 100 * 2.5) / 1e6, 10)
    assert u[None].is_total and u[None].calls == 2


def test_interleave_gives_each_split_its_turns(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", f"q{i}") for i in range(90)], "split string, seq string")
    one = assemble.interleave(df, seed=1).collect()
    two = assemble.interleave(df.repartition(7), seed=1).collect()
    assert sorted(one) == sorted(two)
    assert sorted(r.turn for r in one if r.split == "b") == list(range(1, 31))


def plain_vote(items):
    def toks(s):
        return set(s.lower().split())

    def match(a, b):
        if " on " in a or " on " in b:
            return False
        return toks(a) <= toks(b) or toks(b) <= toks(a)

    clusters = []
    for lab, w in items:
        for c in clusters:
            if match(lab, c[0]):
                c[1].append(lab)
                c[2] += w
                break
        else:
            clusters.append([lab, [lab], w])
    spec = lambda s: len(s.split()) + (0.5 if " on " in s else 0)
    best = None
    for rep, labs, w in clusters:
        cand = max(labs, key=lambda s: (spec(s), len(s)))
        if best is None or round(w, 6) > best[0] or (round(w, 6) == best[0] and spec(cand) > best[1]):
            best = (round(w, 6), spec(cand), cand)
    return best[2]


def test_vote_matches_a_plain_loop(spark):
    rnd = random.Random(9)
    labels = ["cup", "red cup", "blue cup", "desk", "cup on desk", "lamp", "desk lamp"]
    rows, want = [], {}
    for f in range(60):
        cams = rnd.sample(range(1, 7), rnd.randint(1, 6))
        anchor = f"Cam{rnd.choice(cams)}"
        got = [(f"Cam{c}", c, rnd.choice(labels), rnd.choice([0.1, 0.15, 0.5])) for c in cams]
        ordered = sorted(got, key=lambda t: (t[0] != anchor, t[1]))
        close = min(ordered, key=lambda t: (t[3],))[0]
        items = [(lab, (2.0 if c == anchor else 1.0) * (0.8 if c == close and d <= 0.2 else 1.0)) for c, _, lab, d in ordered]
        want[str(f)] = plain_vote(items) if len(items) > 1 else items[0][0]
        rows += [(str(f), c, p, lab, d, anchor) for c, p, lab, d in got]
    df = spark.createDataFrame(rows, "frame_key string, cam string, cam_pos int, label string, bbox_gaze_dist_norm double, anchor_cam string")
    got = {r.frame_key: r.mv_label for r in views.multiview_vote(views.camera_weights(df)).collect()}
    assert got == want


def test_cut_at_fatal_keeps_the_first(spark):
    df = spark.createDataFrame([("m", 1, False), ("m", 2, True), ("m", 3, True), ("n", 1, False)], "model_key string, pos int, f boolean")
    got = {(r.model_key, r.pos) for r in campaign.cut_at_fatal(df, F.col("f")).collect()}
    assert got == {("m", 1), ("m", 2), ("n", 1)}


def test_rouge_matches_a_table_of_lengths(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rnd = random.Random(2)
    data, scores = [], []
    for i in range(80):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        data.append(("m", i, "assistant\n" + " ".join(a), " ".join(b)))
        n = lcs(a, b)
        if n:
            p, r = n / len(a), n / len(b)
            scores.append((1 + 1.44) * p * r / (r + 1.44 * p))
        else:
            scores.append(0.0)
    df = spark.createDataFrame(data, "model_key string, pair_id bigint, answer string, reference string")
    assert math.isclose(metrics.rouge_l(df).first().rouge_l, sum(scores) / len(scores))
    same = spark.createDataFrame([("m", 1, "a b c d e", "a b c d e"), ("m", 2, "f g h i j", "f g h i j")], df.schema)
    t = metrics.semantic_table(same).first()
    assert math.isclose(t.bleu, 1.0) and math.isclose(t.cider, 10.0) and math.isclose(t.rouge_l, 1.0)
    assert t.meteor is None and t.sample_count == 2


def test_rig_prefers_by_source_on_equal_scores(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("s", "q", f"Cam{i}", eye, [float(i * i), 1.0, 0.0]) for i in range(1, 5)]
    c = rig.camera_centers(spark.createDataFrame(rows, "split string, seq string, cam string, r array<double>, t array<double>"))
    assert {r.mode for r in rig.choose_convention(c).collect()} == {"world_to_cam"}
    assert {r.mode for r in rig.choose_convention(c, "json").collect()} == {"cam_to_world"}
    one = rig.rig_scores(c.where("cam = 'Cam1'")).first()
    assert one.score_a == 1e18


def test_distractor_points_stay_in_bounds(spark):
    df = spark.createDataFrame([("s", "q", str(i), [float(50 * i), 300.0], [400.0, 100.0, 200.0, 300.0]) for i in range(10)],
                               "split string, seq string, frame_id string, coord array<double>, body array<double>")
    pts = masks.distractor_points(df).join(df, ["split", "seq", "frame_id"]).collect()
    assert pts
    for p in pts:
        d = math.hypot(p.x - p.coord[0], p.y - p.coord[1])
        assert 0.02818 * 3.14 * 1000 <= d <= 950 and 20 <= p.x <= 979 and 20 <= p.y <= 729
        assert not (400 <= p.x <= 600 and 100 <= p.y <= 400)
    per = {}
    for p in pts:
        per.setdefault(p.frame_id, []).append(p.point_idx)
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 18 for v in per.values())


def test_frames_need_three_cameras_and_two_views(spark):
    rows = [("s", "q", f, f"Cam{i}", i, v, None, img) for f, cams in
            {"1": [(1, True, "a"), (2, False, "b"), (3, None, "c")], "2": [(1, True, "a"), (2, True, "b")], "3": [(1, True, "a"), (2, None, "b"), (3, None, None)]}.items()
            for i, v, img in cams]
    df = spark.createDataFrame(rows, "split string, seq string, frame_id string, cam string, cam_pos int, visible boolean, recorded string, image string")
    got = {r.frame_id: r.reject for r in samples.per_view_answers(df).collect()}
    assert got == {"1": None, "2": "not_enough_cams", "3": "t3_not_enough_views"}


def test_label_matrix_last_wins(spark):
    df = spark.createDataFrame([(1, "p", 1, "k", "a"), (2, "p", 1, "k", "b"), (3, "q", 1, "z", "c")], "idx int, provider string, task_id int, k string, answer string")
    got = {r.sample_key: (r.p, r.q) for r in qa.label_matrix(df, ["p", "q"], F.col("k")).collect()}
    assert got == {"k": ("b", ""), "z": ("", "c")}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    z = spark.createDataFrame([("y", 2), ("x", 1)], "b string, a int")
    assert inv.fingerprint(a).first() == inv.fingerprint(z).first()
    assert inv.fingerprint(a).first() != inv.fingerprint(a.limit(1)).first()


def test_query_camera_prefers(spark):
    rows = [("s", "q", "1", f"Cam{i}", i, i != 1, "img", "Cam3", i == 2) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "split string, seq string, frame_id string, cam string, cam_pos int, visible boolean, image_path string, prefer_cam string, object_visible boolean")
    assert decisions.pick_query_cam(df).first().query_cam == "Cam3"
    assert decisions.pick_query_cam(df, "object").first().query_cam == "Cam2"
    assert decisions.pick_query_cam(df, "object", checks=1).count() == 0


def test_fingerprint_sees_nulls_and_borders(spark):
    from benchspark.sources import inventory

    schema = "a string, b string, c array<string>, d array<string>"
    tables = [spark.createDataFrame([r], schema) for r in [(None, "a", ["x"], ["y"]), ("a", None, ["x", "y"], []), ("a", None, ["x"], ["y"])]]
    assert len({tuple(inventory.fingerprint(t).first()) for t in tables}) == 3
    assert inventory.fingerprint(tables[0]).first() == inventory.fingerprint(tables[0].repartition(3)).first()


def test_each_model_has_its_own_work_and_answers(spark):
    manifest = spark.createDataFrame([("s1",), ("s2",)], "sample_uid string")
    done = spark.createDataFrame([("s1", "m1", "")], "sample_uid string, model_key string, error string")
    models = spark.createDataFrame([("m1",), ("m2",)], "model_key string")
    todo = {(r.sample_uid, r.model_key) for r in campaign.pending(manifest, done, models=models).collect()}
    assert todo == {("s2", "m1"), ("s1", "m2"), ("s2", "m2")}
    schema = "sample_uid string, model_key string, pos int, inference_answer string, tokens_in int, tokens_out int, error string"
    primary = spark.createDataFrame([("s", "m1", 1, "", 1, 1, "bad"), ("s", "m2", 1, "", 1, 1, "bad")], schema)
    fallback = spark.createDataFrame([("s", "m1", 1, "old", 1, 1, ""), ("s", "m1", 2, "one", 1, 1, ""), ("s", "m2", 1, "two", 1, 1, "")], schema)
    got = sorted((r.model_key, r.inference_answer, r.error) for r in campaign.combine_answers(primary, fallback).collect())
    assert got == [("m1", "one", ""), ("m2", "two", "")]


def test_the_last_manifest_row_counts(spark):
    columns = "sample_uid string, task_id int, task_type string, scene string, question string, groundtruth_answer string, pos int"
    manifest = spark.createDataFrame([("s", 1, campaign.TASK_ORDER[0], "old", "q", "g", 1), ("s", 1, campaign.TASK_ORDER[0], "new", "q", "g", 2)], columns)
    preds = spark.createDataFrame([("s", "m", "", 1, "x", "", 0.1)], PRED)
    verdicts = spark.createDataFrame([("s", "m", 1, "correct", "")], VERD)
    assert [(r.scene, r.total, r.correct) for r in campaign.score_cube(manifest, preds, verdicts).collect()] == [("new", 1, 1)]
    assert [r.scene for r in campaign.eval_rows(manifest, preds, verdicts).collect()] == ["new"]


def test_content_ignores_the_key_order_of_nested_json(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"x":1,"y":2}}',), ('{"b":{"y":2,"x":1},"a":1}',), ("no json",)], "meta string")
    assert len({r.f for r in df.select(merge.content_fp(["meta"]).alias("f")).collect()}) == 2


def test_shared_folder_needs_a_setting_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from benchspark.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context), "x")
