"""Readers, writers and incremental runs."""

import json
import random

import pytest

from benchspark.operators import assemble, campaign
from benchspark.operators.frames import explode_cameras, normalize_frames
from benchspark.operators.rig import eye_points
from benchspark.sources import files, inventory, json_ranges
from benchspark.streaming import logs


def test_benchmark_to_manifest(spark, tmp_path):
    image = str(tmp_path / "Commons_03_27_1_0047_Cam1_raw.jpg")
    sample = {"task_id": 1, "task_type": "gaze_target_recognition", "question": "What is the person looking at?", "answer": "chair",
              "scene": "commons", "input_cams": ["Cam1"], "input_images": [{"cam": "Cam1", "image": image}], "meta": {"confidence": 0.5}}
    (tmp_path / "b.json").write_text(json.dumps({"samples": [sample, "oops", {**sample, "task_id": "1"}, {**sample, "input_images": []}]}, indent=1))
    rows = files.read_benchmark(spark, str(tmp_path / "b.json"))
    stored = spark.createDataFrame([(image,)], "path string")
    v = campaign.validate(rows, stored)
    assert [r.reason for r in v.orderBy("idx").collect()] == [None, "sample_not_object", "invalid_task_id", "missing_input_images"]
    m = campaign.manifest_rows(v, "/b.json").first()
    assert (m.scene, m.seq, m.frame, m.groundtruth_answer, m.camera_ids) == ("commons", "03_27_1", "0047", "chair", ["Cam1"])
    again = campaign.manifest_rows(v, "/b.json").first()
    assert again.sample_uid == m.sample_uid and len(m.sample_uid) == 20
    gone = campaign.validate(rows, stored.limit(0))
    assert gone.where("idx = 0").first().reason == "missing_image_files:1"
    (tmp_path / "l.json").write_text(json.dumps([sample, sample]))
    (tmp_path / "d.json").write_text(json.dumps({"data": [sample]}))
    assert files.read_benchmark_any(spark, [str(tmp_path / "l.json"), str(tmp_path / "d.json")]).count() == 3


def test_document_ranges(spark, tmp_path):
    """A document cut into hundreds of ranges gives every element with its place, whatever strings and nesting hold."""
    rng = random.Random(3)

    def element():
        if rng.random() < 0.1:
            return rng.choice([1, 2.5, None, True, "oops", 'a } b { " \\ ]', "é}"])
        return {"task_id": rng.choice([1, "2"]), "answer": "x}" * rng.randint(0, 30), "q": 'he said "hi" \\ {[' * rng.randint(0, 20),
                "meta": {"a": [1, {"b": []}], "s": "}{"}, "input_images": [{"cam": "C", "image": "p"}] * rng.randint(0, 3)}

    docs = {}
    for i, n in enumerate((1, 150, 0, 150, 80, 60)):
        items = [element() for _ in range(n)]
        wrapped = [{"samples": items}, {"meta": {"x": [1, {"samples": [9]}], "note}": "}"}, "note": "a } b", "samples": items, "tail": {"samples": [1]}, "n": 3}, {"data": items}, items][i % 4]
        docs[f"{i}.json"] = items
        (tmp_path / f"{i}.json").write_text(json.dumps(wrapped, indent=i % 2 or None, ensure_ascii=i < 3), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        paths = [str(tmp_path / f) for f in docs]
        assert spark.read.option("lineSep", "}").text(paths).rdd.getNumPartitions() > 100
        rows = json_ranges.read_elements(spark, paths, keys=("samples", "data"), bare=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    same = lambda e, raw: raw is None if e is None else raw == e if isinstance(e, str) else json.loads(raw) == e
    for f, items in docs.items():
        got = {r.idx: r.raw for r in rows if r.source.endswith(f)}
        assert sorted(got) == list(range(len(items))) and all(same(e, got[i]) for i, e in enumerate(items))
    with pytest.raises(ValueError, match="Expected object with list 'samples'"):
        json_ranges.read_elements(spark, paths[2])


def test_benchmark_document_round_trip(spark, tmp_path):
    path = str(tmp_path / "bench")
    rows = [(f"k{i % 40:02d}", i % 4 + 1, f"q }} \" {i % 40}") for i in range(200)] + [("k00", 1, 'q } " 0')] * 3
    samples = spark.createDataFrame(rows, "bundle_key string, task_id int, question string")
    rejects = spark.createDataFrame([("far",), ("far",), (None,)], "reason string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assemble.write_benchmark(samples.repartition(5), path, rejects=rejects, frames=rejects.limit(0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = files.read_benchmark(spark, path, folder=True).orderBy("idx").collect()
    assert [(r.idx, r.task_id, r.question) for r in back] == [(i, t, q) for i, (_, t, q) in enumerate(sorted(rows))]
    text = "".join(f.read_text() for f in sorted((tmp_path / "bench").glob("part-*")))
    doc = json.loads(text)
    assert doc["counts"]["samples"] == 203 and doc["reject_stats"] == {"by_reason": {"far": 2}} and doc["frame_stats"] == {"by_reason": {}}
    assert len(doc["samples"]) == 203 and len(list((tmp_path / "bench").glob("part-*"))) > 1
    assemble.write_benchmark(samples.limit(0), path)
    assert files.read_benchmark(spark, path, folder=True).count() == 0


def test_samples_are_parsed_once(spark, tmp_path):
    items = ['{"task_id": 7, "question": "a } b", "meta": {"half": 1.50}}', '"{\\"task_id\\": 3}"', '{"task_id" : "7", "answer": 2.50}', ' {"task_id": 8, "input_cams": "x", "answer": "y"}', "5", '{"task_id": 1, "answer": }']
    (tmp_path / "b.json").write_text('{"samples": [' + ",".join(items) + "]}")
    rows = files.read_benchmark(spark, str(tmp_path / "b.json"))
    got = [(r.task_id, r.raw_task_id, r.question, r.answer, r.meta, r.is_object) for r in rows.orderBy("idx").collect()]
    assert got == [(7, "7", "a } b", None, '{"half":1.5}', True), (3, "3", None, None, None, True), (None, "7", None, "2.5", None, True),
                   (8, "8", None, "y", None, True), (None, None, None, None, None, False), (None, None, None, None, None, None)]
    plan = rows.select("idx", "task_id", "question")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "raw_sample" not in plan


def test_logs_and_decisions(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"bundle_key": " k ", "sample": {"task_id": 2}}\n\nbroken{\n{"task_id": 3}\n{"other": 1}\n')
    got = files.read_jsonl_lenient(spark, str(tmp_path / "a.jsonl")).collect()
    assert sorted((r.bundle_key or "", r.task_id) for r in got) == [("", 3), ("k", 2)]
    pred = tmp_path / "predictions"
    pred.mkdir()
    (pred / "m.one.jsonl").write_text('{"sample_uid": "s", "inference_answer": "x"}\n')
    assert files.read_per_model(spark, str(pred)).first().source_model == "m.one"
    want = {"b1": "yes", "b2": "no"}
    (tmp_path / "d.csv").write_text("bundle_id,decision,note,reviewer,updated_at\nb1,yes,,,\nb2,no,,,\n")
    (tmp_path / "d1.json").write_text(json.dumps([{"bundle_id": "b1", "decision": "yes"}, {"bundle_id": "b2", "decision": "no"}]))
    (tmp_path / "d2.json").write_text(json.dumps({"decisions": [{"bundle_id": k, "decision": v} for k, v in want.items()]}))
    (tmp_path / "d3.json").write_text(json.dumps({"b1": {"decision": "yes"}, "b2": "no"}))
    (tmp_path / "d2.csv").write_text("reviewer,bundle_id,decision\nann,b1,yes\n,b2,no\n")
    for name in ("d.csv", "d2.csv", "d1.json", "d2.json", "d3.json"):
        assert {r.bundle_id: r.decision for r in files.read_decisions(spark, str(tmp_path / name)).collect()} == want, name
    df = spark.createDataFrame([("s", 1)], "a string, b int")
    files.write_jsonl(df, str(tmp_path / "out"))
    files.write_jsonl(df, str(tmp_path / "out"), mode="append")
    assert files.read_jsonl(spark, str(tmp_path / "out"), "a string, b int").count() == 2
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b"]


def test_annotation_documents(spark):
    docs = [
        ("m", json.dumps({"frames": {"0007": {"Cam2": {"visibility": 0.7, "coordinate": [1, 2]}}, "x": {}, "8": 3}})),
        ("l", json.dumps([{"filename": "a/0012.jpg", "Cam1": {"visibility": "Yes"}}, {"frame_id": 12345}, 5])),
        ("d", json.dumps({"frames": [1], "3": {"Cam6": {"visibility": True, "body": [1, 2, 3, 4]}}})),
    ]
    f = normalize_frames(spark.createDataFrame(docs, "seq string, value string"))
    assert sorted((r.seq, r.frame_id) for r in f.collect()) == [("d", "0003"), ("l", "0012"), ("l", "12345"), ("m", "0007")]
    cams = {(r.seq, r.cam): r for r in explode_cameras(f).collect()}
    assert cams[("m", "Cam2")].visible is False and cams[("m", "Cam2")].coord == [1.0, 2.0]
    assert cams[("d", "Cam6")].visible is True and cams[("d", "Cam6")].body == [1.0, 2.0, 3.0, 4.0]
    eyes = [("q", "src", json.dumps({"frames": [{"frame_id": 3, "eye3d": [1, 2]}, {"frame_id": "04", "eye": [1, 2, 3]}]})),
            ("z", "src", json.dumps({"5": {"eye3d": [], "eye": [4, 5, 6]}}))]
    e = {r.frame_id: r.eye3d for r in eye_points(spark.createDataFrame(eyes, "seq string, src string, value string")).collect()}
    assert e == {"0003": None, "0004": [1.0, 2.0, 3.0], "0005": [4.0, 5.0, 6.0]}


def test_inventory_choices(spark):
    paths = ["Data/s/q_1/Calibration/a/extri.yml", "Data/s/q_1/Calibration/extri_x.yml", "Data/s/q_1/Images/Cam1/0001.jpeg",
             "Data/s/q_1/Images/Cam1/0001.JPG", "t/Triangulate_3d_q_1.json", "Data/s/q_1/pose.json", "Annotations/s/q_1.json", "Annotations/s/d/x.json"]
    inv = spark.createDataFrame([(p,) for p in paths], "path string")
    seqs = inventory.list_sequences(inv)
    assert [tuple(r)[:2] for r in seqs.collect()] == [("s", "q_1")]
    assert inventory.choose_calib(inv, "extri").first().extri_path == paths[0]
    two = spark.createDataFrame([("s", "q_1"), ("s", "q_2")], "split string, seq string")
    tri = {r.seq: r.tri_path for r in inventory.choose_tri_path(inv, two).collect()}
    assert tri == {"q_1": paths[4], "q_2": paths[4]}
    assert inventory.choose_param_json(inv, two).first().param_path == paths[5]
    images = inventory.parse_images(inv)
    wanted = images.select("split", "seq", "cam", "frame_id").distinct()
    resolved = inventory.resolve_images(wanted, images)
    assert resolved.first().image_path == paths[3]
    assert inventory.image_list(resolved).first().input_images[0].image == "s_q_1_0001_Cam1_raw.jpg"


def test_ingest_keeps_the_first_row_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "sample_uid string, model_key string, pos int, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    rows(("a", "m", 2, 8), ("a", "m", 1, 1), ("b", "m", 1, 2), ("a", "n", 1, 3), ("b", "m", 5, 0)).coalesce(1).write.json(src)
    read = lambda: spark.readStream.schema(schema).json(src)
    logs.ingest_first(read(), out, ck).awaitTermination()
    rows(("a", "m", 0, 9), ("c", "m", 1, 4)).coalesce(1).write.mode("append").json(src)
    logs.ingest_first(read(), out, ck).awaitTermination()
    got = sorted((r.sample_uid, r.model_key, r.v) for r in spark.read.parquet(out).collect())
    assert got == [("a", "m", 1), ("a", "n", 3), ("b", "m", 2), ("c", "m", 4)]


def test_error_totals_add_up(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "task_id int, stage string, error_type string, model string"
    spark.createDataFrame([(1, "s", "quota", "m"), (0, "", "", None)], schema).coalesce(1).write.json(src)
    stream = spark.readStream.schema(schema).json(src)
    logs.error_counts(stream, str(tmp_path / "c"), str(tmp_path / "ck")).awaitTermination()
    seed = spark.createDataFrame([("total", None, 5)], "dimension string, value string, n bigint")
    got = {(r.dimension, r.value): r.n for r in logs.error_totals(spark, str(tmp_path / "c"), seed).collect()}
    assert got[("total", None)] == 7 and got[("task", "unknown")] == 1 and got[("stage", "s")] == 1
    assert got[("model", "unknown")] == 1 and got[("type", "quota")] == 1


def test_accept_log_snapshots(spark, tmp_path):
    """Batches hand their counts on: the snapshots of three runs are those of the whole log."""
    src, out = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "pos bigint, bundle_key string, task_id int"
    data = [(i, f"k{i // 4}", i % 4 + 1) for i in range(23)]
    for part in (data[:12] + [(0, "k0", 1)], data[12:14] + [(99, "k0", 1)], data[14:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(schema).json(src)
        logs.accept_log(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(f"{out}/log").count() == 23
    want = assemble.progress(spark.createDataFrame(data, schema), 5, last=5)
    got = logs.accept_snapshots(spark, out)
    key = lambda df: sorted((r.pos, r.total_accepts, r.task1, r.task4, tuple(r.last_samples)) for r in df.collect())
    assert key(got) == key(want) and [k[1] for k in key(got)] == [5, 10, 15, 20]
    assert key(got)[1][4] == (9, 8, 7, 6, 5)


def test_progress_merges_rejects(spark):
    s = spark.createDataFrame([(p, p % 4 + 1) for p in (1, 3, 4, 8, 9, 400000)], "pos bigint, task_id int")
    r = spark.createDataFrame([(0,), (2,), (3,), (5,), (10,)], "pos bigint")
    got = assemble.progress(s, 2, rejects=r, last=3).orderBy("pos").collect()
    assert [(x.pos, x.total_accepts, x.rejects, x.last_samples) for x in got] == [(3, 2, 3, [3, 1]), (8, 4, 4, [8, 4, 3]), (400000, 6, 5, [400000, 9, 8])]
    assert assemble.progress(s.limit(0), 2, rejects=r, last=3).count() == 0


def test_ingest_does_not_read_its_log(spark, tmp_path):
    """Earlier folders may be moved away: what was seen is stream state."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "sample_uid string, model_key string, pos int"
    for i, rows in enumerate(([("a", "m", 1), ("b", "m", 2)], [("a", "m", 0), ("c", "m", 4)], [("c", "m", 1), ("b", "m", 0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        logs.ingest_first(spark.readStream.schema(schema).json(src), f"{out}{i}", ck).awaitTermination()
    got = [sorted((r.sample_uid, r.pos) for r in spark.read.parquet(f"{out}{i}").collect()) for i in range(3)]
    assert got == [[("a", 1), ("b", 2)], [("c", 4)], []]
