"""The pipeline keeps clean rows, drops what each stage is for, keeps columns as they are, and ends on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from benchspark.llm import common

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[1] >= 0.99 * kept[0]
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(labels.get(i) == 0 for i in ids) <= 0.02 * len(ids)
    texts = [r.text for r in docs.collect()]
    assert len(texts) == len(set(texts))
    items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    assert not any(i in t for t in texts for i in items)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == ids


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    own = spark.newSession()
    common.bounded_batches(own)
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
    assert int(own.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        own.conf.set(key, "1024")
    common.bounded_batches(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "1024"


def test_empty(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """run over NULL ids and texts, repeated and long rows, and columns of names that the operators use."""
    docs = common.table(spark, SF, "documents").filter("doc_id < 150")
    item = common.table(spark, SF, "benchmark").orderBy("item_id").first().text
    some = docs.filter("lang = 'en' and n_chars > 1500").orderBy("doc_id").first()
    extra = [(None, some.text + " " + item, "en", "x", 1), (None, None, "en", "x", 1), (9001, "", None, None, 0), (9002, "one " + "word " * 30000, "en", "x", 1), (9003, some.text, "en", "x", 1), (9003, some.text, "en", "x", 1)]
    rows = docs.union(spark.createDataFrame(extra, docs.schema))
    for name in ("lang_pred", "lang_score", "lang_rejected", "quality_score", "_row", "_text", "n_links"):
        rows = rows.withColumn(name, F.lit("own"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        common.table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [r.doc_id for r in out.collect()]
    assert None not in ids and 9001 not in ids and 9003 not in ids and len(ids) > 50
    kept = corpus_pipeline.language(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns and {r.lang_score for r in kept.select("lang_score").distinct().collect()} == {"own"}
