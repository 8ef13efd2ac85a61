"""Queries against their SQL on tables whose keys have more digits than the given ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

#: Frames 1000 to 1049 and 10000 to 10499: some agree in split, sequence and the first four digits.
PARTS = "SELECT (CASE WHEN i < 300 THEN 6000 ELSE 59700 END + i)::BIGINT AS p_partkey, ['red', 'green', 'old'][1 + i % 3] || ' ' || ['rod', 'cup', 'gear', 'ring'][1 + i % 4] AS p_name, " \
    "'Brand#' || (1 + i % 5) AS p_brand, 'T' || (i % 7) AS p_type, (1 + i * 7 % 50)::INTEGER AS p_size, 900 + i::DOUBLE AS p_retailprice FROM range(3300) t(i)"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("large-keys"))
    duckdb.sql(f"COPY ({PARTS}) TO '{folder}/part.parquet'")
    return folder


def rows_of(spark, sf, name, *tables):
    """Rows of the query and of its SQL, columns in the same order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, sf).select(*columns).collect()
    return sorted((tuple(r) for r in got), key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["anchor_rank", "per_view_answer", "task1_samples", "task3_samples", "task4_samples"])
def test_frames_with_long_numbers_stay_apart(spark, tables, name):
    got, want = rows_of(spark, tables, name, "part")
    assert got == want


def test_eye_points_of_long_document_numbers(spark, tmp_path):
    docs = "SELECT (9990 + i)::BIGINT AS doc_id, 'src1' AS source, (40 + i)::BIGINT AS n_chars FROM range(25) t(i)"
    duckdb.sql(f"COPY ({docs}) TO '{tmp_path}/documents.parquet'")
    got, want = rows_of(spark, str(tmp_path), "eye_points", "documents")
    assert got == want and len(got) == 25


@pytest.mark.parametrize("name", ["distractor_points", "label_maps", "cue_choice", "teacher_decision"])
def test_costly_rules_leave_the_task_that_reads_the_file(spark, tables, name):
    rows = entry.queries()[name](spark, tables)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got, want = rows_of(spark, tables, name, "part")
    assert got == want


def test_fixed_distractors_need_no_join(spark, tables):
    got, want = rows_of(spark, tables, "distractor_fixed", "part")
    assert got == want
    assert "Join" not in entry.queries()["distractor_fixed"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
