"""A training corpus in five stages: language, quality, near duplicates, benchmark contamination, tokens.

Each stage works on all rows that the one before has kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.bpe import encode_documents, public_vocabulary
from benchspark.llm.common import bounded_batches, crc_of_id, staged, table
from benchspark.llm.decontaminate import find_contamination
from benchspark.llm.jaccard import jaccard_join
from benchspark.llm.langid import fit_centroids, identify_language
from benchspark.llm.quality import fit_quality, score_quality


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that no name of a document's column meets a name that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those too far from every centroid of the languages learned from these rows."""
    bounded_batches(spark)
    model = fit_centroids(docs.filter(crc_of_id() % 5 != 0))
    return identify_language(packed(docs), model, text="_row.text", keep=["_row"]).filter(~F.col("lang_rejected")).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts scored below 0.5 by a model of the labels of these rows."""
    bounded_batches(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels").filter(crc_of_id() % 3 != 1))
    return score_quality(packed(docs), model, text="_row.text", keep=["_row"]).filter(F.col("quality_score") >= 0.5).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of five-word shingles at 0.8 stays: the one of the smallest id.

    Rows without an id stay; repeated rows of the kept id stay together.
    """
    found = jaccard_join(docs, percent=80, size=5, links=False).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Texts are looked at by their digest, so rows without an id are searched too."""
    bounded_batches(spark)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    texts = docs.select(digest.alias("doc_id"), "text")
    found = staged(find_contamination(texts, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    rows = packed(docs).withColumn("_text", F.md5(F.coalesce(F.col("_row.text"), F.lit("")).cast("binary")))
    return rows.join(found, rows["_text"] == found["doc_id"], "left_anti").select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    bounded_batches(spark)
    rank_file, pattern = public_vocabulary()
    return encode_documents(docs, rank_file, pattern, digest=True, keep=["doc_id"])


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: Fitted models, components and merges have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
