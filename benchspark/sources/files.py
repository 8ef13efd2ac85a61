"""Benchmark, log and decision files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchspark.sources.json_ranges import element_texts, unwrapped, wrapped

IMAGES = T.ArrayType(T.StructType([T.StructField("cam", T.StringType()), T.StructField("image", T.StringType())]))

SAMPLE = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("scene", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("input_cams", T.ArrayType(T.StringType())),
        T.StructField("input_images", IMAGES),
        T.StructField("meta", T.StringType()),
    ]
)

PREDICTION = "sample_uid string, model_key string, model_id string, inference_answer string, error string, " \
    "latency_s double, tokens_in int, tokens_out int, timestamp string"
VERDICT = "sample_uid string, model_key string, gemini_judge string, judge_model string, judge_latency_s double, " \
    "error string, timestamp string"
DECISION = "bundle_id string, decision string, note string, reviewer string, updated_at string"


def _samples(elements: DataFrame) -> DataFrame:
    """An object is parsed once, where it stands; its text without blanks is made only for those who read that column."""
    inside = T.StructType([T.StructField("v", SAMPLE)])
    is_object = F.col("text").rlike(r"^\s*\{")
    sample = F.when(is_object, F.from_json(wrapped(), inside).getField("v")).otherwise(F.from_json(unwrapped(), SAMPLE))
    bare = F.when(is_object, F.col("text")).otherwise(unwrapped())
    parsed = elements.select("source", "idx", bare.alias("text"), unwrapped().alias("raw_sample"), sample.alias("s"))
    return parsed.select(
        "source",
        "idx",
        F.trim("raw_sample").startswith("{").alias("is_object"),
        "raw_sample",
        F.col("s.task_id").alias("raw_task_id"),
        # a JSON number without a fraction is an int task id; the same digits in quotes are not
        F.when(
            F.col("s.task_id").rlike(r"^-?\d+$")
            & F.col("text").rlike(r'"task_id"\s*:\s*-?\d'),
            F.col("s.task_id").cast("int"),
        ).alias("task_id"),
        *[F.col(f"s.{f.name}").alias(f.name) for f in SAMPLE.fields if f.name != "task_id"],
    )


def read_benchmark(spark: SparkSession, path, folder: bool = False) -> DataFrame:
    """One row per sample of benchmark objects, with file and position; a file without a sample list is an error.

    A large document is read by as many tasks as it has blocks. With ``folder`` its part files are one document.
    """
    return _samples(element_texts(spark, path, folder=folder))


def read_benchmark_any(spark: SparkSession, path) -> DataFrame:
    """As ``read_benchmark`` but ``{samples}``, ``{data}`` or a bare list are all accepted."""
    return _samples(element_texts(spark, path, keys=("samples", "data"), bare=True))


def read_jsonl(spark: SparkSession, path, schema) -> DataFrame:
    """JSON lines; blank lines are skipped and a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path) -> DataFrame:
    """Accepted-sample log: broken lines dropped, wrapped ``{bundle_key, sample}`` and bare samples accepted."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rec = F.try_parse_json("value")
    wrapped = F.get_json_object("value", "$.sample")
    is_wrapped = wrapped.startswith("{")
    task = F.get_json_object(F.when(is_wrapped, wrapped).otherwise(F.col("value")), "$.task_id")
    bare_ok = F.get_json_object("value", "$.task_id").try_cast("int").isin(1, 2, 3, 4)
    return lines.where(rec.isNotNull() & (F.coalesce(is_wrapped, F.lit(False)) | F.coalesce(bare_ok, F.lit(False)))).select(
        F.when(is_wrapped, F.nullif(F.trim(F.get_json_object("value", "$.bundle_key")), F.lit(""))).alias("bundle_key"),
        F.coalesce(task.try_cast("int"), F.lit(0)).alias("task_id"),
        F.when(is_wrapped, wrapped).otherwise(F.col("value")).alias("sample"),
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_per_model(spark: SparkSession, folder: str, schema=PREDICTION) -> DataFrame:
    """Every ``<model>.jsonl`` under ``folder``; the file stem is the model key."""
    raw = (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.jsonl")
        .json(folder)
    )
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    return raw.select("*", stem.alias("source_model"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions from CSV, a JSON list, ``{"decisions": [...]}`` or a map of bundle to decision.

    ``pos`` is the row's place in the file; the last row of a bundle counts. Absent CSV columns are NULL.
    """
    columns = ["bundle_id", "decision", "note", "reviewer", "updated_at"]
    if not path.lower().endswith(".json"):
        raw = spark.read.option("header", True).option("multiLine", True).csv(path)  # names decide, whatever their order
        found = [F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return raw.select(*found, F.monotonically_increasing_id().alias("pos"))
    doc = spark.read.option("wholetext", True).text(path)
    row = "struct<bundle_id:string,decision:string,note:string,reviewer:string,updated_at:string>"
    is_list = F.ltrim(F.col("value")).startswith("[")
    listed = F.coalesce(
        F.when(is_list, F.from_json("value", f"array<{row}>")),
        F.from_json("value", f"struct<decisions:array<{row}>>").getField("decisions"),
    )
    from_list = doc.select(F.posexplode(listed).alias("pos", "r")).select("r.*", F.col("pos").cast("bigint"))
    entries = F.when(~is_list & listed.isNull(), F.map_entries(F.from_json("value", "map<string,string>")))
    from_map = doc.select(F.posexplode(entries).alias("pos", "e")).select(
        F.col("e.key").alias("k"), F.col("e.value").alias("v"), F.col("pos").cast("bigint").alias("pos")
    )
    parsed = F.when(F.col("v").startswith("{"), F.from_json("v", row))
    from_map = from_map.select(
        F.coalesce(parsed.getField("bundle_id"), F.col("k")).alias("bundle_id"),
        F.when(parsed.isNotNull(), parsed.getField("decision")).otherwise(F.col("v")).alias("decision"),
        *[parsed.getField(c).alias(c) for c in columns[2:]],
        "pos",
    )
    return from_list.select(*columns, "pos").unionByName(from_map)
