"""Merging benchmark files and dropping duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.text import base_name, norm_lower, norm_space, strip, text
from benchspark.operators.ranking import global_rank

# A row's place over all inputs in one number: source position in the high bits, row in the low 40.
ROW_BITS = 40


def place(source_pos="source_pos", idx="idx") -> Column:
    return F.col(source_pos).cast("bigint") * F.lit(1 << ROW_BITS) + F.col(idx).cast("bigint")


def identity_key(samples: DataFrame) -> Column:
    """SHA-1 over task, type, scene, time, question, sorted cameras and sorted (camera, image name)."""
    parts = [F.coalesce(F.col("task_id"), F.lit(0)).alias("task_id"), norm_lower("task_type").alias("task_type"),
             norm_lower("scene").alias("scene"), norm_space("timestamp").alias("timestamp"),
             norm_lower("question").alias("question")]
    if "input_cams" in samples.columns:
        cams = F.transform(F.filter("input_cams", lambda c: strip(text(c)) != ""), norm_lower)
        parts.append(F.coalesce(F.array_sort(cams), F.array().cast("array<string>")).alias("cams"))
    if "input_images" in samples.columns:
        images = F.transform(
            F.filter("input_images", lambda i: i.isNotNull()),
            lambda i: F.array(norm_lower(i.getField("cam")), base_name(strip(text(i.getField("image"))))),
        )
        parts.append(F.coalesce(F.array_sort(images), F.array().cast("array<array<string>>")).alias("images"))
    return F.sha1(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def canonical_json(c) -> Column:
    """JSON text with the keys of every object sorted, at every depth; other text stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.col(c))


def content_fp(columns, json_columns=("meta",)) -> Column:
    """SHA-1 over the full content with sorted field names, inside JSON texts too."""
    parts = [canonical_json(c).alias(c) if c in json_columns else F.col(c) for c in sorted(columns)]
    return F.sha1(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def with_keys(samples: DataFrame, content: list[str] | None = None) -> DataFrame:
    """Add ``identity_key``, ``fp`` and ``place``; ``source_pos`` orders the inputs, ``idx`` the rows of one."""
    content = content or [c for c in samples.columns if c not in ("source", "source_pos", "idx")]
    return samples.select(
        "*", identity_key(samples).alias("identity_key"), content_fp(content).alias("fp"), place().alias("place")
    )


def _copies(keyed: DataFrame) -> DataFrame:
    """One row per (key, content): first place and number of copies. Copies collapse on the map side."""
    return keyed.groupBy("identity_key", "fp").agg(F.min("place").alias("first_place"), F.count("*").alias("n"))


def _identities(keyed: DataFrame) -> DataFrame:
    """One row per key: place and content of the kept row, rows with the same and with other content."""
    c = _copies(keyed)
    return (
        c.groupBy("identity_key")
        .agg(
            F.min("first_place").alias("kept_place"),
            F.min_by("fp", "first_place").alias("kept_fp"),
            F.min_by("n", "first_place").alias("n_same"),
            F.sum("n").alias("n_all"),
        )
        .select(
            "identity_key",
            "kept_place",
            "kept_fp",
            (F.col("n_same") - 1).alias("exact_duplicates"),
            (F.col("n_all") - F.col("n_same")).alias("conflict_duplicates"),
        )
    )


def dedup_keep_first(keyed: DataFrame) -> DataFrame:
    """First row of every identity.

    The first place per key comes from a narrow aggregate; whole rows are then matched on the place, which is
    unique, so an identity with very many copies never gathers in one task.
    """
    kept = keyed.groupBy("identity_key").agg(F.min("place").alias("place")).select("place")
    return keyed.join(kept, "place", "left_semi")


def duplicate_counts(keyed: DataFrame) -> DataFrame:
    """One row: kept samples, exact and conflicting duplicates."""
    return _identities(keyed).agg(
        F.count("*").alias("merged_sample_count"),
        F.coalesce(F.sum("exact_duplicates"), F.lit(0)).alias("exact_duplicates_dropped"),
        F.coalesce(F.sum("conflict_duplicates"), F.lit(0)).alias("conflict_duplicates_dropped"),
    )


def conflicts(keyed: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` rows dropped although their content differs from the kept row.

    Those rows lie in the ``limit`` differing (key, content) groups that start first, so only these groups are
    matched back to rows.
    """
    ids = _identities(keyed).where("conflict_duplicates > 0")
    groups = (
        _copies(keyed)
        .join(ids, "identity_key")
        .where("fp <> kept_fp")
        .orderBy("first_place")
        .limit(limit)
        .select("identity_key", "fp", "kept_place")
    )
    mask = F.lit((1 << ROW_BITS) - 1)
    return (
        keyed.select("identity_key", "fp", "place")
        .join(F.broadcast(groups), ["identity_key", "fp"])
        .orderBy("place")
        .limit(limit)
        .select(
            "identity_key",
            F.shiftright("kept_place", ROW_BITS).alias("kept_source"),
            F.col("kept_place").bitwiseAND(mask).alias("kept_index"),
            F.shiftright("place", ROW_BITS).alias("drop_source"),
            F.col("place").bitwiseAND(mask).alias("drop_index"),
        )
    )


def order_columns() -> list[Column]:
    return [norm_lower("scene"), norm_space("timestamp"), F.coalesce("task_id", F.lit(0)), norm_lower("question"), F.col("identity_key")]


def order_samples(samples: DataFrame) -> DataFrame:
    """Deterministic order (G6), a range-partitioned sort."""
    return samples.orderBy(*order_columns())


def place_samples(samples: DataFrame) -> DataFrame:
    """Every sample with its 1-based ``place`` in that order; pieces of one scene, time, task and question are numbered each."""
    order = order_columns()
    return global_rank(samples, order=order, slots=order[:4], name="place")


def merge_maps(maps: DataFrame, column: str = "stats", pos: str = "source_pos") -> DataFrame:
    """Sum maps of JSON values over inputs: numbers add up, booleans and text count only if no number comes."""
    entries = maps.select(F.col(pos).alias("pos"), F.explode(column).alias("key", "value"))
    number = F.when(~F.col("value").isin("true", "false"), F.expr("try_cast(value AS DOUBLE)"))
    rows = entries.withColumn("num", number)
    return rows.groupBy("key").agg(F.sum("num").alias("total"), F.min_by("value", "pos").alias("first_value")).select(
        "key",
        F.when(F.col("total").isNull(), F.col("first_value"))
        .when(F.col("total") == F.floor("total"), F.col("total").cast("bigint").cast("string"))
        .otherwise(F.col("total").cast("string"))
        .alias("value"),
    )


def recount(samples: DataFrame) -> DataFrame:
    """Samples per task and distinct (scene, time) bundles."""
    by_bundle = samples.select(
        F.coalesce("task_id", F.lit(0)).alias("t"), norm_lower("scene").alias("s"), norm_space("timestamp").alias("f")
    ).groupBy("s", "f").agg(*[F.count_if(F.col("t") == t).alias(f"n{t}") for t in (1, 2, 3, 4)])
    named = (F.col("s") != "") | (F.col("f") != "")
    return by_bundle.agg(
        *[F.coalesce(F.sum(f"n{t}"), F.lit(0)).alias(f"task{t}") for t in (1, 2, 3, 4)], F.count_if(named).alias("bundle")
    )


def source_counts(samples: DataFrame) -> DataFrame:
    """Samples per input before merging."""
    return samples.groupBy("source").agg(F.count("*").alias("sample_count"))


def merge_report(keyed: DataFrame) -> DataFrame:
    """Duplicate counts beside the recount of what is kept."""
    counts = recount(dedup_keep_first(keyed))
    dup = duplicate_counts(keyed)
    names = ["merged_sample_count", "exact_duplicates_dropped", "conflict_duplicates_dropped"]
    one = dup.select(F.struct(*names).alias("d")).scalar()
    return counts.select("*", *[one.getField(n).alias(n) for n in names])
