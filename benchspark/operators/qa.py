"""Quality control of benchmark files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from benchspark.functions.text import (
    WS,
    base_name,
    first_word,
    in_words,
    last_word,
    let,
    lower_strip,
    more_words_than,
    strip,
    text,
    words,
)
from benchspark.operators.campaign import HUMAN_WORDS, PREPOSITIONS
from benchspark.operators.ranking import exact_quantiles

# Labels too vague to be answers.
BAD_OBJECTS = ["floor", "wall", "ceiling", "room", "background", "outside", "nothing", "unknown", "scene", "image",
               "view", "camera", "person", "people", "man", "woman", "boy", "girl", "human", "humans"]
BAD_GENERIC_WORDS = ["object", "thing", "item", "stuff", "something", "anything", "square", "circle", "shape"]
BAD_GENERIC_PHRASES = ["white object", "black object", "red object", "blue object", "small object", "large object"]

# Where the target stands in questions and answers of tasks 3 and 4.
TASK3_QUESTION = r"gaze target is '([^']+)'"
TASK3_ANSWER = rf"^{WS}*Gaze target:{WS}*([^.]+)\."
TASK4_QUESTION = r"see the '([^']+)'"
TASK4_ANSWER_IN = rf"In{WS}+Cam\w+,{WS}+the{WS}+([^\s][^\n]*?){WS}+is{WS}+within"
TASK4_ANSWER_OUT = rf"In{WS}+Cam\w+,{WS}+the{WS}+([^\s][^\n]*?){WS}+is{WS}+outside"


def noun_phrase_ok(c) -> Column:
    toks = words(lower_strip(text(c)))
    first, last = F.try_element_at(toks, F.lit(1)), F.try_element_at(toks, F.lit(-1))
    return (F.size(toks).between(1, 6)) & ~in_words(last, PREPOSITIONS) & ~in_words(first, HUMAN_WORDS)


def generic_label(c) -> Column:
    """Empty, a banned object or phrase, led by a human word, or holding a vague word."""
    low = lower_strip(text(c))
    toks = words(low)
    vague = F.arrays_overlap(toks, F.array(*[F.lit(w) for w in BAD_GENERIC_WORDS]))
    return (
        (low == "")
        | low.isin(*BAD_OBJECTS, *BAD_GENERIC_PHRASES)
        | F.coalesce(in_words(F.try_element_at(toks, F.lit(1)), HUMAN_WORDS), F.lit(False))
        | vague
    )


def odd_question(c) -> Column:
    q = lower_strip(text(c))
    return (q != "") & (q.contains("person with wearing") | q.endswith(" with") | q.endswith(" wearing"))


def targets(question="question", answer="answer") -> Column:
    """Target named by question and answer, for tasks 3 and 4; NULL where not found."""
    q, a = text(question), text(answer)

    def found(c, pattern):
        return F.nullif(strip(F.regexp_extract(c, pattern, 1)), F.lit(""))

    return F.struct(
        found(F.lower(q), TASK3_QUESTION).alias("q3"),
        found(a, TASK3_ANSWER).alias("a3"),
        found(q, TASK4_QUESTION).alias("q4"),
        F.coalesce(found(a, TASK4_ANSWER_IN), found(a, TASK4_ANSWER_OUT)).alias("a4"),
    )


def qa_flags(samples: DataFrame) -> DataFrame:
    """Every check as a boolean column."""
    a, q = F.col("answer"), F.col("question")
    t1 = F.coalesce(F.col("task_id") == 1, F.lit(False))
    shape = let(
        strip(text(a)),
        lambda x: F.struct(
            F.length(x).alias("chars"),
            F.lower(first_word(x)).alias("first"),
            F.lower(last_word(x)).alias("last"),
            more_words_than(x, 6).alias("long"),
        ),
    )
    t = samples.withColumn("t", targets()).withColumn("shape", shape)
    chars, first, last = F.col("shape.chars"), F.col("shape.first"), F.col("shape.last")
    phrase = (chars > 0) & ~F.col("shape.long") & ~in_words(last, PREPOSITIONS) & ~in_words(first, HUMAN_WORDS)
    task = F.col("task_id")

    def clash(n):
        return F.coalesce(
            (task == n) & F.col(f"t.q{n}").isNotNull() & F.col(f"t.a{n}").isNotNull()
            & (F.lower(f"t.q{n}") != F.lower(f"t.a{n}")),
            F.lit(False),
        )

    return t.select(
        *samples.columns,
        "t",
        (text(q) == "").alias("missing_question"),
        a.isNull().alias("missing_answer"),
        F.coalesce(a.isNotNull() & (chars == 0), F.lit(False)).alias("empty_answer"),
        chars.between(1, 3).alias("short_answer"),
        F.coalesce(in_words(last, PREPOSITIONS), F.lit(False)).alias("trailing_prep"),
        F.coalesce(in_words(first, HUMAN_WORDS), F.lit(False)).alias("human_label"),
        (t1 & a.isNotNull() & ~F.coalesce(phrase, F.lit(False))).alias("noun_phrase_fail"),
        (t1 & odd_question(q)).alias("weird_question"),
        clash(3).alias("task3_target_mismatch"),
        clash(4).alias("task4_target_mismatch"),
    )


QA_CHECKS = ["missing_question", "missing_answer", "empty_answer", "short_answer", "trailing_prep", "human_label",
             "noun_phrase_fail", "weird_question", "task3_target_mismatch", "task4_target_mismatch"]
EXAMPLE_CHECKS = QA_CHECKS[4:]


def qa_profile(flags: DataFrame) -> DataFrame:
    """One row of counters."""
    return flags.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("task_id") == t).alias(f"task{t}") for t in (1, 2, 3, 4)],
        *[F.count_if(c).alias(c) for c in QA_CHECKS],
    )


def label_diversity(samples: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` most common task-1 labels beside the number of different ones."""
    counted = (
        samples.where((F.col("task_id") == 1) & F.col("answer").isNotNull())
        .groupBy(lower_strip("answer").alias("label"))
        .agg(F.count("*").alias("n"))
    )
    unique = counted.agg(F.count("*")).scalar()
    return counted.orderBy(F.desc("n"), "label").limit(top).withColumn("unique_labels", unique)


def examples(flags: DataFrame, per_check: int = 5, order: str = "idx") -> DataFrame:
    """First ``per_check`` rows of each inconsistency (G13); Spark keeps only that many per task before the shuffle."""
    hits = flags.select(
        order, "task_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c), c) for c in EXAMPLE_CHECKS]))).alias("check_name")
    )
    w = W.partitionBy("check_name").orderBy(order)
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_check)


def confidence_report(samples: DataFrame, conf: str = "confidence") -> DataFrame:
    """Count, missing, min, median, mean, max and nearest-rank percentiles of a confidence column."""
    marks = {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)}
    return exact_quantiles(
        samples, conf, linear={"median_conf": 0.5}, nearest=marks,
        extra=lambda total, missing: [
            total.alias("n"), missing.alias("missing"), F.min("v").alias("min_conf"),
            (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_conf"), F.max("v").alias("max_conf"),
        ],
    )


def histogram(samples: DataFrame, conf: str = "confidence", bins: int = 10) -> DataFrame:
    """Equal-width histogram; one bin if all values are equal, the last bin closed, empty bins shown."""
    v = F.col(conf)
    rows = samples.where(v.isNotNull())
    span = rows.agg(F.struct(F.min(conf).alias("lo"), F.max(conf).alias("hi"), F.count("*").alias("n"))).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    step = (hi - lo) / F.lit(bins)
    place = F.when(hi == lo, 0).otherwise(F.least(F.floor((v - lo) / step), F.lit(bins - 1))).cast("int")
    counted = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    # zero-count rows for every bin come from the data's own one-row summary
    frame = (
        rows.agg(F.min(conf).alias("lo"), F.max(conf).alias("hi"))
        .where("lo is not null")
        .select("lo", "hi", F.explode(F.sequence(F.lit(0), F.when(F.expr("hi = lo"), 0).otherwise(bins - 1))).alias("bin"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        F.when(F.expr("hi = lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def provider_summary(samples: DataFrame) -> DataFrame:
    """Per provider: task counts, label and target checks (G16). Distinct labels are counted after a first aggregate."""
    f = qa_flags(samples)
    t1 = F.coalesce(F.col("task_id") == 1, F.lit(False)) & F.col("answer").isNotNull()
    label = F.when(t1, lower_strip("answer"))

    def checked(n):
        return F.coalesce((F.col("task_id") == n) & F.col(f"t.q{n}").isNotNull() & F.col(f"t.a{n}").isNotNull(), F.lit(False))

    per_label = f.groupBy("provider", label.alias("label")).agg(
        F.count("*").alias("total_samples"),
        *[F.count_if(F.col("task_id") == t).alias(f"task{t}") for t in (1, 2, 3, 4)],
        F.count_if("missing_question").alias("missing_question"),
        F.count_if("missing_answer").alias("missing_answer"),
        F.count_if("empty_answer").alias("empty_answer"),
        F.count_if(t1).alias("labels"),
        F.count_if(t1 & generic_label("answer")).alias("generic"),
        F.count_if(t1 & F.col("noun_phrase_fail")).alias("noun_fail"),
        F.sum(F.when(F.col("task_id") == 1, F.col("confidence"))).alias("conf_sum"),
        F.count(F.when(F.col("task_id") == 1, F.col("confidence"))).alias("conf_n"),
        *[F.count_if(checked(n)).alias(f"task{n}_checked") for n in (3, 4)],
        *[F.count_if(f"task{n}_target_mismatch").alias(f"task{n}_target_mismatches") for n in (3, 4)],
    )
    sums = ["total_samples", "task1", "task2", "task3", "task4", "missing_question", "missing_answer", "empty_answer",
            "labels", "generic", "noun_fail", "conf_sum", "conf_n", "task3_checked", "task4_checked",
            "task3_target_mismatches", "task4_target_mismatches"]
    g = per_label.groupBy("provider").agg(*[F.sum(s).alias(s) for s in sums], F.count("label").alias("unique_labels"))

    def rate(x, y):
        return F.when(F.col(y) > 0, F.col(x) / F.col(y))

    return g.select(
        "provider", *sums[:9], "unique_labels",
        rate("conf_sum", "conf_n").alias("mean_confidence"),
        rate("generic", "labels").alias("generic_label_rate"),
        rate("noun_fail", "labels").alias("noun_phrase_fail_rate"),
        "task3_checked", "task3_target_mismatches", rate("task3_target_mismatches", "task3_checked").alias("task3_mismatch_rate"),
        "task4_checked", "task4_target_mismatches", rate("task4_target_mismatches", "task4_checked").alias("task4_mismatch_rate"),
    )


def sample_key(images: str | None = "input_images") -> Column:
    """Task, scene, time and sorted distinct image names."""
    names = F.lit("")
    if images:
        found = F.transform(
            F.filter(images, lambda i: text(i.getField("image")) != ""), lambda i: base_name(i.getField("image"))
        )
        names = F.array_join(F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))), ";")
    return F.concat_ws("|", text("task_id"), text("scene"), text("timestamp"), names)


def label_matrix(samples: DataFrame, providers: Sequence[str], key: Column, pos: str = "idx") -> DataFrame:
    """Task-1 labels by sample key and provider; the last sample of a key counts, a missing cell is the empty text.

    One aggregate per (key, provider) first, so copies of a key collapse before the pivot.
    """
    last = (
        samples.where(F.col("task_id") == 1)
        .groupBy(key.alias("sample_key"), "provider")
        .agg(F.max(F.struct(F.col(pos), F.col("answer"))).getField("answer").alias("answer"))
    )
    cells = [text(F.max(F.when(F.col("provider") == p, F.col("answer")))).alias(p) for p in providers]
    return last.groupBy("sample_key").agg(*cells)
