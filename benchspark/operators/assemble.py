"""Sampling, quotas, bundles and run accounting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.text import half_even, lower_strip, portable_hash, text
from benchspark.operators.ranking import exact_quantiles, global_rank, hash_slot, position_slot
from benchspark.operators.rig import DISTANCE_MAX, DISTANCE_MIN
from benchspark.sources.json_ranges import write_document

TASKS = (1, 2, 3, 4)

# USD per million tokens; the model prefix decides before the provider.
PRICES = [
    ("openai", "gpt-4o-mini", 0.15, 0.075, 0.60),
    ("openai", "", 2.5, 1.25, 10.0),
    ("gemini", "", 0.30, 0.30, 2.50),
]
# Early warning about a low acceptance rate.
WARN_FRAMES, WARN_RATE = 250, 0.01


# --- sequences and frames (F1-F4, F7) ------------------------------------------------------------------------------

def filter_splits(sequences: DataFrame, splits: Sequence[str]) -> DataFrame:
    want = sorted({s.strip().lower() for s in splits if s.strip()})
    return sequences.where(F.lower("split").isin(*want)) if want else sequences


def interleave(sequences: DataFrame, seed: int = 42, split: str = "split", key: str = "seq") -> DataFrame:
    """Round-robin position over splits, sequences of a split in hash order (F2).

    A split of any size is ranked by slices of the hash range, not in one task. ``turn`` then ``split`` is the order.
    """
    hashed = sequences.withColumn("__h", portable_hash(F.lit(seed), split, key))
    ranked = global_rank(hashed, order=[F.col("__h"), F.col(key)], slots=[hash_slot("__h", width=60)], within=[split], name="turn")
    return ranked.drop("__h")


def cap(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in an order (F3); Spark keeps ``n`` rows per task before they meet."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def split_cap(target: int, splits: int) -> int:
    return 0 if target <= 0 else max(1, math.ceil(target / max(1, splits)))


def select_balanced(candidates: DataFrame, target: int, splits: int, split: str = "split", pos: str = "pos") -> DataFrame:
    """The first ``target`` candidates by position of those within their split's share of the target.

    ``pos`` is a unique non-negative position. A split's rank is built from position slots, so no split gathers in one
    task, and only shares survive to the global cut.
    """
    if target <= 0:
        return candidates.limit(0)
    share = split_cap(target, splits)
    base = candidates.withColumn("__split", F.lower(split))
    ranked = global_rank(base, order=[F.col(pos)], slots=[position_slot(pos)], within=["__split"], name="__rank")
    within = ranked.where(F.col("__rank") <= share).drop("__rank", "__split")
    return within.orderBy(pos).limit(target)


def pending_frames(frames: DataFrame, accepted: DataFrame, key: str = "bundle_key") -> DataFrame:
    """Frames not accepted yet."""
    return frames.join(accepted.select(key).distinct(), key, "left_anti")


def bundle_key(split="split", seq="seq", frame="frame_id") -> Column:
    return F.concat_ws("/", split, seq, frame)


# --- bundles (F5, F6, F10) -----------------------------------------------------------------------------------------

def bundle_status(samples: DataFrame, key: str = "bundle_key") -> DataFrame:
    """Per frame which tasks have a sample and the first one missing in order 1-4."""
    has = samples.groupBy(key).agg(*[F.max(F.coalesce(F.col("task_id") == t, F.lit(False))).alias(f"has{t}") for t in TASKS])
    first = F.lit(None).cast("int")
    for t in reversed(TASKS):
        first = F.when(~F.col(f"has{t}"), t).otherwise(first)
    return has.withColumn("first_missing", first)


def complete_bundles(samples: DataFrame, key: str = "bundle_key") -> DataFrame:
    """Samples of frames that have all four tasks."""
    full = bundle_status(samples, key).where("first_missing is null").select(key)
    return samples.join(full, key, "left_semi")


def select_partial(samples: DataFrame, targets: dict[int, int], splits: int, key: str = "bundle_key", split: str = "split",
                   pos: str = "pos") -> DataFrame:
    """Independent quotas per task; tasks 3 and 4 only for frames that have a task-1 sample."""
    with_t1 = samples.where("task_id = 1").select(key).distinct()
    parts = []
    for t in TASKS:
        rows = samples.where(F.col("task_id") == t)
        if t in (3, 4):
            rows = rows.join(with_t1, key, "left_semi").select(*samples.columns)
        parts.append(select_balanced(rows, targets.get(t, 0), splits, split, pos))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bundle_skip_stats(status: DataFrame) -> DataFrame:
    """Attempted, accepted and skipped frames, skip rate and first failed tasks."""
    skipped = F.col("first_missing").isNotNull()
    return status.agg(
        F.count("*").alias("attempted"),
        F.count_if(~skipped).alias("accepted"),
        F.count_if(skipped).alias("skipped"),
        (F.count_if(skipped) / F.nullif(F.count("*"), F.lit(0))).alias("skip_rate"),
        *[F.count_if(F.col("first_missing") == t).alias(f"first_failed_task{t}") for t in TASKS],
    )


# --- resuming (F8) -------------------------------------------------------------------------------------------------

def accepted_keys(samples: DataFrame, bundles: DataFrame, key: str = "bundle_key") -> DataFrame:
    """Keys of both logs, once each."""
    both = samples.select(key).unionByName(bundles.select(key))
    return both.select(F.trim(text(key)).alias(key)).where(F.col(key) != "").distinct()


def recover_counts(samples: DataFrame, bundles: DataFrame, state: DataFrame | None = None, key: str = "bundle_key") -> DataFrame:
    """Counts after a restart: the larger of the stored and the recounted number, per task and for bundles (F8)."""
    per_task = samples.where(F.col("task_id").isin(*TASKS)).groupBy(
        F.concat(F.lit("task"), F.col("task_id").cast("string")).alias("counter")
    ).agg(F.count("*").alias("n"))
    zero = samples.agg(F.lit(0).alias("z")).select(
        F.explode(F.array(*[F.lit(f"task{t}") for t in TASKS])).alias("counter"), F.lit(0).cast("bigint").alias("n")
    )
    keys = accepted_keys(samples, bundles, key).agg(F.lit("bundle").alias("counter"), F.count("*").alias("n"))
    parts = zero.unionByName(per_task).unionByName(keys)
    if state is not None:
        parts = parts.unionByName(state.select("counter", F.col("n").cast("bigint").alias("n")))
    return parts.groupBy("counter").agg(F.max("n").alias("n"))


# --- reports (F9, F11, F12, F14) -----------------------------------------------------------------------------------

def reject_report(events: DataFrame, reason: str = "reason", top: int | None = 8) -> DataFrame:
    """Reject reasons by count, most frequent first; the ``top`` ones or all."""
    counted = events.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
    return counted.limit(top) if top else counted


def early_warning(frames: DataFrame, after: int = WARN_FRAMES, rate: float = WARN_RATE, pos: str = "pos") -> DataFrame:
    """Task-1 acceptance among the first ``after`` frames, and whether it is too low."""
    first = frames.orderBy(pos).limit(after)
    return first.agg(
        F.count("*").alias("frames_seen"), F.count_if("usable").alias("usable"), F.count_if("accepted").alias("accepted")
    ).select(
        "*",
        (F.col("accepted") / F.greatest(F.lit(1), F.col("usable"))).alias("rate"),
        ((F.col("frames_seen") >= after) & (F.col("accepted") / F.greatest(F.lit(1), F.col("usable")) < rate)).alias("warn"),
    )


def _running(rows: DataFrame, pos: str, values: dict[str, Column]) -> DataFrame:
    """``pos`` and the running sums of ``values`` up to each row: kept per position slot, lifted by the sums of earlier slots."""
    from pyspark.sql import Window as W

    slotted = rows.select(F.col(pos).alias("pos"), position_slot(pos).alias("slot"), *[v.cast("bigint").alias(n) for n, v in values.items()])
    per_slot = slotted.groupBy("slot").agg(*[F.sum(n).alias(n) for n in values])
    before = W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slot.select(F.col("slot").alias("slot_o"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_o") for n in values])
    inside = W.partitionBy("slot").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    local = slotted.select("pos", "slot", *[F.sum(n).over(inside).alias(n) for n in values])
    return local.join(offsets, F.col("slot") == F.col("slot_o")).select("pos", *[(F.col(n) + F.col(f"{n}_o")).alias(n) for n in values])


def _task_flags() -> dict[str, Column]:
    return {"total_accepts": F.lit(1)} | {f"task{t}": F.when(F.col("task_id") == t, 1).otherwise(0) for t in TASKS}


def progress(samples: DataFrame, every: int = 5, pos: str = "pos", rejects: DataFrame | None = None, last: int = 0, start=None) -> DataFrame:
    """Counts per task at each ``every``-th accepted sample.

    ``pos`` is a unique position. With ``rejects`` (a log with the same clock ``pos``) a snapshot has ``rejects``, how many were
    refused up to it: both logs are one ordered log of flags, so the as-of merge is the same running sum. With ``last`` it has
    ``last_samples``, the positions of the last so many samples, latest first: a sample belongs to the next few snapshots only,
    which follow from its own rank, so snapshots gather at most ``last`` rows each. ``start`` is a row of ``running_totals`` of
    an earlier part of the log.
    """
    flags = _task_flags()
    rows = samples.select(F.col(pos).alias("pos"), F.lit(True).alias("accepted"), *[v.alias(n) for n, v in flags.items()])
    names = list(flags)
    if rejects is not None:
        zero = [F.lit(0).alias(n) for n in names]
        rows = rows.withColumn("rejects", F.lit(0)).unionByName(rejects.select(F.col(pos).alias("pos"), F.lit(False).alias("accepted"), *zero, F.lit(1).alias("rejects")))
        # a reject at the very position of a sample counts with it
        rows = rows.groupBy("pos").agg(F.max("accepted").alias("accepted"), *[F.sum(n).alias(n) for n in [*names, "rejects"]])
        names.append("rejects")
    counted = _running(rows.withColumn("accepted", F.col("accepted").cast("int")).withColumn("__key", F.col("pos")), "__key", {n: F.col(n) for n in names} | {"was": F.col("accepted")})
    if start is not None:
        counted = counted.select("pos", *[(F.col(n) + F.lit(start[n] if n in start else 0)).alias(n) for n in names], "was")
    if rejects is not None:
        accepted = counted.join(samples.select(F.col(pos).alias("pos")), "pos", "left_semi")
    else:
        accepted = counted
    shots = accepted.where(F.col("total_accepts") % every == 0).select("pos", *names)
    if not last:
        return shots
    rank = F.col("total_accepts")
    first = F.ceil(rank / every) * every  # the first snapshot at or after the sample
    member = accepted.select("pos", rank.alias("rank"), F.explode(F.when(first < rank + last, F.sequence(first, rank + last - 1, F.lit(every).cast("bigint")))).alias("total_accepts"))
    if start is not None and start["last_samples"]:
        old = [(p, start["total_accepts"] - i) for i, p in enumerate(start["last_samples"])]
        held = samples.sparkSession.createDataFrame([(p, r, t) for p, r in old for t in range(-(-r // every) * every, r + last, every)], "pos bigint, rank bigint, total_accepts bigint")
        member = member.unionByName(held)
    latest = member.groupBy("total_accepts").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("rank", "pos")))), lambda e: e["pos"]).alias("last_samples"))
    return shots.join(latest, "total_accepts").select("pos", *names, "last_samples")


def running_totals(samples: DataFrame, last: int = 5, pos: str = "pos", start=None) -> DataFrame:
    """One row: the counts of ``progress`` and the last ``last`` positions after all samples, on top of ``start`` (S3)."""
    flags = _task_flags()
    row = samples.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(n) for n, v in flags.items()]).first()
    counts = {n: row[n] + (start[n] if start is not None else 0) for n in flags}
    latest = [r["pos"] for r in samples.select(F.col(pos).cast("bigint").alias("pos")).orderBy(F.desc("pos")).limit(last).collect()]
    latest = (latest + list(start["last_samples"] if start is not None else []))[:last]
    schema = ", ".join(f"{n} bigint" for n in flags) + ", last_samples array<bigint>"
    return samples.sparkSession.createDataFrame([(*counts.values(), latest)], schema)


def last_samples(samples: DataFrame, k: int = 5, pos: str = "pos") -> DataFrame:
    """The last ``k`` accepted samples."""
    return samples.orderBy(F.desc(pos)).limit(k)


def distance_summary(gated: DataFrame, distance: str = "median_distance") -> DataFrame:
    """Seen, accepted and rejected frames with min, quartiles and max of the median distance.

    Acceptance depends on the distance alone, so all counts come from the counted distances.
    """
    good = F.col("v").between(DISTANCE_MIN, DISTANCE_MAX)

    def counts(total, missing):
        accepted = F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0))
        return [
            (total + missing).alias("seen"), accepted.alias("accepted"), (total + missing - accepted).alias("rejected"),
            F.min("v").alias("min_distance"), F.max("v").alias("max_distance"),
        ]

    return exact_quantiles(gated, distance, linear={"p25": 0.25, "median": 0.5, "p75": 0.75}, extra=counts)


# --- output (F15) --------------------------------------------------------------------------------------------------

def assemble(samples: DataFrame, order: Sequence[str] = ("bundle_key", "task_id")) -> dict[str, DataFrame]:
    """Final benchmark as two tables: samples in order, and one row of counts."""
    counts = samples.agg(
        F.count("*").alias("samples"), *[F.count_if(F.col("task_id") == t).alias(f"task{t}") for t in TASKS]
    )
    return {"samples": samples.orderBy(*order), "meta": counts}


def reason_counts(events: DataFrame, reason: str = "reason") -> DataFrame:
    """One row with the map ``by_reason``: how often each reason stands; reasons are a run's few names."""
    counted = events.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("k")).agg(F.count("*").alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("by_reason"))


def write_benchmark(
    samples: DataFrame, path: str, order: Sequence[str] = ("bundle_key", "task_id"), meta: DataFrame | None = None,
    rejects: DataFrame | None = None, frames: DataFrame | None = None,
) -> None:
    """The benchmark as one JSON document of many part files (F15): meta, counts, reject and frame statistics, ordered samples.

    ``meta`` is one row of the run's settings, ``rejects`` and ``frames`` hold a ``reason`` per refused sample and per frame.
    ``files.read_benchmark(..., folder=True)`` reads the samples back, ``json_ranges.read_head`` the rest.
    """
    head = {"meta": meta} if meta is not None else {}
    head["counts"] = assemble(samples, order)["meta"]
    for name, events in (("reject_stats", rejects), ("frame_stats", frames)):
        if events is not None:
            head[name] = reason_counts(events)
    write_document(head, samples, path, list(order))


# --- usage (F16) ---------------------------------------------------------------------------------------------------

def call_cost(provider="provider", model="model", prices=PRICES) -> Column:
    """Cost of one call. Cached input has its own price with the first provider, the full price with the others."""
    inp, out, cached = (F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))) for c in ("input_tokens", "output_tokens", "cached_input_tokens"))
    billed = F.greatest(F.lit(0), inp - cached)
    low, cost = lower_strip(text(model)), None
    for name, prefix, p_in, p_cached, p_out in prices:
        match = (F.col(provider) == name) & low.startswith(prefix)
        split = name == "openai"
        value = ((billed * p_in + cached * p_cached) if split else inp * p_in) + out * p_out
        cost = F.when(match, value / 1_000_000.0) if cost is None else cost.when(match, value / 1_000_000.0)
    return cost.otherwise(0.0)


def usage_report(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost per frame and, in the row with a NULL frame and ``is_total``, over all (F16)."""
    zero = F.lit(0)
    c = calls.select(
        F.coalesce(F.nullif("frame_key", F.lit("")), F.lit("NO_FRAME_CONTEXT")).alias("frame_key"),
        *[F.greatest(zero, F.coalesce(F.col(k), zero)).alias(k) for k in ("input_tokens", "output_tokens", "cached_input_tokens")],
        F.col("total_tokens").alias("given_total"),
        call_cost().alias("cost"),
    )
    return c.rollup("frame_key").agg(
        F.grouping("frame_key").cast("boolean").alias("is_total"),
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cached_input_tokens").alias("cached_input_tokens"),
        F.sum(F.greatest(zero, F.col("input_tokens") - F.col("cached_input_tokens"))).alias("billed_input_tokens"),
        F.sum(F.coalesce("given_total", F.col("input_tokens") + F.col("output_tokens"))).alias("total_tokens"),
        F.round(F.sum("cost"), 10).alias("cost_usd_estimate"),
    )


# --- teacher, verifier and error summaries (F17, F18) --------------------------------------------------------------

def teacher_verifier_summary(passes: DataFrame, verifiers: DataFrame) -> DataFrame:
    """Counters of both checks as (section, counter, value, n) rows.

    ``passes`` holds one row per teacher pass with its sample's ``sample_id, applied, final_source``; ``verifiers`` one
    row per verifier answer. Samples are counted once through a first aggregate.
    """
    s1, s4 = F.lit("task1_teacher").alias("section"), F.lit("task4_verifier").alias("section")
    per_sample = passes.groupBy("sample_id").agg(
        F.max("applied").alias("applied"), F.max(F.col("final_source") == "student_fallback").alias("fallback"),
        F.count("*").alias("attempts"), F.count_if("parse_ok").alias("ok"), F.count_if(F.col("retry_count") > 0).alias("retries"),
    )
    head1 = per_sample.agg(
        F.count("*").alias("samples"), F.count_if("applied").alias("applied"), F.count_if("fallback").alias("student_fallback"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("parse_attempts"), F.coalesce(F.sum("ok"), F.lit(0)).alias("parse_success"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("partial_retry_calls"),
    )
    readable = F.col("parse_ok") & F.upper(text("prediction")).isin("YES", "NO")
    head4 = verifiers.agg(
        F.count("*").alias("samples"), F.count_if(readable).alias("parse_success"),
        F.count_if(F.col("retry_count") > 0).alias("partial_retry_calls"),
    )

    def long(df, section):
        pairs = F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).cast("bigint").alias("n")) for c in df.columns])
        return df.select(section, F.lit("totals").alias("counter"), F.inline(pairs))

    def counters(df, section, fields):
        used, asked = F.trim(text("model")), F.trim(text("model_requested"))
        fell = (used != "") & (asked != "") & (F.lower(used) != F.lower(asked))
        values = {n: c for n, c in fields.items()} | {
            "finish_reasons": F.upper(F.trim(text("finish_reason"))), "modes": F.lower(F.trim(text("mode"))),
            "models_used": used, "model_fallback_usage": F.when(fell, F.concat(asked, F.lit(" -> "), used)),
        }
        pairs = F.array(*[F.struct(F.lit(n).alias("counter"), v.alias("value")) for n, v in values.items()])
        return df.select(section, F.inline(pairs)).where(text("value") != "").groupBy("section", "counter", "value").agg(
            F.count("*").alias("n")
        )

    fields4 = {
        "actions": F.lower(F.trim(text("action"))), "presence": F.upper(F.trim(text("presence"))),
        "person_presence": F.upper(F.trim(text("person_presence"))),
    }
    return (
        long(head1, s1).unionByName(counters(passes, s1, {}))
        .unionByName(long(head4, s4)).unionByName(counters(verifiers, s4, fields4))
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Errors in total and by task, stage, type and model, as (dimension, value, n) rows."""
    unknown = F.lit("unknown")
    base = errors.select(
        F.coalesce(F.nullif(F.col("task_id"), F.lit(0)).cast("string"), unknown).alias("task"),
        F.coalesce(F.nullif("stage", F.lit("")), unknown).alias("stage"),
        F.coalesce(F.nullif("error_type", F.lit("")), unknown).alias("type"),
        F.coalesce(F.nullif("model", F.lit("")), unknown).alias("model"),
    )
    dims = ["task", "stage", "type", "model"]
    sets = [[], *[[F.col(d)] for d in dims]]
    grouped = base.groupingSets(sets, *dims).agg(F.grouping_id(*dims).alias("gid"), F.count("*").alias("n"))
    # the bit of a dimension is 0 in its own set
    name = F.when(F.col("gid") == 15, "total")
    for i, d in enumerate(dims):
        name = name.when(F.col("gid") == 15 - (8 >> i), d)
    return grouped.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n")
