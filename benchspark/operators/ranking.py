"""Ranks and exact quantiles that never put a whole group into one task.

A plain ``row_number() over (partition by g order by k)`` sorts each group in one task. Here the caller names a
*slot*: a column that grows with the sort key and splits a group into pieces of bounded size. Rows are numbered
inside their piece and the piece's offset comes from a small table of piece counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    slots: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """1-based rank by ``order`` inside ``within``; ``slots`` sort ascending exactly as ``order`` does."""
    keys = list(within)
    slot_names = [f"__slot{i}" for i in range(len(slots))]
    slotted = df.select("*", *[c.alias(n) for c, n in zip(slots, slot_names)])
    counts = slotted.groupBy(*keys, *slot_names).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy(*slot_names).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[F.col(n).alias(f"__o{i}") for i, n in enumerate(slot_names)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    local = slotted.withColumn(
        "__rn", F.row_number().over(W.partitionBy(*keys, *slot_names).orderBy(*order))
    )
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    match += [F.col(n).eqNullSafe(F.col(f"__o{i}")) for i, n in enumerate(slot_names)]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return local.join(offsets, condition).select(
        *df.columns, (F.col("__before") + F.col("__rn")).cast("bigint").alias(name)
    )


def hash_slot(hash_col, bits: int = 12, width: int = 64) -> Column:
    """Slot for an order by a hash of ``width`` bits: its top bits. Hash order is uniform, so slots are even."""
    return F.shiftright(F.col(hash_col) if isinstance(hash_col, str) else hash_col, width - bits)


def position_slot(pos, width: int = 1 << 18) -> Column:
    """Slot for an order by a unique non-negative position: at most ``width`` rows each."""
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(width)).cast("bigint")


def _counted(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value once with its number of rows: copies collapse before the shuffle."""
    return df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))


def _cumulative(counted: DataFrame, bounds: Column) -> DataFrame:
    """Distinct values with ``below`` (rows with a smaller value) and ``upto`` (rows up to this value).

    The distinct values are cut into slots at their own approximate quantiles, so slots are even however they spread.
    """
    # place of the value among the cuts; native array functions, as a lambda cannot hold the subquery
    slotted = counted.where(F.col("v").isNotNull()).withColumn(
        "slot", F.array_position(F.sort_array(F.array_append(bounds, F.col("v"))), F.col("v"))
    )
    per_slot = slotted.groupBy("slot").agg(F.sum("n").alias("m"))
    offsets = per_slot.select(
        F.col("slot").alias("slot_o"),
        F.coalesce(
            F.sum("m").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("off"),
    )
    inside = F.sum("n").over(W.partitionBy("slot").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return (
        slotted.withColumn("run", inside)
        .join(offsets, F.col("slot") == F.col("slot_o"))
        .select("v", "n", (F.col("off") + F.col("run") - F.col("n")).alias("below"), (F.col("off") + F.col("run")).alias("upto"))
    )


def _value_at(rank: Column) -> Column:
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("upto")), F.col("v")))


def exact_quantiles(
    df: DataFrame,
    value: str,
    linear: dict[str, float] | None = None,
    nearest: dict[str, float] | None = None,
    slots: int = 256,
    extra=None,
) -> DataFrame:
    """One row of exact quantiles: ``linear`` interpolates, ``nearest`` takes index round-half-even(p*(n-1)).

    ``extra(total, missing)`` may add aggregates over the distinct values ``v`` and their counts ``n``. The input is
    read once; everything else works on its counted values.
    """
    counted = _counted(df, value)
    known = F.col("v").isNotNull()
    cuts = [i / slots for i in range(1, slots)]
    facts = counted.select(
        F.struct(
            F.percentile_approx("v", cuts, 10000).alias("bounds"),
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        )
    ).scalar()
    n = facts.getField("total")
    outputs = list(extra(n, facts.getField("missing"))) if extra else []
    for name, p in (linear or {}).items():
        h = F.lit(float(p)) * (n - 1)
        low = _value_at(F.floor(h))
        high = _value_at(F.ceil(h))
        outputs.append((low + (high - low) * (h - F.floor(h))).alias(name))
    for name, p in (nearest or {}).items():
        outputs.append(_value_at(F.bround(F.lit(float(p)) * (n - 1), 0)).alias(name))
    return _cumulative(counted, facts.getField("bounds")).agg(*outputs)
