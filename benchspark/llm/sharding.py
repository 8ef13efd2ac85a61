"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters are good, then
one exchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchspark.llm.common import private, staged, table

#: Low bits of a key that order the rows of equal texts; the bits above come from the text.
ROW_BITS = 24
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _order_key(text: str, doc_id: str):
    """A 64-bit key: rows of equal texts lie side by side, and a hot text can still be cut between its rows."""
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    row = F.xxhash64(F.col(doc_id), F.lit(7))
    mask = (1 << ROW_BITS) - 1
    return body.bitwiseAND(F.lit(~mask)).bitwiseOR(row.bitwiseAND(F.lit(mask)))


def _counts_below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows with a key below each probe, exact: one vector of counts per task, summed by Spark."""

    def count(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column("key").to_numpy(zero_copy_only=False), side="right")
            rows += np.bincount(at, minlength=len(rows))
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(cuts):
                size[at[order][cuts]] += np.add.reduceat(b.column("size").to_numpy(zero_copy_only=False)[order], cuts)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some, pa.int32()), "bytes": pa.array(size[some]), "rows": pa.array(rows[some])})

    cells = keys.mapInArrow(count, "cell int, bytes long, rows long").groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for cell, b, r in cells.collect():  # at most one row per probe
        size[cell], rows[cell] = b, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def find_splitters(keys: DataFrame, shards: int, parts: int, tolerance: float = 0.001, probes_per_gap: int = 32, max_rounds: int = 20) -> list[tuple[int, int, int]]:
    """(key, rows below, shard border?) at the bounds of ``shards * parts`` pieces of near equal bytes.

    A border between shards is refined until it is within ``tolerance`` of a shard's bytes or no key lies between its two
    nearest probes; a border inside a shard may be off by half a piece, as it only deals out work. Probes are multiples of
    2^24 at first, so a text's rows are cut only where its rows are too many for the tolerance.
    """
    count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    total, n = int(count[0]), int(count[1])
    if n == 0:
        return []
    pieces = shards * parts
    goals = np.array([total * k / pieces for k in range(1, pieces)])
    border = np.array([k % parts == 0 for k in range(1, pieces)])
    allowed = np.where(border, tolerance * total / shards, 0.5 * total / pieces)
    known_k = np.array([LOW, HIGH], dtype=np.int64)
    known_b, known_r = np.array([0, total]), np.array([0, n])
    grid = np.linspace(LOW, HIGH, max(1024, 8 * pieces) + 1)[1:-1]
    probes = np.unique(grid.astype(np.int64) & ~np.int64((1 << ROW_BITS) - 1))
    for _ in range(max_rounds):
        below, rows = _counts_below(keys, probes)
        known_k, at = np.unique(np.concatenate([known_k, probes]), return_index=True)
        known_b, known_r = np.concatenate([known_b, below])[at], np.concatenate([known_r, rows])[at]
        right = np.clip(np.searchsorted(known_b, goals), 1, len(known_k) - 1)
        off = np.minimum(np.abs(known_b[right] - goals), np.abs(known_b[right - 1] - goals))
        open_ = (off > allowed) & (known_r[right] - known_r[right - 1] > 1)
        gaps = {(int(known_k[i - 1]), int(known_k[i])) for i in right[open_]}
        more = []
        for lo, hi in gaps:
            step = 1 << ROW_BITS if hi - lo > (1 << ROW_BITS) else 1
            first, last = lo // step + 1, (hi - 1) // step
            width = last - first + 1
            more += [(first + width * j // (probes_per_gap + 1)) * step for j in range(1, probes_per_gap + 1)] if width > probes_per_gap else [j * step for j in range(first, last + 1)]
            if step > 1 and width <= probes_per_gap:  # no border between texts is left here: cut between the rows of one text
                more += [lo + (hi - lo) * j // (probes_per_gap + 1) for j in range(1, probes_per_gap + 1)]
        probes = np.setdiff1d(np.array(sorted(set(more)), dtype=np.int64), known_k)
        if not len(probes):
            break
    out: dict[int, tuple[int, int, int]] = {}
    for g, is_border in zip(goals, border):
        r = int(np.clip(np.searchsorted(known_b, g), 1, len(known_k) - 1))
        i = r if abs(known_b[r] - g) < abs(known_b[r - 1] - g) else r - 1
        k = int(known_k[i])
        old = out.get(k, (k, int(known_r[i]), 0))
        out[k] = (k, int(known_r[i]), old[2] + int(is_border))
    return sorted(out.values())


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", piece_rows: int = 1_000_000, tolerance: float = 0.001) -> DataFrame:
    """All columns of ``docs`` with ``_size``, ``_shard``, ``_slot``: shards of near equal bytes under a total order.

    Method: histogram sort. Keys and sizes are staged once (16 bytes a row); each round counts the exact bytes and rows below
    all probes in one narrow pass and only those counts reach the driver (their number does not depend on the rows). The
    final exchange moves each row once, into pieces of a shard, so that no task holds a whole shard; slots are the exact rows
    below the piece plus the place in it.

    Defined results: NULL text counts as empty (size 8); NULL ids are ordered like any other; repeated rows get slots of
    their own; a table without rows gives no rows; other columns are carried on,
    those named ``_size``, ``_shard`` and ``_slot`` replaced. Equal texts stay in one shard where the
    tolerance allows it and are cut between their rows where it does not.
    """
    key_, piece_, row_ = private(docs, "_key", "_piece", "_row")
    keyed = docs.withColumn("_size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).withColumn(key_, _order_key(text, doc_id))
    keys = staged(keyed.select(F.col(key_).alias("key"), F.col("_size").alias("size")), "shard-keys")
    parts = max(16, -(-keys.count() // (shards * piece_rows)))
    cuts = find_splitters(keys, shards, parts, tolerance)
    bounds = [c[0] for c in cuts if c[0] != LOW]
    shard_of, start_of, shard = [0], [0], 0
    for key, rows, borders in cuts:
        shard += borders
        if key == LOW:
            shard_of[0] = shard
        else:
            shard_of.append(shard)
            start_of.append(rows)
    first_row = {}
    for s, r in zip(shard_of, start_of):
        first_row.setdefault(s, r)
    offsets = [r - first_row[s] for s, r in zip(shard_of, start_of)]
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    placed = keyed.withColumn(piece_, _piece_of(F.col(key_), np.array(bounds, np.int64)))
    within = F.row_number().over(Window.partitionBy(piece_).orderBy(key_, doc_id))
    return (
        placed.withColumn(row_, within)
        .withColumn("_shard", F.get(literal(shard_of), F.col(piece_)).cast("int"))
        .withColumn("_slot", F.get(literal(offsets), F.col(piece_)) + F.col(row_) - 1)
        .drop(key_, piece_, row_)
    )


def _piece_of(key: Column, bounds: np.ndarray) -> Column:
    """How many of the sorted bounds are at or below the key."""

    @F.pandas_udf("int")
    def piece(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    return piece(key)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    # the checksum is taken before the exchange, so the texts stay out of it
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return shard_documents(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
