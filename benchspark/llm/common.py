"""Helpers shared by the corpus operators: staged tables, Arrow text buffers, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.session import shared_dir

MASK = (1 << 64) - 1
#: Text bytes hashed at once; a longer single text is one chunk of its own.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch; a single longer row is one batch of its own.
BATCH_BYTES = 1 << 20
#: Rows that a Parquet reader decodes at once: whole texts are wide.
READER_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet under the cluster's shared folder and read again: cuts lineage and survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the folders of staged tables that nothing reads any more; other tables are left alone."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to ``BATCH_BYTES`` and a Parquet reader's to ``READER_ROWS``, unless it has set limits of its own.

    Arrow batches are else cut by rows only until they hold 64 MB, and a task holds one several times, in the JVM and in Python.
    Python workers stay and keep what they once took: an executor has two per core after a step that calls Python twice.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def crc_of_id(doc_id="doc_id"):
    """crc32 of the id written as text; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, bytes_[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(sep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of bytes not marked in ``sep``; no run crosses a row."""
    n = len(sep)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inner = offsets[(offsets > 0) & (offsets < n)]
    word = ~sep
    begin = word.copy()
    begin[1:] &= sep[:-1]
    begin[inner] = word[inner]
    end = word.copy()
    end[:-1] &= sep[1:]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, A-Z as a-z: differences of one running polynomial sum."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def append_arrow(df: DataFrame, inputs: list[str], fields: dict[str, str], fn, keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (None: all) with the columns ``fields`` (name -> type) that ``fn(*arrays)`` gives for each batch.

    Input columns of a name in ``fields`` are replaced. Narrow: each Arrow batch is worked on where it lies.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in fields]
    inner = df.select(*[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)], *kept)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[len(inputs) :]] + [f"`{k}` {v}" for k, v in fields.items()])
    names = kept + list(fields)
    n = len(inputs)

    def run(batches):
        for b in batches:
            new = fn(*b.columns[:n])
            yield pa.RecordBatch.from_arrays(list(b.columns[n:]) + list(new), names=names)

    return inner.mapInArrow(run, schema)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def hash_sample(df: DataFrame, rows: int, key: str, count: int) -> DataFrame:
    """About ``rows`` of ``count`` rows, chosen by a hash of ``key``: the same at any partitioning."""
    cells = 1 << 30
    if count <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(cells)) < int(cells * rows / count))


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; NULL is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]
