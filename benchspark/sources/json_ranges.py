"""The elements of a list inside one JSON document, read by as many tasks as the file has blocks (A1, A2).

Spark's text reader cuts a file into byte ranges at ``}``, which no escape can precede. A range cannot know by itself whether it
begins inside a string, how deep, under which key and after how many elements. Two narrow passes leave one small row per range
that says so: first the parity of quotes and the change of depth for both beginnings, then, with these known, keys and commas at
the list's level. The third pass emits the elements with their positions; only elements that cross a border are shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes looked at together; a range is walked in such steps.
CHUNK_BYTES = 1 << 20
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_PART = re.compile(r"^part-(\d+)")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1
_QUOTE, _COMMA, _LIST = ord('"'), ord(","), ord("[")


def _ranges(batches, folder: bool):
    """(file, start, bytes) of runs of records of one range, in order; each record with the brace that ended it.

    With ``folder`` a file is its folder and a start counts from the file's number.
    """
    held, size, at = [], 0, None
    for b in batches:
        values, starts, names = pc.binary_join_element_wise(b.column(0), pa.scalar(b""), pa.scalar(b"}")), b.column(2).to_numpy(), b.column(1).dictionary_encode()
        offsets, data = np.frombuffer(values.buffers()[1], np.int32), memoryview(values.buffers()[2] or b"")
        code = names.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(starts, prepend=starts[:1]) != 0) | (np.diff(code, prepend=code[:1]) != 0)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(values)]):
            if lo == hi:
                continue
            here = (names.dictionary[int(code[lo])].as_py(), int(starts[lo]))
            if folder:
                path, name = here[0].rsplit("/", 1)
                here = (path, int(_PART.match(name)[1]) * (1 << 44) + here[1])
            if held and here != at:
                yield *at, b"".join(held)
                held, size = [], 0
            at = here
            held.append(data[offsets[lo] : offsets[hi]])
            size += len(held[-1])
            if size > CHUNK_BYTES:
                yield *at, b"".join(held)
                held, size = [], 0
    if held:
        yield *at, b"".join(held)


def _marks(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, which of them are string text or its quotes, and the change of depth at each."""
    chars = np.frombuffer(_ESCAPE.sub(b"__", data) if b"\\" in data else data, np.uint8)
    quotes = chars == _QUOTE
    after = ((np.cumsum(quotes, dtype=np.uint8) + np.uint8(inside)) & 1).view(bool)  # its parity survives the overflow
    text = after | quotes
    return chars, text, np.where(text, np.int8(0), _DEPTH[chars])


class Walk:
    """Where a reader of the document stands: in a string or not, how deep, under which key and how many commas into its list."""

    def __init__(self, root: str, inside: bool, depth: int, key: str | None = None, listed: bool = True, commas: int = 0):
        self.level = 1 if root == "[" else 2
        self.inside, self.depth, self.key, self.commas = inside, depth, key, commas
        self.listed = listed and depth >= self.level
        self.last, self.opened, self.lists = None, False, set()

    def step(self, data: bytes):
        """(starts, ends, key, number of the first, ended) of runs of neighbouring elements in the next bytes; one that goes on starts at 0."""
        chars, text, change = _marks(data, self.inside)
        depth = np.cumsum(change, dtype=np.int32) + np.int32(self.depth)
        at_level = (depth == self.level) & ((change > 0) | (~text & (chars == _COMMA)))
        marks = at_level | ((change < 0) & (depth == self.level - 1))
        if self.level == 2:
            marks = marks | ((chars == _QUOTE) & (depth == 1))
        begin, name = 0, (-1 if self.inside else None)
        places = np.flatnonzero(marks)
        others = np.flatnonzero(chars[places] != _COMMA).tolist()
        for lo, hi in zip([0, *(k + 1 for k in others)], [*others, len(places)]):
            if self.listed and lo < hi:  # elements that end at a comma
                yield np.append(begin, places[lo : hi - 1] + 1), places[lo:hi], self.key, self.commas, True
                begin, self.commas = int(places[hi - 1]) + 1, self.commas + hi - lo
            if hi == len(places):
                break
            i = int(places[hi])
            if chars[i] == _QUOTE:
                if name is None:
                    name = i + 1
                else:
                    self.last, name = data[max(name, 0) : i].decode("utf-8", "replace"), None
            elif change[i] > 0:
                self.key, self.listed, self.commas, self.opened, begin = self.last if self.level == 2 else "", bool(chars[i] == _LIST), 0, True, i + 1
                if self.listed:
                    self.lists.add(self.key)
            elif self.listed:
                yield np.array([begin]), np.array([i]), self.key, self.commas, True
                begin, self.listed = i + 1, False
        if self.listed:
            yield np.array([begin]), np.array([len(data)]), self.key, self.commas, False
        self.inside = bool(self.inside ^ (int((chars == _QUOTE).sum()) % 2))
        self.depth += int(change.sum(dtype=np.int64))


def _slices(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between bytes, each the one after the other's comma."""
    lo = int(starts[0])
    keep = np.ones(int(ends[-1]) - lo, bool)
    keep[ends[:-1] - lo] = False
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    text = np.frombuffer(data, np.uint8)[lo : int(ends[-1])][keep]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).cast(pa.string())


def _beginnings(text: DataFrame, folder: bool) -> dict[tuple[str, int], tuple[str, bool, int]]:
    """(file, start) -> (root, inside, depth) of every range: a fold over one row per range."""

    def run(batches):
        found: dict = {}
        for file, start, data in _ranges(batches, folder):
            chars = np.frombuffer(_ESCAPE.sub(b"__", data) if b"\\" in data else data, np.uint8)
            quotes = chars == _QUOTE
            odd = (np.cumsum(quotes, dtype=np.uint8) & 1).view(bool) | quotes
            change = _DEPTH[chars]
            flat = int(change[~odd].sum(dtype=np.int64))
            deep = int(change.sum(dtype=np.int64)) - flat  # quotes change no depth
            r = found.setdefault((file, start), [data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1"), 0, 0, 0])
            if r[1]:  # an odd number of quotes so far: both beginnings have changed sides
                flat, deep = deep, flat
            r[1], r[2], r[3] = (r[1] + int(quotes.sum())) % 2, r[2] + flat, r[3] + deep
        for (file, start), r in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (file, start, *r)], names=["file", "start", "root", "odd", "flat", "deep"])

    out, state = {}, None
    rows = text.mapInArrow(run, "file string, start long, root string, odd long, flat long, deep long").collect()
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if state is None or state[0] != r["file"]:
            state = [r["file"], r["root"], False, 0]
        out[r["file"], r["start"]] = (state[1], state[2], state[3])
        state[3] += r["deep"] if state[2] else r["flat"]
        state[2] = bool(state[2] ^ r["odd"])
    return out


def _lists(text: DataFrame, begin: dict, folder: bool) -> tuple[dict, dict]:
    """(file, start) -> (key, listed, commas) at the beginning of every range, and file -> keys that hold lists."""
    shared = text.sparkSession.sparkContext.broadcast(begin)

    def run(batches):
        walks: dict = {}
        for file, start, data in _ranges(batches, folder):
            walk = walks.setdefault((file, start), Walk(*shared.value[file, start]))
            for _ in walk.step(data):
                pass
        for (file, start), w in walks.items():
            row = (file, start, w.opened, w.key, w.listed, w.commas, sorted(w.lists))
            types = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["file", "start", "opened", "key", "listed", "commas", "lists"])

    out, lists, file, state = {}, {}, None, None
    rows = text.mapInArrow(run, "file string, start long, opened boolean, key string, listed boolean, commas long, lists array<string>").collect()
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state = r["file"], (None, False, 0)
        out[file, r["start"]] = state
        lists.setdefault(file, set()).update(r["lists"])
        if r["opened"]:
            state = (r["key"], r["listed"], r["commas"])
        elif state[1]:
            state = (state[0], r["listed"], state[2] + r["commas"])
    return out, lists


def wrapped(text: str = "text"):
    """An element's text as the field ``v`` of an object, as Spark parses objects only."""
    return F.concat(F.lit('{"v":'), text, F.lit("}"))


def unwrapped(text: str = "text"):
    """An element's JSON text without blanks, the bare text for a string."""
    return F.from_json(wrapped(text), "v string").getField("v")


def read_elements(spark: SparkSession, path, keys: tuple[str, ...] = ("samples",), bare: bool = False, folder: bool = False) -> DataFrame:
    """(source, idx, raw) of ``element_texts``; ``raw`` is the element's JSON text without blanks, the bare text for a string."""
    return element_texts(spark, path, keys, bare, folder).select("source", "idx", unwrapped().alias("raw"))


def element_texts(spark: SparkSession, path, keys: tuple[str, ...] = ("samples",), bare: bool = False, folder: bool = False) -> DataFrame:
    """(source, idx, text): the elements of the list under the first of ``keys`` that a document has, or (``bare``) of a bare list.

    With ``folder`` the part files of a folder, in the order of their numbers, are one document (see ``write_document``).

    ``text`` is what stands in the file. A file without such a list is an error. What is collected is two small rows per block
    of a file, whatever its content.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    text = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    begin = _beginnings(text, folder)
    states, lists = _lists(text, begin, folder)
    chosen = {}
    for (file, _), (root, _, _) in begin.items():
        wanted = [""] if root == "[" and bare else [k for k in keys if k in lists[file]] if root == "{" else []
        if not wanted:
            raise ValueError(f"Expected object with list '{keys[0]}' in {file}")
        chosen[file] = wanted[0]
    shared = spark.sparkContext.broadcast((begin, states, chosen))

    def found(batches):
        """(file, start, first number, texts, whole) of elements; all but the first of a range's stretches are whole."""
        begin, states, chosen = shared.value
        at, walk = None, None
        held, fresh, number = b"", False, None  # the element that goes on: its bytes, whether it began in this range, its number
        for file, start, data in _ranges(batches, folder):
            if (file, start) != at:
                if number is not None:
                    yield *at, number, held, False
                at, walk = (file, start), Walk(*begin[file, start], *states[file, start])
                held, fresh, number = b"", False, None
            for starts, ends, key, n, ended in walk.step(data):
                if key != chosen[file]:
                    continue
                if starts[0] > 0:
                    held, fresh = b"", True
                held, number = held + data[starts[0] : ends[0]], n
                if ended:
                    yield file, start, n, held, fresh
                    held, number = b"", None
                if len(starts) > 1:
                    yield file, start, n + 1, (data, starts[1:], ends[1:]), True
        if number is not None:
            yield *at, number, held, False

    def whole(batches):
        for file, _, n, texts, complete in found(batches):
            if complete:
                raw = _slices(*texts) if isinstance(texts, tuple) else pa.array([texts.decode("utf-8")], pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(file, len(raw)), pa.array(np.arange(n, n + len(raw), dtype=np.int64)), raw], names=["source", "idx", "raw"])

    def cut(batches):
        for file, start, n, texts, complete in found(batches):
            if not complete:
                yield pa.RecordBatch.from_pylist([{"source": file, "idx": n, "start": start, "raw": texts.decode("utf-8")}], pa.schema([("source", pa.string()), ("idx", pa.int64()), ("start", pa.int64()), ("raw", pa.string())]))

    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "raw"))), lambda p: p["raw"])  # one piece per block that an element crosses
    pieces = text.mapInArrow(cut, "source string, idx long, start long, raw string")
    crossing = pieces.groupBy("source", "idx").agg(F.array_join(in_order, "").alias("raw"))
    rows = text.mapInArrow(whole, "source string, idx long, raw string").unionByName(crossing)
    return rows.where(F.col("raw").rlike(r"\S")).withColumnRenamed("raw", "text")


def write_document(head: dict[str, DataFrame], rows: DataFrame, path: str, order: list[str], name: str = "samples") -> None:
    """One JSON document under ``path``: the one-row frames of ``head``, then all ``rows`` in order as the list ``name``.

    Many tasks write it: each part file holds rows with their commas, the first one the head as well, the last one the closing
    bracket, and all parts end at a brace, so that they make the document when put one after the other.
    """
    fields = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    spark = rows.sparkSession
    parts = [f'"{k}":' + (df.select(fields(df)).first() or ["null"])[0] for k, df in head.items()]
    begin = "{" + ",".join(parts) + ("," if parts else "") + f'"{name}":['
    keys = [f"k{i}" for i in range(len(order))]
    keyed = rows.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, order)], F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    line = F.to_json("row", {"ignoreNullFields": "false"})  # of all rows only after the sort, so it is made once
    first = keyed.groupBy().agg(F.min(F.struct(*keys)).alias("m"), F.count("*").alias("n")).first()
    if not first["n"]:
        spark.createDataFrame([(begin + "]",)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "}").text(path)
        return
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lit(first["m"][k]))
    least = keyed.where(same).agg(F.min(line).alias("line")).first()["line"]
    # the first row follows the head; its exact copies, if any, are rows like the others
    is_first = same & (line == least)
    inner = lambda c: F.concat(F.lit(","), F.expr(f"substring({c}, 1, length({c}) - 1)"))
    copies = keyed.where(is_first).select(*keys, line.alias("line")).groupBy(*keys, "line").agg(F.count("*").alias("n")).where("n > 1")
    copies = copies.select(F.lit(1).alias("rank"), *keys, F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), inner("line").alias("value"), F.explode(F.sequence(F.lit(2).cast("bigint"), "n")).alias("copy")).drop("copy")
    body = keyed.where(~is_first).select(F.lit(1).alias("rank"), *keys, "row", F.lit(None).cast("string").alias("value"))
    ends = spark.createDataFrame([(0, begin + least[:-1]), (2, "]")], "rank int, value string")
    ends = ends.select("rank", *[F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in [*keys, "row"]], "value")
    ordered = body.union(copies).union(ends).orderBy("rank", *keys).select("value", line.alias("line"))
    ordered.select(F.coalesce("value", inner("line")).alias("value")).write.mode("overwrite").option("lineSep", "}").text(path)


def read_head(spark: SparkSession, path: str, schema: str, name: str = "samples") -> DataFrame:
    """What ``write_document`` has put before the list, as one row."""
    first = spark.read.option("lineSep", f',"{name}":[').text(path).where(F.col("_metadata.file_name").startswith("part-00000"))
    return first.where(F.col("value").startswith("{") & (F.col("_metadata.file_block_start") == 0)).limit(1).select(F.from_json(F.concat("value", F.lit("}")), schema).alias("h")).select("h.*")
