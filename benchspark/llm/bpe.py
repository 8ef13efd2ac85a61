"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the bytes of distinct words; decoding concatenates
the tokens' bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, staged, table

#: Most frequent words that are encoded once and broadcast: at most so many, of at most so many bytes each.
COMMON_WORDS, COMMON_BYTES = 1 << 20, 64
#: Words whose ids are put together at once.
JOIN_WORDS = 200_000
NONE = (1 << 31) - 1


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTable:
    """The rank map as one literal: merging tokens a, b gives token c = its rank, for the pair that each token is merged from.

    Spark looks a map literal up by scanning it, so the map is laid out as a sparse matrix whose rows overlap: ``cells[a]`` is
    where row a begins, ``cells[cells[a] + b]`` names the row that owns the place, ``cells[cells[a] + b + width]`` holds c.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        pairs = [(*pair, r) for token, r in ranks.items() if len(token) > 1 and (pair := self._last_pair(token, ranks)) is not None]
        self.cells, self.width = self._layout(np.array(pairs, np.int64).reshape(-1, 3), len(self.tokens))
        # in parts, as the digits of all cells are large as single objects
        self.text = ",".join(",".join(map(str, part.tolist())) for part in np.array_split(self.cells, 64) if len(part))

    @staticmethod
    def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two tokens that the merges of lower rank leave of a token; None if they leave more, as it then never arises."""
        parts = [bytes([b]) for b in token]
        top = ranks[token]
        while len(parts) > 2:
            found = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
            low = min(found)
            if low >= top:
                return None
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    @staticmethod
    def _layout(pairs: np.ndarray, n: int) -> tuple[np.ndarray, int]:
        """First fit of the rows, longest first; a row may begin before the places, where the pad of n cells owns nothing."""
        size = 4 * n + 2 * len(pairs)
        begin, owner, value = np.zeros(n, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        rows, start, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        free = np.ones(size, bool)
        free[:n] = False
        base, block = n, 1 << 14
        for k in np.argsort(-count, kind="stable"):
            columns = pairs[start[k] : start[k] + count[k], 1]
            while not free[base : base + 64].any():
                base += 64
            lo, fits = base, np.zeros(0, np.int64)
            while not len(fits):
                fits = lo + np.flatnonzero(free[lo : lo + block]) - columns[0]
                for c in columns[1:]:  # few places are left after some columns
                    if not len(fits):
                        break
                    fits = fits[free[fits + c]]
                lo += block
            d = int(fits[0])
            begin[rows[k]] = d
            free[d + columns] = False
            owner[d + columns], value[d + columns] = rows[k], pairs[start[k] : start[k] + count[k], 2]
        width = int(begin.max()) + n  # no row reads past its own columns
        return np.concatenate([begin + n, owner[:width], value[:width]]), width

    def literal(self) -> Column:
        return F.split(F.lit(self.text), ",").cast("array<int>")  # folded to one literal

    def rank(self, cells: Column, a: Column, b: Column) -> Column:
        """The rank of two tokens' merge; NONE if there is none."""
        place = F.get(cells, a) + b
        return F.when(F.get(cells, place) == a, F.get(cells, place + self.width)).otherwise(F.lit(NONE))


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(read_ranks(path))


def encode_word(word: Column, merges: MergeTable) -> Column:
    """The tokens of one word (array<int>): a fold that merges the leftmost pair of the lowest rank until none is left."""
    ids = F.split(F.lit(",".join(map(str, merges.byte_ids))), ",").cast("array<int>")
    one_char_a_byte = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    parts = F.transform(F.split(one_char_a_byte, ""), lambda c: F.get(ids, F.ascii(c)))
    none = F.array().cast("array<int>")

    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), then), 0)

    def merged(cells: Column, parts: Column, ranks: Column, low: Column, i: Column) -> Column:
        right = F.get(parts, i + 1)
        return F.struct(
            F.concat(F.slice(parts, F.lit(1), i - 1), F.array(low), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
            F.concat(
                F.when(i > 1, F.concat(F.slice(ranks, F.lit(1), i - 2), F.array(merges.rank(cells, F.get(parts, i - 2), low)))).otherwise(none),
                F.when(right.isNotNull(), F.array(merges.rank(cells, low, right))).otherwise(none),
                F.slice(ranks, i + 2, F.size(ranks)),
            ).alias("ranks"),
        )

    def fold(cells: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            def at(low: Column) -> Column:
                return let(F.array_position(acc["ranks"], low).cast("int"), lambda i: merged(cells, acc["parts"], acc["ranks"], low, i))

            return let(F.array_min(acc["ranks"]), lambda low: F.when(low < NONE, at(low)).otherwise(acc))

        def run(p: Column) -> Column:
            ranks = F.slice(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: merges.rank(cells, a, b)), F.lit(1), F.size(p) - 1)
            return F.aggregate(F.slice(p, 2, F.size(p)), F.struct(p.alias("parts"), ranks.alias("ranks")), step, lambda acc: acc["parts"])

        return let(parts, run)

    return let(merges.literal(), fold)


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the split pattern, with Unicode white space as the tokenizer's regex engine has it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def common_words(words: DataFrame, most: int = COMMON_WORDS) -> DataFrame:
    """(word) of those that occur at least 2^j times, j the least from 1 that leaves at most ``most`` words of ``COMMON_BYTES``.

    A word that occurs once is encoded once wherever that is done, so it is left beside its document.
    """
    counts = staged(words.groupBy("word").count().filter((F.octet_length("word") <= COMMON_BYTES) & (F.col("count") > 1)), "bpe-words")
    level = F.floor(F.log2("count")).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)  # at most 64 rows
    total, least = 0, None
    for at, n in sizes:
        if total + n > most:
            break
        total, least = total + n, at
    return counts.filter(F.lit(False) if least is None else level >= least).select("word")


def _packed(column: pa.Array) -> bytes:
    """A column as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("v", column.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], names=["v"]))
    return sink.getvalue().to_pybytes()


class Packed:
    """A column in packed pieces: the driver passes them on as they are, a worker unpacks them once."""

    def __init__(self, pieces: list[bytes], kind: pa.DataType):
        self.pieces, self.kind = pieces, kind

    def __getstate__(self):
        return {"pieces": self.pieces, "kind": self.kind}

    @cached_property
    def column(self) -> pa.Array:
        chunks = [c for p in self.pieces for c in pa.ipc.open_stream(p).read_all().column(0).chunks]
        self.pieces = []
        return pa.concat_arrays(chunks) if chunks else pa.array([], self.kind)


def pack_book(book: DataFrame, kind: pa.DataType) -> tuple[Packed, Packed]:
    """The words of (word, ids) and, in the same order, their ids as lists of ``kind``: a few packed pieces per task."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                row = _packed(b.column(0).cast(pa.string())), _packed(b.column(1).cast(pa.list_(kind)))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], names=["words", "ids"])

    pieces = book.mapInArrow(run, "words binary, ids binary").collect()
    return Packed([bytes(r["words"]) for r in pieces], pa.string()), Packed([bytes(r["ids"]) for r in pieces], pa.list_(kind))


def places(words: pa.Array, book: pa.Array) -> np.ndarray:
    """Where each word stands in ``book``, -1 if nowhere. The book is looked up among the words, as a hash table of the far
    larger book would be built anew each time."""
    coded = words.dictionary_encode()
    at = pc.index_in(book, value_set=coded.dictionary)
    place = np.full(len(coded.dictionary), -1, np.int32)
    place[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return place[coded.indices.to_numpy()]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", digest: bool = False, keep: list[str] | None = None, most_common: int = COMMON_WORDS) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (binary), or with ``digest`` their count and SHA-256 sums.

    Each match of the pattern is a word. The distinct words of the corpus are counted; the most frequent ones, a table of
    bounded size, are encoded once by the fold and broadcast in packed pieces, which the driver does not unpack. A document's other words, whatever their number,
    go through the same fold beside the document, so its rows are never shuffled. Arrow functions look words up in bulk, and
    decoding takes the bytes of all ids from the vocabulary in one concatenated buffer.

    Defined results: NULL or empty text has no ids and decodes to no bytes; other columns are carried on, columns of the result
    names replaced; equal texts get equal ids; a single word of n bytes costs n merges of arrays of n.
    """
    spark = docs.sparkSession
    merges = merge_table(rank_file)
    words = docs.select(F.explode(words_of(F.col(text), pattern)).alias("word"))
    spread = common_words(words, most_common)
    words_known, ids_known = pack_book(spread.select("word", encode_word(F.col("word"), merges).alias("ids")), pa.uint16() if len(merges.tokens) <= 1 << 16 else pa.int32())
    shared, shared_ids, shared_tokens = (spark.sparkContext.broadcast(v) for v in (words_known, ids_known, pa.array(merges.tokens, pa.binary())))

    def look_up(column):
        flat = column.flatten()
        code = places(flat.cast(pa.string()), shared.value.column)
        missing = code < 0
        ends = np.asarray(column.offsets, np.int64) - column.offsets[0].as_py() if len(column) else np.zeros(1, np.int64)
        rest, at = [[] for _ in range(len(column))], np.flatnonzero(missing)
        if len(at):
            row = np.searchsorted(ends, at, side="right") - 1
            seen: dict[tuple[int, str], int] = {}
            for i, r, w in zip(at.tolist(), row.tolist(), flat.take(pa.array(at)).to_pylist()):
                k = seen.get((r, w))
                if k is None:
                    k = seen[r, w] = len(rest[r])
                    rest[r].append(w)
                code[i] = -1 - k
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code, pa.int32())), pa.array(rest, pa.list_(pa.string()))

    def join(codes, rest):
        """In runs of rows of about JOIN_WORDS words, as each word's ids and bytes are spread out."""
        ends = np.asarray(codes.offsets, np.int64)
        parts, at = [], 0
        while at < len(codes) or not parts:
            to = min(len(codes), max(at + 1, int(np.searchsorted(ends, ends[at] + JOIN_WORDS, side="right")) - 1))
            parts.append(join_rows(codes.slice(at, to - at), rest.slice(at, to - at)))
            at = to
        return [pa.concat_arrays([p[i] for p in parts]) for i in range(len(parts[0]))]

    def join_rows(codes, rest):
        known, tokens = shared_ids.value.column, shared_tokens.value
        offsets, values = np.asarray(known.offsets), np.asarray(known.values)
        code = codes.flatten().to_numpy(zero_copy_only=False)
        ends = np.asarray(codes.offsets, np.int64) - codes.offsets[0].as_py() if len(codes) else np.zeros(1, np.int64)
        inner = rest.flatten()  # array<int> of each rare word, in the rows' order
        inner_off = np.asarray(inner.offsets, np.int64) if len(inner) else np.zeros(1, np.int64)
        rest_off = np.asarray(rest.offsets, np.int64) - rest.offsets[0].as_py() if len(rest) else np.zeros(1, np.int64)
        own = np.asarray(inner.values, np.int32) if len(inner) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(codes)), np.diff(ends))
        rare = code < 0
        at = np.empty(len(code), np.int64)
        length = np.empty(len(code), np.int64)
        at[~rare] = offsets[code[~rare]]
        length[~rare] = offsets[code[~rare] + 1] - at[~rare]
        which = rest_off[row[rare]] - 1 - code[rare]
        at[rare] = inner_off[which]
        length[rare] = inner_off[which + 1] - inner_off[which]
        stop = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat(at - stop[:-1], length) + np.arange(stop[-1])
        is_rare = np.repeat(rare, length)
        ids = np.empty(len(place), np.int32)
        ids[~is_rare], ids[is_rare] = values[place[~is_rare]], own[place[is_rare]]
        cut = stop[ends]
        pieces = tokens.take(pa.array(ids)).cast(pa.large_binary())
        where = np.frombuffer(pieces.buffers()[1], np.int64)[: len(ids) + 1]
        data = memoryview(pieces.buffers()[2] or b"")
        spans = [(a, b, where[a], where[b]) for a, b in zip(cut[:-1], cut[1:])]
        if not digest:
            return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32())), pa.array([bytes(data[c:d]) for _, _, c, d in spans], pa.binary())
        little = memoryview(ids.astype("<u4").tobytes())
        return (
            pa.array(np.diff(cut), pa.int64()),
            pa.array([hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b, _, _ in spans], pa.string()),
            pa.array([hashlib.sha256(data[c:d]).hexdigest() for _, _, c, d in spans], pa.string()),
        )

    fields = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {"ids": "array<int>", "decoded": "binary"}
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in fields]
    inner = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carried)], words_of(F.col(text), pattern).alias("__words"))
    looked = append_arrow(inner, ["__words"], {"__codes": "array<int>", "__rest": "array<string>"}, look_up, keep=[f"__c{i}" for i in range(len(carried))])
    folded = looked.withColumn("__rest", F.transform("__rest", lambda w: encode_word(w, merges)))
    done = append_arrow(folded, ["__codes", "__rest"], fields, join, keep=[f"__c{i}" for i in range(len(carried))])
    return done.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)], *fields)


def decode(ids: Column, rank_file: str) -> Column:
    """The bytes of an ``array<int>`` of ids; ids outside the vocabulary give no bytes."""
    tokens = pa.array(merge_table(rank_file).tokens, pa.binary())

    @F.arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        return pa.array([None if row is None else b"".join(t for t in tokens.take(row.values.filter(pc.and_(pc.greater_equal(row.values, 0), pc.less(row.values, len(tokens))))).to_pylist()) for row in (x if x.is_valid else None for x in column)], pa.binary())

    return joined(ids)


def public_vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the many-language vocabulary at hand."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded bytes of every document."""
    rank_file, pattern = public_vocabulary()
    return encode_documents(table(spark, sf_dir, "documents"), rank_file, pattern, digest=True, keep=["doc_id"])
