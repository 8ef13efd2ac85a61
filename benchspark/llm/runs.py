"""Periodic runs of words: segments are split at words too rare to be in a run, what survives is scanned lag by lag."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, crc_of_id, table

# A run of period q has at least LEAST_WORDS words and at least LEAST_TURNS * q.
LEAST_WORDS, LEAST_TURNS = 6, 4
#: Words whose texts are looked at together; a longer single text is a piece of its own.
CHUNK_WORDS = 1 << 18
#: Rounds of splitting go on while one takes out at least this share of the words left; the lag scan is exact at any split.
SETTLED = 1 / 64


def split_rare(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the segments of rows in which a run may lie.

    A run of period q and at least 4 * q words holds each of its words four times. So a word that stands less often in its
    segment is in no run: it splits the segment, and the parts are counted anew until nothing splits any more.
    """
    at = np.arange(len(word))
    seg = row.astype(np.int64)
    while len(at):
        order = np.lexsort((word[at], seg))
        w, s = word[at][order], seg[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        often = np.empty(len(at), bool)
        often[order] = np.repeat(np.diff(np.append(first, len(w))) >= LEAST_TURNS, np.diff(np.append(first, len(w))))
        left, old = at[often], seg[often]
        cut = np.ones(len(left), bool)
        cut[1:] = (np.diff(left) > 1) | (old[1:] != old[:-1])
        seg = np.cumsum(cut) - 1
        long = np.bincount(seg) >= LEAST_WORDS if len(seg) else np.zeros(0, bool)
        keep = long[seg]
        gone = len(at) - int(keep.sum())
        at, seg = left[keep], seg[keep]
        if gone <= SETTLED * len(at):
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(seg, prepend=-1))
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def _same_to(a: np.ndarray, b: np.ndarray) -> int:
    """Words that ``a`` and ``b`` share from their beginning, looked at in growing pieces."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return min(done + int(differ[0]), n)
        done, step = done + step, 2 * step
    return n


def lag_scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by start and period.

    A run of period q holds four words in a row of every q-th word of the segment, all equal. So lag q needs a look at every
    q-th word only, n / q of them: n log n over all lags. Where four are equal, the words around are compared to both ends.
    A stretch found at a smaller lag already has that lag's period; a lag that is a multiple of a known run's period finds
    nothing new inside it.
    """
    n = len(w)
    found: dict[tuple[int, int], int] = {}
    cover, until = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for q in range(1, n // LEAST_TURNS + 1):
        s = w[::q]
        same = s[1:] == s[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        if not len(hits):
            continue
        known = cover[hits]
        hits = hits[(known == 0) | (q % np.maximum(known, 1) != 0) | (until[hits] < hits + (LEAST_TURNS - 1) * q)]
        end = 0
        for c in hits.tolist():
            if c + (LEAST_TURNS - 1) * q < end:
                continue
            right = c + _same_to(w[c : n - q], w[c + q :])
            left = c - _same_to(w[:c][::-1], w[q : c + q][::-1])
            length = right + q - left
            if length >= max(LEAST_WORDS, LEAST_TURNS * q):
                end = right + q
                if (left, length) not in found:
                    found[left, length] = q
                    if length > until[left] - left or not cover[left]:
                        cover[left:end], until[left:end] = q, end
    return sorted((left, length, q) for (left, length), q in found.items())


def _words(column: pa.Array):
    """(first row, words of each row) of runs of rows of about CHUNK_WORDS words; bytes.split cuts at blanks and \\t to \\r."""
    at, rows, total = 0, [], 0
    for i, text in enumerate(column.cast(pa.large_binary())):
        words = (text.as_py() or b"").split()
        if rows and total + len(words) > CHUNK_WORDS:
            yield at, rows
            at, rows, total = i, [], 0
        rows.append(words)
        total += len(words)
    if rows:
        yield at, rows


def _scan(column: pa.Array):
    counts, starts, lengths, periods, ends, texts = [], [], [], [], [0], []
    for _, rows in _words(column):
        ids: dict[bytes, int] = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for words in rows for w in words), np.int64)
        sizes = np.array([len(words) for words in rows])
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(rows)), sizes)
        runs: dict[int, list] = {}
        for a, b in zip(*(x.tolist() for x in split_rare(word, row))):
            i = int(row[a])
            runs.setdefault(i, []).extend((a - int(first[i]) + s, length, q) for s, length, q in lag_scan(word[a:b]))
        for i, words in enumerate(rows):
            here = sorted((s, q, length) for s, length, q in runs.get(i, ()))
            counts.append(len(words))
            starts += [s for s, _, _ in here]
            lengths += [n for _, _, n in here]
            periods += [q for _, q, _ in here]
            ends.append(len(starts))
            if here:
                keep = np.ones(len(words), bool)
                for s, q, n in here:
                    keep[s + q : s + n] = False
                words = [words[j] for j in np.flatnonzero(keep).tolist()]
            texts.append(b" ".join(words))
    fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], names=["start", "length", "period"])
    return pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) with ``_n_words``, ``_runs`` and ``_collapsed``.

    ``_runs``: (start, length, period) of every run, by start and period, in words from 0: consecutive words of which those
    ``period`` apart are equal, of no smaller period, at least 6 words and 4 periods, as long as the equality goes.
    ``_collapsed``: the text's words joined by one blank, each run cut to its first period. One narrow pass.

    Defined results: NULL, empty or blank texts have no words, no runs and an empty collapsed text; overlapping runs are all
    listed, and a word goes if any run drops it; repeated rows are scanned each; other columns are carried on (input columns of
    the three names are replaced); a table without rows gives none. A text is one row, so one task looks at all of it: n log n
    steps for n words.
    """
    fields = {"_n_words": "bigint", "_runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "_collapsed": "string"}
    return append_arrow(docs, [text], fields, _scan, keep=keep)


def with_turns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, in about every tenth row (by crc32 of the id) with the words from a place on repeating their first p words.

    A NULL id repeats nothing.
    """
    h = crc_of_id(doc_id)
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # one-element arrays name a value once per row
    bound = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda x: F.struct(x.w.alias("w"), F.pmod(x.g, F.size(x.w)).cast("int").alias("a"), x.g.alias("g")))
    turned = F.transform(bound, lambda x: F.struct(x.w.alias("w"), x.a.alias("a"), (1 + F.floor((F.size(x.w) - x.a) / (3 + x.g % 8))).cast("int").alias("p")))
    text_of = F.transform(turned, lambda x: F.array_join(F.transform(x.w, lambda w, i: F.when(i < x.a, w).otherwise(F.get(x.w, x.a + (i - x.a) % x.p))), " "))
    asked = F.col(doc_id).isNotNull() & (h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return F.when(asked, F.get(text_of, 0)).otherwise(F.col(text))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, some of which are made to repeat themselves."""
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", with_turns(docs).alias("text")), keep=["doc_id"])
    first = F.array_min(F.transform("_runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p"))))
    line = F.array_join(F.transform("_runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    best = found.withColumn("_best", first)
    length = -F.col("_best.l")
    return best.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), length.alias("length"), F.col("_best.p").alias("period"),
        F.floor(1000 * length / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 of a text's bytes, bit by bit.
_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT)),
  lambda acc, byte: list_reduce([xor(acc, byte)] || [CAST(k AS BIGINT) FOR k IN range(8)], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""

#: All pairs of equal words at every lag, and the islands of such pairs.
ORACLES = {
    "op12_runs": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (SELECT *, row_number() OVER () AS row, len(w) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
t AS (SELECT row, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w, n FROM p),
u AS (SELECT row, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
pairs AS (SELECT x.row, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY row, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
r AS (SELECT row, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), [-length, start, period]) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
k AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM u ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, b.s AS start, b.l AS length, b.p AS period, CAST(1000 * b.l // b.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM t LEFT JOIN r USING (row) LEFT JOIN k USING (row)
"""
}
