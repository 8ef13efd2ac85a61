"""Exact n-gram Jaccard join by a token-group matrix: similar documents form groups, a group stores the union of its members'
tokens, the overlap of a query with the union bounds its overlap with every member, and only qualifying groups are opened."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, bounded_batches, dropped, mix, staged, table, text_chunks, word_hashes, word_spans

#: Keys by which similar documents meet a leader.
SKETCH = 8
#: Buckets that a class shares with its leader at least, by the links' percentage: pairs below rarely link.
least_keys = lambda percent: SKETCH * percent // 200
#: Keys that a class shares with the hub that it is compared with. Fewer pairs met there are left to the matrix.
HUB_KEYS = 2
#: Rounds in which each set of a family meets one other, before all that is left is looked up.
HUB_ROUNDS = 2
#: Sets of a family differ from its root in at most this many times the tokens in which linked sets may differ.
FAR = 4
#: Cells of the table of counts that orders tokens from rare to frequent, and cells of one of its pieces. Fixed: what is
#: broadcast (a byte a cell) does not grow. Any table gives right results, a full one only more candidates.
COUNT_BITS, PIECE_BITS = 21, 14
#: Bits of the filter over candidate ids: fixed, so what is broadcast does not grow.
FILTER_BITS = 1 << 23
#: Bits of the filter over tokens that several groups have, as a power of two.
PROBE_BITS = 26
#: Sets and bytes of sets in a block of a group whose links are counted.
BLOCK_SETS, BLOCK_BYTES = 1024, 1 << 23
#: Tokens counted at once for two blocks.
BLOCK_TOKENS = 4096
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = 3) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct word ``size``-grams; fewer words count as one sequence, none as no set."""
    out: list[np.ndarray] = []
    for _, data, offsets in text_chunks(column):
        starts, ends, doc = word_spans(_SEP[data], offsets)
        h = word_hashes(data, starts, ends)
        rows = len(offsets) - 1
        first = np.searchsorted(doc, np.arange(rows + 1))
        for a, b in zip(first[:-1], first[1:]):
            w, k = h[a:b], min(size, b - a)
            if k == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            acc = np.full(len(w) - k + 1, k, np.uint64)
            for j in range(k):
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(acc)]
            out.append(np.unique(mix(acc)))
    return out


def looked_up(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(probes, index): how many of a set's n tokens, first in the common order, are looked up and how many are held in the matrix.

    Of two linked sets the larger one shares at least percent % of its tokens, the smaller one at least 2 * percent / (100 + percent)
    of its own. So their first common token is among the larger one's probes and among the smaller one's index tokens.
    """
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _name(s: np.ndarray) -> bytes:
    """A set's class: 128 bits of its tokens."""
    return int(mix(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(s + np.uint64(1)).sum(dtype=np.uint64)).to_bytes(8, "big")


def _features(base: DataFrame, size: int) -> DataFrame:
    """(id, n, c, keys) of every row, and beside them rows (piece, counts) of each task's counts of its tokens' cells."""

    def run(batches):
        cells = np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = shingle_sets(part.column("t"), size)
                n = [len(s) for s in sets]
                if sum(n):
                    cell, k = np.unique((np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.uint32), return_counts=True)
                    cells[cell] += k.astype(np.uint32)
                c = pa.array([_name(s) if len(s) else None for s in sets], pa.binary())
                keys = pa.array([(s[:, None] * _SEEDS).min(0).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
                none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), c, keys, *none], names=names)
        pieces = cells.reshape(-1, 1 << PIECE_BITS)
        some = np.flatnonzero(pieces.any(axis=1))
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array([pieces[i].tobytes() for i in some], pa.binary())], names=names)

    names = ["id", "n", "c", "keys", "piece", "counts"]
    return base.mapInArrow(run, "id long, n long, c binary, keys array<long>, piece int, counts binary")


def _ranks(counts: DataFrame) -> np.ndarray:
    """One byte a cell that grows with the logarithm of its count, added up over all tasks piece by piece."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << PIECE_BITS, np.uint64)
        for v in rows["counts"]:
            total += np.frombuffer(v, np.uint32)
        rank = np.minimum(255, 8 * np.log2(total + 1.0)).astype(np.uint8)
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "ranks": [rank.tobytes()]})

    out = np.zeros((1 << (COUNT_BITS - PIECE_BITS), 1 << PIECE_BITS), np.uint8)
    for r in counts.groupBy("piece").applyInPandas(add, "piece int, ranks binary").collect():
        out[r["piece"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.reshape(-1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b), for all ids that it is not itself.

    Large and small stars alternate until only stars are left. Every round is staged; a node's edges are only aggregated, never gathered.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _stars(edges):
        near = both(edges)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        old, edges = edges, staged(small, "edges")
        dropped(old)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether each of the edges (a, b), a > b, leads to a node without smaller neighbours and is the only one of a."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return ends.filter("down > 1 or (down > 0 and up > 0)").agg(F.count("*")).first()[0] == 0


def _bits(cells: DataFrame, size: int) -> np.ndarray:
    """A bitmap of the column ``cell`` (0 to size - 1): at most size / 32768 pieces of 4 KB reach the driver."""
    out = np.zeros(size // 8, np.uint8)
    for r in cells.groupBy(F.shiftright("cell", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(32767))).alias("bits")).collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _in_bits(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _token_filter(tokens: DataFrame):
    """A Python function that tells which 64-bit tokens may be among the column ``token``, by a broadcast bitmap of fixed size."""
    cell = F.shiftrightunsigned("token", 64 - PROBE_BITS)
    shared = tokens.sparkSession.sparkContext.broadcast(_bits(tokens.select(cell.alias("cell")), 1 << PROBE_BITS).tobytes())
    return lambda t: _in_bits(np.frombuffer(shared.value, np.uint8), (t >> np.uint64(64 - PROBE_BITS)).astype(np.int64))


def _texts_of(docs: DataFrame, ids: DataFrame, size: int, out, schema: str) -> DataFrame:
    """Rows (c, ``schema``) that ``out`` makes of the sets of the rows whose id is in ``ids``, one per class.

    The fixed filter lets few other texts through to be hashed; equal sets collapse on the map side.
    """
    cell = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(_bits(ids.select(cell.alias("cell")), FILTER_BITS).tobytes())

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            some = np.flatnonzero(_in_bits(bits, b.column("cell").to_numpy(zero_copy_only=False)))
            for lo in range(0, len(some), 256):
                sets = [s for s in shingle_sets(b.column("t").take(pa.array(some[lo : lo + 256])), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([out(s) for s in sets], pa.binary())], names=["c", "n", "s"])

    hashed = docs.filter("id is not null").select("t", cell.alias("cell")).mapInArrow(run, f"c binary, n long, {schema}")
    return hashed.groupBy("c").agg(F.first("n").alias("n"), F.first("s").alias("s"))


def _sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """(c, s): the sets, as bytes, of the classes named in ``names`` and perhaps of a few others."""
    some = names.distinct().join(classes.select("c", "rep"), "c")
    return _texts_of(docs, some.select(F.col("rep").alias("id")), size, lambda s: s.tobytes(), "s binary").select("c", "s")


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sets x and y; only sets that stand in a pair move on from their own exchange."""
    x, y = sets.select(F.col("c").alias("a"), F.col("s").alias("x")), sets.select(F.col("c").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose sets link, counted exactly."""
    return _compared(pairs, sets, percent).where("linked").select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, far: int = 0) -> DataFrame:
    """(a, b, linked, diff): whether the pairs' sets link, and the tokens that only one of them has, NULL if these are more than
    ``far`` times as many as linked sets of these sizes may differ in."""

    def run(batches):
        for batch in batches:
            linked, diff = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                odd = np.setxor1d(x, y, assume_unique=True)
                linked.append((100 + percent) * len(odd) <= (100 - percent) * (len(x) + len(y)))
                diff.append(odd.tobytes() if (100 + percent) * len(odd) <= far * (100 - percent) * (len(x) + len(y)) else None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(diff, pa.binary())], names=["a", "b", "linked", "diff"])

    return _beside(pairs, sets).mapInArrow(run, "a binary, b binary, linked boolean, diff binary")


def _may_link(pairs: DataFrame, heads: DataFrame, ranks, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those that their first tokens allow to link.

    ``heads`` (c, n, s) holds each class's first tokens in the common order. Up to the smaller one of two heads' last tokens
    both sets are known whole, so the tokens that only one of them has there count in full: no link is lost.
    """

    def run(batches):
        rank = np.frombuffer(ranks.value, np.uint8)
        for batch in batches:
            keep = []
            for u, v, n in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist()):
                x, y = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                rx, ry = (rank[(t >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] for t in (x, y))
                end = min((rx[-1], x[-1]), (ry[-1], y[-1]))
                x, y = (t[(r < end[0]) | ((r == end[0]) & (t <= end[1]))] for t, r in ((x, rx), (y, ry)))
                keep.append((100 + percent) * len(np.setxor1d(x, y, assume_unique=True)) <= (100 - percent) * n)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = heads.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("s").alias("x"))
    y = heads.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("s").alias("y"))
    beside = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y")
    return beside.mapInArrow(run, "a binary, b binary")


def _alike_keys(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes those that share at least ``HUB_KEYS`` min-hash keys: a choice of pairs worth comparing."""
    x, y = classes.select(F.col("c").alias("a"), F.col("keys").alias("x")), classes.select(F.col("c").alias("b"), F.col("keys").alias("y"))
    same = F.size(F.filter(F.zip_with("x", "y", lambda u, v: u == v), lambda e: e))
    return pairs.join(x, "a").join(y, "b").filter(same >= HUB_KEYS).select("a", "b")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """|a & b| of every a in ``x`` and b in ``y``, by runs of the tokens that both sides have."""
    flat = []
    for side in (x, y):
        token, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(a) for a in side])
        order = np.argsort(token, kind="stable")
        flat.append((token[order], owner[order]))
    shared = np.intersect1d(flat[0][0], flat[1][0])
    out = np.zeros((len(x), len(y)), np.int64)
    for lo in range(0, len(shared), BLOCK_TOKENS):
        some = shared[lo : lo + BLOCK_TOKENS]
        dense = []
        for side, (token, owner) in zip((x, y), flat):
            a, b = np.searchsorted(token, some[0]), np.searchsorted(token, some[-1], side="right")
            at = np.searchsorted(some, token[a:b])
            fits = some[at] == token[a:b]
            m = np.zeros((len(side), len(some)), np.float32)
            m[owner[a:b][fits], at[fits]] = 1
            dense.append(m)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    return out


def _degrees_inside(groups: DataFrame, sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(c, links): for each set of a group the ``rows`` (c, m) of the sets of its group that link with it, counted exactly.

    A group is dealt to blocks of bounded size; every two blocks are one piece of work.
    """
    named = groups.select(F.col("id").alias("c"), F.col("component").alias("group")).union(groups.select(F.col("component").alias("c"), F.col("component").alias("group"))).distinct()
    members = named.join(sets, "c").join(rows, "c")
    sizes = named.join(sets, "c").groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum(F.length("s")) / F.lit(BLOCK_BYTES))).cast("int").alias("blocks")
    )
    dealt = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = other.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "m", "s")

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        x, y = piece[piece["block"] == piece["i"]], piece[piece["block"] == piece["j"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"c": np.zeros(0, object), "links": np.zeros(0, np.int64)})
        a, b = ([np.frombuffer(v, np.uint64) for v in side["s"]] for side in (x, y))
        both = _overlaps(a, b)
        linked = 100 * both >= percent * (np.array([len(v) for v in a])[:, None] + np.array([len(v) for v in b])[None, :] - both)
        one = piece["i"].iloc[0] == piece["j"].iloc[0]
        if one:
            np.fill_diagonal(linked, False)
        out = [pd.DataFrame({"c": x["c"].to_numpy(), "links": linked @ y["m"].to_numpy()})]
        if not one:
            out.append(pd.DataFrame({"c": y["c"].to_numpy(), "links": linked.T @ x["m"].to_numpy()}))
        return pd.concat(out)

    return pieces.groupBy("group", "i", "j").applyInPandas(run, "c binary, links long")


def _best(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for every class the class outside its group that is the hub of most of its tokens, a hub being a token's least class."""
    hubs = rows.groupBy("token").agg(F.min(F.struct("c", "g", "n")).alias("hub"))
    met = rows.join(hubs, "token").filter((F.col("g") != F.col("hub.g")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    shared = met.groupBy("c", F.col("hub.c").alias("b")).agg(F.count("*").alias("k"))
    return shared.groupBy(F.col("c").alias("a")).agg(F.max(F.struct("k", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def _inside_families(diffs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) twice: links that connect the sets of a family, and the links left between what they connect, counted exactly.

    ``diffs`` (c, f, g, n, diff): what a set and its family's root do not share. Two sets x, y of a family differ in
    |dx| + |dy| - 2 |dx & dy| tokens, so the differences decide. A pair of two groups has a set that does not link with the root,
    and then linked sets share (|dx| + |dy| - D) / 2 > 0 tokens of their differences, D being what linked sets may differ in. With
    the tokens ordered from rare to frequent among the family's differences, one of the first few is common. A token's least
    set is compared first, by those that share most with it; what that connects need not meet again.
    """
    most = F.floor((100 - percent) * (F.col("n") + F.floor(100 * F.col("n") / percent)) / (100 + percent))
    token = F.explode(_longs(F.col("diff"))).alias("token")
    rows = diffs.select("c", "f", "g", "n", (F.length("diff") / 8).cast("long").alias("d"), token)
    often = rows.groupBy("f", "token").agg(F.count("*").alias("often"))
    order = Window.partitionBy("c").orderBy("often", "token")
    placed = staged(rows.join(often, ["f", "token"]).withColumn("at", F.row_number().over(order) - 1).filter("often > 1"), "jaccard-differences")
    probes = placed.filter(F.col("at") <= F.col("d") - F.greatest(F.lit(1), F.col("d") - most))
    held = placed.filter(F.col("at") <= F.col("d") - F.greatest(F.lit(1), F.col("d") - F.floor(most / 2)))

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in ("na", "nb"))
            keep = [
                (100 + percent) * len(np.setxor1d(np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64), assume_unique=True)) <= (100 - percent) * (i + j)
                for u, v, i, j in zip(batch.column("x"), batch.column("y"), na.tolist(), nb.tolist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def checked(pairs: DataFrame) -> DataFrame:
        u, v = diffs.select(F.col("c").alias("a"), F.col("diff").alias("x")), diffs.select(F.col("c").alias("b"), F.col("diff").alias("y"))
        return staged(pairs.join(u, "a").join(v, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a binary, b binary"), "jaccard-alike")

    def regrouped(df: DataFrame, now: DataFrame) -> DataFrame:
        return df.join(now.select(F.col("id").alias("g"), "component"), "g", "left").withColumn("g", F.coalesce("component", "g")).drop("component")

    names = staged(diffs.select("c", "g"), "jaccard-names")
    connecting = None
    for _ in range(HUB_ROUNDS):
        of_now = lambda df: df.drop("g").join(names, "c")
        least = of_now(held).groupBy("f", "token").agg(F.min(F.struct("c", "g", "n")).alias("hub"))
        met = of_now(probes).join(least, ["f", "token"]).filter(F.col("g") != F.col("hub.g")).groupBy("c", "n", F.col("hub.c").alias("b"), F.col("hub.n").alias("nb")).agg(F.count("*").alias("k"))
        best = met.groupBy(F.col("c").alias("a"), F.col("n").alias("na")).agg(F.max(F.struct("k", "b", "nb")).alias("m")).select("a", "na", "m.b", "m.nb")
        links = checked(best)
        connecting = links if connecting is None else connecting.union(links)
        at = lambda k, g: names.select(F.col("c").alias(k), F.col("g").alias(g))
        edges = links.join(at("a", "ga"), "a").join(at("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        names = staged(regrouped(names, connected_components(edges)), "jaccard-names")
    probes, held = probes.drop("g").join(names, "c"), held.drop("g").join(names, "c")
    x = probes.select("f", "token", F.col("c").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("at").alias("ia"))
    y = held.select("f", "token", F.col("c").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("at").alias("ib"))
    differ = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    smaller = (F.col("db") < F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("b") < F.col("a")))
    fits = 2 * F.least(F.col("da") - F.col("ia"), F.col("db") - F.col("ib")) >= F.col("da") + F.col("db") - differ
    left = x.join(y, ["f", "token"]).filter(smaller & (F.col("ga") != F.col("gb")) & fits).select("a", "b", "na", "nb").distinct()
    return connecting, checked(left)


def jaccard_join(docs: DataFrame, percent: int = 90, size: int = 3, text: str = "text", doc_id: str = "doc_id", links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id): one row per row of ``docs``, linked at 100 * |A & B| >= percent * |A | B|.

    1. One pass hashes every text's word n-grams: the tokens. Equal sets are one class, named by 128 bits of its tokens. Beside
       its rows each task leaves counts of its tokens' cells in a table of fixed size; the table orders tokens from rare to
       frequent, ties by hash.
    2. Leaders gather groups: each class is verified against the least class of the buckets of equal min-hash keys that it shares
       most of; verified links are contracted to groups. A large group of near copies costs pairs in proportion to its members.
    3. Of each class the first tokens in the common order are looked up, and fewer of them held (see ``looked_up``), as arrays
       beside the class. Only tokens that several groups have become rows. A passage that many texts share is frequent, so it
       is looked up only where it makes up nearly all of a set.
    4. Texts that are alike without linking, such as copies of one text changed in places of their own, form families: each class
       is compared with the hub outside its group that it shares most tokens with, near ones are connected, and all of a family
       are compared with its root. What a set and the root do not share is kept, and links inside a family are found by it.
    5. The matrix holds the union of the held tokens of each family or group, with the union's bounds on size and place. They
       bound what a query that meets one of its tokens there can share with any member; below what a link needs it is not
       opened. Members of opened ones that share a looked-up token are verified exactly, where their first tokens alone do not
       differ too much.
    6. Components of all verified links are the result. n_links (if ``links``) counts the other rows with an id whose sets link,
       equal sets too: inside groups by overlaps of two blocks of sets at a time, across groups by the verified links.

    Staged tables are deleted once what follows them is written.

    Defined results: texts without words (NULL and empty ones too) have no set, link with nothing and are components of their
    own; rows with NULL ids belong to the component of their class if that has an id, else to none; rows that repeat an id with
    other texts are rows of their own; other columns do not matter; a table without rows gives none.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    written = staged(_features(base, size), "jaccard-features")
    feats = written.filter("piece is null").select("id", "n", "c")
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(written.filter("piece is not null").select("piece", "counts")).tobytes())
    having = written.filter("piece is null and c is not null")
    classes = staged(having.groupBy("c").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("id").alias("m"), F.first("keys").alias("keys")).filter("rep is not null"), "jaccard-classes")

    # groups: each class against the least class of its buckets
    keyed = classes.select("c", "n", F.posexplode("keys").alias("k", "key"))
    lead = keyed.groupBy("k", "key").agg(F.min(F.struct("c", "n")).alias("lead"), F.count("*").alias("many")).filter("many > 1")
    met = keyed.join(lead, ["k", "key"]).filter((F.col("c") != F.col("lead.c")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
    alike = met.groupBy("c", F.col("lead.c").alias("b")).agg(F.count("*").alias("k")).filter(F.col("k") >= least_keys(percent)).groupBy(F.col("c").alias("a")).agg(F.max(F.struct("k", "b")).alias("m"))
    near = staged(alike.select("a", F.col("m.b").alias("b")), "jaccard-near")
    both = lambda pairs: pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c")))
    verified = []

    def compare(pairs: DataFrame, far: int = 0) -> DataFrame:
        found = staged(_compared(pairs, _sets_of(base, classes, both(pairs), size), percent, far), "jaccard-compared")
        verified.append(found.where("linked").select("a", "b"))
        dropped(pairs)
        return found

    def groups_now() -> DataFrame:
        found = verified[0]
        for more in verified[1:]:
            found = found.union(more)
        return staged(connected_components(found), "jaccard-groups")

    compare(near)
    groups = groups_now()

    # the first tokens of every class, in the common order, and those of them that several groups have
    def first(s: np.ndarray) -> bytes:
        rank = np.frombuffer(ranks.value, np.uint8)[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
        probes, _ = looked_up(np.int64(len(s)), percent)
        return s[np.lexsort((s, rank))[:probes]].tobytes()

    heads = _texts_of(base, classes.select(F.col("rep").alias("id")), size, first, "s binary")
    heads = heads.join(groups.select(F.col("id").alias("c"), F.col("component").alias("g")), "c", "left").withColumn("g", F.coalesce("g", "c"))
    heads = staged(heads, "jaccard-heads")

    def rows_of(keep):
        def run(batches):
            for b in batches:
                token, owner, place = [], [], []
                for i, s in enumerate(b.column("s")):
                    t = np.frombuffer(s.as_buffer(), np.uint64)
                    at = np.flatnonzero(keep(t)) if keep else np.arange(len(t))
                    token.append(t[at])
                    owner.append(np.full(len(at), i))
                    place.append(at)
                owner = pa.array(np.concatenate(owner) if owner else np.zeros(0, np.int64))
                columns = [pa.array((np.concatenate(token) if token else np.zeros(0, np.uint64)).view(np.int64)), pa.array((np.concatenate(place) if place else np.zeros(0, np.int64)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [b.column(k).take(owner) for k in ("c", "g", "n")], names=["token", "at", "c", "g", "n"])

        return heads.mapInArrow(run, "token long, at int, c binary, g binary, n long")

    short = rows_of(None).select("token", F.xxhash64("g").alias("g"))
    often = staged(short.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("token"), "jaccard-often")
    rows = staged(rows_of(_token_filter(often)).join(often, "token"), "jaccard-rows")
    dropped(often)
    # families: near hubs connect classes, and every class is compared with its family's root
    hubs = compare(staged(_alike_keys(_best(rows, percent), classes), "jaccard-best"), FAR)
    families = staged(connected_components(hubs.where("diff is not null").select("a", "b")), "jaccard-families")
    rooted = compare(families.select(F.col("id").alias("a"), F.col("component").alias("b")), FAR).where("diff is not null")
    groups = groups_now()
    own = groups.select(F.col("id").alias("c"), F.col("component").alias("g"))
    family = rooted.select(F.col("a").alias("c"), F.col("b").alias("f"), "diff")
    named = family.union(family.select(F.col("f").alias("c"), "f", F.lit(None).cast("binary").alias("diff")).distinct())
    diffs = staged(family.join(classes.select("c", "n"), "c").join(own, "c", "left").withColumn("g", F.coalesce("g", "c")), "jaccard-diffs")
    connecting, alike_ = _inside_families(diffs, percent)
    verified.append(connecting)
    inside = groups_now()
    verified.append(alike_)
    # a family and a group may be named after one class, but a group's members without a difference are not of the family
    placed = rows.drop("g").join(own, "c", "left").join(named.select("c", F.concat(F.lit(b"f"), "f").alias("f")), "c", "left")
    placed = placed.withColumn("g", F.coalesce("g", "c")).withColumn("f", F.coalesce("f", "g"))
    over = Window.partitionBy("token")
    several = placed.withColumn("_lo", F.min("f").over(over)).withColumn("_hi", F.max("f").over(over)).filter("_lo < _hi").drop("_lo", "_hi")
    before, rows = rows, staged(several, "jaccard-rows")
    dropped(before)

    # the matrix, its bound, and the opened groups
    probes, held = (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1), (F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1)
    needed = F.ceil(percent * F.col("n") / 100)
    index = rows.filter(F.col("at") < held)
    matrix = index.groupBy("token", F.col("f").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("at").alias("from"))
    meets = (F.col("f") != F.col("other")) & (F.col("lo") <= F.col("n")) & (100 * F.col("hi") >= percent * F.col("n"))
    fits = F.least(F.col("hi") - F.col("from"), F.col("n") - F.col("at")) >= needed
    asked = rows.filter(F.col("at") < probes).join(matrix, "token").filter(meets & fits)
    opened = asked.select("c", "other").distinct()
    query = rows.filter(F.col("at") < probes).join(opened, "c").select("token", "other", F.col("c").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na"), F.col("at").alias("ia"))
    seen = index.select("token", F.col("f").alias("other"), F.col("c").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    shared = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    pairs = query.join(seen, ["token", "other"]).filter((F.col("ga") != F.col("gb")) & (F.col("nb") <= F.col("na")) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= shared))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = staged(_may_link(pairs, heads, ranks, percent), "jaccard-pairs")
    dropped(heads)
    more = staged(_linked(pairs, _sets_of(base, classes, both(pairs), size), percent), "jaccard-more")
    dropped(pairs, rows)
    verified.append(more)

    near_by = classes.select("c", "rep", "m").join(groups_now().withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = near_by.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = near_by.join(least, "component").select("c", "m", "component_id")
    if links:
        of = classes.select("c", "m")
        at = lambda k, g: inside.select(F.col("id").alias(k), F.col("component").alias(g))
        found = more.union(alike_).distinct().join(at("a", "ga"), "a", "left").join(at("b", "gb"), "b", "left")
        found = found.filter(F.coalesce("ga", "a") != F.coalesce("gb", "b"))
        across = found.select("a", F.col("b").alias("c")).union(found.select(F.col("b").alias("a"), F.col("a").alias("c"))).join(of, "c").select(F.col("a").alias("c"), F.col("m").alias("links"))
        members = inside.select(F.col("id").alias("c")).union(inside.select(F.col("component").alias("c")))
        sets = staged(_sets_of(base, classes, members, size), "jaccard-sets")
        degree = _degrees_inside(inside, sets, of, percent).union(across).groupBy("c").agg(F.sum("links").alias("links"))
        named = named.join(degree, "c", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("m"))
        own = [F.coalesce(F.col("n_links") - F.col("id").isNotNull().cast("int"), F.lit(0)).cast("long").alias("n_links")]
    else:
        own = []
    return feats.join(named, "c", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), *own, F.coalesce("component_id", "id").alias("component_id")
    )


def _longs(s):
    """The 64-bit words of a set's bytes, as an array."""

    @F.pandas_udf("array<long>")
    def read(v: pd.Series) -> pd.Series:
        return v.map(lambda b: np.frombuffer(b, np.int64))

    return read(s)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of three-word shingles at 0.9."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")
