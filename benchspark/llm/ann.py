"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beam."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchspark.llm.common import staged, table

#: Bytes of the vectors and graph of a full shard, which a task holds a few times; a table of fewer shards is dealt to up to
#: ``SPREAD`` of at least ``SPREAD_ROWS``. Queries searched together in a shard.
SHARD_BYTES, SPREAD, SPREAD_ROWS, QUERY_ROWS = 1 << 24, 8, 4096, 65_536
DEGREE, BUILD_BEAM, BEAM, RELAX = 64, 96, 192, 1.2
#: Rows of a shard from which its searches take a wider beam.
BEAM_ROWS = 24_576
#: Points that enter a graph together, points pruned or queries searched together, columns of a block of products, components gathered at once.
_BATCH, _BLOCK, _TILE, _FLOATS = 512, 128, 2048, 1 << 23
#: Points that searches may start from, starts of one search, points it opens at a time.
_PIVOTS, _STARTS, _OPEN = 1024, 64, 8
_NONE = np.uint64(2**64 - 1)


def _padded(row: np.ndarray, n: int, values: np.ndarray, fill) -> np.ndarray:
    """The values as a table of ``n`` rows, filled up on the right; ``row`` ascends."""
    count = np.bincount(row, minlength=n)
    wide = np.full((n, int(count.max(initial=0))), fill, values.dtype)
    wide[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = values
    return wide


def _packed(dist: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Words that sort as the distances (none below 0) and hold the id; their lowest bit is free. Words are much faster to partition."""
    return (np.maximum(dist, 0).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (ids.astype(np.uint64) << np.uint64(1))


def _ids(words: np.ndarray) -> np.ndarray:
    return np.where(words == _NONE, -1, ((words & np.uint64(0xFFFFFFFF)) >> np.uint64(1)).astype(np.int32))


def _search(x: np.ndarray, sq: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
    """Greedy beam searches of all rows of ``q`` at once from their nearest points of ``entry``: ids by distance, -1 where there are
    fewer than ``beam``. A search ends when all points of its beam are opened, and looks at a point once."""
    n, size, step = len(q), len(x), _OPEN * graph.shape[1]
    most = max(1, min(_BLOCK, 65_535 // step, _FLOATS // (step * x.shape[1])))
    if n > most:
        return np.concatenate([_search(x, sq, graph, entry, q[lo : lo + most], beam) for lo in range(0, n, most)])
    own = (q**2).sum(1)
    starts, wide = min(_STARTS, beam, len(entry)), min(_OPEN, beam)
    words = _packed(sq[entry] - 2 * (q @ np.take(x, entry, axis=0).T) + own[:, None], np.broadcast_to(entry, (n, len(entry))))
    words = np.partition(words, starts - 1, axis=1)[:, :starts]
    base = np.arange(n, dtype=np.int64) * size
    seen = np.zeros(n * size, np.uint16)
    seen[(base[:, None] + _ids(words)).ravel()] = 1
    words = np.concatenate([words, np.full((n, beam - starts), _NONE)], 1)
    found, rows = np.full((n, beam), _NONE), np.arange(n)
    while True:
        best = np.partition(np.where(words & np.uint64(1), _NONE, words), wide - 1, axis=1)[:, :wide]
        live = (best != _NONE).any(1)
        if not live.all():
            found[rows[~live]] = words[~live]
            if not live.any():
                break
            rows, words, best = rows[live], words[live], best[live]
        words |= (words <= best[:, -1:]).astype(np.uint64)  # the lowest bit: opened
        at = np.flatnonzero(best.ravel() != _NONE)
        near = np.take(graph, _ids(best.ravel()[at]), axis=0)
        key = (base[rows[at // wide]][:, None] + near)[near >= 0]
        key = key[seen[key] == 0]
        mark = np.arange(1, len(key) + 1, dtype=np.uint16)
        seen[key] = mark
        key = key[seen[key] == mark]  # one of several equal keys of this step
        row, point = np.divmod(key, size)
        d = sq[point] - 2 * np.einsum("ij,ij->i", np.take(x, point, axis=0), np.take(q, row, axis=0)) + own[row]
        new, row = _packed(d, point), np.searchsorted(rows, row)
        keep = new < words.max(1)[row]
        if keep.any():
            words = np.concatenate([words, _padded(row[keep], len(rows), new[keep], _NONE)], 1)
            words = np.ascontiguousarray(np.partition(words, beam - 1, axis=1)[:, :beam])
    return _ids(np.sort(np.where(found == _NONE, _NONE, found & ~np.uint64(1)), axis=1))


def _before(x: np.ndarray, sq: np.ndarray, lo: int, hi: int, width: int) -> np.ndarray:
    """For each of the points ``lo`` to ``hi`` its ``width`` nearest of the points before ``hi``, itself included (-1: none), found by
    products of blocks."""
    q, own = x[lo:hi], sq[lo:hi]
    words, worst = np.full((len(q), width), _NONE), np.full(len(q), -np.inf, np.float32)
    at, step = 0, _TILE // 2
    while at < hi:
        to = min(hi, at + step)
        s = q @ x[at:to].T
        s -= sq[at:to] / 2
        row, col = np.divmod(np.flatnonzero(s > worst[:, None]), to - at)
        if len(row):
            new = _packed(own[row] - 2 * s[row, col], col + at)
            words = np.partition(np.concatenate([words, _padded(row, len(q), new, _NONE)], 1), width - 1, axis=1)[:, :width]
            last = words.max(1)
            worst = np.where(last == _NONE, -np.inf, (own - (last >> np.uint64(32)).astype(np.uint32).view(np.float32)) / 2).astype(np.float32)
        at, step = to, min(_TILE, to)
    return _ids(words)


def _prune(x: np.ndarray, point: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point its diverse neighbours among ``cand`` (-1: none): the nearest one drops all that are ``relax`` times
    nearer to it than to the point, and so on."""
    most = max(1, min(_BLOCK, _FLOATS // (cand.shape[1] * x.shape[1])))
    if len(point) > most:
        return np.concatenate([_prune(x, point[lo : lo + most], cand[lo : lo + most], degree, relax) for lo in range(0, len(point), most)])
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == point[:, None]] = -1
    v = np.take(x, np.maximum(cand, 0).ravel(), axis=0).reshape(*cand.shape, -1)
    v -= x[point][:, None, :]
    d = np.einsum("nwd,nwd->nw", v, v)
    between = np.matmul(v, v.transpose(0, 2, 1))
    between *= -2
    between += d[:, :, None]
    between += d[:, None, :]
    np.maximum(between, 0, out=between)
    between *= relax * relax
    left = np.where(cand < 0, np.float32(np.inf), d)
    out = np.full((len(point), degree), -1, np.int32)
    r = np.arange(len(point))
    for k in range(degree):
        first = np.argmin(left, 1)
        some = np.isfinite(left[r, first])
        if not some.any():
            break
        out[some, k] = cand[r, first][some]
        left[between[r, first] <= d] = np.inf
        left[r, first] = np.inf
    return out


def _augment(x: np.ndarray, top: float) -> np.ndarray:
    """One more component makes all norms equal, so the nearest vector is the one of the largest inner product."""
    return np.concatenate([x, np.sqrt(np.maximum(top * top - (x**2).sum(1, keepdims=True), 0))], 1).astype(np.float32, copy=False)


def _reach(graph: np.ndarray, entry: np.ndarray, seen: np.ndarray) -> None:
    """Marks in ``seen`` the points that a walk from ``entry`` reaches past the marked ones."""
    seen[entry] = True
    while len(entry):
        near = graph[entry].ravel()
        near = near[near >= 0]
        entry = np.unique(near[~seen[near]])
        seen[entry] = True


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours by row, -1 padded; entry points): points enter in random order; each is linked to the diverse ones of its ``beam``
    nearest among those there so far, and these are linked back. Every point is reached from an entry point."""
    n = len(x)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    x = x[order]
    sq = (x**2).sum(1)
    graph = np.full((n, degree), -1, np.int32)
    at = 0
    while at < n:
        part = np.arange(at, min(n, at + min(_BATCH, max(64, at))), dtype=np.int32)
        at = int(part[-1]) + 1
        graph[part] = _prune(x, part, _before(x, sq, int(part[0]), at, beam + 1), degree, relax)
    src = np.argsort(graph, axis=None, kind="stable")[np.count_nonzero(graph < 0) :]
    src = (src // degree).astype(np.int32)  # the links by their ends
    count = np.bincount(graph[graph >= 0], minlength=n)
    begin = np.cumsum(count) - count
    for done in range(0, int(count.max(initial=0)), 2 * degree):  # hubs take more rounds
        nodes = np.flatnonzero(count > done).astype(np.int32)
        nodes = nodes[np.argsort(count[nodes], kind="stable")]  # rows of one table are about as wide
        for lo in range(0, len(nodes), _BLOCK):
            part = nodes[lo : lo + _BLOCK]
            many = np.minimum(count[part] - done, 2 * degree)
            row = np.repeat(np.arange(len(part)), many)
            place = begin[part][row] + done + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            graph[part] = _prune(x, part, np.concatenate([graph[part], _padded(row, len(part), src[place], -1)], 1), degree, relax)
    far = np.argsort(2 * (x @ x.mean(0)) - sq, kind="stable")[:_PIVOTS]  # from the middle
    entry = np.union1d(np.arange(min(n, _PIVOTS)), far)
    seen = np.zeros(n, bool)
    _reach(graph, entry, seen)
    lost = np.flatnonzero(~seen)
    more = [entry, np.setdiff1d(lost, graph[lost])]
    _reach(graph, more[1], seen)
    for p in lost[:, None]:
        if not seen[p]:
            more.append(p)
            _reach(graph, p, seen)
    entry = np.concatenate(more)
    back = np.empty_like(graph)
    back[order] = np.where(graph >= 0, order[graph], -1)
    return back, order[entry]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep", ignore_index=True)
    x = np.stack(pdf["v"].to_numpy()).astype(np.float32, copy=False)
    graph, entry = build_graph(_augment(x, float(np.sqrt((x**2).sum(1).max()))))
    pdf["pos"] = np.arange(len(pdf), dtype=np.int32)
    pdf["near"] = list(graph)
    pdf["entry"] = np.isin(pdf["pos"], entry)
    return pdf[["dim", "shard", "pos", "entry", "v", "ids", "near"]]


def _searcher(k: int, beam: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(index) or not len(queries):
            return empty
        index = index.sort_values("pos", ignore_index=True)
        raw = np.stack(index["v"].to_numpy())
        x = raw.astype(np.float32, copy=False)
        x = _augment(x, float(np.sqrt((x**2).sum(1).max())))
        sq, graph, entry = (x**2).sum(1), np.stack(index["near"].to_numpy()), np.flatnonzero(index["entry"].to_numpy())
        count = index["ids"].str.len().to_numpy()
        members, begin = np.concatenate(index["ids"].to_numpy()), np.cumsum(count) - count
        wide = int(max(beam, 2 * k) * max(1.0, len(x) / BEAM_ROWS) ** 0.25)
        parts = []
        for lo in range(0, len(queries), _BLOCK):
            part = queries.iloc[lo : lo + _BLOCK]
            q, qid = np.stack(part["v"].to_numpy()), part["query_id"].to_numpy()
            found = _search(x, sq, graph, entry, np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32), wide)
            score = np.matmul(np.take(raw, np.maximum(found, 0).ravel(), axis=0).reshape(*found.shape, -1).astype(np.float64), q.astype(np.float64)[:, :, None])[:, :, 0]
            score[found < 0] = -np.inf
            order = np.argsort(-score, 1, kind="stable")[:, : k + 1]
            found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
            row, _ = np.nonzero(found >= 0)
            score, found = score[found >= 0], found[found >= 0]
            own = count[found]  # a point stands for all its ids
            vec = members[np.repeat(begin[found], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
            row, score = np.repeat(row, own), np.repeat(score, own)
            keep = vec != qid[row]
            row, vec, score = row[keep], vec[keep], score[keep]
            by = np.lexsort((vec, -score, row))
            row, vec, score = row[by], vec[by], score[by]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            parts.append(pd.DataFrame({"query_id": qid[row[best]], "vec_id": vec[best], "score": score[best]}))
        return pd.concat(parts, ignore_index=True)

    return run


def _shards(n: int, dim: int, shard_rows: int | None) -> int:
    """Shards of ``n`` points: as few as tasks can hold, as each query visits them all, but enough to share a small table's work."""
    if shard_rows:
        return -(-n // shard_rows)
    full = max(SPREAD_ROWS, SHARD_BYTES // (4 * (dim + DEGREE)))
    return max(-(-n // full), min(SPREAD, -(-n // SPREAD_ROWS)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", beam: int = BEAM, shard_rows: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products among the other rows of ``vectors``.

    Equal vectors are one point of the graph that carries their ``k + 1`` smallest ids, which is all that can be among the
    nearest ``k``, so a hot vector is cut before the shuffle. Points are dealt to shards of about ``shard_rows`` (None: as many
    as a task holds) by a hash; a task builds one shard's graph, which is staged; queries visit every shard in blocks of
    ``query_rows``, and the shards' best are ranked by exact double-precision scores. The beam of ``beam`` widens with the fourth
    root of a shard's rows.

    Defined results: vectors that are NULL, zero or hold NULL or non-finite components, and NULL ids, take no part; vectors of
    another length are never compared; ties go to the smaller id; repeated rows of one id count once; other columns are
    ignored; fewer candidates than ``k`` give fewer rows, none give none.
    """
    v = F.col(embedding)
    usable = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    clean = lambda df, name: df.filter(usable).select(F.col(vec_id).cast("long").alias(name), F.transform(v, lambda c: c + F.lit(0.0).cast("float")).alias("v"))  # noqa: E731  -0.0 becomes 0.0
    by = Window.partitionBy("v").orderBy("id")
    some = clean(vectors, "id").distinct().withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    points = staged(some.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.array_min("ids")).withColumn("dim", F.size("v")), "ann-points")
    sizes = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}
    shards = {dim: _shards(n, dim, shard_rows) for dim, n in sizes.items()}
    ask = clean(queries, "query_id").distinct().withColumn("dim", F.size("v"))
    blocks = -(-max(1, ask.count()) // query_rows)
    count = F.lit(0)
    for dim, n in shards.items():
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("rep", F.lit("shard")), F.greatest(count, F.lit(1))).cast("int"))
    spots = max(64, 4 * sum(shards.values()))  # few heavy groups: adaptive merging would put several into one task
    graph = staged(dealt.repartition(spots, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build, f"dim int, shard int, pos int, entry boolean, v {points.schema['v'].dataType.simpleString()}, ids array<bigint>, near array<int>"), "ann-graph")
    spread = ask.filter(count > 0).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), count - 1)))
    index = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    index, spread = (df.repartition(spots * blocks, *keys) for df in (index, spread))
    found = index.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_searcher(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
