"""Whitening, periodic runs and mixing against brute force, SQL and odd rows; each query is called by its contract."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from benchspark.llm import mixing, runs, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, start long, position int, _runs string"
VECTORS = "vec_id long, embedding array<double>, label int, x string, n long"


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def documents(spark, tmp_path, rows):
    """(doc_id, text, source) rows as a table whose other columns have names that the operators use themselves."""
    return write(spark, tmp_path, "documents", [(i, t, "en", s, 1, 7, 0.5, 3, 2, "r") for i, t, s in rows], DOCS)


def by_sql(oracle, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    found = con.sql(oracle)
    return Counter(tuple(None if v is None else v for v in r) for r in found.fetchall()), found.columns


def as_counter(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


ODD = [
    (1, None, "b"), (2, "", "b"), (3, " \t\n", "a"), (4, "one two", "a"), (4, "one two", "a"), (5, "é " * 40, "ü"), (6, "a b c " * 3000, "a"),
    (7, "x" * 50000, None), (8, "p q p q p q p q r", None), (9, "a b a b c", "B"), (10, "\x0b\x0cw w w w w w\r\nw", "B"), (11, "w " * 5, "c"), (12, None, None),
]


# --- 11 whitening -------------------------------------------------------------------------------------------------

def fitted(spark, tmp_path, rows):
    sf = write(spark, tmp_path, "embeddings", [(i, v, 0, "x", 1) for i, v in rows], VECTORS)
    return whitening.op11_whitening(spark, sf)


def test_whitening_is_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 7)) * np.array([5, 4, 3, 2, 1, 0.5, 0.25])
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(900 + i, v[0].tolist()) for i in range(50)]
    out = fitted(spark, tmp_path, rows).toPandas().sort_values(["vec_id", "component"])
    assert dict(out.dtypes.astype(str)) == {"vec_id": "int64", "component": "int32", "n": "int64", "deviation": "int64", "whitened": "float64", "explained": "float64", "identity_error": "float64"}
    assert len(out) == 4 * len(rows) and set(out.n) == {300} and out.identity_error.max() < 1e-12 and out.identity_error.nunique() == 1
    x = np.floor(256 * v)
    val, vec = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ vec[:, ::-1][:, :4] / np.sqrt(val[::-1][:4])
    got = out[out.vec_id < 300].whitened.to_numpy().reshape(-1, 4)
    for k in range(4):
        assert min(abs(got[:, k] - want[:, k]).max(), abs(got[:, k] + want[:, k]).max()) < 1e-9
    assert np.allclose(out.explained.to_numpy()[:4], val[::-1][:4] / val.sum(), rtol=1e-12)
    gap = 300 * x.astype(int) - x.astype(int).sum(0)
    assert out[out.vec_id < 300].deviation.to_numpy().reshape(-1, 4)[:, 0].tolist() == (gap**2).sum(1).tolist()
    assert (out[out.vec_id >= 900].groupby("component").whitened.nunique() == 1).all()


def test_whitening_of_equal_roots(spark, tmp_path):
    """Points on the axes: every component has the same variance, so any orthogonal axes are right."""
    rows = [(2 * k + s, [float((1 if s else -1) * (j == k)) for j in range(5)]) for k in range(5) for s in (0, 1)]
    out = fitted(spark, tmp_path, rows).toPandas().sort_values(["vec_id", "component"])
    w = out.whitened.to_numpy().reshape(-1, 4)
    assert np.allclose(w.T @ w / len(w) - np.outer(w.mean(0), w.mean(0)), np.eye(4), atol=1e-12)
    assert np.allclose(out.explained, 0.2)


def test_whitening_odd_rows(spark, tmp_path):
    good = [(1, [0.5, -0.25, 1.0]), (2, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (None, [-0.001, 0.0, 2.0])]
    bad = [(3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 0.0, 0.0]), (8, [1e300, 0.0, 0.0]), (9, [1.0, 2.0])]
    out = fitted(spark, tmp_path, good + bad).toPandas()
    assert Counter(out.vec_id.fillna(-1)) == {1: 2, 2: 4, -1: 2}  # three points lie in a plane: two components
    assert set(out.n) == {3} and out.identity_error.max() < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, tmp_path, rows):
    assert fitted(spark, tmp_path, rows).count() == 0


def test_whitening_large_entries(spark, tmp_path):
    """Sums beyond doubles and 64 bits are exact; deviations beyond 64 bits are NULL."""
    rows = [(i, [float(i * 2**40), float(-i), 0.0]) for i in range(6)]
    out = fitted(spark, tmp_path, rows).toPandas()
    assert out.deviation.isna().all() and out.identity_error.max() < 1e-9
    assert abs(out[out.component == 1].whitened.std(ddof=0) - 1) < 1e-9


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(5)
    b = rng.integers(-50, 50, size=(6, 9)).astype(object)
    a = b.dot(b.T)
    c = whitening.characteristic_polynomial(spark, a)
    for x in (-3, 0, 1, 7, 10**6):  # against elimination in fractions
        m = [[Fraction((x if i == j else 0) - int(a[i][j])) for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for k in range(6):
            p = next(i for i in range(k, 6) if m[i][k])
            if p != k:
                m[k], m[p], det = m[p], m[k], -det
            det *= m[k][k]
            for i in range(k + 1, 6):
                f = m[i][k] / m[k][k]
                m[i] = [u - f * v for u, v in zip(m[i], m[k])]
        assert sum(k * x**i for i, k in enumerate(c)) == det


# --- 12 runs ------------------------------------------------------------------------------------------------------

def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_by_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice([1, 2, 2, 3, 30])
        w = []
        while len(w) < rng.choice([0, 5, 6, 40, 200]):
            piece = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            w += piece * rng.choice([1, 1, 4, 5, 9])
        word, row = np.array(w, np.int64), np.zeros(len(w), np.int64)
        got = [(a + s, n, q) for a, b in zip(*(x.tolist() for x in runs.split_rare(word, row))) for s, n, q in runs.lag_scan(word[a:b])]
        assert sorted(got) == brute_runs(w)


def test_splitting_leaves_little():
    """Words that stand less often than four times in a segment end it, again and again."""
    word = np.array([0, 1, 2, 3, 0, 1, 2, 3, 9, 0, 1, 2, 3, 0, 1, 2, 3], np.int64)
    assert runs.split_rare(word, np.zeros(len(word), np.int64))[0].size == 0  # only four of each until 9 splits them
    a, b = runs.split_rare(np.array([5] * 7 + [1] + [5] * 6), np.zeros(14, np.int64))
    assert list(zip(a, b)) == [(0, 7), (8, 14)]
    a, b = runs.split_rare(np.array([5] * 12), np.repeat([0, 1], 6))
    assert list(zip(a, b)) == [(0, 6), (6, 12)]  # no segment crosses a row


def test_runs_long_text():
    """A million equal words, and a hundred thousand without any run, stay cheap."""
    assert runs.lag_scan(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    w = np.tile(np.arange(1000), 300)
    assert runs.lag_scan(w) == [(0, 300_000, 1000)]


def test_runs_are_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choice("ab") if i % 3 else "abcdefgh"[k % (2 + i % 5)] for k in range(rng.randint(0, 60))), "s") for i in range(150)]
    rows += [r for r in ODD if len(r[1] or "") < 1000] + [(13, "a b c " * 50, "s"), (14, "k l m n " * 9 + "o", "s")]
    sf = documents(spark, tmp_path, rows)
    out = runs.op12_runs(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2
    want, columns = by_sql(runs.ORACLES["op12_runs"], sf)
    assert as_counter(out, columns) == want and sum(want.values()) == len(rows)


def test_runs_operator(spark, tmp_path):
    sf = documents(spark, tmp_path, ODD + [(None, "z z z z z z", "s")])
    out = {(r.doc_id, r.text): r for r in runs.find_runs(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert out[6, "a b c " * 3000]._runs == [(0, 9000, 3)] and out[6, "a b c " * 3000]._collapsed == "a b c"
    assert out[8, "p q p q p q p q r"]._collapsed == "p q r" and out[1, None]._n_words == 0 and out[1, None]._collapsed == ""
    assert out[10, "\x0b\x0cw w w w w w\r\nw"]._runs == [(0, 7, 1)] and out[None, "z z z z z z"].source == "s"
    assert runs.op12_runs(spark, documents(spark, tmp_path / "none", [])).count() == 0


# --- 13 mixing ----------------------------------------------------------------------------------------------------

def test_apportion_by_highest_quotients(spark):
    rng = random.Random(4)
    rows = []
    for g in range(60):
        kind = g % 4
        weights = [rng.choice([1, 2, 3]) if kind == 0 else rng.randint(0, 1000) if kind == 1 else 0 if kind == 2 and g % 8 == 2 else rng.paretovariate(0.6) for _ in range(rng.randint(1, 12))]
        seats = rng.choice([0, 1, 7, 50, 999])
        rows += [(g, i, float(w), seats) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "g int, i int, w double, seats long")
    got = {(r.g, r.i): r.won for r in mixing.apportion(df, "w", "seats", "i", ["g"], "won").collect()}
    for g in range(60):
        party = [(i, w) for k, i, w, _ in rows if k == g]
        seats = next(s for k, _, _, s in rows if k == g)
        bids = sorted((-w / (2 * k - 1), i, k) for i, w in party if w > 0 for k in range(1, seats + 1))[:seats]
        won = Counter(i for _, i, _ in bids)
        assert {i: got[g, i] for i, _ in party} == {i: won.get(i, 0) for i, _ in party}


def brute_targets(sizes, weights):
    goal, stopped = Fraction(3 * sum(sizes), 2), set()
    while True:
        rest = goal - sum(2 * sizes[i] for i in stopped)
        open_ = [i for i in range(len(sizes)) if i not in stopped]
        if not open_:
            return [2 * s for s in sizes]
        fair = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if fair[i] > 2 * sizes[i]}
        if not over:
            return [2 * sizes[i] if i in stopped else float(fair[i]) for i in range(len(sizes))]
        stopped |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 0, 1000, 5], [0, 0], [7], [100, 1, 1, 1, 1, 300, 5000]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    out = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("position").collect()
    assert [r.target for r in out] == pytest.approx(brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_mixing_is_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = ODD + [(1000 + i, "w " * rng.randint(0, 400), rng.choice(["a", "a", "a", "b", "z", None, "ü"])) for i in range(400)] + [(None, "n n", "a")] * 5
    sf = documents(spark, tmp_path, rows)
    out = mixing.op13_mixing(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    want, columns = by_sql(mixing.ORACLES["op13_mixing"], sf)
    assert as_counter(out, columns) == want and sum(want.values()) == len(rows)


def test_mixing_law(spark, tmp_path):
    """Near the targets, never above twice a size, the same at other partitionings and shard sizes that cut sources."""
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(1, 300), f"s{i % 7 if i % 2 else 0}") for i in range(900)] + [(5000, "v " * 60000, "s3")] + [(7, "same", "s1")] * 40
    docs = spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet")
    first = mixing.mix_sources(docs, shard_words=5000)
    again = mixing.mix_sources(docs.repartition(7), shard_words=5000)
    columns = first.columns
    assert as_counter(first, columns) == as_counter(again, columns)
    assert first.filter("taken > 2 * size or taken < 0").count() == 0 and first.count() == len(rows)
    for r in first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target
    other = mixing.mix_sources(docs, shard_words=5000, seed="other")
    assert as_counter(first, columns) != as_counter(other, columns)


def test_mixing_empty(spark, tmp_path):
    assert mixing.op13_mixing(spark, documents(spark, tmp_path / "none", [])).count() == 0
    out = mixing.op13_mixing(spark, documents(spark, tmp_path / "blank", [(1, None, None), (2, " ", "a")])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in out} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_digests(spark, tmp_path):
    sf = documents(spark, tmp_path, [(1, "u u u u u u x", "s")])
    r = runs.op12_runs(spark, sf).first()
    assert r.runs_sha256 == hashlib.sha256(b"0,6,1\n").hexdigest() and r.collapsed_sha256 == hashlib.sha256(b"u x").hexdigest()
