"""Language identification by the nearest of several TF-IDF centroids of each language, with rejection by distance."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, crc_of_id, strings, table

#: Letter 2- and 3-grams are hashed into so many dimensions.
DIMS = 1 << 14
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter, in the host's Unicode."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _TABLES["letters"]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed letter 2- and 3-grams of the lower-cased words with their borders; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    s = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint64)
    pair = s[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = pair[:-1] * np.uint64(0xD6E8FEB86659FD93) + s[2:] * np.uint64(0xA0761D6478BD642F)
    cells = np.concatenate([pair, triple + np.uint64(1)])
    cells = (cells ^ (cells >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(50)
    return np.bincount(cells.astype(np.int64), minlength=DIMS)


def unit_vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and weights of the unit TF-IDF vector with TF = 1 + ln(count)."""
    cells = np.flatnonzero(counts)
    w = (1 + np.log(counts[cells])) * idf[cells]
    return cells, w / np.linalg.norm(w)


class CentroidModel:
    """langs[i] names the language of row i of ``centroids`` (unit rows); similarities below ``floor[i]`` are rejected."""

    def __init__(self, langs: list[str], centroids: np.ndarray, floor: np.ndarray, idf: np.ndarray):
        self.langs, self.idf, self.floor = langs, idf, floor
        self.columns = np.ascontiguousarray(centroids.T)  # by cell, so that a text reads its own cells only

    def predict(self, text: str) -> tuple[str, float, bool]:
        counts = gram_counts(text)
        if counts is None or not self.langs:
            return "und", 0.0, True
        cells, w = unit_vector(counts, self.idf)
        sims = w @ self.columns[cells]
        i = int(np.argmax(sims))
        return self.langs[i], float(min(1.0, max(0.0, sims[i]))), bool(sims[i] < self.floor[i])


def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first seeds: unit centroids."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, 1)
        c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_centroids(train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", clusters: int = 4, sample_per_lang: int = 500, slack: float = 0.35) -> CentroidModel:
    """IDF over all rows of ``train``; ``clusters`` centroids per language from about ``sample_per_lang`` of its rows.

    The bound ``sample_per_lang`` keeps a language's rows, one vector each, in one task's memory; the sample follows a hash of
    the id. A centroid rejects what is farther than ``slack`` of the similarity that its worst sampled texts have.
    """
    train = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))

    def frequency(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column("t").to_pylist():
                counts = gram_counts(t)
                if counts is not None:
                    df += counts > 0
                    n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(df[some], n), pa.int64())})

    cells = train.select("t").mapInArrow(frequency, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    df = {c: n for c, n in cells}
    idf = np.zeros(DIMS)
    idf[:] = [np.log((df.get(-1, 0) + 1) / (df.get(c, 0) + 1)) + 1 for c in range(DIMS)]
    sizes = {r["l"]: r["count"] for r in train.groupBy("l").count().collect()}
    bound = 1 << 30
    rates = F.lit(0)
    for name, n in sizes.items():
        rates = F.when(F.col("l") == name, F.lit(bound if n <= sample_per_lang else int(bound * sample_per_lang / n))).otherwise(rates)
    chosen = train.filter(F.pmod(F.xxhash64("i", F.lit("langid")), F.lit(bound)) < rates)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t in pdf["t"]:
            counts = gram_counts(t)
            if counts is not None:
                row = np.zeros(DIMS, np.float32)
                c, w = unit_vector(counts, idf)
                row[c] = w
                rows.append(row)
        if not rows:
            return pd.DataFrame({"l": [], "c": [], "f": []})
        x = np.stack(rows)
        c = _cluster(x, clusters)
        sims = x @ c.T
        at = np.argmax(sims, 1)
        lowest = float(np.quantile(sims.max(1), 0.001))
        floor = [slack * (float(np.quantile(sims[at == j, j], 0.001)) if (at == j).any() else lowest) for j in range(len(c))]
        return pd.DataFrame({"l": pdf["l"].iloc[0], "c": [r.astype(np.float32).tobytes() for r in c], "f": [min(f, slack * lowest) for f in floor]})

    got = chosen.groupBy("l").applyInPandas(centroids, "l string, c binary, f double").orderBy("l", "f", "c").collect()
    stack = np.stack([np.frombuffer(r["c"], np.float32) for r in got]) if got else np.zeros((0, DIMS), np.float32)
    return CentroidModel([r["l"] for r in got], stack, np.array([r["f"] for r in got]), idf)


def identify_language(docs: DataFrame, model: CentroidModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (cosine of the nearest centroid) and ``lang_rejected``.

    Defined results: NULL, empty or letterless text is ``und`` with score 0 and rejected, as is everything where the model has
    learned nothing; other columns are carried on, columns of the three names replaced; ties go to the first language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x DIMS floats: bounded by the label set

    def predict(column):
        got = [shared.value.predict(t) for t in strings(column)]
        return pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())

    return append_arrow(docs, [text], {"lang_pred": "string", "lang_score": "double", "lang_rejected": "boolean"}, predict, keep)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id() % 5 == 0
    model = fit_centroids(docs.filter(~held))
    return identify_language(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
