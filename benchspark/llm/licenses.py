"""License scan by a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import staged, table

#: Words of a text: runs of letters, digits and everything outside ASCII. A-Z are in the class, as lower case comes later.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases and labels that the base result counts.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as they stand in public license texts. label: (notice, mandatory key phrases).
NOTICES = {
    "agpl": ("gnu affero general public license", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license", "2 0"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    "cc-by": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "gpl-2.0": ("gnu general public license version 2", ["general public license version 2"]),
    "gpl-3.0": ("gnu general public license version 3", ["general public license version 3"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["hereby granted"]),
    "lgpl": ("gnu lesser general public license", ["gnu lesser general public license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted free of charge"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "public-domain": ("this is free and unencumbered software released into the public domain", ["public domain"]),
}

#: Notice words that are in every text and never looked up, unless a key phrase holds them.
COMMON = {"a", "any", "are", "by", "for", "in", "into", "is", "of", "or", "the", "this", "to", "under", "use", "with", "and", "0", "2", "3", "4"}

#: Share of a notice's IDF that must stand at the right places.
MIN_COVER = 0.75


class Notice:
    """A notice as postings: its looked-up words with their offsets, and the offsets that must match."""

    def __init__(self, label: str, text: str, key_phrases: list[str]):
        words = text.split()
        self.label, self.must = label, set()
        for phrase in key_phrases:
            p = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            self.must |= set(range(at, at + len(p)))
        self.words = {i: w for i, w in enumerate(words) if w not in COMMON or i in self.must}


def _notices() -> tuple[list[Notice], list[Notice]]:
    return [Notice(label, p, [p]) for p, label in BASE_PHRASES.items()], [Notice(label, t, k) for label, (t, k) in NOTICES.items()]


def index_words(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``hits``: the place of every vocabulary word. One narrow pass over the texts."""
    lower = lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    found = docs.withColumn("_words", words)
    # lower() is fast and may only let too much through; translate() then decides on the few words left
    marked = F.transform("_words", lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct(lower(w).alias("w"), i.alias("i"))))
    hits = F.filter(marked, lambda h: h.isNotNull() & h.w.isin(vocabulary))
    return found.withColumn("n_words", F.size("_words").cast("long")).withColumn("hits", hits).drop("_words")


def document_frequency(indexed: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows and, per vocabulary word, rows that hold it; at most one row per vocabulary word reaches the driver."""
    each = indexed.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h.w))).alias("w"))
    return indexed.count(), {w: int(n) for w, n in each.groupBy("w").count().collect()}


def _starts(notice: Notice, idf: dict[str, float], lookups: int | None) -> Column:
    """Starts at which the notice's rarest mandatory words (all words if ``lookups`` is None) stand at their relative places.

    Mandatory words stand wherever the notice is found, so no start that can pass is left out.
    """
    asked = {o: w for o, w in notice.words.items() if lookups is None or o in notice.must}
    rare = sorted(asked.items(), key=lambda x: (-idf[x[1]], x[0]))[:lookups]

    def starts(offset: int, word: str) -> Column:
        return F.transform(F.filter("hits", lambda h: h.w == F.lit(word)), lambda h: h.i - F.lit(offset))

    sets = [starts(o, w) for o, w in rare]
    out = sets[0]
    for s in sets[1:]:
        out = F.array_intersect(out, s)
    return out


def _cover(notice: Notice, idf: dict[str, float], start: Column) -> Column:
    """The best share of the notice's IDF at one of the starts, 0 where a key phrase is not complete."""
    total = sum(idf[w] for w in notice.words.values())
    has = lambda a, o, w: F.array_contains("hits", F.struct(F.lit(w).alias("w"), (a + F.lit(o)).alias("i")))

    def at(a):
        share = F.lit(0.0)
        for o, w in notice.words.items():
            share = share + F.when(has(a, o, w), F.lit(idf[w])).otherwise(F.lit(0.0))
        whole = F.lit(True)
        for o in sorted(notice.must):
            whole = whole & has(a, o, notice.words[o])
        return F.when(whole, share / F.lit(total)).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(start, at)), F.lit(0.0))


def scan_licenses(docs: DataFrame, text: str = "text", carry: list[str] | None = None, lookups: int = 2) -> DataFrame:
    """The columns ``carry`` of ``docs`` (None: all) with ``_n_words``, ``_starts`` (of base phrases), ``_base_labels``, ``_labels``, ``_score``.

    The places of all notice words are staged in one pass; their document frequencies over all rows rank them. Per row and
    notice the ``lookups`` rarest words of its key phrases are looked up, their places less their offsets are intersected, and at the starts
    left the other words and the mandatory key phrases are checked. Base phrases intersect all their words, so every place
    counts. Everything after the count of frequencies is narrow.

    Defined results: NULL or empty text has no words, no starts, empty labels and score 0; a notice's score is the share of
    its IDF found in place; repeated rows are scanned each; other columns are carried on.
    """
    base, own = _notices()
    vocabulary = sorted({w for t in base + own for w in t.words.values()})
    inner = docs.select(F.struct(*(carry or docs.columns)).alias("_row"), F.col(text).alias("_text"))
    indexed = staged(index_words(inner, vocabulary, "_text").drop("_text"), "license-hits")
    n, df = document_frequency(indexed)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}
    places = indexed.select("_row", "n_words", "hits", *[_starts(t, idf, None).alias(f"b{i}") for i, t in enumerate(base)])
    placed = places.select(
        "_row", "n_words", "hits", F.flatten(F.array(*[f"b{i}" for i in range(len(base))])).alias("starts"),
        F.filter(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(t.label)) for i, t in enumerate(base)]), lambda x: x.isNotNull()).alias("base"),
        *[F.when(F.size("hits") > 0, _cover(t, idf, _starts(t, idf, lookups))).otherwise(F.lit(0.0)).alias(f"c{i}") for i, t in enumerate(own)],
    )
    own_labels = F.filter(F.array(*[F.when(F.col(f"c{i}") >= MIN_COVER, F.lit(t.label)) for i, t in enumerate(own)]), lambda x: x.isNotNull())
    best = F.greatest(*[F.when(F.col(f"c{i}") >= MIN_COVER, F.col(f"c{i}")).otherwise(F.lit(0.0)) for i in range(len(own))])
    return placed.select(
        "_row.*", F.col("n_words").alias("_n_words"), F.col("starts").alias("_starts"),
        F.array_sort(F.array_distinct("base")).alias("_base_labels"),
        F.array_sort(F.array_union("base", own_labels)).alias("_labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), best)).alias("_score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, labels and score of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join("_base_labels", ",").alias("base_labels"),
        F.array_join("_labels", ",").alias("labels"),
        F.col("_score").alias("score"),
    )
