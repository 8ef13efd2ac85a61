"""Benchmark decontamination by template canonicalisation: numbers, names and units become typed slots, template windows are
hash-joined, and the fillings of the slots must be consistent."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchspark.llm.common import mix, powers, staged, strings, table, word_spans

#: Words in a window. Shorter items are one window of their whole length; documents then have windows of that length as well.
WINDOW = 8
#: Words of a window that must be plain words, so that a window of slots alone says nothing.
LEAST_PLAIN = 4
#: Share of an item's windows that a document must hold.
MIN_COVER = 0.5
#: Bits of the filter over the benchmark's window hashes: fixed, so what is broadcast does not grow.
FILTER_BITS = 1 << 23

# Unit words and number words that are slots; number words in English, German, French and Spanish, without articles and the
# Spanish word for 11, which is an English word.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds metre metres meter meters mile miles gram grams kilogram kilograms litre litres liter liters pound pounds dollar dollars cent cents euro euros percent degree degrees usd eur kmh mph kb mb gb tb".split())
NUMBERS = frozenset(
    (
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
        "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
        "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
        "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
        "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
        "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
        "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil"
    ).split()
)
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Code points of texts worked on at once; a longer text is worked on alone.
CHUNK = 1 << 17
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """By code point: hash of the lower case, and whether it is part of a word, a digit, a capital, the end of a sentence."""
    if not _TABLES:
        n = sys.maxunicode + 1
        lower = np.arange(n, dtype=np.uint64)
        for c, x in enumerate(map(chr, range(n))):
            if x.isupper() and len(x.lower()) == 1:
                lower[c] = ord(x.lower())
        _TABLES["hash"] = mix(lower + np.uint64(0x51ED))
        _TABLES["word"] = np.fromiter((x.isalnum() or x == "_" for x in map(chr, range(n))), bool, n)
        _TABLES["digit"] = np.fromiter((x.isdigit() for x in map(chr, range(n))), bool, n)
        _TABLES["upper"] = np.fromiter((x.isupper() for x in map(chr, range(n))), bool, n)
        _TABLES["stop"] = np.isin(np.arange(n), [ord(x) for x in ".!?\n:;|\""])
    return _TABLES


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _hash_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_tables()["hash"][codes] * power[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def _hash_set(words: frozenset[str]) -> np.ndarray:
    codes = [_codes(w) for w in sorted(words)]
    size = np.array([len(c) for c in codes])
    ends = np.cumsum(size)
    return _hash_runs(np.concatenate(codes), ends - size, ends)


class Words:
    """The words of a run of texts: where they lie, whose they are, their slot types, and their hashes.

    A number is a word with a digit or a number word; units are the unit words right after a number; a name is a capitalised
    word that is not all capitals and does not begin a sentence, or begins one and stands elsewhere in its text as a name and
    never in lower case. In a second form every capitalised word that begins a sentence is a name.
    """

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        codes, t = _codes(self.joined), _tables()
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        self.starts, self.ends, self.doc = word_spans(~t["word"][codes], offsets)
        starts, ends, doc, n = self.starts, self.ends, self.doc, len(self.starts)
        self.plain = _hash_runs(codes, starts, ends)
        kinds = np.zeros(n, np.int8)
        self.joins = np.zeros(n, bool)
        if n:
            digits, uppers, stops = _sums(t["digit"][codes]), _sums(t["upper"][codes]), _sums(t["stop"][codes])
            same = np.zeros(n, bool)
            same[1:] = doc[1:] == doc[:-1]
            before = np.concatenate([[0], ends[:-1]])
            all_capitals = (uppers[ends] - uppers[starts] == ends - starts) & (ends - starts > 1)
            goes_on = same & (stops[starts] == stops[before])
            capital = t["upper"][codes[starts]]
            kinds[capital & ~all_capitals & goes_on] = NAME
            key = self.plain + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            begins = np.flatnonzero(capital & ~all_capitals & ~goes_on)
            known = begins[np.isin(key[begins], key[kinds == NAME])]
            kinds[known[~np.isin(key[known], key[~capital])]] = NAME
            if "numbers" not in _TABLES:
                _TABLES["numbers"], _TABLES["units"] = _hash_set(NUMBERS), _hash_set(UNITS)
            kinds[(digits[ends] > digits[starts]) | np.isin(self.plain, _TABLES["numbers"])] = NUMBER
            units = np.flatnonzero(np.isin(self.plain, _TABLES["units"]) & same & (kinds != NUMBER))
            new = units[kinds[units - 1] == NUMBER]
            while len(new):
                kinds[new] = UNIT
                units = units[kinds[units] != UNIT]
                new = units[kinds[units - 1] == UNIT]
            # words that may be of one slot with the word before; one sign inside a number, as in 3.5, ends no sentence
            point = t["digit"][codes[np.maximum(before - 1, 0)]] & t["digit"][codes[starts]] & (starts - before == 1)
            self.joins = goes_on | (same & point)
        wild = kinds.copy()
        if n:
            wild[begins[kinds[begins] == PLAIN]] = NAME
        self.forms = [kinds, wild]

    def text(self, first: int, n: int) -> list[str]:
        return [self.joined[a:b].lower() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n])]

    def _tokens(self, kinds: np.ndarray) -> np.ndarray:
        """First words of the tokens: a run of words of one slot type is one token."""
        first = np.ones(len(kinds), bool)
        first[1:] = (kinds[1:] == PLAIN) | (kinds[1:] != kinds[:-1]) | ~self.joins[1:]
        return np.flatnonzero(first)

    def windows(self, short: list[int] | None = None):
        """(hashes, first words, last words that they stand for, rows of (words, slot types), form) of the windows by form.

        Form 0 has the words as they are, at every word. The others have tokens, where they hold a slot (form 2: a slot that form
        1 has not); such a window stands for the windows that begin in its first token, the last one of a text for all that follow. A text shorter than a window
        is one window of its own length; with ``short`` the windows of those lengths, too, are taken everywhere instead.
        """
        if not len(self.doc):
            return
        every = np.arange(len(self.doc))
        texts = np.searchsorted(self.doc, np.arange(self.doc[-1] + 2))
        full = np.maximum(texts[1:] - WINDOW, texts[:-1])  # first word of the last window of a text
        for form, kinds in enumerate([np.zeros(len(self.doc), np.int8), *self.forms]):
            at = self._tokens(kinds) if form else every
            doc, kind = self.doc[at], kinds[at]
            h = self.plain[at]
            for k in (NUMBER, NAME, UNIT):
                h[kind == k] = mix(np.array([k], np.uint64))[0]
            bounds = np.append(at, len(self.doc))
            slot = _sums(kind != PLAIN)
            # a token is the same in form 1 if its words are of its type there, too
            other = _sums(kinds != self.forms[0])
            differs = other[bounds[1:]] > other[bounds[:-1]]
            more = _sums(differs if form == 2 else kind != PLAIN)
            change = np.zeros(len(at), np.int64)
            change[1:] = np.cumsum(h[1:] != h[:-1])
            first = np.searchsorted(doc, np.arange(doc[-1] + 2))
            for n in range(1, WINDOW + 1):
                if n == WINDOW or short is not None and n in short:
                    begin = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
                elif short is not None:
                    continue
                else:
                    begin = first[:-1][np.diff(first) == n]
                slotted = slot[begin + n] - slot[begin]
                fine = (more[begin + n] > more[begin]) & (n - slotted >= LEAST_PLAIN) if form else np.ones(len(begin), bool)
                if n == WINDOW:  # a window of one repeated word says nothing
                    fine &= change[begin + n - 1] - change[begin] >= LEAST_PLAIN - 1
                begin = begin[fine]
                if not len(begin):
                    continue
                acc = np.full(len(begin), n, np.uint64)
                for j in range(n):
                    acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[begin + j]
                last = at[begin]
                if form:
                    own = doc[begin]
                    ends = begin + n == first[own + 1]
                    last = np.where(ends, full[own], np.minimum(bounds[begin + 1] - 1, full[own]))

                def row(i: int, kind=kind, bounds=bounds, begin=begin, n=n):
                    cut = bounds[begin[i] : begin[i] + n + 1].tolist()
                    return [" ".join(self.text(x, y - x)) for x, y in zip(cut[:-1], cut[1:])], kind[begin[i] : begin[i] + n].tobytes()

                yield mix(acc), at[begin], np.maximum(last, at[begin]), row, form


def _runs(texts: list[str]):
    """(first, last) of runs of texts of about CHUNK code points."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


WINDOW_ROW = "h long, start int, last int, words array<string>, kinds binary, form int"


def _rows(table_: DataFrame, text: str, key: str, bits: bytes | None, short: list[int] | None = None) -> DataFrame:
    """(key, h, start, last, words, kinds, form) of the windows; with ``bits`` only of those that may be in the benchmark."""
    shared = table_.sparkSession.sparkContext.broadcast(bits) if bits is not None else None
    key_type = table_.schema[key].dataType.simpleString()

    def run(batches):
        mask = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for b in batches:
            texts = strings(b.column(1))
            for lo, hi in _runs(texts):
                w = Words(texts[lo:hi])
                for h, at, last, row, form in w.windows(short):
                    some = np.arange(len(h))
                    if mask is not None:
                        cell = (h >> np.uint64(41)).astype(np.int64)
                        some = np.flatnonzero((mask[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
                    if len(some):
                        h, at, last = h[some], at[some], last[some]
                        begin = np.searchsorted(w.doc, w.doc[at])
                        words, kinds = zip(*[row(i) for i in some.tolist()])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(lo + w.doc[at])), pa.array(h.view(np.int64)), pa.array(at - begin, pa.int32()), pa.array(last - begin, pa.int32()),
                             pa.array(list(words), pa.list_(pa.string())), pa.array(list(kinds), pa.binary()), pa.array(np.full(len(some), form), pa.int32())],
                            names=[key, "h", "start", "last", "words", "kinds", "form"],
                        )

    return table_.select(key, text).mapInArrow(run, f"`{key}` {key_type}, {WINDOW_ROW}")


def _filter_bits(index: DataFrame) -> bytes:
    """One bit per top 23 bits of a window hash: at most FILTER_BITS / 32768 bitmaps of 4 KB reach the driver."""
    cell = F.shiftrightunsigned("h", 41)
    rows = index.groupBy(F.shiftright(cell, 15).alias("part")).agg(F.bitmap_construct_agg(cell.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, cover, n_refilled, kind) of the documents that hold an item.

    Both sides become windows of words and windows of template tokens, a token being a plain word or a run of number, name or
    unit words. A filter of fixed size over the benchmark's window hashes is broadcast, so that only windows that may match
    leave the scan of the documents; the hash join then decides exactly, by words and slot types. A document holds an item if,
    on windows that lie at one distance from the item's or at neighbouring ones (steps of at most half the item, so that words
    may be inserted or left out), it covers at least ``min_cover`` of the item's windows, and if over these windows each
    filling of a slot in the item always meets the same filling in the document (a renamed or re-numbered question passes, a
    text with other words in arbitrary places does not). Capitalised words that begin a sentence are slots as well
    where the cover needs them. Where fillings contradict each other, the windows that are equal word for word must reach the
    cover alone, and only they are counted. ``kind`` is ``verbatim`` where all fillings of the counted
    windows are equal and ``refilled`` otherwise.

    Defined results: NULL or empty texts hold nothing and match nothing; items of fewer than 8 words are one window,
    looked for at every word of the documents; rows with NULL ids are skipped; repeated documents or items of one id count once; windows of
    one repeated word are ignored; tables without rows give no rows.
    """
    items = staged(_rows(benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")), "t", "item_id", None), "benchmark-windows")
    sizes = items.filter("form = 0").groupBy("item_id").agg(F.countDistinct("start").alias("item_windows"))
    short = sorted(r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # at most WINDOW - 1 numbers
    found = _rows(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "t", "doc_id", _filter_bits(items), short)
    index = items.join(sizes, "item_id").select(
        "item_id", "item_windows", "h", F.col("start").alias("item_start"), F.col("last").alias("item_last"),
        F.col("words").alias("item_words"), F.col("kinds").alias("item_kinds"), F.col("form").alias("item_form"),
    )
    slots = F.transform(F.sequence(F.lit(1), F.length("kinds")), lambda i: F.substring("kinds", i, F.lit(1)) != F.lit(b"\x00"))
    both = (
        found.join(index, "h")
        .filter((F.size("words") == F.size("item_words")) & (F.col("kinds") == F.col("item_kinds")))
        .withColumn("pairs", F.arrays_zip(F.col("item_words").alias("a"), F.col("words").alias("b"), slots.alias("s")))
        .filter(F.forall("pairs", lambda p: p["s"] | (p["a"] == p["b"])))
        .withColumn("swaps", F.array_distinct(F.transform(F.filter("pairs", lambda p: p["s"]), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))))
    )
    pair = ["doc_id", "item_id", "item_windows"]
    form = F.greatest("form", "item_form")
    at = both.select(*pair, (F.col("start") - F.col("item_start")).alias("shift"), form.alias("form"), "swaps", F.explode(F.sequence("item_start", "item_last")).alias("at"))
    at = at.groupBy(*pair, "shift", "at").agg(F.max(F.col("form") == 0).alias("literal"), F.min(F.when(F.col("form") == 1, F.col("swaps"))).alias("s1"), F.min(F.when(F.col("form") == 2, F.col("swaps"))).alias("s2"))
    # runs of neighbouring shifts: one document's matches of one item bound the window
    order = Window.partitionBy(*pair).orderBy("shift", "at")
    gap = F.col("shift") - F.lag("shift").over(order)
    steps = at.withColumn("new", (gap > F.greatest(F.lit(WINDOW), F.floor((F.col("item_windows") + WINDOW - 1) / 2))).cast("int"))
    steps = steps.withColumn("near", F.sum(F.coalesce("new", F.lit(0))).over(order)).withColumn("support", F.count("*").over(Window.partitionBy(*pair, "shift")))
    # without and with the wildcards of form 2: every shift by itself, and every run of shifts with the window of its fullest shift at each place
    line = ["level", "whole", "line"]
    lines = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(w).alias("whole"), F.col(c).cast("long").alias("line")) for n in (1, 2) for w, c in ((False, "shift"), (True, "near"))]))
    each = steps.withColumn("l", lines).filter((F.col("l.level") == 2) | F.col("literal") | F.col("s1").isNotNull()).select(*pair, "l.*", "at", "support", "literal", F.coalesce(F.when(F.col("l.level") == 2, F.col("s2")), "s1", F.array().cast("array<struct<a:string,b:string>>")).alias("swaps"))
    picked = each.groupBy(*pair, *line, "at").agg(F.max(F.struct("support", "literal", "swaps")).alias("m"))
    covered = picked.groupBy(*pair, *line).agg(
        F.count("*").alias("n_all"), F.count_if("m.literal").alias("n_literal"), F.array_distinct(F.flatten(F.collect_set("m.swaps"))).alias("swaps")  # an item's words bound the list
    )
    consistent = F.size("swaps") == F.size(F.array_distinct(F.transform("swaps", lambda p: p["a"])))
    refilled = F.size(F.filter("swaps", lambda p: p["a"] != p["b"]))
    # where fillings contradict each other, only the windows that are equal word for word count
    kept = covered.withColumn("n_refilled", F.when(consistent, refilled).otherwise(0)).withColumn("n_windows", F.least(F.when(consistent, F.col("n_all")).otherwise(F.col("n_literal")), "item_windows"))
    kept = kept.withColumn("cover", F.col("n_windows") / F.col("item_windows")).filter(F.col("cover") >= min_cover)
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-F.col("n_refilled")).alias("less"), "item_windows", "cover")).alias("m"))
    return best.select(
        "doc_id", "item_id", F.col("m.n_windows"), F.col("m.item_windows"), F.col("m.cover"), (-F.col("m.less")).cast("int").alias("n_refilled"),
        F.when(F.col("m.less") == 0, "verbatim").otherwise("refilled").alias("kind"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
