"""Object-label rules as column expressions (C1-C18, C20, C23 parts, C25, C26, E1).

A label is a nullable text; NULL and the empty text both mean "no label", and every rule that finds none gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchspark.functions.text import WS, WS_CHARS, any_word, col, let, lower_strip, re_any, strip, text, words

# Word lists of the label rules.
BAD_OBJECTS = ["floor", "wall", "ceiling", "room", "background", "outside", "nothing", "unknown", "scene", "image",
               "view", "camera", "person", "people", "man", "woman", "boy", "girl", "human", "humans"]
BAD_GENERIC_WORDS = ["object", "thing", "item", "stuff", "something", "anything", "square", "circle", "shape"]
BAD_GENERIC_PHRASES = ["white object", "black object", "red object", "blue object", "small object", "large object"]
FURNITURE_PHRASES = ["furniture", "wooden furniture", "decor", "room decor"]
HUMAN_FIRST = ["person", "man", "woman", "boy", "girl", "people"]
PERSON_LIKE = ["person", "man", "woman", "boy", "girl", "human", "people"]
SURFACES = ["table", "desk", "counter", "shelf", "cabinet", "bench", "stool", "stand", "rack", "piano", "whiteboard", "board"]
OVERLAY_WORDS = ["dot", "line", "ray", "marker", "overlay", "circle", "point", "pointer", "arrow", "arrowhead"]
PREPOSITIONS = ["in", "on", "at", "with", "of", "to", "from", "near", "by", "for"]
VAGUE_PHRASES = ["not enough information", "cannot determine", "cannot tell", "unclear", "not enough", "cannot"]
COPULAS = ["is", "are", "was", "were", "be", "being", "been"]
BAD_NOUN_TOKENS = ["is", "are", "was", "were", "be", "being", "been", "standing", "sitting", "wearing", "near", "next", "to",
                   "left", "right", "behind", "infront", "front", "back", "on", "under", "above", "below", "with", "and",
                   "or", "the"]
ALIASES = {"couch": "sofa", "sofa": "sofa", "desk": "table", "table": "table", "cupboard": "cabinet", "cabinet": "cabinet"}
CLOTHING = ["shirt", "tshirt", "t-shirt", "sweater", "hoodie", "jacket", "coat", "vest", "pants", "jeans", "shorts", "skirt",
            "dress", "leggings", "shoes", "sneakers", "sandals", "slippers", "boots", "flip-flops", "hat", "cap", "beanie",
            "glasses", "sunglasses", "scarf", "tie", "backpack", "bag", "purse", "apron"]

# Area and distance limits.
SMALL_AREA = 0.01
SMALL_CONTEXT_AREA = 0.05
MASK_MIN_AREA = 0.000001
MASK_MAX_AREA = 0.65
EARLY_ACCEPT_AREA = 0.0314
CLOSE_DISTANCE = 0.20
CLOSE_DOWNSCALE = 0.8
CONFIDENCE_RANK = ["LOW", "MEDIUM", "HIGH"]


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _has(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- cleaning ------------------------------------------------------------------------------------------------------

def clean_label(c, n: int = 8) -> Column:
    """Last line, brackets and punctuation dropped, first ``n`` words; NULL if empty, vague or banned."""
    last_line = F.substring_index(strip(c), "\n", -1)
    plain = F.regexp_replace(F.regexp_replace(last_line, r"[()\[\]{}]", " "), rf"[^A-Za-z0-9\-{WS_CHARS}]", "")

    def judge(toks):
        short = F.slice(toks, 1, n)

        def banned(label):
            low = F.lower(label)
            return F.when(
                (label != "")
                & ~low.rlike(re_any(VAGUE_PHRASES))
                & ~low.isin(*BAD_OBJECTS, *BAD_GENERIC_PHRASES)
                & ~any_word(F.split(low, " "), BAD_GENERIC_WORDS),
                label,
            )

        return let(F.array_join(short, " "), banned)

    return let(words(plain), judge)


def strict_noun_phrase(c, n: int = 4) -> Column:
    """``clean_label`` without a copula; a leading "the" may be dropped to save it."""

    def judge(label):
        toks = F.split(F.lower(label), " ")
        rest = clean_label(F.regexp_replace(label, r"^[^ ]+ ?", ""), n)
        rescued = let(rest, lambda r: F.when(~any_word(F.split(F.lower(r), " "), COPULAS), r))
        return F.when(~any_word(toks, COPULAS), label).when((F.get(toks, F.lit(0)) == "the") & (F.size(toks) <= n), rescued)

    return let(clean_label(c, n), judge)


def first_two_sentences(c) -> Column:
    """First two sentences; the empty text if there is none."""
    parts = F.split(strip(text(c)), rf"(?<=[.!?]){WS}+")
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.array_join(F.slice(kept, 1, 2), " ")


def safe_reasoning(c, fallback) -> Column:
    return F.coalesce(_none(first_two_sentences(c)), _none(first_two_sentences(fallback)), col(fallback))


def filter_phrase(c, strict: bool = False) -> Column:
    """NULL for phrases that mention overlay marks: as part of a word, or as a word if ``strict`` (C4)."""
    found = re_any(OVERLAY_WORDS)
    pattern = rf"\b(?:{found})\b" if strict else found
    return let(col(c), lambda x: _none(F.when(~F.lower(x).rlike(pattern), x)))


def has_on(c) -> Column:
    return _true(F.contains(F.lower(col(c)), F.lit(" on ")))


def _cut_conjunction(s: Column) -> Column:
    low = F.lower(s)
    at_or, at_and = F.locate(" or ", low), F.locate(" and ", low)
    return F.when(at_or > 0, strip(F.substring(s, F.lit(1), at_or - 1))).when(
        at_and > 0, strip(F.substring(s, F.lit(1), at_and - 1))
    ).otherwise(s)


def _squash_on(s: Column) -> Column:
    parts = F.filter(F.transform(F.split(s, " on "), strip), lambda p: p != "")
    return F.when(~has_on(s), s).otherwise(
        let(parts, lambda p: F.when(F.size(p) <= 2, s).otherwise(F.concat_ws(" on ", F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    )


def sanitize(c) -> Column:
    """Cut at the first conjunction, keep one " on ", drop trailing prepositions."""
    tail = rf"(?i)(?:(?:^| )(?:{re_any(PREPOSITIONS)}))+$"
    squashed = let(_cut_conjunction(col(c)), _squash_on)
    return _none(F.regexp_replace(F.trim(F.regexp_replace(squashed, f"{WS}+", " ")), tail, ""))


# --- predicates (C6) -----------------------------------------------------------------------------------------------

def is_generic(c) -> Column:
    def by_words(toks):
        return _true(F.get(toks, F.lit(0)).isin(*HUMAN_FIRST)) | ((F.size(toks) <= 2) & any_word(toks, BAD_GENERIC_WORDS))

    def judge(low):
        return low.isin("", *BAD_OBJECTS, *BAD_GENERIC_PHRASES, *FURNITURE_PHRASES) | let(words(low), by_words)

    return F.coalesce(let(lower_strip(col(c)), judge), F.lit(True))


def is_bleeding(c) -> Column:
    return _true(let(lower_strip(col(c)), lambda low: low.contains(" or ") | low.contains(" and ") | low.endswith(" on")))


def is_ambiguous(c) -> Column:
    return let(col(c), lambda x: is_generic(x) | is_bleeding(x))


def is_person_like(c) -> Column:
    return _true(F.lower(col(c)).rlike(rf"\b({re_any(PERSON_LIKE)})\b"))


def is_surface(c) -> Column:
    return _true(any_word(words(F.lower(col(c))), SURFACES))


# --- comparing labels (C8, C9) -------------------------------------------------------------------------------------

def specificity(c) -> Column:
    """Words, less 2 for a generic label, plus 0.5 for an " on " relation; -1 without a label."""

    def score(s):
        value = F.size(words(s)).cast("double") - F.when(is_generic(s), 2.0).otherwise(0.0) + F.when(has_on(s), 0.5).otherwise(0.0)
        return F.when(_has(s), value).otherwise(-1.0)

    return let(col(c), score)


def most_specific(labels: Column) -> Column:
    """Highest specificity, then the longer label, then the earlier one."""
    clean = F.transform(labels, lambda x, i: F.struct(sanitize(x).alias("s"), i.alias("i")))
    scored = F.transform(
        F.filter(clean, lambda x: x["s"].isNotNull()),
        lambda x: F.struct(
            specificity(x["s"]).alias("score"), F.length(x["s"]).alias("n"), (-x["i"]).alias("first"), x["s"].alias("label")
        ),
    )
    return F.coalesce(F.array_max(scored)["label"], F.get(labels, F.lit(0)))


def _subset(ta: Column, tb: Column) -> Column:
    both = (F.size(ta) > 0) & (F.size(tb) > 0)
    return both & ((F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0))


def subset_match(a, b) -> Column:
    """One label's words all occur in the other; never for labels with " on "."""

    def judge(x, y):
        match = let(
            words(F.lower(_cut_conjunction(x))), lambda ta: let(words(F.lower(_cut_conjunction(y))), lambda tb: _subset(ta, tb))
        )
        return _true(F.when(_has(x) & _has(y) & ~has_on(x) & ~has_on(y), match))

    return let(col(a), lambda x: let(col(b), lambda y: judge(x, y)))


def _before_on(s: Column) -> Column:
    return _none(strip(F.substring_index(s, " on ", 1)))


def _relaxed(x: Column, y: Column) -> Column:
    """Relaxed match of two sanitised labels; the part before " on " is looked at only where there is one."""
    roots = let(_before_on(x), lambda rx: let(_before_on(y), lambda ry: (rx == ry) | subset_match(rx, ry)))
    related = x.contains(" on ") | y.contains(" on ")
    return _true((x == y) | subset_match(x, y) | (related & roots))


def relaxed_match(a, b) -> Column:
    """Equal or subset after sanitising, for the whole label or for the part before " on "."""
    return let(sanitize(a), lambda x: let(sanitize(b), lambda y: _relaxed(x, y)))


def equivalent(a, b) -> Column:
    """Relaxed match of labels or roots, or of the roots with furniture aliases resolved."""
    alias = F.create_map(*[F.lit(v) for pair in ALIASES.items() for v in pair])

    def resolved(root):
        return F.transform(words(root), lambda t: F.coalesce(F.try_element_at(alias, t), t))

    def by_root(ra, rb):
        aliased = let(resolved(ra), lambda ta: let(resolved(rb), lambda tb: _subset(ta, tb)))
        return F.when(_has(ra) & _has(rb), relaxed_match(ra, rb) | aliased)

    def judge(x, y):
        root = lambda s: sanitize(_before_on(s))
        return _relaxed(x, y) | _true(let(root(x), lambda ra: let(root(y), lambda rb: by_root(ra, rb))))

    return let(sanitize(a), lambda x: let(sanitize(b), lambda y: judge(x, y)))


def informative(labels: Column) -> Column:
    """Map of cue to usable label; cues without one are dropped."""
    clean = F.transform_values(labels, lambda _, v: sanitize(filter_phrase(sanitize(v))))
    return F.map_filter(clean, lambda _, v: _has(v))


def disagreement(labels: Column) -> Column:
    """Some two concrete labels of the map do not match (C11). A map holds one label per cue, so pairs are few."""
    concrete = F.transform(F.filter(F.map_values(labels), lambda v: ~is_generic(v)), sanitize)

    def differs(vals):
        # slice starts count from 1, positions from 0
        later = lambda i: F.slice(vals, i + 2, F.size(vals))
        return F.exists(F.transform(vals, lambda x, i: F.exists(later(i), lambda y: ~_relaxed(x, y))), lambda d: d)

    return _true(let(concrete, differs))


def trigger(current, differs, always: bool = False) -> Column:
    """Why the arbiter (or, with ``always``, the guardrail) runs, given the cues' ``disagreement`` (C11)."""
    return (
        F.when(is_ambiguous(sanitize(current)), "current_ambiguous")
        .when(col(differs), "cue_disagreement")
        .otherwise("always_on" if always else "no_trigger")
    )


def cue_agreement(label, dot, ray) -> Column:
    """How many of the dot and ray cues agree with the label, 0-2."""

    def agrees(x, cue):
        return let(sanitize(cue), lambda y: (x == y) | subset_match(x, y))

    return F.coalesce(
        let(sanitize(label), lambda x: sum((F.when(_true(agrees(x, c)), 1).otherwise(0) for c in (dot, ray)), F.lit(0))), F.lit(0)
    )


def prefer_specific(canon, mask, ray, dot) -> Column:
    """The canonical label if concrete, else the first concrete cue."""
    out = F.when(~is_generic(canon), F.struct(_none(col(canon)).alias("label"), F.lit(None).cast("string").alias("mode")))
    for cue in (mask, ray, dot):
        out = out.when(~is_generic(cue), F.struct(_none(col(cue)).alias("label"), F.lit("prefer_specific").alias("mode")))
    return out.otherwise(F.struct(_none(col(canon)).alias("label"), F.lit(None).cast("string").alias("mode")))


def choose_mask_label(mask, refined, area) -> Column:
    """Mask label for large masks or a subset of it, else the more specific one (C14)."""
    limit = max(0.015, SMALL_AREA * 1.8)

    def pick(m, r):
        return F.when(col(area) > limit, F.coalesce(m, r)).when(subset_match(m, r), m).otherwise(most_specific(F.array(m, r)))

    return let(sanitize(mask), lambda m: let(sanitize(refined), lambda r: pick(m, r)))


def dot_tiebreak(mask, dot, ray) -> Column:
    """The dot label may stand in for a weak mask label if it agrees with the ray label."""

    def judge(d, m, r):
        return _true(d.isNotNull() & ~is_ambiguous(d) & is_ambiguous(m) & r.isNotNull() & (relaxed_match(d, r) | subset_match(d, r)))

    return let(sanitize(dot), lambda d: let(sanitize(mask), lambda m: let(sanitize(ray), lambda r: judge(d, m, r))))


def canonicalize(mask, dot, area, ray=None) -> Column:
    """STRUCT(label, mode, small_skip) from the cues of one mask."""
    ray = F.lit(None).cast("string") if ray is None else col(ray)
    tiny = (col(area) <= SMALL_AREA) & _has(col(mask)) & _has(col(dot)) & (col(mask) != col(dot))
    skip = _true(
        tiny
        & (
            is_generic(mask) | is_bleeding(mask)
            | (has_on(dot) & relaxed_match(dot, ray))
            | (has_on(dot) & is_surface(mask))
        )
    )

    def decide(skipped):
        usable = F.when(~skipped, col(mask))
        by_mask = F.when(~is_ambiguous(usable), sanitize(usable))
        by_dot = F.when(dot_tiebreak(usable, dot, ray), sanitize(dot))

        def named(m, d):
            mode = F.when(m.isNotNull(), "mask_primary").when(d.isNotNull(), "dot_tiebreak_ray")
            with_skip = F.when(skipped, F.concat_ws("+", mode, F.lit("mask_small_skip"))).otherwise(mode)
            label = F.coalesce(m, d)
            by_ray = label.isNull() & _has(ray)
            return F.struct(
                F.when(by_ray, ray).otherwise(label).alias("label"),
                F.when(by_ray, "fallback_ray_only").otherwise(with_skip).alias("mode"),
                skipped.alias("small_skip"),
            )

        return let(by_mask, lambda m: let(by_dot, lambda d: named(m, d)))

    return let(skip, decide)


def triple_cue(ray, mask, dot, same_mask_ray, same_mask_dot, same_ray_dot, reconciled=None) -> Column:
    """Consensus of three cues from recorded same-object answers (C17).

    Each ``same_*`` is the canonical label of a recorded "yes", else NULL; ``reconciled`` the recorded answer for all three.
    """
    m, r, d = _none(col(mask)), _none(col(ray)), _none(col(dot))
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (m, r, d)), F.lit(0))
    first = F.coalesce(m, r, d)

    def out(label, mode):
        return F.struct(label.alias("label"), F.lit(mode).alias("mode"))

    c = F.when(n == 0, out(F.lit(None).cast("string"), "missing_label")).when(n == 1, out(first, "fallback_single"))
    for answer, pair, mode in (
        (same_mask_ray, (m, r), "judge_mask_ray"),
        (same_mask_dot, (m, d), "judge_mask_dot"),
        (same_ray_dot, (r, d), "judge_ray_dot"),
    ):
        canon = filter_phrase(answer)
        c = c.when(pair[0].isNotNull() & pair[1].isNotNull() & canon.isNotNull(), out(canon, mode))
    if reconciled is not None:
        all3 = filter_phrase(strict_noun_phrase(reconciled, 4))
        c = c.when((n == 3) & all3.isNotNull(), out(all3, "judge_reconcile_all"))
    return c.otherwise(out(first, "fallback_no_consensus"))


def positional(small, surface, max_words: int = 6) -> Column:
    """"small on surface" of two clean labels."""

    def build(a, b):
        ok = ~has_on(a) & ~has_on(b) & (F.lower(a) != F.lower(b))
        phrase = F.array_join(F.slice(words(F.concat(a, F.lit(" on "), b)), 1, max_words), " ")
        return F.when(_true(ok), filter_phrase(phrase))

    return let(clean_label(small, 3), lambda a: let(clean_label(surface, 3), lambda b: build(a, b)))


def salvage(c, n: int = 4) -> Column:
    """Noun phrase before the first function word (C20)."""

    def cut(toks):
        at = F.array_position(F.transform(toks, lambda t: F.lower(t).isin(*BAD_NOUN_TOKENS)), True)
        kept = F.when(at > 0, F.slice(toks, F.lit(1), (at - 1).cast("int"))).otherwise(toks)
        return _none(F.array_join(F.slice(kept, 1, n), " "))

    return let(clean_label(c, 10), lambda s: F.when(s.isNotNull(), let(words(s), cut)))


def label_flow(stages) -> Column:
    """Audit trail from (stage, before, after, note) columns; steps that change nothing are left out."""

    def step(stage, before, after, note):
        def entry(b, a):
            changed = ~F.equal_null(b, a)
            return F.when(
                changed, F.struct(F.lit(stage).alias("stage"), b.alias("before"), a.alias("after"), note.alias("note"))
            )

        return let(sanitize(before), lambda b: let(sanitize(after), lambda a: entry(b, a)))

    none = F.lit(None).cast("string")
    return F.array_compact(F.array(*[step(s, b, a, none if n is None else col(n)) for s, b, a, n in stages]))


def repair_label(c, mask, dot, on_plausible) -> Column:
    """Sanitise; reduce an implausible " on " relation to its left part; replace a bleeding label by a clean cue."""

    def on_fixed(s):
        left = _before_on(s)
        drop = s.contains(" on ") & ~F.coalesce(col(on_plausible), F.lit(True)) & ~is_generic(left)
        return F.when(_true(drop), left).otherwise(s)

    def usable(cue):
        return let(sanitize(cue), lambda x: F.when(~is_ambiguous(x), x))

    def bleed_fixed(s):
        return F.when(is_bleeding(s), F.coalesce(usable(mask), usable(dot), s)).otherwise(s)

    return let(let(sanitize(c), on_fixed), bleed_fixed)


# --- person descriptions (C7) --------------------------------------------------------------------------------------

def clean_person(c) -> Column:
    """Clothing part of a person description; "person" if there is none."""
    low = lower_strip(text(c))
    out = low
    for pattern in (
        rf"^(a|the){WS}+",
        rf"^(person|man|woman|boy|girl){WS}+(is{WS}+)?(wearing|with){WS}+",
        rf"^person{WS}+",
        rf"^(wearing|with){WS}+",
        rf"\b(and|with){WS}*$",
    ):
        out = F.regexp_replace(out, pattern, "")
    out = strip(out)
    return F.when(low.contains("no person visible") | low.contains("no person is visible") | (out == ""), "person").otherwise(out)


def format_person(c) -> Column:
    """Clothing words grouped by garment: "a", "a and b", "a, b, and c"."""
    s = lower_strip(text(c))
    for word in ("a", "the", "person", "man", "woman", "boy", "girl", "wearing", "with"):
        s = strip(F.regexp_replace(s, rf"^{word} ", ""))
    garment = rf"(?<![^ ])({re_any(CLOTHING)})(?![^ ])"
    marked = F.regexp_replace(F.array_join(words(s), " "), garment, "$1\u0001")

    def groups(m):
        # text after the last garment is dropped; without any garment the whole text is one group
        kept = F.when(m.contains("\u0001"), F.substring_index(m, "\u0001", -1)).otherwise(F.lit(""))
        body = F.when(m.contains("\u0001"), F.substring(m, F.lit(1), F.length(m) - F.length(kept) - 1)).otherwise(m)
        return F.transform(F.split(body, "\u0001"), strip)

    def join(g):
        n = F.size(g)
        head = F.array_join(F.slice(g, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
        return F.when(n == 1, F.get(g, F.lit(0))).when(n == 2, F.array_join(g, " and ")).otherwise(
            F.concat(head, F.lit(", and "), F.element_at(g, -1))
        )

    pretty = let(let(marked, groups), join)
    return F.when(lower_strip(text(c)) == "", "person").otherwise(pretty)


def person_ref(c) -> Column:
    return let(
        format_person(c),
        lambda p: F.when(p.isin("", "person"), "the person").otherwise(F.concat(F.lit("the person wearing "), p)),
    )


# --- confidence words (E1) -----------------------------------------------------------------------------------------

def conf_rank(c) -> Column:
    up = F.upper(col(c))
    return F.when(up == "HIGH", 2).when(up == "MEDIUM", 1).otherwise(0)


def teacher_valid(label, confidence, minimum: str = "MEDIUM") -> Column:
    return let(sanitize(label), lambda s: s.isNotNull() & ~is_generic(s)) & (
        conf_rank(confidence) >= CONFIDENCE_RANK.index(minimum)
    )


def mask_quality(area) -> Column:
    """1 inside the accepted area band, falling off outside; 0.5 without a mask."""
    r = col(area)
    low = F.least(F.lit(1.0), F.greatest(F.lit(0.0), r / max(MASK_MIN_AREA, 1e-6)))
    high = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(MASK_MAX_AREA) / F.greatest(r, F.lit(1e-6))))
    return (
        F.when(r.isNull(), 0.5).when((r >= MASK_MIN_AREA) & (r <= MASK_MAX_AREA), 1.0).when(r < MASK_MIN_AREA, low).otherwise(high)
    )
