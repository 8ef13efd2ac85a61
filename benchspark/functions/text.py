"""Text helpers shared by every family.

``WS`` is the white space that Python's ``str.strip`` and ``str.split`` see; Java's ``\\s`` is narrower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CHARS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CHARS}]"
# The same characters one by one, for trimming.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c) -> Column:
    """NULL as the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def lower_strip(c) -> Column:
    return F.lower(strip(c))


def words(c) -> Column:
    """Split at white space; the empty text gives an empty array.

    White space is made plain first: that pattern is compiled once, and a split at one space needs none.
    """
    return F.array_remove(F.split(F.regexp_replace(col(c), f"{WS}+", " "), " "), "")


def first_word(c) -> Column:
    """First word of a stripped text, without splitting the rest; NULL for the empty text."""
    return F.nullif(F.regexp_extract(col(c), f"^[^{WS_CHARS}]+", 0), F.lit(""))


def last_word(c) -> Column:
    """Last word of a stripped text, found from its end."""
    return F.nullif(F.reverse(F.regexp_extract(F.reverse(col(c)), f"^[^{WS_CHARS}]+", 0)), F.lit(""))


def more_words_than(c, n: int) -> Column:
    """Whether a stripped text has more than ``n`` words; looks no further than the next word."""
    return col(c).rlike(f"^(?:[^{WS_CHARS}]+{WS}+){{{n}}}[^{WS_CHARS}]")


def norm_space(c) -> Column:
    """Trim and collapse white space (G1)."""
    return F.trim(F.regexp_replace(text(c), f"{WS}+", " "))


def norm_lower(c) -> Column:
    return F.lower(norm_space(c))


def base_name(c) -> Column:
    """Last part of a slash-separated path."""
    return F.regexp_extract(col(c), r"([^/]*)/*$", 1)


def stable_id(*parts) -> Column:
    """First 12 hex digits of the MD5 of the parts joined by ``|``."""
    return F.substring(F.md5(F.concat_ws("|", *[text(p) for p in parts])), 1, 12)


def portable_hash(*parts) -> Column:
    """60 bits of the MD5 of the parts joined by ``|``: a number that any engine with an MD5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[text(p) for p in parts])), 1, 15), 16, 10).cast("bigint")


def portable_hash_sql(*parts: str) -> str:
    """The same number as SQL text, for the oracle queries."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def in_words(c, values) -> Column:
    """Membership in a fixed word list."""
    return col(c).isin(*sorted(values))


def any_word(arr: Column, values) -> Column:
    return F.arrays_overlap(arr, F.array(*[F.lit(v) for v in sorted(values)]))


def re_any(values) -> str:
    """Alternation of literal words for a regular expression."""
    return "|".join(sorted(values, key=lambda v: (-len(v), v)))


def half_even(c, digits: int) -> Column:
    """Round the binary value half to even, as Python's ``round`` does.

    ``bround`` rounds the shortest decimal text, so it takes 0.17605 for a tie although the stored number lies
    beside it. Where the scaled value looks like a tie, the exact product (split into two halves) decides.
    """
    scale = F.lit(float(10**digits))

    def rounded(x):
        scaled = x * scale
        low = F.floor(scaled)
        rest = scaled - low
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        error = (high * scale - scaled) + (x - high) * scale
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
        return (low + F.when(up, 1).otherwise(0)).cast("double") / scale

    return let(col(c), rounded)


def half_even_sql(x: str, digits: int) -> str:
    """The same rule as SQL text, for the oracle queries."""
    s = f"{10**digits}.0::DOUBLE"
    high = f"(134217729.0::DOUBLE * ({x}) - (134217729.0::DOUBLE * ({x}) - ({x})))"
    error = f"(({high} * {s} - ({x}) * {s}) + (({x}) - {high}) * {s})"
    return (
        f"CASE WHEN ({x}) * {s} - floor(({x}) * {s}) = 0.5 AND {error} <> 0 "
        f"THEN (floor(({x}) * {s}) + CASE WHEN {error} > 0 THEN 1 ELSE 0 END) / {s} ELSE round_even({x}, {digits}) END"
    )


def accuracy(correct, total) -> Column:
    """Share to four places; 0.0 for an empty denominator."""
    c, t = col(correct), col(total)
    return F.when(t > 0, half_even(c / t, 4)).otherwise(F.lit(0.0))
