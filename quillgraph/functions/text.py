"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_CHARS = 400
#: ASCII white space as Java's \\s has it.
SPACES = " \t\n\x0b\f\r"
#: White space at either end, for engines whose trim takes spaces only. A scan: within long texts stripped() takes a fraction of its time.
EDGES = r"^\s+|\s+$"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body's lambdas use it for each of many elements."""
    return F.transform(F.array(value), body)[0]


def stripped(t: Column) -> Column:
    """Without ASCII white space at either end; only the ends are read."""
    return F.btrim(t, F.lit(SPACES))


def sanitize(t: Column) -> Column:
    """Without control characters but tab and newline, trimmed; an empty text is null."""
    return F.nullif(stripped(F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F]", "")), F.lit(""))


def trimmed(t: Column) -> Column:
    """Without ASCII white space at either end, as RE2's \\s has it: a vertical tab is none, and nothing within the text or beyond ASCII goes."""
    return F.btrim(t, F.lit(" \t\n\f\r"))


def collapse(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^ | $", "")


def snippet(t: Column, limit: int = SNIPPET_CHARS) -> Column:
    flat = collapse(t)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("…")))


def normalized(t: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def tokens(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)))


def overlap_share(query: Column, t: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for an empty query."""
    q = tokens(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(t))) / F.size(q))


def plain_number(v: Column) -> Column:
    """Four decimals at most, without trailing zeros."""
    fixed = F.format_string("%.4f", v)
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def number_spellings(v: Column) -> Column:
    """The ways a number may stand in a text: plain, with a decimal comma, with a percent sign."""
    p = plain_number(v)
    comma = F.replace(p, F.lit("."), F.lit(","))
    return F.array_distinct(F.array(p, comma, F.concat(p, F.lit("%")), F.concat(p, F.lit(" %")), F.concat(comma, F.lit("%"))))


def stands_in(v: Column, text: Column) -> Column:
    """Whether a number stands in a text, also with its white space taken out."""
    tight = F.regexp_replace(text, r"\s+", "")
    return F.exists(number_spellings(v), lambda a: F.contains(text, a) | F.contains(tight, F.replace(a, F.lit(" "), F.lit(""))))


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def confidence(v: Column) -> Column:
    """Missing confidence counts as 0.6."""
    return clamp(F.coalesce(v.try_cast("double"), F.lit(0.6)))


def split_of(t: Column) -> Column:
    low = F.lower(t)
    return F.when(F.contains(low, F.lit("test")), "test").when(F.contains(low, F.lit("dev")) | F.contains(low, F.lit("valid")), "validation").when(F.contains(low, F.lit("train")), "train")


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID of version 5, from SHA-1."""

    def spelled(h: Column) -> Column:
        s = lambda a, n: F.substring(h, a, n)
        variant = F.translate(s(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-5"), s(14, 3), F.lit("-"), variant, s(18, 3), F.lit("-"), s(21, 12))

    # the digest and what it is taken of once, not for each of its parts
    return let(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary"))), spelled)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; 0 for a zero vector or NaN, within [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = dot(a, b) / F.nullif(norm, F.lit(0.0))
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(clamp(value, -1.0, 1.0))


def clean_aliases(a: Column) -> Column:
    """Trimmed, without blanks, repeats dropped in order."""
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))


def mention_features(t: Column) -> tuple[Column, Column, Column]:
    """Acronym flag, digit flag and share of capitals."""
    caps = F.regexp_count(t, F.lit("[A-Z]"))
    return t.rlike("^[A-Z][A-Z0-9-]+$"), t.rlike("[0-9]"), caps / F.greatest(F.length(t), F.lit(1))
