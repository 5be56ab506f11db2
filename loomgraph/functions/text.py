"""Text expressions: terms, hashes, filters and path priors. All are built-in expressions without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "[a-z0-9]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), F.lit(1))


def body_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text with runs of white space made one space."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+", " ")).cast("binary"), 256), 1, 16)


def long_line_bytes(text: Column, limit: int) -> Column:
    return F.aggregate(F.split(text, "\n"), F.lit(0).cast("long"), lambda n, line: n + F.when(F.octet_length(line) > limit, F.octet_length(line)).otherwise(0))


def minified(text: Column, limit: int = 5000, share: float = 0.7) -> Column:
    """At least `share` of the bytes are on lines of more than `limit` bytes."""
    return (F.octet_length(text) > 0) & (long_line_bytes(text, limit) >= share * F.octet_length(text))


def has_nul(text: Column) -> Column:
    return F.instr(text, "\x00") > 0


def bm25(tf: Column, df: Column, length: Column, docs: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def path_prior(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.rlike("(^|/)src/"), 0.5).otherwise(0.0)
        + F.when(p.rlike("(^|/)(tests?|spec)(/|$)"), -12.0).otherwise(0.0)
        + F.when(p.rlike("(^|/)docs?(/|$)"), -6.0).otherwise(0.0)
        + F.when(p.rlike("(^|/)(vendor|third_party|node_modules)(/|$)"), -5.0).otherwise(0.0)
    )


def name_score(name: Column, query: str, weight: float = 1.0) -> Column:
    """+14 for equal names without separators, 6w for an equal name, 3w for containment."""
    compact = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    asked = query.lower()
    squeezed = "".join(c for c in asked if c.isascii() and c.isalnum())
    return (
        F.when(compact == squeezed, 14.0).otherwise(0.0)
        + F.when(F.lower(name) == asked, 6.0 * weight).when(F.contains(F.lower(name), F.lit(asked)), 3.0 * weight).otherwise(0.0)
    )


def sparse_terms(text: Column) -> Column:
    """Lower-cased runs of letters or of digits, cut also where small letters meet capitals and before the last of several capitals."""
    words = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1)), " ")
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        words = F.regexp_replace(words, pattern, "$1 $2")
    return F.filter(F.split(F.lower(words), " "), lambda x: x != "")


def scaled(value: Column, total: Column, observed: Column) -> Column:
    """A count of a partial scan carried over to the whole: ceil(value * total / observed)."""
    return F.when((observed == 0) | (value == 0), value).otherwise(F.ceil(value.cast("double") * total / observed)).cast("long")
