"""Text columns: cleaning, composing, hashing, measuring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode text splitting treats as whitespace, as a string for trim() and as the
# body of a regex class. Java's \s is ASCII only and lacks U+001C to U+001F. Single characters and one category
# test run twice as fast in Java as a chain of ranges.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\p{Z}"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_text(c: Column) -> Column:
    """Null becomes empty; whitespace at both ends goes."""
    return F.btrim(text_or_empty(c), F.lit(WS_CHARS))


def clean_text(c: Column) -> Column:
    """Null becomes empty; each whitespace run becomes one blank; both ends are stripped."""
    return F.trim(F.regexp_replace(text_or_empty(c), f"[{WS_CLASS}]++", " "))


def normalize_text(c: Column) -> Column:
    """Key under which two messages count as copies: lower case, blanks collapsed."""
    return clean_text(F.lower(text_or_empty(c)))


def text_hash(c: Column) -> Column:
    """SHA-256 (hex) of the normalised text."""
    return F.sha2(normalize_text(c), 256)


def text_length(c: Column) -> Column:
    """Length in code points, null counts as 0."""
    return F.length(text_or_empty(c)).cast("bigint")


def has_text(c: Column) -> Column:
    return F.length(strip_text(c)) > 0


def tagged_text(sender: Column, subject: Column, body: Column) -> Column:
    """``Sender: …`` / ``Subject: …`` / ``Body: …`` on lines of their own, empty parts left out. Takes cleaned
    parts."""

    def part(tag: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(tag + ": "), value))

    return F.concat_ws("\n", part("Sender", sender), part("Subject", subject), part("Body", body))


def subject_body_text(subject: Column, body: Column) -> Column:
    """``Subject: …`` and ``Body: …``, both always present. Takes cleaned parts."""
    return F.concat(F.lit("Subject: "), subject, F.lit("\nBody: "), body)


def message_text(subject: Column, sender: Column, body: Column) -> Column:
    """Message as scored: subject line, from line, blank line, body. Parts are not cleaned."""
    return F.concat(
        F.lit("Subject: "), text_or_empty(subject),
        F.lit("\nFrom: "), text_or_empty(sender),
        F.lit("\n\n"), text_or_empty(body),
    )


def word_tokens(c: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(clean_text(c), " "), lambda w: w != "")


def truncate_tokens(c: Column, limit: int = 256) -> Column:
    """The first ``limit`` words, joined by blanks: what a model with a bounded input length sees."""
    return F.array_join(F.slice(word_tokens(c), 1, limit), " ")


def numeric_or_zero(c: Column) -> Column:
    """Number in the text; what is not a number becomes 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    """Infinite, undefined and missing values become 0."""
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)
