"""Finding URLs in text, and the parts of a URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, strip_text, text_or_empty


@dataclass(frozen=True)
class ExtractionRule:
    """Characters that end a URL besides whitespace, characters cut off its end, and how matches are kept."""

    stop: str
    trailing: str
    any_case: bool
    distinct: bool

    @property
    def pattern(self) -> str:
        flags = "(?iu)" if self.any_case else ""
        return rf"{flags}https?://[^{WS_CLASS}{self.stop}]+"


# The four ways URLs are read from a column.
EXTRACTION_RULES = {
    "live": ExtractionRule(stop=r'<>"', trailing=".,!?;:)]}", any_case=False, distinct=False),
    "list": ExtractionRule(stop=r"\],", trailing=".,;:!?)]}'\"", any_case=True, distinct=True),
    "text": ExtractionRule(stop=r"<>\[\]\"'", trailing=".,;:!?)]}>", any_case=True, distinct=True),
    "test": ExtractionRule(stop=r'<>"', trailing=".,!?;:)]}", any_case=False, distinct=False),
}


def extract_urls(c: Column, mode: str = "live") -> Column:
    """URLs of a text in order of appearance; null text gives an empty array.

    ``live``: message text, repeats kept. ``list``: column that holds a list literal. ``text``: message text,
    first of each URL. ``test``: like ``live``.
    """
    rule = EXTRACTION_RULES[mode]
    found = F.regexp_extract_all(text_or_empty(c), F.lit(rule.pattern), F.lit(0))
    cut = F.transform(found, lambda u: F.rtrim(u, F.lit(rule.trailing)))
    if not rule.distinct:
        return cut
    return F.array_distinct(F.filter(cut, lambda u: u != ""))


# Fixed value: what counts as a scheme.
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


def canonical_url(c: Column) -> Column:
    """Stripped, with ``http://`` in front when there is no scheme; empty stays empty."""
    stripped = strip_text(c)
    return (
        F.when(stripped == "", stripped)
        .when(stripped.rlike(SCHEME), stripped)
        .otherwise(F.concat(F.lit("http://"), stripped))
    )


def url_authority(canonical: Column) -> Column:
    """What stands between the scheme and the path, query or fragment. URL parsing ignores tabs and newlines."""
    return F.regexp_extract(F.translate(canonical, "\t\r\n", ""), SCHEME + "([^/?#]*)", 1)


def url_domain(canonical: Column) -> Column:
    """Host: lower case, without user and port. Never fails, also not on a broken IPv6 host."""
    host = F.substring_index(F.lower(url_authority(canonical)), "@", -1)
    return F.substring_index(host, ":", 1)
