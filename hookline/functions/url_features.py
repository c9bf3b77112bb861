"""The 25 lexical features of a URL, as plain expressions inside one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_or_empty
from .urls import canonical_url, url_domain

# Feature names in model order.
URL_FEATURES = [
    "URLLength", "DomainLength", "IsDomainIP", "NoOfSubDomain", "HasObfuscation",
    "NoOfObfuscatedChar", "ObfuscationRatio", "NoOfLettersInURL", "LetterRatioInURL", "NoOfDegitsInURL",
    "NoOfEqualsInURL", "NoOfQMarkInURL", "NoOfAmpersandInURL", "NoOfOtherSpecialCharsInURL",
    "SpacialCharRatioInURL", "IsHTTPS", "NoOfURLRedirect", "NoOfSelfRedirect", "HasExternalFormSubmit",
    "HasSocialNet", "HasPasswordField", "Bank", "Pay", "Crypto", "NoOfExternalRef",
]
RATIO_FEATURES = {"ObfuscationRatio", "LetterRatioInURL", "SpacialCharRatioInURL"}

# Names and keywords looked for.
SOCIAL_DOMAINS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com",
    "youtube.com", "tiktok.com", "reddit.com", "pinterest.com",
]
PASSWORD_KEYWORDS = ["password", "passwd", "pwd"]
BANK_KEYWORDS = ["bank", "banking", "netbanking", "onlinebank"]
PAY_KEYWORDS = ["pay", "payment", "paypal", "checkout", "billing", "invoice"]
CRYPTO_KEYWORDS = ["crypto", "bitcoin", "ethereum", "wallet", "usdt", "blockchain"]

# The shorter lists of the simplified feature set.
SIMPLE_SOCIAL = ["facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok"]
SIMPLE_PASSWORD = ["password"]
SIMPLE_BANK = ["bank"]
SIMPLE_PAY = ["pay", "payment", "paypal"]
SIMPLE_CRYPTO = ["crypto", "bitcoin", "wallet"]

# Digits outside the decimal-number category (superscripts, circled digits and the like).
OTHER_DIGITS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)

# A number from 0 to 255, and four of them.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def _count(c: Column, token: str) -> Column:
    """Non-overlapping occurrences of a fixed token."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token))


def _count_class(c: Column, other: str) -> Column:
    """Characters left once those matching ``other`` are removed."""
    return F.length(F.regexp_replace(c, other, "")).cast("bigint")


def _flag(condition: Column) -> Column:
    return condition.cast("bigint")


def _contains_any(c: Column, words: list[str]) -> Column:
    return _flag(reduce(lambda a, b: a | b, [c.contains(w) for w in words]))


def _letters(url: Column) -> Column:
    return _count_class(url, r"[^\p{L}]+")


def _digits(url: Column) -> Column:
    return _count_class(url, rf"[^\p{{Nd}}{OTHER_DIGITS}]+")


def _specials(url: Column) -> Column:
    return _count_class(url, r"[\p{L}\p{N}]+")


def _standard(url: Column, lowered: Column, domain: Column) -> dict[str, Column]:
    length = F.length(url).cast("bigint")
    at_least_one = F.greatest(length, F.lit(1))
    hidden = F.regexp_count(url, F.lit(r"%[0-9a-fA-F]{2}|[@\\]")).cast("bigint")
    labels = F.regexp_count(domain, F.lit(r"[^.]+"))
    schemes = _count(lowered, "http://") + _count(lowered, "https://")
    return {
        "URLLength": length,
        "DomainLength": F.length(domain),
        "IsDomainIP": _flag(domain.rlike(IPV4)),
        "NoOfSubDomain": F.greatest(labels - 2, F.lit(0)),
        "HasObfuscation": _flag(hidden > 0),
        "NoOfObfuscatedChar": hidden,
        "ObfuscationRatio": hidden / at_least_one,
        "NoOfLettersInURL": _letters(url),
        "LetterRatioInURL": _letters(url) / at_least_one,
        "NoOfDegitsInURL": _digits(url),
        "NoOfEqualsInURL": _count(url, "="),
        "NoOfQMarkInURL": _count(url, "?"),
        "NoOfAmpersandInURL": _count(url, "&"),
        "NoOfOtherSpecialCharsInURL": _specials(url),
        "SpacialCharRatioInURL": _specials(url) / at_least_one,
        "IsHTTPS": _flag(lowered.startswith("https://")),
        "NoOfURLRedirect": F.greatest(schemes - 1, F.lit(0)),
        "NoOfSelfRedirect": F.lit(0),
        "HasExternalFormSubmit": F.lit(0),
        "HasSocialNet": _contains_any(domain, SOCIAL_DOMAINS),
        "HasPasswordField": _contains_any(lowered, PASSWORD_KEYWORDS),
        "Bank": _contains_any(lowered, BANK_KEYWORDS),
        "Pay": _contains_any(lowered, PAY_KEYWORDS),
        "Crypto": _contains_any(lowered, CRYPTO_KEYWORDS),
        "NoOfExternalRef": F.lit(0),
    }


def _simplified(url: Column, lowered: Column, authority: Column) -> dict[str, Column]:
    length = F.length(url).cast("bigint")
    at_least_one = F.greatest(length, F.lit(1))
    percent = _count(url, "%")
    host = F.substring_index(authority, ":", 1)
    return {
        "URLLength": length,
        "DomainLength": F.length(authority),
        "IsDomainIP": _flag(host.rlike(r"\A\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}\z")),
        "NoOfSubDomain": F.greatest(_count(authority, ".") - 1, F.lit(0)),
        "HasObfuscation": _flag(url.contains("@") | url.contains("%")),
        "NoOfObfuscatedChar": percent,
        "ObfuscationRatio": percent / at_least_one,
        "NoOfLettersInURL": _letters(url),
        "LetterRatioInURL": _letters(url) / at_least_one,
        "NoOfDegitsInURL": _digits(url),
        "NoOfEqualsInURL": _count(url, "="),
        "NoOfQMarkInURL": _count(url, "?"),
        "NoOfAmpersandInURL": _count(url, "&"),
        "NoOfOtherSpecialCharsInURL": _specials(url),
        "SpacialCharRatioInURL": _specials(url) / at_least_one,
        "IsHTTPS": _flag(lowered.startswith("https://")),
        "NoOfURLRedirect": _count(url, "http://") + _count(url, "https://") - 1,
        "NoOfSelfRedirect": F.lit(0),
        "HasExternalFormSubmit": F.lit(0),
        "HasSocialNet": _contains_any(lowered, SIMPLE_SOCIAL),
        "HasPasswordField": _contains_any(lowered, SIMPLE_PASSWORD),
        "Bank": _contains_any(lowered, SIMPLE_BANK),
        "Pay": _contains_any(lowered, SIMPLE_PAY),
        "Crypto": _contains_any(lowered, SIMPLE_CRYPTO),
        "NoOfExternalRef": F.lit(0),
    }


def _typed(name: str, value: Column) -> Column:
    return value.cast("double" if name in RATIO_FEATURES else "bigint")


def with_url_features(df: DataFrame, url: str = "url", simplified: bool = False) -> DataFrame:
    """``df`` plus the 25 feature columns, one narrow projection, no shuffle.

    An empty URL has all features 0. ``simplified`` selects the cruder definitions of the same 25 names: no
    scheme is added, the port stays in the domain, fewer words are looked for, redirects may be -1.
    """
    if simplified:
        step = df.withColumn("_url", text_or_empty(F.col(url)))
        host = F.regexp_extract("_url", r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    else:
        step = df.withColumn("_url", canonical_url(F.col(url)))
        host = url_domain(F.col("_url"))
    step = step.withColumns({"_host": host, "_lowered": F.lower("_url")})
    build = _simplified if simplified else _standard
    features = build(F.col("_url"), F.col("_lowered"), F.col("_host"))
    out = {name: _typed(name, features[name]) for name in URL_FEATURES}
    return step.withColumns(out).drop("_url", "_host", "_lowered")
