"""Building blocks of the SQL twins. Written for DuckDB; its regexes are RE2, so character classes differ."""

from __future__ import annotations

from ..functions import labels, url_features
from . import views

WS = r"[\s\x0B\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_URL = r"\s\x0B\x{1c}-\x{1f}\x{85}\p{Z}"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '^{WS}+', ''), '{WS}+$', '')"


def norm(x: str) -> str:
    return clean(f"lower({x})")


def text_hash(x: str) -> str:
    return f"sha256({norm(x)})"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def spelled_label(x: str) -> str:
    w = f"lower({strip(x)})"
    return (
        f"CASE WHEN {w} IN ({_quoted(labels.PHISHING_SPELLINGS)}) THEN 1 "
        f"WHEN {w} IN ({_quoted(labels.LEGITIMATE_SPELLINGS)}) THEN 0 END"
    )


def tagged(sender: str, subject: str, body: str) -> str:
    def part(tag: str, x: str) -> str:
        return f"CASE WHEN {clean(x)} <> '' THEN '{tag}: ' || {clean(x)} END"

    return f"concat_ws(chr(10), {part('Sender', sender)}, {part('Subject', subject)}, {part('Body', body)})"


def subject_body(subject: str, body: str) -> str:
    return f"'Subject: ' || {clean(subject)} || chr(10) || 'Body: ' || {clean(body)}"


def message(subject: str, sender: str, body: str) -> str:
    return (
        f"'Subject: ' || coalesce({subject}, '') || chr(10) || 'From: ' || coalesce({sender}, '') || chr(10) || chr(10) "
        f"|| coalesce({body}, '')"
    )


def urls_in(x: str, mode: str = "live") -> str:
    stop = {"live": '<>"', "test": '<>"', "list": r"\],", "text": r"<>\[\]\"''"}[mode]
    trailing = {"live": ".,!?;:)]}", "test": ".,!?;:)]}", "list": ".,;:!?)]}''\"", "text": ".,;:!?)]}>"}[mode]
    flags = "" if mode in ("live", "test") else "(?i)"
    found = f"regexp_extract_all(coalesce({x}, ''), '{flags}https?://[^{NOT_URL}{stop}]+')"
    return f"list_transform({found}, lambda u: rtrim(u, '{trailing}'))"


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n"


CANON = (
    f"CASE WHEN {strip('url')} = '' THEN '' WHEN regexp_matches({strip('url')}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://') "
    f"THEN {strip('url')} ELSE 'http://' || {strip('url')} END"
)
DOMAIN = (
    "split_part(list_last(string_split(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)), '@')), ':', 1)"
)


def _n(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def _any(x: str, words: list[str]) -> str:
    return "CAST((" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ") AS BIGINT)"


_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_LEN = "greatest(length(u), 1)"
_HIDDEN = _n("u", r"%[0-9a-fA-F]{2}") + " + " + _n("u", "@") + " + " + _n("u", r"\\")
_LETTERS, _SPECIALS = _n("u", r"\p{L}"), _n("u", r"[^\p{L}\p{N}]")

# (name, expression over u = canonical URL, d = domain, w = lowered URL)
FEATURES = {
    "URLLength": "CAST(length(u) AS BIGINT)",
    "DomainLength": "CAST(length(d) AS BIGINT)",
    "IsDomainIP": f"CAST(regexp_full_match(d, '{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}') AS BIGINT)",
    "NoOfSubDomain": "CAST(greatest(len(list_filter(string_split(d, '.'), lambda x: x <> '')) - 2, 0) AS BIGINT)",
    "HasObfuscation": f"CAST(({_HIDDEN}) > 0 AS BIGINT)",
    "NoOfObfuscatedChar": f"({_HIDDEN})",
    "ObfuscationRatio": f"CAST(({_HIDDEN}) AS DOUBLE) / {_LEN}",
    "NoOfLettersInURL": _LETTERS,
    "LetterRatioInURL": f"CAST({_LETTERS} AS DOUBLE) / {_LEN}",
    "NoOfDegitsInURL": _n("u", r"\p{Nd}"),
    "NoOfEqualsInURL": _n("u", "="),
    "NoOfQMarkInURL": _n("u", "[?]"),
    "NoOfAmpersandInURL": _n("u", "&"),
    "NoOfOtherSpecialCharsInURL": _SPECIALS,
    "SpacialCharRatioInURL": f"CAST({_SPECIALS} AS DOUBLE) / {_LEN}",
    "IsHTTPS": "CAST(starts_with(w, 'https://') AS BIGINT)",
    "NoOfURLRedirect": f"greatest({_n('w', 'https?://')} - 1, 0)",
    "NoOfSelfRedirect": "CAST(0 AS BIGINT)",
    "HasExternalFormSubmit": "CAST(0 AS BIGINT)",
    "HasSocialNet": _any("d", url_features.SOCIAL_DOMAINS),
    "HasPasswordField": _any("w", url_features.PASSWORD_KEYWORDS),
    "Bank": _any("w", url_features.BANK_KEYWORDS),
    "Pay": _any("w", url_features.PAY_KEYWORDS),
    "Crypto": _any("w", url_features.CRYPTO_KEYWORDS),
    "NoOfExternalRef": "CAST(0 AS BIGINT)",
}
_RAW_HOST = "regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1)"
SIMPLE_FEATURES = {
    **FEATURES,
    "IsDomainIP": r"CAST(regexp_full_match(split_part(d, ':', 1), '\d{1,3}([.]\d{1,3}){3}') AS BIGINT)",
    "NoOfSubDomain": "CAST(greatest(len(string_split(d, '.')) - 2, 0) AS BIGINT)",
    "HasObfuscation": "CAST((contains(u, '@') OR contains(u, '%')) AS BIGINT)",
    "NoOfObfuscatedChar": _n("u", "%"),
    "ObfuscationRatio": f"CAST({_n('u', '%')} AS DOUBLE) / {_LEN}",
    "NoOfURLRedirect": f"{_n('u', 'http://')} + {_n('u', 'https://')} - 1",
    "HasSocialNet": _any("w", url_features.SIMPLE_SOCIAL),
    "HasPasswordField": _any("w", url_features.SIMPLE_PASSWORD),
    "Bank": _any("w", url_features.SIMPLE_BANK),
    "Pay": _any("w", url_features.SIMPLE_PAY),
    "Crypto": _any("w", url_features.SIMPLE_CRYPTO),
}


def feature_list(features: dict[str, str] = FEATURES) -> str:
    return ", ".join(f'{expr} AS "{name}"' for name, expr in features.items())


def ranked_split(source: str, scheme: str, key: str = "id") -> str:
    """Split by a global rank in hash order: the plain way to say what the split must be."""
    held, second, rest = {
        "80_10_10": ("0.2", "0.5", False), "70_15_15": ("0.3", "0.5", False), "70_10_20": ("0.2", "0.125", True)
    }[scheme]

    def deal(available: str, share: str, out: str, table: str) -> str:
        return f"""
        SELECT * EXCLUDE (kept, fl, rm), fl + CASE WHEN row_number() OVER (ORDER BY rm DESC, label) <=
               kept - sum(fl) OVER () THEN 1 ELSE 0 END AS {out}
        FROM (SELECT *, (kept * {available}) // sum({available}) OVER () AS fl,
                     (kept * {available}) % sum({available}) OVER () AS rm
              FROM (SELECT *, sum({available}) OVER () -
                     CAST(ceil(CAST({share} AS DOUBLE) * sum({available}) OVER ()) AS BIGINT) AS kept FROM {table}))"""

    step1 = deal("n", held, "kept1", "(SELECT label, count(*) AS n FROM src GROUP BY label)")
    if rest:
        cuts = f"SELECT label, cut1, kept1 AS cut2 FROM ({deal('kept1', second, 'cut1', f'({step1})')})"
    else:
        cuts = (
            f"SELECT label, kept1 AS cut1, kept1 + v AS cut2 FROM ("
            f"{deal('held', second, 'v', f'(SELECT *, n - kept1 AS held FROM ({step1}))')})"
        )
    return f"""
    SELECT r.* EXCLUDE (rn), CASE WHEN rn <= cut1 THEN 'train' WHEN rn <= cut2 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || {key})) AS rn FROM src) r
    JOIN ({cuts}) c ON r.label = c.label
    """.replace("src", source)


def grouped_split(groups: str, rows: str, key: str) -> str:
    """Group split of ``rows`` (with ``domain_group``, ``label``), placed group by group in a recursive query."""

    def folds(source: str, k: int) -> str:
        state = "[" + ", ".join(["0::HUGEINT"] * k) + "]"
        return f"""SELECT grp, n0, n1, n, CAST(fold AS BIGINT) AS fold FROM (
        WITH RECURSIVE g AS ({source}),
        tot AS (SELECT sum(n0)::HUGEINT AS t0, sum(n1)::HUGEINT AS t1, sum(n) AS tn FROM g),
        heavy AS (SELECT g.*, greatest(t1, 1) * greatest(t1, 1) AS w0, greatest(t0, 1) * greatest(t0, 1) AS w1,
            row_number() OVER (ORDER BY abs(n0 - n1) DESC, grp) AS rn FROM g, tot WHERE n * 100 > tn),
        place AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS grp, -1::BIGINT AS best, {state} AS h0, {state} AS h1
          UNION ALL
          SELECT rn, grp, best, list_transform(range({k}), lambda i: h0[i + 1] + CASE WHEN i = best THEN n0 ELSE 0 END),
            list_transform(range({k}), lambda i: h1[i + 1] + CASE WHEN i = best THEN n1 ELSE 0 END)
          FROM (SELECT h.rn, h.grp, h.n0, h.n1, p.h0, p.h1, (list_sort(list_transform(range({k}), lambda i:
                  {{'a': p.h0[i + 1] * h.n0 * h.w0 + p.h1[i + 1] * h.n1 * h.w1, 'b': p.h0[i + 1] + p.h1[i + 1], 'i': i}})))[1].i AS best
                FROM place p JOIN heavy h ON h.rn = p.rn + 1))
        SELECT heavy.grp, n0, n1, n, best AS fold FROM heavy JOIN place USING (grp)
        UNION ALL
        SELECT grp, n0, n1, n, (row_number() OVER (PARTITION BY n0, n1 ORDER BY sha256('42:' || grp), grp) - 1
          + list_sum(list_transform([1, 2, 3, 4], lambda d: (strpos('0123456789abcdef',
              substr(sha256('42:' || n0 || ':' || n1), d, 1)) - 1) * (16 ** (4 - d))::BIGINT))) % {k}
        FROM g, tot WHERE n * 100 <= tn)"""

    return f"""WITH {groups}, src AS ({rows}),
    counted AS (SELECT domain_group AS grp, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, count(*) AS n FROM src GROUP BY 1),
    outer_folds AS ({folds('SELECT * FROM counted', 5)}),
    inner_folds AS ({folds('SELECT grp, n0, n1, n FROM outer_folds WHERE fold = 0', 2)})
    SELECT src.{key}, domain_group, label, CASE WHEN o.fold <> 0 THEN 'train' WHEN i.fold = 0 THEN 'val' ELSE 'test' END AS split
    FROM src JOIN outer_folds o ON o.grp = domain_group LEFT JOIN inner_folds i ON i.grp = domain_group"""


CTES = {
    "urls": views.DUCK_URLS,
    "emails": views.DUCK_EMAILS,
    "list_mails": views.DUCK_LIST_MAILS,
    "short_texts": views.DUCK_SHORT_TEXTS,
    "copies": views.DUCK_COPIES,
    "prepared": (
        f"SELECT id, source, {clean('subject')} AS subject, {clean('sender')} AS sender, {clean('body')} AS body, "
        f"{clean('urls')} AS url, {tagged('sender', 'subject', 'body')} AS text, {spelled_label('label')} AS label "
        f"FROM emails WHERE {spelled_label('label')} IS NOT NULL"
    ),
    "listed": (
        "SELECT min(id) AS id, 'SpaPhish' AS source, text, label FROM (SELECT id, "
        + subject_body("subject", "body") + f" AS text, {spelled_label('class')} AS label FROM list_mails) "
        "WHERE label IS NOT NULL GROUP BY text, label"
    ),
    "shorts": (
        f"SELECT min(id) AS id, 'ShortText' AS source, text, label FROM (SELECT id, {clean('message')} AS text, "
        f"{spelled_label('target')} AS label FROM short_texts) WHERE label IS NOT NULL AND text <> '' GROUP BY text, label"
    ),
    "stacked": (
        f"SELECT 0 AS priority, id, source, {strip('text')} AS text, label FROM prepared UNION ALL "
        f"SELECT 1, id, source, {strip('text')}, label FROM listed UNION ALL "
        f"SELECT 2, id, source, {strip('text')}, label FROM shorts"
    ),
    "firsts": (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "
        + text_hash("text") + " ORDER BY priority, id) AS rn FROM stacked WHERE text <> '') WHERE rn = 1"
    ),
    "dataset": (
        "SELECT row_number() OVER (ORDER BY priority, id) AS id, source, text, label FROM firsts"
    ),
    "text_splits": ranked_split("dataset", "70_15_15"),
    "docs": "SELECT doc_id AS id, text, toxic AS label FROM documents JOIN labels USING (doc_id)",
    "doc_splits": ranked_split("docs", "70_15_15"),
    "canon": f"SELECT url_id, label, {CANON} AS u FROM urls",
    "parts": f"SELECT url_id, label, u, lower(u) AS w, {DOMAIN} AS d FROM canon",
    "features": f"SELECT url_id, {feature_list()}, label FROM parts",
    "url_splits": ranked_split("urls", "80_10_10", "url_id"),
    "scored": (
        "SELECT id, label, text_probability, url_probability, url_count, "
        "CAST(0.6 AS DOUBLE) * text_probability + CAST(0.4 AS DOUBLE) * url_probability AS risk FROM ("
        "SELECT id, label, CAST(length(body) % 1000 AS DOUBLE) / 999 AS text_probability, "
        "CAST(coalesce(list_max(list_transform(urls, lambda u: CAST(len(regexp_extract_all(u, '[^\\p{L}\\p{N}]')) AS DOUBLE) / "
        "greatest(length(u), 1))), 0) AS DOUBLE) AS url_probability, CAST(len(urls) AS BIGINT) AS url_count FROM ("
        f"SELECT id, body, {spelled_label('label')} AS label, {urls_in(message('subject', 'sender', 'body'))} AS urls FROM emails))"
    ),
    "judged": "SELECT label, risk AS score, CASE WHEN risk >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scored WHERE label IS NOT NULL",
}
DATASET = ("emails", "list_mails", "short_texts", "prepared", "listed", "shorts", "stacked", "firsts", "dataset")
