import hashlib

from hookline.llm import lz_fingerprint as lz


def phrases(text):
    found, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in found:
            found.add(text[start:end])
            start = end
    return found


def plain_edit(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def check(df):
    rows = sorted(
        ((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()),
        key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()),
    )
    want = []
    for i, (name, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = plain_edit(text, following)
        own, other = lz.fingerprint(text), lz.fingerprint(changed)
        want.append((name, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, lz.likeness(own, other), lz.likeness(own, lz.fingerprint(following))))
    for runs in (1, 3, 7):
        got = lz.fingerprints(df, runs=runs)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_documents(documents):
    check(documents)


def test_odd_rows(odd):
    check(odd)


def test_one_row_and_none(documents):
    check(documents.limit(1))
    assert lz.fingerprints(documents.limit(0)).count() == 0


def test_likeness_follows_shared_phrases(documents):
    texts = [r.text for r in documents.limit(60).collect()]
    off = []
    for a, b in zip(texts, texts[1:], strict=False):
        changed = plain_edit(a, b)
        p, q = phrases(a), phrases(changed)
        off.append(abs(lz.likeness(lz.fingerprint(a), lz.fingerprint(changed)) - len(p & q) / max(1, len(p | q))))
    assert sum(off) / len(off) < 0.04 and max(off) < 0.2


def test_phrases_are_those_of_the_incremental_parse():
    text = "abababab abc abcabc ñandú 😀😀😀 " * 9
    ends, trie = [], {}
    lz._extend(lz._codes(text).tolist(), trie, 0, ends, 0)
    assert {text[a:b] for a, b in zip([0, *ends], ends, strict=False)} == {p for p in phrases(text) if not text.endswith(p) or p in {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}}
    assert len(trie) == len(ends)


def test_bounds():
    assert lz.likeness(lz.fingerprint(""), lz.fingerprint(None)) == 1.0
    assert lz.likeness(lz.fingerprint(""), lz.fingerprint("abc")) == 0.0
    assert lz.fingerprint("x" * 999) == lz.fingerprint("x" * 999)
