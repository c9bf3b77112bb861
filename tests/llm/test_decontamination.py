from hookline.llm import decontamination as dc

ITEM = "Alice and Bob drove 120 km in 2 hours before Alice walked the last 3 km to the old harbour"


def hits(spark, scratch, texts, items=((1, ITEM),), **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {r.doc_id: (r.hits, r.item) for r in dc.with_hits(docs, bench, scratch, **settings).collect()}


def test_changed_numbers_names_and_units_are_caught(spark, scratch):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("120", "75").replace("2 hours", "9 minutes").replace(" 3 ", " 8 ")
    mixed = ITEM.replace("Alice walked", "Bob walked")
    got = hits(spark, scratch, [ITEM, "So " + ITEM.upper(), "He said: " + other + " Then rest.", mixed, "the last words to the old harbour", None, ""])
    assert got[0][0] > 0 and got[2] == (got[2][0], 1) and got[2][0] > 0
    assert got[4] == got[5] == got[6] == (0, None)
    assert got[3][0] < got[0][0]


def test_slots_map_one_to_one():
    assert dc.consistent(["<num>1", "", "<num>1"], ["<num>5", "", "<num>5"])
    assert not dc.consistent(["<num>1", "<num>1"], ["<num>5", "<num>6"])
    assert not dc.consistent(["<num>1", "<num>2"], ["<num>5", "<num>5"])
    assert not dc.consistent(["<num>1"], [""])


def test_short_items_and_blocks(spark, scratch):
    items = [(1, "one two three four five six"), (2, "too short"), (3, None), (4, ""), (None, ITEM), (9, ITEM)]
    texts = ["zero one two three four five six seven", "too short", ITEM, "nothing here at all"]
    whole = hits(spark, scratch, texts, items)
    assert whole[0] == (1, 1) and whole[1] == (0, None) and whole[2][1] == 9 and whole[3] == (0, None)
    assert hits(spark, scratch, texts, items, block=3) == whole


def plain(documents, items, width=10):
    """Documents that share ``width`` words in a row with an item, word for word."""
    cut = lambda t: [x for x in (p.strip(dc._EDGE).lower() for p in (t or "").split()) if x]
    grams = set()
    for t in items:
        w = cut(t)
        grams |= {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {d.doc_id for d in documents if any(tuple(w[i : i + width]) in grams for w in [cut(d.text)] for i in range(len(w) - width + 1))}


def test_documents(spark, scratch):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain(docs.collect(), [r.text for r in bench.collect()])
    found = {r.doc_id for r in dc.with_hits(docs, bench, scratch).where("hits > 0").collect()}
    assert want and want == found


def test_odd_rows_and_empty(spark, odd, documents, scratch):
    bench = spark.createDataFrame([("q1", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id string, text string")
    out = dc.with_hits(odd, bench, scratch)
    assert out.columns.count("hits") == 1 and out.count() == odd.count()
    assert [r.item for r in out.where("hits > 0").collect()] == ["q1"]
    renamed = dc.with_hits(odd, bench, scratch, names=("n", "first"))
    assert renamed.columns[: len(odd.columns)] == odd.columns
    assert dc.with_hits(documents.limit(0), bench, scratch).count() == 0
    assert dc.with_hits(odd, bench.limit(0), scratch).where("hits > 0").count() == 0


ALICE = "Alice has 5 apples. Bob gives her 3 more apples. Alice eats 2 of them. How many apples are left?"


def test_names_at_the_head_of_sentences(spark, scratch):
    other = ALICE.replace("Alice", "Carol").replace("Bob", "Dan").replace("5", "7")
    same_twice = ALICE.replace("Bob", "Alice")
    texts = [ALICE, other, other.replace(". ", ".\n"), "We know that " + other, other.upper(), ALICE.upper(), ALICE.lower(), other.lower(), same_twice]
    got = hits(spark, scratch, texts, [(1, ALICE)])
    assert all(got[k] == (11, 1) for k in range(8))
    assert got[8][0] < 11
    short = hits(spark, scratch, ["Carol gives Dan 8 apples", "who gives them 8 apples", "carol gives dan 8 apples"], [(1, "Alice gives Bob 3 apples")])
    assert [short[k][0] for k in range(3)] == [1, 0, 0]


def test_names_known_from_another_place_and_case(spark, scratch):
    items = [(1, "alice sold the red boat for 9 coins to someone there"), (2, "We saw that Alice and Carol met at the old harbour")]
    got = hits(spark, scratch, ["Zoe sold the red boat for 9 coins to someone there", "we saw that carol and alice met at the old harbour"], items)
    assert got == {0: (2, 1), 1: (2, 2)}


def test_in_is_a_unit_after_a_number_only(spark, scratch):
    items = [(1, "they live in the small town by the sea and 5 in of rain fell")]
    got = hits(spark, scratch, ["they live km the small town by the sea and", "town by the sea and 7 cm of rain fell"], items)
    assert got == {0: (0, None), 1: (1, 1)}


def test_spelled_numbers_are_numbers(spark, scratch):
    items = [(1, "if five hens lay 25 eggs in a day then how many eggs do they lay")]
    texts = [
        "if 5 hens lay twenty-five eggs in a day then how many eggs do they lay",
        "if seven hens lay 30 eggs in a day then how many eggs do they lay",
        "if one two three hens lay 25 eggs in a day then how many eggs",
    ]
    got = hits(spark, scratch, texts, items)
    assert got[0] == got[1] == (7, 1)
    assert got[2][0] == 2  # the windows from "hens" and from "lay" on


def test_short_items_are_whole_lines(spark, scratch):
    items = [(4, "Add 17 and 25"), (6, "Who was Ada?"), (7, "too short")]
    texts = ["Add 17 and 25", "First.\nadd 17 and 25.\nThen rest.", "so add 17 and 25", "add 17 and 26", "add\n17 and 25", "Who was Eve?", "who was ada", "too short"]
    got = hits(spark, scratch, texts, items)
    assert [got[k] for k in range(8)] == [(1, 4), (1, 4), (0, None), (0, None), (0, None), (0, None), (1, 6), (0, None)]


def test_lists_of_names_are_found_as_they_stand(spark, scratch):
    names = "Ada Bea Cia Dea Eva Fea Gia Hea Ida Jea"
    got = hits(spark, scratch, [f"by {names} and others", "by " + names.replace("Ida", "Zoe")], [(1, f"written by\n{names}")])
    assert got[0][0] > 0 and got[1][0] <= 1


def test_windows_against_every_window_of_every_text():
    """The lookup by anchors against a comparison of all windows with all places, word by word."""
    import random

    draw = random.Random(5)
    words = ["the", "red", "boat", "Anna", "Karl", "met", "7", "8", "km", "in", "two", "old"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    known = frozenset({"anna", "karl"})
    rows = []
    for k in range(60):
        digests, slots = dc.template(text(4), dc._FORMS, known)
        if sum(not s.startswith((dc._NAME, dc._HEAD)) for s in slots) < 2:
            slots = ["" if s.startswith((dc._NAME, dc._HEAD)) else s for s in slots]
        own = [0 if s.startswith(dc._NAME) else d for d, s in zip(digests, slots, strict=True)]
        own = [own[0], *own[1:], dc.template("hill", dc._FORMS)[0][0]]
        slots = [*slots, ""]
        rows.append({"hash": int(dc.window_hashes(dc.np.array(own, dc.np.uint64), 5)[0]), "width": 5, "item": k, "words": own, "slots": slots})
    windows = dc._Windows(rows, known)
    texts = [" ".join(text(4) + " hill" for _ in range(draw.randrange(1, 40))) for _ in range(200)]
    want = []
    for body in texts:
        forms = [dc._FORMS.form[dc._FORMS[p]] for p in body.split()]
        spelled = dc.counted([f[1] == dc._SPELLED for f in forms])
        digests = [dc._HASH["<num>"] if s else f[0] for f, s in zip(forms, spelled, strict=True)]
        for i in range(1, len(digests)):
            if forms[i][2] == "in" and forms[i][1] == dc._WORD and digests[i - 1] == dc._HASH["<num>"]:
                digests[i], forms[i] = dc._HASH["<unit>"], dc._FORMS.form[0]
        pairs = {(at, k) for at in range(len(digests) - 4) for k in range(60) if windows._fits(k, digests[at : at + 5], forms[at : at + 5])}
        want.append((len({at for at, _ in pairs}), min((k for _, k in pairs), default=None)))
    assert windows.hits(texts, dc._FORMS) == want and sum(n for n, _ in want) > 100
