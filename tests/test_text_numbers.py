"""Texts are cleaned once and move once on their way into the data set."""

from hookline.plans import text_corpus as C


def rows(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, text string, label int").repartition(3)


def test_no_text_is_sorted_for_its_number(spark, monkeypatch):
    sorted_columns, plain = [], C.sequence_id
    monkeypatch.setattr(C, "sequence_id", lambda df, *a: sorted_columns.append(df.columns) or plain(df, *a))
    a = rows(spark, [(2, "a", "Pay  now", 1), (1, "a", "hello", 0), (3, "a", " ", 0), (4, "a", "", 1), (5, "a", "x", 7)])
    b = rows(spark, [(1, "b", "pay now ", 0), (2, "b", "new", 1), (3, "b", "HELLO", 1)])
    out = C.build_text_dataset([a, b], "id")
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "a", "hello", 0), (2, "a", "Pay  now", 1), (3, "b", "new", 1)]
    assert len(sorted_columns) == 1 and "text" not in sorted_columns[0]


def test_rows_whose_key_repeats_or_is_missing_stay(spark):
    a = rows(spark, [(1, "a", "one", 0), (1, "a", "two", 1), (None, "a", "three", 0), (None, "a", "four", 1), (2, "a", "two", 0)])
    got = C.build_text_dataset([a], "id").collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4] and sorted(r.text for r in got) == ["four", "one", "three", "two"]
