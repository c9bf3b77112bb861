"""CSV files cut into blocks of some bytes give the rows that one task reads."""

import csv
import io
import random

import pytest

from hookline.sources import readers

AWKWARD = (
    'id,text,label\n1,"one\ntwo",0\n2,"say ""hi"", then\n\n""go""",1\n3,plain "quoted" word,0\n4,"",1\n\n5,"\n",0\n'
    '6,"a,b\nc,d\n""\n",1\n7,"closed" and more,0\n8,,1\n9,"""",0\n10,"x""\n""y",1\n11,café "ü,0\n12,"last\nline",1'
)


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "23")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def rows(tables):
    out = []
    for table in tables:
        names = [c for c in table.columns if c != "_malformed"]
        out += [tuple(r) for r in table.select(*names, (table["_malformed"].isNotNull()).alias("bad")).collect()]
    return sorted(out, key=repr)


def both(spark, paths):
    whole = rows(readers.by_header(spark, paths, large=1 << 40))
    return whole, rows(readers.by_header(spark, paths, large=0))


def test_awkward_quoting(spark, tmp_path, small_blocks):
    (tmp_path / "awkward.csv").write_bytes(AWKWARD.encode())
    whole, cut = both(spark, [str(tmp_path / "awkward.csv")])
    assert cut == whole and len(cut) == 12
    assert ("1", "one\ntwo", "0", "awkward", False) in cut
    blocks = spark.read.text(str(tmp_path / "awkward.csv"), lineSep="\n").rdd.getNumPartitions()
    assert blocks > 1


def test_random_fields(spark, tmp_path, small_blocks):
    """Fields drawn from quotes, commas and line breaks, in several files of one header, some ended by CRLF."""
    draw, paths, want = random.Random(5), [], []
    for number, end in enumerate(["\n", "\r\n", "\n"]):
        made = [(str(i), "".join(draw.choice('ab",\n') for _ in range(draw.randrange(1, 25))), "1") for i in range(40)]
        out = io.StringIO()
        csv.writer(out, lineterminator=end).writerows([("id", "text", "label"), *made])
        path = tmp_path / f"part{number}.csv"
        path.write_bytes(out.getvalue().encode())
        paths.append(str(path))
        want += [(*r, f"part{number}", False) for r in made]
    whole, cut = both(spark, paths)
    assert cut == sorted(want, key=repr) and whole == cut


def test_a_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f'word {i} "" ,' for i in range(60))
    (tmp_path / "long.csv").write_text(f'id,text,label\n1,"{long}",0\n2,b,1\n3,"{long}",1\n')
    whole, cut = both(spark, [str(tmp_path / "long.csv")])
    assert cut == whole and [r[0] for r in cut] == ["1", "2", "3"] and len(cut[0][1]) > 500


def test_malformed_empty_and_header_only(spark, tmp_path, small_blocks):
    for name, text in {
        "few": "id,text,label\n1,a\n2,b,1\n", "many": 'id,text,label\n1,"a\nb",0,x\n', "bare": "id,text,label\n",
        "unended": 'id,text,label\n1,a,0\n2,"open\nto the end', "split": 'id,"te\nxt",label\n1,a,0\n',
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    for name, n in {"few": 2, "many": 1, "bare": 0}.items():
        whole, cut = both(spark, [str(tmp_path / f"{name}.csv")])
        assert cut == whole and len(cut) == n, name
    cut = rows(readers.by_header(spark, [str(tmp_path / "unended.csv")], large=0))
    assert [r[0] for r in cut] == ["1", "2"] and cut[1][-1]
    assert readers.by_header(spark, [str(tmp_path / "absent.csv")], large=0) == []
