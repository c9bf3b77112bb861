import uuid

import pytest

from hookline.session import Scratch

#: Texts that every operator must take: null, empty, blanks, controls, other scripts, one long word, a long text.
ODD = [
    None, "", " \t\n\x0b ", "one", "One ONE one", "\x01 mark \x02", "naïve ÄÖÜ straße \u00a0x 漢字 😀😀", "z" * 5000,
    " ".join(f"w{i % 97}" for i in range(6000)), "a\nb\nc", "one",
]


@pytest.fixture
def scratch(spark):
    own = Scratch(spark, "test-" + uuid.uuid4().hex[:6])
    yield own
    own.close()


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts under ids that repeat or are null, with columns named like results and helpers of the operators."""
    rows = [(None if i == 3 else i // 2 if i < 4 else i, t, None if i % 3 else "s", "en", i, "x", 1.5, 7, "k") for i, t in enumerate(ODD)]
    rows.append(rows[-1])
    schema = (
        "doc_id bigint, text string, source string, lang string, n_chars bigint, score string, size double, fp int, `key` string"
    )
    return spark.createDataFrame(rows, schema).selectExpr(
        "*", "1 AS hits", "2 AS predicted", "'v' AS print", "'g' AS given", "0 AS none", "'q' AS src", "3 AS u", "4 AS run", "'h' AS host"
    )
