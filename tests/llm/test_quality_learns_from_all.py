"""The ranker of quality learns from every labelled row outside the held-out fold."""

from hookline.llm import pairwise_quality as P
from hookline.llm.labelled import fold_is


def test_cut_is_the_quantile_of_all_labelled_rows(spark, scratch):
    n = 16_000  # beyond the 6,000 rows of a label that were drawn once
    x = [f"double(pmod(xxhash64(id, {i}), 1000)) / 1000" for i in range(len(P.FEATURES))]
    rows = spark.range(n).selectExpr("id", f"array({', '.join(x)}) AS x").repartition(4)
    labels = rows.selectExpr("id AS doc_id", "int(x[0] > 0.2) AS quality")
    ranker = P.fit_ranker(rows, labels.withColumnRenamed("doc_id", "id"), scratch, "id", "x")
    known = rows.where(~fold_is("id", 4, 2))
    above = known.where(ranker.value() > ranker.cut).count()
    wanted = known.where("x[0] > 0.2").count()
    assert wanted > 9000 and above == wanted
