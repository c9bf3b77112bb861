"""Character n-gram TF-IDF of URLs in long form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, text_or_empty
from ..session import materialize
from .ordered import sequence_id

# Settings of the vectoriser.
NGRAM_RANGE = (3, 5)
MIN_DOCUMENTS = 3
MAX_FEATURES = 100_000
_STEPS = 64  # counts are first told apart by this part of their binary logarithm


def ngram_text(c: Column) -> Column:
    """The text n-grams are taken from: lower case, runs of whitespace as one blank."""
    return F.regexp_replace(F.lower(text_or_empty(c)), f"[{WS_CLASS}]{{2,}}", " ")


def char_ngrams(text: Column, ngram_range: tuple[int, int] = NGRAM_RANGE) -> Column:
    """All character n-grams of a column, with repeats. Pass a plain column: it is read once for every n-gram."""
    length = F.length(text)

    def of_size(n: int) -> Column:
        starts = F.when(length >= n, F.sequence(F.lit(1), length - (n - 1)))
        grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
        return F.coalesce(grams, F.array().cast("array<string>"))

    return F.flatten(F.array(*[of_size(n) for n in range(ngram_range[0], ngram_range[1] + 1)]))


def gram_counts(df: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = NGRAM_RANGE) -> DataFrame:
    """(key, gram, tf). A text without n-grams keeps one row with a null gram.

    The short texts are distributed by key once; their many n-grams are then counted where they are, since
    grouping by (key, gram) needs nothing more than a distribution by key. The number of tasks is given, or the
    short texts would be packed into few tasks although each grows a hundredfold.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(F.col(key), ngram_text(F.col(text)).alias("_text")).repartition(tasks, key)
    grams = placed.select(key, F.explode_outer(char_ngrams(F.col("_text"), ngram_range)).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("gram").alias("tf"))


@dataclass
class TfidfModel:
    """Vocabulary table (gram, idx, tf, df, idf) with ``n_documents`` and ``size`` as plain numbers."""

    vocabulary: DataFrame
    n_documents: int
    size: int
    ngram_range: tuple[int, int] = NGRAM_RANGE

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, indices, weights) per text: sublinear tf times idf, scaled to length 1, indices ascending.

        A text without known n-grams has empty arrays. Everything after the one distribution by key stays
        in place: counting, the vocabulary lookup, gathering a text's own n-grams, and the norm.
        """
        counts = gram_counts(df, key, text, self.ngram_range)
        known = self.vocabulary.select("gram", "idx", "idf")  # a written table: the optimiser knows its size
        weighted = counts.join(known, "gram", "left").select(
            key,
            F.when(
                F.col("idx").isNotNull(),
                F.struct("idx", ((F.ln("tf") + 1.0) * F.col("idf")).alias("w")),
            ).alias("cell"),
        )
        rows = weighted.groupBy(key).agg(
            F.array_sort(F.collect_list("cell")).alias("cells"),
            F.sqrt(F.sum(F.col("cell.w") * F.col("cell.w"))).alias("norm"),
        )
        return rows.select(
            key,
            F.transform("cells", lambda c: c["idx"]).alias("indices"),
            F.transform("cells", lambda c: c["w"] / F.col("norm")).alias("weights"),
        )

    def long_form(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, gram, weight), one row per non-zero cell."""
        cells = self.weights(df, key, text).select(
            key, F.explode(F.arrays_zip("indices", "weights")).alias("cell")
        )
        known = self.vocabulary.select("gram", "idx")
        return cells.join(known, F.col("cell.indices") == F.col("idx")).select(
            key, "gram", F.col("cell.weights").alias("weight")
        )

    def vectors(self, weights: DataFrame, out: str = "tfidf") -> DataFrame:
        """``weights`` plus an ML sparse vector, made in Arrow batches."""
        size = self.size

        @F.udf(VectorUDT(), useArrow=True)
        def sparse(indices, values):
            return SparseVector(size, indices, values)

        return weights.withColumn(out, sparse("indices", "weights"))

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark = self.vocabulary.sparkSession
        meta = [(self.n_documents, self.size, *self.ngram_range)]
        spark.createDataFrame(meta, "n_documents long, size long, shortest int, longest int").write.mode(
            "overwrite"
        ).json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TfidfModel":
        meta = spark.read.schema("n_documents long, size long, shortest int, longest int").json(f"{path}/meta").first()
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
        return cls(vocabulary, meta["n_documents"], meta["size"], (meta["shortest"], meta["longest"]))


def fit_tfidf(
    df: DataFrame,
    key: str,
    text: str,
    min_documents: int = MIN_DOCUMENTS,
    max_features: int = MAX_FEATURES,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
) -> TfidfModel:
    """Vocabulary of the most frequent n-grams that occur in at least ``min_documents`` texts.

    Ties at the cut go to the alphabetically smaller gram; indices follow the alphabet.
    """
    n_documents = df.count()
    grams = materialize(
        gram_counts(df, key, text, ngram_range)
        .where(F.col("gram").isNotNull())
        .groupBy("gram")
        .agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        .where(F.col("df") >= min_documents),
        "grams",
    )
    kept = sequence_id(_most_frequent(grams, max_features), ["gram"], "place")
    vocabulary = kept.select(
        "gram",
        (F.col("place") - 1).cast("int").alias("idx"),
        "tf",
        "df",
        (F.ln((1.0 + n_documents) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
    )
    vocabulary = materialize(vocabulary, "vocabulary")
    return TfidfModel(vocabulary, n_documents, vocabulary.count(), ngram_range)


def _cut(groups: list, room: int) -> tuple[float, int]:
    """The highest value whose group no longer fits, and the room left for it; (value, count) pairs in any order."""
    for value, n in sorted(groups, reverse=True):
        if n > room:
            return value, room
        room -= n
    return float("-inf"), 0


def _most_frequent(grams: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the highest tf, ties at the cut by gram, without sorting the table in one task.

    The cut is found from counts by step of log2(tf), then by tf within the step in which it lies. Only the rows
    with exactly the tf of the cut are put in order, by many tasks.
    """
    step = F.floor(F.log2("tf") * _STEPS)
    at_step, room = _cut([(r["step"], r["count"]) for r in grams.groupBy(step.alias("step")).count().collect()], most)
    if at_step == float("-inf"):
        return grams
    inside = grams.where(step == at_step).groupBy("tf").count().collect()  # the counts within one step
    at_tf, room = _cut([(r["tf"], r["count"]) for r in inside], room)
    ties = sequence_id(grams.where(F.col("tf") == at_tf), ["gram"], "place").where(F.col("place") <= room).drop("place")
    return grams.where(F.col("tf") > at_tf).unionByName(ties)


def tfidf_stats(model: TfidfModel, weights: DataFrame) -> DataFrame:
    """Vocabulary size, matrix rows and non-zero cells."""
    return weights.agg(F.count("*").alias("n_rows"), F.sum(F.size("indices")).alias("non_zeros")).select(
        F.lit(model.size).cast("bigint").alias("vocabulary_size"), "n_rows", "non_zeros"
    )
