"""Truncated SVD of the TF-IDF rows.

A dense block (terms by columns) is a table of one row a term: ``idx`` and ``vec``, its numbers as 8-byte floats.
Only matrices of columns by columns pass through the driver, and tables so small that Spark broadcasts them for a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .tfidf import TfidfModel

# Settings of the decomposition.
N_COMPONENTS = 300
ITERATIONS = 5
OVERSAMPLING = 10
SEED = 42
_ROWS = 1024  # rows multiplied at a time in a task
_NUMBERS = 1 << 17  # products of cells held at a time: a megabyte, which stays in a core's cache
# A block up to this size is shuffled as a whole to every task that multiplies; a larger one is cut into ranges of terms.
BROADCAST_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
_BLOCK = "idx int, vec binary"


@dataclass
class SvdModel:
    """``table`` is the vocabulary-by-components matrix V, ``singular_values`` the values that go with it."""

    table: DataFrame
    size: int
    singular_values: np.ndarray

    @property
    def components(self) -> int:
        return len(self.singular_values)

    @property
    def factors(self) -> np.ndarray:
        """V on the driver, for looking at a small model."""
        return _collected(self.table, self.size, self.components)

    def transform(self, weights: DataFrame, out: str = "svd") -> DataFrame:
        """Projection of sparse rows (``indices``, ``weights``) on V as an array of floats.

        The rows are written first, as they are read twice. Each meets a copy of V in its task; a large V is cut into
        ranges of terms, each multiplied with the cells that fall into it, and the products are summed by row.
        """
        rows = materialize(weights.withColumn("_row", F.monotonically_increasing_id()), "svd-projected")
        width, cells = self.components, rows.select("_row", "indices", "weights")

        def floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = _matrix(batch.column(1), width).astype(np.float32)
                ends = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(numbers.ravel()))], names=["_row", "_svd"])

        if _fits(self.size, width):
            projected = _range_products(_whole(cells), self.table, self.size, width, self.size, _copies(rows, self.size))
        else:
            span = _span(width)
            pieces = _pieces(cells, span)
            projected = _sums(_range_products(pieces, self.table, self.size, width, span, _salts(pieces, self.size, span)), "row", width)
        dense = projected.mapInArrow(floats, "_row bigint, _svd array<float>")
        none = F.array_repeat(F.lit(0.0).cast("float"), width)  # a row without known terms
        return rows.join(dense, "_row", "left").withColumn(out, F.coalesce("_svd", none)).drop("_row", "_svd")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/factors")
        values = [(i, float(s), self.size) for i, s in enumerate(self.singular_values)]
        spark.createDataFrame(values, "component int, value double, size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SvdModel":
        values = spark.read.parquet(f"{path}/values").orderBy("component").toPandas()
        return cls(spark.read.schema(_BLOCK).parquet(f"{path}/factors"), int(values["size"].iloc[0]), values["value"].to_numpy())


def _fits(size: int, width: int) -> bool:
    return size * width * 8 <= BROADCAST_BYTES


def _span(width: int) -> int:
    """Terms in a range."""
    return max(1, RANGE_BYTES // (8 * width))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), width)


def _named(names: np.ndarray, matrix: np.ndarray, key: str = "idx") -> Iterator[pa.RecordBatch]:
    kind = pa.int32() if key == "idx" else pa.int64()
    for low in range(0, len(names), 4096):
        vectors = pa.array([row.tobytes() for row in matrix[low : low + 4096]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 4096], kind), vectors], names=[key, "vec"])


def _collected(block: DataFrame, size: int, width: int) -> np.ndarray:
    out = np.zeros((size, width))
    for row in block.collect():
        out[row["idx"]] = np.frombuffer(row["vec"])
    return out


def _add(into: np.ndarray, owner: np.ndarray, picked: np.ndarray, cells: np.ndarray, block: np.ndarray) -> None:
    """Adds ``cells`` times the rows ``picked`` of ``block`` to the rows ``owner`` (ascending) of ``into``."""
    step = max(1, _NUMBERS // max(1, into.shape[1]))
    for low in range(0, len(cells), step):
        some = slice(low, low + step)
        named, first = np.unique(owner[some], return_index=True)
        into[named] += np.add.reduceat(cells[some, None] * block[picked[some]], first, axis=0)


def _flat(indices, values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, term and weight of each cell."""
    lengths = np.fromiter(map(len, indices), np.int64, len(indices))
    terms = np.concatenate([*indices, np.zeros(0)]).astype(np.int64)
    cells = np.concatenate([*values, np.zeros(0)]).astype(np.float64)
    return np.repeat(np.arange(len(indices)), lengths), terms, cells


def _products(indices, values, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time: row, term and weight of their cells, and the rows times ``block``."""
    for low in range(0, len(indices), _ROWS):
        owner, terms, cells = _flat(indices[low : low + _ROWS], values[low : low + _ROWS])
        out = np.zeros((len(indices[low : low + _ROWS]), block.shape[1]))
        _add(out, owner, terms, cells, block)
        yield owner, terms, cells, out


def _sums(parts: DataFrame, key: str, width: int) -> DataFrame:
    """``vec`` summed by key while the sorted rows stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = total = None
        for batch in batches:
            names = batch.column(0).to_numpy()
            if not len(names):
                continue
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            sums, names = np.add.reduceat(_matrix(batch.column(1), width), starts, axis=0), names[starts]
            if held is not None and names[0] == held:
                sums[0] += total
            elif held is not None:
                yield from _named(np.array([held]), total[None], key)
            yield from _named(names[:-1], sums[:-1], key)
            held, total = names[-1], sums[-1].copy()
        if held is not None:
            yield from _named(np.array([held]), total[None], key)

    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(add, parts.schema)


def _pieces(rows: DataFrame, span: int) -> DataFrame:
    """(row, part, indices, weights): each row cut by ranges of ``span`` terms."""
    ranges = F.array_distinct(F.transform("indices", lambda i: F.floor(i / span).cast("int")))
    cut = rows.select("_row", F.arrays_zip("indices", "weights").alias("cells"), F.explode(ranges).alias("part"))
    own = F.filter("cells", lambda c: F.floor(c["indices"] / span).cast("int") == F.col("part"))
    return cut.select(F.col("_row").alias("row"), "part", own.alias("cells")).select(
        "row", "part", F.col("cells.indices").alias("indices"), F.col("cells.weights").alias("weights")
    )


def _whole(rows: DataFrame) -> DataFrame:
    """(row, part, indices, weights): each row as one piece."""
    return rows.select(F.col("_row").alias("row"), F.lit(0).alias("part"), "indices", "weights")


def _copies(rows: DataFrame, size: int) -> int:
    """Tasks that hold a copy of a block each: one a core, unless there are fewer cells than so many copies have terms."""
    cells = rows.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0))).first()[0]
    return max(1, min(rows.sparkSession.sparkContext.defaultParallelism, cells // max(size, 1)))


def _salts(pieces: DataFrame, size: int, span: int) -> int:
    """Tasks among which the cells of one range are spread."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, tasks // -(-size // span))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Stretches of a batch with the same (part, salt), its first two columns."""
    part, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    if len(part):
        starts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (salt[1:] != salt[:-1]))))
        for low, high in zip(starts, [*starts[1:], len(part)]):
            yield (int(part[low]), int(salt[low])), batch.slice(low, high - low)


def _met(pieces: DataFrame, block: DataFrame, size: int, span: int, salts: int) -> DataFrame:
    """(part, salt, kind, name, vec, indices, weights): in a task, the block rows of a range precede its pieces."""
    nothing = F.lit(None)
    left = block.select(
        F.floor(F.col("idx") / span).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.lit(0).alias("kind"), F.col("idx").cast("long").alias("name"), "vec",
        nothing.cast("array<int>").alias("indices"), nothing.cast("array<double>").alias("weights"),
    )
    right = pieces.select(
        "part", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("row").alias("name"),
        nothing.cast("binary").alias("vec"), "indices", "weights",
    )

    both = left.unionByName(right)
    dealt = both.repartitionById(salts, "salt") if span >= size else both.repartition("part", "salt")
    return dealt.sortWithinPartitions("part", "salt", "kind")


def _range_products(pieces: DataFrame, block: DataFrame, size: int, width: int, span: int, salts: int) -> DataFrame:
    """(row, vec): each piece times its range of the block."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, np.zeros((span, width))
        for batch in batches:
            for place, run in _runs(batch):
                if place != own:
                    own = place
                    held[:] = 0
                kind, name = run.column(2).to_numpy(), run.column(3).to_numpy()
                n = int(np.searchsorted(kind, 1))
                if n:
                    held[name[:n] - place[0] * span] = _matrix(run.column(4).slice(0, n), width)
                indices, values = (run.column(i).slice(n).to_numpy(zero_copy_only=False) for i in (5, 6))
                for low, (_, _, _, out) in zip(range(0, len(indices), _ROWS), _products([i - place[0] * span for i in indices], values, held)):
                    yield from _named(name[n + low : n + low + len(out)], out, "row")

    return _met(pieces, block, size, span, salts).mapInArrow(multiply, "row bigint, vec binary")


def _gram_by_ranges(pieces: DataFrame, block: DataFrame, size: int, width: int) -> DataFrame:
    """A'A times a block that no executor holds as a whole.

    Ranges of the block meet their cells, the products are summed by row, each row's sum goes back to the row's
    pieces, and these are added up by range. A task holds one range of the block.
    """
    span = _span(width)
    salts = _salts(pieces, size, span)
    products = _sums(_range_products(pieces, block, size, width, span, salts), "row", width)
    cells = pieces.join(products, "row").select(
        "part", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "indices", "weights", "vec"
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, met = None, np.zeros((span, width)), np.zeros(span, dtype=bool)

        def emit():
            terms = np.flatnonzero(met)
            yield from _named(terms + own[0] * span, total[terms])
            total[:], met[:] = 0, False

        for batch in batches:
            for place, run in _runs(batch):
                if own is not None and place != own:
                    yield from emit()
                own = place
                product = _matrix(run.column(4), width)
                lists = (run.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                owner, terms, weights = _flat(*lists)
                order, local = np.argsort(terms, kind="stable"), terms - place[0] * span
                _add(total, local[order], owner[order], weights[order], product)
                met[local] = True
        if own is not None:
            yield from emit()

    parts = cells.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(multiply, _BLOCK)
    return _sums(parts, "idx", width)


def _gram_by_copies(pieces: DataFrame, block: DataFrame, size: int, width: int, copies: int) -> DataFrame:
    """A'A times a block of which each task gets a copy; a task adds up its own rows and hands on one row a term it met."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total, met = np.zeros((size, width)), np.zeros((size, width)), np.zeros(size, dtype=bool)
        for batch in batches:
            n = int(np.searchsorted(batch.column(2).to_numpy(), 1))
            if n:
                q[batch.column(3).to_numpy()[:n]] = _matrix(batch.column(4).slice(0, n), width)
            lists = (batch.column(i).slice(n).to_numpy(zero_copy_only=False) for i in (5, 6))
            for owner, terms, cells, product in _products(*lists, q):
                order = np.argsort(terms, kind="stable")
                _add(total, terms[order], owner[order], cells[order], product)
                met[terms] = True
        yield from _named(np.flatnonzero(met), total[met])

    return _sums(_met(pieces, block, size, size, copies).mapInArrow(multiply, _BLOCK), "idx", width)


class _Rows:
    """The sparse rows A, written once in the form that the products read."""

    def __init__(self, weights: DataFrame, size: int, width: int):
        self.size, self.width, self.whole = size, width, _fits(size, width)
        rows = weights.select(F.monotonically_increasing_id().alias("_row"), "indices", "weights")
        if self.whole:
            self.table = materialize(_whole(rows), "svd-rows")
            self.copies = _copies(self.table, size)
        else:
            self.table = materialize(_pieces(rows, _span(width)), "svd-pieces")

    def gram_times(self, block: DataFrame) -> DataFrame:
        """A'A times a block, written. Terms that no row holds have no row in the result."""
        if self.whole:
            times = _gram_by_copies(self.table, block, self.size, self.width, self.copies)
        else:
            times = _gram_by_ranges(self.table, block, self.size, self.width)
        return materialize(times, "svd-block")


def _inner(pairs: DataFrame, left: int, right: int) -> np.ndarray:
    """The sum of the outer products of the last two columns: a partial sum a task, added up in one more."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((left, right))
        for batch in batches:
            total += _matrix(batch.column(0), left).T @ _matrix(batch.column(1), right)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vec"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((left, right))
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py()).reshape(left, right)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vec"])

    summed = pairs.mapInArrow(multiply, "vec binary").repartition(1).mapInArrow(add, "vec binary")
    (row,) = summed.collect()  # read to the end, or the task's Python worker is given up
    return np.frombuffer(row["vec"]).reshape(left, right)


def _turned(block: DataFrame, *turns: np.ndarray, fill: int = 0, seed: int = 0) -> DataFrame:
    """A block times small matrices, with ``fill`` columns of random numbers, drawn for each term by its index, beside it."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            out = _matrix(batch.column(1), len(turns[0]))
            for turn in turns:
                out = out @ turn
            if fill:
                drawn = [np.random.default_rng([seed, int(i)]).standard_normal(fill) for i in names]
                out = np.concatenate((out, np.array(drawn).reshape(len(names), fill)), axis=1)
            yield from _named(names, out)

    return block.mapInArrow(multiply, _BLOCK)


def _orthonormal(block: DataFrame, terms: DataFrame, width: int, seed: int) -> DataFrame:
    """Orthonormal columns that span those of ``block``, from its Gram matrix, which alone reaches the driver.

    Columns are scaled to length 1 before. The step is repeated until the Gram matrix is the unit matrix; the written
    block is turned anew each time it is read. Directions that rounding has swallowed give way to random columns.
    """
    turns: list[np.ndarray] = []
    for attempt in range(6):
        now = _turned(block, *turns) if turns else block
        gram = _inner(now.select("vec", F.col("vec").alias("other")), width, width)
        if np.abs(gram - np.eye(width)).max() < 1e-9:
            return now
        length = np.sqrt(np.diag(gram))
        scale = np.divide(1.0, length, out=np.zeros(width), where=length > 0)
        values, vectors = np.linalg.eigh(gram * scale[:, None] * scale)
        kept = values > 1e-13 * max(values.max(), 1e-300)
        turns.append(scale[:, None] * vectors[:, kept] / np.sqrt(values[kept]))
        fill = width - int(kept.sum())
        if fill:  # random columns need a number for every term
            zero = F.lit(bytes(8 * width))
            whole = terms.join(block, "idx", "left").select("idx", F.coalesce("vec", zero).alias("vec"))
            block = materialize(_turned(whole, *turns, fill=fill, seed=seed + attempt + 1), "svd-basis")
            turns = []
    return _turned(block, *turns) if turns else block


def fit_svd(
    model: TfidfModel, weights: DataFrame, components: int = N_COMPONENTS, iterations: int = ITERATIONS, seed: int = SEED
) -> SvdModel:
    """Uncentred truncated SVD of the training rows by randomised subspace iteration (Halko et al., 2011).

    Each of the ``iterations + 1`` passes multiplies the distributed rows by a thin block; an eigen solver would
    need a pass for every Lanczos vector. At most as many components as the vocabulary has terms are kept.
    """
    spark, size = weights.sparkSession, model.size
    components = min(components, size)
    width = min(components + OVERSAMPLING, size)
    rows = _Rows(weights, size, width)
    terms = spark.range(size).select(F.col("id").cast("int").alias("idx"))
    nothing = terms.withColumn("vec", F.lit(b""))
    start = materialize(_turned(nothing, np.zeros((0, 0)), fill=width, seed=seed), "svd-basis")
    block = _orthonormal(start, terms, width, seed)
    for _ in range(iterations):
        block = _orthonormal(rows.gram_times(block), terms, width, seed)
    other = rows.gram_times(block).withColumnRenamed("vec", "other")
    inner = _inner(block.join(other, "idx").select("vec", "other"), width, width)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    largest = np.argsort(values)[::-1][:components]
    table = materialize(_turned(block, vectors[:, largest]), "svd-factors")
    return SvdModel(table, size, np.sqrt(np.clip(values[largest], 0.0, None)))


def pair_errors(svd: SvdModel, weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each component the length of A'A v - s^2 v, and how far V'V is from the unit matrix in its column."""
    width = svd.components
    times = _Rows(weights, svd.size, width).gram_times(svd.table).withColumnRenamed("vec", "other")
    squares = svd.singular_values**2
    both = svd.table.join(times, "idx", "left").select("vec", F.coalesce("other", F.lit(bytes(8 * width))).alias("other"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _matrix(batch.column(1), width) - _matrix(batch.column(0), width) * squares
            ones = np.ones((batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o.tobytes() for o in ones], pa.binary()), pa.array([a.tobytes() for a in apart**2], pa.binary())], names=["vec", "other"]
            )

    residual = np.sqrt(_inner(both.mapInArrow(differ, "vec binary, other binary"), 1, width)[0])
    gram = _inner(svd.table.select("vec", F.col("vec").alias("other")), width, width)
    return residual, np.abs(gram - np.eye(width)).max(axis=0)


def explained_variance(weights: DataFrame, projected: DataFrame, svd: str = "svd") -> DataFrame:
    """Variance kept by the projection over the variance of the TF-IDF matrix, both summed over columns.

    Both tables are reduced per column: the sparse cells by term, the dense cells by component.
    """
    n = float(max(weights.count(), 1))

    def total_variance(cells: DataFrame, name: str) -> DataFrame:
        sums = cells.groupBy("column").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
        mean = F.col("s") / n
        return sums.agg(F.sum(F.col("ss") / n - mean * mean).alias(name)).withColumn("_one", F.lit(1))

    sparse = weights.select(F.explode(F.arrays_zip("indices", "weights")).alias("c")).select(
        F.col("c.indices").alias("column"), F.col("c.weights").alias("v")
    )
    dense = projected.select(F.posexplode(svd).alias("column", "v")).select("column", F.col("v").cast("double"))
    return total_variance(dense, "kept").join(total_variance(sparse, "full"), "_one").select(F.try_divide("kept", "full").alias("explained_variance_ratio"))
