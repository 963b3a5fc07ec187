"""Word vectors from a co-occurrence table by block power iteration: vocabulary and vectors stay distributed.

Words of a list that stand within ``window`` places of each other count as a pair, each word also with itself.  The positive pointwise
mutual information of the pairs is a sparse symmetric matrix, one row a pair; its leading eigenvectors, scaled by
the square roots of their eigenvalues, are the words' vectors (the factors that skip-gram finds implicitly, Levy & Goldberg 2014).

Block power iteration multiplies the matrix by a block of ``dim`` columns, held as a table with a row for each word: a join on the
word, and element-wise sums per word, combined map-side.  Only products of the block's columns, dim x dim
numbers, reach the driver.  The start is drawn from hashes of the words, so the result depends on the data alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, TOL = 30, 1e-7


def _materialize(df: DataFrame) -> DataFrame:
    from paysift.session import materialize
    return materialize(df)


def cooccurrences(lists: DataFrame, col: str, window: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """``(word, freq)`` of the words seen ``min_count`` times at least, and ``(word, other, n)``: how often two of them
    stand within ``window`` places in a list of array column ``col``, in both orders; a word's pair with itself is its frequency.

    Rarer words are left out of the pairs but keep their places.  Counts are combined map-side, so a word in a third of the lists is no hot key."""
    placed = lists.select(F.col(col).alias("w"), F.posexplode(col).alias("i", "word"))
    vocab = _materialize(placed.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_count))
    near = F.slice("w", F.col("i") + 2, window)  # those that follow; the other order is added to the counts
    after = (placed.select("word", F.explode(near).alias("other")).groupBy("word", "other").agg(F.count(F.lit(1)).alias("n")))
    both = after.where("word <> other").unionByName(after.where("word <> other").select(F.col("other").alias("word"), F.col("word").alias("other"), "n"))
    known = vocab.select("word")
    pairs = (both.groupBy("word", "other").agg(F.sum("n").alias("n")).join(known, "word", "left_semi")
             .join(known.withColumnRenamed("word", "other"), "other", "left_semi").select("word", "other", "n"))
    return vocab, pairs.unionByName(vocab.select("word", F.col("word").alias("other"), F.col("freq").alias("n")))


def information(pairs: DataFrame) -> DataFrame:
    """``word, other, m``: the positive pointwise mutual information of the counted pairs, zeros left out."""
    pairs = _materialize(pairs)
    margin = _materialize(pairs.groupBy("word").agg(F.sum("n").alias("t")))
    total = margin.agg(F.sum("t")).first()[0] or 0
    m = F.ln(F.col("n") * F.lit(float(total)) / (F.col("t") * F.col("u")))
    return (pairs.join(margin, "word").join(margin.select(F.col("word").alias("other"), F.col("t").alias("u")), "other")
            .select("word", "other", m.alias("m")).where("m > 0"))


def _times(matrix: DataFrame, block: DataFrame, dim: int) -> DataFrame:
    """``word, a, y``: the block's own row and that of matrix x block."""
    joined = matrix.join(block.select(F.col("word").alias("other"), "a"), "other")
    sums = joined.groupBy("word").agg(*[F.sum(F.col("m") * F.get("a", F.lit(i))).alias(f"_{i}") for i in range(dim)])
    product = sums.select("word", F.array(*[f"_{i}" for i in range(dim)]).alias("y"))
    none = F.array_repeat(F.lit(0.0), dim)
    return block.select("word", "a").join(product, "word", "left").select("word", "a", F.coalesce("y", none).alias("y"))


def _rows(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(table: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A'Y and Y'Y over all words."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, dim, dim))
        for b in batches:
            if b.num_rows:
                a, y = _rows(b.column("a"), dim), _rows(b.column("y"), dim)
                out += np.stack([a.T @ y, y.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["i", "v"])

    out = np.zeros(2 * dim * dim)
    for i, v in table.select("a", "y").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    ay, yy = out.reshape(2, dim, dim)
    return ay, (yy + yy.T) / 2


def _turned(table: DataFrame, by: np.ndarray, col: str, dim: int) -> DataFrame:
    """``word, a``: the rows of ``col`` times a dim x dim matrix."""
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = _rows(b.column(col), dim) @ by
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), pa.array(out.ravel()))], ["word", "a"])

    return table.select("word", col).mapInArrow(turn, "word string, a array<double>")


def leading_vectors(matrix: DataFrame, words: DataFrame, dim: int, rounds: int = ROUNDS, tol: float = TOL) -> tuple[DataFrame, np.ndarray]:
    """``word, vector`` for every row of ``words``, and the eigenvalues: the ``dim`` pairs of largest absolute eigenvalue of a symmetric
    sparse ``matrix`` (word, other, m), each vector's elements scaled by the root of that value; negative ones get zeros, and so do
    places beyond the number of words.

    A round is one product, with the Rayleigh-Ritz values of the block; rounds end when these move by less than ``tol`` of the
    largest, or at once where the block spans all words' space."""
    matrix = _materialize(matrix)
    draw = lambda i: F.xxhash64("word", F.lit(i)) / F.lit(float(1 << 63))
    start = words.select("word", F.array(*[draw(i) for i in range(dim)]).alias("a"))
    _, gram = _products(start.select("a", F.col("a").alias("y")), dim)
    block, whole = _turned(start, _unscaled(gram), "a", dim), words.count() <= dim
    before = None
    for _ in range(rounds):
        table = _materialize(_times(matrix, _materialize(block), dim))
        ay, yy = _products(table, dim)
        values, turn = np.linalg.eigh((ay + ay.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")
        values, turn = values[order], turn[:, order]
        if whole or before is not None and np.abs(values - before).max() <= tol * max(np.abs(values).max(), 1e-300):
            break
        before, block = values, _turned(table, _unscaled(yy), "y", dim)
    vectors = _turned(table, turn * np.sqrt(np.maximum(values, 0.0)), "a", dim)
    return _materialize(vectors.withColumnRenamed("a", "vector")), values


def _unscaled(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns of this Gram matrix orthonormal; dependent ones become zeros."""
    values, turn = np.linalg.eigh(gram)
    keep = values > 1e-12 * max(values[-1], 0.0)
    return turn * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def train(lists: DataFrame, col: str, dim: int, window: int, min_count: int) -> DataFrame:
    """``word, vector`` of every word seen ``min_count`` times at least in the lists of array column ``col``."""
    vocab, pairs = cooccurrences(lists, col, window, min_count)
    return leading_vectors(information(pairs), vocab.select("word"), dim)[0]
