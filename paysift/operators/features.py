"""Feature engineering: target, ordinal codes, date parts, skill counts,
one-hot levels as a written index, sparse feature rows, embedding pooling.  Native column
expressions, but for feature rows of a small vocabulary, which are put together batch by batch as they are read; else
pooling is a join plus a per-dimension partial aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from paysift.functions import constants as K
from paysift.functions.expr import days_between_clipped, lookup

#: Word vectors that take at most this much go to every task; more meet the tokens in a shuffled join.
VECTOR_BYTES = 32 << 20
#: Tokens whose vectors are held at a time.
TOKENS = 1 << 15


def log_target(df: DataFrame, col: str = "salary_usd", name: str = "log_salary") -> DataFrame:
    return df.withColumn(name, F.ln(col))


def ordinal_codes(df: DataFrame) -> DataFrame:
    """Level / education / size codes; values outside the map stay null."""
    return (df.withColumn("exp_level_encoded", lookup("experience_level", K.EXPERIENCE_CODE).cast("int"))
              .withColumn("edu_level_encoded", lookup("education_required", K.EDUCATION_CODE).cast("int"))
              .withColumn("size_encoded", lookup("company_size", K.SIZE_CODE).cast("int")))


def date_parts(df: DataFrame, post: str = "posting_date", deadline: str = "application_deadline") -> DataFrame:
    return (df.withColumn("post_year", F.year(post)).withColumn("post_month", F.month(post))
              .withColumn("post_quarter", F.quarter(post))
              .withColumn("deadline_year", F.year(deadline)).withColumn("deadline_month", F.month(deadline))
              .withColumn("days_to_deadline", days_between_clipped(deadline, post)))


def skill_counts(df: DataFrame, arr: str = "skills_array") -> DataFrame:
    """``skill_count`` = list length as the reference counts it (``''`` -> 1)
    and ``skill_count_nonblank`` = real tokens only."""
    return (df.withColumn("skill_count", F.size(arr).cast("int"))
              .withColumn("skill_count_nonblank", F.size(F.filter(arr, lambda x: F.trim(x) != "")).cast("int")))


def onehot_long(df: DataFrame, keys: Sequence[str], prefixes: dict[str, str]) -> DataFrame:
    """The ones of the one-hot blocks as rows ``keys, feature, value``: as many rows a record as
    it has non-null columns, however many levels there are, and no level reaches the driver."""
    pairs = F.array(*[F.concat(F.lit(p), F.col(c).cast("string")) for c, p in prefixes.items()])
    return (df.select(*keys, F.explode(pairs).alias("feature")).where(F.col("feature").isNotNull())
              .select(*keys, "feature", F.lit(1).cast("long").alias("value")))


def level_index(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``feature, place``: the one-hot features of the levels in ``df`` and their places from 0, in the order of the names.  A
    written table; the levels never reach the driver."""
    from paysift.operators.ranking import row_numbers
    names = onehot_long(df, [], prefixes).select("feature").distinct()
    return row_numbers(names, ["feature"], "place").select("feature", (F.col("place") - 1).cast("int").alias("place"))


def _level_places(df: DataFrame, prefixes: dict[str, str], index: DataFrame, n_levels: int) -> tuple[DataFrame, Column]:
    """``df`` with a column ``_p<k>`` for each one-hot column, its level's place, and all of a row's places in their order."""
    from paysift.operators.selection import small
    out = df
    for k, (col, prefix) in enumerate(prefixes.items()):
        places = index.where(F.col("feature").startswith(prefix)).select(F.substring("feature", len(prefix) + 1, 1 << 30).alias(f"_l{k}"), F.col("place").alias(f"_p{k}"))
        out = out.join(small(places, n_levels), out[col].cast("string") == F.col(f"_l{k}"), "left").drop(f"_l{k}")
    return out, F.array_sort(F.array_compact(F.array(*[F.col(f"_p{k}") for k in range(len(prefixes))])))


def sparse_rows(df: DataFrame, numeric: Sequence[str], prefixes: dict[str, str], index: DataFrame, n_levels: int, dense: str, dim: int) -> DataFrame:
    """``df`` with ``indices`` and ``values`` of its features: the numeric ones, then one place for each level of
    ``index``, then the ``dim`` elements of the array ``dense`` (null: zeros).  A one-hot column meets the index in a join; a level that isn't in it is left out."""
    out, ones = _level_places(df, prefixes, index, n_levels)
    first, after = len(numeric), len(numeric) + n_levels
    vector = F.coalesce(F.col(dense), F.array_repeat(F.lit(0.0), dim))
    indices = F.concat(F.sequence(F.lit(0), F.lit(first - 1)), F.transform(ones, lambda p: p + first), F.sequence(F.lit(after), F.lit(after + dim - 1)))
    values = F.concat(F.array(*[F.col(c).cast("double") for c in numeric]), F.transform(ones, lambda _: F.lit(1.0)), vector)
    return out.withColumn("indices", indices).withColumn("values", values).drop(dense, *[f"_p{k}" for k in range(len(prefixes))])


def stored_vectors(df: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``df`` (with ``indices`` and ``values``) written once and read in two ways: as it is, and with ``features``, a sparse
    vector for ``pyspark.ml``: a vector's stored form is a struct that the reader takes for one."""
    from paysift.session import shared_dir
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "feature-rows")
    features = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("indices"), F.col("values"))
    rest = [c for c in df.columns if c not in ("indices", "values")]
    df.select(*rest, features.alias("features")).write.parquet(path)
    plain = df.select(*rest).schema.fields
    raw = spark.read.parquet(path).select(*rest, "features.indices", "features.values")
    return raw, spark.read.schema(StructType([*plain, StructField("features", VectorUDT())])).parquet(path)


def vectors_fit(words: DataFrame, dim: int, most: int) -> bool:
    """Whether ``word, vector`` (a stored table) takes at most ``most`` bytes."""
    n, letters = words.agg(F.count(F.lit(1)), F.sum(F.octet_length("word").cast("long"))).first()
    return n * dim * 8 + (letters or 0) <= most


@dataclass
class TokenRows:
    """Feature rows as they are written, a row's numbers ``_x<i>``, places and tokens, and how a batch of them becomes ``indices`` and ``values``."""

    frame: DataFrame
    keep: list[str]
    first: int
    size: int
    shared: Broadcast

    def where(self, condition: str) -> TokenRows:
        return replace(self, frame=self.frame.where(condition))

    def column(self, i: int) -> Column:
        """A numeric feature by its place in the row, for those who need no more of the row."""
        assert i < self.first
        return F.coalesce(F.col(f"_x{i}"), F.lit(float("nan")))

    def map(self, others: Sequence[str | Column], f: Callable, schema: str | StructType, vector: bool = False) -> DataFrame:
        """``f`` over the batches of ``indices``, ``values`` (or ``features``) and the columns ``others``; both are done in one pass through Python."""
        first, size, shared = self.first, self.size, self.shared
        inner = [*[f"_x{i}" for i in range(first)], "_ones", "_tokens"]
        rows = self.frame.select(*inner, *others)
        rest = rows.columns[len(inner):]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, table = shared.value
            for b in batches:
                pooled = _means(b.column("_tokens"), names, table)
                offsets, indices, values = _entries([b.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(first)], b.column("_ones"), pooled, size)
                both = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (indices, values)]
                if vector:
                    n = b.num_rows
                    both = [pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *both], ["type", "size", "indices", "values"])]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *both], [*rest, *(["features"] if vector else ["indices", "values"])])

        return rows.mapInArrow(lambda it: f(read(it)), schema)

    def frames(self) -> tuple[DataFrame, DataFrame]:
        """All rows with ``indices`` and ``values``, and with ``features``, a vector for ``pyspark.ml``."""
        plain, same = self.frame.select(*self.keep).schema.fields, lambda it: it
        lists = [StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))]
        return (self.map(self.keep, same, StructType([*plain, *lists])), self.map(self.keep, same, StructType([*plain, StructField("features", VectorUDT())]), vector=True))


def token_rows(df: DataFrame, keep: Sequence[str], numeric: Sequence[str], prefixes: dict[str, str], index: DataFrame, n_levels: int, tokens: str, words: DataFrame, dim: int) -> TokenRows:
    """What ``pool_vectors``, ``sparse_rows`` and ``stored_vectors`` give, for ``words`` that fit a task (``vectors_fit``): the columns
    ``keep``, and the features.

    A row is written with its places and its array ``tokens``; the mean of the tokens' vectors is taken as the row is read, so no vector is
    shuffled or written.  A row without a known token gets zeros."""
    from paysift.session import stored
    placed, ones = _level_places(df, prefixes, index, n_levels)
    double = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numeric)]
    rows = stored(placed.select(*keep, *double, ones.alias("_ones"), F.col(tokens).alias("_tokens")), "feature-rows")
    known = words.select("word", "vector").toArrow()
    matrix = known.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    shared = df.sparkSession.sparkContext.broadcast((known.column("word").to_pylist(), matrix))
    return TokenRows(rows, list(keep), len(numeric), len(numeric) + n_levels + dim, shared)


def rows_of_tokens(*args) -> tuple[DataFrame, DataFrame]:
    """``token_rows`` in two forms: with ``indices`` and ``values``, and with a vector ``features``."""
    return token_rows(*args).frames()


def _means(tokens: pa.ListArray, words: list[str], vectors: np.ndarray) -> np.ndarray:
    """For each list the mean of its known tokens' vectors, zeros if it has none."""
    place = pc.index_in(tokens.flatten(), value_set=pa.array(words, tokens.type.value_type))
    known = place.is_valid().to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)[known]
    place = place.fill_null(0).to_numpy(zero_copy_only=False)[known]
    out = np.zeros((len(tokens), vectors.shape[1]))
    for at in range(0, len(row), TOKENS):
        r = row[at:at + TOKENS]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[starts]] += np.add.reduceat(vectors[place[at:at + TOKENS]], starts, axis=0)
    return out / np.maximum(np.bincount(row, minlength=len(tokens)), 1)[:, None]


def _entries(numeric: Sequence[np.ndarray], ones: pa.ListArray, pooled: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, indices and values of a batch's sparse rows: the numeric columns, ones at the listed places after them, the pooled vector."""
    (n, dim), first = pooled.shape, len(numeric)
    row, place = pc.list_parent_indices(ones).to_numpy(zero_copy_only=False), ones.flatten().to_numpy(zero_copy_only=False)
    count = np.bincount(row, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(count + first + dim)]).astype(np.int32)
    indices, values = np.empty(offsets[-1], np.int32), np.ones(offsets[-1])
    start, end = offsets[:-1, None], offsets[1:, None]
    at = start + np.arange(first)
    indices[at], values[at] = np.arange(first), np.stack(numeric, axis=1)
    indices[offsets[row] + first + np.arange(len(row)) - (np.cumsum(count) - count)[row]] = place + first
    at = end - dim + np.arange(dim)
    indices[at], values[at] = size - dim + np.arange(dim), pooled
    return offsets, indices, values


def request_defaults(df: DataFrame, as_of: str = K.SCORE_AS_OF) -> DataFrame:
    """Missing model inputs as the serving layer fills them: its numbers, the middle level, the
    first degree, the middle size, and dates of a posting made on ``as_of``."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    fill = {c: v for c, v in K.SCORE_DEFAULTS.items() if c in K.BASE_NUMERIC_FEATURES}
    fill |= {"exp_level_encoded": K.EXPERIENCE_DEFAULT, "edu_level_encoded": K.EDUCATION_DEFAULT, "size_encoded": K.SIZE_DEFAULT,
             "post_year": year, "post_month": month, "post_quarter": (month - 1) // 3 + 1,
             "deadline_year": year + month // 12, "deadline_month": month % 12 + 1}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if c in df.columns})


def pool_vectors(tokens: DataFrame, keys: Sequence[str], vectors: DataFrame, dim: int,
                 how: str = "mean", token_col: str = "token", word_col: str = "word",
                 vector_col: str = "vector") -> DataFrame:
    """Element-wise mean (or max) of the vectors of each row's in-vocabulary
    tokens; rows without a hit get zeros.  ``keys`` identify the rows.

    Tokens meet vectors in an equi-join and each vector stays one row: the elements
    are ``dim`` aggregates of it, combined map-side, so a row with very many tokens
    sends one row a task.
    """
    keys = list(keys)
    v = vectors.select(F.col(word_col).alias("_w"), F.col(vector_col).alias("_vec"))
    hits = tokens.join(v, F.col(token_col) == F.col("_w"), "left")
    agg = F.avg if how == "mean" else F.max
    pooled = hits.groupBy(*keys).agg(*[agg(F.get("_vec", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)])
    return pooled.select(*keys, F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(dim)]).alias("pooled"))
