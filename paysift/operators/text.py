"""Text rules: keyword classification, tokenisation, vocabulary matching.

Everything is a native expression or a join; no Python UDF runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.functions.constants import JOB_CATEGORIES, JOB_CATEGORY_DEFAULT
from paysift.functions.expr import contains_any, title_case


def classify_keywords(col: Column | str, rules: Sequence[tuple[str, Sequence[str]]] = JOB_CATEGORIES,
                      default: str = JOB_CATEGORY_DEFAULT) -> Column:
    """First category (in priority order) whose keyword is a substring of the
    lower-cased text; null text counts as ``''``.  Plain substrings, not regexes."""
    text = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    out = None
    for name, kws in rules:
        cond = contains_any(text, [k.lower() for k in kws])
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def words(col: Column | str, pattern: str = r"[^\p{L}]+") -> Column:
    """Split text into letter runs (empty pieces removed)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: x != "")


def token_table(df: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """Long form ``keys + (pos, token)`` of an array column (1-based positions)."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


def vocabulary(tokens: DataFrame, token_col: str = "token", min_count: int = 5,
               ranked: bool = True) -> DataFrame:
    """Tokens seen at least ``min_count`` times, with frequency and (``ranked``)
    a rank — most frequent first, ties by token — the order a trained model lists them."""
    from paysift.operators.ranking import row_numbers
    from paysift.session import materialize
    # read by several lookups and by the ranking: computed from the corpus once
    v = materialize(tokens.groupBy(F.col(token_col).alias("word")).agg(F.count(F.lit(1)).alias("freq"))
                          .where(F.col("freq") >= min_count))
    if not ranked:
        return v
    v = v.withColumn("_nf", -F.col("freq"))
    # range-partitioned numbering: no single-partition window over the vocabulary
    return materialize(row_numbers(v, ["_nf", "word"], "vocab_rank").drop("_nf"))


def resolve_tokens(tokens: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """``token, hit`` for each different token: the vocabulary word it stands for, null if none.

    Priority: as typed, Title case, UPPER case, then case-insensitively (the least frequent vocabulary word of
    that lower-case form wins, ties by the larger word).  The forms of a token meet one dictionary of words and lower-case
    forms in one join; repeated tokens are merged map-side before.
    """
    t = tokens.groupBy(F.col(token_col).alias("token")).agg(F.lit(1).alias("_one")).select("token")
    forms = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(kind).alias("kind"), c.alias("form")) for k, (kind, c) in enumerate(
        [("word", F.col("token")), ("word", title_case("token")), ("word", F.upper("token")), ("lower", F.lower("token"))])])
    rarest = F.max_by("word", F.struct((-F.col("freq")).alias("f"), F.col("word").alias("w")))
    entries = (vocab.select(F.lit("word").alias("kind"), F.col("word").alias("form"), F.col("word").alias("hit"))
               .unionByName(vocab.groupBy(F.lower("word").alias("form")).agg(rarest.alias("hit")).withColumn("kind", F.lit("lower"))))
    asked = t.select("token", F.explode(forms).alias("f")).select("token", "f.*")
    return asked.join(entries, ["kind", "form"], "left").groupBy("token").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("p"))).alias("hit"))


def vocab_match(requests: DataFrame, keys: Sequence[str], vocab: DataFrame) -> DataFrame:
    """Match each request token to the vocabulary (``resolve_tokens`` has the rules).

    ``requests`` is long form (``keys, pos, token``); the result adds ``hit``
    (null when unmatched) and ``note`` (``tok→hit`` when they differ).  The different tokens are resolved once into a written
    table; the token table meets it in one join, which adaptive execution broadcasts or splits by its measured bytes.
    """
    from paysift.session import materialize
    known = materialize(resolve_tokens(requests, vocab))
    out = requests.select(*keys, "pos", "token").join(known, "token", "left").select(*keys, "pos", "token", "hit")
    return out.withColumn("note", F.when(F.col("hit").isNull(), F.lit(None))
                                   .when(F.col("hit") == F.col("token"), F.col("token"))
                                   .otherwise(F.concat("token", F.lit("→"), "hit")))


#: Letters of a posting list's key.
GRAM = 3


def grams(chars: Column, n: Column, q: int) -> Column:
    """The different runs of ``q`` letters of a word given as an array of its ``n`` letters (none if it is shorter)."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - q, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(q)]))
    return F.when(n >= q, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _lettered(df: DataFrame, col: str) -> DataFrame:
    """With the word's letters and their number, as columns of their own: they are used in many places."""
    return df.withColumn("_c", F.split(col, "")).withColumn("_n", F.length(col))


def suggest_contained(unmatched: DataFrame, vocab: DataFrame, q: int = GRAM) -> DataFrame:
    """For each unmatched token: the first vocabulary word (by ``vocab_rank``)
    that contains the lower-cased token or is contained in it; none for an empty token.

    A posting list of the runs of up to ``q`` letters serves both ways, with work linear in a word's length:

    * a word inside the token: the word is filed under its rarest run (itself, if it is no longer than ``q``), the token
      asks for all of its runs;
    * the token inside a word: words are filed under all of their runs, the token asks for its rarest one.  A token no longer than
      ``q`` is a run itself, and takes the first word filed there.

    What meets is verified by ``contains``.  Each token is looked up once, however many requests repeat it.
    """
    from paysift.session import materialize
    best = F.min(F.struct("vocab_rank", "word")).alias("best")
    words_ = _lettered(vocab.select("word", "vocab_rank"), "word")
    filed = materialize(words_.select("word", "vocab_rank", "_n", F.explode(F.flatten(F.array(*[grams(F.col("_c"), F.col("_n"), k) for k in range(1, q + 1)]))).alias("gram")))
    heads = materialize(filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"), best))
    # of a word's longest runs, the one that the fewest words share
    longest = filed.where(F.length("gram") == F.least(F.col("_n"), F.lit(q)))
    key = (longest.join(heads.select("gram", "n_words"), "gram").groupBy("word", "vocab_rank")
           .agg(F.min_by("gram", F.struct("n_words", "gram")).alias("gram")))
    tokens = materialize(_lettered(unmatched.select(F.lower("token").alias("_lt")).distinct().where("_lt <> ''"), "_lt")
                         .select("_lt", "_n", F.explode(F.flatten(F.array(*[grams(F.col("_c"), F.col("_n"), k) for k in range(1, q + 1)]))).alias("gram")))
    inside = (tokens.join(key, "gram").where(F.col("_lt").contains(F.col("word"))).groupBy("_lt").agg(best))
    short = tokens.where((F.col("_n") <= q) & (F.col("gram") == F.col("_lt"))).join(heads, "gram").select("_lt", "best")
    asked = (tokens.where((F.col("_n") > q) & (F.length("gram") == q)).join(heads.select("gram", "n_words"), "gram", "left")
             .groupBy("_lt").agg(F.min_by("gram", F.struct(F.coalesce("n_words", F.lit(0)).alias("n"), "gram")).alias("gram")))
    around = asked.join(filed, "gram").where(F.col("word").contains(F.col("_lt"))).groupBy("_lt").agg(best)
    found = (inside.unionByName(short).unionByName(around).groupBy("_lt").agg(F.min("best").alias("best"))
             .select("_lt", F.col("best.word").alias("suggestion")))
    return unmatched.join(found, F.lower("token") == F.col("_lt"), "left").drop("_lt")
