"""Token resolution and containment suggestions against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from paysift.operators import text as TX

WORDS = ["an", "and", "band", "Sand", "thousand", "o", "zz", "grün", "ünd", "aaa", "aaaa", "SQL", "abcab", "q"]


def ranked(spark, words):
    return spark.createDataFrame([(w, 100 - i, i + 1) for i, w in enumerate(words)], "word string, freq long, vocab_rank long")


def brute(token, words):
    t = token.lower()
    return next((w for w in words if t and (t in w or w in t)), None)


@pytest.mark.parametrize("seed", [1, 2])
def test_suggestions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = WORDS + ["".join(rng.choice("abü") for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    words = list(dict.fromkeys(words))
    rng.shuffle(words)
    tokens = ["AN", "x", "Thousands", "", "aaaaaaa", "GRÜNDEN", "sand", "nosuch", "q" * 30] + ["".join(rng.choice("abüx") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, token string")
    got = {r["i"]: r["suggestion"] for r in TX.suggest_contained(df, ranked(spark, words)).collect()}
    assert got == {i: brute(t, words) for i, t in enumerate(tokens)}


def test_very_long_tokens_are_linear_work(spark):
    rng = random.Random(3)
    words = WORDS + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    words = list(dict.fromkeys(words))
    vocab = ranked(spark, words)
    tokens = ["".join(rng.choice("ijklmnop") for _ in range(10_000)) + "thousand" + "x" * 10_000, "y" * 40_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, token string")
    TX.suggest_contained(df.withColumn("token", F.lit("warm")), vocab).collect()
    began = time.time()
    got = {r["i"]: r["suggestion"] for r in TX.suggest_contained(df, vocab).collect()}
    assert got == {i: brute(t, words) for i, t in enumerate(tokens)}
    assert time.time() - began < 20  # the enumeration of all substrings took 28 s for 2,000 letters


def test_matching_joins_the_token_table_once(spark):
    vocab = spark.createDataFrame([("Python", 9), ("SQL", 8), ("tensorFlow", 5), ("TensorFLOW", 5)], "word string, freq long")
    req = spark.createDataFrame([(1, i, t) for i, t in enumerate(["python", "python", "sql", "TENSORFLOW", "Rust", ""])], "rid int, pos int, token string")
    out = TX.vocab_match(req, ["rid"], vocab)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert [r["hit"] for r in out.orderBy("pos").collect()] == ["Python", "Python", "SQL", "tensorFlow", None, None]
    assert out.select("rid", "pos", "token", "hit", "note").count() == 6


def test_gram_lists(spark):
    df = TX._lettered(spark.createDataFrame([("abcab",), ("ü",), ("",)], "w string"), "w")
    rows = df.select(*[TX.grams(F.col("_c"), F.col("_n"), k).alias(f"g{k}") for k in (1, 2, 3)]).collect()
    assert [list(r) for r in rows] == [[["a", "b", "c"], ["ab", "bc", "ca"], ["abc", "bca", "cab"]], [["ü"], [], []], [[], [], []]]
