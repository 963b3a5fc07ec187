"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose score is over a cutoff.  Cutoffs come from a labelled holdout, in two parts by a hash of the text.
On the smaller part every stratum (a band of the text's length in words) and rule proposes the cutoff that gains most, that is
rejects most bad texts less ``cost`` times the good ones (none where no cutoff gains).  On the other part the stratum's proposed rules are
tested together, as they will be used: first with every cutoff ``MARGINS[0]`` steps laxer, then with smaller margins, down to the proposal.  A
step is certified while the exact (Clopper-Pearson) upper bound of the stratum's false rejection
rate, the share of good texts that any of its rules rejects, stays within ``max_false``; testing
stops at the first failure (fixed-sequence testing, the sequence being fixed by the other part), so no
correction is due within a stratum, and the error level is divided by the number of strata (Bonferroni).  So with probability
``1 - level`` every stratum loses ``max_false`` of its good texts at most.  The strictest certified step is used; a stratum
without one keeps all that pass the base rules.

The bound counts trials, so a text counts once, however many rows repeat it.

Everything is counted by Spark: the labelled rows become (stratum, rule, cutoff step) counts,
whose number is fixed by the settings, and the driver receives only those.

Defined cases: a null, empty or wordless text has no words and fails the base rules; labels
without a document, documents without a label, and null labels take no part; a repeated
label or row counts as often as it occurs; without labels no cutoff is certified and only the
base rules reject; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import bounded_batches, fresh, small_side, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Rule -> score in [0, 1] from the measured columns.
RULES = {
    "symbols": lambda c: c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "repeats": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "dup_lines": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "capitals": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
}
#: Cutoffs are multiples of 1 / STEPS.
STEPS = 100
#: Lower ends of the strata, in words.
BANDS = (0, 50, 100, 200, 400, 1000)
MAX_FALSE, LEVEL, COST = 0.02, 0.05, 20.0
#: One in so many labelled texts proposes cutoffs, the others test them, with these margins in steps.
PROPOSING, MARGINS = 3, (8, 4, 2, 1, 0)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def measure(text: str | None) -> tuple[int, ...]:
    """The columns of ``MEASURES`` for one text."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at just the six ASCII spaces
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), _repeated(words), len(lines), sum(1 for x in filter(str.isupper, text)))


def _repeated(words: list[bytes]) -> int:
    """Words in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    # a window's number from its first pair's rank: no overflow, however many words differ
    pair = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)[1]
    _, at, times = np.unique(pair[:-1] * len(ids) + x[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= again
    return int(hit.sum())


def measured(docs: DataFrame, text_col: str = "text") -> Column:
    """A struct column of ``MEASURES``."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=names, dtype="int64")

    # a filter on the measures would else be pushed below them, and measure every text again
    return of.asNondeterministic()(docs[text_col])


def base_failed(c) -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def stratum(c) -> Column:
    return sum(((c("n_words") >= lo).cast("int") for lo in BANDS[1:]), F.lit(0))


def binomial_upper(bad: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a rate after ``bad`` of ``n``: the rate at which so few
    or fewer have probability ``level``."""
    if bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]
    lo, hi = bad / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(math.exp(x + k * math.log(p) + (n - k) * math.log1p(-p)) for k, x in enumerate(logs)) if 0 < p < 1 else float(p <= 0)
        lo, hi = (p, hi) if tail > level else (lo, p)
    return hi


def choose_cutoffs(counts: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], max_false: float = MAX_FALSE,
                   level: float = LEVEL, cost: float = COST, tests: int | None = None) -> dict[tuple[int, str], int]:
    """(stratum, rule) -> cutoff step.  ``counts``: good and bad documents by score step; a
    document of score step s is rejected by a cutoff step below s."""
    tests, chosen = tests or max(1, len(counts)), {}
    for key, (good, bad) in counts.items():
        n, best = int(good.sum()), 0.0
        for cut in range(len(good) - 2, -1, -1):  # the laxest first
            lost, gone = int(good[cut + 1:].sum()), int(bad[cut + 1:].sum())
            if not n or lost > max_false * n or binomial_upper(lost, n, level / tests) > max_false:
                break
            if gone - cost * lost >= best > 0 or gone - cost * lost > best:
                best, chosen[key] = gone - cost * lost, cut
        # of the cutoffs that reject the same holdout documents, the middle one
        if key in chosen:
            cut = chosen[key]
            top = cut
            while top + 1 < len(good) - 1 and not good[top + 1] and not bad[top + 1]:
                top += 1
            chosen[key] = (cut + top) // 2
    return chosen


def score_steps(c) -> Column:
    """An array of (rule, step), where step / STEPS is the score rounded up."""
    return F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.ceil(score(c) * STEPS), F.lit(STEPS)).cast("int").alias("step")) for r, score in RULES.items()])


def certified(lost: list[int], n: int, max_false: float = MAX_FALSE, level: float = LEVEL / len(BANDS)) -> int | None:
    """The last step of a sequence, with so many of ``n`` good texts lost at each, up to which every step is certified."""
    best = None
    for k, x in enumerate(lost):
        if not n or x > max_false * n or binomial_upper(x, n, level) > max_false:
            break
        best = k
    return best


def fit(measured_docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, level: float = LEVEL, cost: float = COST) -> dict[tuple[int, str], int]:
    """Cutoffs from ``measured_docs`` (doc_id, text_hash and struct ``m``) and ``labels`` (doc_id,
    quality).  The false rejections counted are of good texts that pass the base rules, each text once."""
    c = lambda n: F.col(f"m.{n}")
    held = (measured_docs.join(labels.select("doc_id", F.col("quality").alias("_good")).where("_good is not null"), "doc_id")
            .where(~base_failed(c)).groupBy("text_hash").agg(F.min(F.col("_good") > 0).alias("good"), F.any_value("m").alias("m"))
            .select((F.pmod(F.xxhash64(F.col("text_hash"), F.lit("part")), F.lit(PROPOSING)) == 0).alias("proposes"), "good", stratum(c).alias("stratum"),
                    score_steps(c).alias("s")))
    held = written(held, "quality-held")
    rows = held.where("proposes").select("good", "stratum", F.explode("s").alias("s")).groupBy("stratum", "s.rule", "s.step", "good").count().collect()
    counts: dict = {}  # at most strata x rules x steps x 2
    for r in rows:
        pair = counts.setdefault((r["stratum"], r["rule"]), (np.zeros(STEPS + 1, int), np.zeros(STEPS + 1, int)))
        pair[0 if r["good"] else 1][r["step"]] += r["count"]
    proposed = choose_cutoffs(counts, max_false=max_false, level=1.0, cost=cost, tests=1)  # the level 1 certifies nothing
    if not proposed:
        return {}
    step = {rule: F.col("s")[i]["step"] for i, rule in enumerate(RULES)}

    def rejects(margin: int) -> Column:
        over = F.lit(False)
        for (band, rule), cut in sorted(proposed.items()):
            over = over | ((F.col("stratum") == band) & (step[rule] > min(cut + margin, STEPS)))
        return over

    lost = (held.where("good AND NOT proposes").groupBy("stratum")
            .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rejects(m)).alias(f"lost{m}") for m in MARGINS]).collect())
    out = {}
    for r in lost:
        k = certified([r[f"lost{m}"] for m in MARGINS], r["n"], max_false, level / len(BANDS))
        if k is not None:
            out |= {key: min(cut + MARGINS[k], STEPS) for key, cut in proposed.items() if key[0] == r["stratum"]}
    return out


def verdict(c, cutoffs: dict[tuple[int, str], int]) -> Column:
    """True for a text that passes the base rules and every certified cutoff of its stratum."""
    over = F.lit(False)
    for (band, rule), cut in sorted(cutoffs.items()):
        over = over | ((stratum(c) == band) & (F.ceil(RULES[rule](c) * STEPS) > cut))
    return ~base_failed(c) & ~over


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, then n_lines, n_upper, stratum and text_hash."""
    m = written(docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), measured(docs, text_col).alias("m")), "quality")
    cutoffs = fit(m.select("doc_id", "text_hash", "m"), labels, **settings)
    c = lambda n: F.col(f"m.{n}")
    return m.select("doc_id", *[c(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    base_failed(c).alias("base_failed"), verdict(c, cutoffs).alias("kept"),
                    c("n_lines").alias("n_lines"), c("n_upper").alias("n_upper"), stratum(c).alias("stratum"), "text_hash")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows that the rules reject.  The labelled rows are measured twice, to
    fit and where all are judged, rather than that texts are written; texts are shuffled only
    if the labelled ids are too many to be broadcast."""
    ids = small_side(written(labels.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct(), "labelled-ids"), 8)
    known = docs.join(ids, docs[id_col] == ids["_id"], "left_semi")
    cutoffs = fit(known.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), measured(known, text_col).alias("m")), labels, **settings)
    m = fresh(docs, "_measured")
    c = lambda n: F.col(f"{m}.{n}")
    return docs.withColumn(m, measured(docs, text_col)).where(verdict(c, cutoffs)).select(*[F.col(f"`{x}`") for x in docs.columns])
