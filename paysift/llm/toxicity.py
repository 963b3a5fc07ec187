"""Toxicity grades by cumulative-link ordinal regression over sparse word features.

The model has one weight a word, shared by all grades, and ordered thresholds: the chance that
a text's grade is over j is the logistic of its weighted words less threshold j.  Its output is
the expected severity, the sum of those chances, from 0 to the highest grade.

Labels say only toxic or not, so the grades of toxic texts are made from the labelled texts
themselves: of toxic texts, the thirds by their amount (log counts) of words that are far more
frequent in toxic texts than in others are graded 1 to 3; other texts have grade 0.

The model is fitted in numpy on a bounded sample of labelled rows (``MAX_LABELLED`` of either
class, those of least hash), weighted to the counts of all labelled rows.  Every word of these has a weight (words are hashed to
``BUCKETS`` places); a penalty on the weights keeps rare words' small.  Whole texts of all
documents are scored, each where it is read.

Defined cases: a null or wordless text has severity by the thresholds alone; labels without a
document, and null labels, take no part; an id with both labels is toxic; of a labelled document that is repeated, one copy is
fitted on; without toxic labels every severity is 0; a repeated row gets the same result; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import bounded_batches

#: Labelled rows of either class that the fit may use.
MAX_LABELLED = 8000
BUCKETS, GRADES = 1 << 20, 3
#: Penalty on the squared weights.
L2 = 3e-5
#: A text is called toxic from this chance on: missing one costs as much as four false alarms.
TOXIC_FROM = 0.2
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and how often each occurs."""
    counts = Counter(WORD.findall((text or "").lower()))
    ids = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in counts), np.int32, len(counts))
    return ids, np.fromiter(counts.values(), np.int32, len(counts))


@dataclass
class Model:
    """Weights by hashed word (none: all 0), and ``GRADES`` rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, score: float) -> np.ndarray:
        """The chance of a grade over j, for each j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))


def grades(ids: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for other texts; toxic ones by thirds of their amount of toxic words."""
    odds, seen = _log_odds(ids, toxic)
    strong = (odds > 2) & (seen >= 3)
    amount = np.array([np.log1p(c[strong[i]]).sum() for i, c in zip(ids, counts)])
    out = np.zeros(len(ids), int)
    if toxic.any():
        cuts = np.quantile(amount[toxic], [k / GRADES for k in range(1, GRADES)])
        out[toxic] = 1 + (amount[toxic][:, None] > cuts).sum(axis=1)
    return out


def _log_odds(ids: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of a word's presence in toxic texts against others, and the number of toxic texts with it."""
    count = lambda which: np.bincount(np.concatenate([ids[k] for k in np.flatnonzero(which)]) if which.any() else np.zeros(0, int), minlength=BUCKETS)
    pos, neg = count(toxic), count(~toxic)
    n, m = max(1, toxic.sum()), max(1, (~toxic).sum())
    return np.log((pos + 0.5) / (n + 1)) - np.log((neg + 0.5) / (m + 1)), pos


def thresholds_of(raw: np.ndarray) -> np.ndarray:
    """Rising thresholds from free parameters: the first, and the logs of the gaps."""
    return raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def loss(w: np.ndarray, raw: np.ndarray, row: np.ndarray, col: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray,
         l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with its penalty, and the gradients by ``w`` and ``raw``.  Entry e: word
    ``col[e]`` has value ``x[e]`` in text ``row[e]``."""
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    total = weight.sum()
    theta = thresholds_of(raw)
    score = np.bincount(row, x * w[col], len(grade))
    ends = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = logistic(np.clip(ends[grade + 1], -1e9, 1e9) - score), logistic(np.clip(ends[grade], -1e9, 1e9) - score)
    hi, lo = np.where(grade == GRADES, 1.0, hi), np.where(grade == 0, 0.0, lo)
    p = np.maximum(hi - lo, 1e-12)
    by_score = weight * -(1 - hi - lo) / total
    g = l2 * w - np.bincount(col, x * by_score[row], len(w))
    by_theta = np.array([((grade == j) * weight * -hi * (1 - hi) / p + (grade == j + 1) * weight * lo * (1 - lo) / p).sum() / total for j in range(GRADES)])
    g_raw = np.concatenate([[by_theta.sum()], [by_theta[j:].sum() * np.exp(raw[j]) for j in range(1, GRADES)]])
    return float(-(weight * np.log(p)).sum() / total + l2 / 2 * (w @ w)), g, g_raw


def fit(ids: list[np.ndarray], counts: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, rounds: int = 150, l2: float = L2) -> Model:
    """Maximum penalized likelihood by Adam on the whole sample; every word of it has a weight."""
    if not grade.max(initial=0):
        return Model(np.zeros(0, np.float32), np.full(GRADES, 40.0))
    kept, col = np.unique(np.concatenate(ids), return_inverse=True)
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    x = np.log1p(np.concatenate(counts))
    w, raw = np.zeros(len(kept)), np.concatenate([[3.0], np.zeros(GRADES - 1)])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    for t in range(1, rounds + 1):
        _, g, g_raw = loss(w, raw, row, col, x, grade, weight, l2)
        for value, grad, k in ((w, g, 0), (raw, g_raw, 2)):
            state[k] += 0.1 * (grad - state[k])
            state[k + 1] += 0.01 * (grad * grad - state[k + 1])
            value -= 0.1 * (state[k] / (1 - 0.9 ** t)) / (np.sqrt(state[k + 1] / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = w
    return Model(weights, thresholds_of(raw))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """The model from ``labels`` (doc_id, toxic)."""
    bounded_batches(docs.sparkSession)
    known = (labels.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("_toxic")).where("_id is not null and _toxic is not null")
             .groupBy("_id").agg(F.max("_toxic").alias("_toxic")))
    totals = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not totals.get(True):
        return Model(np.zeros(0, np.float32), np.full(GRADES, 40.0))
    chosen = None
    for toxic in (True, False):
        part = known.where(F.col("_toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
        chosen = part if chosen is None else chosen.unionByName(part)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype("string"), "toxic": batch["toxic"], "ids": [i.tobytes() for i, _ in found], "n": [c.tobytes() for _, c in found]})

    plain = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("text"))
    texts = plain.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(F.col("_doc").cast("string").alias("id"), F.col("_toxic").alias("toxic"), "text")
    rows = texts.mapInPandas(task, "id string, toxic boolean, ids binary, n binary").collect()  # at most 2 * max_labelled texts' words
    rows = sorted({(r["toxic"], r["id"], bytes(r["ids"]), bytes(r["n"])) for r in rows})
    ids, counts = [np.frombuffer(r[2], np.int32) for r in rows], [np.frombuffer(r[3], np.int32) for r in rows]
    toxic = np.array([r[0] for r in rows], bool)
    weight = np.where(toxic, totals.get(True, 0) / max(1, toxic.sum()), totals.get(False, 0) / max(1, (~toxic).sum()))
    return fit(ids, counts, grades(ids, counts, toxic), weight)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """Per row: doc_id, severity (expected grade), p_toxic, grade (severity rounded), toxic."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("severity double, p_toxic double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}  # of words seen; emptied when large
        for texts in parts:
            out = []
            for text in texts:
                total = 0.0
                for word, n in Counter(WORD.findall((text or "").lower())).items():
                    w = cache.get(word)
                    if w is None:
                        w = cache[word] = float(model.weights[zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS]) if len(model.weights) else 0.0
                    if w:
                        total += w * np.log1p(n)
                chances = model.chances(total)
                out.append((float(chances.sum()), float(chances[0])))
                if len(cache) > 1_000_000:
                    cache.clear()
            yield pd.DataFrame(out, columns=["severity", "p_toxic"])

    s = docs.select(docs[id_col].alias("doc_id"), score(docs[text_col]).alias("s"))
    return s.select("doc_id", "s.severity", "s.p_toxic", F.round("s.severity").cast("int").alias("grade"), (F.col("s.p_toxic") >= toxic_from).alias("toxic"))
