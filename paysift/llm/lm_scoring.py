"""Masked pseudo-likelihood: a bidirectional window network scores every word from both sides.

The words are the corpus's own: all are counted exactly, and the ``VOCABULARY * words ** 0.4`` most
frequent ones (ties by the word) make the vocabulary, so it grows with the corpus.  A network takes
the embedded words of the ``SIDE`` places before and after a masked place, each position with a
matrix of its own, through a tanh layer to a softmax of two levels, both conditional on both
sides: first the group of the masked word (groups are runs of the vocabulary, by frequency, of about
equal share), then the word within its group.  A word outside the vocabulary is spelled: all such words are a
group of the first level, their class, by the last byte, is found within it like a word, and the other bytes follow
from the last to the first by the byte pairs of all such words of the corpus.  Every word has a probability of its own, and those of
all strings add up to 1.  A document's pseudo-log-likelihood is the sum over its words of
log P(word | both sides).

What is gathered: texts are read twice, once for the counts and once to be written as word numbers.  Training is
in numpy, in the tasks: the rows are dealt into shards by a hash of id and words, each shard in the order of that
hash, so that the result depends on the rows and not on how they were split.  Each shard trains a copy of the network by Adagrad
on windows of all its documents, and the copies are averaged, weighted by their windows, in ``rounds``
rounds.  A round takes every ``stride``-th place, from an offset by the text's hash and the round; as many
rounds as the stride, or more, make every word a target.  A shard has about ``SHARD_WORDS`` words, or
``WORDS_A_ROW`` for each word of the vocabulary if that is more: so copies stay small beside what they learn
from.  Vocabulary and averaged parameters reach the driver (10**13 words: 630,000 words, 100 MB).

Defined cases: a null or wordless text has no words and the score 0; places past a text's ends
are word 0; an empty corpus leaves the network untrained; repeated rows get the same score, up to rounding.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from paysift.llm.common import bounded_batches, written

SIDE, WIDTH, HIDDEN = 2, 16, 24
VOCABULARY, SPELLED = 4, 48
SHARD_WORDS, WORDS_A_ROW = 2_000_000, 500
STRIDE, ROUNDS, RATE, BATCH, LEAST_BATCH = 2, 2, 0.15, 8192, 256
BLOCK = 4096  #: parameters a row, where copies are averaged
WORD = re.compile(r"\w+|[^\w\s]")
START = 256  #: what a word's first byte follows


@dataclass
class Vocabulary:
    """The words with a number of their own, from 1, most frequent first, and how others are spelled."""

    words: list[str]
    counts: np.ndarray       # of words, then of the SPELLED classes
    class_of: np.ndarray     # last byte -> class
    last: np.ndarray         # last byte -> log P(last byte | class)
    back: np.ndarray         # (byte, byte before it or START) -> log P(before | byte)
    numbers: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.numbers = {w: i for i, w in enumerate(self.words, 1)}

    def spellings(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number, log P(spelling | number)) of words outside the vocabulary."""
        b = np.frombuffer("\n".join([*words, ""]).encode("utf-8", "surrogatepass"), np.uint8).astype(np.intp)
        ends = np.flatnonzero(b == 10)  # no word holds a line's end
        begins = np.concatenate([[0], ends[:-1] + 1])
        before = np.concatenate([[START], b[:-1]])
        before[begins] = START
        p = self.back[np.minimum(b, 255), before]
        p[ends] = self.last[b[ends - 1]]
        return 1 + len(self.words) + self.class_of[b[ends - 1]], np.add.reduceat(p, begins)


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' runs without white space of ASCII, one after another, and how many each text has; no word spans white space."""
    found = pc.ascii_split_whitespace(texts.cast(pa.string()), max_splits=-1)
    return found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)


class Codes:
    """The numbers of texts' words; what chunks without white space come to is kept, for about ``most`` of them."""

    def __init__(self, vocab: Vocabulary, most: int = 1_000_000):
        self.vocab, self.most = vocab, most
        self.numbers = {**vocab.numbers, "\n": -1}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # chunk -> place in begin, length and spelled
        self.letters = 0
        self.flat, self.begin, self.length, self.spelled = np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def learn(self, chunks: list[str]) -> None:
        """Finds the words of all ``chunks`` together."""
        text = "\n".join([*chunks, ""]).lower()
        words = re.findall(WORD.pattern + "|\n", text)
        numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        p = np.zeros(len(words))
        if len(other := np.flatnonzero(numbers == 0)):
            numbers[other], p[other] = self.vocab.spellings([words[i] for i in other.tolist()])
        ends = np.flatnonzero(numbers == -1)
        begin = np.concatenate([[0], ends[:-1] + 1])
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.letters += len(text)
        self.begin = np.concatenate([self.begin, begin + len(self.flat)])
        self.length = np.concatenate([self.length, ends - begin])
        self.spelled = np.concatenate([self.spelled, np.add.reduceat(p, begin)])
        self.flat = np.concatenate([self.flat, numbers.astype("<i4")])

    def found(self, chunks: list[str], place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of texts' words, one text after another, where each text ends, and the sums of its spellings' logarithms.  The texts
        have ``counts`` chunks, which are at ``place`` of the different ``chunks``."""
        if len(self.known) >= self.most or self.letters >= 32 * self.most:
            self.clear()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(new := np.flatnonzero(at < 0)):
            at[new] = len(self.known) + np.arange(len(new))
            self.learn([chunks[i] for i in new.tolist()])
        at = at[place]
        length = self.length[at]
        upto = np.concatenate([[0], np.cumsum(length)])
        numbers = self.flat[np.repeat(self.begin[at] - upto[:-1], length) + np.arange(upto[-1])]
        return numbers, upto[np.cumsum(counts)], np.bincount(np.repeat(np.arange(len(counts)), counts), self.spelled[at], len(counts))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``found`` gives, of a batch of texts."""
        chunks, counts = chunks_of(texts)
        coded = chunks.dictionary_encode()
        return self.found(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), counts)

    def encode(self, texts: Iterable[str | None], at_once: int = 200_000) -> Iterator[tuple[np.ndarray, float]]:
        """(numbers of the words, sum of their spellings' logarithms) of each text; texts needn't have a form in UTF-8."""
        chunks: list[str] = []
        counts: list[int] = []

        def told() -> Iterator[tuple[np.ndarray, float]]:
            place: dict[str, int] = {}
            at = np.array([place.setdefault(c, len(place)) for c in chunks], np.int64)
            numbers, ends, spelled = self.found(list(place), at, np.array(counts))
            yield from zip(np.split(numbers, ends[:-1]), spelled.tolist())

        for text in texts:
            new = (text or "").split()
            chunks += new
            counts.append(len(new))
            if len(chunks) >= at_once:
                yield from told()
                chunks, counts = [], []
        if counts:
            yield from told()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of every word of the corpus, counted by each task and summed by a shuffle; written."""
    bounded_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, int] = {}
        letters = 0

        def counted() -> pa.RecordBatch:
            words: dict[str, int] = {}
            for chunk, n in chunks.items():
                for w in WORD.findall(chunk.lower()):
                    words[w] = words.get(w, 0) + n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            values, counts = chunks_of(batch.column(0))[0].value_counts().flatten()
            for chunk, n in zip(values.to_numpy(zero_copy_only=False).tolist(), counts.to_numpy(zero_copy_only=False).tolist()):
                chunks[chunk] = chunks.get(chunk, 0) + n
            letters += batch.nbytes
            if len(chunks) > 300_000 or letters > 64 << 20:
                yield counted()
                letters = 0
        yield counted()

    counts = docs.select(docs[text_col].alias("text")).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts, "lm-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary that ``counts`` make, and the byte pairs of all other words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(round(VOCABULARY * total ** 0.4)).collect()
    rest = counts.where((F.col("n") < top[-1]["n"]) | (F.col("n") == top[-1]["n"]) & (F.col("word") > top[-1]["word"])) if top else counts

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((257, 257), np.int64)  # the byte after the last one is 256 too
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"]):
                b = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                np.add.at(seen, (np.append(b, 256), np.append(START, b)), n)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"pair": at, "n": seen.ravel()[at]})

    seen = np.zeros(257 * 257)
    for r in rest.mapInPandas(pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 257 * 257
        seen[r["pair"]] = r["n"]
    seen = seen.reshape(257, 257)
    lasts = seen[256, :256] + 0.5
    order = np.argsort(-lasts, kind="stable")
    class_of = np.full(256, SPELLED - 1)
    class_of[order[:SPELLED - 1]] = np.arange(SPELLED - 1)
    of_class = np.bincount(class_of, lasts, SPELLED)
    back = seen[:256] + 0.01
    return Vocabulary([r["word"] for r in top], np.array([r["n"] for r in top] + list(of_class), float), class_of,
                      np.log(lasts / of_class[class_of]), np.log(back / back.sum(axis=1, keepdims=True)))


@dataclass
class Network:
    """Parameters, and where each group of words begins."""

    starts: np.ndarray       # first number of each group, and the number past the last
    group: np.ndarray        # number -> group; of 0, which is past a text's ends, -1
    embed: np.ndarray        # (numbers, WIDTH)
    mix: np.ndarray          # (2 * SIDE, WIDTH, HIDDEN)
    bias: np.ndarray         # HIDDEN
    head: np.ndarray         # (HIDDEN, groups)
    head_prior: np.ndarray   # groups
    leaf: np.ndarray         # (numbers, HIDDEN)
    leaf_prior: np.ndarray   # numbers

    NAMES = ("embed", "mix", "bias", "head", "head_prior", "leaf", "leaf_prior")

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded neighbours (n, 2 * SIDE * WIDTH) and the hidden layer, of windows (n, 2 * SIDE)."""
        x = self.embed.take(around.ravel(), axis=0).reshape(len(around), -1)
        h = x @ self.mix.reshape(-1, self.mix.shape[2])
        h += self.bias
        return x, np.tanh(h, out=h)

    def segments(self, group: np.ndarray) -> Iterator[tuple[int, int, slice]]:
        """(from, to, numbers) of the runs of equal groups of more than one number; ``group`` is sorted."""
        ends = np.cumsum(np.bincount(group, minlength=len(self.starts) - 1)).tolist()
        starts = self.starts.tolist()
        for lo, hi, first, after in zip([0, *ends], ends, starts, starts[1:]):
            if hi > lo and after - first > 1:
                yield lo, hi, slice(first, after)

    def by_group(self, around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order by group, and windows, targets and groups in it."""
        group = self.group.take(target)
        order = np.argsort(group, kind="stable")
        return order, around.take(order, axis=0), target.take(order), group.take(order)

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(number | both sides) of each place."""
        order, around, target, group = self.by_group(around, target)
        _, h = self.hidden(around)
        found, small = _log_softmax(h, self.head.T, self.head_prior, group, _within(self.head.T, self.head_prior)), _within(self.leaf, self.leaf_prior)
        for lo, hi, words in self.segments(group):
            found[lo:hi] += _log_softmax(h[lo:hi], self.leaf[words], self.leaf_prior[words], target[lo:hi] - words.start, small)
        out = np.empty(len(found))
        out[order] = found
        return out

    def gradients(self, around: np.ndarray, target: np.ndarray) -> Iterator[tuple[str, object, np.ndarray]]:
        """(name, rows, gradient) of the mean of -log P; what is given no more is needed by the next ones."""
        n = np.float32(len(target))
        _, around, target, group = self.by_group(around, target)
        x, h = self.hidden(around)
        ones = np.ones(len(h), h.dtype)
        d = _errors(h, self.head.T, self.head_prior, group, n, _within(self.head.T, self.head_prior))
        dh = d @ self.head.T
        yield "head", slice(None), h.T @ d
        yield "head_prior", slice(None), ones @ d
        leaf, prior, small = np.zeros(self.leaf.shape, h.dtype), np.zeros(self.leaf_prior.shape, h.dtype), _within(self.leaf, self.leaf_prior)
        for lo, hi, words in self.segments(group):
            d = _errors(h[lo:hi], self.leaf[words], self.leaf_prior[words], target[lo:hi] - words.start, n, small)
            dh[lo:hi] += d @ self.leaf[words]
            np.matmul(d.T, h[lo:hi], out=leaf[words])
            np.matmul(ones[lo:hi], d, out=prior[words])
        yield "leaf", slice(None), leaf
        yield "leaf_prior", slice(None), prior
        dh *= 1 - h * h
        dx = (dh @ self.mix.reshape(-1, self.mix.shape[2]).T).reshape(-1, self.embed.shape[1])
        yield "mix", slice(None), (x.T @ dh).reshape(self.mix.shape)
        yield "bias", slice(None), ones @ dh
        # neighbours' gradients summed by number: one sorted pass instead of scattered adds
        ids = around.ravel().astype(np.uint16 if len(self.embed) < 1 << 16 else np.uint32)
        order = np.argsort(ids, kind="stable")
        ids = ids.take(order)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        pairs = dx.take(order, axis=0).view(f"c{2 * dx.itemsize}")  # two elements are added at once
        yield "embed", ids[first], np.add.reduceat(pairs, first, axis=0).view(dx.dtype)

    def log_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """The sum over each text's words, in windows of bounded number that texts share."""
        gap = np.zeros(SIDE, np.int64)
        c = np.concatenate([gap, *(part for t in texts for part in (t, gap))])
        at = np.flatnonzero(c)
        of_text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        total = np.zeros(len(texts))
        for lo in range(0, len(at), BATCH):
            part = at[lo:lo + BATCH]
            total += np.bincount(of_text[lo:lo + BATCH], self.log_probabilities(_around(c, part), c[part]), len(texts))
        return total


def _within(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether no power of a score ``w @ h + b`` overflows or vanishes, as all of h is within 1."""
    return bool((np.abs(w) @ np.ones(w.shape[1], w.dtype) + np.abs(b)).max() < 60)


def _powers(h: np.ndarray, w: np.ndarray, b: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the scores ``h @ w.T + b``, up to a factor by row, and their sums by row."""
    z = h @ w.T
    z += b
    if not small:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def _log_softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray, small: bool) -> np.ndarray:
    e, sums = _powers(h, w, b, small)
    return np.log(np.maximum(e[np.arange(len(target)), target], 1e-37) / sums)


def _errors(h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray, n: np.float32, small: bool) -> np.ndarray:
    """The softmax of the scores less 1 at the targets, over ``n``."""
    e, sums = _powers(h, w, b, small)
    sums *= n
    e *= np.reciprocal(sums, out=sums)[:, None]
    e[np.arange(len(target)), target] -= 1 / n
    return e


def _around(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the neighbours of the places ``at``; the texts have gaps of 0 between them."""
    return np.stack([padded.take(at + k) for k in range(-SIDE, SIDE + 1) if k], axis=1)


def new_network(vocab: Vocabulary, seed: int = 0) -> Network:
    """An untrained network over the vocabulary, which predicts the words' shares."""
    v, counts = len(vocab.words), np.maximum(vocab.counts, 0.5)
    share = np.cumsum(counts[:v]) - counts[:v]
    cut = np.floor(share * np.ceil(np.sqrt(v)) / max(1.0, counts[:v].sum())).astype(np.int64)
    starts = 1 + np.concatenate([np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]) if v else np.zeros(0, np.int64), [v, v + SPELLED]])
    group = (np.searchsorted(starts, np.arange(v + SPELLED + 1), "right") - 1).astype(np.int16 if len(starts) < 1 << 15 else np.int64)  # 16 bits sort fast
    of_group = np.bincount(group[1:], counts, len(starts) - 1)
    r = np.random.default_rng(seed)
    f = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
    return Network(starts, group, f(len(group), WIDTH), f(2 * SIDE, WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), f(HIDDEN, len(of_group)),
                   np.log(of_group / of_group.sum()).astype(np.float32), np.zeros((len(group), HIDDEN), np.float32),
                   np.concatenate([[0], np.log(counts / of_group[group[1:]])]).astype(np.float32))


class Trainer:
    """Adagrad on batches of windows; batches grow with what was seen."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net = replace(net, **{k: getattr(net, k).copy() for k in Network.NAMES})
        self.rate, self.seen = rate, 0
        self.clear()
        self.sums = {k: np.full_like(getattr(net, k), 0.1) for k in Network.NAMES}

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        for name, rows, g in self.net.gradients(around, target):
            sums = self.sums[name]
            total = sums[rows]  # a view of a slice, a copy of numbered rows
            total += g * g
            if not isinstance(rows, slice):
                sums[rows] = total
            g /= np.sqrt(total)
            g *= np.float32(self.rate)
            getattr(self.net, name)[rows] -= g
        self.seen += len(target)

    def learn(self) -> None:
        """Steps over all windows held."""
        if self.held:
            c, at = np.concatenate(self.texts), np.concatenate(self.places)
            a, t, lo = _around(c, at), c.take(at), 0
            while lo < len(t):
                n = min(BATCH, max(LEAST_BATCH, self.seen // 16))
                self.step(a[lo:lo + n], t[lo:lo + n])
                lo += n
        self.clear()

    def clear(self) -> None:
        gap = np.zeros(SIDE, np.int64)
        self.texts: list[np.ndarray] = [gap]
        self.places: list[np.ndarray] = []
        self.length, self.held = SIDE, 0

    def read(self, c: np.ndarray, at: np.ndarray) -> None:
        """Takes the places ``at`` of a text, in rising order, a bounded number at a time."""
        for lo in range(0, len(at), 4 * BATCH):
            part = at[lo:lo + 4 * BATCH]
            first = max(0, int(part[0]) - SIDE)
            near = c[first:int(part[-1]) + SIDE + 1]
            self.places.append(part + (self.length - first))
            self.texts += [near, np.zeros(SIDE, np.int64)]
            self.length += len(near) + SIDE
            self.held += len(part)
            if self.held >= 4 * BATCH:
                self.learn()


def encoded(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, spelled): the words as little-endian 32-bit numbers, and the logarithm of their spellings; written."""
    bounded_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(vocab)
        for batch in batches:
            numbers, ends, spelled = codes.encode_array(batch.column(1))
            offsets = np.concatenate([[0], 4 * ends])
            words = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(numbers)])
            yield pa.RecordBatch.from_arrays([batch.column(0), words.cast(pa.binary()), pa.array(spelled)], ["doc_id", "words", "spelled"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("words", BinaryType()), StructField("spelled", DoubleType())])
    return written(rows.mapInArrow(task, schema), "lm-words")


def _numbers(words: bytes) -> np.ndarray:
    return np.frombuffer(words, "<i4").astype(np.int64)


def places(text: bytes, n: int, stride: int, turn: int) -> np.ndarray:
    """The places among a text's ``n`` that the round ``turn`` trains on; ``stride`` rounds take each once."""
    return np.arange((zlib.crc32(text[:64]) + turn) % stride, n, stride)


def train(words: DataFrame, vocab: Vocabulary, stride: int = STRIDE, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> Network:
    """A network from ``words`` as ``encoded`` makes them."""
    total = (words.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0) // 4
    net, n = new_network(vocab), max(1, -(-total // max(shard_words, WORDS_A_ROW * len(vocab.words))))
    for turn in range(rounds):
        net = _averaged(words, net, int(n), stride, turn)
    return net


def _averaged(words: DataFrame, net: Network, n_shards: int, stride: int, turn: int) -> Network:
    def told(shard: int, trainer: Trainer) -> pd.DataFrame:
        trainer.learn()
        flat = np.concatenate([getattr(trainer.net, k).ravel() for k in Network.NAMES])
        parts = [flat[lo:lo + BLOCK].astype("<f4").tobytes() for lo in range(0, len(flat), BLOCK)] if trainer.seen else []
        return pd.DataFrame({"block": range(len(parts)), "some": shard // 256, "shard": shard, "n": trainer.seen, "w": pd.Series(parts, dtype=object)})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = trainer = None
        for batch in batches:
            for s, text in zip(batch["shard"], batch["words"]):
                if s != shard:
                    if trainer:
                        yield told(shard, trainer)
                    shard, trainer = s, Trainer(net)
                c = _numbers(text)
                trainer.read(c, places(text, len(c), stride, turn))
        if trainer:
            yield told(shard, trainer)

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")  # sums of floats in one order
        total = sum(np.frombuffer(w, "<f4").astype(np.float64) * n for w, n in zip(rows["w"], rows["n"]))
        n = rows["n"].sum()
        return rows.head(1).assign(n=n, w=(total / n).astype("<f4").tobytes())

    schema = "block int, some int, shard int, n long, w binary"
    key = F.xxhash64("doc_id", "words")
    dealt = words.select("words", key.alias("key")).withColumn("shard", F.pmod("key", F.lit(n_shards)).cast("int"))
    copies = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "key", "words").mapInPandas(task, schema)
    rows = (copies.groupBy("block", "some").applyInPandas(mean, schema).groupBy("block").applyInPandas(mean, schema)
            .select("block", "w").collect())  # the averaged parameters
    if not rows:
        return net
    flat, at, new = np.frombuffer(b"".join(bytes(r["w"]) for r in sorted(rows)), "<f4"), 0, {}
    for k in Network.NAMES:
        old = getattr(net, k)
        new[k] = flat[at:at + old.size].reshape(old.shape).copy()
        at += old.size
    return replace(net, **new)


def scored(words: DataFrame, net: Network) -> DataFrame:
    """Per row of ``words``: doc_id, n_words, log_likelihood, and its mean a word (null without
    words)."""
    @F.pandas_udf("double")
    def score(words: pd.Series) -> pd.Series:
        return pd.Series(net.log_likelihoods([_numbers(w) for w in words]), dtype="float64")

    n = (F.octet_length("words") / 4).cast("long")
    s = words.select("doc_id", n.alias("n_words"), (score("words") + F.col("spelled")).alias("log_likelihood"))
    return s.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Trains on all of ``docs`` and scores them all."""
    vocab = vocabulary(word_counts(docs, text_col))
    words = encoded(docs, vocab, id_col, text_col)
    return scored(words, train(words, vocab, **settings))
