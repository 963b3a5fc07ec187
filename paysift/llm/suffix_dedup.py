"""Exact repeated-substring removal by a suffix sort: deep-shallow sorting of the suffixes that can repeat.

A byte is removed if it lies in a ``LENGTH``-byte string that also starts earlier (in a document with a smaller
id, or earlier in its own).  So suffixes are compared in their first ``LENGTH`` bytes, and those equal to their
neighbour in sorted order, all but the first by (document, start), mark what they cover.

Which suffixes meet.  The ``GRAM``-byte string of least hash among those in a suffix's first ``LENGTH`` bytes is its
anchor: equal strings have equal anchors at equal distances, so suffixes need to be compared only with those of the same anchor.
Consecutive starts that share an anchor are a segment, one row.  Then, in order:

1. anchors that occur once are set aside by a count (nothing there can repeat);
2. segments that are equal as a whole are merged: every start in all but the first of them is a repeat;
3. the different segments of an anchor are cut out of their texts and their suffixes sorted in tasks of
   bounded size: multikey quicksort over 8-byte characters down to ``SHALLOW`` bytes, then a blind
   trie for each group that is still equal there.

Skew: what is equal is merged before it is shuffled or by partial aggregates.  An anchor with over ``HOT`` different
segments (the edge of a passage in a third of all documents) isn't sorted in one task: its segments are sorted in
slices of the input first, the repeats found there are settled, and the suffixes that are left, one of each kind and slice, are
dealt by a hash of their ``LENGTH`` bytes and sorted again.  No suffix is dropped.

Defined cases: a null text is empty and has nothing removed; rows that repeat as a whole (id and text) are one
document, and each of the rows gets its result; different texts under one id come in the order of their sha256;
a null id comes before all others; ids of any type that can be ordered will do; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import bounded_batches, fresh, small_side, written
from paysift.operators.ranking import row_numbers

LENGTH, GRAM, SHALLOW = 100, 32, 24
HOT, SHARD, SLICE = 8192, 400_000, 200_000
PIECE = 256 << 10

_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


# Anchors and segments -------------------------------------------------------------------------------------------------

def _anchors(buf: np.ndarray, length: int, gram: int, power: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start whose ``length`` bytes fit in ``buf`` the position of its anchor; the hash of every gram."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * back[:n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    # the least hash of each window, and of equal ones the first: the low bits hold the place
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    w = length - gram + 1
    blocks = np.concatenate([key, np.full(-len(h) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:len(h) - w + 1], ahead[w - 1:len(h)])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64), h


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, from byte, to byte): runs of whole rows of about ``PIECE`` bytes, and
    overlapping parts of a longer row; every start lies in one of them with all its bytes."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        for at in range(lo, max(lo + 1, hi - length + 1), PIECE) if j == i + 1 else [lo]:
            yield i, j, at, min(hi, at + PIECE + length - 1) if j == i + 1 else hi
        i = j


def segments(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM,
             named: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts that lie at ``offsets`` in ``data``: (anchor's hash, segment's hash, row, first start in the row, number of
    starts), arrays for each piece; without ``named`` only the first."""
    power = np.cumprod(np.full(PIECE + length, np.uint64(_ODD)))
    back = np.cumprod(np.full(PIECE + length, np.uint64(_BACK)))
    digest = xxhash.xxh3_64_intdigest
    for i, j, lo, hi in _pieces(offsets, length):
        if hi - lo < length:
            continue
        buf = data[lo:hi]
        anchor, h = _anchors(buf, length, gram, power, back)
        start = np.arange(len(anchor))
        row = np.searchsorted(offsets[i:j + 1] - lo, start, side="right") - 1 + i
        fits = start + length <= offsets[row + 1] - lo
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new & fits)
        hashes = h[anchor[first]].view(np.int64)
        if not named:
            yield (hashes,)
            continue
        run = np.cumsum(new) - 1
        count = np.bincount(run[fits], minlength=run[-1] + 1)[run[first]]
        whole = buf.tobytes()
        names = np.fromiter((digest(whole[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist())), np.uint64, len(first))
        yield hashes, names.view(np.int64), row[first], first + lo - offsets[row[first]], count


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


# The sort -------------------------------------------------------------------------------------------------------------

def shallow_sort(buf: np.ndarray, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at ``pos`` by their first ``depth`` bytes, a character being 8 bytes: sorted by
    the first, the groups that share it by the next, and so on.  Returns the order, and for each place in it whether the
    suffix there equals the one before in those bytes."""
    words = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))
    order, tied = np.arange(len(pos)), np.ones(len(pos), bool)
    tied[:1] = False
    at = np.arange(len(pos))  # the places whose groups aren't settled
    for d in range(0, depth, 8):
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        word = words[pos[order[at]] + d].astype(np.uint64)
        by = np.lexsort((word, group))
        order[at], word = order[at][by], word[by]
        tied[at[1:]] &= word[1:] == word[:-1]
        # a place stays if it is tied to the one before or the one after
        open_ = tied[at].copy()
        open_[:-1] |= tied[at[1:]] & (at[1:] == at[:-1] + 1)
        at = at[open_]
    return order, tied


class BlindTrie:
    """Strings of one length in order.  A branching holds the place of the first differing byte and its
    children by that byte; what lies between branchings isn't stored.  A string goes down blindly to some leaf, one comparison
    there gives its true longest common prefix, and it branches off at that place.  Equal strings share a leaf."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, s: bytes, item: int) -> None:
        node = self.root
        if node is None:
            self.root = [-1, s, [item]]
            return
        while node[0] >= 0:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        other = node[1]
        if other == s:
            node[2].append(item)
            return
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        at = len(s) - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while 0 <= node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        leaf = [-1, s, [item]]
        if node[0] == at:
            node[1][s[at]] = leaf
            return
        branch = [at, {other[at]: node, s[at]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """The items of each leaf, in the order of their strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def deep_shallow(buf: np.ndarray, pos: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``pos``, each with ``length`` bytes in ``buf``, in the order of those bytes: the order, and for each place
    in it whether the suffix there equals the one before.  Equal ones keep the order of ``pos``."""
    shallow = min(shallow, length // 8 * 8)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    order, tied = shallow_sort(padded, pos, shallow)
    if shallow == length or not len(pos):
        return order, tied
    whole = padded.tobytes()
    heads = np.flatnonzero(~tied)
    sizes = np.diff(np.append(heads, len(pos)))
    _sort_pairs(padded, pos, order, tied, heads[sizes == 2], shallow, length)
    for head, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        items = order[head:head + size]
        trie = BlindTrie()
        for item, p in zip(items.tolist(), pos[items].tolist()):
            trie.add(whole[p + shallow:p + length], item)
        sorted_, same = [], []
        for leaf in trie.leaves():
            sorted_ += sorted(leaf)
            same += [False] + [True] * (len(leaf) - 1)
        order[head:head + size] = sorted_
        tied[head:head + size] = same
    return order, tied


def _sort_pairs(buf: np.ndarray, pos: np.ndarray, order: np.ndarray, tied: np.ndarray, heads: np.ndarray, shallow: int, length: int) -> None:
    """Groups of two: a trie of two leaves is one comparison, here of all such groups at once."""
    words = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))
    a, b = order[heads], order[heads + 1]
    less, same = np.zeros(len(heads), bool), np.ones(len(heads), bool)
    for d in [*range(shallow, length - 8, 8), length - 8]:
        x, y = words[pos[a] + d].astype(np.uint64), words[pos[b] + d].astype(np.uint64)
        less |= same & (y < x)
        same &= x == y
    order[heads], order[heads + 1] = np.where(less, b, a), np.where(less, a, b)
    tied[heads + 1] = same


def repeats(buf: np.ndarray, pos: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """For suffixes in the order of the corpus: whether an earlier one has the same ``length`` bytes."""
    order, tied = deep_shallow(buf, pos, length, shallow)
    out = np.zeros(len(pos), bool)
    out[order[tied]] = True
    return out


def _covered(k: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """The spans of bytes that the repeats at (k, start), in order, cover; touching ones as one."""
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (start[1:] > start[:-1] + length)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(k)) - 1
    return pd.DataFrame({"k": k[head], "lo": start[head], "hi": start[last] + length if len(head) else start[head]})


def _suffixes(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, positions, document and start of all suffixes of segments (k, p, body), in the order of the corpus."""
    rows = rows.sort_values(["k", "p"], kind="stable")
    size = rows["body"].map(len).to_numpy(np.int64)
    base, count = np.cumsum(size) - size, size - length + 1
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return (np.frombuffer(b"".join(rows["body"]), np.uint8), np.repeat(base, count) + within,
            np.repeat(rows["k"].to_numpy(np.int64), count), np.repeat(rows["p"].to_numpy(np.int64), count) + within)


# The plan -------------------------------------------------------------------------------------------------------------

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(k, b) for each different document, k a long that orders them, and (k, id, sha) for each row."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("b"))
    if dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"):
        tally = rows.agg(F.count("*").alias("n"), F.count("id").alias("named")).first()
        repeated = rows.groupBy("id").count().where("count > 1").isEmpty() is False
        if tally["n"] == tally["named"] and not repeated:
            keyed = rows.withColumn("k", F.col("id").cast("long"))
            return keyed.select("k", "b"), keyed
    rows = rows.withColumn("sha", F.sha2("b", 256))
    ranked = written(row_numbers(rows.select("id", "sha").distinct(), [F.col("id").asc_nulls_first(), F.col("sha")], "k"), "suffix-keys")
    keyed = (rows.alias("r").join(ranked.alias("n"), F.col("r.id").eqNullSafe(F.col("n.id")) & (F.col("r.sha") == F.col("n.sha")))
             .select("r.id", "b", F.col("k").cast("long").alias("k")))
    return keyed.dropDuplicates(["k"]).select("k", "b"), keyed


def spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k, lo, hi): spans of bytes that repeats cover in ``texts`` (k, b); they may overlap and touch."""
    spark = texts.sparkSession
    bounded_batches(spark)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (h,) in segments(*_buffers(b.column(0)), length, gram, named=False):
                yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            for h, s, row, p, n in segments(*_buffers(b.column(1)), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, s, k[row], p * length + (n - 1))], ["h", "s", "k", "at"])

    shared = written(texts.select("b").mapInArrow(anchors, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-anchors")
    found = written(texts.select("k", "b").mapInArrow(cut, "h long, s long, k long, at long").join(shared.hint("shuffle_hash"), "h"), "suffix-segments")

    # equal segments: all but the first are repeats from end to end
    kinds = written(found.groupBy("h", "s").agg(F.min(F.struct("k", "at")).alias("first"), F.count("*").alias("n"))
                    .select("h", "s", "n", F.col("first.k").alias("k"), F.col("first.at").alias("at")), "suffix-kinds")
    again = kinds.where("n > 1").select("h", "s", F.col("k").alias("k1"), F.col("at").alias("at1"))
    n_starts = F.col("at") % length + 1
    p = F.expr(f"at div {length}")
    whole = (found.join(small_side(written(again, "suffix-again"), 32), ["h", "s"]).where("k != k1 OR at != at1")
             .select("k", p.alias("lo"), (p + n_starts + (length - 1)).alias("hi")))

    # different segments of an anchor
    several = written(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "suffix-several")
    open_ = kinds.join(several, "h").select("h", "m", "k", p.alias("p"), n_starts.alias("c"))
    open_ = written(open_, "suffix-open")
    holders = small_side(written(open_.select("k").distinct(), "suffix-holders"), 8)
    bodies = texts.join(holders, "k", "left_semi").join(open_, "k").select("h", "m", "k", "p", F.expr(f"substring(b, cast(p + 1 as int), cast(c + {length - 1} as int))").alias("body"))
    total = open_.agg(F.sum("c")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    bodies = written(bodies, "suffix-bodies")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        buf, pos, k, start = _suffixes(rows, length)
        hit = repeats(buf, pos, length)
        return _covered(k[hit], start[hit], length)

    cold = (bodies.where(F.col("m") <= hot).select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "k", "p", "body")
            .groupBy("shard").applyInPandas(lambda rows: settle(rows), "k long, lo long, hi long"))
    many = bodies.where(F.col("m") > hot).select("k", "p", "body")
    if many.isEmpty():
        return whole.unionByName(cold)

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Repeats within a slice are settled (body null); of each other kind the first goes on."""
        held, size = [], 0

        def done() -> pd.DataFrame:
            buf, pos, k, start = _suffixes(pd.concat(held), length)
            hit = repeats(buf, pos, length)
            sure = _covered(k[hit], start[hit], length).assign(body=None)
            whole_ = buf.tobytes()
            left = pd.DataFrame({"k": k[~hit], "lo": start[~hit], "body": [whole_[p:p + length] for p in pos[~hit].tolist()]}).assign(hi=lambda x: x["lo"] + length)
            return pd.concat([sure, left])[["k", "lo", "hi", "body"]]

        for b in batches:
            held.append(b)
            size += int((b["body"].map(len) - length + 1).sum())
            if size >= SLICE:
                yield done()
                held, size = [], 0
        if size:
            yield done()

    sliced = written(many.mapInPandas(slices, "k long, lo long, hi long, body binary"), "suffix-slices")
    left = sliced.where("body IS NOT NULL")
    n_left = left.count()
    rest = (left.select(F.pmod(F.xxhash64("body"), F.lit(max(1, -(-n_left // SHARD)))).cast("int").alias("shard"), "k", F.col("lo").alias("p"), "body")
            .groupBy("shard").applyInPandas(lambda rows: settle(rows), "k long, lo long, hi long"))
    return whole.unionByName(cold).unionByName(sliced.where("body IS NULL").select("k", "lo", "hi")).unionByName(rest)


def merged(spans_of: list, size: int) -> list[tuple[int, int]]:
    """Disjoint maximal spans from overlapping or touching ones."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans_of):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, min(hi, size)))
    return out


def cut_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``: the bytes that are left, null where nothing
    was removed."""
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 bytes at least and fits the length")
    texts, rows = _keyed(docs, id_col, text_col)
    found = spans(texts, length, gram, hot).groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    found = written(found, "suffix-spans")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, body, spans_of in zip(b["k"], b["b"], b["spans"]):
                body, runs = bytes(body), merged([(x["lo"], x["hi"]) for x in spans_of], len(body))
                parts, at = [], 0
                for lo, hi in runs:
                    parts.append(body[at:lo])
                    at = hi
                left = b"".join([*parts, body[at:]])
                out.append((k, len(body) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(out, columns=["k", "n_removed", "n_spans", "kept_sha256", "kept"])

    holders = small_side(written(found.select("k"), "suffix-touched"), 8)
    touched = texts.join(holders, "k", "left_semi").join(found, "k").select("k", "b", "spans").mapInPandas(
        kept, "k long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    each = rows.select("id", "k", F.octet_length("b").cast("long").alias("n_bytes"), F.sha2("b", 256).alias("sha"))
    return each.join(touched, "k", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
