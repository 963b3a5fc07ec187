"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: 64 bits from the XXH64 (seed 42) of word shingles, repeats included; a bit is 1
if it is set in over half the hashes.  Two fingerprints link at ``max_bits`` or fewer
differing bits.

Blocks: the 64 bits are split into ``n_blocks`` parts.  At most ``max_bits`` of them can hold a
differing bit, so a close pair agrees on at least ``n_blocks - max_bits`` whole parts.  Each
fingerprint is keyed by every choice of that many parts; close pairs meet under a shared key
and their Hamming distance is verified.  More blocks give longer keys, so fewer chance
meetings: 5 blocks (10 keys of 25 bits) suit up to some 10^8 different fingerprints, 7 (35 keys
of 36 bits) billions.  The result is the same for any number.

Skew: equal fingerprints are merged before any key is made.  Keys with over ``cold`` members
are not joined: their members are dealt to chunks, and each pair of chunks is compared in a
task of its own, which returns a spanning forest of the links instead of every pair.  No
fingerprint or link is dropped.

Defined cases: a null or wordless text has fingerprint zero; a text of fewer words than a
shingle hashes its whole word sequence; repeated rows are rows of one component; null ids
never are a component's id unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import bounded_batches, fresh, small_side, written

SHINGLE, MAX_BITS, N_BLOCKS = 3, 3, 5
COLD, CHUNK = 24, 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return _signed(hashed(b" ".join(words), 42))
    line = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = np.fromiter((hashed(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1:])), np.uint64, len(words) - shingle + 1)
    return _signed(_majority(h))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):  # a bit matrix of bounded size, however long the text
        ones += np.unpackbits(h[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row: id, text_hash and the fingerprint ``fp`` (signed long)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fp(text_col).alias("fp"))


def block_keys(max_bits: int, n_blocks: int) -> list[int]:
    """A bit mask for each choice of ``n_blocks - max_bits`` parts."""
    edges = [64 * b // n_blocks for b in range(n_blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(choice)) for choice in combinations(parts, n_blocks - max_bits)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, n_blocks: int = N_BLOCKS) -> DataFrame:
    """Edges (a < b) between different fingerprints, a column ``fp`` of distinct values, that
    connect just those that links of ``max_bits`` connect."""
    if not max_bits < n_blocks <= 64:
        raise ValueError("n_blocks must be over max_bits and at most 64")
    masks = block_keys(max_bits, n_blocks)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)]))
    keyed = fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.v")
    shared = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(shared, ["t", "v"]), "simhash-keys")
    a, b = met.where(F.col("n") <= COLD).alias("a"), met.where(F.col("n") <= COLD).alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    cold = (a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")) & near)
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    n_chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    hot = (met.where(F.col("n") > COLD)
           .withColumn("c", F.pmod(F.xxhash64("fp", "t"), n_chunks))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)))
           .select("t", "v", "fp", "c", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi")))

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows["fp"].to_numpy(np.int64))
        return pd.DataFrame(_forest(x, max_bits), columns=["a", "b"], dtype="int64")

    return cold.unionByName(hot.groupBy("t", "v", "lo", "hi").applyInPandas(forest, "a long, b long")).distinct()


def _forest(x: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A breadth-first spanning forest of the links among ``x``, a bounded chunk."""
    u, left, found = x.view(np.uint64), np.ones(len(x), bool), []
    while left.any():
        first = int(np.argmax(left))
        left[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            new = rest[np.bitwise_count(u[rest] ^ u[at]) <= max_bits]
            left[new] = False
            found += [(min(x[at], x[j]), max(x[at], x[j])) for j in new]
            queue += new.tolist()
    return found


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root its component's least node.

    Large-star and small-star rounds: every round joins each node's neighbours to the least of
    them, and the number of rounds grows with the logarithm of the component's size.  Nothing
    but the count of changed edges reaches the driver."""
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")), "cc-least")  # written, so that a join on a hub can be split
        large = (both.where("b > a").join(least, "a")
                 .select(F.least("a", "m").alias("a"), "b").where("a < b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        new = written(large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x"))
                      .select("x.*").where("a < b").distinct(), "cc-edges")
        # a star forest: every edge starts at a node that ends none
        centre_ends = new.select("a").distinct().join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        twice = new.groupBy("b").count().where("count > 1")
        e = new
        if centre_ends.isEmpty() and twice.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, n_blocks: int = N_BLOCKS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the least id
    reachable over links), then text_hash and root (the component's least fingerprint)."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = written(components(links(first.select("fp"), max_bits, n_blocks)), "simhash-roots")
    named = (first.join(roots, first["fp"] == roots["node"], "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("fp", "root", "component_id")
    return (marked.join(of, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each component: that with the least id; of equal rows, one."""
    found = near_duplicates(docs, id_col, text_col, **settings)
    pairs = written(found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("component_id").alias("least")), "simhash-rows")
    chosen = (pairs.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("root")
              .agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("x")).select("root", "x.*"))
    chosen = written(chosen, "simhash-chosen")
    other = pairs.alias("p").join(chosen.alias("c"), (F.col("p.root") == F.col("c.root")) & F.col("p.doc_id").eqNullSafe(F.col("c.doc_id"))
                                  & (F.col("p.text_hash") == F.col("c.text_hash")), "left_anti").select("doc_id", "text_hash")

    def meeting(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        at = (F.xxhash64(docs[text_col]) == keys["text_hash"]) & docs[id_col].eqNullSafe(keys["doc_id"])
        return left.join(keys, at, how)

    kept = meeting(docs, small_side(written(other, "simhash-other"), 17), "left_anti")
    # a chosen row that is repeated stays once; where none is, nothing more is done
    again = chosen.where("n > 1").select("doc_id", "text_hash")
    if again.isEmpty():
        return kept
    side = small_side(written(again, "simhash-again"), 17)
    id_key, hash_key = fresh(docs, "_id"), fresh(docs, "_hash")
    once = (meeting(kept, side, "left_semi").withColumn(id_key, docs[id_col]).withColumn(hash_key, F.xxhash64(docs[text_col]))
            .dropDuplicates([id_key, hash_key]).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return meeting(kept, side, "left_anti").unionByName(once)

