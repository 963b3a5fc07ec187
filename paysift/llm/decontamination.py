"""Benchmark decontamination by winnowing, in DataFrame operations only.

A benchmark item's windows are its spans of ``window`` consecutive words; an item of fewer
words, but not none, is one window.  Document words inside any occurrence of a window are hit.

Winnowing: of a window's k-gram hashes the least is kept, on both sides, so a document that
holds a window also keeps that window's fingerprint: no shared span of ``window`` words is
missed.  The kept fingerprints of the documents, about two in each ``window - k + 2`` words, are
joined with the benchmark's; only where one matches are the texts looked at again, and each
hit is extended: the words around it are compared with the words of every item window that
kept this fingerprint, so a chance collision of hashes never counts.

Items shorter than a window have fingerprints of their own, for spans as short as the
shortest of them; both kinds are taken in the same pass over the documents.

The benchmark's fingerprints are broadcast where their measured size allows it, and else
joined by a shuffle; no text is shuffled unless the table of documents with a match is too
large to be broadcast.

Defined cases: a null or wordless text has no words, hits or items; a null or wordless item
has no window; repeated rows get the same result each; an item's repeated id counts once; a
null item id counts as no item, but its words are hit; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import ascii_lower, small_side, written

WINDOW, K = 13, 5
MIN_SHARE_PERCENT = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def grams(hashes: Column, k: int) -> Column:
    """The hash of the k word hashes from each position; the last k - 1 have fewer."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)], F.lit(k)))


def winnowed(g: Column, span: int, k: int) -> Column:
    """The least hash of each window of ``span`` words; the last positions have shorter ones."""
    return F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, span - k + 1)])) if span > k else g


def kept_hashes(w: Column, kinds: list[tuple[int, int]]) -> Column:
    """Distinct winnowed hashes of a text's words, for each (span, k) of ``kinds``."""
    empty = F.array().cast("array<long>")

    def kind(h: Column, span: int, k: int) -> Column:
        return F.when(F.size(h) >= span, _let(grams(h, k), lambda g: winnowed(g, span, k))).otherwise(empty)

    return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.array_distinct(F.concat(*[kind(h, *x) for x in kinds])))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, k: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(item_id, words of the window, its fingerprint and where in the window that begins),
    and the kinds (span, k) that the documents must be winnowed by."""
    w = items.select(items[id_col].alias("item_id"), words(items[text_col]).alias("w")).where("size(w) > 0")
    shortest = w.where(F.size("w") < window).agg(F.min(F.size("w"))).first()[0]
    kinds = [(window, k)] + ([(shortest, min(k, shortest))] if shortest else [])
    long = w.where(F.size("w") >= window).select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.slice("w", i, window))).alias("win"))
    found = _fingerprint(long, window, k)
    if shortest:  # any span of the shortest length inside a short item finds it: take the first
        found = found.unionByName(_fingerprint(w.where(F.size("w") < window).withColumnRenamed("w", "win"), *kinds[1]))
    return found, kinds


def _fingerprint(windows: DataFrame, span: int, k: int) -> DataFrame:
    g = windows.distinct().withColumn("h", F.transform(F.slice("win", 1, span), lambda x: F.xxhash64(x)))
    g = g.withColumn("g", F.slice(grams(F.col("h"), k), 1, span - k + 1))
    return g.select("item_id", "win", F.array_min("g").alias("fp"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("lead"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, k: int = K, min_share: int = MIN_SHARE_PERCENT) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, then item_ids and
    text_hash."""
    found, kinds = item_windows(items, item_id, item_text, window, k)
    marks = written(found, "benchmark-windows")
    keys = written(marks.select("fp").distinct(), "benchmark-fingerprints")
    text = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))

    split = text.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    kept = written(split.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), kept_hashes(F.col("w"), kinds).alias("fps")), "winnowed")
    one = kept.select("doc_id", "text_hash", F.explode("fps").alias("fp"))
    matched = written(one.join(small_side(keys, 8), "fp").groupBy("doc_id", "text_hash").agg(F.collect_set("fp").alias("fps")), "matched")
    match = small_side(matched, F.lit(24) + 8 * F.size("fps"))

    # the words around each matching k-gram: enough for any window that holds it
    again = text.join(match.withColumnRenamed("doc_id", "_id"), (text["text_hash"] == match["text_hash"]) & text["doc_id"].eqNullSafe(F.col("_id"))) \
        .select(text["doc_id"], text["text_hash"], words(F.col("text")).alias("w"), "fps")
    none = F.array().cast("array<struct<at:int,fp:long>>")

    def places(h: Column, q: int) -> Column:
        at = _let(grams(h, q), lambda g: F.transform(g, lambda x, i: F.when(F.array_contains("fps", x), F.struct(i.alias("at"), x.alias("fp")))))
        return F.filter(at, lambda x: x.isNotNull())

    ks = sorted({q for _, q in kinds})
    spots = _let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: F.concat(*[F.when(F.size(h) >= q, places(h, q)).otherwise(none) for q in ks]))
    spot = again.select("doc_id", "text_hash", "w", F.explode(F.array_distinct(spots)).alias("s")) \
        .select("doc_id", "text_hash", "s.at", "s.fp", F.greatest(F.col("s.at") - window, F.lit(0)).alias("from"), "w") \
        .select("doc_id", "text_hash", "at", "fp", "from", F.slice("w", F.col("from") + 1, 2 * window + k).alias("around"))
    start = F.col("at") - F.col("lead")
    hits = (spot.join(small_side(marks, F.lit(32) + F.octet_length(F.array_join("win", "  "))), "fp")
            .where((start >= 0) & (F.slice("around", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.size("win")) == F.col("win")))
            .groupBy("doc_id", "text_hash")
            .agg(F.collect_set(F.struct(start.alias("at"), F.size("win").alias("n"))).alias("spans"), F.collect_set("item_id").alias("item_ids"))
            .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "item_ids",
                    F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))).cast("long").alias("hit")))
    hits = written(hits, "hits")

    rows = kept.drop("fps").join(small_side(hits, F.lit(64) + 8 * F.size("item_ids")), (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    ids = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast(hits.schema["item_ids"].dataType)), lambda x: x.cast("string")))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                       F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                       ((n_hit > 0) & (100 * n_hit >= min_share * F.col("n_words"))).alias("contaminated"), ids.alias("item_ids"), "text_hash")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = (contamination(docs, items, id_col, text_col, **settings).where("contaminated")
           .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    bad = small_side(written(bad, "contaminated"), 24)
    return docs.join(bad, (F.xxhash64(docs[text_col]) == bad["_hash"]) & docs[id_col].eqNullSafe(bad["_id"]), "left_anti")
