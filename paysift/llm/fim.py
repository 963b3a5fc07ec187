"""Fill-in-middle texts by a secondary sort: pieces in, incremental digests out.

Every text is cut into lines; two cut points drawn from the sha256 of the seed and the row's id
divide them into prefix, middle and suffix, and the form says in which order they follow:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle        plain: the text

A row becomes pieces, each a chunk of whole lines (a line over ``CHUNK`` code points becomes several) or a
marker, keyed by (row, output position).  ``repartitionAndSortWithinPartitions`` deals them
by the row and sorts them by position, so that a task streams each output piece by piece into a digest and holds
one piece at a time.  For the restoration the same pieces are keyed anew by (row, section, order) as the output's own
markers tell, and sorted again by the same partitioner: that sort stays within the partition and moves nothing.

Scale: rows are dealt by their place in the input, not by their id, so an id that a third of the rows
share is no hot key; a partition gets about ``TARGET_BYTES`` of text, and Spark's external sorter spills
beyond its memory.  The only shuffle holds the text once.

Defined cases: a null text is an empty one; empty texts and texts that contain a marker are plain, with null
``prefix_chars`` and ``middle_chars``; rows that repeat give a row each; a null id is drawn as the text "null";
any type of id is taken by its text form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The sections that a marker opens, in the order in which the text has them.
SECTION = {PREFIX.encode(): 0, MIDDLE.encode(): 1, SUFFIX.encode(): 2}
CHUNK = 16_384
TARGET_BYTES = 16 << 20
#: Position of a row's description: before all of its pieces.
HEAD = (-1, -1)

_line = re.compile(r"[^\n]*\n|[^\n]+")


def plan(text: str, key: str, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> tuple[str, int, int, int]:
    """(form, number of lines, end of the prefix, end of the middle), the ends in code points."""
    n = text.count("\n") + (text != "" and not text.endswith("\n"))
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return "plain", n, 0, 0
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends, at, k = [], 0, 0
    for cut in cuts:
        while k < cut:
            found = text.find("\n", at)
            at, k = (found + 1 if found >= 0 else len(text)), k + 1
        ends.append(at)
    return ("spm" if h4 % 100 < spm_percent else "psm"), n, ends[0], ends[1]


def chunks(text: str, start: int, end: int, size: int = CHUNK) -> Iterator[bytes]:
    """The span in chunks of whole lines of about ``size`` code points; a longer line is cut."""
    while start < end:
        stop = min(end, start + size)
        if stop < end:
            stop = text.rfind("\n", start, stop) + 1 or stop
        yield text[start:stop].encode()
        start = stop


def pieces(text: str, form: str, prefix_end: int, middle_end: int, size: int = CHUNK) -> Iterator[bytes]:
    """The output of one text, piece by piece; a marker is a piece of its own."""
    if form == "plain":
        yield from chunks(text, 0, len(text), size)
        return
    spans = {PREFIX: (0, prefix_end), SUFFIX: (middle_end, len(text)), MIDDLE: (prefix_end, middle_end)}
    for marker in ((SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)):
        yield marker.encode()
        yield from chunks(text, *spans[marker], size)


def _row(key: tuple) -> int:
    """Deals by the row alone: its partition and its place there."""
    return key[0] * 1_000_003 + key[1]


def emitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_percent: int = 100,
            spm_percent: int = 50, size: int = CHUNK) -> RDD:
    """((partition, place, section, position), value): for each row its description, then its output's pieces."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("k"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).rdd

    def cut(part: int, it: Iterable) -> Iterator:
        for place, (key, text) in enumerate(it):
            form, n, a, b = plan(text, "null" if key is None else key, seed, fim_percent, spm_percent)
            chars = (None, None) if form == "plain" else (a, b - a)
            yield (part, place, *HEAD), (key, n, form, *chars)
            for i, piece in enumerate(pieces(text, form, a, b, size)):
                yield (part, place, 0, i), piece

    return rows.mapPartitionsWithIndex(cut)


def sorted_pieces(keyed: RDD, partitions: int) -> RDD:
    return keyed.repartitionAndSortWithinPartitions(partitions, _row)


def digested(it: Iterable) -> Iterator:
    """From pieces in output order: the description with the output's digest, and each piece of
    text keyed by the section it belongs to, as the markers that went before it say."""
    head, key, section, at = None, None, 0, 0
    digest = hashlib.sha256()

    def closed() -> tuple:
        return (*key, *HEAD), (*head, digest.hexdigest())

    for (part, place, where, _), value in it:
        if (where, _) == HEAD:
            if head is not None:
                yield closed()
            head, key, section, at, digest = value, (part, place), 0, 0, hashlib.sha256()
            continue
        digest.update(value)
        if head[2] != "plain" and value in SECTION:
            section = SECTION[value]
        else:
            yield (*key, section, at), value
            at += 1
    if head is not None:
        yield closed()


def restored(it: Iterable) -> Iterator[tuple]:
    """From pieces in the text's order: (id, n, form, prefix_chars, middle_chars, output digest, digest of the restored text)."""
    head, digest = None, hashlib.sha256()
    for (_, _, section, at), value in it:
        if (section, at) == HEAD:
            if head is not None:
                yield (*head, digest.hexdigest())
            head, digest = value, hashlib.sha256()
        else:
            digest.update(value)
    if head is not None:
        yield (*head, digest.hexdigest())


def _partitions(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    return max(1, -(-size // TARGET_BYTES))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, **settings) -> DataFrame:
    """Per row: the id, its number of lines, form, ``prefix_chars`` and ``middle_chars``, and the digests of the
    output and of the text restored from it."""
    count = partitions or _partitions(docs, text_col)
    out = sorted_pieces(emitted(docs, id_col, text_col, **settings), count)
    again = sorted_pieces(out.mapPartitions(digested, preservesPartitioning=True), count)
    schema = StructType([StructField("_key", StringType()), StructField("n", LongType()), StructField("form", StringType()),
                         StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()),
                         StructField("output_sha256", StringType()), StructField("restored_sha256", StringType())])
    rows = docs.sparkSession.createDataFrame(again.mapPartitions(restored), schema)
    return rows.select(F.col("_key").cast(docs.schema[id_col].dataType).alias(id_col), *schema.names[1:])


def _texts(stream: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    def joined(it: Iterable) -> Iterator[tuple]:
        head, parts = None, []
        for (_, _, where, at), value in stream(it):
            if (where, at) == HEAD:
                if head is not None:
                    yield head[0], head[2], b"".join(parts).decode()
                head, parts = value, []
            else:
                parts.append(value)
        if head is not None:
            yield head[0], head[2], b"".join(parts).decode()
    return joined


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, **settings) -> DataFrame:
    """Per row: the id, the form and the whole output text, for a training set (here a row's text is joined in memory)."""
    out = sorted_pieces(emitted(docs, id_col, text_col, **settings), partitions or _partitions(docs, text_col))
    rows = docs.sparkSession.createDataFrame(out.mapPartitions(_texts(iter)), "_key string, form string, output string")
    return rows.select(F.col("_key").cast(docs.schema[id_col].dataType).alias(id_col), "form", "output")
