"""WARC archives as a chunked record table.

Writing: each task streams its pages into gzip members, one a record, in archives of its own in
a shared folder; the rows it returns name the archives, so that files of a task that was lost
or ran twice are never read.  Of records with equal payloads of at least ``MIN_REVISIT`` bytes,
that with the largest page id is a response and the others are revisits that refer to it.

Reading: each archive is streamed by one task into rows (record, chunk number), a payload of
any length in chunks of at most ``CHUNK`` bytes; the SHA-1 so far goes with each chunk, and with
the last that of the whole payload, checked against the record's header.  Neither a payload
nor an archive is held in memory.

Payloads are never shuffled: of the groups of equal ones only the digest and largest id travel.

Defined cases: a null page is an empty payload; an empty payload has one empty chunk; a null
page id counts as less than any other, and a repeated row of the response is a response too;
a null url has no target header; an empty table gives no archive with records, and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import bounded_batches, small_side, written
from paysift.session import shared_dir

MIN_REVISIT, CHUNK, ARCHIVE_BYTES = 1000, 64 << 10, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = ("path string, record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean")


def record_id(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}").urn


def record_head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The header of a record, and the HTTP header that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    named = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"),
             ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url is not None:  # white space and control characters can't stand in a header
        named.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url)))
    if page_id is not None:
        named.append(("X-Page-ID", str(page_id)))
    if revisit:
        named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>")]
        named += [("X-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []
    named += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if revisit else size)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in named), "\r\n"]).encode() + http


def record_parts(page_id, url, html: str | None, size: int, digest: str, refers_to, revisit: bool) -> Iterator[bytes]:
    yield record_head(page_id, url, size, digest, refers_to, revisit)
    if not revisit:
        for at in range(0, len(html or ""), CHUNK):
            yield html[at:at + CHUNK].encode()
    yield b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record a row; returns (path, n_records, n_bytes) of the archives."""
    bounded_batches(pages.sparkSession)
    text = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), text.alias("html"),
                        F.octet_length(text).cast("long").alias("size"), F.sha1(text).alias("digest"))
    copies = (rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("digest").alias("_digest"), "response_id"))
    copies = written(copies, "warc-copies")
    typed = rows.join(small_side(copies, 64), rows["digest"] == copies["_digest"], "left").select(
        "page_id", "url", "html", "size", "digest", "response_id",
        (F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))).alias("revisit"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        context, made, out, n = TaskContext.get(), [], None, 0
        for batch in batches:
            ids, firsts = batch["page_id"].astype("Int64"), batch["response_id"].astype("Int64")
            for page_id, url, html, size, digest, first, revisit in zip(ids, batch["url"], batch["html"], batch["size"], batch["digest"], firsts, batch["revisit"]):
                if out is None:
                    path = f"{top}/part-{context.partitionId():06d}-{len(made):04d}-{context.taskAttemptId()}.warc.gz"
                    out, n = store.open_output_stream(path, compression=None), 0
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member of its own
                for part in record_parts(_int(page_id), url, html, int(size), digest, _int(first), bool(revisit)):
                    out.write(packer.compress(part))
                out.write(packer.flush())
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    made.append((path, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            made.append((path, n, out.tell()))
            out.close()
        yield pd.DataFrame(made, columns=["path", "n_records", "n_bytes"])

    return written(typed.mapInPandas(task, "path string, n_records long, n_bytes long"), "warc-archives")


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def read_records(stream, payload: bool = True) -> Iterator[tuple]:
    """The chunk rows of an archive, from a file object: ``CHUNKS`` without the path."""
    def headers() -> dict[str, str]:
        found = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            found[key.strip().lower()] = value.strip()
        return found

    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {version[:40]!r}")
        head = headers()
        left = int(head["content-length"])
        http = b""
        while left and not http.endswith(b"\r\n\r\n"):
            line = stream.readline(left)
            http, left = http + line, left - len(line)
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        named = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        ident = lambda key: int(head[key]) if key in head else None
        common = (head["warc-record-id"].strip("<>"), ident("x-page-id"), head.get("warc-target-uri"), head["warc-type"], ident("x-refers-to-page-id"))
        if head["warc-type"] == "revisit":
            yield (*common, int(stated[1]), named, 0, b"", 0, named, True)
            continue
        digest, size, done, k = hashlib.sha1(), left, 0, 0
        while True:
            part = stream.read(min(CHUNK, left))
            if left and not part:
                raise EOFError(f"record {common[0]} ends after {done} of {size} bytes")
            digest.update(part)
            left, done = left - len(part), done + len(part)
            so_far = digest.hexdigest()
            if not left and so_far != named:
                raise ValueError(f"record {common[0]}: its payload has SHA-1 {so_far}, its header {named}")
            yield (*common, size, named, k, part if payload else None, done, so_far, not left)
            k += 1
            if not left:
                break


def read_archives(archives: DataFrame, folder: str, n_tasks: int | None = None, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``archives`` (path) names; ``payload`` False
    leaves the bytes themselves out."""
    bounded_batches(archives.sparkSession)
    columns = [x.split()[0] for x in CHUNKS.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for path in (p for batch in batches for p in batch["path"]):
            rows, held = [], 0
            with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for row in read_records(stream, payload):
                    rows.append((path, *row))
                    held += len(row[8] or b"") + 300
                    if held >= 4 << 20:
                        yield _frame(rows, columns)
                        rows, held = [], 0
            yield _frame(rows, columns)

    n_tasks = n_tasks or min(archives.count() + 1, 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(n_tasks).mapInPandas(task, CHUNKS)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to, then its record_id and the number of chunks."""
    folder = shared_dir(pages.sparkSession, "warc")
    chunks = read_archives(write_archives(pages, folder), folder, payload=False)
    return (chunks.where("last").select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to",
                                        "record_id", (F.col("chunk_no") + 1).alias("n_chunks")))
