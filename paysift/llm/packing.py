"""Best-fit packing of documents into token sequences, with bounded space.

Each task tokenizes its own documents and packs their pieces online, in order: a piece goes
to the open sequence that it fills best.  Open sequences are held by their free space, and the
free spaces in use are the bits of one integer, so the best one is found by a shift and the
lowest set bit.  At most ``n_open`` sequences are open; when one more is needed, the fullest
closes first.  The pieces of sequences still open when a task ends are packed again by the
same method in a second pass, those of ``MERGE`` tasks together, longest first.

Texts aren't shuffled: of the pieces that the second pass takes, at most those of ``n_open``
sequences a task, only the numbers travel (and the ids, where they are asked for).

Defined cases: a null text is empty, and an empty one is its end token alone; a document of
over ``length`` tokens is cut into pieces of ``length``, the first may be shorter; repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import bounded_batches, written

LENGTH, END_ID, N_OPEN = 1024, 2, 512
#: Tasks whose open sequences one task of the second pass takes.
MERGE = 64
#: Runs longer than this are given to the ``tokenizers`` library, whose merging of one run takes
#: no quadratic time.
LONG_RUN = 2000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean"
#: Marks the sequence numbers of the second pass.
SECOND = 1 << 62


class Encoder:
    """Token ids of ``byte_bpe_50k.json``.  The vocabulary and special tokens are read from that file;
    short-run texts are encoded by ``tiktoken``, which gives the same ids four times as fast."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        to_byte = {c: b for b, c in enumerate(_byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self._path, self._whole = path, None
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = frozenset(special)
        self._run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and self._run.search(text):
            if self._whole is None:  # seldom needed, and large
                from tokenizers import Tokenizer
                self._whole = Tokenizer.from_file(self._path)
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self._fast.encode_to_numpy(text, allowed_special=self._special).astype("<u4", copy=False)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others follow from code point 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BestFit:
    """Online best-fit over at most ``n_open`` open bins."""

    def __init__(self, length: int = LENGTH, n_open: int = N_OPEN):
        self.length, self.n_open = length, n_open
        self.bits, self.by_free, self.count, self.made = 0, [[] for _ in range(length + 1)], 0, 0
        #: Bins closed by the last ``place``.
        self.closed: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``size``."""
        self.closed = []
        if roomy := self.bits >> size:
            free = size + (roomy & -roomy).bit_length() - 1
            at = self._take(free)
        else:
            if self.count >= self.n_open:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest
            at, free = self.made, self.length
            self.made += 1
        if free > size:
            self.by_free[free - size].append(at)
            self.bits |= 1 << (free - size)
            self.count += 1
        else:
            self.closed.append(at)
        return at, self.length - free

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        self.count -= 1
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return at


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, size) of a document's pieces."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(rows: Iterable[tuple[object, str | None]], encode, length: int, end_id: int) -> Iterator[tuple]:
    """(id, piece, start, size, crc, ids) of each piece."""
    end = np.array([end_id], "<u4")
    for name, text in rows:
        ids = np.concatenate([encode(text), end]) if text else end
        for k, (start, size) in enumerate(cut(len(ids), length)):
            part = ids[start:start + size]
            yield name, k, start, size, zlib.crc32(part.tobytes()), part


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, end_id: int = END_ID, n_open: int = N_OPEN, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` the token ids."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)
    schema = PIECES + ", ids array<long>" * with_ids
    columns = [x.split()[0] for x in schema.split(", ")]

    def frame(rows: list[tuple], is_open: bool) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "bin", "offset"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"), open=is_open)[columns]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = Encoder(tokenizer), BestFit(length, n_open)
        base = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}  # the pieces of open bins
        for batch in batches:
            done = []
            for row in pieces(zip(batch["doc_id"].astype("Int64"), batch["text"]), encode, length, end_id):
                at, offset = packer.place(row[3])
                held.setdefault(at, []).append((*row, at + base, offset))
                for gone in packer.closed:
                    done += held.pop(gone)
            yield frame(done, False)
        yield frame([row for rows in held.values() for row in rows], True)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    packed = written(rows.mapInPandas(task, schema), "packed")

    def again(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "bin", "offset"], ascending=[False, True, True])
        packer = BestFit(length, len(group) + 1)
        placed = [packer.place(int(n)) for n in group["length"]]
        base = SECOND | int(group["bin"].min()) >> 32 << 32
        return group.assign(bin=[b + base for b, _ in placed], offset=[o for _, o in placed], doc_id=group["doc_id"].astype("Int64"))

    loose = packed.where("open").groupBy(F.floor(F.shiftright("bin", 32) / MERGE).alias("g")).applyInPandas(lambda x: again(x)[columns], packed.schema)
    return packed.where("not open").unionByName(loose).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", *["ids"] * with_ids)
