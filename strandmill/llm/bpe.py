"""Encoding a corpus with the byte-level BPE of a public rank file.

A text is split by the tokenizer's pattern; each piece's bytes are merged by a priority
queue of merge ranks over a doubly linked list of symbols, where entries that a later
merge made stale are skipped. Pieces repeat a great deal, so a worker keeps the ids of
those it met, up to a bound after which it starts afresh. Decoding concatenates the
vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Where the public vocabulary files are; a parameter of every function that needs them.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

# The tokenizer's split is 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# with the letters, numbers and white space of Unicode 16. These are the code points with the White_Space property,
# and the letters and numbers that Unicode 16 added to what Python's tables may have.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

#: The split in terms of the standard module, for texts in which its classes are those meant.
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^{WHITE_SPACE}\w]|_)+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")


@lru_cache(1)
def _stand_ins() -> dict[int, str]:
    """For each character that the standard module classes otherwise, one that it classes as is meant."""
    new = {c: "a" for x, y in NEW_LETTERS for c in range(x, y + 1)} | {c: "0" for x, y in NEW_NUMBERS for c in range(x, y + 1)}
    other = {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        meant = new.get(i) or {"L": "a", "N": "0"}.get(kind, "!")
        is_number = c.isdecimal()
        if meant != ("0" if is_number else "a" if c.isalnum() else "!") and c not in WHITE_SPACE:
            other[i] = meant
    return other


class Encoder:
    """Byte-pair encoding by ranks. cache_pieces bounds the pieces kept, not what can be encoded."""

    def __init__(self, ranks: dict[bytes, int], cache_pieces: int = 400_000) -> None:
        self.ranks = ranks
        self.words = {i: b for b, i in ranks.items()}
        self.stand_ins = _stand_ins()
        self.odd = frozenset(map(chr, self.stand_ins))
        self.cache_pieces = cache_pieces
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = tuple(outer.merge(piece.encode("utf-8", "surrogatepass")))
                if len(self) >= outer.cache_pieces:
                    self.clear()
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece: always the pair of lowest rank merges next, the leftmost of equals."""
        ranks, n = self.ranks, len(data)
        if n == 1:
            return [ranks[data]]
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j == n or end[j] != stop:
                continue  # stale: one of its symbols has since grown or gone
            end[i], alive[j] = stop, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(queue, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(queue, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = after[i]
        return ids

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return _SPLIT.findall(text)
        return [text[m.start() : m.end()] for m in _SPLIT.finditer(text.translate(self.stand_ins))]

    def encode(self, text: str | None) -> Iterable[int]:
        """Ids without special tokens, whose strings are ordinary text; none for null and for empty text."""
        return chain.from_iterable(map(self.pieces.__getitem__, self.split(text))) if text else ()

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.words.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a rank file, made once in each worker."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))})


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of every document's whole text.

    Null and empty text give an empty list; blanks are text. Repeated rows give repeated
    rows; an empty table gives an empty result; other columns play no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            # A batch of long texts is sent on in parts, so that ids of at most a few million tokens are held.
            start, ids, ends = 0, array("i"), [0]
            for row, t in enumerate(batch.column("text")):
                ids.extend(enc.encode(t.as_py()))
                ends.append(len(ids))
                if len(ids) > 4_000_000 or row == batch.num_rows - 1:
                    values = pa.array(np.frombuffer(ids, np.int32)) if len(ids) else pa.array([], pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, row + 1 - start), lists], schema=IDS)
                    start, ids, ends = row + 1, array("i"), [0]

    return spread(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(work, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, keep: dict[str, Column], text: Column, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns of keep and n_tokens of each row's whole text, 0 for null and empty text."""
    rows = df.select(*[c.alias(name) for name, c in keep.items()], text.cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            n = pa.array([enc.count(t.as_py()) for t in batch.column("__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(work, f"{fields}, n_tokens bigint")


def decode_documents(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of token ids; null ids give an empty text, ids outside the vocabulary raise KeyError."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            texts = [enc.decode(x.as_py() or ()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(work, "doc_id bigint, text string")
