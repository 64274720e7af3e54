"""Byte-level BPE encoding and decoding of whole texts.

A pre-token's bytes become a doubly linked list of symbols; a priority queue holds the merge ranks of neighbouring
pairs, an entry that no longer describes its pair is skipped when it comes up.  Decoding concatenates the vocabulary's
strings.  Pre-tokens repeat, so a worker keeps the ids of those it has met, packed two bytes an id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.byte_bpe import Pieces, splitter
from loomgraph.llm.common import prepared


def byte_characters() -> dict[str, int]:
    """The printable character by which such vocabularies write each byte (printable Latin-1 as itself, others from U+0100)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Merge ranks and vocabulary strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        to_byte = byte_characters()
        vocabulary = content["model"]["vocab"]
        self.specials = {token["content"]: token["id"] for token in content["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.specials.values()])
        self.strings = [b""] * size
        for token, k in vocabulary.items():
            self.strings[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, k in self.specials.items():
            self.strings[k] = token.encode()
        self.first = [0] * 256
        for character, b in to_byte.items():
            self.first[b] = vocabulary[character]
        #: left id and right id in one number -> rank; rank -> merged id
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        self.decimal = [b"%d" % k for k in range(size)]
        self.width = "<u2" if size <= 1 << 16 else "<u4"

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        first = self.first
        ids = [first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged, push, pop = self.ranks.get, self.merged, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []  # rank and place in one number: the lowest rank first, the leftmost of equals
        for i in range(n - 1):
            if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: a neighbour has been merged since
            ids[i], ids[j] = symbol, _ = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(symbol << 32 | ids[k])) is not None:
                    push(queue, rank << 32 | i)
            k = before[i]
            if k >= 0 and (rank := rank_of(ids[k] << 32 | symbol)) is not None:
                push(queue, rank << 32 | k)
        return [k for k in ids if k >= 0]

    def encoder(self):
        """A function from a text to its ids as a numpy array, with caches of its own."""
        parts, pack = splitter(self.specials), np.dtype(self.width)
        code = "H" if pack.itemsize == 2 else "I"
        pieces = Pieces(lambda t: array(code, self.merge(t.encode())).tobytes(), b"".join)

        def encode(text: str) -> np.ndarray:
            return np.frombuffer(b"".join(array(code, [self.specials[part]]).tobytes() if special else pieces.of(part) for part, special in parts(text)), pack)

        return encode

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def of_worker(path: str) -> tuple[ByteBPE, Callable[[str], np.ndarray]]:
    """The tokenizer and its encoder; a worker keeps them, with their bounded caches, for all its tasks."""
    bpe = ByteBPE(path)
    return bpe, bpe.encoder()


def _coded(documents: DataFrame, tokenizer_path: str, columns: str, row) -> DataFrame:
    prepared(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = of_worker(tokenizer_path)
        for batch in batches:
            out = [row(bpe, encode(text or "")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out]) if out else pa.array([], t) for k, t in zip(names[1:], TYPES[len(names)], strict=True))], names=names)

    return rows.mapInArrow(run, columns)


TYPES = {2: [pa.list_(pa.int32())], 4: [pa.int64(), pa.string(), pa.string()]}


def encode(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids`` for each row of ``documents`` (columns ``doc_id``, ``text``); null and empty texts have no ids."""
    return _coded(documents, tokenizer_path, "doc_id long, ids array<int>", lambda bpe, ids: {"ids": ids.astype(np.int32)})


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` for each row of ``encoded`` (columns ``doc_id``, ``ids``); null ids give an empty text."""
    prepared(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = of_worker(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every text encoded and decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty texts have 0 tokens and the digests of nothing.  Repeated rows are coded each for itself; a null
    ``doc_id`` is kept; other columns are ignored; an empty table gives an empty result.  Texts are never cut.
    """

    def row(bpe: ByteBPE, ids: np.ndarray) -> dict:
        ids = ids.tolist()
        return {
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, ids))).hexdigest(),
            "decoded_sha256": hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
        }

    return _coded(documents, tokenizer_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
