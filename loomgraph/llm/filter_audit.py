"""How filters of texts act together, in every order: what each removes, alone, first, or after others.

A text is read once, as bytes, by a finite-state transducer given as two tables: the state after a byte, and what a byte
of a class emits in a state (a word begins or ends, a code point, a capital, a symbol).  The state after a byte follows
from that byte's class alone, so a piece of a buffer takes one step for all its bytes, and the state at its end is
carried into the next piece.  Spans of words go into a hash table whose equal hashes are verified by their bytes.

Spark reduces the five verdicts of each text to counts of the 32 combinations; every order of the filters follows from
these, so no text is judged more than once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import cut, prepared

FILTERS = "ABCDE"
#: Bounds of the filters: words at least, percent of distinct words at least, percent of capitals at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10

#: Classes of bytes, states, and what a step emits.
SEPARATOR, CONTINUATION, CAPITAL, SYMBOL, OTHER = range(5)
GAP, WORD = range(2)
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = (1 << k for k in range(5))

CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = SEPARATOR
CLASS[0x80:0xC0] = CONTINUATION
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[[ord(c) for c in "#$%&*|"]] = SYMBOL

NEXT = np.array([GAP if c == SEPARATOR else WORD for c in range(5)], np.uint8)
EMITS = np.array(
    [[(BEGINS if s == GAP and c != SEPARATOR else 0) | (ENDS if s == WORD and c == SEPARATOR else 0) | (POINT if c != CONTINUATION else 0) | (IS_CAPITAL if c == CAPITAL else 0) | (IS_SYMBOL if c == SYMBOL else 0) for c in range(5)] for s in (GAP, WORD)],
    np.uint8,
)

#: Bytes that take a step together; documents are gathered up to so many.
PIECE = 1 << 20
#: Words longer than this are hashed and compared one by one, in parts of this size.
LONG = 1 << 12
MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.concatenate([[1], np.full(LONG - 1, MULTIPLIER)]).astype(np.uint64))


def _flat(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bytes of spans, one after the other, and each one's distance from its span's start."""
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + within, within


def _hashes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A polynomial of each span's bytes, modulo 2^64."""
    out = np.zeros(len(starts), np.uint64)
    short = np.flatnonzero(lengths <= LONG)
    if len(short):
        at, within = _flat(starts[short], lengths[short])
        out[short] = np.add.reduceat((text[at].astype(np.uint64) + np.uint64(1)) * _POWERS[within], np.cumsum(lengths[short]) - lengths[short])
    for k in np.flatnonzero(lengths > LONG):
        total, factor = 0, 1
        for part in range(int(starts[k]), int(starts[k] + lengths[k]), LONG):
            some = text[part : min(part + LONG, int(starts[k] + lengths[k]))].astype(np.uint64) + np.uint64(1)
            total = (total + factor * int((some * _POWERS[: len(some)]).sum(dtype=np.uint64))) % (1 << 64)
            factor = factor * pow(MULTIPLIER, LONG, 1 << 64) % (1 << 64)
        out[k] = total
    return out


class SpanTable:
    """An open-addressing table of spans of one buffer, by owner and bytes; spans of equal hash are compared byte by byte."""

    def __init__(self, text: np.ndarray) -> None:
        self.text, self.bits = text, 12
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.entries = np.zeros((4, 0), np.int64)  # start, length, owner, hash, as far as `held`, doubled when full
        self.held = 0

    def _same(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether columns ``a`` of ``known`` are the spans ``b`` of it."""
        out = (known[1:, a] == known[1:, b]).all(axis=0)
        check = np.flatnonzero(out)
        long = known[1, a[check]] > LONG
        for k in check[long]:
            (p, n), q = known[:2, a[k]], known[0, b[k]]
            out[k] = all((self.text[p + i : p + min(i + LONG, n)] == self.text[q + i : q + min(i + LONG, n)]).all() for i in range(0, n, LONG))
        check = check[~long]
        if len(check):
            n = known[1, a[check]]
            at, _ = _flat(known[0, a[check]], n)
            of, _ = _flat(known[0, b[check]], n)
            out[check] = np.add.reduceat(self.text[at] != self.text[of], np.cumsum(n) - n, dtype=np.int64) == 0
        return out

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        mixed = hashes.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Adds spans of at least one byte; returns for each whether it is the first of its owner and bytes."""
        n = len(starts)
        if 2 * (self.held + n) > len(self.slots):
            self._grow(2 * (self.held + n))
        hashes = (_hashes(self.text, starts, lengths) ^ (owners.astype(np.uint64) * np.uint64(MULTIPLIER))).view(np.int64)
        if self.held + n > self.entries.shape[1]:
            more = np.zeros((4, max(2 * self.entries.shape[1], self.held + n)), np.int64)
            more[:, : self.held] = self.entries[:, : self.held]
            self.entries = more
        known = self.entries
        known[:, self.held : self.held + n] = starts, lengths, owners, hashes
        new, place = np.zeros(n, bool), self._slot(hashes)
        left = np.arange(n)
        while len(left):
            s = place[left]
            free = self.slots[s] < 0
            self.slots[s[free]] = self.held + left[free]  # of several that claim a slot one gets it
            there = self.slots[s]
            won = there == self.held + left
            new[left[won]] = True
            same = np.zeros(len(left), bool)
            lost = np.flatnonzero(~won)
            same[lost] = self._same(self.held + left[lost], there[lost], known)
            left = left[~won & ~same]
            place[left] = (place[left] + 1) & (len(self.slots) - 1)
        first = np.flatnonzero(new)
        self.slots[place[first]] = self.held + np.arange(len(first))
        known[:, self.held : self.held + len(first)] = known[:, self.held + first]
        self.held += len(first)
        return new

    def _grow(self, least: int) -> None:
        self.bits = max(self.bits + 1, int(least - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        place, left = self._slot(self.entries[3, : self.held]), np.arange(self.held)
        while len(left):  # all of them differ
            s = place[left]
            free = self.slots[s] < 0
            self.slots[s[free]] = left[free]
            left = left[self.slots[s] != left]
            place[left] = (place[left] + 1) & (len(self.slots) - 1)


def measures(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each text between two of ``offsets``, as rows of an array."""
    n = len(offsets) - 1
    out = np.zeros((5, n), np.int64)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        table, state, begun = SpanTable(text), GAP, -1
        ends_of, starts_of = offsets[first + 1 : last + 1], offsets[first:last]
        for a in range(int(offsets[first]), int(offsets[last]), PIECE):
            b = min(a + PIECE, int(offsets[last]))
            kinds = CLASS[text[a:b]]
            before = np.empty(b - a, np.uint8)
            before[0], before[1:] = state, NEXT[kinds[:-1]]
            fresh = starts_of[(starts_of >= a) & (starts_of < b)]
            before[fresh - a] = GAP
            emitted = EMITS[before, kinds]
            state = int(NEXT[kinds[-1]])
            # a word ends before a separator or where its text does
            ends = np.flatnonzero(emitted & ENDS) + a
            closing = ends_of[(ends_of > a) & (ends_of <= b)]
            closing = np.unique(closing[NEXT[CLASS[text[closing - 1]]] == WORD])
            ends = np.union1d(ends, closing)
            begins = np.flatnonzero(emitted & BEGINS) + a
            if begun >= 0:
                begins = np.concatenate([[begun], begins])
            begun = int(begins[-1]) if len(begins) > len(ends) else -1
            begins = begins[: len(ends)]
            if len(ends):
                owner = np.searchsorted(offsets, begins, "right") - 1
                new = table.insert(begins, ends - begins, owner)
                out[0] += np.bincount(owner, minlength=n)
                out[1] += np.bincount(owner[new], minlength=n)
            for row, bit in ((2, IS_CAPITAL), (3, POINT), (4, IS_SYMBOL)):
                # sums between the borders of texts inside this piece
                borders = np.concatenate([[a], offsets[first + 1 : last][(offsets[first + 1 : last] > a) & (offsets[first + 1 : last] < b)], [b]])
                here = np.concatenate([[0], np.cumsum((emitted & bit) != 0, dtype=np.int64)])[borders - a]
                np.add.at(out[row], np.searchsorted(offsets, borders[:-1], "right") - 1, np.diff(here))
        first = last
    return out


def failures(found: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that texts with these ``measures`` fail."""
    words, distinct, capitals, points, symbols = found
    return (words < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * words) * 2 + (100 * capitals > MOST_CAPITALS * points) * 4 + (symbols > 0) * 8


def verdicts(documents: DataFrame) -> DataFrame:
    """``doc_id, part, digest, words, distinct_words, capitals, points, symbols, fails`` for each row (``fails``: bits of A to D).

    A null text is an empty one, a null ``lang`` the part ''; repeated rows are measured each for itself; other columns
    are ignored; an empty table gives an empty result.  Texts are read whole, in pieces, however long.
    """
    prepared(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = texts.buffers()[2]
            text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            found = measures(text, offsets)
            digests = [hashlib.sha256(text[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *(pa.array(x) for x in found), pa.array(failures(found).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "part", "digest", "words", "distinct_words", "capitals", "points", "symbols", "fails"]
    return rows.mapInArrow(measured, "doc_id long, part string, digest binary, words long, distinct_words long, capitals long, points long, symbols long, fails int")


def combinations(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, good, toxic, n``: how many documents fail each combination of the five filters.

    E fails a text that a smaller ``doc_id`` has too: rows of one text's smallest id, and rows without an id, pass.
    Counts of one text are gathered before they are shuffled by its digest, so a text that a third of all rows hold is
    a few rows by then.  A document is good (toxic) if any of its rows in ``labels`` says so; rows without id have no labels.
    """
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    rows = verdicts(documents).select("doc_id", "part", "digest", "fails").join(said.agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")), "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    group = ["part", "digest", "fails", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    by_text = by_id.groupBy("digest", *(c for c in group if c != "digest")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), least)
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    at_least = F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(F.lit(0))
    split = by_text.withColumn("original", F.col("nameless") + F.coalesce(at_least, F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("fails"), F.col("original").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("original")).alias("n")))).alias("x")
    return split.select("part", "good", "toxic", both).groupBy("part", "x.fails", "good", "toxic").agg(F.sum("x.n").alias("n"))


def _over(counts: str, when) -> Column:
    """The sum of those of 32 ``counts`` whose combination ``when`` accepts."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, k: s + F.when(when(k), F.col(counts)[k]).otherwise(F.lit(0)))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each of the 120 orders: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Every part (language) has all 600 rows, zeros included; an empty table has no part.  For nulls, repeated rows and
    copies see ``verdicts`` and ``combinations``.
    """
    counted = cut(combinations(documents, labels))
    array = lambda name, held: F.array(*(F.coalesce(F.sum(F.when((F.col("fails") == k) & held, F.col("n"))), F.lit(0)) for k in range(32))).alias(name)
    parts = counted.groupBy("part").agg(array("every", F.lit(True)), array("goods", F.col("good")), array("toxics", F.col("toxic")))
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])).alias("filter_order")
    rows = parts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("own", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
    rows = rows.withColumn("earlier", F.expr("aggregate(sequence(1, 5), 0, (s, k) -> s + if(k < step, shiftleft(1, ascii(substring(filter_order, k, 1)) - 65), 0))"))
    own, earlier = F.col("own"), F.col("earlier")
    fails, gone = (lambda k: k.bitwiseAND(own) != 0), (lambda k: k.bitwiseAND(earlier) != 0)
    # of the orders of a combination's filters this one is first in the same share
    shares = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, k: s + F.when(fails(k), F.expr("120L") * F.col("every")[k] / F.bit_count(k)).otherwise(F.lit(0)).cast("long"))
    removed = lambda k: fails(k) & ~gone(k)
    return rows.select(
        "part", "filter_order", "step", _over("every", lambda k: ~fails(k) & ~gone(k)).alias("kept"), _over("every", removed).alias("removed"), _over("every", lambda k: fails(k) & gone(k)).alias("redundant"),
        _over("every", lambda k: k == own).alias("unique_fails"), _over("goods", removed).alias("good_lost"), _over("toxics", removed).alias("toxic_lost"), shares.alias("shapley"),
    )
