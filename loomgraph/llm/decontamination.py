"""Benchmark decontamination: BM25 over test items, searched by every passage of every text by block-max WAND.

The test items are the indexed side, in shards of bounded size, each broadcast in its turn.  Items are of length classes
(16, 24, 36 ... words); a class is searched by windows of twice its length, half overlapping, so an item's whole text
lies in one of them, and neither other items nor shards have a say in where windows lie.  A score is a share of what the
item scores against itself.  A passage has a cursor on the list of each of its terms.  The lists' largest weights say up
to which cursor, in the order of items, the threshold can be reached; the largest weights of the blocks that hold this
pivot say whether it is worth a look.  If so, cursors move there and the item is scored; if not, they move past the
nearest end of those blocks.  The cursors of many passages step together.  Every item at or above the threshold is
retrieved, and stands if enough three-word runs of its question and of its answer are in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import prepared

K1, B = 1.2, 0.75
#: Words of the shortest length class; each further class is half as long again.
SHORTEST = 16
#: Postings of a block of a list; words of the items that one broadcast index holds.
BLOCK_POSTINGS = 16
SHARD_WORDS = 1 << 20
#: Cursors that step together, and words whose passages are searched at once.
CURSORS = 1 << 14
TEXT_WORDS = 1 << 17
GRAM = 3

find_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


class TermsOf(dict):
    """The term of each piece between white space, -1 for a word that no item has; pieces of none or several words have a
    lower number, the place of their terms in ``lists``."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms, self.lists = terms, []

    def __missing__(self, piece: str) -> int:
        core = piece.lower().strip(MARKS)
        if core.isalnum():
            found = self.terms.get(core, -1)
        else:
            words = words_of(piece)
            found = self.terms.get(words[0], -1) if len(words) == 1 else -2 - len(self.lists)
            if len(words) != 1:
                self.lists.append([self.terms.get(w, -1) for w in words])
        self[piece] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """The terms of a text's words in order."""
        if len(self) >= CACHE:
            self.clear()
            self.lists.clear()
        pieces = text.split()
        found = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        odd = np.flatnonzero(found < -1)
        if not len(odd):
            return found
        lists = [self.lists[-2 - k] for k in found[odd].tolist()]
        count = np.ones(len(found), np.int64)
        count[odd] = [len(x) for x in lists]
        begin, out = np.cumsum(count) - count, np.repeat(found, count)
        for at, x in zip(begin[odd].tolist(), lists, strict=True):
            out[at : at + len(x)] = x
        return out


#: Pieces that a task remembers.
CACHE = 400_000
#: Marks around a word that is otherwise one run of letters and digits.
MARKS = ".,;:!?()[]\"'"


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's two parts: up to its last question mark and after it, or else its halves by words."""
    head, mark, tail = text.rpartition("?")
    if mark and words_of(head) and words_of(tail):
        return words_of(head), words_of(tail)
    words = words_of(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def length_class(words: int) -> int:
    """The longest that an item of so many words may be in its class: close to its own length, so that weights are alike."""
    longest = SHORTEST
    while longest < words:
        longest += longest // 2
    return longest


class Lists:
    """Inverted lists of the items of one length class: each term's items in order, with the largest weights of list and blocks.

    ``term, item, weight`` are its postings, ``terms`` and ``items`` how many of either there are.  Keys are term and
    item in one number, so all lists together are in order.  One term more than there are has an empty list.
    """

    def __init__(self, term: np.ndarray, item: np.ndarray, weight: np.ndarray, terms: int, items: int):
        order = np.lexsort((item, term))
        # the smaller numbers are, the faster they are sorted and found
        self.item_kind = np.int16 if items < 1 << 15 else np.int32
        self.key_kind = np.int32 if (terms + 1) * (items + 1) < 1 << 31 else np.int64
        term, self.weight, self.items, self.none = term[order], np.append(weight[order], 0.0), items, terms
        self.item = np.append(item[order], items).astype(self.item_kind)
        self.key = (term * (items + 1) + self.item[:-1]).astype(self.key_kind)
        self.begin = np.searchsorted(term, np.arange(terms + 2))
        self.top = np.zeros(terms + 1)
        np.maximum.at(self.top, term, self.weight[:-1])
        first = np.flatnonzero((np.arange(len(term)) - self.begin[term]) % BLOCK_POSTINGS == 0)
        last = np.append(first[1:], len(term)) - 1
        self.block_base, self.block_last, self.block_key = np.append(term[first] * (items + 1), -1), np.append(self.item[last], self.item_kind(items)), self.key[last]
        self.block_top = np.append(np.maximum.reduceat(self.weight[:-1], first), 0.0)
        blocks = np.searchsorted(term[first], np.arange(terms + 2))
        self.first_block, self.several = blocks[:-1], np.diff(blocks) > 1

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Passages, items and scores of at least ``threshold``; ``passage`` and ``term`` are distinct pairs in order of passages."""
        least = threshold - 1e-9
        own = self.top[term] > 0
        passage, term = passage[own], term[own]
        if not len(passage):
            return
        live = np.bincount(passage, self.top[term])[passage] >= least
        passage, term = passage[live], term[live]
        first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])[: len(passage)])
        size = np.diff(np.append(first, len(passage)))
        by_size = np.argsort(size, kind="stable")[::-1]  # long ones first, so that little is padded
        at = 0
        while at < len(by_size):
            width = int(size[by_size[at]])
            some = by_size[at : at + max(1, CURSORS // width)]
            at += len(some)
            place = np.arange(width)
            inside = place < size[some][:, None]
            terms = np.where(inside, term[np.where(inside, first[some][:, None] + place, 0)], self.none)
            yield from self.wand(passage[first[some]], terms, least)

    def wand(self, passage: np.ndarray, terms: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block-max WAND over rows of cursors, one row a passage, one cursor a term."""
        several, single = self.several[terms], self.first_block[terms]
        base, top, cursor, stop = (terms * (self.items + 1)).astype(self.key_kind), self.top[terms], self.begin[terms], self.begin[terms + 1]
        while len(passage):
            here = np.where(cursor < stop, self.item[cursor], self.item_kind(self.items))
            order = np.argsort(here, axis=1, kind="stable")
            inward = np.take_along_axis(here, order, axis=1)
            reached = np.cumsum(np.where(inward < self.items, np.take_along_axis(top, order, axis=1), 0.0), axis=1) >= least
            on = reached[:, -1]
            some = np.count_nonzero(on)
            if not some:
                return
            if some < 0.7 * len(on):  # else the rows that are done stay a while, without a pivot
                passage, base, top, cursor, stop, several, single, here, inward, reached, on = (x[on] for x in (passage, base, top, cursor, stop, several, single, here, inward, reached, on))
            pivot = np.where(on, inward[np.arange(len(passage)), reached.argmax(axis=1)], self.item_kind(-1))
            row, column = np.nonzero(here <= pivot[:, None])
            begun, p = base[row, column], pivot[row]
            block = single[row, column]  # the block that holds the list's first item from the pivot on
            many = np.flatnonzero(several[row, column])
            block[many] = np.searchsorted(self.block_key, begun[many] + p[many])
            held = (self.block_base[block] == begun) & (self.block_last[block] >= p)
            worth = np.bincount(row, np.where(held, self.block_top[block], 0.0), len(passage)) >= least
            # past the nearest end of the pivot's blocks, or on to the next cursor
            beyond = np.where(here > pivot[:, None], here, self.item_kind(self.items)).min(axis=1)
            np.minimum.at(beyond, row[held], self.block_last[block[held]] + self.item_kind(1))
            to = np.where(worth, pivot, beyond)
            moved = np.searchsorted(self.key, begun + to[row])
            moved = np.minimum(moved, stop[row, column])
            at_pivot = worth[row] & (moved < stop[row, column]) & (self.item[moved] == p)
            score = np.bincount(row[at_pivot], self.weight[moved[at_pivot]], len(passage))
            hit = np.flatnonzero(worth & (score >= least))
            if len(hit):
                yield passage[hit], pivot[hit], score[hit]
            cursor[row, column] = moved + at_pivot


@dataclass
class Index:
    """Inverted lists by length class, over the same terms and items."""

    terms: dict[str, int]
    lists: dict[int, Lists]
    texts: list[str]
    item_ids: list[int | None]

    @classmethod
    def of(cls, postings: pa.Table, texts: list[str], item_ids: list[int | None]) -> Index:
        """``postings``: ``term, item`` (place in ``texts``) and ``weight``, which sum to 1 for each item."""
        names, term = np.unique(postings.column("term").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        item, weight = postings.column("item").to_numpy(), postings.column("weight").to_numpy()
        longest = np.array([length_class(len(words_of(t))) for t in texts])
        lists = {int(c): Lists(term[own], item[own], weight[own], len(names), len(texts)) for c in np.unique(longest) if len(own := np.flatnonzero(longest[item] == c))}
        return cls({str(t): k for k, t in enumerate(names)}, lists, texts, item_ids)

    def search(self, texts: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """Text, length class, window, item and score of all that is retrieved; ``texts`` are the terms of each text's words, -1 for others.

        Window k has the words from k times the class's length on, twice as many as that.
        """
        words = np.concatenate([*texts, np.zeros(0, np.int64)])
        count = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), count)
        within = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
        known = np.flatnonzero(words >= 0)
        words, owner, within = words[known], owner[known], within[known]
        for step, lists in self.lists.items():
            steps = np.maximum(1, -(-count // step))
            windows = np.maximum(1, steps - 1)
            begin = np.cumsum(windows) - windows
            weight = lists.top[words]
            own = np.flatnonzero(weight > 0)
            k, terms, base = within[own] // step, words[own], begin[owner[own]]
            # most of what a window could score, its repeated words counted each time: few windows go further
            late, early = k < windows[owner[own]], k > 0  # a step is the first half of its own window and the second of the one before
            window = np.concatenate([(base + k)[late], (base + k - 1)[early]])
            terms = np.concatenate([terms[late], terms[early]])
            hopeful = (np.bincount(window, lists.top[terms], int(windows.sum())) >= threshold - 1e-9)[window]
            pair = np.unique(window[hopeful] * (lists.none + 1) + terms[hopeful])
            for passages, items, scores in lists.retrieve(pair // (lists.none + 1), pair % (lists.none + 1), threshold):
                text = np.searchsorted(begin, passages, "right") - 1
                yield from zip(text.tolist(), [step] * len(text), (passages - begin[text]).tolist(), items.tolist(), scores.tolist(), strict=True)


def indexed_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, text`` of the items that have words."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().where(F.col("text").rlike(r"[\p{L}\p{N}_]"))


def indexes(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[Index]:
    """The index in shards by a hash of the item; document frequencies are those of all items."""
    prepared(benchmark.sparkSession)
    items = indexed_items(benchmark)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["item_id", "text", "words"])

    worded = items.mapInArrow(tokens, "item_id long, text string, words array<string>").withColumn("size", F.size("words"))
    stats = worded.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    if not stats.n:
        return
    shards, mean = -(-int(stats.words) // shard_words), max(1.0, stats.words / stats.n)
    frequency = worded.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for shard in range(shards):
        own = worded.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        tf = own.select("item_id", "text", "size", F.explode("words").alias("term")).groupBy("item_id", "text", "size", "term").agg(F.count("*").alias("tf"))
        idf = F.log(1 + (F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
        table = tf.join(frequency, "term").select("item_id", "text", "term", weight.alias("weight")).toArrow().to_pandas()
        if not len(table):
            continue
        table["key"] = list(zip(table["item_id"].isna(), table["item_id"].fillna(0), table["text"], strict=True))
        keys = sorted(set(table["key"]))
        table["item"] = table["key"].map({k: i for i, k in enumerate(keys)})
        table["weight"] /= table.groupby("item")["weight"].transform("sum")
        yield Index.of(pa.table({"term": table["term"].tolist(), "item": table["item"].tolist(), "weight": table["weight"].tolist()}), [k[2] for k in keys], [None if k[0] else int(k[1]) for k in keys])


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every text that holds a test item.

    One row for each row of ``documents`` (``doc_id, text``) and item of ``benchmark`` (``item_id, text``) that it
    holds, with the best passage's figures; nothing for null and empty texts, nor for items without words.  Repeated
    documents or items give rows each; equal rows of ``benchmark`` count as one item.  Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = prepared(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    found = None
    for index in indexes(benchmark, shard_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            terms_of = TermsOf(index.terms)
            parts = [tuple(map(grams, question_and_answer(t))) for t in index.texts]

            def found(held: list[tuple[int | None, str, np.ndarray]]) -> pa.RecordBatch:
                best: dict[tuple[int, int], tuple] = {}
                passages: dict[tuple[int, int, int], set] = {}
                for text, step, k, item, score in index.search([h[2] for h in held], threshold):
                    passage = passages.get((text, step, k))
                    if passage is None:
                        window = words_of(held[text][1])[k * step : (k + 2) * step]
                        passages[text, step, k] = passage = grams(window) | {(w,) for w in window} | set(zip(window, window[1:], strict=False))  # parts of one or two words, too
                    q, a = (len(p & passage) / len(p) if p else 1.0 for p in parts[item])
                    if q >= overlap and a >= overlap:
                        best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (min(1.0, score), q, a))
                out = [{"doc_id": held[t][0], "item_id": index.item_ids[i], "score": s, "question_overlap": q, "answer_overlap": a} for (t, i), (s, q, a) in sorted(best.items())]
                return pa.RecordBatch.from_pylist(out, schema=schema)

            for batch in batches:
                held, size = [], 0
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    terms = terms_of.of(text or "")
                    held.append((doc_id, text or "", terms))
                    size += len(terms)
                    if size >= TEXT_WORDS:
                        yield found(held)
                        held, size = [], 0
                if held:
                    yield found(held)

        part = rows.mapInArrow(run, columns)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], columns)
