"""Document scores by masked pseudo-likelihood under a bidirectional window network.

Words are counted over all documents, and every word keeps its count.  The most frequent words have an input row and a
leaf of the output tree each; the others share leaves by a hash, of which there are more the more such words there are,
and a word's share of its leaf follows from the counts, which are joined to the documents' words.  The network predicts
every word from two words on each side: a word's probability is the product of the choices on its path through a Huffman
tree over all leaves, so the probabilities of all words sum to one.

The network is trained in numpy on every word of all documents.  Documents are dealt by a hash to groups of about
GROUP_WORDS words, one network is trained in mini-batches on each, all from the same start, and their parameters are
averaged in rounds of bounded fan-in, weighted by words.  Groups depend on the rows alone, so neither the partitions nor
the order of the table has a say.  Texts are turned into leaves once, two bytes a word; training and scoring read these.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, prepared

#: Words that have a leaf each, at most; steps of an octave by which the least count of such a word is found.
VOCABULARY = 32_768
STEPS = 16
WIDTH = 16
SIDES = (-2, -1, 1, 2)
EDGE = 2
#: A leaf as it is sent and kept.
LEAF = np.uint16
#: Leaves for the words that have none of their own, each time that their number doubles.
MORE_LEAVES = 4
#: Words of a mini-batch, of a group that trains one network, and networks that are averaged at once.
BATCH = 4096
#: Nodes at the top of the tree, which most paths go through: all words of a batch meet them at once.
TOP = 64
GROUP_WORDS = 4_000_000
FAN_IN = 16
#: Tasks that groups are dealt to; a task has one network in hand at a time, however many groups it has.
MOST_TASKS = 8192
TASK_WORDS = 200_000


class Codes(dict):
    """Leaf by word; a word without a leaf of its own has that of its hash."""

    def __init__(self, of: dict[str, int], rest: int) -> None:
        super().__init__(of)
        self.own, self.rest = len(of), rest

    def __missing__(self, word: str) -> int:
        return self.own + zlib.crc32(word.encode()) % self.rest

    def __reduce__(self) -> tuple:
        return Codes, (dict(self), self.rest)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts, as ``str.split`` gives them, and the number of each one's text."""
    found = pc.utf8_split_whitespace(texts)
    text, found = pc.list_parent_indices(found), pc.list_flatten(found)
    real = pc.not_equal(found, "")  # there is an empty one where a text begins or ends with a space
    return text.filter(real).to_numpy().astype(np.int64), found.filter(real)


def rest_leaves(rest: int) -> int:
    """How many leaves ``rest`` distinct words share."""
    return MORE_LEAVES * max(1, rest.bit_length())


@dataclass
class Words:
    """What is sent of the words: leaves, their log shares (0 for a word alone), and each leaf's path through the tree."""

    of: Codes
    share: np.ndarray
    #: Where a leaf's path begins, how many of its steps are at the top, how many beyond; the nodes and directions (1 or -1)
    #: along all paths.
    begin: np.ndarray
    near: np.ndarray
    beyond: np.ndarray
    node: np.ndarray
    way: np.ndarray

    @classmethod
    def counted(cls, frequent: list[tuple[str, int]], rest: int, rest_mass: dict[int, int]) -> Words:
        """``rest`` distinct words aren't frequent; ``rest_mass`` has the sum of their counts by leaf, from 0 on."""
        leaves = rest_leaves(rest)
        mass = [max(1, rest_mass.get(k, 0)) for k in range(leaves)]
        if len(frequent) + leaves > np.iinfo(LEAF).max:
            raise ValueError("more leaves than two bytes tell apart")
        of = Codes({w: k for k, (w, _) in enumerate(frequent)}, leaves)
        share = np.concatenate([np.zeros(len(frequent)), -np.log(mass)])
        begin, node, way = huffman([*(n for _, n in frequent), *mass])
        near = np.diff(np.concatenate([[0], np.cumsum(node < TOP)])[begin])  # on a path nodes ascend, so those of the top come first
        return cls(of, share, begin, near, np.diff(begin) - near, node.astype(LEAF), way.astype(np.int8))

    @property
    def leaves(self) -> int:
        return len(self.share)

    def encoded(self, text: str | None) -> np.ndarray:
        """The leaf of each word."""
        return self.coded(pa.array([text], pa.string()))[1]

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
        """Of all words of ``texts``, the text (by number) and the leaf; and of each text, the words that have no leaf of their own, with a space between."""
        text, found = split(texts)
        found = found.dictionary_encode()
        word, known = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        leaf = np.fromiter(map(self.of.get, known, repeat(-1)), np.int32, len(known))
        missing = np.flatnonzero(leaf < 0)
        leaf[missing] = self.of.own + np.fromiter(map(zlib.crc32, map(str.encode, map(known.__getitem__, missing.tolist()))), np.int64, len(missing)) % self.of.rest
        leaf = leaf.take(word)
        at = np.flatnonzero(leaf >= self.of.own)
        begin = np.searchsorted(text[at], np.arange(len(texts) + 1))
        left = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), found.dictionary.take(pa.array(word[at])).cast(pa.string())), " ")
        return text, leaf.astype(LEAF), left

    def paths(self, leaf: np.ndarray) -> Paths:
        """All steps to ``leaf``, words in the order of their steps beyond the top, most first."""
        steps = self.beyond.take(leaf)
        order = np.argsort((steps.max() - steps).astype(LEAF), kind="stable")
        leaf = leaf.take(order)
        sizes = len(leaf) - np.cumsum(np.bincount(steps))[:-1]
        first, count = self.begin.take(leaf), self.near.take(leaf)
        end = np.cumsum(count)
        near = np.repeat(np.arange(len(leaf)), count)
        top, beyond = np.arange(len(near)) + (first - end + count).take(near), first + count
        at = np.concatenate([top, *(beyond[:n] + k for k, n in enumerate(sizes.tolist()))])
        return Paths(order, near, sizes.tolist(), self.node.take(at), self.way.take(at))


@dataclass
class Paths:
    """Steps of a batch: first those to nodes of the top, word by word, then the first, second ... beyond it of each word.

    Of ``n`` words that have a step of some depth beyond the top, the first ``n`` in ``order`` have one.
    """

    order: np.ndarray
    #: The word, by its place in ``order``, of each step at the top; words by depth beyond it; node and way of all steps.
    near: np.ndarray
    sizes: list[int]
    node: np.ndarray
    way: np.ndarray


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths to the leaves of a Huffman tree: where each begins, nodes from the root on, and ways."""
    n, heap = len(counts), [(c, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    above, way = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32)
    for parent in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i], above[j], way[i], way[j] = parent, parent, 1, -1
        heapq.heappush(heap, (a + b, parent))
    begin, nodes, ways = [0], [], []
    for leaf in range(n):
        path, k = [], leaf
        while k != 2 * n - 2:
            path.append((2 * n - 2 - above[k], way[k]))  # the root is node 0
            k = above[k]
        nodes += [p[0] for p in reversed(path)]
        ways += [p[1] for p in reversed(path)]
        begin.append(len(nodes))
    return np.array(begin), np.array(nodes, np.int64), np.array(ways, np.float32)


@dataclass
class WindowNet:
    """Input rows (0 is the text's edge), a scale by side, hidden bias, and the weights and bias of the tree's nodes."""

    inputs: np.ndarray
    scale: np.ndarray
    bias: np.ndarray
    nodes: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, seed: int, leaves: int) -> WindowNet:
        draw = np.random.default_rng(seed)
        make = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
        return cls(make(leaves + 1, WIDTH), 1 + make(len(SIDES), WIDTH), np.zeros(WIDTH, np.float32), np.zeros((max(1, leaves - 1), WIDTH), np.float32), np.zeros(max(1, leaves - 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.scale, self.bias, self.nodes, self.offset]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """Of every place but the first and last two, edges too; ``x``: the input row of each place."""
        n = len(x) - 2 * EDGE
        h = np.tile(self.bias, (n, 1))
        for side, scale in zip(SIDES, self.scale, strict=True):
            h += x[EDGE + side : EDGE + side + n] * scale
        return np.tanh(h, out=h)

    def log_probabilities(self, words: Words, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each leaf given its ``context`` (see ``contexts``), whose words, but for two at each end, ``leaf`` has."""
        out, place = np.empty(len(leaf)), EDGE + np.flatnonzero(context[EDGE:-EDGE])
        for k in range(0, len(leaf), BATCH):
            at, own = place[k : k + BATCH], leaf[k : k + BATCH]
            paths = words.paths(own)
            h = self.hidden(self.inputs.take(context[at[0] - EDGE : at[-1] + EDGE + 1], axis=0)).take(at.take(paths.order) - at[0], axis=0)
            z, _ = self.choices(paths, h)
            each = np.minimum(z, 0) - np.log(1 + np.exp(-np.abs(z)))  # log(sigmoid(z))
            total, first = np.bincount(paths.near, each[: len(paths.near)], len(h)), len(paths.near)
            for n in paths.sizes:
                total[:n] += each[first : first + n]
                first += n
            out[k + paths.order] = total
        return out

    def choices(self, paths: Paths, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The answer of each step in the step's way, and the nodes' rows beyond the top by depth; ``h`` in the order of ``paths``."""
        z, rows, first = np.empty(len(paths.node), np.float32), [], len(paths.near)
        top = h @ self.nodes[:TOP].T
        z[:first] = top.ravel().take(paths.near * top.shape[1] + paths.node[:first])
        for n in paths.sizes:
            w = self.nodes.take(paths.node[first : first + n], axis=0)
            np.einsum("iw,iw->i", h[:n], w, out=z[first : first + n])
            rows.append(w)
            first += n
        z += self.offset.take(paths.node)
        z *= paths.way
        return z, rows

    def learn(self, words: Words, context: np.ndarray, leaf: np.ndarray, rate: float, squares: list[np.ndarray]) -> None:
        """One step of Adagrad on a batch, on the rows of the batch alone where a table is large."""
        x, paths = self.inputs.take(context, axis=0), words.paths(leaf)
        place = np.flatnonzero(context[EDGE:-EDGE]).take(paths.order)
        h = self.hidden(x).take(place, axis=0)
        z, rows = self.choices(paths, h)
        g = np.exp(np.minimum(z, 30, out=z), out=z)
        g += 1
        np.divide(paths.way, g, out=g)
        np.negative(g, out=g)
        first, n = len(paths.near), min(TOP, len(self.nodes))
        at_top = np.zeros((len(h), n), np.float32)
        at_top.ravel()[paths.near * n + paths.node[:first]] = g[:first]
        back, far, begin = at_top @ self.nodes[:n], np.empty((len(g) - first, WIDTH), np.float32), 0
        for w in rows:
            own, stop = g[first + begin : first + begin + len(w), None], begin + len(w)
            np.multiply(h[: len(w)], own, out=far[begin:stop])
            w *= own
            back[: len(w)] += w
            begin = stop
        self._step(self.nodes, squares[3], slice(0, n), at_top.T @ h, rate)
        self._step(self.offset, squares[4], slice(0, n), np.ones(len(h), np.float32) @ at_top, rate)
        if len(far):
            order, begin, node = grouped(paths.node[first:])
            self._step(self.nodes, squares[3], node, sums(far, order, begin), rate)
            self._step(self.offset, squares[4], node, np.add.reduceat(g[first:].take(order), begin), rate)
        h *= h
        back *= np.subtract(1, h, out=h)
        # what a place passes on to each side; edges between texts have passed on nothing
        m = len(context) - 2 * EDGE
        d, whole = np.zeros((m, WIDTH), np.float32), np.zeros_like(x)
        put(d, place, back)
        to_scale = np.stack([np.einsum("pw,pw->w", x[EDGE + s : EDGE + s + m], d) for s in SIDES])
        for s, scale in zip(SIDES, self.scale, strict=True):
            whole[EDGE + s : EDGE + s + m] += d * scale
        self._step(self.scale, squares[1], slice(None), to_scale, rate)
        self._step(self.bias, squares[2], slice(None), np.ones(len(h), np.float32) @ back, rate)
        order, begin, row = grouped(context)
        self._step(self.inputs, squares[0], row, sums(whole, order, begin), rate)

    @staticmethod
    def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray | slice, g: np.ndarray, rate: float) -> None:
        if isinstance(rows, slice):
            s, old = squares[rows] + g * g, table[rows]
            squares[rows] = s
            table[rows] = old - rate * g / np.sqrt(s)
            return
        s = squares.take(rows, axis=0)
        s += g * g
        put(squares, rows, s)
        g *= rate
        g /= np.sqrt(s, out=s)
        put(table, rows, np.subtract(table.take(rows, axis=0), g, out=g))


def put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] = values``, a row at a time as one item, which is several times as fast."""
    item = np.dtype((np.void, table.nbytes // len(table)))
    np.put(table.view(item), rows, values.view(item))


def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal rows together, where each begins in it, and the distinct rows; rows are below 65,536."""
    rows = rows.astype(LEAF)  # numpy sorts two bytes by radix
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return order, begin, rows[begin].astype(np.int64)


def sums(values: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``values`` in groups, two numbers at a time as a complex one."""
    return np.add.reduceat(values.take(order, axis=0).view(np.complex64), begin, axis=0).view(np.float32)


def contexts(*leaves: np.ndarray) -> np.ndarray:
    """The input rows of texts one after another, with edges before, between and after them."""
    edge = np.zeros(EDGE, LEAF)
    return np.concatenate([edge, *(part for leaf in leaves for part in (leaf + LEAF(1), edge))])


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all rows of column ``text``; a task sums what it has met before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(counts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        counts, size = [], 0
        for batch in batches:
            word, n = split(batch.column(0))[1].value_counts().flatten()
            counts.append(pa.table({"word": word.cast(pa.string()), "n": n}))
            size += len(n)
            if size > TASK_WORDS:
                counts = [summed(counts)]
                size = len(counts[0])
                if 2 * size > TASK_WORDS:
                    yield from counts[0].to_batches()
                    counts, size = [], 0
        if counts:
            yield from summed(counts).to_batches()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Fit:
    """A network in training on texts that come one by one; every word is once the target of a step."""

    def __init__(self, words: Words, seed: int, batch: int, rate: float = 0.1):
        self.words, self.batch, self.rate, self.net = words, batch, rate, WindowNet.start(seed, words.leaves)
        self.squares = [np.full_like(p, 1e-2) for p in self.net.parameters()]
        self.seen, self.size, self.held = 0, 0, [contexts()]

    def add(self, leaf: np.ndarray) -> None:
        """A text, by its leaves."""
        if len(leaf):
            self.held.append(contexts(leaf)[EDGE:])
            self.size += len(leaf)
            if self.size >= self.batch:
                self.learn(whole=True)

    def learn(self, whole: bool) -> None:
        """Steps on what is held, as long as ``whole`` batches are left, or on all."""
        held = np.concatenate(self.held)  # begins with the two places before the next word
        place = EDGE + np.flatnonzero(held[EDGE:])
        stop = len(place) // self.batch * self.batch if whole else len(place)
        for k in range(0, stop, self.batch):
            at = place[k : k + self.batch]
            self.net.learn(self.words, held[at[0] - EDGE : at[-1] + EDGE + 1], held[at].astype(np.int64) - 1, self.rate, self.squares)
        self.seen, self.size = self.seen + stop, len(place) - stop
        self.held = [held[place[stop] - EDGE :] if self.size else contexts()]

    def done(self) -> tuple[WindowNet, int]:
        if self.size:
            self.learn(whole=False)
        return self.net, self.seen


def fitted(texts: Iterable[str | None], words: Words, seed: int) -> tuple[WindowNet, int]:
    """The network that is trained on ``texts``, and the number of their words."""
    fit = Fit(words, seed, BATCH)
    for text in texts:
        fit.add(words.encoded(text))
    return fit.done()


def train(rows: DataFrame, words: Words, total: int, seed: int) -> WindowNet:
    """The average of the networks of all groups of ``rows`` (``digest, leaves``), which have ``total`` words."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(words)
    columns = "part long, seen double, net binary"
    parts = max(1, -(-total // GROUP_WORDS))

    def row(part: int, seen: float, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.float64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["part", "seen", "net"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, None
        for batch in batches:
            for p, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if at is not None:
                        yield row(part, *flat(*at.done()))
                    part, at = p, Fit(shared.value, seed, BATCH)
                at.add(np.frombuffer(leaves, LEAF))
        if at is not None:
            yield row(part, *flat(*at.done()))

    def flat(net: WindowNet, seen: int) -> tuple[float, np.ndarray]:
        return float(seen), np.concatenate([p.ravel() for p in net.parameters()])

    def mean(nets: pa.Table) -> pa.Table:
        nets = nets.sort_by("part")
        seen = np.array(nets.column("seen").to_pylist())
        share = seen / seen.sum() if seen.sum() else np.full(len(seen), 1 / len(seen))
        total = sum(w * np.frombuffer(net.as_py(), np.float32) for w, net in zip(share, nets.column("net"), strict=True))
        return pa.Table.from_batches([row(nets.column("part")[0].as_py() // FAN_IN, float(seen.sum()), total)])

    dealt = rows.where(F.octet_length("leaves") > 0).select(F.pmod("digest", F.lit(parts)).alias("part"), F.xxhash64("digest").alias("place"), "leaves")
    dealt = dealt.repartitionById(min(parts, MOST_TASKS), F.pmod("part", F.lit(min(parts, MOST_TASKS))).cast("int")).sortWithinPartitions("part", "place", "leaves").select("part", "leaves")
    nets = cut(dealt.mapInArrow(fit, columns))
    while nets.count() > 1:
        nets = cut(nets.groupBy(F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(mean, columns))
    net, found = WindowNet.start(seed, words.leaves), nets.select("net").head()
    if found:
        values, at = np.frombuffer(found.net, np.float32), 0
        for p in net.parameters():
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
    return net


def vocabulary(counts: DataFrame) -> tuple[Words, DataFrame, int]:
    """What is sent of the words, the counts of those without a leaf of their own (``word, n``), and the number of all words.

    A word has its own leaf if its count is at least the smallest that not more than VOCABULARY words reach, in steps.
    """
    level = F.floor(F.log2("n") * STEPS)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    least, size = math.inf, 0
    for r in levels:
        size += r.words
        if size > VOCABULARY:
            break
        least = r.level
    frequent = [(r.word, r.n) for r in counts.where(level >= F.lit(float(least))).collect()]
    others = counts.where(level < F.lit(float(least)))
    rest = sum(r.words for r in levels) - len(frequent)
    bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(rest_leaves(rest))).cast("int")
    mass = {r.k: r.n for r in others.groupBy(bucket.alias("k")).agg(F.sum("n").alias("n")).collect()}
    return Words.counted(sorted(frequent, key=lambda p: (-p[1], p[0])), rest, mass), others, sum(r.n for r in levels)


def coded(rows: DataFrame, words: Words) -> DataFrame:
    """``row, doc_id, digest, leaves, left`` of each row (``doc_id, text``): its number, its words' leaves, and the words that have none of their own, with a space between."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = shared.value
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            text, leaf, left = words.coded(batch.column(1))
            stop = np.searchsorted(text, np.arange(batch.num_rows + 1)) * LEAF().itemsize
            leaves = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(leaf)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), batch.column(0), batch.column(2), leaves, left], names=["row", "doc_id", "digest", "leaves", "left"])
            at += batch.num_rows

    # written, so that a row's number stays the same
    return cut(rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("digest")).mapInArrow(run, "row long, doc_id long, digest long, leaves binary, left string"))


def score(documents: DataFrame, seed: int = 3) -> DataFrame:
    """``doc_id, mean_log_likelihood, log_likelihood, n_words`` of every whole text (``doc_id, text``).

    The log-likelihood is the sum of every word's conditional log-probability given both sides.  Null and empty texts
    have 0 words, the sum 0 and a null mean.  Repeated rows are scored each for itself and count each in training; a null ``doc_id`` is
    kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = prepared(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words, others, total = vocabulary(cut(count_words(rows)))
    texts = coded(rows, words)
    shared = spark.sparkContext.broadcast((words, train(texts, words, total, seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        for batch in batches:
            codes = [np.frombuffer(b, LEAF) for b in batch.column(2).to_pylist()]
            n = np.array([len(c) for c in codes], np.int64)
            total = np.zeros(len(codes))
            if n.sum():
                y = np.concatenate(codes).astype(np.int64)
                each = net.log_probabilities(words, contexts(*codes), y) + words.share[y]
                total = np.bincount(np.repeat(np.arange(len(codes)), n), each, len(codes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total)], names=["row", "doc_id", "n_words", "sum"])

    # the counts of words that have no leaf of their own weren't sent; they are added by word
    scored = texts.select("row", "doc_id", "leaves").mapInArrow(run, "row long, doc_id long, n_words long, sum double")
    pairs = texts.where("left != ''").select("row", F.explode(F.split("left", " ")).alias("word"))
    added = pairs.join(others, "word").groupBy("row").agg(F.sum(F.log("n")).alias("added"))
    whole = scored.join(added, "row", "left").withColumn("log_likelihood", F.col("sum") + F.coalesce("added", F.lit(0.0)))
    return whole.select("doc_id", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"), "log_likelihood", "n_words")
