"""N-gram Jaccard join of texts by chosen paths, repeated until the target recall.

Texts of equal shingle sets are one class.  Every class is embedded as the minima of 128 hash functions over its set; a
run then splits the classes recursively: at each node two places of the embedding are drawn, and classes that share a
place's token go to one child.  Classes that meet at the end of a path are compared by their embeddings.  A bucket that
is still large is split on by one more place a level; one that is large at the deepest level is a candidate group as a
whole, so none of its pairs is left out.  Runs are repeated until a pair at the threshold is missed with less than
``1 - recall``, counted over the deepest paths.  What has met forms candidate groups; in these every pair is compared
exactly, by whole shingle sets in pairs of blocks, so that within a group no link is lost however the members met.
Only sums of links and one local root a class leave a pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, prepared
from loomgraph.llm.components import connected_components
from loomgraph.llm.shingles import Shingler, mixed

PLACES = 128
DEPTH = 3
#: Classes of a bucket that are compared all with all, and deepest path of a larger one.
BUCKET = 128
DEEPEST = 6
#: Classes of a block of a candidate group, and shingles in it.
BLOCK = 256
BLOCK_SHINGLES = 1 << 18


def missed(threshold: float, depth: int, deepest: int) -> float:
    """The chance that one run misses a pair at the threshold: the tree of paths, with one child from ``depth`` on, dies out."""
    q = 0.0
    for _ in range(deepest - depth):
        q = 1 - threshold * (1 - q)
    for _ in range(depth):
        q = (1 - threshold * (1 - q)) ** 2
    return q


def runs_for(recall: float, threshold: float, depth: int = DEPTH, deepest: int = DEEPEST) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed(threshold, depth, deepest))))


def paths(runs: int, depth: int, seed: int) -> np.ndarray:
    """The places drawn along each path: [path, level]; two children a node, no place twice in a path."""
    draw, out = np.random.default_rng(seed), []

    def grow(path: list[int]) -> None:
        if len(path) == depth:
            out.append(path)
            return
        for place in draw.choice([p for p in range(PLACES) if p not in path], 2, replace=False):
            grow([*path, int(place)])

    for _ in range(runs):
        grow([])
    return np.array(out)


def embedding(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """Minima of PLACES hash functions over each set, 32 bits each."""
    draw = np.random.default_rng(seed)
    a, b = draw.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, PLACES, dtype=np.uint64)
    out = np.zeros((len(sets), PLACES), np.uint32)
    for k, s in enumerate(sets):
        low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 256):
            np.minimum(low, ((s[at : at + 256, None] ^ b) * a).min(axis=0), out=low)
        out[k] = low >> np.uint64(32)
    return out


def spread(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def sketches(documents: DataFrame, runs: int, seed: int) -> DataFrame:
    """``doc_id, key, size, sketch, paths`` of every row; ``key`` is a digest of its ``size`` shingles, null without words or id.

    A sketch has the lowest byte of each minimum, which is enough to compare two; paths are of whole minima.
    """
    drawn = paths(runs, DEPTH, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingled = Shingler()
        for batch in batches:
            sets = [shingled(t) for t in batch.column(1).to_pylist()]
            some = [len(s) > 0 and i.is_valid for s, i in zip(sets, batch.column(0), strict=True)]
            low = embedding([s for s, x in zip(sets, some, strict=True) if x], seed)
            ends = np.tile(mixed(np.arange(len(drawn), dtype=np.uint64)), (len(low), 1))
            for level in range(DEPTH):
                ends = mixed(ends ^ low[:, drawn[:, level]].astype(np.uint64) * np.uint64(2 * level + 3))
            row = iter(range(len(low)))
            at = [next(row) if x else None for x in some]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([None if k is None else xxhash.xxh3_128_digest(s.tobytes()) for s, k in zip(sets, at, strict=True)], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if k is None else low[k].astype(np.uint8).tobytes() for k in at], pa.binary()),
                    pa.array([None if k is None else ends[k].astype(np.int64) for k in at], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "size", "sketch", "paths"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, size long, sketch binary, paths array<long>")


def met_in_buckets(rows: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` from each class to the first of those it reaches in its bucket over estimates of at least ``least``.

    ``rows`` (``path, id, sketch``) come sorted within partitions that hold whole buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(bucket: np.ndarray, ids: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
            left, right, d = [], [], 1
            while d < len(bucket):
                at = np.flatnonzero(bucket[d:] == bucket[:-d])
                if not len(at):
                    break
                at = at[(low[at] == low[at + d]).mean(axis=1) >= least]
                left.append(at)
                right.append(at + d)
                d += 1
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            root = spread(a, b, len(bucket))
            some = np.flatnonzero(root != np.arange(len(bucket)))
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, PLACES)
            held = new if held is None else tuple(map(np.concatenate, zip(held, new, strict=True)))
            done = int((held[0] == held[0][-1]).argmax())  # the last bucket may go on in the next batch
            if done:
                yield links(*(x[:done] for x in held))
                held = tuple(x[done:] for x in held)
        if held is not None:
            yield links(*held)

    return rows.select("path", "id", "sketch").mapInArrow(run, "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """Links of the same components as ``links`` (``a, b``), few of them: each a keeps one to its smallest b, which takes over the others.

    A class has a link for each path on which it met a class before it, so there are few to one a, and in a large group
    most lead to the same smallest classes.
    """
    w = links.where("a <> b").withColumn("least", F.min("b").over(Window.partitionBy("a")))
    own = w.select("a", F.col("least").alias("b"))
    return own.unionByName(w.where("b <> least").select(F.col("least").alias("a"), "b")).distinct()


def shared_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections, by products over slices of the tokens that more than one set has."""
    n = len(sets)
    owner, token = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    _, place, count = np.unique(token, return_inverse=True, return_counts=True)
    common = count[place] > 1
    owner, place = owner[common], (np.cumsum(count > 1) - 1)[place[common]]
    order = np.argsort(place, kind="stable")
    owner, place, out = owner[order], place[order], np.zeros((n, n))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, (low, low + 4096))
        x = np.zeros((n, 4096), np.float32)
        x[owner[a:b], place[a:b] - low] = 1
        out += x @ x.T
    return out


def compared(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of blocks by whole sets: ``id, links`` (documents of the other classes) and ``root``."""
    _, first = np.unique(table.column("id").to_numpy(), return_index=True)  # an id whose row is repeated comes once
    table = table.take(pa.array(first))
    ids, weight, block = (table.column(c).to_numpy() for c in ("id", "n", "block"))
    sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
    size = np.array([len(s) for s in sets], np.float64)
    both = shared_sizes(sets)
    met = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(met, False)
    if table.column("i")[0] != table.column("j")[0]:
        met &= block[:, None] != block[None, :]
    links = met @ weight
    root = ids[spread(*np.nonzero(met), len(ids))]
    some = links > 0
    return pa.table({"id": ids[some], "links": links[some].astype(np.int64), "root": root[some]})


def jaccard_join(documents: DataFrame, threshold: float = 0.8, recall: float = 0.9999, seed: int = 5) -> DataFrame:
    """``doc_id, class_id, n_links, component_id, kept`` for each row of ``documents`` (``doc_id, text``).

    ``class_id`` is the smallest id of the same shingle set, ``n_links`` the number of other documents at the threshold
    or above (copies included), ``component_id`` the smallest id that links reach, ``kept`` whether it is the row's own.
    Texts without words, null ones included, and rows without id have no links, are their own class, and are kept.  A
    repeated row counts as a document of its own.  Other columns are ignored; an empty table gives an empty result.
    """
    prepared(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = cut(sketches(rows, runs_for(recall, threshold), seed))
    first = [F.first(c).alias(c) for c in ("size", "sketch", "paths")]
    classes = cut(sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), *first))
    embedded = classes.select("id", "sketch")

    def counted(ends: DataFrame) -> DataFrame:
        """Rows of buckets of several; counts are written before they are joined: Spark splits a very common path's rows only in a join of two shuffles."""
        sizes = cut(ends.groupBy("path").agg(F.count("*").alias("many"), F.min("id").alias("least")).where("many > 1"))
        return cut(ends.join(sizes, "path"))

    shared, small, depth = counted(classes.select("id", F.explode("paths").alias("path"))), [], DEPTH
    while True:
        small.append(shared.where(F.col("many") <= BUCKET).select("path", "id"))
        large = shared.where(F.col("many") > BUCKET)
        if depth == DEEPEST or large.isEmpty():
            break
        # the next place of a path follows from the path itself; its token is that byte of the sketch
        place = F.pmod(F.xxhash64("path", F.lit(depth)), F.lit(PLACES)).cast("int")
        shared, depth = counted(cut(large.select("path", "id").join(embedded, "id").select("id", F.xxhash64("path", F.substring("sketch", place + 1, F.lit(1))).alias("path")))), depth + 1
    dealt = reduce(DataFrame.unionByName, small).join(embedded, "id").repartition("path").sortWithinPartitions("path", "id")
    met = met_in_buckets(dealt, threshold - 0.15).unionByName(large.select(F.col("id").alias("a"), F.col("least").alias("b")))
    groups = cut(connected_components(contracted(met)).join(classes.select("id", "n", "key", "size"), "id"))

    many = F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)
    blocks = cut(groups.groupBy("component").agg(F.ceil(many).cast("int").alias("h")))
    placed = groups.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("h")).cast("int"))
    members = placed.join(rows.select(F.col("doc_id").alias("id"), "text"), "id").select("component", "id", "n", "block", "h", "key", "text")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingled = Shingler()
        for batch in batches:
            sets = [shingled(t).tobytes() for t in batch.column(6).to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column(5).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.filter(own) for c in batch.columns[:5]), pa.array(sets, pa.binary()).filter(own)], names=["component", "id", "n", "block", "h", "set"])

    sets = members.mapInArrow(with_sets, "component long, id long, n long, block int, h int, set binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    verified = cut(sets.select("component", "id", "n", "block", "set", F.explode(pairs).alias("p")).select("component", "id", "n", "block", "set", "p.i", "p.j").groupBy("component", "i", "j").applyInArrow(lambda t: compared(t, threshold), "id long, links long, root long"))
    components = connected_components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = verified.groupBy("id").agg(F.sum("links").alias("links")).join(components, "id", "left")
    of_class = classes.select("key", "id", "n").join(linked, "id", "left")
    of_class = of_class.select("key", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    worded = sketched.select("doc_id", "key").join(of_class, "key").select("doc_id", F.col("id").alias("class_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = sketched.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return worded.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
