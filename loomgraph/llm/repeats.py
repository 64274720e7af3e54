"""Removal of repeated passages: every byte covered by a string of 400 bytes that also starts anywhere else.

A string of 400 bytes belongs to its anchor, the 64 bytes in it of lowest hash (the leftmost of equals), so equal strings
have equal anchors at equal places.  The strings of one anchor's occurrence form one context.  Contexts that are equal to
the byte are counted, not compared, and a context whose anchor occurs once is done with.  The rest, different contexts
of one anchor, go by anchor to shards: suffix arrays with common prefixes find the repeated strings in a shard, and where
an anchor's contexts go on in the next shard, their strings are looked up in the former by binary search.  An anchor with
very many different contexts is refined first: its strings are halved by the anchor's place in them, a half is grouped by
the bytes that all its strings share, and equal pieces are counted again, so no task gets more than LARGE of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, let_go, prepared
from loomgraph.llm.shingles import mixed
from loomgraph.llm.suffixes import Shard, find_sorted

LEAST = 400
GRAM = 64
#: Different contexts of an anchor that go to one task, bytes of a shard, bytes that are hashed at once.
LARGE = 128
SHARD_BYTES = 1 << 20
CHUNK = 4 << 20
PLACE_BITS = np.uint64((1 << 24) - 1)

#: A piece: the strings with the anchor at places ``low``..``high`` in them, of one context.
PIECE = "key long, node int, context binary, low int, high int, bytes binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes, by doubling."""
    h, size = mixed(data.astype(np.uint64)), 1
    while size < GRAM:
        factor = mixed(np.array([size], np.uint64))[0] | np.uint64(1)
        h = h[:-size] * factor + h[size:]
        size *= 2
    return mixed(h)


def lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` keys in a row."""
    n = len(keys) - width + 1
    rows = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each run of strings with one anchor: text, first start, number of starts, anchor's place in the first string, anchor's hash, digest (two numbers)."""
    out, held, size = [], [], 0

    def done() -> None:
        data = np.frombuffer(b"".join(texts[t][a : a + n] for t, a, n in held), np.uint8)
        hashes = gram_hashes(data)
        keys = (hashes & ~PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (lowest(keys, LEAST - GRAM + 1) & PLACE_BITS).astype(np.int64)
        sizes = np.array([n for _, _, n in held])
        piece = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(len(anchor))
        valid = at + LEAST <= (begin + sizes)[piece]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        stop = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]])) + 1
        raw, digests = data.tobytes(), bytearray()
        view = memoryview(raw)
        for a, b, c in zip(first.tolist(), stop.tolist(), (anchor[first] - first).tolist(), strict=True):
            digests += xxhash.xxh3_128_digest(view[a : b - 1 + LEAST], seed=c)
        digest = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
        text, shift = np.array([t for t, _, _ in held]), np.array([a for _, a, _ in held]) - begin
        out.append((text[piece[first]], first + shift[piece[first]], stop - first, anchor[first] - first, hashes[anchor[first]].astype(np.int64), digest[:, 0], digest[:, 1]))

    for t, text in enumerate(texts):
        for a in range(0, len(text) - LEAST + 1, CHUNK):
            n = min(CHUNK + LEAST - 1, len(text) - a)
            held.append((t, a, n))
            size += n
            if size >= CHUNK:
                done()
                held, size = [], 0
    if held:
        done()
    kinds = (np.int64,) * 7
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)) if out else tuple(np.zeros(0, k) for k in kinds)


def occurrences(texts: DataFrame) -> DataFrame:
    """All contexts of all rows (``id, mark, text``)."""
    names = ["id", "mark", "start", "count", "place", "anchor", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, count, place, anchor, d1, d2 = contexts([(t or "").encode() for t in batch.column(2).to_pylist()])
            own = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(start), pa.array(count, pa.int32()), pa.array(place, pa.int32()), pa.array(anchor), pa.array(d1), pa.array(d2)], names=names)

    return texts.select("id", "mark", "text").mapInArrow(run, "id long, mark long, start long, count int, place int, anchor long, d1 long, d2 long")


def _node(node: int) -> tuple[int, int]:
    """The places of node ``node`` (1 is the root, 2k and 2k+1 the halves of k)."""
    low, high = 0, LEAST - GRAM
    for bit in bin(node)[3:]:
        middle = (low + high) // 2
        low, high = (low, middle) if bit == "0" else (middle + 1, high)
    return low, high


def halved(pieces: DataFrame) -> DataFrame:
    """Each piece of node k as up to two, of nodes 2k and 2k+1, grouped anew by the bytes that a half's strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                anchor = r["high"]  # its place in the piece, which begins with the string that has it furthest on
                for child in (2 * r["node"], 2 * r["node"] + 1):
                    low, high = _node(child)
                    a, b = max(low, r["low"]), min(high, r["high"])
                    if a <= b:
                        core = r["bytes"][anchor - low : anchor - high + LEAST]
                        own = r["bytes"][anchor - b : anchor - a + LEAST]
                        out.append({**r, "key": xxhash.xxh3_64_intdigest(core, seed=r["key"] & (2**64 - 1)) - 2**63, "node": child, "low": a, "high": b, "bytes": own})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return pieces.select("key", "node", "context", "low", "high", "bytes").mapInArrow(run, PIECE)


def repeated_in_shards(pieces: DataFrame) -> DataFrame:
    """``context, low, high``: places of the anchor in strings of a context that another piece of the same key has too.

    ``pieces`` come sorted by key within partitions that hold whole keys.
    """
    columns = "context binary, low int, high int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        before: list[dict] = []  # strings of the key that goes on, in former shards

        def found(rows: list[dict], marks: list[np.ndarray]) -> pa.RecordBatch:
            context, low, high = [], [], []
            for r, m in zip(rows, marks, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    context.append(r["context"])
                    low.append(r["high"] - b + 1)
                    high.append(r["high"] - a)
            return pa.RecordBatch.from_arrays([pa.array(context, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["context", "low", "high"])

        def shard(rows: list[dict], goes_on: bool) -> Iterator[pa.RecordBatch]:
            nonlocal before
            array = Shard([r["bytes"] for r in rows])
            counts = np.array([r["high"] - r["low"] + 1 for r in rows])
            marks = [np.zeros(c, bool) for c in counts]
            base = np.cumsum(counts) - counts
            mark = np.zeros(int(counts.sum()), bool)
            slot = np.full(len(array.bytes), -1, np.int64)  # of the suffixes that start a whole string
            for k in range(len(rows)):
                slot[array.begin[k] : array.begin[k] + counts[k]] = base[k] + np.arange(counts[k])
            shared = np.zeros(len(mark), np.int64)
            for step, h in enumerate(array.common_with_previous(array.begin, counts, LEAST)):
                shared[base[counts > step] + step] = h
            order = slot[array.order]
            order = order[order >= 0]  # whole strings alone; an equal one is next to it, for what is between is equal too
            same = shared[order] >= LEAST
            same[:1] = False
            mark[order[same]] = True
            mark[order[np.flatnonzero(same) - 1]] = True
            start = np.flatnonzero(slot >= 0)[np.argsort(slot[slot >= 0])]
            keys = np.repeat([r["key"] for r in rows], counts)
            nodes = np.repeat([r["node"] for r in rows], counts)
            for old in before:
                own = np.flatnonzero((keys == old["key"]) & (nodes == old["node"]))
                if len(own):
                    query = array.windows(start[own], LEAST)
                    at = np.minimum(find_sorted(query, old["known"]), len(old["known"]) - 1)
                    equal = (old["known"][at] == query).all(axis=1)
                    mark[own[equal]] = True
                    late = np.zeros(len(old["known"]), bool)
                    late[at[equal]] = True
                    yield found(old["rows"], np.split(late[np.argsort(old["order"])], np.cumsum(old["counts"])[:-1]))
            marks = np.split(mark, np.cumsum(counts)[:-1])
            yield found(rows, marks)
            last = rows[-1]["key"], rows[-1]["node"]
            if not goes_on:
                before = []
                return
            kept = [k for k, r in enumerate(rows) if (r["key"], r["node"]) == last]
            own = order[np.isin(order, np.concatenate([base[k] + np.arange(counts[k]) for k in kept]))]  # in the order of suffixes
            position = np.empty(len(mark), np.int64)
            position[np.concatenate([base[k] + np.arange(counts[k]) for k in kept])] = np.arange(len(own))
            before = [o for o in before if (o["key"], o["node"]) == last]
            before.append({"key": last[0], "node": last[1], "rows": [rows[k] for k in kept], "counts": counts[kept], "known": array.windows(start[own], LEAST), "order": position[own]})

        for batch in batches:
            for r in batch.to_pylist():
                if size >= SHARD_BYTES:
                    yield from shard(held, (held[-1]["key"], held[-1]["node"]) == (r["key"], r["node"]))
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield from shard(held, False)

    return pieces.select("key", "node", "context", "low", "high", "bytes").mapInArrow(run, columns)


def repeated_strings(pieces: DataFrame) -> DataFrame:
    """``context, low, high`` over all pieces (``PIECE``), small keys in shards and large ones refined first."""
    spark = pieces.sparkSession
    # a number of its own: by their few bytes, what is most work for a byte would be put into few tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.createDataFrame([], "context binary, low int, high int")
    while True:
        pieces = cut(pieces)
        let_go(spark)  # what the pieces were made of: the first time, texts
        # equal pieces of different contexts count together: their strings are repeated
        kinds = pieces.withColumn("h1", F.xxhash64(F.lit(1), "low", "high", "bytes")).withColumn("h2", F.xxhash64(F.lit(2), "low", "high", "bytes"))
        kind = ["key", "node", "h1", "h2"]
        counted = cut(kinds.groupBy(*kind).agg(F.count("*").alias("pieces"), F.min("context").alias("first")))
        sizes = cut(counted.groupBy("key", "node").agg(F.count("*").alias("kinds")))
        placed = cut(kinds.join(counted, kind).join(sizes, ["key", "node"]))
        found = found.unionByName(placed.where("pieces > 1").select("context", "low", "high"))
        # one piece of each kind meets the other kinds; what it shares holds for those equal to it, too
        one = placed.where((F.col("kinds") > 1) & (F.col("context") == F.col("first")))
        small = one.where(F.col("kinds") <= LARGE).repartition(parts, "key", "node").sortWithinPartitions("key", "node", "context")
        met = repeated_in_shards(small)
        found = found.unionByName(met)
        large = one.where(F.col("kinds") > LARGE)
        if large.isEmpty():
            return found
        pieces = halved(large.select("key", "node", "context", "low", "high", "bytes"))


def _key(frame: DataFrame) -> DataFrame:
    """A row's own key: its id (null as a number that ids don't have) and a hash of its text."""
    return frame.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("mark", F.xxhash64("text"))


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """``id, mark, start, stop``: bytes of each text (``id, mark, text``) that repeated strings cover, one row a run of them."""
    found = cut(occurrences(texts))
    # written first: a join with what an aggregate by the same key has just made isn't split where an anchor is very common
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("d1").alias("least"), F.max("d1").alias("most")).where("n > 1")
    anchors = cut(anchors.select("anchor", (F.col("least") != F.col("most")).alias("mixed")))
    shared = cut(found.join(anchors, "anchor"))
    whole = shared.where(~F.col("mixed")).select("id", "mark", "start", (F.col("start") + F.col("count") - 1 + LEAST).alias("stop"))
    # different contexts of one anchor: one occurrence of each stands for all, with its bytes
    del found, anchors
    mixed_ = shared.where("mixed")
    kind = ["anchor", "d1", "d2"]
    classes = cut(mixed_.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "start", "count", "place")).alias("at")))
    context = F.concat(*(F.to_binary(F.lpad(F.hex(c), 16, "0"), F.lit("hex")) for c in ("d1", "d2")))
    wanted = classes.select("at.id", "at.mark", F.struct("anchor", context.alias("context"), "at.start", "at.count", "at.place").alias("want")).groupBy("id", "mark").agg(F.collect_list("want").alias("wants"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = (text or "").encode()
                for w in wants:
                    out.append({"key": w["anchor"], "node": 1, "context": w["context"], "low": w["place"] - w["count"] + 1, "high": w["place"], "bytes": content[w["start"] : w["start"] + w["count"] - 1 + LEAST]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("node", pa.int32()), ("context", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())]))

    let_go(texts.sparkSession)  # before texts are shuffled
    # not named here, so that the shuffled texts can be let go of there
    strings = repeated_strings(texts.join(wanted, ["id", "mark"]).select("text", "wants").mapInArrow(slices, PIECE).dropDuplicates(["key", "context"]))
    let_go(texts.sparkSession)  # before the caller shuffles texts again
    met = strings.groupBy("context").agg(F.collect_list(F.struct("low", "high")).alias("places"))
    counted = classes.select(*kind, context.alias("context"), "n").join(met, "context", "left")
    known = counted.where((F.col("n") > 1) | F.col("places").isNotNull()).select(*kind, "n", "places")
    hits = mixed_.join(known, kind)
    all_ = F.array(F.struct((F.col("place") - F.col("count") + 1).alias("low"), F.col("place").alias("high")))
    each = hits.select("id", "mark", "start", "place", F.explode(F.when(F.col("n") > 1, all_).otherwise(F.col("places"))).alias("p"))
    part = each.select("id", "mark", (F.col("start") + F.col("place") - F.col("p.high")).alias("start"), (F.col("start") + F.col("place") - F.col("p.low") + LEAST).alias("stop"))
    return whole.unionByName(part)


def without_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for each row of ``documents`` (``doc_id, text``); ``kept`` is what is left, in bytes.

    Null and empty texts, and all under 400 bytes, lose nothing.  A repeated row is a copy like any other, so both lose
    what they share.  Other columns are ignored; an empty table gives an empty result.  Strings never cross rows, and
    are judged on the input.
    """
    prepared(documents.sparkSession)
    texts = _key(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    runs = repeated_intervals(texts.where(F.octet_length("text") >= LEAST).select("id", "mark", "text"))
    by_text = runs.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                content, left, at, removed, n = (text or "").encode(), [], 0, 0, 0
                stop = -1
                for a, b in sorted((r["start"], r["stop"]) for r in spans or []):
                    if a > stop:  # runs that touch are one
                        left.append(content[at:a])
                        n += 1
                        removed += b - a
                    elif b > stop:
                        removed += b - stop
                    at = stop = max(stop, b)
                out.append((len(content), removed, n, b"".join([*left, content[at:]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=names)

    joined = texts.join(by_text, ["id", "mark"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(documents: DataFrame) -> DataFrame:
    """``without_repeats`` with the digest of what is left: ``doc_id, n_removed, n_bytes, n_spans, kept_sha256``."""
    return without_repeats(documents).select("doc_id", "n_removed", "n_bytes", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
