"""The trie of conversations' turns, from the lengths that sorted neighbours have in common.

Each turn is a digest and a count of words, each conversation the concatenation of its turns' codes, each distinct
sequence one row.  These are sorted; an edge joins every two neighbours at the depth they share.  Within a block of
sorted rows a union-find takes the edges in descending depth: a component that merges at a lesser depth closes its chain
of nodes, and the merge makes the branching node.  Nodes that hold a block's first or last row, as far as the row beyond
the border shares them, are left open: the block's forest is contracted to them, and they are merged across borders by
their prefix.  What is open is at most twice the depth for each block.

A node that several blocks hold is counted as a node by the first of them, so everything else about it is a sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import cut, prepared

#: Conversations are rebuilt from the one that begins their group of so many, of which they take fewer turns than LEADS.
GROUP, LEADS = 20, 4
#: Bytes of a turn's code: a digest's and the count of its words.
DIGEST, COUNT = 16, 4
CODE = DIGEST + COUNT
#: Bytes and rows of a block, of which one task holds one at a time.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 50_000
#: Characters of a piece of ids, and nodes across borders that are sent to every executor at most.
PIECE_CHARS, BROADCAST_ROWS = 1 << 16, 200_000

NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, code`` of every row that has a ``conv_id``; null roles and texts are empty ones."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256), 1, 2 * DIGEST)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), 2 * COUNT, "0")
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(digest, words).alias("code"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path`` of every conversation: the first turns of its group's first conversation, then its own after as many.

    One shuffle, of codes: a group's conversations are together, and each conversation's turns with them.
    """
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    own = turns(conversations).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code"))).alias("turns"))
    own = own.select("base", "conv_id", F.col("turns.code").alias("codes"), (F.crc32(F.col("conv_id").cast("string")) % LEADS).cast("int").alias("h"))
    lead = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("codes", 1, LEADS - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    led = own.withColumn("lead", F.coalesce(lead, F.array().cast("array<string>")))
    codes = F.concat(F.slice("lead", F.lit(1), F.col("h")), F.slice("codes", F.col("h") + 1, F.size("codes")))
    return led.select("conv_id", F.unhex(F.array_join(codes, "")).alias("path"))


def ends(members: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``key, ends_sha256``: for each key of ``members`` (``key, conv_id``) the digest of its ids, in order, joined by commas.

    Rows are sorted by key and id in ranges, so a key's ids may lie in many partitions; what such a key has in each is
    joined to pieces of text, and the pieces are hashed in order.  SHA-256 takes its input in sequence; a key's pieces
    pass one by one, with nothing but the hash's state kept.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, length, parts, whole = None, None, 0, [], False
        out: list[tuple] = []

        def close(last: bool) -> None:
            # what lies between the borders of a partition is complete
            text = ",".join(parts)
            done = whole and not last
            out.append((key, first, None if done else text, hashlib.sha256(text.encode()).hexdigest() if done else None))

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        close(False)
                    whole, key, first, length, parts = key is not None, k, i, 0, []
                elif length >= piece_chars:
                    whole = False
                    close(True)
                    first, length, parts = i, 0, []
                parts.append(str(i))
                length += len(parts[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "first", "text", "sha"])
                out.clear()
        if key is not None:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "first", "text", "sha"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if k == key:
                    state.update(b"," + text.as_py().encode())
                    continue
                if key is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    found = cut(members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first long, text string, sha string"))
    complete = found.where("sha is not null").select("key", F.col("sha").alias("ends_sha256"))
    split = found.where("sha is null").repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")
    return complete.union(split)


def shared(a: bytes, b: bytes) -> int:
    """How many codes two paths have in common from their beginning."""
    low, high = 0, min(len(a), len(b)) // CODE
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * CODE : middle * CODE] == b[low * CODE : middle * CODE]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """A digest of each beginning of ``path`` of 0 to ``depth`` codes."""
    state, out = hashlib.sha256(), []
    for d in range(depth + 1):
        state.update(path[(d - 1) * CODE : d * CODE] if d else b"")
        out.append(state.digest()[:DIGEST])
    return out


def forest(paths: list[bytes], n_convs: list[int], ids: list[int], ends_sha: list[str], left: int, right: int) -> pa.RecordBatch:
    """Nodes (NODE) of the trie of sorted distinct ``paths``; ``left`` and ``right`` are what the rows before and after share with the first and last (-1: none).

    Nodes with a ``key`` are open: what other blocks hold of them is to be added.  Open parents are named by ``parent_key``.
    """
    m = len(paths)
    depth = [len(p) // CODE for p in paths]
    common = [left, *(shared(paths[i - 1], paths[i]) for i in range(1, m)), right]
    words = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, CODE)[:, DIGEST:].astype(np.int64) @ (256 ** np.arange(COUNT - 1, -1, -1))
    offset = np.concatenate([[0], np.cumsum(depth)])
    # components of the union-find: row of the root -> what is known of the component
    root = list(range(m))
    first, last, at, count, least, kids = list(range(m)), list(range(m)), depth[:], n_convs[:], ids[:], [0] * m
    leaves = [int(common[i + 1] < depth[i]) for i in range(m)]
    below, end, node = [0] * m, list(range(m)), list(range(m))
    same = list(range(m))  # nodes made by merges at one depth are one
    chains: list[tuple] = []
    resting: dict[int, tuple] = {}  # a node's depth, smallest id and borders, once it is complete

    def found(of: list[int], x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    def owned(c: int, d: int) -> bool:
        return not (first[c] == 0 and d <= left)

    def close(c: int, to: int, parent: int) -> tuple[int, int]:
        """Closes the chain of component ``c`` down to depth ``to`` + 1; what its parent gets: children and saved words."""
        deep, head = at[c], first[c]
        w = words[offset[head] + max(to, 0) : offset[head] + deep]  # of depths to + 1 ... deep
        if to < 0:
            w = np.concatenate([[0], w])
        mine = np.arange(to + 1, deep + 1) > (left if head == 0 else -1)
        saved = below[c] + np.cumsum((count[c] * w - mine * w)[::-1])[::-1]
        chains.append((c, head, last[c], to, deep, count[c], least[c], leaves[c], kids[c], end[c], saved, parent))
        resting[found(same, node[c])] = (deep, least[c], head == 0, last[c] == m - 1)
        return int(owned(c, to + 1)), int(saved[0])

    for i in sorted(range(1, m), key=lambda i: -common[i]):
        d, x, y = common[i], found(root, i - 1), found(root, i)
        fresh = next((node[c] for c in (x, y) if at[c] == d), None)
        if fresh is None:
            fresh = len(same)
            same.append(fresh)
        n_kids, under, closing = 0, 0, -1
        for c in (x, y):
            if at[c] == d:
                same[found(same, node[c])] = found(same, fresh)
                n_kids, under, closing = n_kids + kids[c], under + below[c], max(closing, end[c])
            else:
                k, s = close(c, d, fresh)
                n_kids, under = n_kids + k, under + s
        root[y] = x
        last[x], at[x], count[x], least[x] = last[y], d, count[x] + count[y], min(least[x], least[y])
        leaves[x], kids[x], below[x], end[x], node[x] = leaves[x] + leaves[y], n_kids, under, closing, found(same, fresh)
    top = found(root, 0)
    close(top, -1, -1)

    keys = prefix_keys(paths[0], left), prefix_keys(paths[-1], right)
    key_of = lambda d, a, b: keys[0][d] if a and d <= left else keys[1][d] if b and d <= right else None
    columns: list[list] = [[] for _ in range(10)]
    for _, head, tail, to, deep, n, low, n_leaves, n_kids, ending, saved, parent in chains:
        a, b = head == 0, tail == m - 1
        for d in range(to + 1, deep + 1):
            over_key = over_id = None
            if d == to + 1 and parent >= 0:
                p_depth, p_low, p_a, p_b = resting[found(same, parent)]
                over_key = key_of(p_depth, p_a, p_b)
                over_id = None if over_key else p_low
            elif d > 0:
                over_key = key_of(d - 1, a, b)
                over_id = None if over_key else low
            deepest = d == deep
            row = (key_of(d, a, b), over_key, low, d, over_id, n, n_kids if deepest else int(not (a and d + 1 <= left)), n_leaves, int(saved[d - to - 1]), ends_sha[ending] if deepest and ending >= 0 else None)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])


def blocks(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, in blocks of bounded bytes and rows."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[0])
            if size >= BLOCK_BYTES or len(held) >= most_rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def borders(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition of sorted ``rows`` that has any, what its first and last path share with their neighbours beyond.

    Two paths a partition are compared; two numbers a partition come to the driver.
    """
    own = rows.groupBy("pid").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    pairs = own.select("pid", "low", F.lag("high").over(Window.orderBy("pid")).alias("before"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [-1 if b is None else shared(b, a) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["pid", "n"])

    found = sorted((r.pid, r.n) for r in pairs.mapInArrow(compared, "pid int, n long").collect())
    after = [n for _, n in found[1:]] + [-1]
    return {pid: (n, right) for (pid, n), right in zip(found, after, strict=False)}


def trie(members: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of ``members`` (``conv_id, path``)."""
    spark = prepared(members.sparkSession)
    keyed = cut(members.withColumn("key", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * DIGEST))))
    distinct = keyed.groupBy("key", "path").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    rows = distinct.join(ends(keyed.select("key", "conv_id")), "key").select("path", "n_convs", "conv_id", "ends_sha256")
    rows = cut(rows.repartitionByRange("path").sortWithinPartitions("path")).withColumn("pid", F.spark_partition_id())
    known = spark.sparkContext.broadcast(borders(rows))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left, right = None, -1, -1
        for block in blocks(batches, block_rows):
            if held is None:
                left, right = known.value[block[0][4]]
            else:
                between = shared(held[-1][0], block[0][0])
                yield forest(*map(list, list(zip(*held, strict=True))[:4]), left, between)
                left = between
            held = block
        if held:
            yield forest(*map(list, list(zip(*held, strict=True))[:4]), left, right)

    nodes = cut(rows.mapInArrow(grown, NODE))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = cut(nodes.where("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *sums, F.max("ends_sha256").alias("ends_sha256")))
    over = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("over"))
    if merged.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        over = F.broadcast(over)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")]
    closed = nodes.where("key is null")
    inside = closed.where("parent_key is null").select(*columns)
    across = closed.where("parent_key is not null").join(over, "parent_key").withColumn("parent_conv_id", F.col("over")).select(*columns)
    top = merged.join(over, "parent_key", "left").withColumn("parent_conv_id", F.col("over")).select(*columns)
    return inside.union(across).union(top)


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations (see ``rebuilt`` and ``trie``).

    Turns are ordered by ``turn`` (null first), those of one number by their digest; repeated rows are turns each.
    Rows without ``conv_id`` are in no conversation.  A conversation without turns ends at the root.  Other columns are
    ignored; an empty table has no node.  Turns are told apart by 128 bits of SHA-256 of role and text, so texts aren't
    shuffled; the codes of one conversation, 20 bytes a turn, are held by one task.
    """
    prepared(conversations.sparkSession)
    return trie(rebuilt(conversations))
