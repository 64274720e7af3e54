"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

First pass: every task summarises the pieces of its documents in a bounded table; the summaries, never the pieces, are
merged in rounds of bounded fan-in.  The most frequent pieces and their lengths in tokens are broadcast as the first
tier.  Second pass: every task looks its pieces up there, then in its worker's own cache, and has the library encode the
rest.  The tiers decide only the speed; a count is always the library's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.byte_bpe import CACHE_CHARS, Pieces, load, special_tokens, splitter
from loomgraph.llm.common import cut, prepared

#: Pieces in the broadcast tier (under 1 MB), distinct pieces a task counts at once, summaries merged by one task.
HOT_PIECES = 8192
TASK_PIECES = 200_000
FAN_IN = 64

SUMMARY = pa.schema([("task", pa.int64()), ("pieces", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _top(counts: Counter, most: int) -> Counter:
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]))


def _summary(task: int, counts: Counter, most: int) -> pa.RecordBatch:
    top = _top(counts, most)
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([list(top)], pa.list_(pa.string())), pa.array([list(top.values())], pa.list_(pa.int64()))], schema=SUMMARY)


def frequent_pieces(texts: DataFrame, most: int = HOT_PIECES) -> list[str]:
    """The most frequent short pieces of column ``text`` over all rows, without the space before them.

    A task that meets more than ``TASK_PIECES`` distinct pieces lets the rarer half go, so its memory is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(text.split(" ")[1:])
            if len(counts) > TASK_PIECES:
                counts = _top(counts, TASK_PIECES // 2)
        short = Counter({p: n for p, n in counts.items() if p and not p[0].isspace() and len(p) <= CACHE_CHARS})
        yield _summary(TaskContext.get().partitionId(), short, most)

    def merge(rows: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        rows = rows.sort_by("task")
        for pieces, n in zip(rows.column("pieces").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            counts.update(dict(zip(pieces, n, strict=True)))
        return pa.Table.from_batches([_summary(rows.column("task")[0].as_py() // FAN_IN, counts, most)])

    columns = "task long, pieces array<string>, counts array<long>"
    summaries = cut(texts.select("text").mapInArrow(count, columns))
    while summaries.count() > 1:
        summaries = cut(summaries.groupBy(F.floor(F.col("task") / FAN_IN).alias("to")).applyInArrow(merge, columns))
    found = summaries.head()
    return list(found.pieces) if found else []


@lru_cache(maxsize=1)
def of_worker(path: str, first_tier: tuple[tuple[str, int], ...]) -> Pieces:
    """Lengths of pieces in tokens; a worker keeps what it has had encoded, in bounded caches, for all its tasks."""
    encode = load(path).encode
    return Pieces(lambda t: len(encode(t, add_special_tokens=False).ids), sum, dict(first_tier))


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 512, hot: int = HOT_PIECES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``documents`` (columns ``doc_id``, ``text``).

    A null or empty text has 0 bytes and 0 tokens.  Repeated rows are counted each for itself; a null ``doc_id`` is
    kept; other columns are ignored; an empty table gives an empty result.  Texts are never cut.
    """
    spark = prepared(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokenizer = load(tokenizer_path)
    pieces = frequent_pieces(rows.select("text"), hot)
    lengths = [len(e.ids) for e in tokenizer.encode_batch([" " + p for p in pieces], add_special_tokens=False)] if pieces else []
    first_tier = spark.sparkContext.broadcast(tuple(zip(pieces, lengths, strict=True)))
    specials = special_tokens(tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, parts = of_worker(tokenizer_path, first_tier.value), splitter(specials)

        def tokens(text: str) -> int:
            return sum(1 if special else pieces.of(part) for part, special in parts(text))

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [tokens(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
