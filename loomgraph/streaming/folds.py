"""Folds of each key's rows in order: a batch passes rows one Arrow batch at a time, a stream keeps the state between its batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, end: Callable, out: str) -> DataFrame:
    """What ``step(state, row)`` and ``end(key, state)`` give (tuples of ``out``), a key's rows coming in ``order``.

    A row is a tuple of the columns after ``key``; ``step`` changes the state and gives a list.  A key may have any
    number of rows: only its state is held.  A null key is a key; of an empty table nothing comes.
    """
    schema = StructType.fromDDL(out)
    arrow = to_arrow_schema(schema)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or name != now:
                    if state is not None:
                        done += end(now, state)
                    now, state = name, start()
                done += step(state, row)
            yield packed(done)
        if state is not None:
            yield packed(end(now, state))

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, *(c for c in rows.columns if c != key)).mapInArrow(run, schema)


def keyed(spark: SparkSession) -> None:
    """Streams with lists, maps and timers in their state need a store that has them; another choice of the session stays."""
    if spark.conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
