"""Results kept by the content that they come from: what has been processed under the same contract isn't processed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.keyed import KeyedTable
from loomgraph.sources.transcripts import written


def memo(spark: SparkSession, path: str, kept: str, buckets: int = 64) -> KeyedTable:
    """The memo table at ``path``; ``kept`` are the columns of a result row."""
    return KeyedTable(spark, path, f"memo_key string, kept array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in kept.split(','))}>>", "memo_key", buckets)


def remembered(records: DataFrame, table: KeyedTable, run: Callable[[DataFrame], DataFrame], contract: str) -> DataFrame:
    """``id, met, kept``: what ``run`` gives for each of ``records``, and whether ``table`` had it before.

    ``run`` takes rows like ``records`` (``id`` and what the result depends on) and returns rows with their ``id``.  It
    gets one record of each content that the table lacks under this ``contract``, and what it gives is added; equal
    contents and repeated calls cost nothing more.  A record without result rows is kept as an empty array.
    """
    inputs = [c for c in records.columns if c != "id"]
    keyed = written(records.withColumn("memo_key", F.sha2(F.concat_ws("|", F.lit(contract), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})), 256)))
    before = table.read()
    new = written(keyed.join(before.select("memo_key"), "memo_key", "left_anti").dropDuplicates(["memo_key"]).select(F.col("memo_key").alias("id"), *inputs))
    element = table.spark.createDataFrame([], table.schema).schema["kept"].dataType.elementType
    rows = run(new).groupBy("id").agg(F.collect_list(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in element))).alias("kept"))
    none = F.array().cast(table.spark.createDataFrame([], table.schema).schema["kept"].dataType)
    table.insert(new.select("id").join(rows, "id", "left").select(F.col("id").alias("memo_key"), F.coalesce("kept", none).alias("kept")))
    fresh = new.select(F.col("id").alias("memo_key"), F.lit(False).alias("met"))
    return keyed.join(table.read(), "memo_key").join(fresh, "memo_key", "left").select("id", F.coalesce("met", F.lit(True)).alias("met"), "kept")
