"""Tables written by key: a batch rewrites the buckets that it touches, and a commit makes them the table's next version.

Rows lie in ``data/<write>/bucket=<b>``, by a hash of their key; each write has a folder of its own.  A commit is one
small row in ``commits/<version>``: which writes hold each bucket, and the last batch of each writer.  What was written without a commit is never read, so
a write that fails leaves the version before it; a batch that its writer has committed is not written again; a version
is written once, so of two that write at a time one fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.transcripts import written

COMMIT = "version long, buckets map<string,array<string>>, writers map<string,long>"


class KeyedTable:
    """A table at ``path`` with rows of ``schema`` and one row for each ``key``, in ``buckets`` parts.

    The number of buckets is fixed with the first write; a bucket should stay within what a task writes at a time.  With
    ``by`` rows lie by a hash of this column, which must follow from the key, so that all rows of one of its values are
    in one bucket and ``of`` reads that alone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, by: str | None = None) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets, self.by = spark, path.rstrip("/"), schema, key, buckets, by or key

    def last(self) -> dict:
        """The last commit: ``version``, ``buckets``, ``writers``; version 0 holds nothing."""
        try:
            row = self.spark.read.schema(COMMIT).json(f"{self.path}/commits/*").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return {"version": row.version, "buckets": {int(b): list(v) for b, v in row.buckets.items()}, "writers": dict(row.writers)} if row else {"version": 0, "buckets": {}, "writers": {}}

    def read(self, of: dict | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a commit (the last one), or of some of its buckets."""
        held = (of or self.last())["buckets"]
        paths = [f"{self.path}/data/{w}/bucket={b}" for b, writes in sorted(held.items()) if only is None or b in only for w in writes]
        frame = self.spark.read.schema(self.schema)
        return frame.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by).cast("string")), F.lit(self.buckets)).cast("int").alias("bucket")

    def of(self, rows: DataFrame) -> DataFrame:
        """The table's rows whose ``by`` is among those of ``rows``, from their buckets alone."""
        wanted = written(rows.select(self.by).where(F.col(self.by).isNotNull()).distinct())
        return self.read(only=self._touched(wanted)).join(wanted, self.by, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of ``rows``: at most as many numbers as the table has buckets."""
        return sorted(r.bucket for r in rows.select(self.bucket()).distinct().collect())

    def _seen(self, before: dict, writer: str | None, batch_id: int | None) -> bool:
        return writer is not None and batch_id is not None and before["writers"].get(writer, -1) >= batch_id

    def _commit(self, before: dict, rows: DataFrame, filled: list[int], emptied: list[int], adds: bool, writer: str | None, batch_id: int | None) -> int:
        version = before["version"] + 1
        write = f"{version:012d}-{uuid.uuid4().hex}"
        if filled:
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        held = {b: v for b, v in before["buckets"].items() if b not in emptied}
        held |= {b: [*(before["buckets"].get(b, []) if adds else []), write] for b in filled}
        writers = before["writers"] | ({writer: batch_id} if writer is not None and batch_id is not None else {})
        self.spark.createDataFrame([(version, {str(b): v for b, v in held.items()}, writers)], COMMIT).coalesce(1).write.mode("error").json(f"{self.path}/commits/{version:012d}")
        return version

    def upsert(self, batch: DataFrame, order: str, writer: str | None = None, batch_id: int | None = None) -> int:
        """Rows of ``batch`` in place of those of their keys, of several the last by ``order``; the version that is then the last.

        Rows without a key are left out.  Only buckets that hold keys of the batch are read and written.
        """
        before = self.last()
        if self._seen(before, writer, batch_id):
            return before["version"]
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        newest = F.max_by(F.struct(*names), order).alias("r")
        one = written(batch.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("of")).agg(newest).select("r.*"))
        touched = self._touched(one)
        kept = self.read(before, touched).join(one.select(self.key), self.key, "left_anti").select(*names)
        return self._commit(before, kept.unionByName(one), touched, [], False, writer, batch_id)

    def insert(self, batch: DataFrame, writer: str | None = None, batch_id: int | None = None) -> int:
        """Rows of ``batch`` whose key isn't there yet, as files beside those of their buckets; what is there stays as it is."""
        before = self.last()
        if self._seen(before, writer, batch_id):
            return before["version"]
        one = written(batch.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]))
        touched = self._touched(one)
        new = written(one.join(self.read(before, touched).select(self.key), self.key, "left_anti").select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema]))
        filled = self._touched(new)
        return self._commit(before, new, filled, [], True, writer, batch_id) if filled or writer else before["version"]

    def delete(self, gone: Column) -> tuple[int, int]:
        """Takes out rows for which ``gone`` holds; how many were scanned and how many went.  Buckets without such rows aren't written."""
        before = self.last()
        rows = self.read(before).withColumn("gone", F.coalesce(gone, F.lit(False)))
        scanned, n = rows.agg(F.count("*"), F.count_if("gone")).first()
        if n:
            touched = self._touched(rows.where("gone"))
            kept = self.read(before, touched).where(~F.coalesce(gone, F.lit(False)))
            self._commit(before, kept, self._touched(kept), touched, False, None, None)
        return scanned, n

    def vacuum(self) -> list[str]:
        """Removes writes that the last commit doesn't read, and commits before it; the writes that are gone.

        For times without other readers or writers.
        """
        last = self.last()
        used = {w for writes in last["buckets"].values() for w in writes}
        context = self.spark.sparkContext
        at = lambda name: context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = at("data").getFileSystem(context._jsc.hadoopConfiguration())
        there = lambda name: [s.getPath().getName() for s in files.listStatus(at(name))] if files.exists(at(name)) else []
        gone = sorted(w for w in there("data") if w not in used)
        for w in gone:
            files.delete(at(f"data/{w}"), True)
        for v in there("commits"):
            if int(v) < last["version"]:
                files.delete(at(f"commits/{v}"), True)
        return gone
