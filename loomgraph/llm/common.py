"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch.  Texts may be long, so a batch is kept well below Spark's 10,000 rows.
ARROW_ROWS = 512
ARROW_BYTES = 32 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches and a checkpoint folder.

    The folder is the cluster's own ``spark.checkpoint.dir``.  Where none is set, a local session gets one of its own;
    on a cluster that is an error, since executors don't share a folder that the driver would choose.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone, so any store that Spark reaches will do."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared checkpoint folder and read from there: a short lineage that survives lost executors."""
    prepared(frame.sparkSession)
    return frame.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the files of shuffles and checkpoints that nothing refers to any more.

    It learns of them when the driver's JVM collects, which that does by its own memory, not by what lies on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
