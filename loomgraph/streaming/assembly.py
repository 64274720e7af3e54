"""After each turn: records are taken in, their nodes and their sessions' windows kept, and bundles assembled from what is kept.

A micro-batch of turns is written to keyed tables under its number, so a batch that comes again, after a restart between
two of its writes too, changes nothing that it has written.  A session's window follows from all its records, which lie
in one bucket; so the tables are the same however turns are dealt to batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import text as T
from loomgraph.sources.keyed import KeyedTable

RECORD = "id string, session_id string, workspace_id string, turn long, role string, content string, created_at string"
NODE = "id string, session_id string, record_id string, type string, label string, tokens long, updated_at string"
WINDOW = "session_id string, messages long, blocks long, tail long, tokens long, tail_tokens long, baseline string, baseline_lines long, compacted boolean, updated_at string"
#: Turns of the raw tail, lines of a baseline, and characters of a line.
TAIL, LINES, LINE = 2, 8, 120
#: Node types of records by role.
TYPE_OF = {"user": "Intent", "assistant": "Decision", "system": "Rule"}
WRITER = "turns"


def windows(records: DataFrame) -> DataFrame:
    """The window (WINDOW) of each session of ``records``: counts, the raw tail, and a baseline of the messages before it.

    A block begins with each message of a user; the tail is the last TAIL blocks, and what is before it is compacted to
    the last LINES lines.  A message without a user before it belongs to the first block.
    """
    so_far = Window.partitionBy("session_id").orderBy("turn", "id")
    whole = Window.partitionBy("session_id")
    rows = records.withColumn("block", F.greatest(F.count_if(F.col("role") == "user").over(so_far), F.lit(1))).withColumn("blocks", F.max("block").over(whole))
    rows = rows.withColumns({"late": F.col("block") > F.col("blocks") - TAIL, "cost": T.estimated_tokens(F.coalesce("content", F.lit(""))).cast("long")})
    # numbered from the last message before the tail, so that no more than LINES are held
    back = Window.partitionBy("session_id", "late").orderBy(F.desc("turn"), F.desc("id"))
    rows = rows.withColumn("back", F.row_number().over(back))
    line = F.when(~F.col("late") & (F.col("back") <= LINES), F.struct((-F.col("back")).alias("at"), F.concat("role", F.lit(": "), T.preview(F.coalesce("content", F.lit("")), LINE)).alias("said")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["said"])
    return rows.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.max("blocks").alias("blocks"), F.count_if("late").alias("tail"), F.sum("cost").alias("tokens"), F.coalesce(F.sum(F.when(F.col("late"), F.col("cost"))), F.lit(0)).alias("tail_tokens"),
        F.array_join(lines, "\n").alias("baseline"), F.size(lines).cast("long").alias("baseline_lines"), F.count_if(~F.col("late")).alias("before"), F.max("created_at").alias("updated_at"),
    ).withColumn("compacted", F.col("before") > 0).drop("before")


def nodes(records: DataFrame) -> DataFrame:
    """The node (NODE) of each record that says anything."""
    kind = F.coalesce(F.create_map(*(F.lit(x) for p in TYPE_OF.items() for x in p))[F.col("role")], F.lit("State"))
    node_id = F.sha2(F.concat_ws("|", F.lit("semantic"), "session_id", kind, "id"), 256)
    rows = records.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    return rows.select(node_id.alias("id"), "session_id", F.col("id").alias("record_id"), kind.alias("type"), T.preview(F.col("content")).alias("label"), T.estimated_tokens(F.col("content")).cast("long").alias("tokens"), F.col("created_at").alias("updated_at"))


class Assembly:
    """The tables of a stream of turns below ``path``, and what reads and writes them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.records = KeyedTable(spark, f"{path}/records", RECORD, "id", buckets, "session_id")
        self.nodes = KeyedTable(spark, f"{path}/nodes", NODE, "id", buckets, "session_id")
        self.windows = KeyedTable(spark, f"{path}/windows", WINDOW, "session_id", buckets)

    def after_turns(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in a batch of turns (RECORD).  Of a repeated record the later one counts; an empty batch changes nothing."""
        self.records.upsert(batch.withColumn("at", F.struct("created_at", "turn")), "at", WRITER, batch_id)
        touched = self.records.of(batch)
        self.nodes.upsert(nodes(touched).withColumn("at", F.col("updated_at")), "at", WRITER, batch_id)
        self.windows.upsert(windows(touched).withColumn("at", F.col("updated_at")), "at", WRITER, batch_id)

    def stream(self, turns: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """A stream of turns that ends in ``after_turns``."""
        return turns.writeStream.foreachBatch(lambda batch, k: self.after_turns(batch, k)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def assembled(self, requests: DataFrame) -> DataFrame:
        """For each request (``request_id, session_id, token_budget``) its session's nodes within the budget, newest first, and its baseline.

        A node goes in as long as all newer ones of its session and it fit into what the baseline leaves.
        """
        w = self.windows.read().select("session_id", "baseline", T.estimated_tokens(F.col("baseline")).cast("long").alias("baseline_tokens"), "compacted")
        asked = requests.select("request_id", "session_id", "token_budget").join(w, "session_id")
        room = F.col("token_budget") - F.when(F.col("compacted"), F.col("baseline_tokens")).otherwise(0)
        newest = Window.partitionBy("request_id").orderBy(F.desc("updated_at"), "id")
        chosen = asked.join(self.nodes.read().withColumnRenamed("tokens", "cost"), "session_id").withColumn("used", F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= room)
        return chosen.select("request_id", "session_id", "id", "type", "cost", "used", "compacted")
