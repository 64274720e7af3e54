"""The driver's tables seen as a context graph: records, nodes, edges, requests, corrections.

Turns of conversations are records, and each record is a node whose attributes follow from its keys; edges lead from a turn to
the next two; test items are requests; events are correction records on the nodes.  All are narrow projections, so
column pruning reaches the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.fixed import RELATIONS

TYPES = ("Goal", "Intent", "Rule", "Constraint", "Mode", "Process", "Step", "State", "Decision", "Risk", "Outcome", "Tool", "Skill", "Topic", "Evidence", "Pattern")
TARGET_KINDS = {"view": "label_override", "click": "node_suppression", "error": "noise_policy", "purchase": "promotion_decision", "signup": "concept_alias"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(seconds: Column) -> Column:
    """ISO text of a number of seconds since the start of 2024, in no time zone but UTC."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(seconds, F.lit(86400))
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit(".000Z"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    source = F.when(F.col("role") == "user", "conversation").when(F.col("role") == "assistant", "transcript").when(F.col("role") == "system", "system").otherwise("tool_output")
    return c.select(
        F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(F.lit("w"), F.floor(F.col("conv_id") / 16)).alias("workspace_id"),
        "conv_id", "turn", "role", source.alias("source_type"), F.col("text").alias("content"), iso(F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, conv, turn = records(spark, sf_dir), F.col("conv_id"), F.col("turn")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    flat = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    observations, downgrades = (conv * 3 + turn) % 6, (conv + turn * 2) % 3
    payload = F.concat(F.lit('{"sessionId":"'), "session_id", F.lit('","workspaceId":"'), "workspace_id", F.lit('","role":"'), "role", F.lit('","observationCount":'), observations, F.lit(',"downgradeCount":'), downgrades, F.lit("}"))
    return r.select(
        F.concat(F.lit("n"), conv, F.lit("."), turn).alias("id"), "conv_id", "turn", "session_id", "workspace_id", pick(conv * 31 + turn * 17, *TYPES).alias("type"),
        pick(conv + turn, "workspace", "session", "global", "session").alias("scope"), F.substring(flat, 1, 96).alias("label"), payload.alias("payload"),
        pick(turn, "hard", "soft", "heuristic").alias("strength"), F.round(F.lit(0.5) + (conv * 13 + turn * 7) % 50 / 100, 2).alias("confidence"),
        pick(conv + turn, "superseded", "active", "active", "stale", "active", "active").alias("freshness"), pick(turn, "compressed", "raw", "raw", "derived", "raw").alias("origin_kind"),
        observations.alias("observations"), downgrades.alias("downgrades"), pick(conv + turn, "candidate", "candidate", "promoted", "downgraded", "retired").alias("promotion_state"),
        F.concat(F.lit("k"), turn % 2).alias("conflict_key"), (turn * 10 + conv % 3).alias("override_priority"), iso(conv * 1000 + turn).alias("updated_at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    far = c.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"))
    kinds = list(RELATIONS)
    hops = c.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("hop"))
    joined = hops.join(far, (hops.conv_id == far.to_conv) & (hops.turn + hops.hop == far.to_turn))
    conv, turn, hop = F.col("conv_id"), F.col("turn"), F.col("hop")
    kind = F.element_at(F.array(*map(F.lit, kinds)), ((conv * 7 + turn * 3 + hop) % len(kinds) + 1).cast("int"))
    return joined.select(
        F.concat(F.lit("e"), conv, F.lit("."), turn, F.lit("."), hop).alias("id"), F.concat(F.lit("n"), conv, F.lit("."), turn).alias("from_id"), F.concat(F.lit("n"), conv, F.lit("."), "to_turn").alias("to_id"),
        kind.alias("type"), F.concat(F.lit("s"), conv).alias("session_id"), F.round(F.lit(0.4) + (conv * 3 + turn * 11 + hop) % 60 / 100, 2).alias("confidence"), iso(conv * 1000 + turn * 10 + hop).alias("updated_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = read(spark, sf_dir, "benchmark"), F.col("item_id") % 40
    return b.select(F.col("item_id").alias("request_id"), F.concat(F.lit("s"), k).alias("session_id"), F.concat(F.lit("w"), F.floor(k / 16)).alias("workspace_id"), F.col("text").alias("query"), (F.lit(400) + F.col("item_id") % 30 * 20).alias("token_budget"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for p in TARGET_KINDS.items() for x in p))[F.col("event_type")]
    return e.select(
        F.concat(F.lit("m"), "event_id").alias("id"), "event_id", kind.alias("target_kind"), F.concat(F.lit("n"), "user_id", F.lit("."), F.col("event_id") % 3).alias("target_id"),
        F.when(F.col("event_id") % 4 == 3, "rollback").otherwise("apply").alias("action"), F.concat(F.lit("label "), F.col("event_id") % 50).alias("new_label"),
        F.element_at(F.array(F.lit("drop"), F.lit("evidence_only"), F.lit("hint_only"), F.lit("materialize")), (F.col("event_id") % 4 + 1).cast("int")).alias("disposition"), iso(F.col("event_id") * 60).alias("created_at"),
    )
