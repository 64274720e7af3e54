"""What is kept: writes by key to tables, provenance and governance of rows, snapshots, and what explanations look up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.operators import scans as S
from loomgraph.sources.keyed import KeyedTable
from loomgraph.sources.transcripts import written

#: Stages of records by source, prompt defaults of node types (priority, budget class), forms by type.
STAGE_OF = {"tool_output": "tool_output_raw", "document": "document_raw", "rule": "document_raw", "workflow": "document_extract", "skill": "document_extract", "conversation": "hook_message_snapshot", "system": "hook_message_snapshot"}
PRIORITY = {"Goal": "must", "Intent": "must", "Rule": "high", "Constraint": "high", "Mode": "high", "Risk": "high", "Process": "high", "Step": "high", "Decision": "normal", "State": "normal", "Outcome": "normal", "Tool": "normal"}
BUDGET_CLASS = {"Goal": "fixed", "Intent": "fixed", "Process": "fixed", "Step": "fixed", "Rule": "reserved", "Constraint": "reserved", "Mode": "reserved", "Risk": "reserved"}
RECENT_MS = 5000


def folder_of(frame: DataFrame, name: str) -> str:
    """A new folder in the shared checkpoint folder of ``frame``'s session."""
    written(frame.limit(0))
    return f"{frame.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def table_of(frame: DataFrame, name: str, key: str) -> KeyedTable:
    """A new keyed table for rows like those of ``frame``."""
    return KeyedTable(frame.sparkSession, folder_of(frame, name), ", ".join(f"`{n}` {t}" for n, t in frame.dtypes), key)


def saved(existing: DataFrame, batch: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``existing`` as a keyed table, overwritten by ``batch`` by key in the buckets that the batch touches, and read back."""
    table = table_of(existing, name, key)
    table.insert(existing)
    table.upsert(batch, order)
    return table.read()


def appended(existing: DataFrame, batch: DataFrame, key: str, name: str) -> DataFrame:
    """``existing`` as a keyed table, and rows of ``batch`` whose key isn't there yet beside it, read back."""
    table = table_of(existing, name, key)
    table.insert(existing)
    table.insert(batch)
    return table.read()


def snapshots_written(snapshots: DataFrame, newer: DataFrame) -> DataFrame:
    """The last snapshot of each session in a keyed table by session; ``newer`` replaces those of its sessions alone; read back.

    A bucket holds many sessions, so neither files nor what a commit moves grow with their number.
    """
    at = F.coalesce("captured_at", F.lit("")).alias("at")
    return saved(snapshots, newer.select("*", at), "session_id", "at", "snapshots")


def artifacts_written(rows: DataFrame, content: str, path: str | None = None) -> DataFrame:
    """Content-addressed artifacts in the keyed table at ``path`` (a new one); what is there already stays as it is; read back."""
    a = S.artifacts(rows, content).select("content_hash", "path", "content")
    table = KeyedTable(rows.sparkSession, path or folder_of(rows, "artifacts"), "content_hash string, path string, content string", "content_hash")
    table.insert(a)
    return table.read().select("content_hash", "path", F.sha2("content", 256).alias("read_hash"))


def pruned(artifacts: DataFrame, now: int, max_age: int, key: str) -> tuple[DataFrame, DataFrame]:
    """``artifacts`` as a keyed table without those of ``max_age`` or more, and how many were scanned and deleted; only buckets with old ones are written again."""
    table = table_of(artifacts, "kept", key)
    table.insert(artifacts)
    scanned, deleted = table.delete(F.col("modified") <= now - max_age)
    return table.read(), artifacts.sparkSession.createDataFrame([(scanned, deleted)], "scanned long, deleted long")


def evolved(old: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows of an older and a newer schema together; columns that the older one lacks have defaults."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({k: F.coalesce(k, v) for k, v in defaults.items()})


def latest_snapshots(lines: DataFrame, live: DataFrame) -> DataFrame:
    """The newest snapshot of each session among lines of JSON (broken ones go) and live ones, which win at equal times or later."""
    body = F.from_json("json", "sessionId string, capturedAt string, messages int")
    kept = lines.select(body.alias("s")).where("s.sessionId is not null and s.capturedAt is not null").select(F.col("s.sessionId").alias("session_id"), F.col("s.capturedAt").alias("captured_at"), F.col("s.messages").alias("messages"), F.lit(0).alias("live"))
    every = kept.unionByName(live.select("session_id", "captured_at", "messages", F.lit(1).alias("live")))
    top = every.groupBy("session_id").agg(F.max(F.struct("captured_at", "live", "messages")).alias("m"))
    return top.select("session_id", "m.captured_at", F.when(F.col("m.live") == 1, "live").otherwise("persisted").alias("source"), "m.messages")


def session_files(paths: DataFrame) -> DataFrame:
    """``agent, session, path`` of the newest transcript of each session among ``paths`` (``path, modified``) below agents' folders."""
    at = lambda k: F.regexp_extract("path", r"agents/([^/]+)/sessions/([^/]+)\.jsonl$", k)
    own = paths.withColumns({"agent": at(1), "session": at(2)}).where("agent <> ''")
    return own.groupBy("agent", "session").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def origin_and_stage(transcript_type: Column, compressed: Column, source_type: Column) -> Column:
    """Origin and stage of a record that doesn't state them."""
    origin = F.when((transcript_type == "compaction") | compressed, "compressed").otherwise("raw")
    stage = F.when(compressed, "tool_result_persist").otherwise(F.coalesce(X.lookup(source_type, STAGE_OF, "string"), F.lit("legacy_unknown")))
    return F.struct(origin.alias("origin_kind"), stage.alias("source_stage"))


def backfilled(nodes: DataFrame) -> DataFrame:
    """Provenance of nodes that have none, from ``transcript_type, custom_type, source_type, from_hook``; others keep theirs."""
    t = F.col("transcript_type")
    packed = F.lower(F.coalesce("custom_type", F.lit(""))).rlike("summary|compact|compression|checkpoint")
    origin = F.when((t == "compaction") | ((t == "custom_message") & packed), "compressed").otherwise("raw")
    stage = F.when(t == "compaction", "transcript_compaction").when(t == "message", "transcript_message").when(t == "custom_message", "transcript_custom").otherwise(F.coalesce(X.lookup(F.col("source_type"), STAGE_OF, "string"), F.lit("legacy_unknown")))
    by = F.when((t == "compaction") & F.col("from_hook"), "compact").otherwise("legacy-migration")
    lacks = F.col("origin_kind").isNull()
    return nodes.select("id", F.when(lacks, origin).otherwise(F.col("origin_kind")).alias("origin_kind"), F.when(lacks, stage).otherwise(F.col("source_stage")).alias("source_stage"), F.when(lacks, by).alias("filled_by"), F.when(lacks & (t == "compaction"), F.col("id")).alias("run_id"))


def governance(nodes: DataFrame) -> DataFrame:
    """Prompt governance of nodes: what is stored (``said_form``, ``said_priority``), else the defaults of type and state."""
    kind, state = F.col("type"), F.coalesce("origin_kind", F.lit("raw"))
    form = (
        F.when(kind.isin("Evidence", "Document", "Repo", "Module", "File", "API", "Command"), "citation_only").when(kind.isin(*X.TRACE_TYPES, *X.PROMOTED_TYPES), "derived").when(kind.isin("Tool", "Topic", "Concept"), "summary")
        .when(state == "compressed", "summary").when(state == "derived", F.when(kind == "Skill", "derived").otherwise("summary")).otherwise("raw")
    )
    default = lambda values, other: F.coalesce(X.lookup(kind, values, "string"), F.lit(other))
    return nodes.select("id", F.coalesce("said_form", form).alias("form"), F.coalesce("said_priority", default(PRIORITY, "low")).alias("priority"), default(BUDGET_CLASS, "candidate").alias("budget_class"), state.alias("state"))


def references(nodes: DataFrame, names: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Edges that nodes' references (``id, relation, refs``) mean: a reference is a node's id, or the raw source id of the first node that has it."""
    ids = names.select(F.col("id").alias("ref"), F.col("id").alias("to_id"), "type", F.lit(0).alias("late"))
    first = names.where("raw_source_id is not null").groupBy(F.col("raw_source_id").alias("ref")).agg(F.min(F.struct("updated_at", "id", "type")).alias("m")).select("ref", F.col("m.id").alias("to_id"), F.col("m.type").alias("type"), F.lit(1).alias("late"))
    each = nodes.select("id", "relation", F.explode("refs").alias("ref"))
    hit = each.join(ids.unionByName(first), "ref").groupBy("id", "relation", "ref").agg(F.min(F.struct("late", "to_id", "type")).alias("m"))
    fits = F.lit(False)
    for relation, types in kinds.items():
        fits = fits | ((F.col("relation") == relation) & F.col("m.type").isin(*types))
    return hit.where(fits & (F.col("m.to_id") != F.col("id"))).select("id", "relation", F.col("m.to_id").alias("to_id")).distinct()


def corrections_of(targets: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that touch a node by any of its ``targets`` (``id, target_id``), each once."""
    return targets.distinct().join(corrections.select("target_id", F.col("id").alias("correction_id")), "target_id").select("id", "correction_id").distinct()


def evidence_source(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first of the nodes that each derives from (``id, type, derived_from``) that is evidence, else the node itself."""
    each = nodes.select("id", F.posexplode("derived_from").alias("pos", "from_id"))
    found = each.join(evidence.select(F.col("id").alias("from_id")), "from_id").groupBy("id").agg(F.min_by("from_id", "pos").alias("first"))
    return nodes.join(found, "id", "left").select("id", F.when(F.col("type") == "Evidence", F.col("id")).otherwise(F.coalesce("first", "id")).alias("source_id"))


def persisted_in(nodes: DataFrame, kept: DataFrame, recent: int = 12, most: int = 3) -> DataFrame:
    """Where each node (``id, session_id``) is kept: the first ``most`` of the newest ``recent`` of each kind (``session_id, kind, kept_id, created_at, ids``)."""
    w = Window.partitionBy("session_id", "kind").orderBy(F.desc("created_at"), "kept_id")
    held = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent).select("session_id", "kind", "kept_id", "r", F.explode(F.array_distinct("ids")).alias("id"))
    v = Window.partitionBy("id", "kind").orderBy("r")
    return nodes.join(held, ["session_id", "id"]).withColumn("place", F.row_number().over(v)).where(F.col("place") <= most).select("id", "kind", "kept_id", "place")


def retention_reason(held: DataFrame, selected: Column) -> DataFrame:
    """Why a node (``id, checkpoint, delta, skill``) is kept, in words."""
    where = F.array_join(F.array_compact(F.array(F.when(F.col("checkpoint"), "checkpoint history"), F.when(F.col("delta"), "delta history"), F.when(F.col("skill"), "skill candidate history"))), " / ")
    text = F.when(selected.isNull(), F.concat(F.lit("node is retained in "), where)).when(selected, F.concat(F.lit("node is selected into the current runtime bundle and also retained in "), where)).otherwise(F.concat(F.lit("node is retained in "), where, F.lit(" but was not selected into the current runtime bundle")))
    return held.where(where != "").select("id", text.alias("reason"))


def merged_specs(specs: DataFrame) -> DataFrame:
    """Specs of one batch by key: the last label counts, payloads are laid over each other in order, explicit if any is."""
    rows = specs.groupBy("key").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("seq"))).alias("label"), F.max("explicit").alias("explicit"))
    each = specs.select("key", "seq", F.explode("payload").alias("name", "value")).groupBy("key", "name").agg(F.max_by("value", "seq").alias("value"))
    payload = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("payload"))
    return rows.join(payload, "key", "left").select("key", "label", "payload", "explicit")


def merged_skills(skills: DataFrame) -> DataFrame:
    """Skill candidates of one merge key together: mean scores with bonuses, the best clarity, unions of their arrays."""
    n = F.count("*")
    unit = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids"))))
    return skills.groupBy("merge_key").agg(n.alias("merged"), unit(F.avg("frequency") + (n - 1) * 0.1).alias("frequency"), unit(F.avg("stability") + F.when(n > 1, 0.05).otherwise(0.0)).alias("stability"), unit(F.avg("success")).alias("success"), unit(F.max("clarity")).alias("clarity"), ids.alias("evidence_ids"))


def retired(skills: DataFrame, merged: DataFrame) -> DataFrame:
    """The candidates that a merged one replaces: out of use, their success times 0.8."""
    both = skills.join(merged.where("merged > 1").select("merge_key"), "merge_key", "left_semi")
    return both.select("id", F.concat(F.lit("merged:"), "merge_key").alias("replaced_by"), F.lit("retire_candidate").alias("status"), F.round(F.col("success") * 0.8, 6).alias("success"))


def merged_diagnostics(passes: DataFrame) -> DataFrame:
    """Diagnostics of a request's relation passes that met something: sums, largest values, any, kinds, first samples."""
    met = passes.where("eligible > 0 or related > 0")
    samples = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pass", "sample"))), lambda s: s["sample"]), 1, 4)
    return met.groupBy("request_id").agg(F.sum("scanned").alias("scanned"), F.sum("eligible").alias("eligible"), F.sum("related").alias("related"), F.max("hops").alias("hops"), F.max("exhausted").alias("exhausted"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.array_join(samples, ",").alias("samples"))


def chunks(ids: DataFrame, size: int) -> DataFrame:
    """Ids of each list once, in the order of their first places, in chunks of ``size``."""
    once = ids.select("list_id", F.posexplode(F.array_distinct("ids")).alias("pos", "id"))
    return once.select("list_id", F.floor(F.col("pos") / size).alias("chunk"), "pos", "id")


def recent_own(events: DataFrame) -> DataFrame:
    """Whether the last compaction of a session was its own within RECENT_MS before each event (``session_id, at, own``)."""
    w = Window.partitionBy("session_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("own"), F.col("at")), ignorenulls=True).over(w)
    return events.select("id", F.coalesce(F.col("at") - last <= RECENT_MS, F.lit(False)).alias("recent"))


def to_persist(bundles: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Whether each bundle (``session_id, ids, goal, forced``) differs from the session's last checkpoint, or must be kept anyway."""
    last = checkpoints.groupBy("session_id").agg(F.max_by(F.struct(F.col("ids").alias("ids"), F.col("goal").alias("goal")), "created_at").alias("c"))
    same = F.array_sort(F.array_distinct("ids")).eqNullSafe(F.array_sort(F.array_distinct("c.ids"))) & F.col("goal").eqNullSafe(F.col("c.goal"))
    return bundles.join(last, "session_id", "left").select("session_id", (F.col("forced") | ~same).alias("persist"))
