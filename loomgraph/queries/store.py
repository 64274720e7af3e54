"""Queries of writes by key, provenance, governance, snapshots, and what explanations look up."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import scans as SC
from loomgraph.operators import store as P
from loomgraph.queries.model_sql import CORRECTIONS, EDGES, NODES, RECORDS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C


def _pick(n, *values):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


@query("ref_op031_upsert_edges", with_(EDGES) + "SELECT id, CASE WHEN session_id IN ('s0', 's3', 's6') THEN 'batch 2' ELSE type END AS type, session_id FROM edges")
def upsert_edges(spark, d):
    e = C.edges(spark, d).select("id", "type", "session_id")
    batch = e.where(F.col("session_id").isin("s0", "s3", "s6")).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("type", F.concat(F.lit("batch "), "seq"))
    return P.saved(e, batch, "id", "seq", "edges")


@query("ref_op033_save_states", "SELECT 's' || conv_id AS session_id, max(turn) AS version, 'state ' || max(turn) AS body FROM conversations GROUP BY 1")
def save_states(spark, d):
    c = C.read(spark, d, "conversations").select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.col("turn").alias("version"), F.concat(F.lit("state "), "turn").alias("body"))
    return P.saved(SC.latest(c.where("version % 2 = 0"), "session_id", F.desc("version")), c.withColumn("seq", F.col("version")), "session_id", "seq", "states")


@query("ref_op015_compression_state", "SELECT 's' || conv_id AS session_id, 'state ' || max(turn) AS body FROM conversations WHERE conv_id IN (1, 2, 5) GROUP BY conv_id")
def compression_state(spark, d):
    return save_states(spark, d).where(F.col("session_id").isin("s1", "s2", "s5")).select("session_id", "body")


@query("ref_op034_save_skills", "SELECT user_id AS id, arg_max(value, event_id)::DOUBLE AS success, count(*) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1")
def save_skills(spark, d):
    e = C.read(spark, d, "events").where("event_type = 'purchase'")
    seen = e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("seen"))
    old = seen.select("id", F.lit(0.0).alias("success"), "seen")
    batch = e.select(F.col("user_id").alias("id"), F.col("value").alias("success"), F.col("event_id").alias("seq")).join(seen, "id")
    return P.saved(old, batch, "id", "seq", "skills")


@query("ref_op018_list_skills", "SELECT user_id AS id, max(event_id) AS created FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY created DESC LIMIT 20")
def list_skills(spark, d):
    return C.read(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("created")).orderBy(F.desc("created")).limit(20)


@query("ref_op035_save_corrections", with_(CORRECTIONS) + "SELECT target_kind, action, count(*) AS n FROM corrections GROUP BY 1, 2")
def save_corrections(spark, d):
    c = C.corrections(spark, d).select("id", "target_kind", "action")
    old = c.where(F.xxhash64("id") % 2 == 0)
    return P.appended(old, c.unionByName(c), "id", "corrections").groupBy("target_kind", "action").agg(F.count("*").alias("n"))


@query("ref_op036_artifact_sink", "SELECT DISTINCT sha256(props) AS content_hash, left(sha256(props), 2) || '/' || sha256(props) || '.json' AS path, sha256(props) AS read_hash FROM events")
def artifact_sink(spark, d):
    return P.artifacts_written(C.read(spark, d, "events").select("props"), "props")


@query("ref_op037_artifact_prune", "SELECT count(*) AS scanned, count(*) FILTER (WHERE event_id <= 4000) AS deleted, count(*) FILTER (WHERE event_id > 4000) AS kept FROM events")
def artifact_prune(spark, d):
    kept, counts = P.pruned(C.read(spark, d, "events").select("event_id", F.col("event_id").alias("modified"), "props"), 5000, 1000, "event_id")
    return counts.crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each


@query("ref_op038_snapshot_sink", """SELECT 's' || conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'b' ELSE 'a' END || lpad(max(turn)::VARCHAR, 4, '0')
    AS captured_at, max(turn) AS turns FROM conversations GROUP BY conv_id""")
def snapshot_sink(spark, d):
    c = C.read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    rows = lambda v, of: of.select(F.concat(F.lit(v), F.lpad(F.col("turns").cast("string"), 4, "0")).alias("captured_at"), F.col("turns").cast("string").alias("body"), F.concat(F.lit("s"), "conv_id").alias("session_id"))
    back = P.snapshots_written(rows("a", c), rows("b", c.where("conv_id % 3 = 0")))
    return back.select("session_id", "captured_at", F.col("body").cast("long").alias("turns"))


@query("ref_op024_schema_evolution", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'session' ELSE event_type END AS scope, CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'derived' END AS origin FROM events")
def schema_evolution(spark, d):
    e, odd = C.read(spark, d, "events"), F.col("event_id") % 2 == 1
    return P.evolved(e.where(~odd).select(F.col("event_id").alias("id")), e.where(odd).select(F.col("event_id").alias("id"), F.col("event_type").alias("scope"), F.lit("derived").alias("origin")), {"scope": F.lit("session"), "origin": F.lit("raw")})


@query(
    "ref_op020_latest_snapshots",
    """WITH k AS (SELECT 's' || conv_id AS session_id, lpad(turn::VARCHAR, 3, '0') AS captured_at, 0 AS live, length(coalesce(text,
    '')) AS messages FROM conversations WHERE turn % 5 < 4 UNION ALL SELECT 's' || conv_id, lpad((turn - turn % 2)::VARCHAR, 3, '0'), 1, 7 FROM
    conversations WHERE conv_id % 2 = 0 AND turn < 4) SELECT session_id, m.c AS captured_at, CASE m.l WHEN 1 THEN 'live' ELSE 'persisted' END
    AS source, m.n AS messages FROM (SELECT session_id, max({'c': captured_at, 'l': live, 'n': messages}) AS m FROM k GROUP BY 1)""",
)
def latest_snapshots(spark, d):
    c, at = C.read(spark, d, "conversations"), lambda n: F.lpad(n.cast("string"), 3, "0")
    body = F.concat(F.lit('{"sessionId":"s'), "conv_id", F.lit('","capturedAt":"'), at(F.col("turn")), F.lit('","messages":'), F.char_length(F.coalesce("text", F.lit(""))), F.when(F.col("turn") % 5 < 4, "}").otherwise(""))
    live = c.where("conv_id % 2 = 0 and turn < 4").select(F.concat(F.lit("s"), "conv_id").alias("session_id"), at(F.col("turn") - F.col("turn") % 2).alias("captured_at"), F.lit(7).alias("messages"))
    return P.latest_snapshots(c.select(body.alias("json")), live)


@query("ref_op022_session_files", """SELECT 'a' || (user_id % 5) AS agent, 's' || (user_id % 30) AS session, arg_max('home/agents/a' || (user_id % 5) || '/sessions/s'
    || (user_id % 30) || '.jsonl', event_id) AS path FROM events WHERE event_type <> 'view' GROUP BY 1, 2""")
def session_files(spark, d):
    e = C.read(spark, d, "events")
    path = F.concat(F.lit("home/agents/a"), F.col("user_id") % 5, F.lit("/sessions/s"), F.col("user_id") % 30, F.when(F.col("event_type") == "view", ".txt").otherwise(".jsonl"))
    return P.session_files(e.select(path.alias("path"), F.col("event_id").alias("modified")))


_STAGE = "CASE source_type WHEN 'tool_output' THEN 'tool_output_raw' WHEN 'conversation' THEN 'hook_message_snapshot' WHEN 'system' THEN 'hook_message_snapshot' ELSE 'legacy_unknown' END"


@query("ref_op068_origin_and_stage", with_(RECORDS) + f"""SELECT id, CASE WHEN turn % 4 = 1 OR conv_id % 5 = 0 THEN 'compressed' ELSE 'raw' END AS origin_kind, CASE WHEN conv_id %
    5 = 0 THEN 'tool_result_persist' ELSE {_STAGE} END AS source_stage FROM records""")
def origin_and_stage(spark, d):
    t = F.when(F.col("turn") % 4 == 1, "compaction")
    return C.records(spark, d).select("id", P.origin_and_stage(F.coalesce(t, F.lit("")), F.col("conv_id") % 5 == 0, F.col("source_type")).alias("p")).select("id", "p.*")


@query(
    "ref_op025_provenance_backfill",
    with_(RECORDS) + f"""SELECT id, CASE WHEN lacks THEN CASE WHEN t = 'compaction' OR (t = 'custom_message' AND conv_id % 3 = 0) THEN 'compressed'
    ELSE 'raw' END ELSE 'derived' END AS origin_kind, CASE WHEN lacks THEN CASE t WHEN 'compaction' THEN 'transcript_compaction' WHEN 'message'
    THEN 'transcript_message' WHEN 'custom_message' THEN 'transcript_custom' ELSE {_STAGE} END ELSE 'checkpoint' END AS source_stage, CASE WHEN
    lacks THEN CASE WHEN t = 'compaction' AND conv_id % 2 = 0 THEN 'compact' ELSE 'legacy-migration' END END AS filled_by, CASE WHEN lacks AND
    t = 'compaction' THEN id END AS run_id FROM (SELECT *, (conv_id + turn) % 4 < 3 AS lacks, CASE turn % 4 WHEN 0 THEN 'compaction' WHEN 1 THEN
    'message' WHEN 2 THEN 'custom_message' END AS t FROM records)""",
)
def provenance_backfill(spark, d):
    lacks, turn = (F.col("conv_id") + F.col("turn")) % 4 < 3, F.col("turn") % 4
    kind = F.when(turn == 0, "compaction").when(turn == 1, "message").when(turn == 2, "custom_message")
    rows = C.records(spark, d).withColumns({"transcript_type": kind, "custom_type": F.when(F.col("conv_id") % 3 == 0, "A Summary").otherwise("note"), "from_hook": F.col("conv_id") % 2 == 0, "origin_kind": F.when(~lacks, "derived"), "source_stage": F.when(~lacks, "checkpoint")})
    return P.backfilled(rows)


_FORM = """CASE WHEN type = 'Evidence' THEN 'citation_only' WHEN type = 'Pattern' THEN 'derived' WHEN type IN ('Tool', 'Topic') THEN
    'summary' WHEN origin_kind = 'compressed' THEN 'summary' WHEN origin_kind = 'derived' THEN CASE type WHEN 'Skill' THEN 'derived' ELSE 'summary'
    END ELSE 'raw' END"""
_PRIORITY = """CASE WHEN type IN ('Goal', 'Intent') THEN 'must' WHEN type IN ('Rule', 'Constraint', 'Mode', 'Risk', 'Process', 'Step') THEN
    'high' WHEN type IN ('Decision', 'State', 'Outcome', 'Tool') THEN 'normal' ELSE 'low' END"""
_CLASS = "CASE WHEN type IN ('Goal', 'Intent', 'Process', 'Step') THEN 'fixed' WHEN type IN ('Rule', 'Constraint', 'Mode', 'Risk') THEN 'reserved' ELSE 'candidate' END"


def _governed(spark, d):
    stored = F.col("turn") % 6 == 5
    return P.governance(C.nodes(spark, d).withColumns({"said_form": F.when(stored, "raw"), "said_priority": F.when(stored, "must")}))


@query("ref_op061_node_governance", with_(NODES) + f"SELECT id, CASE WHEN turn % 6 = 5 THEN 'raw' ELSE {_FORM} END AS form, CASE WHEN turn % 6 = 5 THEN 'must' ELSE {_PRIORITY} END AS priority, origin_kind AS state FROM nodes")
def node_governance(spark, d):
    return _governed(spark, d).select("id", "form", "priority", "state")


@query("ref_op062_prompt_defaults", with_(NODES) + f"SELECT DISTINCT type, {_PRIORITY} AS priority, {_CLASS} AS budget_class FROM nodes")
def prompt_defaults(spark, d):
    n = C.nodes(spark, d).withColumns({"said_form": F.lit(None).cast("string"), "said_priority": F.lit(None).cast("string")})
    return P.governance(n).join(n.select("id", "type"), "id").select("type", "priority", "budget_class").distinct()


@query("ref_op060_row_decode", with_(NODES) + "SELECT id, coalesce((payload->>'observationCount')::BIGINT, 1) AS observations, payload->>'sessionId' AS session_id, coalesce(payload->>'missing', 'none') AS missing FROM nodes")
def row_decode(spark, d):
    p = F.from_json("payload", "observationCount bigint, sessionId string, missing string")
    return C.nodes(spark, d).withColumn("p", p).select("id", F.coalesce("p.observationCount", F.lit(1)).alias("observations"), F.col("p.sessionId").alias("session_id"), F.coalesce("p.missing", F.lit("none")).alias("missing"))


@query(
    "ref_op085_relation_references",
    with_(NODES) + """, refs AS (SELECT id, 'requires' AS relation, unnest(['n' || conv_id || '.' || (turn + 1), 'raw' || conv_id || '.' || (turn % 3)]) AS ref FROM
    nodes UNION ALL SELECT id, 'next_step', unnest(['n' || conv_id || '.' || (turn + 1), 'nowhere']) FROM nodes),
  first AS (SELECT 'raw' || conv_id || '.' || (turn % 3) AS ref, min({'u': updated_at, 'i': id, 't': type}) AS m FROM nodes GROUP BY 1),
  hit AS (SELECT r.id, relation, coalesce(n.id, f.m.i) AS to_id, coalesce(n.type, f.m.t) AS type FROM refs r LEFT JOIN nodes n ON n.id = r.ref LEFT JOIN first f ON f.ref = r.ref)
  SELECT DISTINCT id, relation, to_id FROM hit WHERE to_id IS NOT NULL AND to_id <> id AND CASE relation WHEN 'requires' THEN type IN ('Rule',
    'Constraint', 'Mode', 'Tool', 'Skill') ELSE type IN ('Step', 'Process') END""",
)
def relation_references(spark, d):
    n, conv, turn = C.nodes(spark, d), F.col("conv_id"), F.col("turn")
    raw = F.concat(F.lit("raw"), conv, F.lit("."), turn % 3)
    after = F.concat(F.lit("n"), conv, F.lit("."), turn + 1)
    refs = n.select("id", F.lit("requires").alias("relation"), F.array(after, raw).alias("refs")).unionByName(n.select("id", F.lit("next_step").alias("relation"), F.array(after, F.lit("nowhere")).alias("refs")))
    return P.references(refs, n.select("id", "type", "updated_at", raw.alias("raw_source_id")), {"requires": ("Rule", "Constraint", "Mode", "Tool", "Skill"), "next_step": ("Step", "Process")})


@query("ref_op089_correction_lookup", with_(NODES, CORRECTIONS) + """SELECT DISTINCT t.id, c.id AS correction_id FROM (SELECT id, id AS target_id FROM nodes UNION SELECT id, 'n' || (conv_id
    + 1) || '.' || (turn % 3) FROM nodes) t JOIN corrections c USING (target_id)""")
def correction_lookup(spark, d):
    n = C.nodes(spark, d)
    alias = F.concat(F.lit("n"), F.col("conv_id") + 1, F.lit("."), F.col("turn") % 3)
    return P.corrections_of(n.select("id", F.col("id").alias("target_id")).unionByName(n.select("id", alias.alias("target_id"))), C.corrections(spark, d))


@query("ref_op090_promoted_lookup", with_(NODES) + """SELECT a.id, b.id AS existing, 'global:' || a.id AS global_id FROM nodes a LEFT JOIN nodes b ON b.conv_id = a.conv_id + 1
    AND b.turn = a.turn AND b.type = 'Pattern' WHERE a.type = 'Pattern' OR a.type = 'Skill'""")
def promoted_lookup(spark, d):
    n = C.nodes(spark, d)
    held = n.where("type = 'Pattern'").select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("id").alias("existing"))
    return n.where("type in ('Pattern', 'Skill')").join(held, ["conv_id", "turn"], "left").select("id", "existing", F.concat(F.lit("global:"), "id").alias("global_id"))


KEPT = """kept AS (SELECT session_id, k.kind, k.kind || turn AS kept_id, updated_at AS created_at, CASE k.kind WHEN 'checkpoint' THEN ['n' || conv_id ||
    '.' || turn, 'n' || conv_id || '.0'] WHEN 'delta' THEN ['n' || conv_id || '.' || (turn + 1)] ELSE ['n' || conv_id || '.0', 'n' || conv_id
    || '.1'] END AS ids FROM nodes, (VALUES ('checkpoint'), ('delta'), ('skill')) k(kind)),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY created_at DESC, kept_id) AS r FROM kept) WHERE r <= 12),
found AS (SELECT n.id, k.kind, k.kept_id, row_number() OVER (PARTITION BY n.id, k.kind ORDER BY k.r) AS place FROM nodes n JOIN recent k ON k.session_id
    = n.session_id AND list_contains(k.ids, n.id))"""


def kept(spark, d):
    n, conv, turn = C.nodes(spark, d), F.col("conv_id"), F.col("turn")
    node = lambda t: F.concat(F.lit("n"), conv, F.lit("."), t)
    rows = lambda kind, *ids: n.select("session_id", F.lit(kind).alias("kind"), F.concat(F.lit(kind), turn).alias("kept_id"), F.col("updated_at").alias("created_at"), F.array(*ids).alias("ids"))
    return rows("checkpoint", node(turn), node(F.lit(0))).unionByName(rows("delta", node(turn + 1))).unionByName(rows("skill", node(F.lit(0)), node(F.lit(1))))


@query("ref_op095_persistence_lookup", with_(NODES, KEPT) + "SELECT id, kind, kept_id, place FROM found WHERE place <= 3")
def persistence_lookup(spark, d):
    return P.persisted_in(C.nodes(spark, d).select("id", "session_id"), kept(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(
    "ref_op317_retention_reason",
    with_(NODES, KEPT) + """, h AS (SELECT id, bool_or(kind = 'checkpoint') AS c, bool_or(kind = 'delta') AS l, bool_or(kind = 'skill') AS s FROM found GROUP BY 1), w AS
    (SELECT id, array_to_string([x FOR x IN [CASE WHEN c THEN 'checkpoint history' END, CASE WHEN l THEN 'delta history' END, CASE WHEN s THEN
    'skill candidate history' END] IF x IS NOT NULL], ' / ') AS where_ FROM h)
  SELECT w.id, CASE n.freshness WHEN 'active' THEN 'node is selected into the current runtime bundle and also retained in ' || where_ WHEN 'stale'
    THEN 'node is retained in ' || where_ || ' but was not selected into the current runtime bundle' ELSE 'node is retained in ' || where_ END
    AS reason FROM w JOIN nodes n ON n.id = w.id""",
)
def retention_reason(spark, d):
    found = P.persisted_in(C.nodes(spark, d).select("id", "session_id"), kept(spark, d))
    is_ = lambda k: F.max(F.col("kind") == k).alias(k)
    held = found.groupBy("id").agg(is_("checkpoint"), is_("delta"), is_("skill")).join(C.nodes(spark, d).select("id", "freshness"), "id")
    selected = F.when(F.col("freshness") == "active", True).when(F.col("freshness") == "stale", False)
    return P.retention_reason(held, selected)


@query("ref_op097_evidence_source", with_(NODES) + """SELECT a.id, CASE WHEN a.type = 'Evidence' THEN a.id ELSE coalesce((SELECT arg_min(b.id, b.turn) FROM nodes b WHERE b.conv_id
    = a.conv_id AND b.turn IN (a.turn + 1, a.turn + 2) AND b.type = 'Evidence'), a.id) END AS source_id FROM nodes a""")
def evidence_source(spark, d):
    n, node = C.nodes(spark, d), lambda t: F.concat(F.lit("n"), "conv_id", F.lit("."), F.col("turn") + t)
    return P.evidence_source(n.select("id", "type", F.array(node(1), node(2)).alias("derived_from")), n.where("type = 'Evidence'"))


@query(
    "ref_op135_merged_specs",
    """SELECT 'k' || (user_id % 60) AS key, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 > 0) AS label, coalesce(arg_max(value,
    event_id) FILTER (WHERE event_id % 2 = 0), -1)::DOUBLE AS even, coalesce(arg_max(value, event_id) FILTER (WHERE event_id % 2 = 1), -1)::DOUBLE
    AS odd, bool_or(value > 300) AS explicit FROM events GROUP BY 1""",
)
def merged_specs(spark, d):
    n = F.col("event_id")
    specs = C.read(spark, d, "events").select(F.concat(F.lit("k"), F.col("user_id") % 60).alias("key"), n.alias("seq"), F.when(n % 3 > 0, F.col("event_type")).alias("label"), F.create_map(F.when(n % 2 == 0, "even").otherwise("odd"), F.col("value").cast("string")).alias("payload"), (F.col("value") > 300).alias("explicit"))
    value = lambda k: F.coalesce(F.try_element_at("payload", F.lit(k)).cast("double"), F.lit(-1.0)).alias(k)
    return P.merged_specs(specs).select("key", "label", value("even"), value("odd"), "explicit")


SKILLS = """skills AS (SELECT user_id AS id, 'k' || (user_id % 20) AS merge_key, round(count(*) % 10 / 10.0, 6)::DOUBLE AS frequency,
    round(count(*) % 3 / 3.0 + 0.3, 6)::DOUBLE AS stability, round(least(1.0, avg(value) / 25), 6)::DOUBLE AS success, round(count(*) % 4 / 4.0
    + 0.25, 6)::DOUBLE AS clarity, user_id % 7 AS e FROM events GROUP BY 1)"""


def skills(spark, d):
    n = F.count("*")
    s = C.read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(n % 10 / 10, 6).alias("frequency"), F.round(n % 3 / 3 + 0.3, 6).alias("stability"), F.round(F.least(F.lit(1.0), F.avg("value") / 25), 6).alias("success"), F.round(n % 4 / 4 + 0.25, 6).alias("clarity"))
    return s.withColumns({"merge_key": F.concat(F.lit("k"), F.col("id") % 20), "evidence_ids": F.array(F.col("id") % 7, F.lit(0).cast("long"))})


@query("ref_op125_skill_merge", "WITH " + SKILLS + """ SELECT merge_key, count(*) AS merged, round(least(1, avg(frequency) + 0.1 * (count(*) - 1)), 6)::DOUBLE AS frequency, round(least(1,
    avg(stability) + CASE WHEN count(*) > 1 THEN 0.05 ELSE 0 END), 6)::DOUBLE AS stability, round(avg(success), 6)::DOUBLE AS success, round(least(1,
    max(clarity)), 6)::DOUBLE AS clarity, array_to_string(list_sort(list_distinct(list(e) || [0])), ',') AS evidence FROM skills GROUP BY 1""")
def skill_merge(spark, d):
    return P.merged_skills(skills(spark, d)).withColumn("evidence", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",")).drop("evidence_ids")


@query("ref_op258_skill_retirement", "WITH " + SKILLS + """ SELECT id, 'merged:' || merge_key AS replaced_by, 'retire_candidate' AS status, round(success * 0.8, 6)::DOUBLE AS success
    FROM skills WHERE merge_key IN (SELECT merge_key FROM skills GROUP BY 1 HAVING count(*) > 1)""")
def skill_retirement(spark, d):
    s = skills(spark, d)
    return P.retired(s, P.merged_skills(s))


@query("ref_op112_relation_diagnostics", with_(EDGES) + """SELECT session_id AS request_id, sum(s)::BIGINT AS scanned, sum(e)::BIGINT AS eligible, sum(e)::BIGINT AS related, max(hop)
    AS hops, bool_or(e > 1) AS exhausted, string_agg(type, ',' ORDER BY type) AS types, array_to_string(list(sample ORDER BY type)[1:4], ',')
    AS samples FROM (SELECT session_id, type, count(*) AS s, count(*) FILTER (WHERE confidence > 0.6) AS e, max(split_part(id, '.', 3)::BIGINT)
    AS hop, min(id) AS sample FROM edges GROUP BY 1, 2) WHERE e > 0 GROUP BY 1""")
def relation_diagnostics(spark, d):
    good = F.count_if(F.col("confidence") > 0.6)
    passes = C.edges(spark, d).groupBy(F.col("session_id").alias("request_id"), "type").agg(F.count("*").alias("scanned"), good.alias("eligible"), good.alias("related"), F.max(F.split("id", r"\.")[2].cast("long")).alias("hops"), (good > 1).alias("exhausted"), F.min("id").alias("sample"))
    return P.merged_diagnostics(passes.withColumn("pass", F.col("type")))


@query("ref_op210_dedupe_chunks", """SELECT conv_id AS list_id, (row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1) // 3 AS chunk, row_number() OVER (PARTITION
    BY conv_id ORDER BY f) - 1 AS pos, id FROM (SELECT conv_id, role || (turn % 3) AS id, min(turn) AS f FROM conversations GROUP BY 1, 2)""")
def dedupe_chunks(spark, d):
    c = C.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn") % 3).alias("id")))), lambda x: x["id"]).alias("ids"))
    return P.chunks(c, 3).withColumn("pos", F.col("pos").cast("long"))


@query("ref_op208_recent_compaction", """SELECT id, coalesce(at_ - last_ <= 5000, FALSE) AS recent FROM (SELECT event_id AS id, event_id * 900 AS at_, max(event_id
    * 900) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS last_ FROM events)""")
def recent_compaction(spark, d):
    e = C.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("session_id"), (F.col("event_id") * 900).alias("at"), (F.col("event_type") == "purchase").alias("own"))
    return P.recent_own(e)


@query("ref_op260_persist_or_skip", """WITH b AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS ids, max(role) AS goal FROM conversations GROUP BY 1)
    SELECT 's' || b.conv_id AS session_id, b.conv_id % 10 = 0 OR c.ids IS NULL OR b.ids <> c.ids OR b.goal <> c.goal AS persist FROM b LEFT JOIN
    b c ON c.conv_id = b.conv_id - 1""")
def persist_or_skip(spark, d):
    b = C.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("ids"), F.max("role").alias("goal"))
    own = b.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), "ids", "goal", (F.col("conv_id") % 10 == 0).alias("forced"))
    return P.to_persist(own, b.select(F.concat(F.lit("s"), F.col("conv_id") + 1).alias("session_id"), "ids", "goal", F.col("conv_id").alias("created_at")))
