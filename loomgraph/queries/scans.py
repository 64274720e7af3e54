"""Queries of scans, filters, writes and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import scans as S
from loomgraph.queries.model_sql import _iso, CONTRACT, CORRECTIONS, EDGES, NODES, NORM, RECORDS, terms, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

TEXT = "the thing that"


@query("ref_op010_query_nodes", with_(NODES) + "SELECT id, type, label, updated_at FROM nodes WHERE type IN ('Rule', 'Constraint', 'Risk') AND scope = 'session' ORDER BY updated_at DESC, label, id LIMIT 500")
def query_nodes(spark, d):
    return S.in_node_order(C.nodes(spark, d).where(S.node_filter(types=("Rule", "Constraint", "Risk"), scopes=("session",))), 500).select("id", "type", "label", "updated_at")


@query("ref_op011_query_edges", with_(EDGES) + "SELECT id, from_id, to_id, type FROM edges WHERE type IN ('supported_by', 'requires') ORDER BY updated_at DESC, id LIMIT 500")
def query_edges(spark, d):
    return S.in_edge_order(C.edges(spark, d).where(S.edge_filter(types=("supported_by", "requires"))), 500).select("id", "from_id", "to_id", "type")


@query("ref_op012_get_node", with_(NODES) + "SELECT id, type, label, payload FROM nodes WHERE id = 'n3.1'")
def get_node(spark, d):
    return C.nodes(spark, d).where(F.col("id") == "n3.1").select("id", "type", "label", "payload")


@query(
    "ref_op013_nodes_by_ids",
    with_(NODES) + ", ".join(["SELECT w.conv_id AS list_id", "w.pos", "n.id", """n.type FROM (SELECT conv_id, p.pos, ['n' || conv_id || '.1', 'n' || conv_id || '.0', 'n' || conv_id || '.1', 'n' || conv_id
    || '.99'][p.pos + 1] AS id FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0), (1), (2), (3)) p(pos)) w JOIN nodes n USING (id)"""]),
)
def nodes_by_ids(spark, d):
    ids = F.array(*(F.concat(F.lit("n"), "conv_id", F.lit(x)) for x in (".1", ".0", ".1", ".99")))
    wanted = C.read(spark, d, "conversations").select(F.col("conv_id").alias("list_id"), F.lit(1)).distinct().select("list_id", F.col("list_id").alias("conv_id")).select("list_id", ids.alias("ids"))
    return S.by_ids(wanted, C.nodes(spark, d).select("id", "type")).select("list_id", "pos", "id", "type")


@query("ref_op014_edges_of_nodes", with_(NODES, EDGES) + "SELECT DISTINCT e.id, e.type FROM edges e WHERE e.from_id IN (SELECT id FROM nodes WHERE type = 'Goal') OR e.to_id IN (SELECT id FROM nodes WHERE type = 'Goal')")
def edges_of_nodes(spark, d):
    return S.edges_of(C.nodes(spark, d).where("type = 'Goal'").select("id"), C.edges(spark, d)).select("id", "type")


@query("ref_op016_latest_checkpoint", with_(NODES) + """SELECT session_id, id AS checkpoint_id, updated_at AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id
    ORDER BY updated_at DESC, id) AS r FROM nodes WHERE type IN ('State', 'Decision', 'Outcome')) WHERE r = 1""")
def latest_checkpoint(spark, d):
    n = C.nodes(spark, d).where(F.col("type").isin("State", "Decision", "Outcome"))
    return S.latest(n, "session_id", F.desc("updated_at"), F.asc("id")).select("session_id", F.col("id").alias("checkpoint_id"), F.col("updated_at").alias("created_at"))


SAVED = f"""saved AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'delta' ELSE 'checkpoint' END AS kind, 'k' || event_id AS id, 's' || user_id AS session_id, {_iso("event_id * 60")} AS created_at FROM events)"""


@query("ref_op017_list_checkpoints", "WITH " + SAVED + " SELECT session_id, kind, id, created_at, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY created_at DESC, id) AS place FROM saved) WHERE place <= 20")
def list_checkpoints(spark, d):
    e = C.read(spark, d, "events")
    saved = e.select(F.when(F.col("event_id") % 3 == 0, "delta").otherwise("checkpoint").alias("kind"), F.concat(F.lit("k"), "event_id").alias("id"), F.concat(F.lit("s"), "user_id").alias("session_id"), C.iso(F.col("event_id") * 60).alias("created_at"))
    return S.listed(saved, 20).withColumn("place", F.col("place").cast("long"))


@query("ref_op019_list_corrections", with_(CORRECTIONS) + "SELECT id, target_kind, target_id, action, created_at FROM corrections ORDER BY created_at DESC, id LIMIT 200")
def list_corrections(spark, d):
    return C.corrections(spark, d).orderBy(F.desc("created_at"), "id").limit(200).select("id", "target_kind", "target_id", "action", "created_at")


@query(
    "ref_op021_truth_source",
    with_(RECORDS)
    + """SELECT session_id, source, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY p) AS r FROM (SELECT session_id,
    'live' AS source, 0 AS p, count(*) AS n FROM records WHERE role = 'user' AND conv_id % 3 = 0 GROUP BY 1 UNION ALL SELECT session_id, 'persisted',
    1, count(*) FROM records WHERE role = 'assistant' AND conv_id % 2 = 0 GROUP BY 1 UNION ALL SELECT session_id, 'transcript', 2, count(*) FROM
    records GROUP BY 1)) WHERE r = 1""",
)
def truth_source(spark, d):
    r = C.records(spark, d)
    per = lambda rows, source, p: rows.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit(source).alias("source"), F.lit(p).alias("p"), "n")
    all_ = per(r.where("role = 'user' and conv_id % 3 = 0"), "live", 0).unionByName(per(r.where("role = 'assistant' and conv_id % 2 = 0"), "persisted", 1)).unionByName(per(r, "transcript", 2))
    return S.latest(all_, "session_id", F.asc("p")).select("session_id", "source", "n")


@query(
    "ref_op030_upsert_nodes",
    with_(NODES) + """SELECT id, label, freshness FROM (SELECT id, label, freshness, 0 AS s, 0 AS q FROM nodes UNION ALL SELECT id, 'again ' ||
    label, 'stale', 1, turn FROM nodes WHERE turn % 2 = 1 UNION ALL SELECT id, 'last ' || label, 'active', 1, turn + 100 FROM nodes WHERE turn
    % 4 = 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, q DESC) = 1""",
)
def upsert_nodes(spark, d):
    n = C.nodes(spark, d).select("id", "label", "freshness", "turn")
    first = n.where("turn % 2 = 1").select("id", F.concat(F.lit("again "), "label").alias("label"), F.lit("stale").alias("freshness"), F.col("turn").alias("seq"))
    last = n.where("turn % 4 = 1").select("id", F.concat(F.lit("last "), "label").alias("label"), F.lit("active").alias("freshness"), (F.col("turn") + 100).alias("seq"))
    return S.upserted(n.drop("turn"), first.unionByName(last), "id", "seq")


@query("ref_op032_source_dimension", """SELECT DISTINCT sha256('{\"source_type\":\"' || source || '\",\"lang\":' || CASE WHEN lang IS NULL THEN 'null' ELSE '\"'
    || lang || '\"' END || '}') AS source_id, source AS source_type, lang FROM documents""")
def source_dimension(spark, d):
    return S.source_dimension(C.read(spark, d, "documents").select(F.col("source").alias("source_type"), "lang"), "source_type", "lang")


@query("ref_op040_node_filter", with_(NODES) + f"""SELECT id FROM nodes, (SELECT {NORM.format(repr(TEXT))} AS q) WHERE scope = 'session' AND freshness = 'active' AND origin_kind
    = 'raw' AND (contains({NORM.format('label')}, q) OR len([t FOR t IN {terms('q')} IF contains({NORM.format('label')}, t)]) >= 1 OR contains({NORM.format('payload')},
    q) OR len([t FOR t IN {terms('q')} IF contains({NORM.format('payload')}, t)]) >= 1)""")
def node_filter(spark, d):
    return C.nodes(spark, d).where(S.node_filter(scopes=("session",), freshness=("active",), origins=("raw",), query=TEXT)).select("id")


@query("ref_op041_edge_filter", with_(EDGES) + "SELECT id, type FROM edges WHERE (from_id = 'n5.1' OR to_id = 'n5.1') AND session_id = 's5'")
def edge_filter(spark, d):
    return C.edges(spark, d).where(S.edge_filter(node_id="n5.1", session_id="s5")).select("id", "type")


@query("ref_op042_payload_predicate", with_(NODES) + "SELECT workspace_id, count(*) AS n FROM nodes WHERE payload LIKE '%\"workspaceId\":\"w3\"%' GROUP BY 1")
def payload_predicate(spark, d):
    return C.nodes(spark, d).where(S.node_filter(workspace_id="w3")).groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("ref_op155_node_order", with_(NODES) + "SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, label, id) AS pos FROM nodes")
def node_order(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("updated_at"), "label", "id")
    return C.nodes(spark, d).select("id", F.row_number().over(w).cast("long").alias("pos"))


@query("ref_op158_history_page", with_(RECORDS) + """SELECT session_id, id, total, total > 4 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at
    DESC, id) AS pos, count(*) OVER (PARTITION BY session_id) AS total FROM records) WHERE pos > 2 AND pos <= 4""")
def history_page(spark, d):
    return S.page(C.records(spark, d), "session_id", 2, 2, F.desc("created_at"), F.asc("id")).select("session_id", "id", "total", "has_more")


@query("ref_op159_due_schedules", "SELECT event_id, event_id * 60 % 7200 AS due_at FROM events WHERE event_type = 'error' AND event_id * 60 % 7200 <= 3600 ORDER BY due_at, event_id LIMIT 100")
def due_schedules(spark, d):
    e = C.read(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("event_id") * 60 % 7200).alias("due_at"))
    return e.where("due_at <= 3600").orderBy("due_at", "event_id").limit(100)


@query("ref_op215_relation_contract", with_(CONTRACT) + """SELECT type, stable, usage, freshness, default_confidence::DOUBLE AS default_confidence, recall_priority::DOUBLE AS recall_priority,
    recall_order::INTEGER AS recall_order, usage = 'recall_eligible' AS recall_eligible, TRUE AS explain_visible FROM contract""")
def relation_contract(spark, d):
    from loomgraph.functions.fixed import relation_contract

    return relation_contract(spark)


@query("ref_op049_recall_eligible_edges", with_(EDGES) + "SELECT type, count(*) AS n FROM edges WHERE type IN ('supported_by', 'requires', 'next_step', 'overrides') GROUP BY 1")
def recall_eligible_edges(spark, d):
    from loomgraph.functions.fixed import relation_contract

    contract = relation_contract(spark).where("recall_eligible").select("type")
    return C.edges(spark, d).join(F.broadcast(contract), "type", "left_semi").groupBy("type").agg(F.count("*").alias("n"))



