"""Queries of traces and explanations: what is known of a node, put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import bundles as B
from loomgraph.operators import store as P
from loomgraph.operators import tools as T
from loomgraph.queries import bundles as Q
from loomgraph.queries.compile import CANDIDATES
from loomgraph.queries.graph import STANDING
from loomgraph.queries.model_sql import CORRECTIONS, EDGES, NODES, RECORDS, REQUESTS, with_
from loomgraph.queries.registry import query
from loomgraph.queries.store import KEPT, kept
from loomgraph.queries.tools import WITH, results
from loomgraph.sources import corpus as C


@query("ref_op069_tool_payload", WITH + """SELECT id, '{' || array_to_string([x FOR x IN ['\"tool\":\"' || tool || '\"', '\"status\":\"' || status || '\"', '\"kind\":\"'
    || kind || '\"', '\"errorCode\":\"' || error_code || '\"', '\"items\":' || items] IF x IS NOT NULL], ',') || '}' AS payload FROM results
    WHERE reduced""")
def tool_payload(spark, d):
    kept_ = T.compressed(results(spark, d))
    return kept_.select("id", F.to_json(F.struct("tool", "status", "kind", F.col("error_code").alias("errorCode"), "items"), {"ignoreNullFields": "true"}).alias("payload"))


def _status(spark, d):
    return Q.selection_status(spark, d)


DEGREE = "degree AS (SELECT id, count(*) AS edges FROM (SELECT from_id AS id, type FROM edges UNION ALL SELECT to_id, type FROM edges) GROUP BY 1)"


def degree(spark, d):
    e = C.edges(spark, d)
    return e.select(F.col("from_id").alias("id")).unionByName(e.select(F.col("to_id").alias("id"))).groupBy("id").agg(F.count("*").alias("edges"))


@query(
    "ref_op072_trace_view",
    with_(RECORDS, Q.SPOKEN, REQUESTS, CANDIDATES, Q.SLOTTED, KEPT) + """SELECT n.id, r.source_type, n.origin_kind, coalesce(s.bundles, 0) AS bundles, coalesce(p.kinds, 0) AS kept_kinds FROM nodes
    n JOIN records r ON r.conv_id = n.conv_id AND r.turn = n.turn LEFT JOIN (SELECT id, count(DISTINCT request_id) AS bundles FROM items GROUP
    BY 1) s ON s.id = n.id LEFT JOIN (SELECT id, count(DISTINCT kind) AS kinds FROM found GROUP BY 1) p ON p.id = n.id""",
)
def trace_view(spark, d):
    source = C.records(spark, d).select("conv_id", "turn", "source_type")
    output = Q.items(spark, d).groupBy("id").agg(F.countDistinct("request_id").alias("bundles"))
    held = P.persisted_in(C.nodes(spark, d).select("id", "session_id"), kept(spark, d)).groupBy("id").agg(F.countDistinct("kind").alias("kept_kinds"))
    rows = C.nodes(spark, d).join(source, ["conv_id", "turn"]).join(output, "id", "left").join(held, "id", "left")
    return rows.select("id", "source_type", "origin_kind", F.coalesce("bundles", F.lit(0)).alias("bundles"), F.coalesce("kept_kinds", F.lit(0)).alias("kept_kinds"))


@query(
    "ref_op315_explain",
    with_(Q.SPOKEN, EDGES, REQUESTS, CORRECTIONS, STANDING, Q.SCORED, Q.SLOTTED, Q.TOPIC, Q._STATUS, DEGREE)
    + """SELECT request_id, c.id, CASE WHEN gone THEN 'suppressed' WHEN slot IN ('goal', 'intent', 'process') AND rank <= most THEN
    'fixed' WHEN slot IS NOT NULL AND rank <= most THEN 'category' WHEN slot IN ('goal', 'intent', 'process') THEN 'fixed_skipped' WHEN slot
    IS NOT NULL THEN 'category_skipped' WHEN type = 'Topic' AND rank <= 4 THEN 'topic_hint' WHEN conflicted THEN 'conflict' WHEN NOT admitted
    THEN 'scope' ELSE 'not_selected' END AS status, coalesce(g.edges, 0) AS edges, coalesce(k.n, 0) AS corrections FROM considered c LEFT JOIN
    degree g ON g.id = c.id LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM corrections GROUP BY 1) k ON k.id = c.id""",
)
def explain(spark, d):
    touched = C.corrections(spark, d).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("corrections"))
    rows = _status(spark, d).join(degree(spark, d), "id", "left").join(touched, "id", "left")
    return rows.select("request_id", "id", "status", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("corrections", F.lit(0)).alias("corrections"))


@query(
    "ref_op121_explain_completeness",
    with_(NODES, EDGES, KEPT, DEGREE) + """SELECT session_id, count(*) AS probes, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE coalesce(edges,
    0) >= 3 AND id IN (SELECT id FROM found WHERE kind = 'delta'))::DOUBLE / count(*), 6) END::DOUBLE AS coverage FROM nodes n LEFT JOIN degree
    USING (id) WHERE type IN ('Rule', 'Decision', 'State') GROUP BY 1""",
)
def explain_completeness(spark, d):
    held = P.persisted_in(C.nodes(spark, d).select("id", "session_id"), kept(spark, d)).where("kind = 'delta'").select("id").distinct().withColumn("held", F.lit(True))
    rows = C.nodes(spark, d).where(F.col("type").isin("Rule", "Decision", "State")).join(degree(spark, d), "id", "left").join(held, "id", "left")
    whole = (F.coalesce("edges", F.lit(0)) >= 3) & F.coalesce("held", F.lit(False))
    return rows.groupBy("session_id").agg(F.count("*").alias("probes"), B.coverage(F.count_if(whole), F.count("*")).alias("coverage"))


@query("ref_op304_notifications", """WITH a AS (SELECT user_id AS snapshot_id, event_type AS metric, avg(value) AS v FROM events GROUP BY 1, 2), s(id, metric,
    least) AS (VALUES (1, 'error', 22.0), (2, NULL, 30.0), (3, 'view', 18.0)) SELECT s.id AS subscription, snapshot_id, a.metric, row_number()
    OVER (PARTITION BY s.id ORDER BY snapshot_id, a.metric) AS seq FROM a JOIN s ON (s.metric IS NULL OR s.metric = a.metric) AND a.v >= s.least""")
def notifications(spark, d):
    from pyspark.sql import Window

    a = C.read(spark, d, "events").groupBy(F.col("user_id").alias("snapshot_id"), "event_type").agg(F.avg("value").alias("v"))
    subs = spark.createDataFrame([(1, "error", 22.0), (2, None, 30.0), (3, "view", 18.0)], "subscription int, metric string, least double")
    hit = a.join(F.broadcast(subs), (F.col("metric").isNull() | (F.col("metric") == F.col("event_type"))) & (F.col("v") >= F.col("least")))
    w = Window.partitionBy("subscription").orderBy("snapshot_id", "event_type")
    return hit.select("subscription", "snapshot_id", F.col("event_type").alias("metric"), F.row_number().over(w).cast("long").alias("seq"))
