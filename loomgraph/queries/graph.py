"""Queries of relations, conflicts and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.queries.model_sql import CORRECTIONS, EDGES, NODES, RECORDS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

BETWEEN = ("Rule", "Constraint", "Mode", "Process", "Step", "Risk", "Decision", "State", "Outcome", "Tool")
STEPS = """steps AS (SELECT at_, to_, id AS edge_id, type, confidence AS ec, CASE type WHEN 'supported_by' THEN 2.5 WHEN 'requires' THEN 1.75 WHEN 'next_step'
    THEN 1.5 ELSE 1.25 END::DOUBLE AS priority FROM (SELECT from_id AS at_, to_id AS to_, id, type, confidence FROM edges UNION ALL SELECT to_id,
    from_id, id, type, confidence FROM edges) WHERE type IN ('supported_by', 'requires', 'next_step', 'overrides') AND at_ <> to_)"""
SOURCES = "sources AS (SELECT id AS source_id, session_id, CASE type WHEN 'Rule' THEN 2.5 ELSE 2.0 END::DOUBLE AS slot_bonus FROM nodes WHERE type IN ('Rule', 'Step', 'Decision', 'Goal'))"
ONE = """one AS (SELECT s.source_id, s.session_id, t.to_ AS target_id, t.type, t.edge_id, s.slot_bonus + t.priority AS bonus FROM
    sources s JOIN steps t ON s.source_id = t.at_ JOIN nodes n ON n.id = t.to_ WHERE n.type IN ('Evidence', 'State', 'Tool', 'Topic'))"""
TWO = f"""two AS (SELECT s.source_id, a.to_ AS middle_id, b.to_ AS target_id, a.type AS first, b.type AS second, round(s.slot_bonus
    + a.priority + (s.slot_bonus + b.priority) * 0.75 + (a.ec + b.ec) / 2 * 0.9 + (m.confidence + n.confidence) / 2 * 0.75, 6) AS bonus FROM
    sources s JOIN steps a ON s.source_id = a.at_ JOIN nodes m ON m.id = a.to_ JOIN steps b ON b.at_ = a.to_ JOIN nodes n ON n.id = b.to_ WHERE
    m.type IN {BETWEEN} AND n.type IN ('Evidence', 'Topic', 'Tool') AND b.type IN ('supported_by', 'next_step') AND b.to_ <> s.source_id)"""
#: labels with words that command or forbid; two types, so that equal ones meet in a session
LABELLED = """labelled AS (SELECT * EXCLUDE (type), (['Rule', 'Constraint'])[((turn // 4) % 2 + 1)::INTEGER] AS type, label || (['; never do this', '; must keep it',
    '', ''])[((conv_id + turn // 2) % 4 + 1)::INTEGER] AS said FROM nodes),
sided AS (SELECT *, CASE WHEN regexp_matches(lower(said), '\\b(?:must not|should not|do not|don''t|never|forbid|forbidden|disable|stop|remove|avoid)\\b|不要|不能|不可|禁止|禁用|停止|移除|避免')
    THEN 'negative' WHEN regexp_matches(lower(said), '\\b(?:must|should|enable|continue|keep|preserve|use|required)\\b|必须|应该|启用|继续|保留|使用|要求')
    THEN 'positive' ELSE 'neutral' END AS polarity,
  CASE origin_kind WHEN 'raw' THEN 3 WHEN 'compressed' THEN 2 ELSE 1 END AS origin FROM labelled)"""
PAIRS = LABELLED + """,
pairs AS (SELECT a.id AS left_id, b.id AS right_id, a.type = b.type AS same, (a.polarity, b.polarity) IN (('positive', 'negative'), ('negative',
    'positive')) AS opposite, CASE WHEN a.updated_at > b.updated_at THEN a.id ELSE b.id END AS newer,
 CASE WHEN (b.override_priority, b.origin, b.confidence, b.updated_at) > (a.override_priority, a.origin, a.confidence, a.updated_at) THEN b.id
    ELSE a.id END AS strong FROM sided a JOIN sided b ON a.session_id = b.session_id AND a.scope = b.scope AND a.conflict_key = b.conflict_key
    AND a.id < b.id)"""
STANDING = """standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_kind, target_id ORDER BY created_at DESC, event_id
    DESC) AS r FROM corrections) WHERE r = 1 AND action <> 'rollback')"""


def _sources(spark, d):
    bonus = F.when(F.col("type") == "Rule", 2.5).otherwise(2.0)
    return C.nodes(spark, d).where(F.col("type").isin("Rule", "Step", "Decision", "Goal")).select(F.col("id").alias("source_id"), "session_id", bonus.alias("slot_bonus"))


def _one(spark, d):
    return G.one_hop(_sources(spark, d).drop("session_id"), C.edges(spark, d), C.nodes(spark, d), ("Evidence", "State", "Tool", "Topic"))


def _two(spark, d):
    return G.two_hops(_sources(spark, d), C.edges(spark, d), C.nodes(spark, d), BETWEEN, ("Evidence", "Topic", "Tool"), ("supported_by", "next_step"))


def sided(spark, d):
    n = C.nodes(spark, d)
    pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    said = F.concat("label", pick(F.col("conv_id") + F.floor(F.col("turn") / 2), "; never do this", "; must keep it", "", ""))
    return n.withColumns({"type": pick(F.floor(F.col("turn") / 4), "Rule", "Constraint"), "polarity": G.polarity(said)})


@query("ref_op081_one_hop", with_(NODES, EDGES, STEPS, SOURCES, ONE) + "SELECT source_id, target_id, type, edge_id, bonus FROM one")
def one_hop(spark, d):
    return _one(spark, d)


@query("ref_op082_two_hops", with_(NODES, EDGES, STEPS, SOURCES, TWO) + "SELECT source_id, middle_id, target_id, first, second, bonus FROM two")
def two_hops(spark, d):
    return _two(spark, d)


@query("ref_op110_relation_bonus", with_(NODES, EDGES, STEPS, SOURCES, ONE) + "SELECT target_id, round(sum(bonus), 6) AS bonus, count(*) AS hints FROM (SELECT source_id, target_id, type, max(bonus) AS bonus FROM one GROUP BY 1, 2, 3) GROUP BY 1")
def relation_bonus(spark, d):
    return G.target_bonus(_one(spark, d))


PATHS = """paths AS (SELECT 'r' || substr(split_part(source_id, '.', 1), 2) AS request_id, source_id, target_id, bonus, hops FROM (SELECT
    source_id, target_id, bonus, 1 AS hops FROM one UNION ALL SELECT source_id, target_id, bonus, 2 FROM two))"""


def _paths(spark, d):
    both = _one(spark, d).select("source_id", "target_id", "bonus", F.lit(1).alias("hops")).unionByName(_two(spark, d).select("source_id", "target_id", "bonus", F.lit(2).alias("hops")))
    return both.withColumn("request_id", F.concat(F.lit("r"), F.substring(F.split("source_id", r"\.")[0], 2, 20)))


@query("ref_op156_path_order", with_(NODES, EDGES, STEPS, SOURCES, ONE, TWO, PATHS) + """SELECT request_id, source_id, target_id, bonus, hops, row_number() OVER (PARTITION BY request_id ORDER BY bonus DESC, hops,
    target_id, source_id) AS pos FROM (SELECT DISTINCT * FROM paths)""")
def path_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy(*G.path_order("bonus_then_hops"), "source_id")
    return _paths(spark, d).distinct().withColumn("pos", F.row_number().over(w).cast("long")).select("request_id", "source_id", "target_id", "bonus", "hops", "pos")


@query("ref_op174_path_admission", with_(NODES, EDGES, STEPS, SOURCES, ONE, TWO, PATHS) + "SELECT request_id, count(*) AS paths, count(*) FILTER (WHERE bonus < 5.2) AS below_floor FROM paths GROUP BY 1")
def path_admission(spark, d):
    a = G.admitted_paths(_paths(spark, d))
    return a.groupBy("request_id").agg(F.count("*").alias("paths"), F.count_if(F.col("status") == "score_floor").alias("below_floor"))


@query("ref_op174_path_admission_status")
def path_admission_status(spark, d):
    return G.admitted_paths(_paths(spark, d))


@query("ref_op192_polarity", with_(NODES, LABELLED) + "SELECT id, polarity FROM sided")
def polarity(spark, d):
    return sided(spark, d).select("id", "polarity")


@query("ref_op084_conflicts", with_(NODES, PAIRS) + """SELECT left_id, right_id, CASE WHEN opposite THEN 'conflicts_with' ELSE 'supersedes' END AS relation, CASE WHEN opposite
    THEN strong ELSE newer END AS winner FROM pairs WHERE opposite OR same""")
def conflicts(spark, d):
    return G.conflict_pairs(sided(spark, d)).drop("session_id")


@query("ref_op216_conflict_winner", with_(NODES, PAIRS) + "SELECT strong AS winner, count(*) AS won FROM pairs WHERE opposite GROUP BY 1")
def conflict_winner(spark, d):
    return G.conflict_standing(sided(spark, d)).where("won > 0").select(F.col("id").alias("winner"), "won")


@query("ref_op217_superseded", with_(NODES, PAIRS) + "SELECT CASE WHEN newer = left_id THEN right_id ELSE left_id END AS id, max(newer) AS superseded_by FROM pairs WHERE same AND NOT opposite GROUP BY 1")
def superseded(spark, d):
    return G.conflict_standing(sided(spark, d)).where("superseded_by is not null").select("id", "superseded_by")


@query("ref_op046_suppressed_by_conflict", with_(NODES, PAIRS) + "SELECT DISTINCT CASE WHEN strong = left_id THEN right_id ELSE left_id END AS id FROM pairs WHERE opposite")
def suppressed_by_conflict(spark, d):
    return G.conflict_standing(sided(spark, d)).where("suppressed").select("id")


@query("ref_op149_correction_precedence", with_(CORRECTIONS, STANDING) + "SELECT target_kind, count(*) AS n FROM standing GROUP BY 1")
def correction_precedence(spark, d):
    return G.standing(C.corrections(spark, d)).groupBy("target_kind").agg(F.count("*").alias("n"))


@query("ref_op223_suppression_and_labels", with_(CORRECTIONS, STANDING) + "SELECT target_id, id, new_label FROM standing WHERE target_kind = 'label_override'")
def suppression_and_labels(spark, d):
    return G.resolved(C.corrections(spark, d), "label_override").select("target_id", "id", "new_label")


@query("ref_op222_noise_override", with_(CORRECTIONS, STANDING) + "SELECT target_id, disposition FROM standing WHERE target_kind = 'noise_policy'")
def noise_override(spark, d):
    return G.resolved(C.corrections(spark, d), "noise_policy").select("target_id", "disposition")


@query("ref_op221_promotion_decision", with_(CORRECTIONS, STANDING) + "SELECT target_id, CASE disposition WHEN 'materialize' THEN 'promote' WHEN 'drop' THEN 'retire' ELSE 'hold' END AS decision FROM standing WHERE target_kind = 'promotion_decision'")
def promotion_decision(spark, d):
    return G.resolved(C.corrections(spark, d), "promotion_decision").select("target_id", F.when(F.col("disposition") == "materialize", "promote").when(F.col("disposition") == "drop", "retire").otherwise("hold").alias("decision"))


@query("ref_op219_alias_catalog", with_(CORRECTIONS) + """SELECT target_id AS concept, new_label AS alias FROM (SELECT *, row_number() OVER (PARTITION BY target_id, new_label ORDER
    BY created_at DESC, event_id DESC) AS r FROM corrections WHERE target_kind = 'concept_alias') WHERE r = 1 AND action <> 'rollback' UNION
    SELECT * FROM (VALUES ('n1.0', 'kg'), ('n2.0', 'trace'))""")
def alias_catalog(spark, d):
    return G.alias_catalog(spark.createDataFrame([("n1.0", "kg"), ("n2.0", "trace")], "concept string, alias string"), C.corrections(spark, d))


@query("ref_op127_alias_workbench", with_(CORRECTIONS) + """SELECT target_id AS concept, string_agg(DISTINCT new_label, ',' ORDER BY new_label) AS labels, count(*) AS corrections, max(created_at)
    AS latest FROM corrections WHERE target_kind = 'concept_alias' GROUP BY 1""")
def alias_workbench(spark, d):
    c = C.corrections(spark, d).where("target_kind = 'concept_alias'")
    return c.groupBy(F.col("target_id").alias("concept")).agg(F.array_join(F.array_sort(F.collect_set("new_label")), ",").alias("labels"), F.count("*").alias("corrections"), F.max("created_at").alias("latest"))


@query("ref_op220_semantic_overrides", with_(CORRECTIONS) + """SELECT target_id, disposition AS type, bool_or(action = 'apply') AS include FROM (SELECT *, row_number() OVER (PARTITION
    BY target_id, disposition ORDER BY created_at DESC, event_id DESC) AS r FROM corrections WHERE target_kind = 'noise_policy') WHERE r = 1
    GROUP BY 1, 2""")
def semantic_overrides(spark, d):
    return G.semantic_overrides(C.corrections(spark, d).where("target_kind = 'noise_policy'").withColumnRenamed("disposition", "type"))


@query(
    "ref_op218_conflict_patches",
    with_(NODES, PAIRS) + """, sides AS (SELECT strong AS winner, CASE WHEN strong = left_id THEN right_id ELSE left_id END AS loser, TRUE AS opposed FROM pairs WHERE opposite
    UNION ALL SELECT newer, CASE WHEN newer = left_id THEN right_id ELSE left_id END, FALSE FROM pairs WHERE same AND NOT opposite),
  every AS (SELECT loser AS id, winner AS other, opposed, TRUE AS lost FROM sides UNION ALL SELECT winner, loser, opposed, FALSE FROM sides)
  SELECT id, CASE WHEN bool_or(lost AND NOT opposed) THEN 'superseded' ELSE 'active' END AS freshness, max(other) FILTER (WHERE lost AND NOT
    opposed) AS superseded_by, coalesce(string_agg(DISTINCT other, ',' ORDER BY other) FILTER (WHERE opposed), '') AS conflicting, bool_or(lost
    AND opposed) AS suppressed FROM every GROUP BY 1""",
)
def conflict_patches(spark, d):
    return G.conflict_patches(G.conflict_pairs(sided(spark, d)))


@query("ref_op088_correction_overlay", with_(NODES, CORRECTIONS, STANDING) + """SELECT n.id, coalesce(s.new_label, n.label) AS label FROM nodes n LEFT JOIN standing s ON s.target_kind = 'label_override'
    AND s.target_id = n.id WHERE n.id NOT IN (SELECT target_id FROM standing WHERE target_kind = 'node_suppression')""")
def correction_overlay(spark, d):
    return G.corrected(C.nodes(spark, d), C.corrections(spark, d)).select("id", "label")


@query("ref_op048_manually_suppressed", with_(NODES, CORRECTIONS, STANDING) + "SELECT id FROM nodes WHERE id IN (SELECT target_id FROM standing WHERE target_kind = 'node_suppression')")
def manually_suppressed(spark, d):
    return C.nodes(spark, d).join(G.resolved(C.corrections(spark, d), "node_suppression").select(F.col("target_id").alias("id")), "id", "left_semi").select("id")


@query("ref_op096_explain_adjacency", with_(NODES, EDGES) + """SELECT n.id, e.id AS edge_id, e.type, CASE WHEN e.from_id = n.id THEN e.to_id ELSE e.from_id END AS other FROM nodes n JOIN
    edges e ON e.from_id = n.id OR e.to_id = n.id WHERE n.type = 'Decision'""")
def explain_adjacency(spark, d):
    n, e = C.nodes(spark, d).where("type = 'Decision'").select("id"), C.edges(spark, d).withColumnRenamed("id", "edge_id").select("edge_id", "type", "from_id", "to_id")
    out = n.join(e, F.col("id") == F.col("from_id")).select("id", "edge_id", "type", F.col("to_id").alias("other"))
    return out.unionByName(n.join(e, F.col("id") == F.col("to_id")).select("id", "edge_id", "type", F.col("from_id").alias("other")))


@query("ref_op080_nodes_with_sources", with_(NODES, RECORDS) + "SELECT n.id, r.source_type, r.created_at FROM nodes n LEFT JOIN records r ON r.conv_id = n.conv_id AND r.turn = n.turn")
def nodes_with_sources(spark, d):
    r = C.records(spark, d).select("conv_id", "turn", "source_type", "created_at")
    return C.nodes(spark, d).join(r, ["conv_id", "turn"], "left").select("id", "source_type", "created_at")


@query("ref_op128_evidence_coverage", with_(NODES, EDGES) + """SELECT n.session_id, count(*) AS rules, count(*) FILTER (WHERE n.id IN (SELECT from_id FROM edges WHERE type = 'supported_by'))
    AS covered FROM nodes n WHERE n.type IN ('Rule', 'Constraint', 'Decision') GROUP BY 1""")
def evidence_coverage(spark, d):
    held = C.edges(spark, d).where("type = 'supported_by'").select(F.col("from_id").alias("id"), F.lit(1).alias("held")).distinct()
    n = C.nodes(spark, d).where(F.col("type").isin("Rule", "Constraint", "Decision")).join(held, "id", "left")
    return n.groupBy("session_id").agg(F.count("*").alias("rules"), F.count("held").alias("covered"))

