"""Queries of sessions, compression, checkpoints and deltas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import sessions as S
from loomgraph.queries.model_sql import NODES, RECORDS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

BLOCKS = """blocks AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block,
    greatest(1, ceil(length(content) / 4.0)::INT) AS cost FROM records)"""


@query("ref_op143_turn_blocks", with_(RECORDS, BLOCKS) + "SELECT session_id, turn, block::BIGINT AS block FROM blocks")
def turn_blocks(spark, d):
    return S.turns(C.records(spark, d)).select("session_id", "turn", "block")


@query("ref_op144_raw_tail", with_(RECORDS, BLOCKS) + "SELECT session_id, turn FROM blocks b WHERE block > (SELECT max(block) FROM blocks x WHERE x.session_id = b.session_id) - 2")
def raw_tail(spark, d):
    return S.raw_tail(C.records(spark, d)).select("session_id", "turn")


TRIM = """sys AS (SELECT *, sum(cost) OVER (PARTITION BY session_id, role = 'system' ORDER BY turn ROWS UNBOUNDED PRECEDING) AS up, sum(cost) OVER (PARTITION
    BY session_id, role = 'system' ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS down, 300 + conv_id % 5 * 100 AS budget FROM blocks),
spent AS (SELECT session_id, coalesce(sum(cost) FILTER (WHERE role = 'system' AND up <= budget), 0) AS spent FROM sys GROUP BY 1),
trimmed AS (SELECT s.session_id, s.turn, s.cost FROM sys s JOIN spent USING (session_id) WHERE CASE WHEN role = 'system' THEN up <= budget ELSE down <= budget - spent END)"""


@query("ref_op145_budget_trim", with_(RECORDS, BLOCKS, TRIM) + "SELECT session_id, turn, cost FROM trimmed")
def budget_trim(spark, d):
    return S.trimmed(C.records(spark, d), F.lit(300) + F.col("conv_id") % 5 * 100).select("session_id", "turn", "cost")


@query("ref_op146_live_fallback", with_(RECORDS, BLOCKS, TRIM) + """SELECT session_id, max(turn) AS turn FROM records WHERE role <> 'system' AND session_id NOT IN (SELECT t.session_id FROM
    trimmed t JOIN records r USING (session_id, turn) WHERE r.role <> 'system') GROUP BY 1""")
def live_fallback(spark, d):
    r = C.records(spark, d).where("role <> 'system'")
    kept = S.trimmed(C.records(spark, d), F.lit(300) + F.col("conv_id") % 5 * 100).where("role <> 'system'").select("session_id").distinct()
    return r.join(kept, "session_id", "left_anti").groupBy("session_id").agg(F.max("turn").alias("turn"))


@query("ref_op147_latest_tool_run", """WITH e AS (SELECT 's' || user_id AS session_id, event_id AS turn, event_type IN ('error', 'click') AS tool FROM events),
    g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) - row_number() OVER (PARTITION BY session_id, tool ORDER BY turn)
    AS island FROM e) SELECT session_id, turn FROM g WHERE tool AND island = (SELECT arg_max(island, turn) FROM g x WHERE x.session_id = g.session_id
    AND x.tool)""")
def latest_tool_run(spark, d):
    e = C.read(spark, d, "events").select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_id").alias("turn"), F.col("event_type").isin("error", "click").alias("tool"))
    return S.latest_tool_run(e).select("session_id", "turn")


@query("ref_op148_duplicate_clauses", """SELECT doc_id, sum(n) AS clauses, sum(n - 1) AS repeated FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text,
    chr(10))) AS c FROM documents) WHERE trim(c) <> '' GROUP BY 1, 2) GROUP BY 1""")
def duplicate_clauses(spark, d):
    c = C.read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("c")).where("trim(c) <> ''")
    return c.groupBy("doc_id", "c").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("clauses"), F.sum(F.col("n") - 1).alias("repeated"))


@query("ref_op150_metric_trend", "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events WHERE event_type = 'purchase'")
def metric_trend(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return C.read(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


@query("ref_op151_latest_point", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_point(spark, d):
    return C.read(spark, d, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("ref_op152_incremental_window", with_(RECORDS, BLOCKS) + "SELECT session_id, count(*) AS n FROM blocks b WHERE block > 1 AND block <= (SELECT max(block) FROM blocks x WHERE x.session_id = b.session_id) - 2 GROUP BY 1")
def incremental_window(spark, d):
    w = Window.partitionBy("session_id")
    return S.turns(C.records(spark, d)).withColumn("top", F.max("block").over(w)).where((F.col("block") > 1) & (F.col("block") <= F.col("top") - 2)).groupBy("session_id").agg(F.count("*").alias("n"))


PLAN = """plan AS (SELECT session_id, sum(cost) AS tokens, count(*) FILTER (WHERE block <= top - 2) AS foldable, count(*) FILTER (WHERE block > top - 2)
    AS tail FROM (SELECT *, max(block) OVER (PARTITION BY session_id) AS top FROM blocks) GROUP BY 1)"""


@query("ref_op265_compression_plan", with_(RECORDS, BLOCKS, PLAN) + """SELECT session_id, tokens::BIGINT AS tokens, foldable, tail, CASE WHEN foldable > 0 AND tokens / 800.0 > 0.5 THEN 'full'
    WHEN foldable > 0 THEN 'incremental' ELSE 'none' END AS mode FROM plan""")
def compression_plan(spark, d):
    return S.compression_plan(C.records(spark, d), 2, 0.5, F.lit(800)).select("session_id", "tokens", "foldable", "tail", "mode")


@query("ref_op266_summary_block", with_(RECORDS) + """SELECT session_id, left(string_agg(role || ': ' || left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 120), chr(10) ORDER
    BY turn), 1200) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM records) WHERE r <= 8
    GROUP BY 1""")
def summary_block(spark, d):
    return S.summary_block(C.records(spark, d))


@query("ref_op272_compile_budget", "SELECT item_id, greatest(256, floor((400 + item_id % 30 * 20) * 0.3))::BIGINT AS budget FROM benchmark")
def compile_budget(spark, d):
    return C.requests(spark, d).select(F.col("request_id").alias("item_id"), F.greatest(F.lit(256), F.floor(F.col("token_budget") * 0.3)).cast("long").alias("budget"))


CHECKPOINTS = """points AS (SELECT session_id, conv_id, turn, list(id ORDER BY t) FILTER (WHERE type = 'Rule') AS rules, list(id ORDER BY
    t) FILTER (WHERE type = 'Decision') AS decisions FROM (SELECT a.session_id, a.conv_id, a.turn, b.id, b.type, b.turn AS t FROM nodes a JOIN
    nodes b ON a.session_id = b.session_id AND b.turn BETWEEN a.turn - 2 AND a.turn) GROUP BY 1, 2, 3)"""


def checkpoints(spark, d):
    """A checkpoint at every turn: ids of the last three turns by slot."""
    n = C.nodes(spark, d).select("session_id", "id", "type", "turn", "label")
    a, b = n.alias("a"), n.alias("b")
    near = a.join(b, (F.col("a.session_id") == F.col("b.session_id")) & F.col("b.turn").between(F.col("a.turn") - 2, F.col("a.turn")))
    rows = near.select(F.col("a.session_id").alias("session_id"), F.col("a.turn").alias("turn"), F.col("b.id").alias("id"), F.col("b.type").alias("type"), F.col("b.turn").alias("t"))
    slot = lambda kind, name: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("t", "id")))), lambda x: x["id"]).alias(name)
    return rows.groupBy("session_id", "turn").agg(slot("Rule", "rules"), slot("Constraint", "constraints"), slot("Decision", "decisions"), slot("State", "states"), slot("Risk", "risks"), F.max(F.when(F.col("type") == "Goal", F.col("id"))).alias("goal"))


@query("ref_op255_checkpoints", with_(NODES, CHECKPOINTS) + "SELECT session_id, turn, coalesce(array_to_string(rules, ','), '') AS rules, coalesce(array_to_string(decisions, ','), '') AS decisions FROM points")
def checkpoint_rows(spark, d):
    return checkpoints(spark, d).select("session_id", "turn", F.array_join("rules", ",").alias("rules"), F.array_join("decisions", ",").alias("decisions"))


@query(
    "ref_op256_deltas",
    with_(NODES)
    + """, p AS (SELECT a.session_id, a.turn, coalesce(list(b.id) FILTER (WHERE b.type = 'Rule'), []) AS rules, coalesce(list(b.id)
    FILTER (WHERE b.type = 'Constraint'), []) AS constraints, coalesce(list(b.id) FILTER (WHERE b.type = 'Decision'), []) AS decisions, coalesce(list(b.id)
    FILTER (WHERE b.type = 'State'), []) AS states, coalesce(list(b.id) FILTER (WHERE b.type = 'Risk'), []) AS risks, max(b.id) FILTER (WHERE
    b.type = 'Goal') AS goal FROM nodes a JOIN nodes b ON a.session_id = b.session_id AND b.turn BETWEEN a.turn - 2 AND a.turn GROUP BY 1, 2),"""
    + """ q AS (SELECT *, coalesce(lag(rules) OVER w, []) AS r0, coalesce(lag(constraints) OVER w, []) AS c0, coalesce(lag(decisions)
    OVER w, []) AS d0, coalesce(lag(states) OVER w, []) AS s0, coalesce(lag(risks) OVER w, []) AS k0, lag(goal) OVER w AS g0 FROM p WINDOW w
    AS (PARTITION BY session_id ORDER BY turn))"""
    + """ SELECT session_id, turn, (12 * len([x FOR x IN rules IF NOT list_contains(r0, x)]) + 12 * len([x FOR x IN constraints IF
    NOT list_contains(c0, x)]) + 16 * len([x FOR x IN decisions IF NOT list_contains(d0, x)]) + 16 * len([x FOR x IN states IF NOT list_contains(s0,
    x)]) + 16 * len([x FOR x IN risks IF NOT list_contains(k0, x)]) + CASE WHEN goal IS DISTINCT FROM g0 THEN 12 ELSE 0 END)::BIGINT AS tokens,"""
    + " (goal IS DISTINCT FROM g0)::INT + (list_sort(rules) <> list_sort(r0))::INT + (list_sort(constraints) <> list_sort(c0))::INT + (list_sort(decisions) <> list_sort(d0))::INT + (list_sort(states) <> list_sort(s0))::INT + (list_sort(risks) <> list_sort(k0))::INT AS kinds FROM q",
)
def delta_rows(spark, d):
    return S.deltas(checkpoints(spark, d)).select("session_id", "turn", F.col("tokens").cast("long").alias("tokens"), F.size("kinds").alias("kinds"))


@query(
    "ref_op086_tool_pairs",
    "WITH m AS (SELECT 's' || user_id AS session_id, event_id, event_type, value FROM events), c AS (SELECT session_id, 'k' || (event_id % 97) AS call_id, min(event_id) AS call_turn FROM m WHERE event_type = 'click' GROUP BY 1, 2), r AS (SELECT session_id, 'k' || ((event_id + 1) % 97) AS call_id, min(event_id) AS result_turn FROM m WHERE event_type = 'error' GROUP BY 1, 2),"
    " f AS (SELECT coalesce(c.session_id, r.session_id) AS session_id, call_turn, result_turn FROM c FULL JOIN r ON c.session_id = r.session_id AND c.call_id = r.call_id), u AS (SELECT session_id, call_turn, row_number() OVER (PARTITION BY session_id ORDER BY call_turn) AS k FROM f WHERE result_turn IS NULL), v AS (SELECT session_id, result_turn, row_number() OVER (PARTITION BY session_id ORDER BY result_turn) AS k FROM f WHERE call_turn IS NULL)"
    " SELECT session_id, call_turn, result_turn FROM f WHERE call_turn IS NOT NULL AND result_turn IS NOT NULL UNION ALL SELECT coalesce(u.session_id, v.session_id), call_turn, result_turn FROM u FULL JOIN v ON u.session_id = v.session_id AND u.k = v.k",
)
def tool_pairs(spark, d):
    e = C.read(spark, d, "events").withColumn("session_id", F.concat(F.lit("s"), "user_id"))
    calls = e.where("event_type = 'click'").groupBy("session_id", F.concat(F.lit("k"), F.col("event_id") % 97).alias("call_id")).agg(F.min("event_id").alias("call_turn"))
    results = e.where("event_type = 'error'").groupBy("session_id", F.concat(F.lit("k"), (F.col("event_id") + 1) % 97).alias("call_id")).agg(F.min("event_id").alias("result_turn"))
    return S.paired(calls, results)


@query("ref_op131_set_difference", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def set_difference(spark, d):
    o = C.read(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'F'").join(o.where("o_orderstatus = 'O'").select("o_custkey").distinct(), "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("ref_op132_set_equality", with_(NODES) + """SELECT session_id, list_sort(list_distinct(list(type) FILTER (WHERE turn % 2 = 0))) = list_sort(list_distinct(coalesce(list(type)
    FILTER (WHERE turn % 2 = 1), []))) AS same FROM nodes GROUP BY 1""")
def set_equality(spark, d):
    side = lambda k: F.collect_list(F.when(F.col("turn") % 2 == k, F.col("type")))
    return C.nodes(spark, d).groupBy("session_id").agg(S.same_ids(side(0), side(1)).alias("same"))
