"""Queries of whole bundles: relation passes, budgets, text, contracts, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import bundles as B
from loomgraph.operators import compiling as K
from loomgraph.operators import selection as S
from loomgraph.operators import sessions as SS
from loomgraph.queries import bundles as Q
from loomgraph.queries.compile import CANDIDATES
from loomgraph.queries.model_sql import EDGES, NODES, NORM, RECORDS, REQUESTS, terms, with_
from loomgraph.queries.registry import query
from loomgraph.queries.sessions import BLOCKS
from loomgraph.sources import corpus as C


def _ranked(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, slot ORDER BY (type = 'Process')::INT, precedence
    DESC, round(score + bonus, 6) DESC, label, id) AS rank FROM {rows}) WHERE rank <= CASE WHEN slot IN ('goal', 'intent', 'process') THEN 1
    WHEN slot = 'rules' THEN 8 WHEN slot IN ('constraints', 'evidence') THEN 6 ELSE 4 END)"""


def _with_bonus(name: str, rows: str, hints: str, types: str) -> str:
    return f"""{name} AS (SELECT r.* REPLACE (r.bonus + CASE WHEN type IN ({types}) THEN coalesce(h.b, 0) ELSE 0 END AS bonus) FROM {rows}
    r LEFT JOIN (SELECT request_id, id, sum(bonus) AS b FROM ({hints}) GROUP BY 1, 2) h USING (request_id, id))"""


_PRIORITY = "CASE e.type WHEN 'supported_by' THEN 2.5 WHEN 'requires' THEN 1.75 WHEN 'next_step' THEN 1.5 ELSE 1.25 END"
_BONUS = "CASE s.slot WHEN 'rules' THEN 2.25 WHEN 'constraints' THEN 2.0 WHEN 'risks' THEN 2.5 WHEN 'process' THEN 1.75 WHEN 'decisions' THEN 1.25 ELSE 1.0 END"
STEPS = """steps AS (SELECT from_id AS at_, to_id AS to_, type, confidence AS ec FROM edges WHERE type IN ('supported_by', 'requires',
    'next_step', 'overrides') AND from_id <> to_id UNION ALL SELECT to_id, from_id, type, confidence FROM edges WHERE type IN ('supported_by',
    'requires', 'next_step', 'overrides') AND from_id <> to_id)"""


def _hop(ranked: str, slots: str, kinds: str, end: str = "e.to_") -> str:
    return f"""SELECT s.request_id, {end} AS id, max({_BONUS} + {_PRIORITY}) AS bonus FROM {ranked} s JOIN steps e ON e.at_ = s.id WHERE
    s.slot IN ({slots}) AND e.type IN ({kinds}) GROUP BY s.request_id, s.id, e.to_, e.type"""


_ALL = "'rules', 'constraints', 'process', 'risks', 'decisions', 'states'"
_TWO = f"""SELECT s.request_id, e2.to_ AS id, max({_BONUS} + {_PRIORITY} + ({_BONUS} + 2.5) * 0.75 + (e.ec + e2.ec) / 2 * 0.9 + (m.confidence
    + n.confidence) / 2 * 0.75) AS bonus FROM f4 s JOIN steps e ON e.at_ = s.id JOIN nodes m ON m.id = e.to_ AND m.type IN ('Rule', 'Constraint',
    'Mode', 'Process', 'Step', 'Risk', 'Decision', 'State', 'Outcome', 'Tool') JOIN steps e2 ON e2.at_ = e.to_ AND e2.type = 'supported_by' AND
    e2.to_ <> s.id AND e2.to_ <> e.to_ JOIN nodes n ON n.id = e2.to_ WHERE s.slot IN ({_ALL}) GROUP BY s.request_id, s.id, e2.to_, e.type"""
PASSES = ",\n".join((
    STEPS,
    """r0 AS (SELECT *, 0.0::DOUBLE AS bonus FROM (SELECT *, count(*) FILTER (WHERE origin_kind = 'raw') OVER (PARTITION BY request_id,
    type) AS raws, CASE type WHEN 'Goal' THEN 'goal' WHEN 'Intent' THEN 'intent' WHEN 'Step' THEN 'process' WHEN 'Process' THEN 'process' WHEN
    'Rule' THEN 'rules' WHEN 'Constraint' THEN 'constraints' WHEN 'Mode' THEN 'constraints' WHEN 'Risk' THEN 'risks' WHEN 'Decision' THEN 'decisions'
    WHEN 'State' THEN 'states' WHEN 'Outcome' THEN 'states' WHEN 'Evidence' THEN 'evidence' WHEN 'Tool' THEN 'evidence' WHEN 'Skill' THEN 'skills'
    END AS slot FROM candidates) WHERE (raws = 0 OR origin_kind = 'raw') AND slot IS NOT NULL)""",
    _ranked("f1", "r0"), _with_bonus("r1", "r0", _hop("f1", "'process'", "'next_step'"), "'Step', 'Process'"),
    _ranked("f2", "r1"), _with_bonus("r2", "r1", _hop("f2", "'process'", "'requires'"), "'Rule', 'Constraint', 'Mode'"),
    _ranked("f3", "r2"), _with_bonus("r3", "r2", _hop("f3", "'rules', 'constraints'", "'overrides'", "s.id"), "'Rule', 'Constraint', 'Mode'"),
    _ranked("f4", "r3"), _with_bonus("r4", "r3", _hop("f4", _ALL, "'supported_by', 'requires', 'next_step', 'overrides'") + " UNION ALL " + _TWO, "'Evidence'"),
    _ranked("best", "r4"),
))
MODEL = with_(Q.SPOKEN, EDGES, REQUESTS, CANDIDATES, PASSES)


def _passes(spark, d):
    return K.retrieved_passes(C.requests(spark, d), Q.nodes(spark, d), C.edges(spark, d))


@query("ref_op241_relation_passes", MODEL + " SELECT request_id, id, slot, round(bonus, 6)::DOUBLE AS bonus FROM r4 WHERE bonus > 0")
def relation_passes(spark, d):
    return _passes(spark, d).where("bonus > 0").select("request_id", "id", "slot", F.round("bonus", 6).alias("bonus"))


@query("ref_op240_bundle_slots", MODEL + " SELECT request_id, slot, id, rank FROM best")
def bundle_slots(spark, d):
    return K.ranked(_passes(spark, d)).select("request_id", "slot", "id", F.col("rank").cast("long").alias("rank"))


@query("ref_op240_compile_context")
def compile_context(spark, d):
    return K.compiled(C.requests(spark, d), Q.nodes(spark, d), C.edges(spark, d))


@query("ref_op113_category_diagnostics", MODEL + """, n AS (SELECT request_id, slot, count(*) AS input FROM best WHERE slot NOT IN ('goal', 'intent', 'process') GROUP BY 1,
    2) SELECT n.request_id, n.slot AS category, input, floor(round(greatest(r.token_budget - coalesce(f.spent, 0), 0) * CASE n.slot WHEN 'rules'
    THEN 0.2 WHEN 'constraints' THEN 0.16 WHEN 'risks' THEN 0.14 WHEN 'decisions' THEN 0.12 WHEN 'states' THEN 0.14 WHEN 'evidence' THEN 0.16
    ELSE 0.08 END, 6))::BIGINT AS pool FROM n JOIN requests r USING (request_id) LEFT JOIN (SELECT b.request_id, coalesce(sum(cost) FILTER (WHERE
    slot <> 'process'), 0) + CASE WHEN coalesce(sum(cost) FILTER (WHERE slot <> 'process'), 0) + coalesce(sum(cost) FILTER (WHERE slot = 'process'),
    0) <= any_value(token_budget) THEN coalesce(sum(cost) FILTER (WHERE slot = 'process'), 0) ELSE 0 END AS spent FROM best b WHERE slot IN ('goal',
    'intent', 'process') GROUP BY 1) f USING (request_id)""")
def category_diagnostics(spark, d):
    best, share = K.ranked(_passes(spark, d)), {k: v[0] for k, v in K.X.CATEGORIES.items()}
    n = best.where(~F.col("slot").isin("goal", "intent", "process")).groupBy("request_id", "token_budget", F.col("slot").alias("category")).agg(F.count("*").alias("input"))
    spent = lambda *s: F.coalesce(F.sum(F.when(F.col("slot").isin(*s), F.col("cost"))), F.lit(0))
    fixed = best.groupBy("request_id", "token_budget").agg(spent("goal", "intent").alias("always"), spent("process").alias("process"))
    fixed = fixed.select("request_id", (F.col("always") + F.when(F.col("always") + F.col("process") <= F.col("token_budget"), F.col("process")).otherwise(0)).alias("spent"))
    room = F.greatest(F.col("token_budget") - F.coalesce("spent", F.lit(0)), F.lit(0))
    return n.join(fixed, "request_id", "left").select("request_id", "category", "input", F.floor(F.round(room * K.X.lookup(F.col("category"), share), 6)).cast("long").alias("pool"))


_WHAT = """CASE slot WHEN 'goal' THEN 'current goal match' WHEN 'intent' THEN 'current intent match' WHEN 'process' THEN 'current process step'
    WHEN 'rules' THEN 'active rule' WHEN 'constraints' THEN 'active constraint' WHEN 'risks' THEN 'open risk' WHEN 'decisions' THEN 'recent decision'
    WHEN 'states' THEN 'recent state' WHEN 'evidence' THEN 'supporting evidence' ELSE 'candidate skill' END"""


@query("ref_op070_selection_reasons", MODEL + f""" SELECT request_id, id, {_WHAT} || ' via ' || CASE WHEN direct OR bonus = 0 THEN CASE WHEN bonus > 0 THEN 'direct_text, relation_graph'
    ELSE 'direct_text' END ELSE 'relation_graph' END || CASE WHEN scope = 'session' THEN '' ELSE '; scope=' || scope END AS reason FROM best""")
def selection_reasons(spark, d):
    kinds = B.recall_kinds(F.col("direct"), F.col("bonus") > 0, F.lit(False))
    return K.ranked(_passes(spark, d)).select("request_id", "id", K.reason(F.col("slot"), kinds, F.col("scope")).alias("reason"))


_LINE = "(SELECT '{1}: ' || string_agg(label, ' | ' ORDER BY rank) FROM best b WHERE b.request_id = r.request_id AND slot = '{0}' HAVING count(*) > 0)"
_TITLES = (("goal", "Goal"), ("intent", "Intent"), ("rules", "Active rules"), ("constraints", "Constraints"), ("process", "Current step"), ("decisions", "Recent decisions"), ("states", "State changes"), ("evidence", "Evidence"), ("skills", "Skills"), ("risks", "Open risks"))


@query("ref_op075_bundle_text", MODEL + f""" SELECT r.request_id, sha256(array_to_string([x FOR x IN ['[Context]', {', '.join(_LINE.format(*t) for t in _TITLES)}, 'Budget used: '
    || (SELECT sum(cost) FROM best b WHERE b.request_id = r.request_id) || '/' || r.token_budget] IF x IS NOT NULL], chr(10))) AS text_sha FROM
    requests r WHERE r.request_id IN (SELECT request_id FROM best)""")
def bundle_text(spark, d):
    best = K.ranked(_passes(spark, d))
    used = best.groupBy("request_id").agg(F.sum("cost").alias("used"), F.max("token_budget").alias("total"))
    return K.rendered(best, used).select("request_id", F.sha2("text", 256).alias("text_sha"))


@query("ref_op071_bundle_contract", MODEL + """ SELECT request_id, count(DISTINCT slot) FILTER (WHERE slot IN ('goal', 'intent', 'process')) AS fixed, count(DISTINCT slot)
    FILTER (WHERE slot NOT IN ('goal', 'intent', 'process')) AS categories, count(*) AS items FROM best GROUP BY 1""")
def bundle_contract(spark, d):
    return K.contract(K.ranked(_passes(spark, d)))


@query("ref_op123_scope_reuse", MODEL + """, x AS (SELECT r.request_id, n.id, n.scope FROM requests r JOIN nodes n ON n.session_id = r.session_id AND n.scope <> 'session'
    AND n.type IN ('Rule', 'Decision', 'Constraint')) SELECT request_id, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE has)::DOUBLE
    / count(*), 6) END::DOUBLE AS benefit, count(*) FILTER (WHERE has AND scope = 'workspace') AS workspace, count(*) FILTER (WHERE has AND scope
    = 'global') AS global_ FROM (SELECT x.*, EXISTS (SELECT 1 FROM best b WHERE b.request_id = x.request_id AND b.id = x.id) AS has FROM x) GROUP
    BY 1""")
def scope_reuse(spark, d):
    n = Q.nodes(spark, d).where("scope <> 'session'").where(F.col("type").isin("Rule", "Decision", "Constraint")).select("session_id", "id", "scope")
    x = C.requests(spark, d).select("request_id", "session_id").join(n, "session_id")
    have = K.ranked(_passes(spark, d)).select("request_id", "id", F.lit(True).alias("has"))
    rows = x.join(have, ["request_id", "id"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return rows.groupBy("request_id").agg(B.coverage(F.count_if("has"), F.count("*")).alias("benefit"), F.count_if(F.col("has") & (F.col("scope") == "workspace")).alias("workspace"), F.count_if(F.col("has") & (F.col("scope") == "global")).alias("global_"))


@query("ref_op122_retrieval_cost", MODEL + """ SELECT b.request_id, count(DISTINCT b.slot) AS source_slots, count(e.to_) AS scanned, count(e.to_) FILTER (WHERE e.type
    = 'supported_by') AS supporting FROM best b LEFT JOIN steps e ON e.at_ = b.id GROUP BY 1""")
def retrieval_cost(spark, d):
    best = K.ranked(_passes(spark, d)).select("request_id", "slot", "id")
    steps = K.G.both_ways(C.edges(spark, d)).select(F.col("at").alias("id"), "to", "type")
    return best.join(steps, "id", "left").groupBy("request_id").agg(F.countDistinct("slot").alias("source_slots"), F.count("to").alias("scanned"), F.count_if(F.col("type") == "supported_by").alias("supporting"))


@query("ref_op076_query_matches", with_(Q.SPOKEN, REQUESTS) + f""", m AS (SELECT *, [t FOR t IN ts IF contains(l, t)] AS ml, [t FOR t IN ts IF contains(p, t)] AS mp FROM (SELECT request_id, id, q, l, p, {terms('q')}
    AS ts FROM (SELECT r.request_id, n.id, {NORM.format('r.query')} AS q, {NORM.format('n.label')} AS l, {NORM.format('n.payload')} AS p FROM
    requests r JOIN nodes n ON n.session_id = r.session_id)))
  SELECT request_id, id, CASE WHEN len(ml) > 0 AND len(ml) >= len(mp) THEN 'label' WHEN len(mp) > 0 THEN 'payload' ELSE 'none' END AS best_field,
    len(list_distinct(ml || mp))::INTEGER AS matched, CASE WHEN len(ts) = 0 THEN 0 ELSE round(len(list_distinct(ml || mp))::DOUBLE / len(ts),
    3) END::DOUBLE AS coverage FROM m""")
def query_matches(spark, d):
    r = C.requests(spark, d).select("request_id", "session_id", T.normalized(F.col("query")).alias("q")).withColumn("ts", T.terms(F.col("q")))
    n = Q.nodes(spark, d).select("session_id", "id", T.normalized(F.col("label")).alias("l"), T.normalized(F.col("payload")).alias("p"))
    hit = lambda c: F.filter("ts", lambda t: F.contains(F.col(c), t))
    rows = r.join(n, "session_id").withColumns({"ml": hit("l"), "mp": hit("p")})
    both = F.size(F.array_union("ml", "mp"))
    best = F.when((F.size("ml") > 0) & (F.size("ml") >= F.size("mp")), "label").when(F.size("mp") > 0, "payload").otherwise("none")
    return rows.select("request_id", "id", best.alias("best_field"), both.alias("matched"), F.when(F.size("ts") == 0, 0.0).otherwise(F.round(both / F.size("ts"), 3)).alias("coverage"))


@query("ref_op318_query_and_explain", MODEL + """ SELECT request_id, id, place, total > 3 AS truncated FROM (SELECT request_id, id, row_number() OVER (PARTITION BY request_id
    ORDER BY precedence DESC, score DESC, label, id) AS place, count(*) OVER (PARTITION BY request_id) AS total FROM candidates WHERE direct)
    WHERE place <= 3""")
def query_and_explain(spark, d):
    from pyspark.sql import Window

    rows = S.ranked(Q.candidates(spark, d).where("direct"), "request_id").withColumn("total", F.count("*").over(Window.partitionBy("request_id")))
    return rows.where("rank <= 3").select("request_id", "id", F.col("rank").cast("long").alias("place"), (F.col("total") > 3).alias("truncated"))


@query("ref_op133_layer_overlap", with_(RECORDS, BLOCKS) + """, g AS (SELECT session_id, turn, block <= 1 AS a, block > 1 AND block <= top - 2 + (session_id IN ('s1', 's4'))::INT AS b,
    block > 1 AND block > top - 2 AS c FROM (SELECT *, max(block) OVER (PARTITION BY session_id) AS top FROM blocks)) SELECT session_id, bool_or(a::INT
    + b::INT + c::INT > 1) AS overlap FROM g GROUP BY 1""")
def layer_overlap(spark, d):
    from pyspark.sql import Window

    m = SS.turns(C.records(spark, d)).withColumn("top", F.max("block").over(Window.partitionBy("session_id")))
    late = F.col("top") - 2 + F.col("session_id").isin("s1", "s4").cast("int")  # two sessions whose layers do overlap
    layer = lambda c: F.collect_set(F.when(c, F.col("id")))
    g = m.groupBy("session_id").agg(layer(F.col("block") <= 1).alias("a"), layer((F.col("block") > 1) & (F.col("block") <= late)).alias("b"), layer((F.col("block") > 1) & (F.col("block") > F.col("top") - 2)).alias("c"))
    return g.select("session_id", (F.arrays_overlap("a", "b") | F.arrays_overlap("a", "c") | F.arrays_overlap("b", "c")).alias("overlap"))


_BASE = """baseline AS (SELECT session_id, string_agg(role || ': ' || left(content, 20), chr(10) ORDER BY turn) AS summary, max(turn)
    AS last_turn, count(*) AS n FROM (SELECT *, max(block) OVER (PARTITION BY session_id) AS top FROM blocks) WHERE block <= top - 2 GROUP BY
    1)"""


def _baseline(spark, d):
    from pyspark.sql import Window

    m = SS.turns(C.records(spark, d)).withColumn("top", F.max("block").over(Window.partitionBy("session_id"))).where(F.col("block") <= F.col("top") - 2)
    line = F.struct("turn", F.concat("role", F.lit(": "), F.substring("content", 1, 20)).alias("line"))
    return m.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("summary"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("ref_op267_baseline_append", with_(RECORDS, BLOCKS, _BASE) + """SELECT session_id, CASE WHEN session_id IN ('s1', 's3', 's5') THEN 1 ELSE 2 END AS version, sha256(session_id || '|baseline|'
    || CASE WHEN session_id IN ('s1', 's3', 's5') THEN 1 ELSE 2 END || '|' || last_turn || '|' || summary) AS baseline_id FROM baseline""")
def baseline_append(spark, d):
    b = _baseline(spark, d)
    before = b.select("session_id", F.when(F.col("session_id").isin("s1", "s3", "s5"), F.col("summary")).otherwise("another").alias("old"), F.lit(1).alias("version"))
    return SS.appended_baselines(b, before)


@query("ref_op269_state_ids", with_(RECORDS, BLOCKS, _BASE) + """SELECT session_id, sha256(session_id || '|compression_state|' || CASE WHEN n > 3 THEN 'full' ELSE 'incremental' END || '|'
    || sha256(summary) || '|' || last_turn) AS state_id, n <= 3 AS same FROM baseline""")
def state_ids(spark, d):
    b = _baseline(spark, d).withColumn("mode", F.when(F.col("n") > 3, "full").otherwise("incremental"))
    return SS.state_ids(b, b.withColumn("mode", F.lit("incremental")))


@query("ref_op201_code_summaries", """SELECT doc_id, coalesce(nullif(left(array_to_string([x FOR x IN [trim(regexp_replace(y, '^#+', '')) FOR y IN string_split(coalesce(text,
    ''), chr(10))] IF x <> ''][1:3], ' | '), 240), ''), 'empty') AS summary FROM documents""")
def code_summaries(spark, d):
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, "^#+", ""))), lambda s: s != "")
    text = F.substring(F.array_join(F.slice(lines, 1, 3), " | "), 1, 240)
    return C.read(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(text, F.lit("")), F.lit("empty")).alias("summary"))
