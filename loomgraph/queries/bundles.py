"""Queries of what follows from bundles: admissions, experience, skills, quality, recall and explanations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.functions import text as T
from loomgraph.operators import bundles as B
from loomgraph.operators import graph as G
from loomgraph.operators import retrieval as R
from loomgraph.operators import selection as S
from loomgraph.queries.compile import CANDIDATES, PROMOTED
from loomgraph.queries.graph import PAIRS, STANDING, sided
from loomgraph.queries.model_sql import CORRECTIONS, EDGES, NODES, NORM, REQUESTS, terms, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C
from loomgraph.sources.transcripts import written

#: nodes whose labels speak of failures and risks, too
SPOKEN = NODES.replace("nodes AS (", "plain_nodes AS (", 1) + ",\nnodes AS (SELECT * REPLACE (label || (['; error seen', '; open risk', '', '', ''])[((conv_id + turn) % 5 + 1)::INTEGER] AS label) FROM plain_nodes)"
SLOTTED = """slotted AS (SELECT *, row_number() OVER (PARTITION BY request_id, slot ORDER BY precedence DESC, score DESC, label, id) AS rank, CASE WHEN slot
    IN ('goal', 'intent', 'process') THEN 1 WHEN slot = 'rules' THEN 8 WHEN slot IN ('constraints', 'evidence') THEN 6 ELSE 4 END AS most FROM
    (SELECT *, CASE type WHEN 'Goal' THEN 'goal' WHEN 'Intent' THEN 'intent' WHEN 'Step' THEN 'process' WHEN 'Process' THEN 'process' WHEN 'Rule'
    THEN 'rules'
  WHEN 'Constraint' THEN 'constraints' WHEN 'Risk' THEN 'risks' WHEN 'Decision' THEN 'decisions' WHEN 'State' THEN 'states' WHEN 'Evidence' THEN
    'evidence' WHEN 'Skill' THEN 'skills' END AS slot FROM candidates) WHERE slot IS NOT NULL),
items AS (SELECT * FROM slotted WHERE rank <= most)"""
MODEL = with_(SPOKEN, REQUESTS, CANDIDATES, SLOTTED)
SIGNALS = """signals AS (SELECT DISTINCT request_id, id, CASE slot WHEN 'risks' THEN 'risk' WHEN 'states' THEN 'state' ELSE 'decision' END AS signal FROM
    items WHERE slot = 'risks' OR (slot IN ('states', 'decisions') AND regexp_matches(lower(label), '\\b(?:fail|failure|blocked|timeout|error|exception|rollback|conflict)\\b|失败|阻塞|超时|错误|异常|回滚|冲突'))),
tried AS (SELECT *, CASE WHEN process IS NOT NULL THEN CASE WHEN failures = 0 THEN 'success' ELSE 'partial' END WHEN failures > 0 THEN 'failure'
    ELSE 'running' END AS status FROM (SELECT i.request_id, max(id) FILTER (WHERE slot = 'process') AS process, max(id) FILTER (WHERE slot =
    'goal') AS goal, count(*) FILTER (WHERE slot = 'risks') AS risks, count(*) FILTER (WHERE slot = 'states') AS states,
  count(*) FILTER (WHERE slot = 'rules') AS rules, count(*) FILTER (WHERE slot = 'constraints') AS constraints, (SELECT count(*) FROM signals
    s WHERE s.request_id = i.request_id) AS failures FROM items i GROUP BY 1))"""


def nodes(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("; error seen", "; open risk", "", "", ""))), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return C.nodes(spark, d).withColumn("label", F.concat("label", said))


def candidates(spark, d):
    return S.candidates(C.requests(spark, d), nodes(spark, d))


def slotted(spark, d):
    return _slotted(candidates(spark, d))


def _with_slot(rows):
    return rows.withColumn("slot", X.lookup(F.col("type"), X.CATEGORY_OF | X.SLOTS, "string")).where("slot is not null")


def _slotted(rows):
    return S.ranked(_with_slot(rows), "request_id", "slot").withColumn("most", F.coalesce(X.lookup(F.col("slot"), {k: v[1] for k, v in X.CATEGORIES.items()}, "int"), F.lit(1)))


def _selected(rows):
    return _slotted(rows).where("rank <= 8").where("rank <= most")


def items(spark, d):
    return _selected(R.recalled(C.requests(spark, d), nodes(spark, d)))


@query("ref_op134_open_risks", MODEL + """, o AS (SELECT request_id, id, min({'f': f, 'r': rank}) AS o FROM (SELECT *, CASE WHEN slot = 'risks' THEN 0 WHEN slot =
    'constraints' THEN 1 ELSE 2 END AS f FROM items WHERE slot = 'risks' OR (slot IN ('constraints', 'states') AND regexp_matches(lower(label),
    'risk|block|conflict|constraint|forbid|warning'))) GROUP BY 1, 2) SELECT request_id, id, place, inferred FROM (SELECT request_id, id, row_number()
    OVER (PARTITION BY request_id ORDER BY o.f, o.r, id) AS place, o.f > 0 AS inferred FROM o) WHERE place <= 4""")
def open_risks(spark, d):
    return B.open_risks(items(spark, d)).withColumn("place", F.col("place").cast("long"))


TOPIC = "topics AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY precedence DESC, score DESC, label, id) AS rank FROM candidates WHERE type = 'Topic')"


@query(
    "ref_op175_topic_admission",
    MODEL + ", " + TOPIC + """, f AS (SELECT request_id, count(*) FILTER (WHERE slot = 'evidence') >= 4 AND count(*) FILTER (WHERE slot = 'skills') >=
    2 AS full_ FROM items GROUP BY 1), h AS (SELECT t.*, confidence >= 0.7 AND NOT coalesce(full_, FALSE) AS may FROM topics t LEFT JOIN f USING
    (request_id) WHERE rank <= 4) SELECT request_id, id, coalesce(rank = min(rank) FILTER (WHERE may) OVER (PARTITION BY request_id), FALSE)
    AS admitted FROM h""",
)
def topic_admission(spark, d):
    return B.topic_admissions(items(spark, d), S.ranked(candidates(spark, d).where("type = 'Topic'"), "request_id"))


@query("ref_op051_failure_labels", with_(SPOKEN) + "SELECT id FROM nodes WHERE regexp_matches(lower(label), '\\b(?:fail|failure|blocked|timeout|error|exception|rollback|conflict)\\b|失败|阻塞|超时|错误|异常|回滚|冲突')")
def failure_labels(spark, d):
    return nodes(spark, d).where(F.lower("label").rlike(B.FAILED)).select("id")


@query("ref_op243_failure_signals", MODEL + ", " + SIGNALS + """ SELECT request_id, id, signal, CASE signal WHEN 'risk' THEN 'high' ELSE 'medium' END AS severity, 'failure-signal:' || left(sha256(id
    || '|' || signal), 16) AS signal_id FROM signals""")
def failure_signals(spark, d):
    return B.failure_signals(items(spark, d))


@query(
    "ref_op243_attempts",
    MODEL + ", " + SIGNALS + """ SELECT request_id, status, CASE status WHEN 'success' THEN 'resolved' WHEN 'failure' THEN 'abandoned' ELSE 'open' END AS
    episode, failures, ((process IS NOT NULL)::INT + (goal IS NOT NULL)::INT + CASE WHEN process IS NOT NULL AND risks = 0 THEN 2 ELSE 0 END
    + (failures = 0 AND states > 0)::INT)::INTEGER AS successes FROM tried""",
)
def attempts(spark, d):
    return B.attempts(items(spark, d)).select("request_id", "status", "episode", "failures", "successes")


@query(
    "ref_op244_procedures",
    MODEL + ", " + SIGNALS + """ SELECT request_id, process AS step_id, CASE WHEN failures = 0 THEN 'validated' ELSE 'candidate' END AS procedure, round(greatest(0,
    least(1, 0.55 + CASE WHEN rules > 0 THEN 0.15 ELSE 0 END + CASE WHEN constraints > 0 THEN 0.1 ELSE 0 END - least(0.3, failures * 0.08))),
    6)::DOUBLE AS confidence FROM tried WHERE process IS NOT NULL""",
)
def procedures(spark, d):
    rows = items(spark, d)
    step = rows.where("slot = 'process'").select("request_id", F.col("id").alias("step_id"))
    return B.attempts(rows).where("procedure is not null").join(step, "request_id").select("request_id", "step_id", "procedure", "confidence")


@query(
    "ref_op245_experience_edges",
    MODEL + ", " + SIGNALS + """, e AS (SELECT i.*, status IN ('success', 'partial') AS learned FROM items i JOIN tried USING (request_id)) SELECT request_id,
    edge, id AS to_id, CASE scope WHEN 'global' THEN 'workspace' ELSE scope END AS scope FROM (SELECT request_id, 'derived_from' AS edge, id,
    scope FROM e UNION ALL SELECT request_id, 'requires', id, scope FROM e WHERE learned AND slot IN ('rules', 'constraints') UNION ALL SELECT
    request_id, 'produces', id, scope FROM e WHERE learned AND slot = 'process')""",
)
def experience_edges(spark, d):
    return B.experience_edges(items(spark, d))


@query(
    "ref_op251_experience_roles",
    MODEL + ", " + SIGNALS + """, r AS (SELECT i.request_id, i.id, i.slot, status IN ('success', 'partial') AS learned, EXISTS (SELECT 1 FROM signals s WHERE s.request_id =
    i.request_id AND s.id = i.id) AS failed FROM items i JOIN tried t USING (request_id)),
  n AS (SELECT request_id, id, slot, [x FOR x IN [CASE WHEN slot = 'process' THEN 'attempt_step' END, CASE WHEN slot = 'process' THEN 'critical_step'
    END, CASE WHEN slot = 'evidence' THEN 'attempt_evidence' END, CASE WHEN failed THEN 'failure_signal_source' END, CASE WHEN slot = 'process'
    AND learned THEN 'procedure_step' END, CASE WHEN slot IN ('rules', 'constraints') AND learned THEN 'procedure_prerequisite' END,
    CASE WHEN failed THEN 'failure_pattern_source' END, CASE WHEN slot = 'process' AND learned THEN 'successful_procedure_step' END, CASE WHEN
    slot IN ('rules', 'constraints') AND learned THEN 'successful_procedure_prerequisite' END] IF x IS NOT NULL] AS roles FROM r)
  SELECT request_id, id, slot, array_to_string(roles, ',') AS roles FROM n WHERE len(roles) > 0""",
)
def experience_roles(spark, d):
    return B.experience_roles(items(spark, d)).withColumn("roles", F.array_join("roles", ","))


SKILL = """s AS (SELECT request_id, max(label) FILTER (WHERE slot = 'process') AS process, count(*) FILTER (WHERE slot = 'evidence') AS evidence, count(*)
    FILTER (WHERE slot = 'rules') AS rules, count(*) FILTER (WHERE slot = 'risks') AS risks, string_agg(id, ',' ORDER BY id) FILTER (WHERE slot
    = 'rules') AS rule_ids, string_agg(id, ',' ORDER BY id) FILTER (WHERE slot = 'constraints') AS constraint_ids FROM items GROUP BY 1)"""


@query(
    "ref_op257_crystallised_skills",
    MODEL + ", " + SKILL + """ SELECT request_id, trim(regexp_replace(process, '(?i)^(workflow|skill|rule):', '')) AS name, least(1.0, evidence / 5.0)::DOUBLE AS frequency,
    CASE WHEN rules > 0 THEN 0.8 ELSE 0.45 END::DOUBLE AS stability, CASE WHEN risks = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS success, 0.85::DOUBLE
    AS clarity,
  'workflow:' || CASE WHEN p = '' THEN 'unspecified' ELSE p END || '|rules:' || coalesce(rule_ids, 'none') || '|constraints:' || coalesce(constraint_ids,
    'none') AS merge_key, CASE WHEN evidence >= 3 AND risks = 0 THEN 'fresh' ELSE 'cooling' END AS decay
  FROM (SELECT *, left(regexp_replace(regexp_replace(lower(process), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 72) AS p FROM s WHERE process IS NOT NULL AND evidence >= 2)""",
)
def crystallised_skills(spark, d):
    return B.crystallised(items(spark, d))


@query("ref_op255_retention", MODEL + "SELECT request_id, CASE WHEN count(*) FILTER (WHERE slot IN ('goal', 'process', 'rules', 'risks')) > 0 THEN 'sticky' ELSE 'rolling' END AS retention FROM items GROUP BY 1")
def retention(spark, d):
    return B.retention(items(spark, d))


_EXPECTED = """expected AS (SELECT r.request_id, n.id, CASE WHEN n.type IN ('Rule', 'Evidence', 'Decision') THEN 'required' ELSE 'forbidden'
    END AS kind FROM requests r JOIN nodes n ON n.session_id = r.session_id WHERE n.type IN ('Rule', 'Evidence', 'Decision', 'Skill', 'State'))"""


def _expected(spark, d):
    r, n = C.requests(spark, d).select("request_id", "session_id"), nodes(spark, d).where(F.col("type").isin("Rule", "Evidence", "Decision", "Skill", "State"))
    return r.join(n, "session_id").select("request_id", "id", F.when(F.col("type").isin("Rule", "Evidence", "Decision"), "required").otherwise("forbidden").alias("kind"))


QUALITY = _EXPECTED + """, x AS (SELECT e.*, EXISTS (SELECT 1 FROM items i WHERE i.request_id = e.request_id AND i.id = e.id) AS has FROM expected
    e), quality AS (SELECT request_id, CASE WHEN count(*) FILTER (WHERE kind = 'required') = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE kind
    = 'required' AND has)::DOUBLE / count(*) FILTER (WHERE kind = 'required'), 6) END::DOUBLE AS coverage, count(*) FILTER (WHERE kind = 'required'
    AND NOT has) AS missing, count(*) FILTER (WHERE kind = 'forbidden' AND has) AS forbidden, CASE WHEN count(*) FILTER (WHERE kind = 'forbidden')
    = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE kind = 'forbidden' AND has)::DOUBLE / count(*) FILTER (WHERE kind = 'forbidden'), 6) END::DOUBLE
    AS intrusion FROM x GROUP BY 1)"""


@query("ref_op118_bundle_quality", MODEL + ", " + QUALITY + " SELECT request_id, coverage, missing, forbidden FROM quality")
def bundle_quality(spark, d):
    return B.quality(items(spark, d), _expected(spark, d)).select("request_id", "coverage", "missing", "forbidden")


@query("ref_op120_memory_usefulness", MODEL + ", " + QUALITY + " SELECT request_id, coverage AS usefulness, intrusion FROM quality")
def memory_usefulness(spark, d):
    return B.quality(items(spark, d), _expected(spark, d)).select("request_id", F.col("coverage").alias("usefulness"), "intrusion")


@query("ref_op124_threshold_failures", MODEL + ", " + QUALITY + """, u AS (UNPIVOT (SELECT request_id, coverage, missing::DOUBLE AS missing, forbidden::DOUBLE AS forbidden, intrusion FROM
    quality) ON coverage, missing, forbidden, intrusion INTO NAME metric VALUE value) SELECT request_id, metric, value FROM u WHERE CASE metric
    WHEN 'coverage' THEN value < 1 ELSE value > 0 END""")
def threshold_failures(spark, d):
    q = B.quality(items(spark, d), _expected(spark, d)).withColumns({"missing": F.col("missing").cast("double"), "forbidden": F.col("forbidden").cast("double")})
    rows = q.unpivot(["request_id"], ["coverage", "missing", "forbidden", "intrusion"], "metric", "value")
    return rows.where(F.when(F.col("metric") == "coverage", F.col("value") < 1).otherwise(F.col("value") > 0))


RELATED = """related AS (SELECT DISTINCT i.request_id, CASE WHEN e.from_id = i.id THEN e.to_id ELSE e.from_id END AS id FROM items i JOIN edges e ON (e.from_id
    = i.id OR e.to_id = i.id) AND e.type IN ('supported_by', 'requires', 'next_step', 'overrides') WHERE i.slot <> 'evidence')"""


def related(spark, d, rows):
    steps = G.both_ways(C.edges(spark, d)).select(F.col("at").alias("id"), "to")
    return rows.where("slot <> 'evidence'").select("request_id", "id").join(steps, "id").select("request_id", F.col("to").alias("id")).distinct()


@query(
    "ref_op119_relation_recall",
    with_(SPOKEN, EDGES, REQUESTS, CANDIDATES, SLOTTED, RELATED) + """, r AS (SELECT request_id, id FROM items JOIN related USING (request_id, id) WHERE slot = 'evidence'), e AS (SELECT r.request_id, n.id FROM requests
    r JOIN nodes n ON n.session_id = r.session_id WHERE n.type = 'Evidence' AND n.freshness = 'active'), a AS (SELECT r.request_id, n.id FROM
    requests r JOIN nodes n ON n.workspace_id = r.workspace_id),
  f AS (SELECT request_id, id, r.id IS NOT NULL AS r, e.id IS NOT NULL AS e, EXISTS (SELECT 1 FROM a WHERE a.request_id = coalesce(r.request_id,
    e.request_id) AND a.id = coalesce(r.id, e.id)) AS a FROM r FULL JOIN e USING (request_id, id))
  SELECT request_id, CASE WHEN count(*) FILTER (WHERE r) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE r AND a)::DOUBLE / count(*) FILTER (WHERE
    r), 6) END::DOUBLE AS precision, CASE WHEN count(*) FILTER (WHERE e) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE r AND e)::DOUBLE / count(*)
    FILTER (WHERE e), 6) END::DOUBLE AS recall, count(*) FILTER (WHERE r AND NOT a) AS noise FROM f GROUP BY 1""",
)
def relation_recall(spark, d):
    rows, r = items(spark, d), C.requests(spark, d)
    recalled = rows.where("slot = 'evidence'").join(related(spark, d, rows), ["request_id", "id"], "left_semi")
    n = nodes(spark, d)
    expected = r.select("request_id", "session_id").join(n.where("type = 'Evidence' and freshness = 'active'").select("session_id", "id"), "session_id")
    allowed = r.select("request_id", "workspace_id").join(n.select("workspace_id", "id"), "workspace_id")
    return B.relation_recall(recalled, expected, allowed)


@query(
    "ref_op242_recall_kinds",
    with_(SPOKEN, EDGES, REQUESTS, CANDIDATES, SLOTTED, RELATED) + """, k AS (SELECT i.request_id, i.slot, i.id, direct, EXISTS (SELECT 1 FROM related r WHERE r.request_id = i.request_id AND
    r.id = i.id) AS rel FROM items i) SELECT request_id, id, array_to_string([x FOR x IN [CASE WHEN direct OR NOT rel THEN 'direct_text' END,
    CASE WHEN rel THEN 'relation_graph' END] IF x IS NOT NULL], ',') AS kinds, CASE WHEN rel THEN 'relation_graph' ELSE 'direct_text' END AS
    primary_kind FROM k""",
)
def recall_kinds(spark, d):
    rows = items(spark, d)
    known = rows.join(related(spark, d, rows).withColumn("rel", F.lit(True)), ["request_id", "id"], "left")
    kinds = B.recall_kinds(F.col("direct"), F.coalesce("rel", F.lit(False)), F.lit(False))
    return known.select("request_id", "id", F.array_join(kinds, ",").alias("kinds"), B.primary_kind(kinds).alias("primary_kind"))


@query(
    "ref_op114_recalled_nodes",
    with_(SPOKEN, EDGES, REQUESTS, CANDIDATES, SLOTTED, RELATED) + """, m AS (SELECT request_id, id, rank <= most AS included, CASE WHEN rank <= most THEN 'selected for ' ELSE 'skipped in ' END
    || slot AS reason, 'direct_text' AS kind FROM slotted UNION ALL SELECT request_id, id, FALSE, 'related to a selection', 'relation_graph'
    FROM related) SELECT request_id, id, bool_or(included) AS included, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons, CASE WHEN
    bool_or(kind = 'relation_graph') THEN 'relation_graph' ELSE 'direct_text' END AS primary_kind FROM m GROUP BY 1, 2""",
)
def recalled_nodes(spark, d):
    r, n = C.requests(spark, d), nodes(spark, d)
    # read twice; the list of all pairs takes no scores and no ranks
    chosen = written(items(spark, d).select("request_id", "id", "slot"))
    return B.recalled_nodes(_with_slot(S.listed(r, n)), chosen, related(spark, d, chosen)).select("request_id", "id", "included", "reasons", "primary_kind")


#: candidates, and nodes of a request's session and workspace that can't be recalled; conflicts as they were decided
_STATUS = PAIRS + """, knowledge AS (SELECT id, scope, confidence, observations, downgrades, promotion_state AS state, type FROM nodes WHERE type = 'Pattern'),
""" + PROMOTED + """, suppressed AS (SELECT target_id AS id FROM standing WHERE target_kind = 'node_suppression'),
beaten AS (SELECT DISTINCT CASE WHEN strong = left_id THEN right_id ELSE left_id END AS id FROM pairs_of WHERE opposite),
near AS (SELECT r.request_id, n.id, n.type, n.scope FROM requests r JOIN nodes n ON n.session_id = r.session_id WHERE n.scope = 'session' AND (n.type = 'Pattern' OR n.freshness = 'superseded')
  UNION ALL SELECT r.request_id, n.id, n.type, n.scope FROM requests r JOIN nodes n ON n.workspace_id = r.workspace_id WHERE n.scope = 'workspace' AND (n.type = 'Pattern' OR n.freshness = 'superseded')),
every AS (SELECT c.request_id, c.id, c.type, s.slot, coalesce(s.rank, t.rank) AS rank, s.most, TRUE AS admitted FROM candidates c LEFT JOIN slotted s ON s.request_id = c.request_id AND s.id = c.id LEFT JOIN topics t ON t.request_id = c.request_id AND t.id = c.id
  UNION ALL SELECT x.request_id, x.id, x.type, NULL, NULL, NULL, x.scope = 'session' OR coalesce(p.workspace_eligible, TRUE) FROM near x LEFT JOIN promoted p ON p.id = x.id),
considered AS (SELECT e.*, g.id IS NOT NULL AS gone, b.id IS NOT NULL AS conflicted FROM every e LEFT JOIN suppressed g ON g.id = e.id LEFT JOIN beaten b ON b.id = e.id)"""
_STATUS = _STATUS.replace("pairs AS (SELECT a.id", "pairs_of AS (SELECT a.id")
SCORED = CANDIDATES.replace("candidates AS (SELECT", "candidates AS MATERIALIZED (SELECT")


@query(
    "ref_op316_selection_status",
    with_(SPOKEN, REQUESTS, CORRECTIONS, STANDING, SCORED, SLOTTED, TOPIC, _STATUS) + """SELECT request_id, id, st AS status, st IN ('fixed', 'category') AS included FROM (SELECT *, CASE WHEN gone THEN 'suppressed'
    WHEN slot IN ('goal', 'intent', 'process') AND rank <= most THEN 'fixed' WHEN slot IS NOT NULL AND rank <= most THEN 'category' WHEN slot
    IN ('goal', 'intent', 'process') THEN 'fixed_skipped' WHEN slot IS NOT NULL THEN 'category_skipped' WHEN type = 'Topic' AND rank <= 4 THEN
    'topic_hint' WHEN conflicted THEN 'conflict' WHEN NOT admitted THEN 'scope' ELSE 'not_selected' END AS st FROM considered)""",
)
def selection_status(spark, d):
    c, n = candidates(spark, d), nodes(spark, d)
    s = slotted(spark, d).select("request_id", "id", "slot", "rank", "most")
    t = S.ranked(c.where("type = 'Topic'"), "request_id").select("request_id", "id", F.col("rank").alias("topic_rank"))
    known = c.select("request_id", "id", "type", F.lit(True).alias("admitted")).join(s, ["request_id", "id"], "left").join(t, ["request_id", "id"], "left")
    beyond = n.where((F.col("freshness") == "superseded") | ~S.eligible(F.col("type"))).withColumn("admitted", S.admitted())
    near = S.near(S.asked(C.requests(spark, d)), beyond).select("request_id", "id", "type", "admitted")
    gone = G.resolved(C.corrections(spark, d), "node_suppression").select(F.col("target_id").alias("id"), F.lit(True).alias("suppressed"))
    beaten = G.conflict_standing(sided(spark, d)).where("suppressed").select("id", F.lit(True).alias("conflicted"))
    rows = known.unionByName(near, allowMissingColumns=True).join(gone, "id", "left").join(beaten, "id", "left")
    rows = rows.withColumns({"suppressed": F.coalesce("suppressed", F.lit(False)), "conflicted": F.coalesce("conflicted", F.lit(False)), "rank": F.coalesce("rank", "topic_rank")})
    return B.selection_status(rows)


@query("ref_op161_prefer_primary", MODEL + """SELECT request_id, id FROM (SELECT *, count(*) FILTER (WHERE origin_kind = 'raw') OVER (PARTITION BY request_id, type) AS
    raws FROM candidates) WHERE raws = 0 OR origin_kind = 'raw'""")
def prefer_primary(spark, d):
    return B.prefer_primary(candidates(spark, d), F.col("origin_kind") == "raw", "request_id", "type").select("request_id", "id")


@query(
    "ref_op162_merge_primary_secondary",
    with_(NODES) + """SELECT session_id, id, rank FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY place, updated_at
    DESC, id) AS rank FROM (SELECT *, min(place) OVER (PARTITION BY session_id) AS best FROM (SELECT *, CASE origin_kind WHEN 'raw' THEN CASE
    WHEN scope = 'session' THEN 1 END WHEN 'compressed' THEN 2 ELSE 3 END AS place FROM nodes) WHERE place IS NOT NULL) WHERE place < 3 OR best
    = 3) WHERE rank <= 3""",
)
def merge_primary_secondary(spark, d):
    place = F.when(F.col("origin_kind") == "raw", F.when(F.col("scope") == "session", 1)).when(F.col("origin_kind") == "compressed", 2).otherwise(3)
    return B.merged(C.nodes(spark, d), place, 3, "session_id", F.desc("updated_at"), F.asc("id")).select("session_id", "id", F.col("rank").cast("long").alias("rank"))


@query("ref_op182_text_match_analysis", with_(SPOKEN, REQUESTS) + f""", m AS (SELECT request_id, id, q, l, {terms('q')} AS ts FROM (SELECT r.request_id, n.id, {NORM.format('r.query')} AS q, {NORM.format('n.label')}
    AS l FROM requests r JOIN nodes n ON n.session_id = r.session_id)) SELECT request_id, id, q <> '' AND contains(l, q) AS phrase, len([t FOR
    t IN ts IF contains(l, t)])::INTEGER AS matched, CASE WHEN len(ts) = 0 THEN 0 ELSE round(len([t FOR t IN ts IF contains(l, t)])::DOUBLE /
    len(ts), 6) END::DOUBLE AS coverage FROM m""")
def text_match_analysis(spark, d):
    r = C.requests(spark, d).select("request_id", "session_id", T.normalized(F.col("query")).alias("q")).withColumn("ts", T.terms(F.col("q")))
    rows = r.join(nodes(spark, d).select("session_id", "id", T.normalized(F.col("label")).alias("l")), "session_id")
    m = T.matched(F.col("l"), F.col("ts"))
    return rows.select("request_id", "id", ((F.col("q") != "") & F.contains("l", "q")).alias("phrase"), m.alias("matched"), F.when(F.size("ts") == 0, 0.0).otherwise(F.round(m / F.size("ts"), 6)).alias("coverage"))


#: a request's goal label: the first three words of its query
GOALS = "array_to_string(string_split(r.query, ' ')[1:3], ' ')"


@query("ref_op160_scope_hierarchy", with_(SPOKEN, REQUESTS, CORRECTIONS, STANDING) + f""", every AS (SELECT r.request_id, r.query, n.id, n.label, CASE n.scope WHEN 'session' THEN 1 WHEN 'workspace' THEN 2 ELSE 3 END AS place FROM requests r JOIN nodes n
    ON CASE n.scope WHEN 'session' THEN n.session_id = r.session_id WHEN 'workspace' THEN n.workspace_id = r.workspace_id ELSE TRUE END UNION ALL SELECT r.request_id, r.query, n.id, s.new_label, 4 FROM requests r
    JOIN nodes n ON n.session_id = r.session_id JOIN standing s ON s.target_kind = 'label_override' AND s.target_id = n.id),
  m AS (SELECT request_id, id, place, q, l, {terms('q')} AS ts FROM (SELECT request_id, id, place, {NORM.format(GOALS)} AS q, {NORM.format('label')} AS l FROM every r))
  SELECT request_id, id, min(place) AS place FROM m WHERE q = '' OR contains(l, q) OR (len(ts) > 0 AND len([t FOR t IN ts IF contains(l, t)]) >= CASE WHEN len(ts) <= 2 THEN len(ts) ELSE greatest(2, ceil(len(ts) * 0.6)) END) GROUP BY 1, 2""")
def scope_hierarchy(spark, d):
    r = C.requests(spark, d).select("request_id", F.col("session_id").alias("s"), F.col("workspace_id").alias("w"), F.substring_index("query", " ", 3).alias("query"))
    r, n = r.withColumn("q", T.normalized(F.col("query"))).withColumn("ts", T.terms(F.col("q"))), nodes(spark, d)
    named = G.resolved(C.corrections(spark, d), "label_override").select(F.col("target_id").alias("id"), "new_label")
    found = lambda rows, label, place: rows.where(T.passes(T.normalized(F.col(label)), F.col("q"), F.col("ts"))).select("request_id", "id", F.lit(place).alias("place"))
    own = found(r.join(n.where("scope = 'session'"), F.col("s") == F.col("session_id")), "label", 1)
    near = found(r.join(n.where("scope = 'workspace'"), F.col("w") == F.col("workspace_id")), "label", 2)
    over = found(r.join(n.join(named, "id"), F.col("s") == F.col("session_id")), "new_label", 4)
    everywhere = R.filtered(r, n.where("scope = 'global'")).withColumn("place", F.lit(3))
    return own.unionByName(near).unionByName(everywhere).unionByName(over).groupBy("request_id", "id").agg(F.min("place").alias("place"))


@query("ref_op052_label_override_filter", with_(SPOKEN, REQUESTS, CORRECTIONS, STANDING) + f""", m AS (SELECT request_id, id, q, l, {terms('q')} AS ts FROM (SELECT r.request_id, n.id, {NORM.format('r.query')} AS q, {NORM.format(chr(39) + 'the ' + chr(39) + ' || s.new_label')}
    AS l FROM requests r JOIN nodes n ON n.session_id = r.session_id AND n.scope = 'session' JOIN standing s ON s.target_kind = 'label_override'
    AND s.target_id = n.id)) SELECT request_id, id FROM m WHERE q = '' OR contains(l, q) OR len([t FOR t IN ts IF contains(l, t)]) >= 1""")
def label_override_filter(spark, d):
    named = G.resolved(C.corrections(spark, d), "label_override").select(F.col("target_id").alias("id"), T.normalized(F.concat(F.lit("the "), "new_label")).alias("l"))
    n = nodes(spark, d).where("scope = 'session'").select("session_id", "id").join(named, "id")
    r = C.requests(spark, d).select("request_id", "session_id", T.normalized(F.col("query")).alias("q")).withColumn("ts", T.terms(F.col("q")))
    return r.join(n, "session_id").where((F.col("q") == "") | F.contains("l", "q") | (T.matched(F.col("l"), F.col("ts")) >= 1)).select("request_id", "id")


KNOWN = """known AS (SELECT 'k' || conv_id || '.' || turn AS id, (['FailureSignal', 'ProcedureCandidate', 'FailurePattern', 'SuccessfulProcedure'])[(turn
    % 4 + 1)::INTEGER] AS type, confidence, CASE WHEN conv_id % 2 = 0 THEN 'validated' ELSE 'candidate' END AS status, (['high', 'medium', 'low'])[(conv_id
    % 3 + 1)::INTEGER] AS severity, 'n' || conv_id || '.0' AS a, 'n' || conv_id || '.1' AS b, label FROM nodes),
hints AS (SELECT a AS node_id, id AS source_id, 'failure_signal' AS kind, CASE severity WHEN 'high' THEN 2.5 WHEN 'medium' THEN 2.0 ELSE 1.5
    END AS bonus, 0 AS late FROM known WHERE type = 'FailureSignal'
  UNION ALL SELECT unnest([a, b]), id, 'procedure_step', CASE status WHEN 'validated' THEN 2.75 ELSE 2.1 END + least(0.5, confidence * 0.5),
    0 FROM known WHERE type = 'ProcedureCandidate' UNION ALL SELECT b, id, 'critical_step', 3.0, 0 FROM known WHERE type = 'ProcedureCandidate'
    UNION ALL SELECT a, id, 'prerequisite', 1.75, 0 FROM known WHERE type = 'ProcedureCandidate'
  UNION ALL SELECT a, id, 'failure_pattern', 2.2, 0 FROM known WHERE type = 'FailurePattern' UNION ALL SELECT unnest([a, b]), id, 'successful_procedure',
    2.6, 0 FROM known WHERE type = 'SuccessfulProcedure' UNION ALL SELECT a, id, 'prerequisite', 1.9, 0 FROM known WHERE type = 'SuccessfulProcedure'"""
LABELLED = f""" UNION ALL SELECT n.id, k.id, CASE k.type WHEN 'FailurePattern' THEN 'failure_pattern' ELSE 'successful_procedure' END, CASE k.type WHEN 'FailurePattern'
    THEN 1.85 ELSE 2.15 END, 1 FROM known k JOIN nodes n ON {NORM.format("n.label")} = {NORM.format("k.label")} WHERE k.type IN ('FailurePattern',
    'SuccessfulProcedure') AND {NORM.format("n.label")} <> ''),
once AS (SELECT node_id, source_id, kind, arg_min(bonus, (late, -bonus)) AS bonus FROM hints GROUP BY 1, 2, 3)"""


def knowledge(spark, d):
    n, conv = nodes(spark, d), F.col("conv_id")
    pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    a, b = F.concat(F.lit("n"), conv, F.lit(".0")), F.concat(F.lit("n"), conv, F.lit(".1"))
    return n.select(
        F.concat(F.lit("k"), conv, F.lit("."), "turn").alias("id"), pick(F.col("turn"), "FailureSignal", "ProcedureCandidate", "FailurePattern", "SuccessfulProcedure").alias("type"), "confidence", F.when(conv % 2 == 0, "validated").otherwise("candidate").alias("status"),
        pick(conv, "high", "medium", "low").alias("severity"), F.array(a).alias("source_ids"), F.array(a, b).alias("step_ids"), F.array(b).alias("critical_ids"), F.array(a).alias("prerequisite_ids"), F.array("label").alias("labels"),
    )


@query("ref_op087_learning_labels", with_(SPOKEN, KNOWN + LABELLED) + "SELECT node_id, source_id, kind, bonus::DOUBLE AS bonus FROM once")
def learning_labels(spark, d):
    h = B.learning_hints(knowledge(spark, d), nodes(spark, d).select("id", "label"))
    return h.withColumn("bonus", F.round("bonus", 6))


@query("ref_op111_learning_bonus", with_(SPOKEN, KNOWN + LABELLED) + "SELECT node_id, round(sum(bonus), 6)::DOUBLE AS bonus, count(*) AS hints FROM once GROUP BY 1")
def learning_bonus(spark, d):
    h = B.learning_hints(knowledge(spark, d), nodes(spark, d).select("id", "label"))
    return h.groupBy("node_id").agg(F.round(F.sum("bonus"), 6).alias("bonus"), F.count("*").alias("hints"))


_STATE = """CASE WHEN decision = 'retire' THEN 'retired' WHEN decision = 'hold' THEN CASE WHEN n >= 2 THEN 'downgraded' ELSE 'candidate'
    END WHEN decision = 'promote' THEN 'reinforced' WHEN state0 = 'retired' THEN 'retired' WHEN (mixed AND n >= 2) OR c1 < c0 - 0.08 OR d0 >=
    2 THEN 'downgraded' WHEN n >= 2 THEN 'reinforced' ELSE 'candidate' END"""
OBSERVED = f"""pairs AS (SELECT id, observations AS n0, downgrades AS d0, promotion_state AS state0, confidence AS c0, observations + 1 AS n, round(0.5 + ((conv_id
    * 11 + turn * 3) % 50) / 100.0, 2)::DOUBLE AS c1, (conv_id + turn) % 4 = 0 AS mixed, (['promote', 'hold', 'retire'])[((conv_id * 2 + turn)
    % 9 + 1)::INTEGER] AS decision, turn % 5 = 4 AS again FROM nodes),
stated AS (SELECT *, {_STATE} AS state FROM pairs), counted AS (SELECT *, CASE state WHEN 'downgraded' THEN d0 + 1 WHEN 'reinforced' THEN 0 ELSE d0 END AS dg FROM stated)"""


@query(
    "ref_op248_pattern_reinforcement",
    with_(NODES, OBSERVED) + """SELECT id, CASE WHEN again THEN n0 ELSE n END AS observations, CASE WHEN again THEN state0 ELSE state END AS state, CASE
    WHEN again THEN d0 ELSE dg END AS downgrades, CASE WHEN NOT again THEN CASE WHEN state = 'retired' THEN 'stale' WHEN state = 'downgraded'
    OR dg >= 2 THEN CASE WHEN c1 >= 0.7 THEN 'cooling' ELSE 'stale' END WHEN n >= 3 OR c1 >= 0.85 THEN 'fresh' WHEN n >= 2 OR c1 >= 0.7 THEN
    'cooling' ELSE 'stale' END END AS decay, round(CASE WHEN again THEN greatest(c0, c1) ELSE least(0.99, greatest(c0, c1) + 0.03) END, 6)::DOUBLE
    AS confidence FROM counted""",
)
def pattern_reinforcement(spark, d):
    conv, turn, n = F.col("conv_id"), F.col("turn"), C.nodes(spark, d)
    old = n.select("id", "observations", "downgrades", F.col("promotion_state").alias("state"), "confidence", F.lit("b0").alias("bundle"))
    decision = F.get(F.array(F.lit("promote"), F.lit("hold"), F.lit("retire")), ((conv * 2 + turn) % 9).cast("int"))
    new = n.select("id", F.when(turn % 5 == 4, "b0").otherwise("b1").alias("bundle"), F.round(F.lit(0.5) + (conv * 11 + turn * 3) % 50 / 100, 2).alias("confidence"), ((conv + turn) % 4 == 0).alias("mixed"), decision.alias("decision"))
    return B.reinforced(old, new)


@query("ref_op250_derived_guard", """SELECT 'b' || conv_id || '.' || turn AS id, CASE WHEN turn % 5 = 0 THEN 'evidence' WHEN turn % 5 = 1 THEN 'no provenance'
    WHEN turn % 5 = 2 THEN 'origin' ELSE 'stage' END AS why FROM conversations WHERE turn % 5 < 4""")
def derived_guard(spark, d):
    c, turn = C.read(spark, d, "conversations"), F.col("turn") % 5
    rows = c.select(F.concat(F.lit("b"), "conv_id", F.lit("."), "turn").alias("id"), F.when(turn == 0, "Evidence").otherwise("Pattern").alias("type"), F.when(turn == 2, "raw").when(turn != 1, "derived").alias("origin_kind"), F.when(turn == 3, "checkpoint").otherwise("runtime_bundle").alias("source_stage"))
    return B.not_derived(rows)


_RISEN = """g AS (SELECT id, scope, type, knowledge_class, risk, decision FROM promoted p LEFT JOIN (SELECT target_id, CASE disposition WHEN 'materialize'
    THEN 'promote' WHEN 'drop' THEN 'retire' ELSE 'hold' END AS decision FROM standing WHERE target_kind = 'promotion_decision') s ON s.target_id
    = p.id)"""


def _promoted():
    from loomgraph.queries.compile import KNOWLEDGE, PROMOTED

    return with_(NODES, CORRECTIONS, STANDING, KNOWLEDGE, PROMOTED, _RISEN)


@query("ref_op249_global_promotion", _promoted() + """SELECT 'global:' || id AS id, 'global' AS scope, type, coalesce(decision, 'governance') AS \"by\" FROM g WHERE scope = 'workspace'
    AND coalesce(decision, '') NOT IN ('retire', 'hold') AND (decision = 'promote' OR (risk = 'low' AND knowledge_class IN ('stable_skill', 'hard_constraint_candidate')))""")
def global_promotion(spark, d):
    kind = F.element_at(F.array(*map(F.lit, X.PROMOTED_TYPES)), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    n = C.nodes(spark, d).withColumn("type", kind)
    g = n.select("id", "scope", "type", S.promotion(F.col("type"), F.col("confidence"), F.col("observations"), F.col("downgrades"), F.col("promotion_state")).alias("g")).select("id", "scope", "type", "g.*")
    said = F.when(F.col("disposition") == "materialize", "promote").when(F.col("disposition") == "drop", "retire").otherwise("hold")
    return B.global_clones(g, G.resolved(C.corrections(spark, d), "promotion_decision").select("target_id", said.alias("decision")))
