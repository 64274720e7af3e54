"""Queries of text processing, tool results, skills, imports, governance and observability."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.operators import control as K
from loomgraph.operators import ingest as I
from loomgraph.operators import processing as P
from loomgraph.queries.model_sql import CORRECTIONS, NODES, RECORDS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

FLAT = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"


@query("ref_op183_utterance_normalisation", f"SELECT conv_id, turn, sha256({FLAT.format('text')}) AS norm_sha FROM conversations")
def utterances(spark, d):
    return C.read(spark, d, "conversations").select("conv_id", "turn", F.sha2(P.flat(F.col("text")), 256).alias("norm_sha"))


SAID = """CASE turn % 5 WHEN 0 THEN text || ' we need a tool' WHEN 1 THEN 'You must not do it; ' || text WHEN 2 THEN text || ' failed with an error'
    WHEN 3 THEN 'What is the next step? ' || text ELSE text END"""


def _said():
    t, turn = F.col("text"), F.col("turn") % 5
    return F.when(turn == 0, F.concat(t, F.lit(" we need a tool"))).when(turn == 1, F.concat(F.lit("You must not do it; "), t)).when(turn == 2, F.concat(t, F.lit(" failed with an error"))).when(turn == 3, F.concat(F.lit("What is the next step? "), t)).otherwise(t)


@query("ref_op190_node_type_ladder", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(f, '{X.PATTERNS['Risk']}') THEN 'Risk' WHEN regexp_matches(f, '{X.PATTERNS['Constraint'].replace(chr(39), chr(39) * 2)}')
    THEN 'Constraint' WHEN regexp_matches(f, '{X.PATTERNS['Step']}') THEN 'Step' WHEN regexp_matches(f, '{X.PATTERNS['Goal']}') THEN 'Goal' ELSE
    CASE role WHEN 'user' THEN 'Intent' WHEN 'assistant' THEN 'Decision' ELSE 'State' END END AS type FROM (SELECT conv_id, turn, role, {FLAT.format(SAID)}
    AS f FROM conversations)""")
def node_type_ladder(spark, d):
    low = P.flat(_said())
    kind = F.when(F.lit(False), "")
    for k in ("Risk", "Constraint", "Step", "Goal"):
        kind = kind.when(low.rlike(P.ascii_words(X.PATTERNS[k])), k)
    kind = kind.when(F.col("role") == "user", "Intent").when(F.col("role") == "assistant", "Decision").otherwise("State")
    return C.read(spark, d, "conversations").select("conv_id", "turn", kind.alias("type"))


@query("ref_op050_open_risk_labels", with_(RECORDS) + "SELECT id FROM records WHERE regexp_matches(lower(content), 'risk|block|conflict|constraint|forbid|warning')")
def open_risk_labels(spark, d):
    return C.records(spark, d).where(F.lower("content").rlike("risk|block|conflict|constraint|forbid|warning")).select("id")


@query("ref_op064_evidence_nodes", with_(RECORDS) + "SELECT sha256(id || '|' || source_type) AS node_id, 'Evidence' AS type, left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 96) AS label FROM records")
def evidence_nodes(spark, d):
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    return C.records(spark, d).select(F.sha2(F.concat_ws("|", "id", "source_type"), 256).alias("node_id"), F.lit("Evidence").alias("type"), F.substring(flat, 1, 96).alias("label"))


@query("ref_op066_kind_strength_confidence", with_(NODES, RECORDS) + """SELECT n.id, CASE WHEN type IN ('Rule', 'Constraint', 'Mode') THEN 'norm' WHEN type IN ('Process', 'Step', 'Skill', 'Pattern')
    THEN 'process' WHEN type = 'Risk' THEN 'inference' WHEN type IN ('State', 'Goal', 'Intent', 'Outcome') THEN 'state' ELSE 'fact' END AS kind,
    CASE source_type WHEN 'system' THEN 'hard' ELSE 'heuristic' END AS strength, CASE source_type WHEN 'system' THEN 1.0 WHEN 'tool_output' THEN
    0.95 ELSE 0.7 END::DOUBLE AS confidence FROM nodes n JOIN records r ON r.conv_id = n.conv_id AND r.turn = n.turn""")
def strengths(spark, d):
    r = C.records(spark, d).select("conv_id", "turn", "source_type")
    n = C.nodes(spark, d).select("conv_id", "turn", "id", "type").join(r, ["conv_id", "turn"])
    return n.select("id", I.kind(F.col("type")).alias("kind"), I.strength(F.col("source_type")).alias("strength"), I.confidence(F.col("source_type")).alias("confidence"))


@query("ref_op067_label_preview", with_(RECORDS) + "SELECT id, CASE WHEN length(f) <= 96 THEN f ELSE left(f, 93) || '...' END AS label FROM (SELECT id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS f FROM records)")
def label_preview(spark, d):
    from loomgraph.functions.text import preview

    return C.records(spark, d).select("id", preview(F.col("content")).alias("label"))


@query("ref_op195_head_tail_preview", """SELECT page_id, length(html) > 900 AS compressed, CASE WHEN length(html) > 900 THEN length(html) - 520 ELSE 0 END::BIGINT
    AS omitted_chars, len(string_split(html, chr(10)))::BIGINT AS lines, sha256(CASE WHEN length(html) > 900 THEN left(html, 320) || chr(10)
    || '...' || chr(10) || right(html, 200) ELSE html END) AS preview_sha FROM pages""")
def head_tail_preview(spark, d):
    return P.digested(C.read(spark, d, "pages"), "html").select("page_id", "compressed", F.col("omitted_chars").cast("long").alias("omitted_chars"), F.col("lines").cast("long").alias("lines"), F.sha2("preview", 256).alias("preview_sha"))


@query("ref_op198_merge_key_slug", with_(RECORDS) + """SELECT id, CASE WHEN s = '' THEN 'unspecified' ELSE s END AS slug FROM (SELECT id, left(regexp_replace(regexp_replace(lower(content),
    '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 72) AS s FROM records)""")
def merge_key_slug(spark, d):
    return C.records(spark, d).select("id", P.slug(F.col("content")).alias("slug"))


@query("ref_op200_document_title", "SELECT doc_id, left([x FOR x IN [trim(regexp_replace(y, '^#+', '')) FOR y IN string_split(coalesce(text, ''), chr(10))] IF x <> ''][1], 96) AS title FROM documents")
def document_title(spark, d):
    return C.read(spark, d, "documents").select("doc_id", P.title(F.col("text")).alias("title"))


@query("ref_op202_truncation", with_(RECORDS) + "SELECT id, CASE WHEN length(content) > 48 THEN left(content, 47) || '…' ELSE content END AS short FROM records")
def truncation(spark, d):
    return C.records(spark, d).select("id", F.when(F.char_length("content") > 48, F.concat(F.substring("content", 1, 47), F.lit("…"))).otherwise(F.col("content")).alias("short"))


@query("ref_op205_clamp_average", "SELECT user_id, round(least(1, greatest(0, avg(value) / 50)), 6) AS score FROM events GROUP BY 1")
def clamp_average(spark, d):
    return C.read(spark, d, "events").groupBy("user_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("value") / 50)), 6).alias("score"))


@query("ref_op206_backoff", "SELECT event_id, least(1000 * 2 ** greatest(event_id % 9 - 1, 0), 60000)::BIGINT AS wait_ms FROM events")
def backoff(spark, d):
    return C.read(spark, d, "events").select("event_id", K.backoff(1000, 60000, F.col("event_id") % 9).alias("wait_ms"))


@query("ref_op207_latest_iso", with_(RECORDS) + "SELECT session_id, max(created_at) AS latest FROM records GROUP BY 1")
def latest_iso(spark, d):
    return C.records(spark, d).groupBy("session_id").agg(F.max("created_at").alias("latest"))


@query("ref_op209_json_accessors", with_(NODES) + "SELECT id, (payload->>'observationCount')::BIGINT AS observations, payload->>'sessionId' AS session, payload->>'absent' AS absent FROM nodes")
def json_accessors(spark, d):
    g = lambda k: F.get_json_object("payload", f"$.{k}")
    return C.nodes(spark, d).select("id", g("observationCount").cast("long").alias("observations"), g("sessionId").alias("session"), g("absent").alias("absent"))


@query("ref_op211_stable_ids", with_(RECORDS) + "SELECT id, sha256(session_id || '|' || role || '|' || turn) AS full_id, 'edge:' || left(sha256(id), 24) AS edge_id, 'v:' || left(sha256(content), 12) AS version FROM records")
def stable_ids(spark, d):
    return C.records(spark, d).select("id", F.sha2(F.concat_ws("|", "session_id", "role", "turn"), 256).alias("full_id"), F.concat(F.lit("edge:"), F.substring(F.sha2("id", 256), 1, 24)).alias("edge_id"), F.concat(F.lit("v:"), F.substring(F.sha2("content", 256), 1, 12)).alias("version"))


METRICS = """metrics AS (SELECT user_id AS snapshot_id, avg((event_type = 'view')::INT) * 2 AS live, avg((event_type = 'error')::INT)
    * 2 AS fallback, avg((event_type = 'click')::INT) AS noise, least(1.0, avg(value) / 40) AS pollution, count(*) % 5 / 5.0 AS reuse FROM events
    GROUP BY 1)"""
CARDS = """cards AS (SELECT snapshot_id, metric, round(value::DOUBLE, 6) AS value, direction, threshold, CASE WHEN direction = 'max'
    THEN CASE WHEN value <= threshold THEN 'healthy' WHEN value >= threshold * 1.5 THEN 'critical' ELSE 'warning' END ELSE CASE WHEN value >=
    threshold THEN 'healthy' WHEN value <= threshold * 0.5 THEN 'critical' ELSE 'warning' END END AS status FROM (SELECT snapshot_id, 'live'
    AS metric, live AS value, 'min' AS direction, 0.5::DOUBLE AS threshold FROM metrics UNION ALL SELECT snapshot_id, 'fallback', fallback, 'max',
    0.4 FROM metrics UNION ALL SELECT snapshot_id, 'noise', noise, 'max', 0.35 FROM metrics UNION ALL SELECT snapshot_id, 'pollution', pollution,
    'max', 0.2 FROM metrics UNION ALL SELECT snapshot_id, 'reuse', reuse, 'min', 0.4 FROM metrics))"""


def _cards(spark, d):
    e = C.read(spark, d, "events")
    is_ = lambda k: F.avg((F.col("event_type") == k).cast("int"))
    m = e.groupBy(F.col("user_id").alias("snapshot_id")).agg((is_("view") * 2).alias("live"), (is_("error") * 2).alias("fallback"), is_("click").alias("noise"), F.least(F.lit(1.0), F.avg("value") / 40).alias("pollution"), (F.count("*") % 5 / 5).alias("reuse"))
    return K.cards(m)


@query("ref_op300_metric_cards", with_(METRICS, CARDS) + "SELECT snapshot_id, metric, value, direction, threshold FROM cards")
def metric_cards(spark, d):
    return _cards(spark, d).select("snapshot_id", "metric", F.round("value", 6).alias("value"), "direction", "threshold")


@query("ref_op301_metric_status", with_(METRICS, CARDS) + "SELECT metric, status, count(*) AS n FROM cards GROUP BY 1, 2")
def metric_status(spark, d):
    return _cards(spark, d).groupBy("metric", "status").agg(F.count("*").alias("n"))


@query("ref_op302_alerts", with_(METRICS, CARDS) + "SELECT snapshot_id, metric || ' is ' || status AS message FROM cards WHERE status <> 'healthy'")
def alerts(spark, d):
    return _cards(spark, d).where("status <> 'healthy'").select("snapshot_id", F.format_string("%s is %s", "metric", "status").alias("message"))


@query("ref_op098_release_comparison", with_(METRICS, CARDS) + """SELECT a.metric, count(*) AS n, count(*) FILTER (WHERE b.status <> a.status) AS changed FROM cards a LEFT JOIN cards b ON
    b.metric = a.metric AND b.snapshot_id = a.snapshot_id - 1 GROUP BY 1""")
def release_comparison(spark, d):
    c = _cards(spark, d).select("snapshot_id", "metric", "status")
    b = c.select((F.col("snapshot_id") + 1).alias("snapshot_id"), "metric", F.col("status").alias("before"))
    return c.join(b, ["snapshot_id", "metric"], "left").groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("status")).alias("changed"))


@query("ref_op115_stage_snapshot", "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stage_snapshot(spark, d):
    return C.read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("ref_op116_window_summary", with_(RECORDS) + "SELECT role, count(*) AS n, round(avg(length(content)), 6) AS mean_chars, max(created_at) AS latest FROM records GROUP BY 1")
def window_summary(spark, d):
    return C.records(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.char_length("content")), 6).alias("mean_chars"), F.max("created_at").alias("latest"))


SKILLS = """skills AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'purchase') AS evidence, count(*) FILTER (WHERE event_type
    = 'error' AND value > 40) AS failures, round(least(1.0, avg(value) / 25), 6) AS success, round(count(*) % 4 / 4.0 + 0.25, 6) AS clarity,
    round(count(*) % 3 / 3.0 + 0.3, 6) AS stability, round(count(*) % 10 / 10.0, 6) AS frequency FROM events GROUP BY 1)"""


def _skills(spark, d):
    e, n = C.read(spark, d, "events"), F.count("*")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("event_type") == "purchase").alias("evidence"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 40)).alias("failures"), F.round(F.least(F.lit(1.0), F.avg("value") / 25), 6).alias("success"), F.round(n % 4 / 4 + 0.25, 6).alias("clarity"), F.round(n % 3 / 3 + 0.3, 6).alias("stability"), F.round(n % 10 / 10, 6).alias("frequency"))


RISK = "CASE WHEN failures >= 2 OR success < 0.45 THEN 'high' WHEN failures > 0 OR success < 0.68 OR clarity < 0.7 THEN 'medium' ELSE 'low' END"


@query("ref_op247_skill_governance", with_(SKILLS) + f"""SELECT id, {RISK} AS risk, CASE WHEN evidence >= 3 AND stability >= 0.75 AND clarity >= 0.7 AND success >= 0.68 AND {RISK}
    <> 'high' THEN 'promote' ELSE 'hold' END AS decision FROM skills""")
def skill_governance(spark, d):
    c = F.col
    return _skills(spark, d).select("id", K.skill_governance(c("evidence"), F.lit(3), c("stability"), c("clarity"), c("success"), c("failures")).alias("g")).select("id", "g.risk", "g.decision")


@query("ref_op259_skill_lifecycle", with_(SKILLS) + """SELECT id, CASE WHEN failures >= 2 AND success < 0.45 THEN 'stale' WHEN evidence >= 4 AND success >= 0.6 THEN 'fresh' WHEN
    evidence >= 3 THEN 'cooling' ELSE 'stale' END AS decay FROM skills""")
def skill_lifecycle(spark, d):
    c = F.col
    return _skills(spark, d).select("id", K.skill_governance(c("evidence"), F.lit(3), c("stability"), c("clarity"), c("success"), c("failures"))["decay"].alias("decay"))


@query("ref_op258_skill_merge", with_(SKILLS) + """SELECT 'k' || (id % 20) AS merge_key, count(*) AS n, round(least(1, avg(frequency) + 0.1 * (count(*) - 1)), 6) AS frequency,
    round(least(1, avg(stability) + CASE WHEN count(*) > 1 THEN 0.05 ELSE 0 END), 6) AS stability, round(least(1, avg(success)), 6) AS success,
    round(least(1, max(clarity)), 6) AS clarity FROM skills GROUP BY 1""")
def skill_merge(spark, d):
    return K.merged_skills(_skills(spark, d).withColumn("merge_key", F.concat(F.lit("k"), F.col("id") % 20)))


@query("ref_op284_import_state", """WITH a AS (SELECT user_id AS job_id, event_id AS seq, event_type = 'purchase' AS ok FROM events), b AS (SELECT *, min(seq)
    FILTER (WHERE ok) OVER (PARTITION BY job_id) AS f FROM a) SELECT job_id, count(*) AS attempts, count(*) FILTER (WHERE NOT ok) AS failures,
    CASE WHEN bool_or(ok) AND count(*) FILTER (WHERE NOT ok) < 3 THEN 'completed' WHEN count(*) FILTER (WHERE NOT ok) >= 3 THEN 'dead_letter'
    ELSE 'waiting' END AS state FROM b WHERE f IS NULL OR seq <= f GROUP BY 1""")
def import_state(spark, d):
    e = C.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    return K.import_state(e).select("job_id", "attempts", "failures", "state")


@query("ref_op281_import_dedupe", "SELECT sha256(lower(trim(text))) AS dedupe_key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def import_dedupe(spark, d):
    return C.read(spark, d, "documents").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("dedupe_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("ref_op292_proposal_states", """WITH RECURSIVE e AS (SELECT user_id AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type
    WHEN 'view' THEN 'submit' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'apply' ELSE 'rollback' END AS a FROM
    events), run AS (SELECT DISTINCT p, 0::BIGINT AS k, 'none' AS s, 0 AS refused FROM e UNION ALL SELECT r.p, e.k, CASE WHEN f THEN CASE a WHEN
    'submit' THEN 'submitted' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'apply' THEN 'applied' ELSE 'rolled_back' END
    ELSE s END, refused + CASE WHEN f THEN 0 ELSE 1 END FROM run r JOIN e ON e.p = r.p AND e.k = r.k + 1, LATERAL (SELECT (s = 'none' AND a =
    'submit') OR (s = 'submitted' AND a IN ('approve', 'reject')) OR (s = 'approved' AND a = 'apply') OR (s = 'applied' AND a = 'rollback') AS
    f)) SELECT p AS proposal_id, arg_max(s, k) AS state, max(refused) AS refused FROM run GROUP BY 1""")
def proposal_states(spark, d):
    action = F.create_map(*(F.lit(x) for x in ("view", "submit", "click", "approve", "error", "reject", "purchase", "apply", "signup", "rollback")))[F.col("event_type")]
    return K.proposal_state(C.read(spark, d, "events").select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), action.alias("action")))


@query("ref_op094_workspace_catalog", with_(NODES, RECORDS) + """SELECT coalesce(a.workspace_id, b.workspace_id) AS workspace_id, coalesce(sessions, 0) AS sessions, coalesce(rules, 0) AS
    rules FROM (SELECT workspace_id, count(DISTINCT session_id) AS sessions FROM records GROUP BY 1) a FULL JOIN (SELECT workspace_id, count(*)
    AS rules FROM nodes WHERE type = 'Rule' GROUP BY 1) b ON a.workspace_id = b.workspace_id""")
def workspace_catalog(spark, d):
    a = C.records(spark, d).groupBy("workspace_id").agg(F.countDistinct("session_id").alias("sessions"))
    b = C.nodes(spark, d).where("type = 'Rule'").groupBy("workspace_id").agg(F.count("*").alias("rules"))
    return a.join(b, "workspace_id", "full").select("workspace_id", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("rules", F.lit(0)).alias("rules"))


@query("ref_op307_platform_events", "SELECT event_type, user_id % 7 AS workspace, count(*) AS n FROM events WHERE value >= 10 GROUP BY 1, 2")
def platform_events(spark, d):
    return C.read(spark, d, "events").where("value >= 10").groupBy("event_type", (F.col("user_id") % 7).alias("workspace")).agg(F.count("*").alias("n"))


@query("ref_op100_subscription_fanout", """SELECT e.event_id, s.id AS subscription FROM events e JOIN (VALUES (1, 'error', 2), (2, 'purchase', 1), (3, 'error', 3))
    s(id, kind, least) ON e.event_type = s.kind AND CASE WHEN e.value >= 30 THEN 3 WHEN e.value >= 10 THEN 2 ELSE 1 END >= s.least""")
def subscription_fanout(spark, d):
    subs = spark.createDataFrame([(1, "error", 2), (2, "purchase", 1), (3, "error", 3)], "subscription int, event_type string, least int")
    e = C.read(spark, d, "events").withColumn("rank", F.when(F.col("value") >= 30, 3).when(F.col("value") >= 10, 2).otherwise(1))
    return e.join(F.broadcast(subs), "event_type").where("rank >= least").select("event_id", "subscription")
