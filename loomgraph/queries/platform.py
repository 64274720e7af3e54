"""Queries of the control plane: events as jobs, proposals and policies, documents as what is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.operators import platform as P
from loomgraph.queries.model_sql import CORRECTIONS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

PROPOSALS = """proposals AS (SELECT event_id // 4 AS proposal_id, (['session', 'workspace', 'global'])[((event_id // 4) % 3 + 1)::INTEGER] AS scope, (['pending',
    'approved', 'rejected', 'applied'])[((event_id // 4) % 7 % 4 + 1)::INTEGER] AS status, 'w' || ((event_id // 4) % 11) AS workspace_id, min(event_id)
    AS submitted FROM events GROUP BY 1, 2, 3, 4),
held AS (SELECT c.*, event_id // 4 AS proposal_id, CASE WHEN target_kind = 'concept_alias' AND event_id % 3 > 0 THEN new_label END AS alias FROM corrections c)"""
MODEL = with_(CORRECTIONS, PROPOSALS)
RECORDS = """records AS (SELECT 'd' || doc_id AS id, 's' || (doc_id % 40) AS session_id, CASE WHEN doc_id % 40 % 5 > 0 THEN 'w' || (doc_id % 40 % 5) END AS
    workspace_id, (['document', 'repo_structure', 'structured_input'])[(doc_id % 3 + 1)::INTEGER] AS source_kind,
  (['src/a' || doc_id || '.TS', 'src/api/r' || doc_id || '.js', 'README.md', 'cfg.yaml', ''])[(doc_id % 5 + 1)::INTEGER] AS path, coalesce(text, '') AS content FROM documents)"""
JOBS = """jobs AS (SELECT event_id AS job_id, 'w' || (event_id % 11) AS workspace_id, (['pending', 'scheduled', 'running', 'failed', 'completed'])[(event_id
    % 5 + 1)::INTEGER] AS status, event_id % 13 = 0 AS paused, event_id % 17 = 0 AS dead, event_id % 4 AS attempts, event_id % 6 AS retries,
    event_id % 3 > 0 AS retriable, (['run', 'retry', 'rerun'])[(event_id // 5 % 3 + 1)::INTEGER] AS action FROM events)"""


def _pick(n, *values):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def proposals(spark, d):
    p = F.floor(F.col("event_id") / 4)
    e = C.read(spark, d, "events").groupBy(p.alias("proposal_id")).agg(F.min("event_id").alias("submitted"))
    n = F.col("proposal_id")
    return e.select(n, _pick(n, "session", "workspace", "global").alias("scope"), _pick(n % 7, "pending", "approved", "rejected", "applied").alias("status"), F.concat(F.lit("w"), n % 11).alias("workspace_id"), "submitted")


def held(spark, d):
    alias = F.when((F.col("target_kind") == "concept_alias") & (F.col("event_id") % 3 > 0), F.col("new_label"))
    return C.corrections(spark, d).withColumns({"proposal_id": F.floor(F.col("event_id") / 4), "alias": alias, "seq": F.col("event_id")})


def records(spark, d):
    n, session = F.col("doc_id"), F.col("doc_id") % 40
    path = F.element_at(F.array(F.concat(F.lit("src/a"), n, F.lit(".TS")), F.concat(F.lit("src/api/r"), n, F.lit(".js")), F.lit("README.md"), F.lit("cfg.yaml"), F.lit("")), (n % 5 + 1).cast("int"))
    return C.read(spark, d, "documents").select(
        F.concat(F.lit("d"), n).alias("id"), F.concat(F.lit("s"), session).alias("session_id"), F.when(session % 5 > 0, F.concat(F.lit("w"), session % 5)).alias("workspace_id"), _pick(n, "document", "repo_structure", "structured_input").alias("source_kind"),
        path.alias("path"), F.coalesce("text", F.lit("")).alias("content"),
    )


def jobs(spark, d):
    n = F.col("event_id")
    return C.read(spark, d, "events").select(
        n.alias("job_id"), F.concat(F.lit("w"), n % 11).alias("workspace_id"), _pick(n, "pending", "scheduled", "running", "failed", "completed").alias("status"), (n % 13 == 0).alias("paused"), (n % 17 == 0).alias("dead"), (n % 4).alias("attempts"),
        (n % 6).alias("retries"), (n % 3 > 0).alias("retriable"), _pick(F.floor(n / 5), "run", "retry", "rerun").alias("action"),
    )


@query("ref_op023_import_catalog", "SELECT * FROM (VALUES ('document', 'md,txt,html,pdf'), ('repo_structure', 'json,tree,manifest'), ('structured_input', 'json,jsonl,yaml')) t(importer, formats)")
def import_catalog(spark, d):
    return spark.createDataFrame(list(P.IMPORTERS), "importer string, formats string")


_STABLE = "array_to_string([x FOR x IN [regexp_replace(regexp_replace(y, '^\\s+', ''), '\\s+$', '') FOR y IN string_split_regex(content, '\\r?\\n')] IF x <> ''], chr(10))"


@query("ref_op199_stable_text", "WITH " + RECORDS + f""" SELECT id, left(sha256({_STABLE}), 16) AS digest, CASE WHEN path = '' THEN 'RepoEntity' WHEN path = 'README.md' THEN 'Document'
    WHEN path LIKE 'src/api%' THEN 'API' WHEN path = 'cfg.yaml' THEN 'Module' ELSE 'File' END AS entity FROM records""")
def stable_text(spark, d):
    return records(spark, d).select("id", F.substring(F.sha2(P.stable_text(F.col("content")), 256), 1, 16).alias("digest"), P.repo_entity(F.col("path")).alias("entity"))


@query(
    "ref_op280_import_jobs",
    "WITH " + RECORDS + f""", j AS (SELECT session_id, workspace_id, source_kind, count(*) AS n_records, string_agg(id, '|' ORDER BY id) AS ids, string_agg(part, '|' ORDER
    BY part) AS parts FROM (SELECT *, CASE WHEN source_kind = 'repo_structure' THEN path ELSE id END || ':' || sha256(CASE WHEN source_kind =
    'structured_input' THEN {_STABLE} ELSE content END) AS part FROM records) GROUP BY 1, 2, 3)
  SELECT session_id, source_kind, CASE source_kind WHEN 'document' THEN 'document_parser' WHEN 'repo_structure' THEN 'repo_structure_parser'
    ELSE 'structured_payload_parser' END AS parser, source_kind AS normalizer, CASE source_kind WHEN 'structured_input' THEN 'runtime_ingest'
    ELSE 'source_entities' END AS materializer, n_records,
    source_kind || ':' || session_id || ':' || coalesce(workspace_id, 'workspace:none') || ':' || ids AS dedupe_key, source_kind || ':' || left(sha256(parts),
    16) AS source_version FROM j""",
)
def import_jobs(spark, d):
    return P.import_jobs(records(spark, d))


_WHY = """CASE WHEN paused THEN 'paused' WHEN dead THEN 'dead-lettered' WHEN status = 'running' THEN 'already running' WHEN action = 'run' AND status NOT
    IN ('pending', 'scheduled') THEN 'must be pending or scheduled'
  WHEN action = 'retry' AND status NOT IN ('failed', 'scheduled') THEN 'must be failed' WHEN action = 'retry' AND NOT retriable THEN 'not retriable'
    WHEN action = 'retry' AND retries >= 3 THEN 'reached max retry count' END"""


@query("ref_op283_import_admission", "WITH " + JOBS + f""" SELECT job_id, action, {_WHY} AS refused, CASE WHEN status = 'running' THEN 'running' WHEN dead THEN 'dead-lettered' END
    AS schedule_refused, CASE WHEN status = 'failed' AND retriable THEN 'retry' WHEN attempts > 0 THEN 'rerun' ELSE 'run' END AS scheduled_action,
    CASE WHEN status = 'failed' AND retriable AND retries < 3 THEN 'retry' WHEN attempts > 0 THEN 'rerun' ELSE 'run' END AS batch_action FROM
    jobs""")
def import_admission(spark, d):
    return jobs(spark, d).select("job_id", "action", P.attempt_allowed(F.col("action")).alias("refused"), P.schedule_allowed().alias("schedule_refused"), P.scheduled_action().alias("scheduled_action"), P.batch_action().alias("batch_action"))


@query(
    "ref_op282_stage_traces",
    """WITH a AS (SELECT user_id AS job_id, event_id // 4 AS attempt, event_id % 4 AS stage_no, (['parse', 'normalize', 'materialize', 'ingest'])[(event_id
    % 4 + 1)::INTEGER] AS stage, value < 60 AS ok, floor(value)::BIGINT AS records FROM events),
  r AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY job_id, attempt ORDER BY stage_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM a)
  SELECT job_id, attempt, max(stage) FILTER (WHERE NOT ok) AS failed_stage, count(*) FILTER (WHERE ok) AS completed, sum(records) FILTER (WHERE
    ok)::BIGINT AS records, max(stage) FILTER (WHERE NOT ok) <> 'parse' AS retriable FROM r WHERE f = 0 GROUP BY 1, 2""",
)
def stage_traces(spark, d):
    n = F.col("event_id")
    a = C.read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.floor(n / 4).alias("attempt"), (n % 4).alias("stage_no"), _pick(n, "parse", "normalize", "materialize", "ingest").alias("stage"), (F.col("value") < 60).alias("ok"), F.floor("value").alias("records"))
    return P.stage_traces(a).select("job_id", "attempt", "failed_stage", "completed", "records", "retriable")


@query("ref_op285_import_listing", "WITH " + JOBS + " (SELECT 'jobs' AS list, job_id FROM jobs ORDER BY job_id DESC LIMIT 50) UNION ALL (SELECT 'dead_letters', job_id FROM jobs WHERE dead ORDER BY job_id DESC LIMIT 20)")
def import_listing(spark, d):
    j = jobs(spark, d)
    listed = lambda name, rows, n: rows.orderBy(F.desc("job_id")).limit(n).select(F.lit(name).alias("list"), "job_id")
    return listed("jobs", j, 50).unionByName(listed("dead_letters", j.where("dead"), 20))


@query("ref_op290_authority_matrix", """SELECT s.scope, a.action, w.authority, CASE s.scope WHEN 'session' THEN TRUE WHEN 'workspace' THEN w.authority <> 'session_operator'
    ELSE w.authority = 'global_reviewer' END AS allowed FROM (VALUES ('session'), ('workspace'), ('global')) s(scope), (VALUES ('submit'), ('review'),
    ('apply'), ('rollback')) a(action), (VALUES ('session_operator'), ('workspace_reviewer'), ('global_reviewer')) w(authority)""")
def authority_matrix(spark, d):
    rows = [(s, a, w, w in who) for s, who in X.AUTHORITIES.items() for a in ("submit", "review", "apply", "rollback") for w in X.AUTHORITIES["session"]]
    return spark.createDataFrame(rows, "scope string, action string, authority string, allowed boolean")


@query(
    "ref_op091_proposal_overlap",
    MODEL + """, c AS (SELECT DISTINCT h.proposal_id, scope, target_kind || ':' || target_id AS t, action FROM held h JOIN proposals p USING (proposal_id) WHERE status <> 'rejected')
  SELECT a.proposal_id, b.proposal_id AS conflicting_id, a.scope, count(DISTINCT a.t) AS targets, CASE WHEN bool_or(a.action <> b.action) THEN
    'blocking' ELSE 'warning' END AS severity FROM c a JOIN c b ON a.scope = b.scope AND a.t = b.t AND a.proposal_id <> b.proposal_id GROUP BY
    1, 2, 3""",
)
def proposal_overlap(spark, d):
    return P.overlaps(proposals(spark, d), held(spark, d))


@query("ref_op092_global_overlap", MODEL + """SELECT DISTINCT a.proposal_id FROM held a JOIN proposals p ON p.proposal_id = a.proposal_id AND p.scope = 'workspace' JOIN
    held b ON a.target_kind = b.target_kind AND a.target_id = b.target_id JOIN proposals q ON q.proposal_id = b.proposal_id AND q.scope = 'global'
    AND q.status <> 'rejected'""")
def global_overlap(spark, d):
    return P.global_overlaps(proposals(spark, d), held(spark, d))


@query("ref_op093_merge_suggestions", MODEL + """SELECT target_kind, target_id, count(DISTINCT h.proposal_id) AS proposals, min(h.proposal_id) AS first FROM held h JOIN proposals
    p ON p.proposal_id = h.proposal_id AND scope <> 'session' GROUP BY 1, 2 HAVING count(DISTINCT h.proposal_id) >= 2""")
def merge_suggestions(spark, d):
    return P.merge_suggestions(proposals(spark, d), held(spark, d))


@query("ref_op291_preview", MODEL + """SELECT proposal_id, id, CASE WHEN target_kind = 'concept_alias' AND alias IS NOT NULL THEN action || ' alias \"' || alias
    || '\" on ' || target_id ELSE action || ' ' || target_kind || ' on ' || target_id END AS summary FROM held""")
def preview(spark, d):
    return P.preview(held(spark, d))


@query(
    "ref_op293_recovery_plan",
    MODEL + """SELECT p.proposal_id, count(DISTINCT target_id) AS targets, any_value(scope) = 'global' OR count(*) > 1 AS rollback FROM
    proposals p JOIN held h ON h.proposal_id = p.proposal_id WHERE status = 'applied' GROUP BY 1""",
)
def recovery_plan(spark, d):
    return P.recovery_plan(proposals(spark, d), held(spark, d))


@query("ref_op293_rollbacks", MODEL + """SELECT proposal_id, id || ':rollback:' || row_number() OVER (PARTITION BY proposal_id ORDER BY event_id) AS id, CASE action
    WHEN 'rollback' THEN 'apply' ELSE 'rollback' END AS action FROM held""")
def rollbacks(spark, d):
    return P.rollbacks(held(spark, d))


@query("ref_op294_proposal_listing", MODEL + "SELECT proposal_id, scope, status FROM proposals ORDER BY submitted DESC LIMIT 50")
def proposal_listing(spark, d):
    return proposals(spark, d).orderBy(F.desc("submitted")).limit(50).select("proposal_id", "scope", "status")


FACTS = """facts AS (SELECT e.workspace_id, e.fallback > 0.4 AS fallback_alert, CASE WHEN e.noise <= 0.35 THEN 'healthy' WHEN e.noise >= 0.525 THEN 'critical'
    ELSE 'warning' END AS noise_status, (e.fallback > 0.4)::INT + (e.noise > 0.35)::INT AS alerts, coalesce(failed_jobs, 0) AS failed_jobs, coalesce(dead_jobs,
    0) AS dead_jobs, coalesce(pending, 0) AS pending, coalesce(global_proposals, 0) AS global_proposals
  FROM (SELECT 'w' || (user_id % 23) AS workspace_id, avg((event_type = 'error')::INT) * 2 AS fallback, avg((event_type = 'click')::INT) * 1.7
    AS noise FROM events GROUP BY 1) e LEFT JOIN (SELECT workspace_id, count(*) FILTER (WHERE status = 'failed' OR dead) AS failed_jobs, count(*)
    FILTER (WHERE dead) AS dead_jobs FROM jobs GROUP BY 1) j USING (workspace_id)
  LEFT JOIN (SELECT workspace_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE scope = 'global') AS global_proposals
    FROM proposals GROUP BY 1) p USING (workspace_id)),
advice AS (SELECT workspace_id, 'threshold_tuning' AS classification, 'warning' AS severity, TRUE AS review FROM facts WHERE fallback_alert UNION
    ALL SELECT workspace_id, 'import_strategy', CASE WHEN dead_jobs > 0 THEN 'critical' ELSE 'warning' END, TRUE FROM facts WHERE failed_jobs
    > 0
  UNION ALL SELECT workspace_id, 'recall_strategy', 'warning', FALSE FROM facts WHERE noise_status <> 'healthy' UNION ALL SELECT workspace_id,
    'promotion_strategy', 'warning', TRUE FROM facts WHERE pending > 3 OR global_proposals > 2 UNION ALL SELECT workspace_id, 'low_risk_automation',
    'info', FALSE FROM facts WHERE alerts = 0)"""


def facts(spark, d):
    rate = lambda k: F.avg((F.col("event_type") == k).cast("int"))
    e = C.read(spark, d, "events").groupBy(F.concat(F.lit("w"), F.col("user_id") % 23).alias("workspace_id")).agg((rate("error") * 2).alias("fallback"), (rate("click") * 1.7).alias("noise"))
    j = jobs(spark, d).groupBy("workspace_id").agg(F.count_if((F.col("status") == "failed") | F.col("dead")).alias("failed_jobs"), F.count_if("dead").alias("dead_jobs"))
    p = proposals(spark, d).groupBy("workspace_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("scope") == "global").alias("global_proposals"))
    rows = e.join(j, "workspace_id", "left").join(p, "workspace_id", "left").na.fill(0, ["failed_jobs", "dead_jobs", "pending", "global_proposals"])
    noise = F.when(F.col("noise") <= 0.35, "healthy").when(F.col("noise") >= 0.525, "critical").otherwise("warning")
    return rows.withColumns({"fallback_alert": F.col("fallback") > 0.4, "noise_status": noise, "alerts": (F.col("fallback") > 0.4).cast("int") + (F.col("noise") > 0.35).cast("int")})


@query("ref_op305_recommendations", with_(CORRECTIONS, PROPOSALS, JOBS, FACTS) + "SELECT * FROM advice")
def recommendations(spark, d):
    return P.recommendations(facts(spark, d))


@query(
    "ref_op305_simulation",
    with_(CORRECTIONS, PROPOSALS, JOBS, FACTS) + """SELECT workspace_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'high' WHEN bool_or(review) OR count(*)
    > 3 THEN 'medium' ELSE 'low' END AS risk, bool_or(review) AS review, sum(CASE classification WHEN 'promotion_strategy' THEN 2 ELSE 1 END)::BIGINT
    AS metrics,
  round(sum(CASE classification WHEN 'threshold_tuning' THEN -0.08 WHEN 'import_strategy' THEN 0.12 WHEN 'recall_strategy' THEN -0.05 WHEN 'promotion_strategy'
    THEN 0.04 ELSE -0.01 END), 6)::DOUBLE AS total_delta FROM advice GROUP BY 1""",
)
def simulation(spark, d):
    return P.simulation(P.recommendations(facts(spark, d)))


@query("ref_op306_isolation", """WITH s AS (SELECT 'w' || (user_id % 40) AS workspace_id, event_id, (['isolated', 'shared_workspace', 'shared_global'])[(event_id
    % 3 + 1)::INTEGER] AS mode, event_id % 2 = 0 AS write FROM events WHERE event_type = 'signup' AND value > 60), w AS (SELECT DISTINCT 'w'
    || (user_id % 60) AS workspace_id FROM events UNION SELECT 'global'), n AS (SELECT DISTINCT ON (workspace_id) * FROM s ORDER BY workspace_id,
    event_id DESC) SELECT workspace_id, coalesce(mode, CASE WHEN workspace_id = 'global' THEN 'shared_global' ELSE 'isolated' END) AS mode, coalesce(write,
    workspace_id = 'global') AS shared_write, event_id IS NOT NULL AS saved FROM w LEFT JOIN n USING (workspace_id)""")
def isolation(spark, d):
    e = C.read(spark, d, "events")
    saved = e.where("event_type = 'signup' and value > 60").select(F.concat(F.lit("w"), F.col("user_id") % 40).alias("workspace_id"), F.col("event_id").alias("saved_at"), _pick(F.col("event_id"), "isolated", "shared_workspace", "shared_global").alias("mode"), (F.col("event_id") % 2 == 0).alias("write"))
    spaces = e.select(F.concat(F.lit("w"), F.col("user_id") % 60).alias("workspace_id")).distinct().unionByName(spark.createDataFrame([("global",)], "workspace_id string"))
    return P.isolation(spaces, saved)


@query("ref_op126_workspace_totals", with_(CORRECTIONS, PROPOSALS, JOBS) + """SELECT count(*) AS workspaces, sum(jobs)::BIGINT AS jobs, sum(proposals)::BIGINT AS proposals, count(*) FILTER (WHERE jobs
    > 0) AS active FROM (SELECT workspace_id, sum(j) AS jobs, sum(p) AS proposals FROM (SELECT workspace_id, 1 AS j, 0 AS p FROM jobs UNION ALL
    SELECT workspace_id, 0, 1 FROM proposals) GROUP BY 1)""")
def workspace_totals(spark, d):
    j = jobs(spark, d).select("workspace_id", F.lit(1).alias("j"), F.lit(0).alias("p"))
    each = j.unionByName(proposals(spark, d).select("workspace_id", F.lit(0).alias("j"), F.lit(1).alias("p"))).groupBy("workspace_id").agg(F.sum("j").alias("j"), F.sum("p").alias("p"))
    return each.agg(F.count("*").alias("workspaces"), F.sum("j").alias("jobs"), F.sum("p").alias("proposals"), F.count_if(F.col("j") > 0).alias("active"))


@query("ref_op099_governance_trace", with_(CORRECTIONS, PROPOSALS, JOBS) + """SELECT s.user_id AS session_id, count(DISTINCT p.proposal_id) AS proposals, count(DISTINCT p.proposal_id) FILTER (WHERE p.status
    = 'applied') AS applied, count(DISTINCT j.job_id) AS jobs FROM events s JOIN proposals p ON p.proposal_id = s.event_id // 4 JOIN jobs j ON
    j.job_id = s.event_id GROUP BY 1""")
def governance_trace(spark, d):
    e = C.read(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id")
    rows = e.join(proposals(spark, d), F.floor(e.event_id / 4) == F.col("proposal_id")).join(jobs(spark, d).select("job_id"), F.col("event_id") == F.col("job_id"))
    return rows.groupBy("session_id").agg(F.countDistinct("proposal_id").alias("proposals"), F.countDistinct(F.when(F.col("status") == "applied", F.col("proposal_id"))).alias("applied"), F.countDistinct("job_id").alias("jobs"))


EXTENSIONS = (("core", "1", ["observability_metric", "event_consumer"], "active", True, "sig:core"), ("old", "0", ["import_job_runner"], "active", False, "sha256:00"), ("off", "1", ["event_consumer"], "disabled", True, None))


@query(
    "ref_op308_extension_negotiation",
    """WITH e(id, api_version, caps, status, neutral, signature) AS (VALUES ('core', '1', ['observability_metric', 'event_consumer'], 'active', TRUE,
    'sig:core'), ('old', '0', ['import_job_runner'], 'active', FALSE, 'sha256:00'), ('off', '1', ['event_consumer'], 'disabled', TRUE, NULL)),
  r AS (SELECT event_id AS request_id, (['core', 'old', 'off', 'none'])[(event_id % 4 + 1)::INTEGER] AS eid, (event_id % 3 % 2)::VARCHAR AS api,
    CASE event_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['event_consumer'] ELSE ['event_consumer', 'import_job_runner'] END AS req FROM events),
  m AS (SELECT *, CASE WHEN id IS NULL THEN req ELSE [x FOR x IN req IF NOT list_contains(caps, x)] END AS missing FROM r LEFT JOIN e ON e.id = r.eid)
  SELECT request_id, coalesce(status = 'active' AND api_version = api AND len(missing) = 0, FALSE) AS compatible, len(missing)::INTEGER AS n_missing,
    CASE WHEN id IS NULL THEN 'extension is not registered' ELSE array_to_string([x FOR x IN [CASE WHEN NOT neutral THEN 'extension is not marked provider-neutral'
    END, CASE WHEN status <> 'active' THEN 'extension status is ' || status END,
    CASE WHEN api_version <> api THEN 'requested api ' || api || ' does not match manifest api ' || api_version END] IF x IS NOT NULL], '; ')
    END AS warnings, CASE WHEN signature LIKE 'sig:%' THEN 'trusted' WHEN signature LIKE 'sha256:%' THEN 'unverified' ELSE 'unsigned' END AS
    signing FROM m""",
)
def extension_negotiation(spark, d):
    n = F.col("event_id")
    required = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 5 == 1, F.array(F.lit("event_consumer"))).otherwise(F.array(F.lit("event_consumer"), F.lit("import_job_runner")))
    r = C.read(spark, d, "events").select(n.alias("request_id"), _pick(n, "core", "old", "off", "none").alias("extension_id"), (n % 3 % 2).cast("string").alias("api"), required.alias("required"))
    return P.negotiated(r, spark.createDataFrame(list(EXTENSIONS), "id string, api_version string, capabilities array<string>, status string, neutral boolean, signature string"))


@query(
    "ref_op303_thresholds",
    """WITH d(metric, value) AS (VALUES ('live', 0.5), ('fallback', 0.4), ('noise', 0.35), ('promotion', 0.6), ('pollution', 0.2), ('reuse', 0.4), ('intrusion',
    0.3), ('multi_source', 0.5)),
  e AS (SELECT user_id AS scope_id, event_id, event_type, value, CASE event_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'noise' ELSE 'reuse' END AS metric FROM events),
  s AS (SELECT scope_id, metric, arg_max(value, event_id) AS v FROM e WHERE event_type = 'signup' GROUP BY 1, 2), a AS (SELECT scope_id, metric,
    arg_max(value, event_id) AS v FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT k.scope_id, d.metric, coalesce(a.v, s.v, d.value)::DOUBLE AS value FROM (SELECT scope_id FROM s UNION SELECT scope_id FROM a) k CROSS
    JOIN d LEFT JOIN s ON s.scope_id = k.scope_id AND s.metric = d.metric LEFT JOIN a ON a.scope_id = k.scope_id AND a.metric = d.metric""",
)
def thresholds(spark, d):
    n = F.col("event_id")
    e = C.read(spark, d, "events").select(F.col("user_id").alias("scope_id"), n, "event_type", "value", _pick(n, "live", "noise", "reuse").alias("metric"))
    saved = e.where("event_type = 'signup'").withColumnRenamed("event_id", "saved_at")
    asked = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "asked_at")
    return P.thresholds(spark.createDataFrame([(k, v[1]) for k, v in X.THRESHOLDS.items()], "metric string, value double"), saved, asked)


@query(
    "ref_op309_review_views",
    with_(CORRECTIONS, PROPOSALS, JOBS) + """SELECT 'knowledge' AS view, scope AS part, status, count(*) AS n FROM proposals WHERE scope <> 'session' GROUP BY 2, 3 UNION
    ALL SELECT 'import', action, status, count(*) FROM jobs WHERE status = 'failed' OR dead GROUP BY 2, 3""",
)
def review_views(spark, d):
    p = proposals(spark, d).where("scope <> 'session'").groupBy(F.lit("knowledge").alias("view"), F.col("scope").alias("part"), "status").agg(F.count("*").alias("n"))
    j = jobs(spark, d).where("status = 'failed' or dead").groupBy(F.lit("import").alias("view"), F.col("action").alias("part"), "status").agg(F.count("*").alias("n"))
    return p.unionByName(j)
