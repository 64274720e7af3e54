"""Queries of keyed state, run as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.queries.model_sql import RECORDS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C
from loomgraph.sources import transcripts as T
from loomgraph.streaming import compression, reinforcement, scheduler


def _compressed(key: str, order: str) -> str:
    """The compression of what ``key`` says in ``order``, message by message: a list of open messages, one of baselines."""
    cost = "greatest(1, ceil(length({0}) / 4.0))"
    total = f"coalesce(list_sum([{cost.format('x')} FOR x IN {{b}}]), 0) + coalesce(list_sum([{cost.format('x.c')} FOR x IN {{o}}]), 0)"
    return with_(RECORDS).replace("WITH ", "WITH RECURSIVE ", 1) + f""", m AS (SELECT {key} AS s, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k, role AS r, coalesce(content, '') AS c FROM records),
    run(s, k, o, b, folds, evictions, mode) AS (SELECT DISTINCT s, 0::BIGINT, []::STRUCT(r VARCHAR, c VARCHAR)[], []::VARCHAR[], 0::BIGINT, 0::BIGINT, 'none' FROM m
    UNION ALL SELECT s, k, CASE WHEN whole THEN o[cut + 1:] ELSE o END, CASE WHEN NOT crowded THEN b WHEN fits THEN list_prepend(merged, b[3:]) ELSE b[2:] END, folds + whole::BIGINT,
        evictions + (crowded AND NOT fits)::BIGINT, CASE WHEN whole THEN 'full' WHEN cut > 0 THEN 'incremental' ELSE 'none' END
    FROM (SELECT *, whole AND len(b) > 3 AS crowded, b[1] || chr(10) || b[2] AS merged, {cost.format("b[1] || chr(10) || b[2]")} <= 200 AS fits
    FROM (SELECT s, k, o, folds, evictions, cut, whole, CASE WHEN whole THEN list_append(b, left(array_to_string([x.r || ': ' || left(trim(regexp_replace(x.c, '\\s+', ' ', 'g')), 120)
        FOR x IN o[greatest(1, cut - 7):cut]], chr(10)), 1200)) ELSE b END AS b
    FROM (SELECT *, cut > 0 AND ({total.format(b="b", o="o")}) / 400.0 > 0.5 AS whole
    FROM (SELECT *, CASE WHEN len(starts) > 2 THEN starts[-2] - 1 ELSE 0 END AS cut
    FROM (SELECT *, [i FOR i IN range(1, len(o) + 1) IF o[i].r = 'user'] AS starts
    FROM (SELECT run.s, m.k, list_append(run.o, {{'r': m.r, 'c': m.c}}) AS o, run.b, run.folds, run.evictions FROM run JOIN m ON m.s = run.s AND m.k = run.k + 1)))))))
    SELECT s AS session_id, k AS messages, len(b)::BIGINT AS baselines, len(o)::BIGINT AS tail, ({total.format(b="b", o="o")})::BIGINT AS tokens, folds, evictions, mode FROM run
    QUALIFY row_number() OVER (PARTITION BY s ORDER BY k DESC) = 1"""


@query("ref_op268_compression_state", _compressed("session_id", "turn"))
def compression_state(spark, d):
    return compression.batch(C.records(spark, d))


@query("ref_op268_baseline_rollup", _compressed("workspace_id", "conv_id, turn"))
def baseline_rollup(spark, d):
    """A workspace's turns as one long session: baselines are merged, and dropped where the merged one is too large."""
    place = F.col("conv_id").cast("long") * 1_000_000 + F.col("turn")
    return compression.batch(C.records(spark, d).select(F.col("workspace_id").alias("session_id"), place.alias("turn"), "role", "content"))


SEEN = """seen AS (SELECT 'p' || user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 'b' || (event_id // 200) AS bundle, round(0.5 + event_id * 7 % 50 / 100.0, 2)::DOUBLE
    AS c, event_type = 'error' AND event_id % 3 = 0 AS mixed, CASE WHEN event_id % 97 = 5 THEN 'retire' WHEN event_id % 43 = 1 THEN 'hold' WHEN event_id % 41 = 0 THEN 'promote' END AS decision,
    event_type AS tag FROM events)"""
_SAID = "CASE decision WHEN 'retire' THEN 'retired' WHEN 'hold' THEN 'downgraded' WHEN 'promote' THEN 'reinforced' END"


@query("ref_op248_keyed_patterns", f"""WITH RECURSIVE {SEEN},
    run(id, k, n, dg, state, decay, confidence, bundle) AS (SELECT id, k, 1::BIGINT, (decision IS NOT DISTINCT FROM 'hold')::BIGINT, coalesce({_SAID}, 'candidate'), CASE decision WHEN 'retire' THEN 'stale'
        WHEN 'hold' THEN 'cooling' ELSE 'fresh' END, c, bundle FROM seen WHERE k = 1
    UNION ALL SELECT id, k, n, dg + (decision IS NOT DISTINCT FROM 'hold')::BIGINT, coalesce({_SAID}, state), CASE decision WHEN 'retire' THEN 'stale' WHEN 'hold' THEN 'cooling' WHEN 'promote' THEN 'fresh'
        ELSE decay END, confidence, bundle
    FROM (SELECT id, k, n, dg, state, confidence, bundle, decision, CASE WHEN again THEN decay WHEN state = 'retired' THEN 'stale' WHEN state = 'downgraded' OR dg >= 2 THEN CASE WHEN c >= 0.7 THEN 'cooling'
        ELSE 'stale' END WHEN n >= 3 OR c >= 0.85 THEN 'fresh' ELSE 'cooling' END AS decay
    FROM (SELECT *, CASE WHEN again THEN old_dg WHEN state = 'downgraded' THEN old_dg + 1 WHEN state = 'reinforced' THEN 0 ELSE old_dg END AS dg
    FROM (SELECT s.id, s.k, s.bundle, s.decision, s.c, r.decay, r.dg AS old_dg, r.bundle = s.bundle AS again, CASE WHEN r.bundle = s.bundle THEN r.n ELSE r.n + 1 END AS n, CASE WHEN r.bundle = s.bundle
        THEN greatest(r.confidence, s.c) ELSE least(0.99::DOUBLE, greatest(r.confidence, s.c) + 0.03::DOUBLE) END AS confidence, CASE WHEN r.bundle = s.bundle THEN r.state WHEN decision IS NOT NULL THEN {_SAID}
        WHEN r.state = 'retired' THEN 'retired' WHEN s.mixed OR s.c < r.confidence - 0.08::DOUBLE OR r.dg >= 2 THEN 'downgraded' ELSE 'reinforced' END AS state
    FROM run r JOIN seen s ON s.id = r.id AND s.k = r.k + 1))))
    SELECT id, n AS observations, dg AS downgrades, state, decay, round(confidence, 6) AS confidence, bundle, (SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM seen s WHERE s.id = run.id) AS tags FROM run
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""")
def keyed_patterns(spark, d):
    """Every event as an observation of its user's pattern by one of the bundles of 200 events."""
    k = F.col("event_id")
    decision = F.when(k % 97 == 5, "retire").when(k % 43 == 1, "hold").when(k % 41 == 0, "promote")
    seen = C.read(spark, d, "events").select(
        F.concat(F.lit("p"), "user_id").alias("id"), k.alias("at"), F.concat(F.lit("b"), F.floor(k / 200)).alias("bundle"), F.round(F.lit(0.5) + k * 7 % 50 / 100, 2).alias("confidence"),
        ((F.col("event_type") == "error") & (k % 3 == 0)).alias("mixed"), decision.alias("decision"), F.array("event_type").alias("tags"),
    )
    return reinforcement.batch(seen).withColumn("tags", F.array_join("tags", ","))


ACTIONS = """log AS (SELECT 'j' || user_id || '.' || (event_id // 3000) AS job_id, row_number() OVER (PARTITION BY user_id, event_id // 3000 ORDER BY event_id) AS k, event_id * 60000 AS t, CASE event_type
    WHEN 'view' THEN 'succeed' WHEN 'click' THEN 'fail' WHEN 'error' THEN CASE event_id % 5 WHEN 0 THEN 'fail_for_good' ELSE 'rerun' END WHEN 'purchase' THEN 'schedule' ELSE (['run', 'stop', 'resume', 'retry', 'resume'])
    [event_id % 5 + 1] END AS action, CASE WHEN event_type = 'purchase' OR event_id % 5 = 4 THEN event_id * 60000 + event_id % 7 * 3600000 END AS due FROM events)"""
#: One step of a job is what is due before the next row of its log, else that row; `q` are the times of its schedules.
STEPS = """run(job_id, k, clock, status, paused, dead, again, attempts, retries, q, event, step) AS (SELECT DISTINCT job_id, 0::BIGINT, 0::BIGINT, 'pending', FALSE, FALSE, FALSE, 0::BIGINT, 0::BIGINT, []::BIGINT[], '', 0::BIGINT FROM log
    UNION ALL SELECT job_id, k, clock, CASE WHEN begins THEN 'running' WHEN NOT ok THEN status WHEN a = 'schedule' THEN 'scheduled' WHEN a = 'stop' AND status <> 'running' THEN 'pending' WHEN a = 'resume' AND status
        <> 'running' THEN CASE WHEN due IS NOT NULL THEN 'scheduled' WHEN status = 'failed' THEN 'pending' ELSE status END WHEN a = 'succeed' THEN 'completed' WHEN fails THEN CASE WHEN dies THEN 'failed'
        ELSE 'scheduled' END ELSE status END, CASE WHEN ok AND a = 'stop' THEN TRUE WHEN ok AND a = 'resume' THEN FALSE ELSE paused END, dead OR dies, CASE WHEN fails THEN a = 'fail' WHEN ok AND a = 'succeed'
        THEN FALSE ELSE again END, attempts + begins::BIGINT, CASE WHEN fails THEN retries + 1 WHEN ok AND a = 'succeed' THEN 0 ELSE retries END, CASE WHEN late THEN list_sort(q)[2:] WHEN NOT ok THEN q WHEN a IN
        ('stop', 'succeed') OR dies THEN [] WHEN fails THEN [clock + least(60000 * 2 ** retries, 3600000)::BIGINT] WHEN a IN ('schedule', 'resume') AND due IS NOT NULL THEN list_append(q, due) ELSE q END,
        CASE WHEN late THEN CASE WHEN begins THEN 'dispatched ' ELSE 'missed ' END || a WHEN ok THEN a ELSE 'refused ' || a END, step + 1
    FROM (SELECT *, ok AND a IN ('fail', 'fail_for_good') AS fails, ok AND (a = 'fail_for_good' OR (a = 'fail' AND retries + 1 >= 3)) AS dies, ok AND a IN ('run', 'retry', 'rerun') AS begins
    FROM (SELECT *, CASE WHEN a IN ('run', 'retry', 'rerun') THEN NOT paused AND NOT dead AND status <> 'running' AND (a <> 'run' OR status IN ('pending', 'scheduled')) AND (a <> 'retry' OR (status IN ('failed', 'scheduled')
        AND again AND retries < 3)) WHEN a = 'schedule' THEN status <> 'running' AND NOT dead AND due IS NOT NULL WHEN a = 'stop' THEN TRUE WHEN a = 'resume' THEN NOT dead ELSE status = 'running' END AS ok
    FROM (SELECT job_id, CASE WHEN late THEN k ELSE k + 1 END AS k, CASE WHEN late THEN greatest(clock, list_min(q)) ELSE greatest(clock, t) END AS clock, status, paused, dead, again, attempts, retries, q, late, step, due,
        CASE WHEN NOT late THEN action WHEN status = 'failed' AND again THEN 'retry' WHEN attempts > 0 THEN 'rerun' ELSE 'run' END AS a
    FROM (SELECT r.*, l.t, l.action, l.due, len(r.q) > 0 AND NOT r.paused AND NOT r.dead AND list_min(r.q) <= coalesce(l.t, h.horizon) AS late FROM run r CROSS JOIN (SELECT max(event_id) * 60000 AS horizon FROM events) h
        LEFT JOIN log l ON l.job_id = r.job_id AND l.k = r.k + 1) WHERE late OR t IS NOT NULL))))"""


@query("ref_op284_scheduler", f"""WITH RECURSIVE {ACTIONS}, {STEPS} SELECT job_id, step, clock AS "at", event, CASE WHEN dead THEN 'dead_letter' ELSE status END AS status, paused, attempts, retries, len(q)::BIGINT AS pending,
    list_min(q) AS next_due FROM run WHERE step > 0""")
def import_scheduler(spark, d):
    """A user's events, 3,000 events of all at a time, as the log of a job with a minute between two events."""
    k, kind = F.col("event_id"), F.col("event_type")
    e = C.read(spark, d, "events")
    other = F.element_at(F.array(*map(F.lit, ("run", "stop", "resume", "retry", "resume"))), (k % 5 + 1).cast("int"))
    action = F.when(kind == "view", "succeed").when(kind == "click", "fail").when(kind == "error", F.when(k % 5 == 0, "fail_for_good").otherwise("rerun")).when(kind == "purchase", "schedule").otherwise(other)
    due = F.when((kind == "purchase") | (k % 5 == 4), k * 60_000 + k % 7 * 3_600_000)
    log = e.select(F.concat(F.lit("j"), "user_id", F.lit("."), F.floor(k / 3000)).alias("job_id"), (k * 60_000).alias("at"), k.alias("seq"), action.alias("action"), due.alias("due"))
    return scheduler.batch(log, e.agg(F.max("event_id")).first()[0] * 60_000)


def _lines(spark, d):
    """Each conversation as a transcript: every turn's parent is the turn before it, but turn 3 branches off turn 1."""
    c = C.read(spark, d, "conversations")
    parent = F.when(F.col("turn") == 3, F.lit(1)).otherwise(F.col("turn") - 1)
    body = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("t"), "turn").alias("id"), F.when(F.col("turn") > 0, F.concat(F.lit("t"), parent)).alias("parentId"), F.struct("role", F.col("text").alias("content")).alias("message")))
    return c.select(F.concat(F.lit("f"), "conv_id").alias("file"), F.col("turn").alias("line_no"), body.alias("json"))


@query("ref_op001_transcript_entries", "SELECT 'f' || conv_id AS file, count(*) AS n FROM conversations GROUP BY 1")
def transcript_entries(spark, d):
    return T.entries(_lines(spark, d)).groupBy("file").agg(F.count("*").alias("n"))


@query("ref_op002_resolve_branch", "SELECT 'f' || conv_id AS file, 't' || turn AS id FROM conversations c WHERE turn <> 2 OR (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id) = 2")
def resolve_branch(spark, d):
    return T.branches(T.entries(_lines(spark, d))).select("file", "id")


@query("ref_op003_transcript_messages", """SELECT 'f' || conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, CASE role WHEN 'user'
    THEN 'Intent' WHEN 'assistant' THEN 'Decision' ELSE 'State' END AS node_type FROM conversations c WHERE turn <> 2 OR (SELECT max(turn) FROM
    conversations x WHERE x.conv_id = c.conv_id) = 2""")
def transcript_messages(spark, d):
    return T.messages(T.branches(T.entries(_lines(spark, d)))).select("file", F.col("pos").cast("long").alias("pos"), "role", "node_type")


@query("ref_op007_messages_to_records", with_(RECORDS) + "SELECT id, source_type, created_at FROM records WHERE trim(content) <> ''")
def messages_to_records(spark, d):
    return C.records(spark, d).where(F.trim("content") != "").select("id", "source_type", "created_at")
