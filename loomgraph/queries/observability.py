"""Queries of stage observability: events as evaluation reports of stages, conversations as runtime windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import observability as O
from loomgraph.queries.model_sql import RECORDS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

KINDS = ("view", "click", "purchase", "signup", "error")


def _reports(spark, d):
    """Every event is a report of the stage of its kind; every seventh has no path counts."""
    k = F.col("event_id")
    share = lambda a, n: (k * a % n) / n
    paths = lambda c: F.when(k % 7 > 0, c)
    return C.read(spark, d, "events").select(
        k.alias("report"), F.col("event_type").alias("stage"), F.floor(k / 250).alias("period"), (F.col("value") >= 5).alias("passed"), (k % 6).alias("selected"), F.least(k % 6, k % 4).alias("noise"), share(3, 11).alias("relation_precision"),
        share(5, 13).alias("relation_recall"), share(7, 17).alias("bundle_coverage"), share(2, 9).alias("explain_coverage"), share(4, 19).alias("concept_coverage"), share(11, 23).alias("usefulness"), share(6, 29).alias("intrusion"),
        F.least(F.lit(1.0), F.col("value") / 15).alias("knowledge_class_coverage"), F.least(F.lit(1.0), F.col("value") / 60).alias("pollution_rate"), share(8, 31).alias("reuse_benefit"),
        F.least(F.lit(1.0), F.col("value") / 40).alias("reuse_intrusion"), share(10, 37).alias("multi_source_coverage"), paths(k % 9).alias("candidate_paths"), paths(F.least(k % 9, k % 5)).alias("admitted_paths"),
        paths(k % 9 - F.least(k % 9, k % 5)).alias("pruned_paths"), paths(k % 12).alias("paths"),
    )


def _share(a, n):
    return f"(event_id * {a} % {n}) / {n}::DOUBLE"


def _paths(c):
    return f"CASE WHEN event_id % 7 > 0 THEN {c} ELSE 0 END"


_LEAST = "least(event_id % 9, event_id % 5)"
SNAPSHOTS = f"""snapshots AS (SELECT event_type AS stage, event_id // 250 AS period, count(*) AS fixtures, count(*) FILTER (WHERE value >= 5) AS passes, avg((value >= 5)::INT) AS pass_rate,
    avg(CASE WHEN event_id % 6 > 0 THEN least(event_id % 6, event_id % 4) / (event_id % 6)::DOUBLE ELSE 0 END) AS recall_noise_rate, avg({_share(3, 11)}) AS relation_precision, avg({_share(5, 13)}) AS relation_recall,
    avg({_share(7, 17)}) AS bundle_coverage, avg({_share(2, 9)}) AS explain_coverage, avg({_share(4, 19)}) AS concept_coverage, avg({_share(11, 23)}) AS memory_usefulness, avg({_share(6, 29)}) AS memory_intrusion,
    avg(least(1, value / 15)) AS promotion_quality, avg(least(1, value / 60)) AS knowledge_pollution_rate, avg({_share(8, 31)}) AS high_scope_reuse_benefit, avg(least(1, value / 40)) AS high_scope_reuse_intrusion,
    avg({_share(10, 37)}) AS multi_source_coverage, avg({_paths("event_id % 9")}) AS candidate_paths, avg({_paths(_LEAST)}) AS admitted_paths, avg(CASE WHEN event_id % 7 > 0 AND event_id % 9 > 0
    THEN (event_id % 9 - {_LEAST}) / (event_id % 9)::DOUBLE ELSE 0 END) AS path_prune_rate, sum({_paths("event_id % 12")})::BIGINT AS total_paths, sum({_paths(f"event_id % 9 - {_LEAST}")})::BIGINT AS total_pruned_paths
    FROM events GROUP BY 1, 2)"""
_MEANS = ("pass_rate", "recall_noise_rate", *O.MEANS, "candidate_paths", "admitted_paths", "path_prune_rate")


@query("ref_op115_stage_observability", f"WITH {SNAPSHOTS} SELECT stage, period, fixtures, passes, total_paths, total_pruned_paths, {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)} FROM snapshots")
def stage_observability(spark, d):
    return O.stage_snapshots(_reports(spark, d), "stage", "period", order="report").withColumns({c: F.round(c, 6) for c in _MEANS})


def _windows(spark, d):
    """Every conversation is a window: by its number live, persisted or from its transcript; tool results are what is compressed."""
    conv = F.col("conv_id")
    w = C.records(spark, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "tool").alias("compressed"), F.count("*").alias("final_messages"), F.max("created_at").alias("captured_at"))
    source = F.when(conv % 4 < 2, "live_runtime").when(conv % 4 == 2, "persisted_snapshot").otherwise("transcript_fallback")
    return w.select(F.element_at(F.array(*map(F.lit, KINDS)), (conv % 5 + 1).cast("int")).alias("stage"), F.floor(conv / 20).alias("period"), source.alias("source"), "compressed", "final_messages", "captured_at")


WINDOWS = f"""windows AS (SELECT ({list(KINDS)})[(conv_id % 5 + 1)::INT] AS stage, conv_id // 20 AS period, conv_id % 4 AS s, tools, n, captured_at FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'tool') AS tools,
    count(*) AS n, max(created_at) AS captured_at FROM records GROUP BY 1)),
summary AS (SELECT stage, period, count(*) AS samples, count(*) FILTER (WHERE s < 2) AS live, count(*) FILTER (WHERE s = 2) AS persisted, count(*) FILTER (WHERE s = 3) AS transcript_fallback, avg(tools) AS compressed,
    avg(n) AS final_messages, max(captured_at) AS captured_at FROM windows GROUP BY 1, 2)"""


@query("ref_op116_runtime_windows", with_(RECORDS, WINDOWS) + """SELECT stage, period, samples, live, persisted, transcript_fallback, round(compressed, 6) AS compressed, round(final_messages, 6) AS final_messages,
    captured_at FROM summary""")
def runtime_windows(spark, d):
    return O.runtime_windows(_windows(spark, d), "stage", "period").withColumns({c: F.round(c, 6) for c in ("compressed", "final_messages")})


_OF = {"runtime_live_window_ratio": "live / samples", "runtime_transcript_fallback_ratio": "transcript_fallback / samples", "runtime_average_compressed_count": "compressed", "runtime_average_final_message_count": "final_messages"}
#: Written out apart from the operator's table: key, label, unit, direction, threshold.
_LIMITS = """(VALUES ('runtime_live_window_ratio', 'Runtime live window ratio', 'ratio', 'min', 0.5), ('runtime_transcript_fallback_ratio', 'Runtime transcript fallback ratio', 'ratio', 'max', 0.4),
    ('runtime_average_compressed_count', 'Runtime average compressed count', 'count', NULL, NULL), ('runtime_average_final_message_count', 'Runtime average final message count', 'count', NULL, NULL),
    ('recall_noise_rate', 'Recall noise rate', 'ratio', 'max', 0.35), ('promotion_quality', 'Promotion quality', 'ratio', 'min', 0.6), ('knowledge_pollution_rate', 'Knowledge pollution rate', 'ratio', 'max', 0.2),
    ('high_scope_reuse_benefit', 'High-scope reuse benefit', 'ratio', 'min', 0.4), ('high_scope_reuse_intrusion', 'High-scope reuse intrusion', 'ratio', 'max', 0.25), ('multi_source_coverage', 'Multi-source coverage', 'ratio',
    'min', 0.5))"""
_REPORTED = ("recall_noise_rate", "promotion_quality", "knowledge_pollution_rate", "high_scope_reuse_benefit", "high_scope_reuse_intrusion", "multi_source_coverage")
DASHBOARD = f"""points AS (SELECT stage, period FROM snapshots UNION SELECT stage, period FROM summary),
figures AS (SELECT stage, period, unnest([{', '.join(f"{{'k': '{k}', 'v': {v}::DOUBLE, 'p': NULL::DOUBLE}}" for k, v in _OF.items())}]) AS f FROM summary
    UNION ALL SELECT stage, period, unnest([{', '.join(f"{{'k': '{k}', 'v': {k}, 'p': lag({k}) OVER w}}" for k in _REPORTED)}]) FROM snapshots WINDOW w AS (PARTITION BY stage ORDER BY period)),
cards AS (SELECT p.stage, p.period, l.metric, label, unit, direction, threshold::DOUBLE AS threshold, f.f.v AS value, f.f.p AS previous, CASE WHEN f.f.v IS NULL THEN 'unknown' WHEN direction IS NULL THEN 'healthy' WHEN direction
    = 'max' THEN CASE WHEN f.f.v <= threshold THEN 'healthy' WHEN f.f.v >= threshold * 1.5 THEN 'critical' ELSE 'warning' END WHEN f.f.v >= threshold THEN 'healthy' WHEN f.f.v <= threshold * 0.5 THEN 'critical' ELSE 'warning' END
    AS status FROM points p CROSS JOIN {_LIMITS} l(metric, label, unit, direction, threshold) LEFT JOIN figures f ON f.stage = p.stage AND f.period = p.period AND f.f.k = l.metric)"""
SAVED = {"high_scope_reuse_intrusion": 0.25}


def _dashboard(spark, d):
    return O.dashboard(O.stage_snapshots(_reports(spark, d), "stage", "period", order="report"), O.runtime_windows(_windows(spark, d), "stage", "period"), "stage", "period", SAVED)


@query("ref_op300_dashboard", with_(RECORDS, SNAPSHOTS, WINDOWS, DASHBOARD) + """SELECT stage, period, metric, label, unit, round(value, 6) AS value, round(previous, 6) AS previous, round(value - previous, 6) AS change,
    direction, threshold, status FROM cards""")
def dashboard(spark, d):
    return _dashboard(spark, d).withColumns({c: F.round(c, 6) for c in ("value", "previous", "change")})


@query("ref_op301_status_counts", with_(RECORDS, SNAPSHOTS, WINDOWS, DASHBOARD) + "SELECT metric, status, count(*) AS n FROM cards GROUP BY 1, 2")
def status_counts(spark, d):
    return _dashboard(spark, d).groupBy("metric", "status").agg(F.count("*").alias("n"))


@query("ref_op302_alert_messages", with_(RECORDS, SNAPSHOTS, WINDOWS, DASHBOARD) + """SELECT stage, period, metric, status AS severity, label || CASE direction WHEN 'max' THEN ' exceeded' ELSE ' fell below' END || ' threshold: current='
    || round(value::DECIMAL(20, 9), 2)::DECIMAL(20, 2) || ' threshold=' || round(threshold::DECIMAL(20, 9), 2)::DECIMAL(20, 2) AS message FROM cards WHERE status IN ('warning', 'critical')""")
def alert_messages(spark, d):
    return O.alerts(_dashboard(spark, d)).select("stage", "period", "metric", F.col("status").alias("severity"), "message")
