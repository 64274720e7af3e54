"""Import jobs, proposals, recommendations, extensions and workspaces of the control plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X

#: What each kind of source is parsed, normalised and materialised by; how often an attempt is repeated.
FLOWS = {"document": ("document_parser", "document", "source_entities"), "repo_structure": ("repo_structure_parser", "repo_structure", "source_entities"), "structured_input": ("structured_payload_parser", "structured_input", "runtime_ingest")}
MOST_RETRIES = 3
#: What a recommendation is expected to change: metric and difference.
DELTAS = {
    "threshold_tuning": (("runtime_transcript_fallback_ratio", -0.08),), "import_strategy": (("multi_source_coverage", 0.12),), "recall_strategy": (("recall_noise_rate", -0.05),),
    "promotion_strategy": (("promotion_quality", 0.07), ("knowledge_pollution_rate", -0.03)), "low_risk_automation": (("high_scope_reuse_intrusion", -0.01),),
}
#: Importers and the formats that they accept; policy templates.
IMPORTERS = (("document", "md,txt,html,pdf"), ("repo_structure", "json,tree,manifest"), ("structured_input", "json,jsonl,yaml"))
TEMPLATES = (("session-safe-alias", "session", "session_operator"), ("workspace-reviewed-rule", "workspace", "workspace_reviewer"), ("global-policy-change", "global", "global_reviewer"))


def stable_text(text: Column) -> Column:
    """Lines trimmed, blank ones left out."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def import_jobs(records: DataFrame) -> DataFrame:
    """A job of each ``session_id, workspace_id, source_kind`` of ``records`` (with ``id, path, content``): flow, dedupe key and source version.

    The version digests its records by id or path, each by the digest of its own content, so that a row holds short texts alone.
    """
    own = F.sha2(F.when(F.col("source_kind") == "structured_input", stable_text(F.col("content"))).otherwise(F.col("content")), 256)
    name = F.when(F.col("source_kind") == "repo_structure", F.col("path")).otherwise(F.col("id"))
    rows = records.withColumn("part", F.concat_ws(":", name, own))
    jobs = rows.groupBy("session_id", "workspace_id", "source_kind").agg(F.count("*").alias("n_records"), F.array_sort(F.collect_list("id")).alias("ids"), F.array_sort(F.collect_list("part")).alias("parts"))
    flow = lambda k: X.lookup(F.col("source_kind"), {s: v[k] for s, v in FLOWS.items()}, "string")
    return jobs.select(
        "session_id", "source_kind", flow(0).alias("parser"), flow(1).alias("normalizer"), flow(2).alias("materializer"), "n_records",
        F.concat_ws(":", "source_kind", "session_id", F.coalesce("workspace_id", F.lit("workspace:none")), F.array_join("ids", "|")).alias("dedupe_key"),
        F.concat(F.col("source_kind"), F.lit(":"), F.substring(F.sha2(F.array_join("parts", "|"), 256), 1, 16)).alias("source_version"),
    )


def repo_entity(path: Column) -> Column:
    """What kind of thing a path of a repository is."""
    low = F.lower(path)
    return (
        F.when(F.coalesce(low, F.lit("")) == "", "RepoEntity").when(low.rlike(r"\.(ts|tsx|js)$"), F.when(low.rlike(r"[\\/]api[\\/]"), "API").otherwise("File"))
        .when(low.endswith(".md"), "Document").when(low.rlike(r"\.(json|yaml|yml)$"), "Module").otherwise("RepoEntity")
    )


def attempt_allowed(action: Column) -> Column:
    """Why an attempt at a job (``status, paused, dead, attempts, retries, retriable``) is refused; null if it isn't."""
    status = F.col("status")
    return (
        F.when(F.col("paused"), "paused").when(F.col("dead"), "dead-lettered").when(status == "running", "already running")
        .when((action == "run") & ~status.isin("pending", "scheduled"), "must be pending or scheduled")
        .when((action == "retry") & ~status.isin("failed", "scheduled"), "must be failed").when((action == "retry") & ~F.col("retriable"), "not retriable")
        .when((action == "retry") & (F.col("retries") >= MOST_RETRIES), "reached max retry count")
    )


def schedule_allowed() -> Column:
    return F.when(F.col("status") == "running", "running").when(F.col("dead"), "dead-lettered")


def scheduled_action() -> Column:
    return F.when((F.col("status") == "failed") & F.col("retriable"), "retry").when(F.col("attempts") > 0, "rerun").otherwise("run")


def batch_action() -> Column:
    return F.when((F.col("status") == "failed") & F.col("retriable") & (F.col("retries") < MOST_RETRIES), "retry").when(F.col("attempts") > 0, "rerun").otherwise("run")


def stage_traces(attempts: DataFrame) -> DataFrame:
    """``job_id, failed_stage, retriable, completed, records`` of attempts' stages (``job_id, attempt, stage_no, stage, ok, records``).

    Stages after a failed one didn't run.  A failure in parsing can't be repeated.
    """
    w = Window.partitionBy("job_id", "attempt").orderBy("stage_no")
    ran = attempts.withColumn("failures", F.coalesce(F.sum((~F.col("ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("failures = 0")
    failed = F.max(F.when(~F.col("ok"), F.col("stage"))).alias("failed_stage")
    rows = ran.groupBy("job_id", "attempt").agg(failed, F.count_if("ok").alias("completed"), F.sum(F.when(F.col("ok"), F.col("records"))).alias("records"))
    return rows.withColumn("retriable", F.when(F.col("failed_stage").isNotNull(), F.col("failed_stage") != "parse"))


def overlaps(proposals: DataFrame, corrections: DataFrame) -> DataFrame:
    """``proposal_id, conflicting_id, scope, targets, severity``: other proposals of the scope, not rejected, on a target of the proposal.

    Counted by target, scope and action before anything is joined, so a common target costs a row a proposal on it.
    """
    c = corrections.join(proposals.where("status <> 'rejected'"), "proposal_id").select("proposal_id", "scope", F.concat_ws(":", "target_kind", "target_id").alias("target"), "action").distinct()
    b = c.select(F.col("proposal_id").alias("conflicting_id"), "scope", "target", F.col("action").alias("other"))
    pairs = c.join(b, ["scope", "target"]).where("proposal_id <> conflicting_id")
    return pairs.groupBy("proposal_id", "conflicting_id", "scope").agg(F.countDistinct("target").alias("targets"), F.when(F.max(F.col("action") != F.col("other")), "blocking").otherwise("warning").alias("severity"))


def global_overlaps(proposals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Workspace proposals that share a target with a global one that isn't rejected."""
    c = corrections.select("proposal_id", "target_kind", "target_id").distinct().join(proposals, "proposal_id")
    held = c.where("scope = 'global' and status <> 'rejected'").select("target_kind", "target_id").distinct()
    return c.where("scope = 'workspace'").join(held, ["target_kind", "target_id"], "left_semi").select("proposal_id").distinct()


def merge_suggestions(proposals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Targets that at least two proposals above session scope have."""
    c = corrections.join(proposals.where("scope <> 'session'").select("proposal_id"), "proposal_id")
    return c.groupBy("target_kind", "target_id").agg(F.countDistinct("proposal_id").alias("proposals"), F.min("proposal_id").alias("first")).where("proposals >= 2")


def recovery_plan(proposals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Of each applied proposal its targets, and whether it is to be rolled back first: global ones and those of several corrections."""
    c = corrections.groupBy("proposal_id").agg(F.count("*").alias("n"), F.countDistinct("target_id").alias("targets"))
    applied = proposals.where("status = 'applied'").join(c, "proposal_id")
    return applied.select("proposal_id", "targets", ((F.col("scope") == "global") | (F.col("n") > 1)).alias("rollback"))


def preview(corrections: DataFrame) -> DataFrame:
    """What each correction of a proposal would do, in words."""
    plain = F.concat_ws(" ", "action", "target_kind", F.lit("on"), "target_id")
    alias = F.concat(F.col("action"), F.lit(' alias "'), F.col("alias"), F.lit('" on '), F.col("target_id"))
    return corrections.select("proposal_id", "id", F.when((F.col("target_kind") == "concept_alias") & F.col("alias").isNotNull(), alias).otherwise(plain).alias("summary"))


def rollbacks(corrections: DataFrame) -> DataFrame:
    """The corrections that undo a proposal's, numbered in its order."""
    w = Window.partitionBy("proposal_id").orderBy("seq")
    return corrections.select("proposal_id", F.concat(F.col("id"), F.lit(":rollback:"), F.row_number().over(w)).alias("id"), F.when(F.col("action") == "rollback", "apply").otherwise("rollback").alias("action"))


def recommendations(facts: DataFrame) -> DataFrame:
    """``workspace_id, classification, severity, review`` by five rules over a workspace's alerts, noise, failed jobs and proposals."""
    rule = lambda when, name, severity, review: F.when(when, F.struct(F.lit(name).alias("classification"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(review).alias("review")))
    rules = F.array_compact(F.array(
        rule(F.col("fallback_alert"), "threshold_tuning", "warning", True),
        rule(F.col("failed_jobs") > 0, "import_strategy", F.when(F.col("dead_jobs") > 0, "critical").otherwise("warning"), True),
        rule(F.col("noise_status") != "healthy", "recall_strategy", "warning", False),
        rule((F.col("pending") > 3) | (F.col("global_proposals") > 2), "promotion_strategy", "warning", True),
        rule(F.col("alerts") == 0, "low_risk_automation", "info", False),
    ))
    return facts.select("workspace_id", F.explode(rules).alias("r")).select("workspace_id", "r.*")


def simulation(recommended: DataFrame) -> DataFrame:
    """Per workspace the metrics that its recommendations would change, and the risk of following them."""
    deltas = F.create_map(*(x for k, v in DELTAS.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(d).alias("delta")) for m, d in v)))))
    risk = F.when(F.count_if(F.col("severity") == "critical") > 0, "high").when(F.max("review") | (F.count("*") > 3), "medium").otherwise("low")
    rows = recommended.withColumn("d", deltas[F.col("classification")])
    return rows.groupBy("workspace_id").agg(F.count("*").alias("n"), risk.alias("risk"), F.max("review").alias("review"), F.sum(F.size("d")).alias("metrics"), F.round(F.sum(F.aggregate("d", F.lit(0.0), lambda a, x: a + x["delta"])), 6).alias("total_delta"))


def negotiated(requests: DataFrame, extensions: DataFrame) -> DataFrame:
    """Whether each request (``request_id, extension_id, api, required``) can use its extension (``id, api_version, capabilities, status, neutral, signature``)."""
    e = extensions.select(F.col("id").alias("extension_id"), "api_version", "capabilities", "status", "neutral", "signature")
    rows = requests.join(F.broadcast(e), "extension_id", "left")  # a registry is a short fixed list
    known = F.col("api_version").isNotNull()
    missing = F.when(known, F.array_except("required", "capabilities")).otherwise(F.col("required"))
    fits = known & (F.col("status") == "active") & (F.col("api_version") == F.col("api")) & (F.size(missing) == 0)
    warnings = F.when(~known, F.array(F.lit("extension is not registered"))).otherwise(F.array_compact(F.array(
        F.when(~F.col("neutral"), "extension is not marked provider-neutral"), F.when(F.col("status") != "active", F.concat(F.lit("extension status is "), "status")),
        F.when(F.col("api_version") != F.col("api"), F.concat(F.lit("requested api "), "api", F.lit(" does not match manifest api "), "api_version")),
    )))
    signing = F.when(~known | F.col("signature").isNull(), "unsigned").when(F.col("signature").startswith("sig:"), "trusted").when(F.col("signature").startswith("sha256:"), "unverified").otherwise("unsigned")
    return rows.select("request_id", F.coalesce(fits, F.lit(False)).alias("compatible"), F.size(missing).alias("n_missing"), F.array_join(warnings, "; ").alias("warnings"), signing.alias("signing"))


def isolation(workspaces: DataFrame, saved: DataFrame) -> DataFrame:
    """Each workspace's isolation: the newest saved policy, else the default."""
    newest = saved.groupBy("workspace_id").agg(F.max(F.struct("saved_at", "mode", "write")).alias("p"))
    shared = F.col("workspace_id") == "global"
    mode = F.coalesce("p.mode", F.when(shared, "shared_global").otherwise("isolated"))
    return workspaces.join(newest, "workspace_id", "left").select("workspace_id", mode.alias("mode"), F.coalesce("p.write", shared).alias("shared_write"), F.col("p").isNotNull().alias("saved"))


def thresholds(defaults: DataFrame, saved: DataFrame, asked: DataFrame) -> DataFrame:
    """``scope_id, metric, value``: a request's threshold, else the newest saved one, else the default."""
    s = saved.groupBy("scope_id", "metric").agg(F.max_by("value", "saved_at").alias("saved"))
    a = asked.groupBy("scope_id", "metric").agg(F.max_by("value", "asked_at").alias("asked"))
    scopes = saved.select("scope_id").union(asked.select("scope_id")).distinct()
    rows = scopes.crossJoin(F.broadcast(defaults))  # the defaults are a short fixed list
    return rows.join(s, ["scope_id", "metric"], "left").join(a, ["scope_id", "metric"], "left").select("scope_id", "metric", F.coalesce("asked", "saved", "value").alias("value"))
