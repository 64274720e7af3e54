"""Observability of stages: evaluation reports and runtime windows as snapshots, and the dashboard's cards and alerts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.control import metric_status

#: Means of a snapshot, and the report's column that each is the mean of.
MEANS = {
    "relation_precision": "relation_precision", "relation_recall": "relation_recall", "bundle_coverage": "bundle_coverage", "explain_coverage": "explain_coverage", "concept_coverage": "concept_coverage",
    "memory_usefulness": "usefulness", "memory_intrusion": "intrusion", "promotion_quality": "knowledge_class_coverage", "knowledge_pollution_rate": "pollution_rate", "high_scope_reuse_benefit": "reuse_benefit",
    "high_scope_reuse_intrusion": "reuse_intrusion", "multi_source_coverage": "multi_source_coverage",
}
#: The dashboard's cards: key, label, unit, direction and value of the threshold (none: always healthy).
CARDS = (
    ("runtime_live_window_ratio", "Runtime live window ratio", "ratio", "min", 0.5),
    ("runtime_transcript_fallback_ratio", "Runtime transcript fallback ratio", "ratio", "max", 0.4),
    ("runtime_average_compressed_count", "Runtime average compressed count", "count", None, None),
    ("runtime_average_final_message_count", "Runtime average final message count", "count", None, None),
    ("recall_noise_rate", "Recall noise rate", "ratio", "max", 0.35),
    ("promotion_quality", "Promotion quality", "ratio", "min", 0.6),
    ("knowledge_pollution_rate", "Knowledge pollution rate", "ratio", "max", 0.2),
    ("high_scope_reuse_benefit", "High-scope reuse benefit", "ratio", "min", 0.4),
    ("high_scope_reuse_intrusion", "High-scope reuse intrusion", "ratio", "max", 0.3),
    ("multi_source_coverage", "Multi-source coverage", "ratio", "min", 0.5),
)


def _share(part: str, whole: str) -> Column:
    """0 where there is nothing that could be a part."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def stage_snapshots(reports: DataFrame, *by: str, order: str | None = None) -> DataFrame:
    """Counts, means and totals of the reports of each group: what passes, recall and its noise, coverage, memory, reuse, paths.

    A report that has no path counts has none; groups without reports have no row.  With ``order`` the shares of a group
    are summed in this column's order, so that a mean at a threshold doesn't fall on another side by how files were split;
    a group is then summed by one task, which spills what it can't hold.
    """
    paths = [F.coalesce(c, F.lit(0)).alias(c) for c in ("candidate_paths", "admitted_paths", "pruned_paths", "paths")]
    r = reports.select(*by, *([order] if order else []), "passed", "selected", "noise", *MEANS.values(), *paths)
    means = {"recall_noise_rate": F.avg(_share("noise", "selected")), **{name: F.avg(c) for name, c in MEANS.items()}, "path_prune_rate": F.avg(_share("pruned_paths", "candidate_paths"))}
    if order:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        r = r.withColumns({f"mean_{name}": mean.over(w) for name, mean in means.items()})
        means = {name: F.first(f"mean_{name}") for name in means}
    mean = lambda name: means[name].alias(name)
    return r.groupBy(*by).agg(
        F.count("*").alias("fixtures"), F.count_if("passed").alias("passes"), F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"), mean("recall_noise_rate"),
        *(mean(name) for name in MEANS), F.avg("candidate_paths").alias("candidate_paths"), F.avg("admitted_paths").alias("admitted_paths"),
        mean("path_prune_rate"), F.sum("paths").alias("total_paths"), F.sum("pruned_paths").alias("total_pruned_paths"),
    )


def runtime_windows(windows: DataFrame, *by: str) -> DataFrame:
    """Windows of each group (``source, compressed, final_messages, captured_at``): counts by source, means, the latest capture."""
    of = lambda source: F.count_if(F.col("source") == source)
    return windows.groupBy(*by).agg(
        F.count("*").alias("samples"), of("live_runtime").alias("live"), of("persisted_snapshot").alias("persisted"), of("transcript_fallback").alias("transcript_fallback"), F.avg("compressed").alias("compressed"),
        F.avg("final_messages").alias("final_messages"), F.max("captured_at").alias("captured_at"),
    )


def dashboard(snapshots: DataFrame, windows: DataFrame, stage: str, point: str, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The ten cards of each stage at each point of its history; ``thresholds`` by key stand before the defaults.

    What no report or window tells is unknown.  The value before, and the change since, are those of the stage's last
    snapshot; cards of runtime windows have none.
    """
    limits = {k: v for k, _, _, _, v in CARDS} | (thresholds or {})
    of_reports = [k for k, *_ in CARDS[4:]]
    w = Window.partitionBy(stage).orderBy(point)
    s = snapshots.select(stage, point, *of_reports, *(F.lag(k).over(w).alias(f"before_{k}") for k in of_reports))
    ratio = lambda c: F.col(c) / F.col("samples")
    r = windows.select(stage, point, ratio("live").alias(CARDS[0][0]), ratio("transcript_fallback").alias(CARDS[1][0]), F.col("compressed").alias(CARDS[2][0]), F.col("final_messages").alias(CARDS[3][0]))

    def card(key: str, label: str, unit: str, direction: str | None) -> Column:
        before = F.col(f"before_{key}") if key in of_reports else F.lit(None)
        parts = {"metric": F.lit(key), "label": F.lit(label), "unit": F.lit(unit), "value": F.col(key), "previous": before, "direction": F.lit(direction), "threshold": F.lit(limits[key])}
        return F.struct(*(c.cast("double" if n in ("value", "previous", "threshold") else "string").alias(n) for n, c in parts.items()))

    cards = s.join(r, [stage, point], "full").select(stage, point, F.explode(F.array(*(card(*c[:4]) for c in CARDS))).alias("c")).select(stage, point, "c.*")
    status = F.when(F.col("value").isNull(), "unknown").when(F.col("direction").isNull(), "healthy").otherwise(metric_status(F.col("value"), F.col("direction"), F.col("threshold"), places=9))
    known = F.when(F.col("value").isNotNull(), F.col("previous"))
    return cards.withColumns({"status": status, "previous": known, "change": F.col("value") - known})


def alerts(cards: DataFrame) -> DataFrame:
    """A message for each card that warns or is critical; figures are rounded as decimals, halves up, so that no order of summing shows."""
    decimal = lambda c, n: F.round(F.col(c).cast("decimal(20,9)"), n).cast(f"decimal(20,{n})").cast("string")
    shown = lambda c: F.when(F.col("unit") == "count", decimal(c, 1)).otherwise(decimal(c, 2))
    said = F.concat("label", F.when(F.col("direction") == "max", " exceeded").otherwise(" fell below"), F.lit(" threshold: current="), shown("value"), F.lit(" threshold="), shown("threshold"))
    return cards.where(F.col("status").isin("warning", "critical")).withColumn("message", said)
