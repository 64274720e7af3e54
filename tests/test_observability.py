"""What the driver's tables don't show of observability: nothing to report, nothing selected, a threshold of zero, a stage on one side only."""

from __future__ import annotations

from loomgraph.operators import observability as O

REPORT = "stage string, period int, passed boolean, selected int, noise int, " + ", ".join(f"{c} double" for c in O.MEANS.values()) + ", candidate_paths int, admitted_paths int, pruned_paths int, paths int"
WINDOW = "stage string, period int, source string, compressed int, final_messages int, captured_at string"


def report(stage, period, passed, selected, noise, paths=(None,) * 4, pollution=0.3):
    return (stage, period, passed, selected, noise, *(pollution if c == "pollution_rate" else 0.5 for c in O.MEANS.values()), *paths)


def test_snapshots_and_cards(spark):
    reports = spark.createDataFrame([report("a", 1, True, 4, 1, (4, 3, 1, 7)), report("a", 1, None, 0, 0), report("a", 2, False, 2, 2, pollution=0.45), report("b", 1, True, 1, 0)], REPORT)
    s = {(r.stage, r.period): r for r in O.stage_snapshots(reports, "stage", "period").collect()}
    r = s["a", 1]
    assert (r.fixtures, r.passes, r.pass_rate, r.recall_noise_rate, r.candidate_paths, r.path_prune_rate, r.total_paths, r.total_pruned_paths) == (2, 1, 0.5, 0.125, 2.0, 0.125, 7, 1)
    windows = spark.createDataFrame([("a", 2, "live_runtime", 3, 9, "2024-01-02"), ("a", 2, "transcript_fallback", 0, 4, None), ("a", 2, "transcript_fallback", 0, 2, None), ("c", 1, "persisted_snapshot", 1, 1, None)], WINDOW)
    w = O.runtime_windows(windows, "stage", "period")
    assert {(x.stage, x.samples, x.live, x.persisted, x.transcript_fallback, x.compressed, x.final_messages, x.captured_at) for x in w.collect()} == {("a", 3, 1, 0, 2, 1.0, 5.0, "2024-01-02"), ("c", 1, 0, 1, 0, 1.0, 1.0, None)}
    cards = O.dashboard(O.stage_snapshots(reports, "stage", "period"), w, "stage", "period", {"recall_noise_rate": 0.0})
    got = {(x.stage, x.period, x.metric): x for x in cards.collect()}
    assert len(got) == 4 * 10
    of = lambda *key: (got[key].status, got[key].value, got[key].previous, got[key].change)
    assert of("a", 1, "recall_noise_rate") == ("critical", 0.125, None, None) and of("b", 1, "recall_noise_rate") == ("healthy", 0.0, None, None)
    assert of("a", 2, "recall_noise_rate") == ("critical", 1.0, 0.125, 0.875) and of("a", 2, "runtime_average_compressed_count") == ("healthy", 1.0, None, None)
    assert of("c", 1, "promotion_quality") == ("unknown", None, None, None) and of("b", 1, "runtime_live_window_ratio")[0] == "unknown"
    assert of("a", 1, "promotion_quality")[0] == "warning" and of("a", 2, "knowledge_pollution_rate")[0] == "critical"
    said = {(x.stage, x.period, x.metric): x.message for x in O.alerts(cards).collect()}
    assert said["a", 2, "knowledge_pollution_rate"] == "Knowledge pollution rate exceeded threshold: current=0.45 threshold=0.20"
    assert said["a", 2, "runtime_live_window_ratio"] == "Runtime live window ratio fell below threshold: current=0.33 threshold=0.50"
    assert said["a", 1, "recall_noise_rate"].endswith("current=0.13 threshold=0.00") and not any(k[2].endswith("count") for k in said)
    empty = O.dashboard(O.stage_snapshots(reports.limit(0), "stage", "period"), O.runtime_windows(windows.limit(0), "stage", "period"), "stage", "period")
    assert empty.collect() == []


def test_means_at_a_threshold_by_order_not_by_files(spark):
    """Shares whose mean is a threshold: however they are dealt, the sum is that in order, to the last place."""
    shares = [(3 * k * 10 % 37) / 37 for k in range(37)]
    total = 0.0
    for x in shares:
        total += x
    rows = [("a", 1, k, True, 1, 0, *(x if c == "multi_source_coverage" else 0.5 for c in O.MEANS.values()), None, None, None, None) for k, x in enumerate(shares)]
    schema = REPORT.replace("period int,", "period int, report int,", 1)
    for parts in ([rows], [rows[::2], rows[1::2]], [rows[::-1]], [rows[k::7] for k in range(7)]):
        frame = spark.createDataFrame(spark.sparkContext.parallelize([r for part in parts for r in part], len(parts)), schema)
        (r,) = O.stage_snapshots(frame, "stage", "period", order="report").collect()
        assert (r.fixtures, r.multi_source_coverage) == (37, total / 37)


def test_half_as_much_again_is_critical(spark):
    """0.2 and 0.4 times 1.5 as doubles are above 0.3 and 0.6, which are critical."""
    reports = spark.createDataFrame([report("a", 1, True, 4, 1, pollution=0.3)], REPORT)
    windows = spark.createDataFrame([("a", 1, "live_runtime", 0, 1, None)] * 2 + [("a", 1, "transcript_fallback", 0, 1, None)] * 3, WINDOW)
    cards = O.dashboard(O.stage_snapshots(reports, "stage", "period"), O.runtime_windows(windows, "stage", "period"), "stage", "period")
    got = {x.metric: x.status for x in cards.collect()}
    assert got["knowledge_pollution_rate"] == got["runtime_transcript_fallback_ratio"] == "critical"
