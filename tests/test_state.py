"""Keyed state: streams of several micro-batches, with a restart between them, end where the batch over all rows does."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.streaming import compression, reinforcement, scheduler


def tokens(text):
    return max(1, math.ceil(len(text) / 4))


def compressed(messages, budget=400):
    """A session's compression by its definition: all open messages and baselines looked at again for each message."""
    tail, baselines, folds, evictions, mode = [], [], 0, 0, "none"
    for role, text in messages:
        tail.append((role, text or ""))
        users = [k for k, (r, _) in enumerate(tail) if r == "user"]
        old = users[-2] if len(users) >= 3 else 0
        mode = "incremental" if old else "none"
        if old and sum(tokens(t) for _, t in tail) + sum(tokens(b) for b in baselines) > budget / 2:
            lines = [f"{r}: {' '.join(t.split())[:120]}" for r, t in tail[:old]]
            baselines.append("\n".join(lines[-8:])[:1200])
            del tail[:old]
            folds, mode = folds + 1, "full"
            if len(baselines) > 3:
                both = baselines[0] + "\n" + baselines[1]
                if tokens(both) <= budget / 2:
                    baselines[:2] = [both]
                else:
                    del baselines[0]
                    evictions += 1
    return len(messages), len(baselines), len(tail), sum(tokens(t) for _, t in tail) + sum(tokens(b) for b in baselines), folds, evictions, mode


def streamed(spark, tmp_path, rows, place, make, mode, parts=4, endless=False):
    """What a stream of ``parts`` files gives; it is stopped after the first half of them and started again.

    A stream with timers by the wall clock never ends of itself: it is stopped when it has taken all rows.
    """
    out = str(tmp_path / "out")

    def go(size):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
        keep = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/{k:04d}")
        q = make(source).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check"))
        q = (q if endless else q.trigger(availableNow=True)).start()
        for _ in range(240 if endless else 0):
            if not q.isActive or q.awaitTermination(0.25) or sum(p.numInputRows for p in q.recentProgress) >= size:
                break
        if endless:
            q.stop()
        assert q.awaitTermination(240)

    size = 0
    for k in range(parts):
        part = rows.where(F.floor(F.col(place) * parts) == k)
        size += part.count()
        part.coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
        if k == parts // 2 - 1 or k == parts - 1:
            go(size)
            size = 0
    return spark.read.parquet(f"{out}/*").collect()


def latest(rows, key, columns):
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r[key]] = tuple(r[c] for c in columns)
    return last


def test_compression(spark, tmp_path):
    said = [(f"s{k % 3}" if k % 4 else None if k % 8 else "long", k, ("user", "assistant", "tool", None)[(k + k // 7) % 4], None if k % 31 == 5 else "word " * (k * 7 % 90), k / 300) for k in range(300)]
    rows = spark.createDataFrame(said, "session_id string, turn long, role string, content string, place double")
    got = {r.session_id: tuple(r)[1:] for r in compression.batch(rows).collect()}
    talks = {}
    for s, _, role, text, _ in said:
        talks.setdefault(s, []).append((role, text))
    assert got == {s: compressed(m) for s, m in talks.items()}
    assert all(x[4] > 2 for x in got.values()) and any(x[5] for x in got.values())
    assert compression.batch(rows.limit(0)).collect() == []
    columns = compression.OUT.replace(",", "").split()[2::2]
    assert latest(streamed(spark, tmp_path, rows, "place", compression.stream, "update"), "session_id", columns) == got


def test_compression_forgets_idle_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("s", k, "user", "word " * 100, k / 4) for k in range(4)], "session_id string, turn long, role string, content string, place double")
    found = streamed(spark, tmp_path, rows, "place", lambda m: compression.stream(m, idle_ms=1), "update", parts=2, endless=True)
    assert [r.messages for r in sorted(found, key=lambda r: r.batch)] == [2, 2], "what was said before the silence is forgotten"


def test_patterns(spark, tmp_path):
    decisions = {3: "hold", 50: "promote", 77: "retire", 90: "unknown"}
    seen = [(f"p{k % 3}", k, None if k == 8 else f"b{k // 5 % 9}", None if k == 13 else 0.5 + k * 37 % 50 / 100, k % 17 == 0 if k % 2 else None, decisions.get(k), None if k % 4 else ["t", f"t{k % 5}"], k / 120) for k in range(120)]
    rows = spark.createDataFrame(seen, "id string, at long, bundle string, confidence double, mixed boolean, decision string, tags array<string>, place double")
    columns = reinforcement.OUT.replace("array<string>", "string").replace(",", "").split()[2::2]
    got = {r.id: tuple(r[c] for c in columns) for r in reinforcement.batch(rows).collect()}
    # within a run of one bundle a pattern counts once
    runs = {p: 1 + sum(a != b for a, b in zip(x, x[1:])) for p in got for x in [[o[2] or "" for o in seen if o[0] == p]]}
    assert {p: x[0] for p, x in got.items()} == runs and got["p2"][2] == "retired" and got["p0"][2] != "retired"
    assert reinforcement.batch(rows.limit(0)).collect() == []
    assert latest(streamed(spark, tmp_path, rows, "place", reinforcement.stream, "update"), "id", columns) == got


MINUTE = 60_000


def answers(spark, log, now=None):
    rows = spark.createDataFrame([("j", at * MINUTE, k, action, None if due is None else due * MINUTE) for k, (at, action, due) in enumerate(log)], "job_id string, at long, seq long, action string, due long")
    found = sorted(scheduler.batch(rows, None if now is None else now * MINUTE).collect(), key=lambda r: r.step)
    return [(r.at // MINUTE, r.event, r.status, r.retries) for r in found]


def test_scheduler_backs_off_and_gives_up(spark):
    got = answers(spark, [(0, "schedule", 5), (6, "fail", None), (7, "fail", None), (10, "fail", None), (11, "resume", 12), (12, "run", None)], 99)
    assert got == [
        (0, "schedule", "scheduled", 0), (5, "dispatched run", "running", 0), (6, "fail", "scheduled", 1), (7, "dispatched rerun", "running", 1), (7, "fail", "scheduled", 2), (9, "dispatched rerun", "running", 2),
        (10, "fail", "dead_letter", 3), (11, "refused resume", "dead_letter", 3), (12, "refused run", "dead_letter", 3),
    ]
    assert answers(spark, [(0, "run", None), (1, "fail_for_good", None), (2, "schedule", 3)], 9)[1:] == [(1, "fail_for_good", "dead_letter", 1), (2, "refused schedule", "dead_letter", 1)]


def test_scheduler_pauses(spark):
    got = answers(spark, [(0, "schedule", 9), (1, "stop", None), (2, "schedule", 3), (5, "run", None), (6, "resume", None), (7, "succeed", None), (8, "run", None), (8, "rerun", None), (8, "schedule", 9), (9, "stop", None), (9, None, None)], 30)
    assert got == [
        (0, "schedule", "scheduled", 0), (1, "stop", "pending", 0), (2, "schedule", "scheduled", 0), (5, "refused run", "scheduled", 0), (6, "resume", "scheduled", 0), (6, "dispatched run", "running", 0),
        (7, "succeed", "completed", 0), (8, "refused run", "completed", 0), (8, "rerun", "running", 0), (8, "refused schedule", "running", 0), (9, "stop", "running", 0), (9, "refused ", "running", 0),
    ]


def log_of_many(spark):
    kinds = ("schedule", "succeed", "fail", "resume", "run", "fail", "stop", "rerun", "fail_for_good", "retry")
    rows = [(f"j{k % 7}", (k + 1) * MINUTE, k, kinds[k * k * 3 % 10 if k % 3 else k % 6], (k + k % 40) * MINUTE if k % 2 else None, k / 210) for k in range(210)]
    return spark.createDataFrame(rows, "job_id string, at long, seq long, action string, due long, place double")


def test_scheduler_by_the_logs_clock(spark, tmp_path):
    """Timers at due times give what one pass over the whole log gives, up to the watermark, which begins at time 0."""
    log = log_of_many(spark)
    got = sorted((tuple(r)[:-1] for r in streamed(spark, tmp_path, log, "place", lambda x: scheduler.stream(x, wall_clock=False), "append")), key=repr)
    want = sorted(map(tuple, scheduler.batch(log, 210 * MINUTE).collect()), key=repr)
    kinds = Counter(x[3].split()[0] for x in want)
    assert kinds["dispatched"] > 5 and kinds["refused"] > 20 and kinds["fail"] > 3
    # the last timers wait until the watermark has passed the end of the log
    assert set(got) <= set(want) and all(x[3].startswith(("dispatched", "missed")) and x[2] >= 209 * MINUTE for x in set(want) - set(got))
    assert scheduler.batch(log.limit(0), 5).collect() == []


def test_scheduler_by_the_wall_clock(spark, tmp_path):
    """Dues in the past are dispatched at once, one in a far future isn't."""
    log = spark.createDataFrame([("a", 1, 1, "schedule", 2, 0.0), ("b", 1, 1, "schedule", 2**45, 0.0), ("a", 3, 2, "succeed", None, 0.6)], "job_id string, at long, seq long, action string, due long, place double")
    got = streamed(spark, tmp_path, log, "place", scheduler.stream, "append", parts=2, endless=True)
    assert sorted((r.job_id, r.step, r.event) for r in got) == [("a", 1, "schedule"), ("a", 2, "dispatched run"), ("a", 3, "succeed"), ("b", 1, "schedule")]
