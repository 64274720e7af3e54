"""Import jobs by a log of what is asked and what comes of attempts: due times, backoff, pause, dead letters.

A log's row says ``job_id, at, seq, action, due`` (times in milliseconds):

- ``schedule`` (at ``due``), ``run``, ``retry``, ``rerun``, ``stop``, ``resume`` (from ``due`` on, if given) are asked for;
- ``succeed``, ``fail`` and ``fail_for_good`` come from the attempt that runs; a failure that may be tried again is
  scheduled after a backoff, the third in a row and one for good make a dead letter.

What isn't allowed in a job's state is refused and changes nothing.  A schedule is dispatched when it is due, unless the
job is paused or dead; one that waited is dispatched when the job goes on.  The answer is a row for each row of the log
and each dispatch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomgraph.streaming.folds import folded, keyed

OUT = "job_id string, step long, at long, event string, status string, paused boolean, attempts long, retries long, pending long, next_due long"
NAMES = ("step", "clock", "status", "paused", "dead", "retriable", "attempts", "retries", "schedules")
COUNTERS = "step long, clock long, status string, paused boolean, dead boolean, retriable boolean, attempts long, retries long, schedules long"
#: Retries at most, failures in a row that make a dead letter, the first wait and the longest.
MOST_RETRIES, DEAD_AFTER, FIRST_WAIT, LONGEST_WAIT = 3, 3, 60_000, 3_600_000


class Job:
    """A job's counters, and when it is due: number of a schedule to its time."""

    def __init__(self, counters: tuple | None = None, due: dict[int, int] | None = None) -> None:
        for name, value in zip(NAMES, counters or (0, 0, "pending", False, False, False, 0, 0, 0), strict=True):
            setattr(self, name, value)
        self.due = dict(due or {})

    def counters(self) -> tuple:
        return tuple(getattr(self, n) for n in NAMES)

    def said(self, event: str) -> tuple:
        self.step += 1
        return (self.step, self.clock, event, "dead_letter" if self.dead else self.status, self.paused, self.attempts, self.retries, len(self.due), min(self.due.values(), default=None))

    def plan(self, due: int) -> None:
        self.schedules += 1
        self.due[self.schedules] = due

    def may(self, action: str) -> bool:
        """Whether an attempt may begin."""
        if self.paused or self.dead or self.status == "running":
            return False
        if action == "run":
            return self.status in ("pending", "scheduled")
        return action != "retry" or (self.status in ("failed", "scheduled") and self.retriable and self.retries < MOST_RETRIES)

    def begin(self) -> None:
        self.status, self.attempts = "running", self.attempts + 1

    def until(self, now: int) -> list[tuple]:
        """Dispatches what is due by ``now``, the earliest first."""
        done = []
        while self.due and not self.paused and not self.dead and min(self.due.values()) <= now:
            n = min(self.due, key=lambda k: (self.due[k], k))
            self.clock = max(self.clock, self.due.pop(n))
            action = "retry" if self.status == "failed" and self.retriable else "rerun" if self.attempts else "run"
            allowed = self.may(action)
            if allowed:
                self.begin()
            done.append(self.said(f"dispatched {action}" if allowed else f"missed {action}"))
        return done

    def take(self, at: int, action: str, due: int | None) -> list[tuple]:
        """What was due before a row of the log, and the row."""
        done = self.until(at)
        self.clock = max(self.clock, at)
        return [*done, self.said(action if self._apply(action, due) else f"refused {action}")]

    def _apply(self, action: str, due: int | None) -> bool:
        running = self.status == "running"
        if action in ("run", "retry", "rerun"):
            if not self.may(action):
                return False
            self.begin()
        elif action == "schedule":
            if running or self.dead or due is None:
                return False
            self.plan(due)
            self.status = "scheduled"
        elif action == "stop":
            self.paused, self.due = True, {}
            self.status = "running" if running else "pending"
        elif action == "resume":
            if self.dead:
                return False
            self.paused = False
            if due is not None:
                self.plan(due)
            self.status = "running" if running else "scheduled" if due is not None else "pending" if self.status == "failed" else self.status
        elif action == "succeed" and running:
            self.status, self.retriable, self.retries, self.due = "completed", False, 0, {}
        elif action in ("fail", "fail_for_good") and running:
            self.retries, self.retriable = self.retries + 1, action == "fail"
            self.dead = not self.retriable or self.retries >= DEAD_AFTER
            if self.dead or self.retries <= MOST_RETRIES:
                self.due = {}
            if not self.dead and self.retries <= MOST_RETRIES:
                self.plan(self.clock + min(FIRST_WAIT * 2 ** (self.retries - 1), LONGEST_WAIT))
            self.status = "scheduled" if self.due else "failed"
        else:
            return False
        return True


def _log(log: DataFrame) -> DataFrame:
    """A row without a time is taken at 0, one without an action is refused."""
    return log.select("job_id", F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce("action", F.lit("")).alias("action"), F.col("due").cast("long").alias("due"))


def batch(log: DataFrame, now: int | None = None) -> DataFrame:
    """The answer to a whole log, a job's rows taken in the order of ``at, seq``; with ``now`` what is due until then is dispatched, too."""

    def end(key: str | None, job: Job) -> list[tuple]:
        return [] if now is None else [(key, *x) for x in job.until(now)]

    named = _log(log).select("job_id", "at", "seq", "action", "due", F.col("job_id").alias("name"))
    return folded(named, "job_id", ["at", "seq", "action"], Job, lambda job, r: [(r[4], *x) for x in job.take(r[0], r[2], r[3])], end, OUT)


class Scheduler(StatefulProcessor):
    """``Job`` over a stream: counters and due times in keyed state, a timer at each due time."""

    def __init__(self, wall_clock: bool) -> None:
        self.wall_clock = wall_clock
        self.kinds = [StructType.fromDDL(x) for x in (COUNTERS, "n long", "due long")]
        self.names = StructType.fromDDL(OUT).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", self.kinds[0])
        self.due = handle.getMapState("due", self.kinds[1], self.kinds[2])

    def _job(self) -> tuple[Job, dict[int, int]]:
        due = {k[0]: v[0] for k, v in self.due.iterator()}
        return Job(tuple(self.state.get()) if self.state.exists() else None, due), due

    def _keep(self, job: Job, before: dict[int, int]) -> None:
        self.state.update(job.counters())
        for n in before.keys() - job.due.keys():
            self.due.removeKey((n,))
        for n in job.due.keys() - before.keys():
            self.due.updateValue((n,), (job.due[n],))
        # a paused or dead job waits for no time
        want = set() if job.paused or job.dead else set(job.due.values())
        have = set(self.handle.listTimers())
        for t in have - want:
            self.handle.deleteTimer(t)
        for t in want - have:
            self.handle.registerTimer(t)

    def _rows(self, key, done: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(self.names, (key[0], *x), strict=True))) for x in done)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        job, before = self._job()
        done = []
        for r in sorted(rows, key=lambda r: (r.at, r.seq or 0, r.action)):
            done += job.take(r.at, r.action, r.due)
        done += job.until(max(job.clock, timerValues.getCurrentProcessingTimeInMs()) if self.wall_clock else job.clock)
        self._keep(job, before)
        return self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job, before = self._job()
        done = job.until(expiredTimerInfo.getExpiryTimeInMs())
        self._keep(job, before)
        return self._rows(key, done)

    def close(self) -> None:
        pass


def stream(log: DataFrame, wall_clock: bool = True, late: str = "0 seconds") -> DataFrame:
    """The answer to a log that goes on.

    By the wall clock a schedule is dispatched at the first micro-batch after it is due; such a stream goes on until it is
    stopped, whatever its trigger.  Otherwise the log's own times
    are the clock: a schedule is dispatched when the log of all jobs has come ``late`` past its due time, and rows that
    are later than that, and those of time 0 or before, are dropped.  A job's rows must come in order from batch to batch.
    """
    keyed(log.sparkSession)
    rows = _log(log)
    if not wall_clock:
        rows = rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithState(Scheduler(wall_clock), StructType.fromDDL(OUT), "Append", "ProcessingTime" if wall_clock else "EventTime")
