"""Promoted patterns as keyed state: each observation of a pattern by a bundle counts once, and changes its state and decay.

A manual decision that stands when a pattern is observed comes before what its counts say, and once more over the
result: one that is held counts a downgrade more, one that is promoted is fresh.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomgraph.streaming.folds import folded, keyed

OUT = "id string, observations long, downgrades long, state string, decay string, confidence double, bundle string, tags array<string>"
COUNTERS = "observations long, downgrades long, state string, decay string, confidence double, bundle string"
NAMES = ("observations", "downgrades", "state", "decay", "confidence", "bundle")
#: What one more bundle adds to a confidence and the most that it comes to; a fall by more is a downgrade.
GAIN, CEILING, FALL = 0.03, 0.99, 0.08


def _next_state(s: dict, n: int, confidence: float, mixed: bool, decision: str | None) -> str:
    if decision:
        return {"retire": "retired", "hold": "downgraded", "promote": "reinforced"}[decision]
    if s["state"] == "retired":
        return "retired"
    return "downgraded" if mixed or confidence < s["confidence"] - FALL or s["downgrades"] >= 2 else "reinforced"


def _decay(n: int, state: str, confidence: float, downgrades: int) -> str:
    if state == "retired":
        return "stale"
    if state == "downgraded" or downgrades >= 2:
        return "cooling" if confidence >= 0.7 else "stale"
    return "fresh" if n >= 3 or confidence >= 0.85 else "cooling"


def observed(s: dict | None, bundle: str, confidence: float, mixed: bool, decision: str | None) -> dict:
    """The pattern after one more observation; ``s`` is None at the first."""
    if s is None:
        s = dict(zip(NAMES, (1, 0, "candidate", "fresh", confidence, bundle), strict=True))
    elif s["bundle"] == bundle:
        s = s | {"confidence": max(s["confidence"], confidence)}
    else:
        n = s["observations"] + 1
        state = _next_state(s, n, confidence, mixed, decision)
        downgrades = {"downgraded": s["downgrades"] + 1, "reinforced": 0}.get(state, s["downgrades"])
        s = dict(zip(NAMES, (n, downgrades, state, _decay(n, state, confidence, downgrades), min(CEILING, max(s["confidence"], confidence) + GAIN), bundle), strict=True))
    over = {"retire": {"state": "retired", "decay": "stale"}, "hold": {"state": "downgraded", "decay": "cooling", "downgrades": s["downgrades"] + 1}, "promote": {"state": "reinforced", "decay": "fresh"}}
    return s | over.get(decision, {})


def _in_order(observations: DataFrame) -> DataFrame:
    """Observations as they are folded: a null bundle is an empty one, a null confidence 0, nothing said of mixed is not mixed."""
    return observations.select(
        "id", F.col("at").cast("long").alias("at"), F.coalesce("bundle", F.lit("")).alias("bundle"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce("mixed", F.lit(False)).alias("mixed"),
        F.when(F.col("decision").isin("retire", "hold", "promote"), F.col("decision")).alias("decision"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def _row(key: str | None, s: dict, tags) -> tuple:
    return (key, *(round(s[n], 6) if n == "confidence" else s[n] for n in NAMES), sorted(t for t in tags if t))


def batch(observations: DataFrame) -> DataFrame:
    """Every pattern (``id``) after all its observations ``at, bundle, confidence, mixed, decision, tags``, in the order of ``at``."""

    def step(held: dict, o: list) -> list:
        held["s"] = observed(held["s"], *o[1:5])
        held["tags"].update(o[5])
        return []

    return folded(_in_order(observations), "id", ["at", "bundle", "confidence"], lambda: {"s": None, "tags": set()}, step, lambda key, held: [_row(key, held["s"], held["tags"])], OUT)


class Reinforcement(StatefulProcessor):
    """``observed`` over a stream.  Tags are a map; a tag not seen for ``tag_ms`` (if given) is forgotten."""

    def __init__(self, tag_ms: int | None) -> None:
        self.tag_ms = tag_ms
        self.kinds = [StructType.fromDDL(x) for x in (COUNTERS, "tag string", "at long")]
        self.names = StructType.fromDDL(OUT).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", self.kinds[0])
        self.tags = handle.getMapState("tags", self.kinds[1], self.kinds[2], self.tag_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s = dict(zip(NAMES, self.counters.get(), strict=True)) if self.counters.exists() else None
        for o in sorted(rows, key=lambda r: (r.at, r.bundle, r.confidence)):
            s = observed(s, o.bundle, o.confidence, o.mixed, o.decision)
            for tag in filter(None, o.tags):
                self.tags.updateValue((tag,), (o.at or 0,))
        self.counters.update(tuple(s[n] for n in NAMES))
        yield Row(**dict(zip(self.names, _row(key[0], s, [t[0] for t in self.tags.keys()]), strict=True)))

    def close(self) -> None:
        pass


def stream(observations: DataFrame, tag_ms: int | None = None) -> DataFrame:
    """The same over a stream: each micro-batch gives the patterns that it observes, as they are then."""
    keyed(observations.sparkSession)
    return _in_order(observations).groupBy("id").transformWithState(Reinforcement(tag_ms), StructType.fromDDL(OUT), "Update", "ProcessingTime" if tag_ms else "None")
