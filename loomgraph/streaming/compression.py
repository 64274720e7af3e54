"""Session compression as keyed state: counters and two lists, folded message by message, alike in batch and in a stream.

The state of a session is its baselines, a line for each message that is not yet folded, and counters.  New turns first
go to the raw tail; older ones are summarised into a baseline when the tokens pass a share of the budget, and when there
are too many baselines the oldest half is merged, or the oldest dropped if the merged one would be too large.  A message
adds to one list and changes the counters; lists are read only when a baseline is made.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomgraph.streaming.folds import folded, keyed

OUT = "session_id string, messages long, baselines long, tail long, tokens long, folds long, evictions long, mode string"
COUNTERS = "messages long, baselines long, tail long, tokens long, folds long, evictions long, mode string, starts array<long>"
TAIL_TURNS, RATIO, MOST, BASELINE_CHARS, LINE_CHARS, LINES = 2, 0.5, 3, 1200, 120, 8


def tokens(text: str) -> int:
    return max(1, -(-len(text) // 4))


class Lists:
    """A session's lists in memory: ``(line, tokens)`` of each message of the tail, and the baselines' texts."""

    def __init__(self) -> None:
        self.tail, self.baselines = [], []

    def add(self, line: tuple[str, int]) -> None:
        self.tail.append(line)


class Kept:
    """The same lists in the state of a stream."""

    def __init__(self, tail, baselines) -> None:
        self._tail, self._baselines = tail, baselines

    def add(self, line: tuple[str, int]) -> None:
        self._tail.appendValue(line)

    tail = property(lambda self: [tuple(x) for x in self._tail.get()], lambda self, lines: self._tail.put(lines))
    baselines = property(lambda self: [x[0] for x in self._baselines.get()], lambda self, texts: self._baselines.put([(t,) for t in texts]))


def start() -> dict:
    return {"messages": 0, "baselines": 0, "tail": 0, "tokens": 0, "folds": 0, "evictions": 0, "mode": "none", "starts": []}


def fold(s: dict, held: Lists | Kept, role: str | None, content: str | None, budget: int) -> None:
    """One more message; a null content is an empty one."""
    text = content or ""
    if role == "user":
        # places in the tail where the last turns begin: one more than stay raw says that there is something to fold
        s["starts"] = [*s["starts"], s["tail"]][-TAIL_TURNS - 1 :]
    held.add((f"{role}: {' '.join(text.split())[:LINE_CHARS]}", tokens(text)))
    s["messages"], s["tail"], s["tokens"] = s["messages"] + 1, s["tail"] + 1, s["tokens"] + tokens(text)
    cut = s["starts"][-TAIL_TURNS] if len(s["starts"]) > TAIL_TURNS else 0
    s["mode"] = "incremental" if cut else "none"
    if not cut or s["tokens"] / budget <= RATIO:
        return
    tail, baselines = held.tail, held.baselines
    baselines.append("\n".join(line for line, _ in tail[max(0, cut - LINES) : cut])[:BASELINE_CHARS])
    s["tokens"] += tokens(baselines[-1]) - sum(n for _, n in tail[:cut])
    while len(baselines) > MOST:
        n = max(2, len(baselines) // 2)
        merged = "\n".join(baselines[:n])
        if tokens(merged) <= budget * RATIO:
            s["tokens"] += tokens(merged) - sum(map(tokens, baselines[:n]))
            baselines = [merged, *baselines[n:]]
        else:
            s["tokens"] -= tokens(baselines[0])
            s["evictions"] += 1
            baselines = baselines[1:]
            break
    held.tail, held.baselines = tail[cut:], baselines
    s["starts"] = [k - cut for k in s["starts"][-TAIL_TURNS:]]
    s["tail"], s["baselines"], s["folds"], s["mode"] = s["tail"] - cut, len(baselines), s["folds"] + 1, "full"


def row(session_id: str | None, s: dict) -> tuple:
    return (session_id, s["messages"], s["baselines"], s["tail"], s["tokens"], s["folds"], s["evictions"], s["mode"])


def batch(messages: DataFrame, budget: int = 400) -> DataFrame:
    """The state of every session (``session_id, turn, role, content``) after all its messages."""

    def step(state: tuple, message: list) -> list:
        fold(*state, message[1], message[2], budget)
        return []

    return folded(messages.select("session_id", "turn", "role", "content"), "session_id", ["turn", "role", "content"], lambda: (start(), Lists()), step, lambda key, state: [row(key, state[0])], OUT)


class Compression(StatefulProcessor):
    """``fold`` over a stream; a session that says nothing for ``idle_ms`` (if given) is forgotten as a whole."""

    def __init__(self, budget: int, idle_ms: int | None) -> None:
        self.budget, self.idle_ms = budget, idle_ms
        self.kinds = [StructType.fromDDL(x) for x in (COUNTERS, "line string, tokens long", "text string")]
        self.names = StructType.fromDDL(OUT).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", self.kinds[0])
        self.tail = handle.getListState("tail", self.kinds[1])
        self.baselines = handle.getListState("baselines", self.kinds[2])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = list(start())
        s = dict(zip(names, self.counters.get(), strict=True)) if self.counters.exists() else start()
        s["starts"] = list(s["starts"])
        held = Kept(self.tail, self.baselines)
        for message in sorted(rows, key=lambda r: (r.turn, r.role or "", r.content or "")):
            fold(s, held, message.role, message.content, self.budget)
        self.counters.update(tuple(s[n] for n in names))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield Row(**dict(zip(self.names, row(key[0], s), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.counters, self.tail, self.baselines):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream(messages: DataFrame, budget: int = 400, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream: each micro-batch gives the new state of the sessions that it touches.

    A session's messages of one micro-batch are sorted in memory (the trigger bounds them); between batches they must
    come in order.  With ``idle_ms`` a session is forgotten when it has said nothing for so long,
    and the stream goes on until it is stopped, whatever its trigger.
    """
    keyed(messages.sparkSession)
    rows = messages.select("session_id", "turn", "role", "content")
    return rows.groupBy("session_id").transformWithState(Compression(budget, idle_ms), StructType.fromDDL(OUT), "Update", "ProcessingTime" if idle_ms else "None")
