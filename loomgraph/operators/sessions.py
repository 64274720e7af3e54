"""Sessions: turns, tails, budget trims, tool runs, compression plans, checkpoints and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns(messages: DataFrame) -> DataFrame:
    """``block`` of each message: a new one at each user message; what comes before the first is block 0."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("block", F.sum((F.col("role") == "user").cast("int")).over(w))


def raw_tail(messages: DataFrame, last: int = 2) -> DataFrame:
    """Messages of the last blocks of each session."""
    w = Window.partitionBy("session_id")
    return turns(messages).withColumn("top", F.max("block").over(w)).where(F.col("block") > F.col("top") - last).drop("top")


def trimmed(messages: DataFrame, budget: Column) -> DataFrame:
    """What fits a budget: system messages from the first until one overflows, then conversation from the newest until one does."""
    cost = F.greatest(F.lit(1), F.ceil(F.char_length("content") / 4).cast("int"))
    m = messages.withColumn("cost", cost).withColumn("budget", budget)
    system = F.col("role") == "system"
    up = Window.partitionBy("session_id", system).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("session_id", system).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("kept", F.when(system, F.sum("cost").over(up) <= F.col("budget")))
    spent = F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).over(Window.partitionBy("session_id"))
    m = m.withColumn("spent", spent)
    return m.withColumn("kept", F.when(system, F.col("kept")).otherwise(F.sum("cost").over(down) <= F.col("budget") - F.col("spent"))).where("kept").drop("spent")


def latest_tool_run(messages: DataFrame) -> DataFrame:
    """The last run of neighbouring tool results of each session; what follows it is passed over."""
    by = Window.partitionBy("session_id").orderBy("turn")
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy("session_id", "tool").orderBy("turn"))
    tools = messages.withColumn("island", island).where("tool")
    last = F.max("turn").over(Window.partitionBy("session_id", "island"))
    tools = tools.withColumn("last", last)
    return tools.withColumn("end", F.max("turn").over(Window.partitionBy("session_id"))).where("last = end").drop("island", "last", "end")


def compression_plan(messages: DataFrame, tail: int, ratio: float, budget: Column) -> DataFrame:
    """Mode of each session: full if its tokens exceed the ratio of the budget and there is something to fold, incremental if
    there is something before the raw tail, else none; with the sizes of both parts."""
    w = Window.partitionBy("session_id")
    m = turns(messages).withColumn("top", F.max("block").over(w)).withColumn("cost", F.greatest(F.lit(1), F.ceil(F.char_length("content") / 4).cast("int")))
    old = F.col("block") <= F.col("top") - tail
    s = m.groupBy("session_id").agg(F.sum("cost").alias("tokens"), F.count_if(old).alias("foldable"), F.count_if(~old).alias("tail"), F.max("block").alias("blocks")).withColumn("budget", budget)
    mode = F.when((F.col("foldable") > 0) & (F.col("tokens") / F.col("budget") > ratio), "full").when(F.col("foldable") > 0, "incremental").otherwise("none")
    return s.withColumn("mode", mode)


def summary_block(messages: DataFrame, lines: int = 8, width: int = 120, most: int = 1200) -> DataFrame:
    """The text that stands for each session: its last lines, each cut, and the whole cut."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    last = messages.withColumn("r", F.row_number().over(w)).where(F.col("r") <= lines)
    line = F.concat("role", F.lit(": "), F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, width))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("session_id").agg(F.substring(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), 1, most).alias("summary"))


def difference(now: Column, before: Column) -> Column:
    """Ids of ``now`` that ``before`` lacks, in order."""
    return F.filter(now, lambda x: ~F.array_contains(before, x))


def same_ids(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def deltas(checkpoints: DataFrame, order: str = "turn") -> DataFrame:
    """Each checkpoint (``session_id``, id arrays) against the one before it: what is new, kinds of change, tokens."""
    w = Window.partitionBy("session_id").orderBy(order)
    names, cost = ("rules", "constraints", "decisions", "states", "risks"), {"rules": 12, "constraints": 12, "decisions": 16, "states": 16, "risks": 16}
    empty = F.array().cast("array<string>")
    rows, kinds, tokens = checkpoints, [], F.lit(0)
    for n in names:
        rows = rows.withColumn(f"before_{n}", F.coalesce(F.lag(n).over(w), empty))
        rows = rows.withColumn(f"added_{n}", difference(F.col(n), F.col(f"before_{n}")))
        kinds.append(F.when(~same_ids(F.col(n), F.col(f"before_{n}")), f"{n}_changed"))
        tokens += F.size(f"added_{n}") * cost[n]
    rows = rows.withColumn("before_goal", F.lag("goal").over(w))
    changed = ~F.col("goal").eqNullSafe(F.col("before_goal"))
    return rows.withColumn("kinds", F.array_compact(F.array(F.when(changed, "goal_changed"), *kinds))).withColumn("tokens", tokens + F.when(changed, 12).otherwise(0))


def paired(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with their results: by id where both have it, else first come first served; what has no partner stays."""
    exact = calls.join(results, ["session_id", "call_id"], "full")
    both = exact.where("call_turn is not null and result_turn is not null").select("session_id", "call_turn", "result_turn")
    w = lambda by: Window.partitionBy("session_id").orderBy(by)
    c = exact.where("result_turn is null").select("session_id", "call_turn").withColumn("k", F.row_number().over(w("call_turn")))
    r = exact.where("call_turn is null").select("session_id", "result_turn").withColumn("k", F.row_number().over(w("result_turn")))
    return both.unionByName(c.join(r, ["session_id", "k"], "full").select("session_id", "call_turn", "result_turn"))


def appended_baselines(now: DataFrame, before: DataFrame) -> DataFrame:
    """The baseline of each session: the former one if it says the same, else a new one of the next version.

    ``now``: ``session_id, summary, last_turn``; ``before``: ``session_id, old, version``.
    """
    rows = now.join(before, "session_id", "left")
    version = F.when(F.col("summary").eqNullSafe(F.col("old")), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    rows = rows.withColumn("version", version)
    return rows.select("session_id", "version", F.sha2(F.concat_ws("|", "session_id", F.lit("baseline"), "version", "last_turn", "summary"), 256).alias("baseline_id"))


def state_ids(now: DataFrame, before: DataFrame) -> DataFrame:
    """The id of each session's compression state, and whether it is what it was."""
    own = lambda rows, name: rows.select("session_id", F.sha2(F.concat_ws("|", "session_id", F.lit("compression_state"), "mode", F.sha2("summary", 256), "last_turn"), 256).alias(name))
    return own(now, "state_id").join(own(before, "former"), "session_id", "left").select("session_id", "state_id", F.col("state_id").eqNullSafe(F.col("former")).alias("same"))
