"""The bundle of every request: recall over scopes, four relation passes, ranks and the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.operators import bundles as B
from loomgraph.operators import graph as G
from loomgraph.operators import retrieval as R
from loomgraph.operators import selection as S
from loomgraph.sources.transcripts import written

#: What a source's slot adds to a relation's bonus, and types between two hops.
SLOT_BONUS = {"rules": 2.25, "constraints": 2.0, "risks": 2.5, "process": 1.75, "decisions": 1.25, "states": 1.0}
SLOT_OF = R.SLOT_OF
BETWEEN = ("Rule", "Constraint", "Mode", "Process", "Step", "Risk", "Decision", "State", "Outcome", "Tool")


def slotted(candidates: DataFrame) -> DataFrame:
    """Candidates with their slots; of each request and type raw nodes alone, if there are any."""
    return B.prefer_primary(candidates, F.col("origin_kind") == "raw", "request_id", "type").withColumn("slot", X.lookup(F.col("type"), SLOT_OF, "string")).where("slot is not null")


def ranked(rows: DataFrame) -> DataFrame:
    """Rank within request and slot by closest scope, score with ``bonus``, label and id; for the process, steps come before processes."""
    w = Window.partitionBy("request_id", "slot").orderBy((F.col("type") == "Process").cast("int"), F.desc("precedence"), F.desc(F.round(F.col("score") + F.col("bonus"), 6)), "label", "id")
    most = F.coalesce(X.lookup(F.col("slot"), {k: v[1] for k, v in X.CATEGORIES.items()}, "int"), F.lit(1))
    numbered = rows.withColumn("rank", F.row_number().over(w))
    return numbered.where(F.col("rank") <= max(v[1] for v in X.CATEGORIES.values())).where(F.col("rank") <= most)


def chosen(rows: DataFrame, *slots: str) -> DataFrame:
    """The sources that ranked rows of ``slots`` are: ``request_id, source_id, slot_bonus``."""
    return rows.where(F.col("slot").isin(*slots)).select("request_id", F.col("id").alias("source_id"), X.lookup(F.col("slot"), SLOT_BONUS).alias("slot_bonus"))


def hints(sources: DataFrame, steps: DataFrame, *edge_types: str) -> DataFrame:
    """One hop from ``sources`` over relations of ``edge_types``: ``request_id, source_id, id, kind, bonus``, of a source and kind the first."""
    met = sources.join(steps.where(F.col("type").isin(*edge_types)), F.col("source_id") == F.col("at")).where("to <> source_id")
    return met.groupBy("request_id", "source_id", F.col("to").alias("id"), F.col("type").alias("kind")).agg(F.max(F.col("slot_bonus") + F.col("priority")).alias("bonus"))


def two_hop_hints(sources: DataFrame, steps: DataFrame, kinds: DataFrame) -> DataFrame:
    """Two hops, the second over ``supported_by`` behind a node of a type in BETWEEN; ``kinds``: ``id, type, confidence``."""
    k = kinds.select(F.col("id").alias("nid"), F.col("type").alias("ntype"), F.col("confidence").alias("sure"))
    first = sources.join(steps, F.col("source_id") == F.col("at")).where("to <> source_id").join(k.where(F.col("ntype").isin(*BETWEEN)), F.col("to") == F.col("nid"))
    first = first.select("request_id", "source_id", "slot_bonus", F.col("to").alias("middle"), F.col("type").alias("one"), F.col("edge_confidence").alias("c1"), F.col("priority").alias("p1"), F.col("sure").alias("m"))
    on = first.join(steps.where("type = 'supported_by'"), F.col("middle") == F.col("at")).where("to <> middle and to <> source_id").join(k, F.col("to") == F.col("nid"))
    bonus = F.col("slot_bonus") + F.col("p1") + (F.col("slot_bonus") + F.col("priority")) * 0.75 + (F.col("c1") + F.col("edge_confidence")) / 2 * 0.9 + (F.col("m") + F.col("sure")) / 2 * 0.75
    return on.groupBy("request_id", "source_id", F.col("to").alias("id"), F.concat("one", F.lit("->"), "type").alias("kind")).agg(F.max(bonus).alias("bonus"))


def supported(rows: DataFrame, support: DataFrame, types: tuple[str, ...], recall: R.Recall | None = None) -> DataFrame:
    """``rows`` with the summed bonuses of ``support`` (``request_id, id, bonus``) added for nodes of ``types``; with ``recall`` also for those that ``rows`` lack."""
    if recall:
        support = written(support)
        more = recall.beyond(support, rows, types).withColumn("slot", X.lookup(F.col("type"), SLOT_OF, "string")).withColumn("bonus", F.lit(0.0))
        rows = rows.unionByName(more.select(*rows.columns))
    total = support.groupBy("request_id", "id").agg(F.sum("bonus").alias("more"))
    joined = rows.join(total, ["request_id", "id"], "left")
    return joined.withColumn("bonus", F.col("bonus") + F.when(F.col("type").isin(*types), F.coalesce("more", F.lit(0.0))).otherwise(0.0)).drop("more")


def passes(candidates: DataFrame, edges: DataFrame, nodes: DataFrame, recall: R.Recall | None = None) -> DataFrame:
    """All slots' candidates with the bonuses of the four relation passes; with ``recall`` those that relations lead to are added.

    From the first process to next steps; from the process that this gives to what it requires; from rules and
    constraints to those that override or are overridden, which supports the source; from all slots to evidence, over
    one or two hops.  A pass reads the one before it twice, so each is written.
    """
    steps = G.both_ways(edges)
    rows = written(slotted(candidates).withColumn("bonus", F.lit(0.0)))
    rows = written(supported(rows, hints(chosen(ranked(rows), "process"), steps, "next_step"), ("Step", "Process"), recall))
    rules = ("Rule", "Constraint", "Mode")
    rows = written(supported(rows, hints(chosen(ranked(rows), "process"), steps, "requires"), rules, recall))
    overriding = hints(chosen(ranked(rows), "rules", "constraints"), steps, "overrides")
    rows = written(supported(rows, overriding.select("request_id", F.col("source_id").alias("id"), "bonus"), rules))
    sources = chosen(ranked(rows), *SLOT_BONUS)
    kinds = nodes.select("id", "type", "confidence")
    evidence = hints(sources, steps, "supported_by", "requires", "next_step", "overrides").unionByName(two_hop_hints(sources, steps, kinds))
    return supported(rows, evidence, ("Evidence",), recall)


def retrieved_passes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = R.DEPTH) -> DataFrame:
    """``passes`` over what can be in a bundle: the best of each slot, and what relations lead to."""
    recall = R.Recall(requests, nodes, depth)
    return passes(recall.candidates, edges, nodes, recall)


def compiled(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The budgeted bundles of all requests: ``request_id, token_budget, used, category, id, rank, pass, cost``."""
    best = ranked(retrieved_passes(requests, nodes, edges))
    return S.packed(best.withColumn("category", F.col("slot")))


def reason(slot: Column, kinds: Column, scope: Column) -> Column:
    """Why a node was selected, in words."""
    what = F.coalesce(F.create_map(*map(F.lit, ("goal", "current goal match", "intent", "current intent match", "process", "current process step", "rules", "active rule", "constraints", "active constraint", "risks", "open risk", "decisions", "recent decision", "states", "recent state", "evidence", "supporting evidence", "skills", "candidate skill")))[slot], F.lit("selected"))
    via = F.when(F.size(kinds) > 0, F.concat(F.lit(" via "), F.array_join(kinds, ", "))).otherwise("")
    return F.concat(what, via, F.when(scope == "session", "").otherwise(F.concat(F.lit("; scope="), scope)))


def rendered(items: DataFrame, used: DataFrame) -> DataFrame:
    """The text of each bundle: a line a slot, in a fixed order, and what of the budget is used (``request_id, used, total``)."""
    titles = (("goal", "Goal"), ("intent", "Intent"), ("rules", "Active rules"), ("constraints", "Constraints"), ("process", "Current step"), ("decisions", "Recent decisions"), ("states", "State changes"), ("evidence", "Evidence"), ("skills", "Skills"), ("risks", "Open risks"))
    line = lambda slot: F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == slot, F.struct("rank", "label")))), lambda x: x["label"])
    rows = items.groupBy("request_id").agg(*(line(slot).alias(slot) for slot, _ in titles)).join(used, "request_id")
    said = [F.when(F.size(slot) > 0, F.concat(F.lit(f"{title}: "), F.array_join(slot, " | "))) for slot, title in titles]
    head, tail = F.lit("[Context]"), F.concat(F.lit("Budget used: "), "used", F.lit("/"), "total")
    return rows.select("request_id", F.array_join(F.array_compact(F.array(head, *said, tail)), "\n").alias("text"))


def contract(items: DataFrame) -> DataFrame:
    """What each bundle covers: fixed slots of three, categories of seven, and the number of its items."""
    n = lambda slots: F.countDistinct(F.when(F.col("slot").isin(*slots), F.col("slot")))
    return items.groupBy("request_id").agg(n(("goal", "intent", "process")).alias("fixed"), n(tuple(X.CATEGORIES)).alias("categories"), F.count("*").alias("items"))
