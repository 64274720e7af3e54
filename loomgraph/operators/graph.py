"""Relations of the graph: expansion over one and two hops, conflicts, corrections, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X


def both_ways(edges: DataFrame) -> DataFrame:
    """Recall-eligible edges as steps in either direction, without loops: ``at, to, edge_id, type, edge_confidence, priority``."""
    priority = X.lookup(F.col("type"), {k: v[4] for k, v in X.RELATIONS.items()})
    e = edges.select("from_id", "to_id", F.col("id").alias("edge_id"), "type", F.col("confidence").alias("edge_confidence"), priority.alias("priority")).where("priority is not null and from_id <> to_id")
    rest = ["edge_id", "type", "edge_confidence", "priority"]
    return e.select(F.col("from_id").alias("at"), F.col("to_id").alias("to"), *rest).unionByName(e.select(F.col("to_id").alias("at"), F.col("from_id").alias("to"), *rest))


def one_hop(sources: DataFrame, edges: DataFrame, nodes: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Targets next to ``sources`` (``source_id, slot_bonus``): ``source_id, target_id, type, bonus``."""
    steps = both_ways(edges)
    hit = sources.join(steps, F.col("source_id") == F.col("at")).where("to <> source_id")
    wanted = nodes.where(F.col("type").isin(*targets)).select(F.col("id").alias("to"))
    return hit.join(wanted, "to").select("source_id", F.col("to").alias("target_id"), "type", "edge_id", (F.col("slot_bonus") + F.col("priority")).alias("bonus"))


def two_hops(sources: DataFrame, edges: DataFrame, nodes: DataFrame, between: tuple[str, ...], targets: tuple[str, ...], second: tuple[str, ...]) -> DataFrame:
    """Targets behind one node of a type in ``between``: ``source_id, middle_id, target_id, first, second, bonus``."""
    steps = both_ways(edges)
    n = nodes.select(F.col("id").alias("nid"), F.col("type").alias("ntype"), F.col("confidence").alias("nconf"))
    first = sources.join(steps, F.col("source_id") == F.col("at")).where("to <> source_id")
    first = first.select("source_id", "slot_bonus", F.col("to").alias("middle_id"), F.col("type").alias("first"), F.col("edge_confidence").alias("c1"), (F.col("slot_bonus") + F.col("priority")).alias("b1"))
    first = first.join(n.where(F.col("ntype").isin(*between)), F.col("middle_id") == F.col("nid")).select("source_id", "slot_bonus", "middle_id", "first", "c1", "b1", F.col("nconf").alias("m"))
    on = first.join(steps.where(F.col("type").isin(*second)), F.col("middle_id") == F.col("at")).where("to <> middle_id and to <> source_id")
    on = on.join(n.where(F.col("ntype").isin(*targets)), F.col("to") == F.col("nid"))
    bonus = F.col("b1") + (F.col("slot_bonus") + F.col("priority")) * 0.75 + (F.col("c1") + F.col("edge_confidence")) / 2 * 0.9 + (F.col("m") + F.col("nconf")) / 2 * 0.75
    return on.select("source_id", "middle_id", F.col("to").alias("target_id"), "first", F.col("type").alias("second"), F.round(bonus, 6).alias("bonus"))


def target_bonus(hints: DataFrame, *by: str) -> DataFrame:
    """Summed bonus of each target over distinct pairs of source and edge type; of a repeated pair the largest counts."""
    once = hints.groupBy(*by, "source_id", "target_id", "type").agg(F.max("bonus").alias("bonus"))
    return once.groupBy(*by, "target_id").agg(F.round(F.sum("bonus"), 6).alias("bonus"), F.count("*").alias("hints"))


def path_order(mode: str) -> list[Column]:
    by = [F.desc("bonus"), F.asc("hops")] if mode == "bonus_then_hops" else [F.asc("hops"), F.desc("bonus")]
    return [*by, F.asc("target_id")]


def admitted_paths(paths: DataFrame, budget: int = 16, per_target: int = 3, per_source: int = 3, targets: int = 6, floor: float = 5.2) -> DataFrame:
    """Ordered greedy admission of each request's paths, with the first reason that prunes one.

    ``paths``: ``request_id, source_id, target_id, bonus, hops``.  The counters of a request are carried over its own
    few paths, so requests are spread over tasks.
    """
    item = F.struct((-F.col("bonus")).alias("o"), "hops", "target_id", "source_id", "bonus")
    rows = paths.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("paths"))

    def step(s: Column, p: Column) -> Column:
        count = lambda k: F.size(F.filter(s["kept"], lambda q: q[k] == p[k]))
        known = count("target_id") > 0
        why = (
            F.when(p["bonus"] < floor, "score_floor").when(F.size(s["kept"]) >= budget, "path_budget").when(count("target_id") >= per_target, "per_target")
            .when(count("source_id") >= per_source, "per_source").when(~known & (F.size(F.array_distinct(F.transform(s["kept"], lambda q: q["target_id"]))) >= targets), "expanded_targets")
        )
        short = F.struct(p["target_id"].alias("target_id"), p["source_id"].alias("source_id"))
        told = F.struct(p["source_id"].alias("source_id"), p["target_id"].alias("target_id"), p["bonus"].alias("bonus"), F.coalesce(why, F.lit("admitted")).alias("status"))
        return F.struct(F.when(why.isNull(), F.concat(s["kept"], F.array(short))).otherwise(s["kept"]).alias("kept"), F.concat(s["out"], F.array(told)).alias("out"))

    none = F.struct(F.array().cast("array<struct<target_id:string,source_id:string>>").alias("kept"), F.array().cast("array<struct<source_id:string,target_id:string,bonus:double,status:string>>").alias("out"))
    return rows.select("request_id", F.posexplode(F.aggregate("paths", none, step)["out"]).alias("pos", "p")).select("request_id", "pos", "p.*")


def polarity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(X.NEGATIVE), "negative").when(low.rlike(X.POSITIVE), "positive").otherwise("neutral")


def conflict_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of rule-like nodes that share session, scope and conflict key, and what the newer is to the older.

    Equal types and no opposition: the newer (of equal times the larger id) supersedes.  Opposition: they conflict, and
    the winner is the one of higher override priority, then origin, confidence, time, and smaller id.
    """
    key = ["session_id", "scope", "conflict_key"]
    side = nodes.where(F.col("type").isin("Rule", "Constraint", "Mode", "Process")).select(*key, "id", "type", "updated_at", "confidence", "override_priority", "polarity", X.lookup(F.col("origin_kind"), {"raw": 3, "compressed": 2, "derived": 1}, "int").alias("origin"))
    a, b = side.alias("a"), side.alias("b")
    c = lambda s, n: F.col(f"{s}.{n}")
    pair = a.join(b, [c("a", k) == c("b", k) for k in key] + [c("a", "id") < c("b", "id")])
    opposite = ((c("a", "polarity") == "positive") & (c("b", "polarity") == "negative")) | ((c("a", "polarity") == "negative") & (c("b", "polarity") == "positive"))
    newer = F.when(c("a", "updated_at") > c("b", "updated_at"), c("a", "id")).otherwise(c("b", "id"))
    strong = lambda s: F.struct(c(s, "override_priority"), c(s, "origin"), c(s, "confidence"), c(s, "updated_at"))
    winner = F.when(strong("b") > strong("a"), c("b", "id")).otherwise(c("a", "id"))
    relation = F.when(opposite, "conflicts_with").when(c("a", "type") == c("b", "type"), "supersedes")
    return pair.select(c("a", "session_id").alias("session_id"), c("a", "id").alias("left_id"), c("b", "id").alias("right_id"), relation.alias("relation"), F.when(opposite, winner).otherwise(newer).alias("winner")).where("relation is not null")


def conflict_standing(nodes: DataFrame) -> DataFrame:
    """What each rule-like node is to all others of its session, scope and conflict key, without their pairs.

    ``won``: how many opposed nodes it beats; ``suppressed``: whether an opposed one beats it; ``superseded_by``: of the
    newer nodes of its type that don't oppose it the one of the largest id.  Rules as in ``conflict_pairs``.  In the
    order of strength a node has beaten the opposed ones before it, in the order of time those after it are newer, so
    two sorts with running counts give all of it.
    """
    key = ["session_id", "scope", "conflict_key"]
    side = nodes.where(F.col("type").isin("Rule", "Constraint", "Mode", "Process")).select(*key, "id", "type", "updated_at", "confidence", "override_priority", "polarity", X.lookup(F.col("origin_kind"), {"raw": 3, "compressed": 2, "derived": 1}, "int").alias("origin"))
    is_, before = (lambda p: F.col("polarity") == p), (Window.unboundedPreceding, -1)
    weaker = Window.partitionBy(*key).orderBy("override_priority", "origin", "confidence", "updated_at", F.desc("id")).rowsBetween(*before)
    newer = Window.partitionBy(*key, "type").orderBy(F.desc("updated_at"), F.desc("id")).rowsBetween(*before)
    opposed = lambda of: F.when(is_("positive"), of("negative")).when(is_("negative"), of("positive")).otherwise(F.lit(0))
    totals = side.groupBy(*key).agg(F.count_if(is_("positive")).alias("n_positive"), F.count_if(is_("negative")).alias("n_negative"))
    latest = lambda but: F.max(F.when(~is_(but), F.col("id"))).over(newer)
    after = F.when(is_("positive"), latest("negative")).when(is_("negative"), latest("positive")).otherwise(F.max("id").over(newer))
    rows = side.withColumn("won", opposed(lambda p: F.count_if(is_(p)).over(weaker))).withColumn("superseded_by", after).join(totals, key)
    return rows.select("id", "won", (opposed(lambda p: F.col(f"n_{p}")) > F.col("won")).alias("suppressed"), "superseded_by")


def resolved(corrections: DataFrame, kind: str) -> DataFrame:
    """The standing correction of each target: the last event, if it isn't a rollback."""
    own = corrections.where(F.col("target_kind") == kind)
    w = Window.partitionBy("target_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return own.withColumn("r", F.row_number().over(w)).where("r = 1 and action <> 'rollback'").drop("r")


def standing(corrections: DataFrame) -> DataFrame:
    """The standing corrections of all kinds at once: of each kind and target the last event, if it isn't a rollback."""
    w = Window.partitionBy("target_kind", "target_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return corrections.withColumn("r", F.row_number().over(w)).where("r = 1 and action <> 'rollback'").drop("r")


def alias_catalog(defaults: DataFrame, corrections: DataFrame) -> DataFrame:
    """``concept, alias``: the defaults and those that the last event of each concept and alias has added."""
    w = Window.partitionBy("target_id", "new_label").orderBy(F.desc("created_at"), F.desc("event_id"))
    added = corrections.where("target_kind = 'concept_alias'").withColumn("r", F.row_number().over(w)).where("r = 1 and action <> 'rollback'")
    return defaults.union(added.select(F.col("target_id"), "new_label")).distinct()


def semantic_overrides(corrections: DataFrame) -> DataFrame:
    """``target_id, type, include`` by the last event of each target and type: applied includes it, rolled back excludes it."""
    return corrections.groupBy("target_id", "type").agg(F.max_by(F.col("action") == "apply", F.struct("created_at", "event_id")).alias("include"))


def conflict_patches(pairs: DataFrame) -> DataFrame:
    """What the pairs of a node (``conflict_pairs``) make of it: superseded, by whom, in conflict with whom, and suppressed."""
    loser = F.when(F.col("winner") == F.col("left_id"), F.col("right_id")).otherwise(F.col("left_id"))
    opposed = F.col("relation") == "conflicts_with"
    p = pairs.select(F.col("winner"), loser.alias("loser"), opposed.alias("opposed"))
    each = p.select(F.col("loser").alias("id"), F.col("winner").alias("other"), "opposed", F.lit(True).alias("lost")).unionByName(p.select(F.col("winner").alias("id"), F.col("loser").alias("other"), "opposed", F.lit(False).alias("lost")))
    gone = F.col("lost") & ~F.col("opposed")
    return each.groupBy("id").agg(
        F.when(F.max(gone), "superseded").otherwise("active").alias("freshness"), F.max(F.when(gone, F.col("other"))).alias("superseded_by"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("opposed"), F.col("other")))), ",").alias("conflicting"), F.max(F.col("lost") & F.col("opposed")).alias("suppressed"),
    )


def corrected(nodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Nodes without suppressed ones, with overriding labels."""
    gone = resolved(corrections, "node_suppression").select(F.col("target_id").alias("id"))
    labels = resolved(corrections, "label_override").select(F.col("target_id").alias("id"), "new_label")
    out = nodes.join(gone, "id", "left_anti").join(labels, "id", "left")
    return out.withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
