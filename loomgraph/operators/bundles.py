"""What follows from compiled bundles: admissions, diagnostics, experience, skills, quality, explanations.

``items`` of these functions are the rows of bundles: ``request_id, slot, id, type, scope, label, confidence, rank``;
fixed slots are goal, intent and process, all others categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.functions import text as T
from loomgraph.operators.selection import spread

#: Words of labels that speak of a risk, or of a failed state; how many risks and topics a bundle takes.
OPEN_RISK = "risk|block|conflict|constraint|forbid|warning"
FAILED = r"(?<![A-Za-z0-9_])(?:fail|failure|blocked|timeout|error|exception|rollback|conflict)(?![A-Za-z0-9_])|失败|阻塞|超时|错误|异常|回滚|冲突"
RISKS, TOPICS = 4, 4
#: The slots of bundles, and why a node is mentioned with one.
SLOT_NAMES = ("goal", "intent", "process", *X.CATEGORIES)
SELECTED, SKIPPED, RELATED = "selected for", "skipped in", "related to a selection"
#: Bonuses that learned knowledge gives to nodes.
SEVERITY_BONUS = {"high": 2.5, "medium": 2.0, "low": 1.5}


def prefer_primary(rows: DataFrame, primary: Column, *by: str) -> DataFrame:
    """Of each group all primary rows, or all rows if there are none."""
    found = F.max(primary.cast("int")).over(Window.partitionBy(*by))
    return rows.withColumn("found", found).where((F.col("found") == 0) | primary).drop("found")


def merged(rows: DataFrame, place: Column, limit: int, by: str, *order: Column) -> DataFrame:
    """Of each group the primary rows (place 1), then secondary ones (2), or else fallbacks (3); each id once, ``limit`` in all."""
    w = Window.partitionBy(by)
    first = rows.withColumn("place", place).where("place is not null").groupBy(by, "id").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in rows.columns if c not in (by, "id")))
    kept = first.withColumn("best", F.min("place").over(w)).where("place < 3 or best = 3")
    return kept.withColumn("rank", F.row_number().over(w.orderBy("place", *order))).where(F.col("rank") <= limit).drop("best")


def open_risks(items: DataFrame) -> DataFrame:
    """Risks of each bundle, and constraints and states whose labels speak of one; each id once, RISKS in all."""
    from_ = F.when(F.col("slot") == "risks", 0).when(F.col("slot").isin("constraints", "states") & F.lower("label").rlike(OPEN_RISK), F.when(F.col("slot") == "constraints", 1).otherwise(2))
    once = items.withColumn("from", from_).where("`from` is not null").groupBy("request_id", "id").agg(F.min(F.struct("from", "rank", "label")).alias("o"))
    w = Window.partitionBy("request_id").orderBy("o.from", "o.rank", "id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= RISKS).select("request_id", "id", "place", (F.col("o.from") > 0).alias("inferred"))


def topic_admissions(items: DataFrame, topics: DataFrame) -> DataFrame:
    """The one topic that each bundle admits, unless it has four pieces of evidence and two skills; the rest are hints.

    ``topics``: ranked candidates of type Topic or Concept; their preferred form is the summary.
    """
    full = items.groupBy("request_id").agg((F.count_if(F.col("slot") == "evidence") >= 4).alias("e"), (F.count_if(F.col("slot") == "skills") >= 2).alias("s"))
    hints = topics.where(F.col("rank") <= TOPICS).join(full, "request_id", "left")
    may = (F.col("confidence") >= 0.7) & ~(F.coalesce("e", F.lit(False)) & F.coalesce("s", F.lit(False)))
    first = F.min(F.when(may, F.col("rank"))).over(Window.partitionBy("request_id"))
    return hints.select("request_id", "id", F.coalesce(F.col("rank") == first, F.lit(False)).alias("admitted"))


def failure_signals(items: DataFrame) -> DataFrame:
    """``request_id, id, signal, severity, signal_id``: open risks, and states and decisions whose labels speak of failure."""
    failed = F.lower("label").rlike(FAILED)
    kind = F.when(F.col("slot") == "risks", "risk").when((F.col("slot") == "states") & failed, "state").when((F.col("slot") == "decisions") & failed, "decision")
    rows = items.withColumn("signal", kind).where("signal is not null")
    own = F.concat(F.lit("failure-signal:"), F.substring(F.sha2(F.concat_ws("|", "id", "signal"), 256), 1, 16))
    return rows.select("request_id", "id", "signal", F.when(F.col("signal") == "risk", "high").otherwise("medium").alias("severity"), own.alias("signal_id")).distinct()


def attempts(items: DataFrame) -> DataFrame:
    """Per bundle its attempt and episode: status, signals of success and failure, critical step, confidence of its procedure."""
    n = lambda *slots: F.count_if(F.col("slot").isin(*slots))
    one = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("id")))
    rows = items.groupBy("request_id").agg(one("process").alias("process"), one("goal").alias("goal"), n("risks").alias("risks"), n("states").alias("states"), n("rules").alias("rules"), n("constraints").alias("constraints"), n("evidence").alias("evidence"))
    failures = failure_signals(items).groupBy("request_id").agg(F.count("*").alias("failures"))
    rows = rows.join(failures, "request_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    has = F.col("process").isNotNull()
    status = F.when(has, F.when(F.col("failures") == 0, "success").otherwise("partial")).when(F.col("failures") > 0, "failure").otherwise("running")
    successes = has.cast("int") + F.col("goal").isNotNull().cast("int") + F.when(has & (F.col("risks") == 0), 2).otherwise(0) + ((F.col("failures") == 0) & (F.col("states") > 0)).cast("int")
    sure = F.lit(0.55) + F.when(F.col("rules") > 0, 0.15).otherwise(0.0) + F.when(F.col("constraints") > 0, 0.1).otherwise(0.0) - F.least(F.lit(0.3), F.col("failures") * 0.08)
    rows = rows.withColumn("status", status)
    episode = F.when(F.col("status") == "success", "resolved").when(F.col("status") == "failure", "abandoned").otherwise("open")
    return rows.withColumns({"episode": episode, "successes": successes, "procedure": F.when(has, F.when(F.col("failures") == 0, "validated").otherwise("candidate")), "confidence": F.when(has, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 6))})


def experience_roles(items: DataFrame) -> DataFrame:
    """What part each node of a bundle has in its attempt: step, critical step, evidence, source of failure, prerequisite."""
    tried = attempts(items).select("request_id", "status")
    failed = failure_signals(items).select("request_id", "id", F.lit(True).alias("failed")).distinct()
    rows = items.join(tried, "request_id").join(failed, ["request_id", "id"], "left")
    slot, learned = F.col("slot"), F.col("status").isin("success", "partial")
    roles = F.array_compact(F.array(
        F.when(slot == "process", "attempt_step"), F.when(slot == "process", "critical_step"), F.when(slot == "evidence", "attempt_evidence"), F.when(F.col("failed"), "failure_signal_source"),
        F.when((slot == "process") & learned, "procedure_step"), F.when(slot.isin("rules", "constraints") & learned, "procedure_prerequisite"), F.when(F.col("failed"), "failure_pattern_source"),
        F.when((slot == "process") & learned, "successful_procedure_step"), F.when(slot.isin("rules", "constraints") & learned, "successful_procedure_prerequisite"),
    ))
    return rows.select("request_id", "id", "slot", roles.alias("roles")).where(F.size("roles") > 0)


def experience_edges(items: DataFrame) -> DataFrame:
    """Edges of a bundle's experience: its attempt derives from its nodes, its procedure requires its rules and produces its step."""
    tried = attempts(items).select("request_id", "status", "process")
    rows = items.join(tried, "request_id")
    learned = F.col("status").isin("success", "partial")
    kinds = F.array_compact(F.array(F.lit("derived_from"), F.when(learned & F.col("slot").isin("rules", "constraints"), "requires"), F.when(learned & (F.col("slot") == "process"), "produces")))
    return rows.select("request_id", F.explode(kinds).alias("edge"), F.col("id").alias("to_id"), F.when(F.col("scope") == "global", "workspace").otherwise(F.col("scope")).alias("scope"))


def crystallised(items: DataFrame, least: int = 2) -> DataFrame:
    """Skill candidates of bundles with a process and enough evidence: name, scores, merge key and lifecycle."""
    n = lambda slot: F.count_if(F.col("slot") == slot)
    ids = lambda slot: F.array_join(F.array_sort(F.collect_list(F.when(F.col("slot") == slot, F.col("id")))), ",")
    label = F.max(F.when(F.col("slot") == "process", F.col("label"))).alias("process")
    rows = items.groupBy("request_id").agg(label, n("evidence").alias("evidence"), n("rules").alias("rules"), n("risks").alias("risks"), ids("rules").alias("rule_ids"), ids("constraints").alias("constraint_ids"))
    rows = rows.where(F.col("process").isNotNull() & (F.col("evidence") >= least))
    plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower("process"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 72)
    some = lambda c, other: F.when(c != "", c).otherwise(other)
    key = F.concat(F.lit("workflow:"), some(plain, "unspecified"), F.lit("|rules:"), some(F.col("rule_ids"), "none"), F.lit("|constraints:"), some(F.col("constraint_ids"), "none"))
    stability, success = F.when(F.col("rules") > 0, 0.8).otherwise(0.45), F.when(F.col("risks") == 0, 0.75).otherwise(0.5)
    decay = F.when((F.col("risks") >= 2) & (success < 0.45), "stale").when((F.col("evidence") >= least + 1) & (success >= 0.6), "fresh").otherwise("cooling")
    return rows.select("request_id", F.trim(F.regexp_replace("process", "(?i)^(workflow|skill|rule):", "")).alias("name"), F.least(F.lit(1.0), F.col("evidence") / 5).alias("frequency"), stability.alias("stability"), success.alias("success"), F.lit(0.85).alias("clarity"), key.alias("merge_key"), decay.alias("decay"))


def retention(items: DataFrame) -> DataFrame:
    """``request_id, retention``: sticky with a goal, process, rule or open risk, else rolling."""
    held = F.max(F.col("slot").isin("goal", "process", "rules", "risks"))
    return items.groupBy("request_id").agg(F.when(held, "sticky").otherwise("rolling").alias("retention"))


def coverage(hits: Column, total: Column) -> Column:
    """``hits`` of ``total``, and 1 of nothing."""
    return F.when(total == 0, 1.0).otherwise(F.round(hits / total, 6))


def quality(items: DataFrame, expected: DataFrame) -> DataFrame:
    """Per bundle how many of the required nodes (``request_id, id, kind``) it has, and of the forbidden ones."""
    have = items.select("request_id", "id").distinct().withColumn("has", F.lit(True))
    rows = expected.join(have, ["request_id", "id"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    n = lambda kind, has=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if has is None else F.col("has")))
    return rows.groupBy("request_id").agg(coverage(n("required", 1), n("required")).alias("coverage"), (n("required") - n("required", 1)).alias("missing"), n("forbidden", 1).alias("forbidden"), F.when(n("forbidden") == 0, 0.0).otherwise(F.round(n("forbidden", 1) / n("forbidden"), 6)).alias("intrusion"))


def relation_recall(recalled: DataFrame, expected: DataFrame, allowed: DataFrame) -> DataFrame:
    """Precision, recall and noise of the evidence that relations brought (``request_id, id``) against expected and allowed nodes."""
    flag = lambda rows, name: rows.select("request_id", "id").distinct().withColumn(name, F.lit(True))
    rows = flag(recalled, "r").join(flag(expected, "e"), ["request_id", "id"], "full").join(flag(allowed, "a"), ["request_id", "id"], "left").na.fill(False, ["r", "e", "a"])
    n = F.count_if
    r, e, a = F.col("r"), F.col("e"), F.col("a")
    return rows.groupBy("request_id").agg(coverage(n(r & a), n(r)).alias("precision"), coverage(n(r & e), n(e)).alias("recall"), n(r & ~a).alias("noise"))


def recall_kinds(direct: Column, related: Column, learned: Column) -> Column:
    """By what a node was recalled; by its text if by nothing else."""
    return F.array_compact(F.array(F.when(direct | (~related & ~learned), "direct_text"), F.when(related, "relation_graph"), F.when(learned, "learning_graph")))


def primary_kind(kinds: Column) -> Column:
    return F.when(F.array_contains(kinds, "relation_graph"), "relation_graph").when(F.array_contains(kinds, "learning_graph"), "learning_graph").otherwise("direct_text")


def recalled_nodes(listed: DataFrame, items: DataFrame, related: DataFrame) -> DataFrame:
    """Each node that a bundle mentions, with all reasons together: ``request_id, id, included, reasons, direct, related, primary_kind``.

    ``listed`` are all candidates and ``items`` those that were selected (``request_id, id, slot``, a slot of SLOT_NAMES);
    ``related`` are nodes that relations of items lead to (``request_id, id``).  A candidate is skipped where fewer rows of
    its id are selected than listed.  All is counted where pairs are dealt to, once, and reasons are bits of one number.
    """
    row = lambda rows, slot, listed, selected, related: rows.select("request_id", "id", slot.alias("slot"), *(F.lit(v).alias(k) for k, v in (("listed", listed), ("selected", selected), ("related", related))))
    rows = row(listed, F.col("slot"), 1, 0, False).unionByName(row(items, F.col("slot"), 0, 1, False)).unionByName(row(related, F.lit(None).cast("string"), 0, 0, True))
    slots = spread(rows, "request_id", "id").groupBy("request_id", "id", "slot").agg(F.sum("listed").alias("listed"), F.sum("selected").alias("selected"), F.max("related").alias("related"))
    texts = sorted([RELATED, *(f"{v} {s}" for s in SLOT_NAMES for v in (SELECTED, SKIPPED))])
    bit = lambda verb: F.coalesce(X.lookup(F.col("slot"), {s: 1 << texts.index(f"{verb} {s}") for s in SLOT_NAMES}, "int"), F.lit(0))
    why = F.when(F.col("related"), 1 << texts.index(RELATED)).otherwise(0).bitwiseOR(F.when(F.col("selected") > 0, bit(SELECTED)).otherwise(0)).bitwiseOR(F.when(F.col("listed") > F.col("selected"), bit(SKIPPED)).otherwise(0))
    g = slots.groupBy("request_id", "id").agg(F.max(F.col("selected") > 0).alias("included"), F.bit_or(why).alias("why"), F.max(F.col("listed") + F.col("selected") > 0).alias("direct"), F.max("related").alias("related"))
    reasons = F.concat_ws("; ", *(F.when(F.col("why").bitwiseAND(1 << k) != 0, t) for k, t in enumerate(texts)))
    return g.select("request_id", "id", "included", reasons.alias("reasons"), "direct", "related", F.when(F.col("related"), "relation_graph").otherwise("direct_text").alias("primary_kind"))


def selection_status(considered: DataFrame) -> DataFrame:
    """Why each considered node (``suppressed, slot, rank, limit, conflicted, admitted``) is or isn't in a bundle: the first reason that applies."""
    fixed = F.col("slot").isin("goal", "intent", "process")
    status = (
        F.when(F.col("suppressed"), "suppressed").when(fixed & (F.col("rank") <= F.col("most")), "fixed").when(F.col("slot").isNotNull() & (F.col("rank") <= F.col("most")), "category")
        .when(fixed, "fixed_skipped").when(F.col("slot").isNotNull(), "category_skipped").when((F.col("type") == "Topic") & (F.col("rank") <= TOPICS), "topic_hint").when(F.col("conflicted"), "conflict").when(~F.col("admitted"), "scope").otherwise("not_selected")
    )
    return considered.select("request_id", "id", status.alias("status"), status.isin("fixed", "category").alias("included"))


def learning_hints(knowledge: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct hints of learned knowledge to nodes: ``node_id, source_id, kind, bonus``.

    ``knowledge``: ``id, type, confidence, status, severity, source_ids, step_ids, critical_ids, prerequisite_ids,
    labels``; ``labels`` (``id, label``) are candidate nodes, met by equal normalised labels.
    """
    c = F.col
    candidate = F.when(c("status") == "validated", 2.75).otherwise(2.1) + F.least(F.lit(0.5), c("confidence") * 0.5)
    by_id = lambda type_, ids, kind, bonus: F.when(c("type") == type_, F.transform(ids, lambda x: F.struct(x.alias("node_id"), F.lit(kind).alias("kind"), bonus.alias("bonus")))).otherwise(F.array().cast("array<struct<node_id:string,kind:string,bonus:double>>"))
    severity = F.coalesce(X.lookup(c("severity"), SEVERITY_BONUS), F.lit(1.5))
    hints = F.concat(
        by_id("FailureSignal", "source_ids", "failure_signal", severity), by_id("ProcedureCandidate", "step_ids", "procedure_step", candidate), by_id("ProcedureCandidate", "critical_ids", "critical_step", F.lit(3.0)),
        by_id("ProcedureCandidate", "prerequisite_ids", "prerequisite", F.lit(1.75)), by_id("FailurePattern", "source_ids", "failure_pattern", F.lit(2.2)), by_id("SuccessfulProcedure", "step_ids", "successful_procedure", F.lit(2.6)),
        by_id("SuccessfulProcedure", "prerequisite_ids", "prerequisite", F.lit(1.9)),
    )
    direct = knowledge.select(c("id").alias("source_id"), F.explode(hints).alias("h")).select("source_id", "h.*")
    said = knowledge.where(c("type").isin("FailurePattern", "SuccessfulProcedure")).select(c("id").alias("source_id"), "type", F.explode("labels").alias("said")).withColumn("norm", T.normalized(c("said")))
    named = said.join(labels.select(c("id").alias("node_id"), T.normalized(c("label")).alias("norm")), "norm").where("norm <> ''")
    failed = c("type") == "FailurePattern"
    named = named.select("source_id", "node_id", F.when(failed, "failure_pattern").otherwise("successful_procedure").alias("kind"), F.when(failed, 1.85).otherwise(2.15).alias("bonus"))
    # of a source and kind the first hint counts, and those by id come first
    every = direct.select("source_id", "node_id", "kind", "bonus", F.lit(0).alias("late")).unionByName(named.withColumn("late", F.lit(1)))
    return every.groupBy("node_id", "source_id", "kind").agg(F.min(F.struct("late", (-c("bonus")).alias("b"))).alias("m")).select("node_id", "source_id", "kind", (-c("m.b")).alias("bonus"))


def reinforced(existing: DataFrame, observed: DataFrame) -> DataFrame:
    """Promoted patterns after one more observation each: count, state, downgrades, decay, confidence.

    ``existing``: ``id, observations, downgrades, state, confidence, bundle``; ``observed``: ``id, bundle, confidence,
    mixed, decision`` (manual, or null).  The same bundle again changes nothing but the confidence.
    """
    rows = existing.alias("e").join(observed.alias("o"), "id")
    e, o = lambda k: F.col(f"e.{k}"), lambda k: F.col(f"o.{k}")
    n = e("observations") + 1
    state = (
        F.when(o("decision") == "retire", "retired").when(o("decision") == "hold", F.when(n >= 2, "downgraded").otherwise("candidate")).when(o("decision") == "promote", "reinforced").when(e("state") == "retired", "retired")
        .when((o("mixed") & (n >= 2)) | (o("confidence") < e("confidence") - 0.08) | (e("downgrades") >= 2), "downgraded").when(n >= 2, "reinforced").otherwise("candidate")
    )
    downgrades = F.when(state == "downgraded", e("downgrades") + 1).when(state == "reinforced", 0).otherwise(e("downgrades"))
    decay = (
        F.when(state == "retired", "stale").when((state == "downgraded") | (downgrades >= 2), F.when(o("confidence") >= 0.7, "cooling").otherwise("stale")).when((n >= 3) | (o("confidence") >= 0.85), "fresh")
        .when((n >= 2) | (o("confidence") >= 0.7), "cooling").otherwise("stale")
    )
    again, most = e("bundle") == o("bundle"), F.greatest(e("confidence"), o("confidence"))
    return rows.select(
        "id", F.when(again, e("observations")).otherwise(n).alias("observations"), F.when(again, e("state")).otherwise(state).alias("state"), F.when(again, e("downgrades")).otherwise(downgrades).alias("downgrades"), F.when(~again, decay).alias("decay"),
        F.round(F.when(again, most).otherwise(F.least(F.lit(0.99), most + 0.03)), 6).alias("confidence"),
    )


def global_clones(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clones of nodes that may rise to all scopes, by their governance or a manual decision; retired ones never."""
    rows = nodes.join(decisions.select(F.col("target_id").alias("id"), "decision"), "id", "left")
    risen = (F.col("risk") == "low") & F.col("knowledge_class").isin("stable_skill", "hard_constraint_candidate")
    up = (F.coalesce("decision", F.lit("")) != "retire") & (F.coalesce("decision", F.lit("")) != "hold") & (risen | (F.col("decision") == "promote"))
    return rows.where(up & (F.col("scope") == "workspace")).select(F.concat(F.lit("global:"), "id").alias("id"), F.lit("global").alias("scope"), "type", F.coalesce("decision", F.lit("governance")).alias("by"))


def not_derived(nodes: DataFrame) -> DataFrame:
    """Artifacts of a bundle that break the rule that they are derived, of stage ``runtime_bundle``, and never evidence; none if all is well."""
    why = F.when(F.col("type") == "Evidence", "evidence").when(F.col("origin_kind").isNull(), "no provenance").when(F.col("origin_kind") != "derived", "origin").when(F.col("source_stage") != "runtime_bundle", "stage")
    return nodes.select("id", why.alias("why")).where("why is not null")
