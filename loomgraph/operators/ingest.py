"""Records to spans, noise decisions, node and summary candidates, and nodes with their support.

Everything is an expression or a window by record: texts are cut at marks that regular expressions set, offsets are
running sums of lengths, and one exchange by record serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.operators import processing as P

#: Routes, whether their sentences are split into clauses, the types that their spans may have, those of
#: which one is the structural target (by priority), and what a span is that has no type else.
ROUTES = {
    "conversation": (True, ("Intent", "Goal", "Constraint", "Risk", "Process", "Step", "Topic", "Concept"), ("Goal", "Constraint", "Process", "Step"), "Intent"),
    "tool_result": (False, ("State", "Risk", "Outcome", "Tool", "Process", "Step", "Topic", "Concept"), (), "State"),
    "transcript": (True, ("Intent", "Decision", "State", "Constraint", "Process", "Step", "Risk", "Topic", "Concept"), ("Goal", "Constraint", "Process", "Step"), "Decision"),
    "document": (False, ("Rule", "Constraint", "Process", "Step", "Skill", "Outcome", "Tool", "Topic", "Concept"), (), "Topic"),
    "experience_trace": (True, ("Decision", "State", "Risk", "Process", "Step", "Skill", "Topic", "Concept"), ("Process", "Step", "Constraint"), "Decision"),
    "system": (False, ("Rule", "Constraint", "Mode", "Process", "Step", "Topic", "Concept"), (), "Topic"),
}
#: Stages that decide a route, the types that a class of words stands for, and connectors between clauses.
STAGES = {
    "transcript": ("transcript_message", "transcript_custom", "transcript_compaction"),
    "experience_trace": ("runtime_bundle", "checkpoint", "delta", "skill_candidate"),
    "tool_result": ("tool_output_raw", "tool_output_summary", "tool_result_persist"),
    "document": ("document_raw", "document_extract"),
}
CLASS_TYPES = {
    "Question": ("Intent", "Topic"), "Goal": ("Goal",), "Constraint": ("Constraint", "Rule"), "Step": ("Step", "Process"), "Process": ("Process",), "Risk": ("Risk", "State"),
    "Outcome": ("Outcome",), "Tool": ("Tool",), "Mode": ("Mode",), "Skill": ("Skill",), "Topic": ("Topic", "Concept"),
}
MORE_PATTERNS = {
    "Mode": r"\b(?:mode|strict mode|debug mode|compatibility)\b|模式|调试模式|严格模式|兼容模式",
    "Skill": r"\b(?:skill|pattern|playbook|procedure)\b|技能|模式|经验|流程卡片",
    "Topic": r"\b(?:provenance|checkpoint|knowledge graph|context compression|prompt|bundle|trace)\b|知识图谱|上下文压缩|来源追踪|检查点|提示词|上下文包",
}
CONNECTORS = r"(?i:(?:and|but|then|however|because|while|before|after|if|when|unless|so|or)(?![A-Za-z0-9_]))|但是|不过|然后|并且|而且|以及|如果|因为|所以|否则|之后|之前|同时|另外|或者"
SLOT_OF = {
    "Goal": "goal", "Intent": "intent", "Process": "currentProcess", "Step": "currentProcess", "Rule": "activeRules", "Constraint": "activeConstraints", "Mode": "activeConstraints", "Risk": "openRisks",
    "Decision": "recentDecisions", "State": "recentStateChanges", "Outcome": "recentStateChanges", "Tool": "relevantEvidence", "Topic": "relevantEvidence", "Concept": "relevantEvidence", "Skill": "candidateSkills",
}
FAILURE = r"\b(?:fail|failed|error|timeout|blocked|warning)\b|失败|错误|超时|阻塞|风险"
DISPOSITIONS = ("drop", "evidence_only", "hint_only", "materialize")
RULE_LIKE = ("Rule", "Constraint", "Mode")


def route() -> Column:
    """The route of a record with ``explicit_route, source_stage, transcript_type, is_trace, source_type``: the first that applies."""
    stage, kind = F.col("source_stage"), F.col("source_type")
    return (
        F.when(F.col("explicit_route").isin(*ROUTES), F.col("explicit_route"))
        .when(stage.isin(*STAGES["transcript"]) | F.col("transcript_type").isNotNull(), "transcript")
        .when(stage.isin(*STAGES["experience_trace"]) | F.col("is_trace"), "experience_trace")
        .when(stage.isin(*STAGES["tool_result"]) | (kind == "tool_output"), "tool_result")
        .when(stage.isin(*STAGES["document"]) | kind.isin("document", "rule", "workflow", "skill"), "document")
        .when(kind == "system", "system").otherwise("conversation")
    )


def _trimmed(rows: DataFrame, raw: str, window, base: Column) -> DataFrame:
    """``text, start, stop`` of the pieces ``raw`` of a text, in characters, without white space at the ends; empty ones go."""
    at = base + F.coalesce(F.sum(F.char_length(raw)).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = F.regexp_replace(raw, r"^\s+", "")
    start = at + F.char_length(raw) - F.char_length(tail)
    return rows.withColumn("start", start).withColumn("text", F.regexp_replace(tail, r"\s+$", "")).where("text <> ''").withColumn("stop", F.col("start") + F.char_length("text"))


def sentences(rows: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``key, sentence, text, start, stop`` and ``keep``: cut after ``.!?`` before white space, after full-width stops, at empty lines."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "  "), r"([.!?](?=\s)|[。！？]|\n(?=\n))", "$1\u0001")
    pieces = rows.select(key, *keep, F.posexplode(F.split(marked, "\u0001")).alias("pos", "raw"))
    w = Window.partitionBy(key).orderBy("pos")
    found = _trimmed(pieces, "raw", w, F.lit(0))
    return found.select(key, *keep, F.row_number().over(w).alias("sentence"), "text", "start", "stop")


def clauses(sentences_: DataFrame, key: str, *keep: str, split: Column | None = None) -> DataFrame:
    """``key, sentence, clause, boundary, text, start, stop``: sentences cut after commas and semicolons, and before connectors.

    A connector counts after white space, punctuation or an opening mark.  Where ``split`` is false a sentence is one
    clause, of boundary ``fallback``.
    """
    split = F.lit(True) if split is None else split
    marked = F.regexp_replace("text", "([,，;；])", "$1\u0001")
    marked = F.regexp_replace(marked, rf"(?<=[\s,，；。\[{{'\"“‘\u0001])({CONNECTORS})", "\u0002$1")
    marked = F.when(split, F.regexp_replace(F.regexp_replace(marked, "\u0001\u0002", "\u0002"), "[\u0001\u0002]$", "")).otherwise(F.col("text"))
    rows = sentences_.select(key, *keep, "sentence", F.col("start").alias("base"), split.alias("split"), marked.alias("marked"))
    kinds = F.regexp_extract_all("marked", F.lit("([\u0001\u0002])"), F.lit(1))
    rows = rows.select(key, *keep, "sentence", "base", "split", kinds.alias("kinds"), F.posexplode(F.split("marked", "[\u0001\u0002]")).alias("pos", "raw"))
    ends = F.coalesce(F.get("kinds", F.col("pos")), F.get("kinds", F.size("kinds") - 1))
    boundary = F.when(~F.col("split"), "fallback").when(ends == "\u0001", "punctuation").when(ends == "\u0002", "connector").otherwise("sentence")
    w = Window.partitionBy(key, "sentence").orderBy("pos")
    found = _trimmed(rows.withColumn("boundary", boundary), "raw", w, F.col("base"))
    return found.select(key, *keep, "sentence", F.row_number().over(w).alias("clause"), "boundary", "text", "start", "stop")


def types(norm: Column, route_: Column, has_concept: Column) -> Column:
    """The types that a span may have, of those that its route supports; those of the route where no words say more."""
    first = X.lookup(route_, {r: v[3] for r, v in ROUTES.items()}, "string")
    patterns = X.PATTERNS | MORE_PATTERNS
    found = [F.array(first)]
    for name, kinds in CLASS_TYPES.items():
        said = norm.rlike(P.ascii_words(patterns[name]))
        found.append(F.when(said, F.array(*map(F.lit, kinds))).otherwise(F.array().cast("array<string>")))
    found.append(F.when(has_concept, F.array(F.lit("Topic"), F.lit("Concept"))).otherwise(F.array().cast("array<string>")))
    supported = F.create_map(*(x for r, v in ROUTES.items() for x in (F.lit(r), F.array(*map(F.lit, v[1])))))[route_]
    return F.array_intersect(F.concat(*found), supported)


def spans(records: DataFrame) -> DataFrame:
    """``id, route, sentence, clause, boundary, text, start, stop, span_id, norm, concepts, types`` of records (``id, content, route``)."""
    split = X.lookup(F.col("route"), {r: v[0] for r, v in ROUTES.items()}, "boolean")
    found = clauses(sentences(records, "id", "content", "route"), "id", "route", split=split)
    found = found.withColumn("span_id", F.format_string("%s:sentence-%d-clause-%d", "id", "sentence", "clause"))
    found = found.withColumn("norm", P.flat(F.col("text"))).withColumn("concepts", P.concepts(F.col("text")))
    return found.withColumn("types", types(F.col("norm"), F.col("route"), F.size("concepts") > 0))


def latest_correction(corrections: DataFrame, kind: str, *values: str) -> DataFrame:
    """``target_id, said``: the newest correction of a kind for each target, as a struct of time, id, action and values."""
    said = F.struct("created_at", "id", "action", *values)
    return corrections.where(F.col("target_kind") == kind).groupBy("target_id").agg(F.max(said).alias("said"))


def noise(spans_: DataFrame, corrections: DataFrame) -> DataFrame:
    """``spans_`` with ``disposition`` and ``reason``; the newest correction of a span, by id or text, counts before any rule."""
    newest = latest_correction(corrections.where(F.col("disposition").isin(*DISPOSITIONS)), "noise_policy", "disposition")
    by_id = newest.select(F.col("target_id").alias("span_id"), F.col("said").alias("of_id"))
    by_text = newest.select(F.col("target_id").alias("norm"), F.col("said").alias("of_text"))
    rows = spans_.join(by_id, "span_id", "left").join(by_text, "norm", "left")
    said = F.greatest("of_id", "of_text")
    rows = rows.withColumn("override", F.when(said["action"] != "rollback", said["disposition"]))
    w = Window.partitionBy("id", "norm").orderBy("sentence", "clause").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("override").isNull().cast("int")).over(w), F.lit(0)) > 0
    weak = (F.size(F.array_except("types", F.array(F.lit("Topic"), F.lit("Concept")))) == 0) & (F.size("concepts") == 0) & (F.size(F.split("norm", " ")) <= 3)
    why = (
        F.when(F.col("override").isNotNull(), "override").when(F.col("seen"), "duplicate").when(F.col("norm").rlike(P.ACKNOWLEDGEMENT), "acknowledgement")
        .when(weak, "weak topic").otherwise("signal")
    )
    out = F.coalesce("override", F.create_map(*map(F.lit, ("duplicate", "evidence_only", "acknowledgement", "evidence_only", "weak topic", "hint_only", "signal", "materialize")))[F.col("reason")])
    return rows.withColumn("seen", seen).withColumn("reason", why).withColumn("disposition", out).drop("of_id", "of_text", "override", "seen")


def candidate_entries() -> Column:
    """The node candidates of a span with ``disposition`` and ``primary`` (the type of the record's own node) as an array: structure, topic, concepts."""
    lists = F.create_map(*(x for r, v in ROUTES.items() for x in (F.lit(r), F.array(*map(F.lit, v[2])).cast("array<string>"))))[F.col("route")]
    target = F.get(F.filter(F.array_intersect(lists, F.col("types")), lambda t: ~t.eqNullSafe(F.col("primary"))), F.lit(0))
    hint, kinds = F.col("disposition") == "hint_only", F.col("types")
    entry = lambda at, kind, made, concept: F.struct(at.cast("int").alias("at"), kind.alias("node_type"), F.when(made, "materialize").otherwise("summary_only").alias("made"), concept.alias("concept"))
    none, no = F.lit(None).cast("string"), F.array().cast("array<struct<at:int,node_type:string,made:string,concept:string>>")
    structure = F.when(target.isNotNull() & ~hint, F.array(entry(F.lit(0), target, F.lit(True), none))).otherwise(no)
    specific = (F.size("concepts") > 0) | (F.size(F.split("norm", " ")) >= 4)
    topic = F.when(F.array_contains(kinds, "Topic"), F.array(entry(F.lit(1), F.lit("Topic"), specific & ~hint & (F.col("primary") != "Topic"), none))).otherwise(no)
    concept = F.when(F.array_contains(kinds, "Concept"), F.transform("concepts", lambda c, k: entry(k + 2, F.lit("Concept"), ~hint & (F.col("primary") != "Concept"), c))).otherwise(no)
    extra = F.when(F.col("route").isin("conversation", "transcript", "experience_trace"), F.concat(topic, concept)).otherwise(no)
    return F.when(F.col("disposition").isin("drop", "evidence_only"), no).otherwise(F.concat(structure, extra))


def node_candidates(decided: DataFrame) -> DataFrame:
    """Node candidates of spans with ``disposition`` and ``primary``, a row each."""
    rows = decided.where(~F.col("disposition").isin("drop", "evidence_only")).withColumn("c", F.explode(candidate_entries()))
    rows = rows.select("id", "route", "sentence", "clause", "span_id", "text", "norm", F.size("concepts").alias("n_concepts"), "c.*")
    preview = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 96)
    rows = rows.withColumn("label", F.when(F.col("node_type") == "Concept", F.replace("concept", F.lit("_"), F.lit(" "))).otherwise(preview))
    own = F.sha2(F.concat_ws("|", F.lit("context-node-candidate"), "route", "span_id", "node_type", F.coalesce("concept", F.lit("")), "made"), 256)
    return rows.withColumn("candidate_id", own)


def summary_candidates(candidates: DataFrame) -> DataFrame:
    """Per record and slot one candidate a label: the first one's id and form, and all spans that say the same."""
    slot = X.lookup(F.col("node_type"), SLOT_OF, "string")
    form = F.when((F.col("made") == "summary_only") | F.col("node_type").isin("Topic", "Concept"), "summary").when(F.col("node_type") == "Tool", "citation_only").otherwise("raw")
    first = F.min(F.struct("sentence", "clause", "at", "candidate_id", "node_type", form.alias("form"), "label")).alias("f")
    rows = candidates.withColumn("slot", slot).where("slot is not null").groupBy("id", "slot", P.flat(F.col("label")).alias("said")).agg(first, F.countDistinct("span_id").alias("n_spans"))
    return rows.select("id", "slot", F.sha2(F.concat_ws("|", F.lit("context-summary-candidate"), "f.candidate_id", "f.node_type"), 256).alias("summary_id"), "f.form", "f.label", "n_spans")


def experience_hints(candidates: DataFrame) -> DataFrame:
    """Per record with steps or failures: its procedure's spans in order, the critical one (the last), and its status."""
    made = candidates.where("made = 'materialize'")
    place = F.struct("sentence", "clause", "at", "span_id")
    step = F.col("node_type").isin("Process", "Step")
    failed = F.col("node_type").isin("Risk", "State") & F.col("norm").rlike(P.ascii_words(FAILURE))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, place))), lambda s: s["span_id"])
    rows = made.where(step | failed).groupBy("id", "route").agg(ids(step).alias("steps"), ids(failed).alias("failures"))
    critical = F.coalesce(F.get("steps", F.size("steps") - 1), F.lit(""))
    status = F.when((F.size("steps") > 0) & (F.size("failures") > 0), "mixed").when(F.size("failures") > 0, "failure_only").otherwise("procedure_only")
    key = F.concat_ws("|", F.lit("context-processing-attempt"), "route", F.array_join("steps", ","), F.array_join("failures", ","), critical)
    return rows.select("id", status.alias("status"), F.size("steps").alias("n_steps"), critical.alias("critical"), F.sha2(key, 256).alias("attempt_id"))


def strength(source_type: Column) -> Column:
    return F.when(source_type.isin("system", "rule"), "hard").when(source_type.isin("workflow", "skill"), "soft").otherwise("heuristic")


def confidence(source_type: Column) -> Column:
    return F.when(source_type.isin("system", "rule"), 1.0).when(source_type.isin("workflow", "skill"), 0.9).when(source_type == "tool_output", 0.95).otherwise(0.7)


def kind(node_type: Column) -> Column:
    return (
        F.when(node_type.isin("Rule", "Constraint", "Mode"), "norm")
        .when(node_type.isin("Command", "Process", "Step", "Skill", "Attempt", "Episode", "ProcedureCandidate", "Pattern", "SuccessfulProcedure"), "process")
        .when(node_type.isin("Risk", "FailurePattern"), "inference").when(node_type.isin("State", "Goal", "Intent", "Outcome", "FailureSignal"), "state").otherwise("fact")
    )


def span_nodes(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes of the candidates that are materialised, with their records' (``id, session_id, scope, source_type``) attributes."""
    rows = candidates.where("made = 'materialize'").join(records.select("id", "session_id", "scope", "source_type"), "id")
    plain = F.trim(F.regexp_replace(F.regexp_replace("norm", r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    anchor = F.coalesce("concept", F.substring(plain, 1, 96))
    group_key = F.array_join(F.filter(F.array(F.lit("span"), "scope", "route", "node_type", anchor), lambda x: x != ""), "|")
    base, is_ = confidence(F.col("source_type")), lambda k: (F.col("node_type") == k).cast("int")
    sure = base - is_("Topic") * 0.08 - is_("Concept") * 0.03 - (F.char_length("norm") < 12).cast("int") * 0.05 + F.col("concept").isNotNull().cast("int") * 0.08
    own = strength(F.col("source_type"))
    weaker = F.when(F.col("node_type").isin("Concept", "Topic"), "heuristic").when(own == "hard", "soft").otherwise(own)
    rows = rows.withColumn("group_key", group_key)
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit("semantic"), "session_id", "node_type", "group_key"), 256).alias("node_id"), F.col("id").alias("record_id"), "session_id", F.col("node_type").alias("type"), "scope",
        F.concat(F.lower("node_type"), F.lit(":"), "label").alias("label"), weaker.alias("strength"), F.round(F.greatest(F.lit(0.45), F.least(F.lit(0.97), sure)), 6).alias("confidence"), kind(F.col("node_type")).alias("kind"),
        F.concat(F.lit("v:"), F.substring(F.sha2(F.concat_ws("|", F.lit("semantic-span-version"), "norm", F.coalesce("concept", F.lit("")), "route"), 256), 1, 12)).alias("version"),
        F.when(F.col("node_type").isin(*RULE_LIKE), F.col("group_key")).alias("conflict_key"), "sentence", "clause", "at",
    )


def group_key() -> Column:
    """The key that a record's own node has beyond its record: scope, source, type and an anchor of its first line; null for types without one."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    first = plain(F.get(F.split("content", r"\r?\n"), F.lit(0)))
    anchor = F.substring(F.when(first != "", first).otherwise(plain("content")), 1, 72)
    stable = F.col("type").isin("Rule", "Constraint", "Process", "Step", "Risk", "Skill", "Mode", "Outcome", "Tool", "Topic", "Concept")
    return F.when(stable, F.concat_ws("|", "scope", "source_type", "type", F.array_join(F.filter(F.array(F.lower("type"), anchor), lambda x: x != ""), "|")))


def supports(nodes: DataFrame) -> DataFrame:
    """An edge from each node to the evidence of its record; a node that several records give has one to each."""
    edges = nodes.select(F.col("node_id").alias("from_id"), F.col("record_id").alias("to_id"), "scope").distinct()
    return edges.select(F.sha2(F.concat_ws("|", F.lit("edge"), "from_id", "to_id", F.lit("supported_by"), "scope"), 256).alias("edge_id"), "from_id", "to_id")
