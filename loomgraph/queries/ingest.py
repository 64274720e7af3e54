"""Queries of ingestion: turns with phrases added, so that every branch is met, from texts to nodes and their support."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import ingest as I
from loomgraph.operators import memo as M
from loomgraph.operators.selection import spread
from loomgraph.operators.store import folder_of
from loomgraph.queries.entities import ENTITIES, entity_edges
from loomgraph.queries.model_sql import RECORDS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

RECS = """recs AS (SELECT *, 'session' AS scope, CASE turn % 7 WHEN 0 THEN 'First we need a workflow, and then the KG checkpoint; ok. ' || content WHEN
    1 THEN 'You must not stop because the build failed. ' || content
    WHEN 2 THEN content || '. Thanks. Thanks. Got it!' WHEN 3 THEN 'What is the next step? ' || content WHEN 4 THEN content || '，但是 需要 图谱，检查点。好的！'
    WHEN 5 THEN 'Debug mode' || chr(10) || chr(10) || 'two, 3.5 words. ' || content ELSE content END AS said,
  CASE WHEN turn % 13 = 12 THEN 'document' END AS explicit_route, CASE turn % 5 WHEN 1 THEN 'transcript_message' WHEN 2 THEN 'checkpoint' WHEN
    3 THEN 'tool_result_persist' END AS source_stage,
  CASE WHEN turn % 9 = 4 THEN 'custom_message' END AS transcript_type, turn % 11 = 5 AS is_trace FROM records),
routed AS (SELECT *, CASE WHEN explicit_route IS NOT NULL THEN explicit_route WHEN source_stage = 'transcript_message' OR transcript_type IS
    NOT NULL THEN 'transcript' WHEN source_stage = 'checkpoint' OR is_trace THEN 'experience_trace'
  WHEN source_stage = 'tool_result_persist' OR source_type = 'tool_output' THEN 'tool_result' WHEN source_type = 'system' THEN 'system' ELSE 'conversation' END AS route FROM recs)"""

SENTENCES = """pieces AS (SELECT id, route, unnest(p) AS raw, generate_subscripts(p, 1) AS k FROM (SELECT id, route, string_split(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(said,
    ''), chr(1) || chr(2), '  '), '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), '([。！？])', '\\1' || chr(1), 'g'), '\\n\\n', chr(10) || chr(1)
    || chr(10), 'g'), chr(1)) AS p FROM routed)),
placed AS (SELECT id, route, k, raw, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS text, length(raw) - length(regexp_replace(raw,
    '^\\s+', '')) + coalesce(sum(length(raw)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM pieces),
sentences AS (SELECT id, route, row_number() OVER (PARTITION BY id ORDER BY k) AS sentence, text, start::BIGINT AS start, (start + length(text))::BIGINT
    AS stop FROM placed WHERE text <> '')"""

_CONNECTOR = "([\\s,，；。\\[{''\"“‘])((?:and|but|then|however|because|while|before|after|if|when|unless|so|or)\\b|但是|不过|然后|并且|而且|以及|如果|因为|所以|否则|之后|之前|同时|另外|或者)"
CLAUSES = f"""marked AS (SELECT id, route, sentence, start AS base, route IN ('conversation', 'transcript', 'experience_trace') AS split, text,
  regexp_replace(regexp_replace(replace(regexp_replace(text, '{_CONNECTOR}', '\\1' || chr(2) || '\\2', 'gi'), '', ''), '([,，;；])([^' || chr(2)
    || ']|$)', '\\1' || chr(1) || '\\2', 'g'), '[' || chr(1) || ']$', '') AS m FROM sentences),
cut AS (SELECT id, route, sentence, base, split, CASE WHEN split THEN string_split_regex(m, '[' || chr(1) || chr(2) || ']') ELSE [text] END AS
    p, CASE WHEN split THEN regexp_extract_all(m, '[' || chr(1) || chr(2) || ']') ELSE [] END AS e FROM marked),
bits AS (SELECT id, route, sentence, base, split, e, unnest(p) AS raw, generate_subscripts(p, 1) AS k FROM cut),
located AS (SELECT *, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS text, base + length(raw) - length(regexp_replace(raw,
    '^\\s+', '')) + coalesce(sum(length(raw)) OVER (PARTITION BY id, sentence ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS start,
  CASE WHEN NOT split THEN 'fallback' ELSE CASE coalesce(e[k], e[len(e)]) WHEN chr(1) THEN 'punctuation' WHEN chr(2) THEN 'connector' ELSE 'sentence'
    END END AS boundary FROM bits),
clauses AS (SELECT id, route, sentence, row_number() OVER (PARTITION BY id, sentence ORDER BY k) AS clause, boundary, text, start::BIGINT AS
    start, (start + length(text))::BIGINT AS stop FROM located WHERE text <> '')"""

_ALIASES = (
    ("artifact_sidecar", "' artifact sidecar ', ' sidecar artifact ', ' sidecar ', '工件 sidecar', '旁路产物', '侧挂产物'"), ("checkpoint", "' checkpoint ', ' state checkpoint ', ' memory checkpoint ', '检查点', '状态检查点', '记忆检查点'"),
    ("context_compression", "' context compression ', ' prompt compression ', ' compact context ', ' compressed context ', ' ctx compression ', '上下文压缩', '提示词压缩', '压缩上下文', '紧凑上下文'"),
    ("knowledge_graph", "' knowledge graph ', ' kg ', ' semantic graph ', '知识图谱', '语义图谱', '图谱'"), ("provenance", "' provenance ', ' source lineage ', ' source trail ', '来源追踪', '来源链路', '溯源', '出处'"),
    ("runtime_bundle", "' runtime bundle ', ' context bundle ', ' bundle ', '运行时上下文包', '上下文包', 'bundle 诊断'"), ("traceability", "' traceability ', ' trace view ', ' trace ', '可追溯性', '追踪视图', '追踪链路'"),
)
_CONCEPTS = ", ".join(f"CASE WHEN len([a FOR a IN [{names}] IF contains(p, a)]) > 0 THEN '{c}' END" for c, names in _ALIASES)
_SAYS = (
    ("\\?$|怎么|如何|为何|为什么|哪一步|哪个|什么|\\b(?:what|why|how|which)\\b", "'Intent', 'Topic'"), ("\\b(?:need|goal|want|trying to|aim to)\\b|需要|目标|想要|打算|准备", "'Goal'"),
    ("\\b(?:must|must not|should|should not|cannot|can not|can''t|never|required|requirement)\\b|必须|不能|不可以|不要|禁止|要求", "'Constraint', 'Rule'"),
    ("\\b(?:step|next step|first|second|before|after|then)\\b|第.{0,3}步|下一步|先|再|之后|然后", "'Step', 'Process'"), ("\\b(?:process|workflow|pipeline|phase|stage)\\b|流程|工作流|阶段|管线", "'Process'"),
    ("\\b(?:risk|warning|blocked|failure|failed|error|exception|timeout|incident)\\b|风险|警告|失败|错误|异常|超时|阻塞", "'Risk', 'State'"), ("\\b(?:result|outcome|success|succeeded|completed)\\b|结果|产出|成功|完成", "'Outcome'"),
    ("\\b(?:tool|cli|command|api|script|artifact)\\b|工具|命令|脚本|接口|产物", "'Tool'"), ("\\b(?:mode|strict mode|debug mode|compatibility)\\b|模式|调试模式|严格模式|兼容模式", "'Mode'"), ("\\b(?:skill|pattern|playbook|procedure)\\b|技能|模式|经验|流程卡片", "'Skill'"),
    ("\\b(?:provenance|checkpoint|knowledge graph|context compression|prompt|bundle|trace)\\b|知识图谱|上下文压缩|来源追踪|检查点|提示词|上下文包", "'Topic', 'Concept'"),
)
_TYPES = " || ".join(f"CASE WHEN regexp_matches(norm, '{p}') THEN [{t}] ELSE [] END" for p, t in _SAYS)
SPANS = f"""worded AS (SELECT *, id || ':sentence-' || sentence || '-clause-' || clause AS span_id, trim(regexp_replace(lower(translate(text, '，！；？', ',!;?')), '\\s+', ' ', 'g')) AS norm FROM clauses),
named AS (SELECT * EXCLUDE (p), [c FOR c IN [{_CONCEPTS}] IF c IS NOT NULL] AS concepts FROM (SELECT *, ' ' || trim(regexp_replace(regexp_replace(norm,
    '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' AS p FROM worded)),
spans AS (SELECT *, list_sort([t FOR t IN list_distinct([CASE route WHEN 'conversation' THEN 'Intent' WHEN 'tool_result' THEN 'State' WHEN 'transcript'
    THEN 'Decision' WHEN 'experience_trace' THEN 'Decision' ELSE 'Topic' END] || {_TYPES} || CASE WHEN len(concepts) > 0 THEN ['Topic', 'Concept']
    ELSE [] END)
  IF list_contains(CASE route WHEN 'conversation' THEN ['Intent', 'Goal', 'Constraint', 'Risk', 'Process', 'Step', 'Topic', 'Concept'] WHEN 'tool_result'
    THEN ['State', 'Risk', 'Outcome', 'Tool', 'Process', 'Step', 'Topic', 'Concept']
    WHEN 'transcript' THEN ['Intent', 'Decision', 'State', 'Constraint', 'Process', 'Step', 'Risk', 'Topic', 'Concept'] WHEN 'document' THEN
    ['Rule', 'Constraint', 'Process', 'Step', 'Skill', 'Outcome', 'Tool', 'Topic', 'Concept']
    WHEN 'experience_trace' THEN ['Decision', 'State', 'Risk', 'Process', 'Step', 'Skill', 'Topic', 'Concept'] ELSE ['Rule', 'Constraint', 'Mode',
    'Process', 'Step', 'Topic', 'Concept'] END, t)]) AS types FROM named)"""

#: corrections of spans by id, and of one text
FIXES = """fixes AS (SELECT 'm' || event_id AS id, CASE WHEN event_id % 50 = 7 THEN 'got it!' ELSE 'c' || user_id || '.' || (event_id % 4) || ':sentence-1-clause-1'
    END AS target_id, CASE WHEN event_id % 5 = 0 THEN 'rollback' ELSE 'apply' END AS action,
  CASE WHEN event_id % 7 < 4 THEN (['drop', 'evidence_only', 'hint_only', 'materialize'])[(event_id % 7 + 1)::INTEGER] END AS disposition, lpad(event_id::VARCHAR,
    12, '0') AS created_at FROM events WHERE event_type = 'error'),
newest AS (SELECT target_id, max({'c': created_at, 'i': id, 'a': action, 'd': disposition}) AS s FROM fixes WHERE disposition IS NOT NULL GROUP BY 1)"""
NOISE = """fixed AS (SELECT s.*, CASE WHEN f.a <> 'rollback' THEN f.d END AS override FROM (SELECT s.*, greatest(a.s, b.s) AS f FROM spans s LEFT JOIN newest
    a ON a.target_id = s.span_id LEFT JOIN newest b ON b.target_id = s.norm) s),
noise AS (SELECT * EXCLUDE (earlier), CASE WHEN override IS NOT NULL THEN override WHEN earlier > 0 THEN 'evidence_only'
  WHEN regexp_matches(norm, '^(?:ok|okay|yes|yep|yeah|sure|thanks|thank you|got it|understood|fine|cool|roger|copy|好的|行|恩|嗯|明白|收到|谢谢|好吧)$') THEN 'evidence_only'
  WHEN len([t FOR t IN types IF t NOT IN ('Topic', 'Concept')]) = 0 AND len(concepts) = 0 AND len(string_split(norm, ' ')) <= 3 THEN 'hint_only'
    ELSE 'materialize' END AS disposition
  FROM (SELECT *, count(*) FILTER (WHERE override IS NULL) OVER (PARTITION BY id, norm ORDER BY sentence, clause ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) AS earlier FROM fixed))"""
PRIMARY = """primaries AS (SELECT id, session_id, source_type, scope, CASE role WHEN 'user' THEN 'Intent' WHEN 'system' THEN 'Rule' WHEN
    'assistant' THEN CASE WHEN turn % 2 = 0 THEN 'Topic' ELSE 'Decision' END ELSE 'State' END AS type, content FROM recs)"""
CANDIDATES = """live AS (SELECT n.*, p.type AS prim FROM noise n JOIN primaries p ON p.id = n.id WHERE disposition NOT IN ('drop', 'evidence_only')),
options AS (SELECT *, [t FOR t IN CASE route WHEN 'experience_trace' THEN ['Process', 'Step', 'Constraint'] WHEN 'conversation' THEN ['Goal',
    'Constraint', 'Process', 'Step'] WHEN 'transcript' THEN ['Goal', 'Constraint', 'Process', 'Step'] ELSE [] END IF list_contains(types, t)
    AND t <> prim][1] AS target, route IN ('conversation', 'transcript', 'experience_trace') AS extra FROM live),
chosen AS (
  SELECT id, route, sentence, clause, span_id, text, norm, 0 AS at, target AS node_type, 'materialize' AS made, NULL AS concept FROM options
    WHERE target IS NOT NULL AND disposition <> 'hint_only'
  UNION ALL SELECT id, route, sentence, clause, span_id, text, norm, 1, 'Topic', CASE WHEN prim <> 'Topic' AND disposition <> 'hint_only' AND
    (len(concepts) > 0 OR len(string_split(norm, ' ')) >= 4) THEN 'materialize' ELSE 'summary_only' END, NULL FROM options WHERE extra AND list_contains(types,
    'Topic')
  UNION ALL SELECT id, route, sentence, clause, span_id, text, norm, 1 + k, 'Concept', CASE WHEN prim <> 'Concept' AND disposition <> 'hint_only'
    THEN 'materialize' ELSE 'summary_only' END, concept
    FROM (SELECT *, unnest(sorted) AS concept, generate_subscripts(sorted, 1) AS k FROM (SELECT *, [c FOR c IN ['context_compression', 'knowledge_graph',
    'provenance', 'checkpoint', 'runtime_bundle', 'traceability', 'artifact_sidecar'] IF list_contains(concepts, c)] AS sorted FROM options WHERE
    extra AND list_contains(types, 'Concept')))),
candidates AS (SELECT *, CASE WHEN node_type = 'Concept' THEN replace(concept, '_', ' ') ELSE left(trim(regexp_replace(text, '\\s+', ' ', 'g')),
    96) END AS label, sha256('context-node-candidate|' || route || '|' || span_id || '|' || node_type || '|' || coalesce(concept, '') || '|'
    || made) AS candidate_id FROM chosen)"""
SUMMARIES = """slotted AS (SELECT *, CASE WHEN node_type = 'Goal' THEN 'goal' WHEN node_type = 'Intent' THEN 'intent' WHEN node_type IN ('Process', 'Step')
    THEN 'currentProcess' WHEN node_type IN ('Constraint', 'Mode') THEN 'activeConstraints' ELSE 'relevantEvidence' END AS slot, trim(regexp_replace(lower(label),
    '\\s+', ' ', 'g')) AS said,
  row_number() OVER (PARTITION BY id, CASE WHEN node_type = 'Goal' THEN 1 WHEN node_type = 'Intent' THEN 2 WHEN node_type IN ('Process', 'Step')
    THEN 3 WHEN node_type IN ('Constraint', 'Mode') THEN 4 ELSE 5 END, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) ORDER BY sentence,
    clause, "at") AS r FROM candidates)"""
HINTS = """steps AS (SELECT id, route, list(span_id ORDER BY sentence, clause, "at") AS s FROM candidates WHERE made = 'materialize' AND node_type IN ('Process', 'Step') GROUP BY 1, 2)"""
MADE = """grouped AS (SELECT c.*, p.session_id, p.source_type, p.scope, 'span|' || p.scope || '|' || route || '|' || node_type || CASE WHEN a <> '' THEN '|' || a ELSE '' END AS group_key,
  CASE p.source_type WHEN 'system' THEN 1.0 WHEN 'tool_output' THEN 0.95 ELSE 0.7 END - CASE node_type WHEN 'Topic' THEN 0.08 WHEN 'Concept'
    THEN 0.03 ELSE 0 END - CASE WHEN length(norm) < 12 THEN 0.05 ELSE 0 END + CASE WHEN concept IS NOT NULL THEN 0.08 ELSE 0 END AS sure
  FROM (SELECT *, coalesce(concept, left(trim(regexp_replace(regexp_replace(norm, '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 96)) AS
    a FROM candidates WHERE made = 'materialize') c JOIN primaries p ON p.id = c.id),
made AS (SELECT sha256('semantic|' || session_id || '|' || node_type || '|' || group_key) AS node_id, id AS record_id, node_type AS type, scope,
    lower(node_type) || ':' || label AS label, CASE WHEN node_type IN ('Concept', 'Topic') THEN 'heuristic' WHEN source_type = 'system' THEN
    'soft' ELSE 'heuristic' END AS strength,
  round(greatest(0.45, least(0.97, sure)), 6)::DOUBLE AS confidence, CASE WHEN node_type = 'Constraint' THEN 'norm' WHEN node_type IN ('Process',
    'Step') THEN 'process' WHEN node_type = 'Goal' THEN 'state' ELSE 'fact' END AS kind,
  'v:' || left(sha256('semantic-span-version|' || norm || '|' || coalesce(concept, '') || '|' || route), 12) AS version, CASE WHEN node_type
    = 'Constraint' THEN group_key END AS conflict_key, span_id FROM grouped)"""

BASE = with_(RECORDS, RECS)
TO_CLAUSES = BASE + ", " + SENTENCES + ", " + CLAUSES
TO_SPANS = TO_CLAUSES + ", " + SPANS
TO_NOISE = TO_SPANS + ", " + FIXES + ", " + NOISE
TO_CANDIDATES = TO_NOISE + ", " + PRIMARY + ", " + CANDIDATES


#: what is remembered of a span
SPANS_KEPT = "sentence int, clause int, boundary string, text string, norm string, concepts array<string>, types array<string>"


def records(spark, d):
    """Turns as records with a route's facts and phrases that meet every branch."""
    r, t, c = spread(C.records(spark, d)), F.col("turn"), F.col("content")
    said = (
        F.when(t % 7 == 0, F.concat(F.lit("First we need a workflow, and then the KG checkpoint; ok. "), c)).when(t % 7 == 1, F.concat(F.lit("You must not stop because the build failed. "), c))
        .when(t % 7 == 2, F.concat(c, F.lit(". Thanks. Thanks. Got it!"))).when(t % 7 == 3, F.concat(F.lit("What is the next step? "), c)).when(t % 7 == 4, F.concat(c, F.lit("，但是 需要 图谱，检查点。好的！")))
        .when(t % 7 == 5, F.concat(F.lit("Debug mode\n\ntwo, 3.5 words. "), c)).otherwise(c)
    )
    stage = F.when(t % 5 == 1, "transcript_message").when(t % 5 == 2, "checkpoint").when(t % 5 == 3, "tool_result_persist")
    r = r.withColumns({"scope": F.lit("session"), "content": said, "explicit_route": F.when(t % 13 == 12, "document"), "source_stage": stage, "transcript_type": F.when(t % 9 == 4, "custom_message"), "is_trace": t % 11 == 5})
    own = F.when(F.col("role") == "user", "Intent").when(F.col("role") == "system", "Rule").when(F.col("role") == "assistant", F.when(t % 2 == 0, "Topic").otherwise("Decision")).otherwise("State")
    return r.withColumn("route", I.route()).withColumn("primary", own)


def fixes(spark, d):
    e, n = C.read(spark, d, "events").where("event_type = 'error'"), F.col("event_id")
    target = F.when(n % 50 == 7, "got it!").otherwise(F.concat(F.lit("c"), "user_id", F.lit("."), n % 4, F.lit(":sentence-1-clause-1")))
    said = F.get(F.array(*map(F.lit, I.DISPOSITIONS)), (n % 7).cast("int"))
    return e.select(F.concat(F.lit("m"), n).alias("id"), F.lit("noise_policy").alias("target_kind"), target.alias("target_id"), F.when(n % 5 == 0, "rollback").otherwise("apply").alias("action"), said.alias("disposition"), F.lpad(n.cast("string"), 12, "0").alias("created_at"))


def candidates(spark, d):
    r = records(spark, d)
    decided = I.noise(I.spans(r), fixes(spark, d)).join(r.select("id", "primary"), "id")
    return I.node_candidates(decided)


@query("ref_op231_remembered_spans", TO_SPANS + """, met AS (SELECT *, conv_id % 10 = 0 AS late FROM (SELECT id, route, said, conv_id FROM routed r)), known AS (SELECT DISTINCT said, route FROM met WHERE NOT late AND said IS NOT NULL)
    SELECT m.id, k.said IS NOT NULL OR m.said IS NULL AND (SELECT count(*) FROM met WHERE NOT late AND said IS NULL AND route = m.route) > 0 AS met, coalesce(s.n, 0) AS spans, coalesce(s.first, '') AS first_norm FROM met m
    LEFT JOIN known k ON k.said = m.said AND k.route = m.route LEFT JOIN (SELECT id, count(*) AS n, arg_min(norm, (sentence, clause)) AS first FROM spans GROUP BY 1) s ON s.id = m.id""")
def remembered_spans(spark, d):
    """Nine tenths of the conversations are met first, then all; what is new is processed alone."""
    r = records(spark, d).select("id", "content", "route", "conv_id")
    memo = M.memo(spark, f"{folder_of(r, 'memo')}", SPANS_KEPT)
    M.remembered(r.where("conv_id % 10 <> 0").select("id", "content", "route"), memo, I.spans, "spans-1")
    rows = M.remembered(r.select("id", "content", "route"), memo, I.spans, "spans-1")
    first = F.array_min(F.transform("kept", lambda s: F.struct(s["sentence"], s["clause"], s["norm"])))["norm"]
    return rows.select("id", F.col("met"), F.size("kept").cast("long").alias("spans"), F.coalesce(first, F.lit("")).alias("first_norm"))


@query("ref_op187_route_resolution", BASE + "SELECT id, route FROM routed")
def route_resolution(spark, d):
    return records(spark, d).select("id", "route")


@query("ref_op186_route_contract", """SELECT * FROM (VALUES ('conversation', TRUE, 8, 4), ('tool_result', FALSE, 8, 0), ('transcript', TRUE, 9, 4), ('document',
    FALSE, 9, 0), ('experience_trace', TRUE, 8, 3), ('system', FALSE, 7, 0)) t(route, clause_split, n_types, n_structural)""")
def route_contract(spark, d):
    return spark.createDataFrame([(r, v[0], len(v[1]), len(v[2])) for r, v in I.ROUTES.items()], "route string, clause_split boolean, n_types int, n_structural int")


@query("ref_op184_sentences", BASE + ", " + SENTENCES + " SELECT id, sentence, start, stop, sha256(text) AS text_sha FROM sentences")
def sentences(spark, d):
    return I.sentences(records(spark, d), "id", "content").select("id", "sentence", "start", "stop", F.sha2("text", 256).alias("text_sha"))


@query("ref_op185_clauses", TO_CLAUSES + " SELECT id, sentence, clause, boundary, start, stop, sha256(text) AS text_sha FROM clauses")
def clauses(spark, d):
    return I.spans(records(spark, d)).select("id", "sentence", "clause", "boundary", "start", "stop", F.sha2("text", 256).alias("text_sha"))


@query("ref_op188_concepts", TO_SPANS + " SELECT span_id, array_to_string(list_sort(concepts), ',') AS concepts FROM spans")
def concepts(spark, d):
    return I.spans(records(spark, d)).select("span_id", F.array_join(F.array_sort("concepts"), ",").alias("concepts"))


@query("ref_op189_semantic_classes", TO_SPANS + " SELECT span_id, array_to_string(types, ',') AS types FROM spans")
def semantic_classes(spark, d):
    return I.spans(records(spark, d)).select("span_id", F.array_join(F.array_sort("types"), ",").alias("types"))


@query("ref_op230_record_spans", TO_SPANS + " SELECT id, route, count(*) AS n_spans, sum(len(concepts))::BIGINT AS n_concepts, sum(stop - start)::BIGINT AS chars, max(span_id) AS last FROM spans GROUP BY 1, 2")
def record_spans(spark, d):
    s = I.spans(records(spark, d))
    return s.groupBy("id", "route").agg(F.count("*").alias("n_spans"), F.sum(F.size("concepts")).alias("n_concepts"), F.sum(F.col("stop") - F.col("start")).alias("chars"), F.max("span_id").alias("last"))


@query("ref_op232_noise_policy", TO_NOISE + " SELECT span_id, disposition FROM noise")
def noise_policy(spark, d):
    return I.noise(I.spans(records(spark, d)), fixes(spark, d)).select("span_id", "disposition")


@query("ref_op233_node_candidates", TO_CANDIDATES + " SELECT candidate_id, span_id, node_type, made, label FROM candidates")
def node_candidates(spark, d):
    return candidates(spark, d).select("candidate_id", "span_id", "node_type", "made", "label")


@query("ref_op234_summary_candidates", TO_CANDIDATES + ", " + SUMMARIES + """ SELECT f.id, f.slot, sha256('context-summary-candidate|' || f.candidate_id || '|' || f.node_type) AS summary_id, CASE WHEN
    f.made = 'summary_only' OR f.node_type IN ('Topic', 'Concept') THEN 'summary' ELSE 'raw' END AS form, f.label, count(DISTINCT a.span_id)
    AS n_spans FROM slotted f JOIN slotted a ON a.id = f.id AND a.slot = f.slot AND a.said = f.said WHERE f.r = 1 GROUP BY f.id, f.slot, f.candidate_id,
    f.node_type, f.made, f.label""")
def summary_candidates(spark, d):
    return I.summary_candidates(candidates(spark, d))


@query("ref_op235_experience_hints", TO_CANDIDATES + ", " + HINTS + """ SELECT id, 'procedure_only' AS status, len(s)::INTEGER AS n_steps, s[len(s)] AS critical, sha256('context-processing-attempt|'
    || route || '|' || array_to_string(s, ',') || '||' || s[len(s)]) AS attempt_id FROM steps""")
def experience_hints(spark, d):
    return I.experience_hints(candidates(spark, d))


@query("ref_op236_span_nodes", TO_CANDIDATES + ", " + MADE + " SELECT DISTINCT node_id, record_id, type, label, strength, confidence, kind, version, conflict_key FROM made")
def span_nodes(spark, d):
    return I.span_nodes(candidates(spark, d), records(spark, d)).select("node_id", "record_id", "type", "label", "strength", "confidence", "kind", "version", "conflict_key").distinct()


@query(
    "ref_op231_process_record",
    TO_CANDIDATES
    + """, s AS (SELECT id, count(*) AS spans, count(*) FILTER (WHERE disposition = 'drop') AS dropped, count(*) FILTER (WHERE disposition = 'evidence_only')
    AS evidence_only, count(*) FILTER (WHERE disposition = 'hint_only') AS hints, count(*) FILTER (WHERE disposition = 'materialize') AS materialize,
    sum(len(concepts))::BIGINT AS concepts FROM noise GROUP BY 1),
  c AS (SELECT id, count(*) AS candidates, count(*) FILTER (WHERE made = 'materialize') AS made FROM candidates GROUP BY 1)
  SELECT id, spans, dropped, evidence_only, hints, materialize, concepts, coalesce(candidates, 0) AS candidates, coalesce(made, 0) AS made FROM s LEFT JOIN c USING (id)""",
)
def process_record(spark, d):
    """Spans and their candidates are counted in one pass; records without a span have no row."""
    r, n = records(spark, d), lambda k: F.count_if(F.col("disposition") == k)
    decided = I.noise(I.spans(r), fixes(spark, d)).join(r.select("id", "primary"), "id").withColumn("entries", I.candidate_entries())
    size = lambda c: F.sum(F.size(c))
    return decided.groupBy("id").agg(
        F.count("*").alias("spans"), n("drop").alias("dropped"), n("evidence_only").alias("evidence_only"), n("hint_only").alias("hints"), n("materialize").alias("materialize"), size("concepts").alias("concepts"),
        size("entries").alias("candidates"), size(F.filter("entries", lambda x: x["made"] == "materialize")).alias("made"),
    )


@query(
    "ref_op117_processing_totals",
    TO_NOISE + """ SELECT route, count(DISTINCT id) AS records, count(*) AS spans, sum(len(concepts))::BIGINT AS concepts, count(*) FILTER
    (WHERE disposition IN ('drop', 'evidence_only')) AS noise, round(count(*) FILTER (WHERE disposition IN ('drop', 'evidence_only')) / count(*)::DOUBLE,
    6) AS noise_rate FROM noise GROUP BY 1""",
)
def processing_totals(spark, d):
    low = F.count_if(F.col("disposition").isin("drop", "evidence_only"))
    return I.noise(I.spans(records(spark, d)), fixes(spark, d)).groupBy("route").agg(F.countDistinct("id").alias("records"), F.count("*").alias("spans"), F.sum(F.size("concepts")).alias("concepts"), low.alias("noise"), F.round(low / F.count("*"), 6).alias("noise_rate"))


_KEY = "CASE WHEN type IN ('Rule', 'Topic') THEN scope || '|' || source_type || '|' || type || '|' || lower(type) || CASE WHEN a <> '' THEN '|' || a ELSE '' END END"
OWN = f"""own AS (SELECT id, session_id, type, scope, group_key, sha256('semantic|' || session_id || '|' || type || '|' || coalesce(group_key, id)) AS
    node_id FROM (SELECT *, {_KEY} AS group_key FROM (SELECT *, left(CASE WHEN f <> '' THEN f ELSE w END, 72) AS a FROM (SELECT *,
  trim(regexp_replace(regexp_replace(lower(regexp_extract(said, '^[^\\r\\n]*')), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS f,
    trim(regexp_replace(regexp_replace(lower(said), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS w FROM (SELECT p.*, r.said FROM
    primaries p JOIN recs r ON r.id = p.id)))))"""


def own_nodes(spark, d):
    r = records(spark, d).withColumn("type", F.col("primary"))
    r = r.withColumn("group_key", I.group_key())
    return r.withColumn("node_id", F.sha2(F.concat_ws("|", F.lit("semantic"), "session_id", "type", F.coalesce("group_key", "id")), 256))


@query("ref_op193_semantic_keys", with_(RECORDS, RECS, PRIMARY, OWN) + "SELECT id, group_key FROM own")
def semantic_keys(spark, d):
    return own_nodes(spark, d).select("id", "group_key")


@query("ref_op065_primary_nodes", with_(RECORDS, RECS, PRIMARY, OWN) + "SELECT id, node_id, type, group_key IS NOT NULL AS merges, type = 'Rule' AS rule_like FROM own")
def primary_nodes(spark, d):
    return own_nodes(spark, d).select("id", "node_id", "type", F.col("group_key").isNotNull().alias("merges"), F.col("type").isin(*I.RULE_LIKE).alias("rule_like"))


@query(
    "ref_op238_ingest",
    TO_CANDIDATES + ", " + MADE + ", " + OWN + ", " + ENTITIES
    + """, every AS (SELECT DISTINCT node_id AS from_id, record_id AS to_id FROM made UNION SELECT node_id, id FROM own) SELECT sha256('edge|'
    || from_id || '|' || to_id || '|supported_by|session') AS edge_id, from_id, to_id FROM every UNION ALL SELECT edge_id, from_id, to_id FROM entity_edges""",
)
def ingest(spark, d):
    own = own_nodes(spark, d).select("node_id", F.col("id").alias("record_id"), "scope")
    supports = I.supports(I.span_nodes(candidates(spark, d), records(spark, d)).select("node_id", "record_id", "scope").unionByName(own))
    return supports.unionByName(entity_edges(spark, d).select("edge_id", "from_id", "to_id"))
