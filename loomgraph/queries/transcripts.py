"""Queries of transcript entries and hook snapshots in every form that a content can have."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C
from loomgraph.sources import transcripts as T

_JS = "replace(replace(replace(replace(replace(t, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
#: each turn's text with words that speak of a type
SAID = """said AS (SELECT conv_id, turn, 'e' || conv_id || '.' || turn AS id, 's' || conv_id AS session_id, role, trim(coalesce(text, '')) || (['', ' use tool X',
    ' the workflow', chr(10) || 'step 2 now', ' it must not', ' debug mode', ' expected outcome', ' a risk'])[(conv_id % 8 + 1)::INTEGER] AS
    t FROM conversations)"""
#: and as a content of each form, with the text that it stands for
FORMS = """forms AS (SELECT *, (conv_id + turn) % 6 AS form, CASE (conv_id + turn) % 6 WHEN 0 THEN t WHEN 1 THEN 'note' || chr(10) || t WHEN 2 THEN t WHEN
    3 THEN t WHEN 4 THEN '' ELSE 'a' || chr(10) || t END AS flat FROM said)"""


def _said(spark, d):
    c = C.read(spark, d, "conversations")
    words = F.array(*map(F.lit, ("", " use tool X", " the workflow", "\nstep 2 now", " it must not", " debug mode", " expected outcome", " a risk")))
    return c.select("conv_id", "turn", F.concat(F.lit("e"), "conv_id", F.lit("."), "turn").alias("id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), "role", F.concat(F.trim(F.coalesce("text", F.lit(""))), F.element_at(words, (F.col("conv_id") % 8 + 1).cast("int"))).alias("t"))


def _content():
    j = F.col("t")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        j = F.replace(j, F.lit(a), F.lit(b))
    s, form = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p)), (F.col("conv_id") + F.col("turn")) % 6
    return (
        F.when(form == 0, s('"  ', j, ' "')).when(form == 1, s('["note",{"type":"text","text":"', j, '"},""]')).when(form == 2, s('{"text":"', j, '"}')).when(form == 3, s('{"content":"', j, '"}'))
        .when(form == 4, F.lit('"   "')).otherwise(s('[{"content":["a",{"text":"', j, '"}]}]'))
    )


def entries(spark, d):
    s, c = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p)), F.col("conv_id")
    rows, body = _said(spark, d), _content()
    names = F.element_at(F.array(*map(F.lit, ("project-rule", "Constraint", "skill_card", "mode", "tool-hint", "note", "workflow", "summary"))), ((c + F.col("turn") * 3) % 8 + 1).cast("int"))
    own = F.when(c % 9 != 4, s('"id":"', F.col("id"), '",')).otherwise("")
    parent = F.when(F.col("turn") > 0, s('"parentId":"e', c, ".", F.col("turn") - 1, '",')).otherwise("")
    kind = F.col("turn") % 4
    role = F.when(kind == 3, F.when(c % 2 == 0, "toolResult").otherwise("other")).otherwise(F.col("role"))
    json = (
        F.when(kind == 1, s('{"type":"custom_message",', own, parent, '"customType":"', names, '","content":', body, ',"details":["more"]}'))
        .when(kind == 2, s('{"type":"compaction",', own, parent, '"summary":"kept facts","details":', body, F.when(c % 2 == 0, ',"firstKeptEntryId":"E1"').otherwise(""), "}"))
        .otherwise(s('{"type":"message",', own, parent, '"timestamp":"2024-01-02T00:00:00Z","message":{"role":"', role, '","content":', body, "}}"))
    )
    return rows.withColumn("json", json)


_TYPE = """CASE WHEN regexp_matches(l, '\\b(mode|operating mode|debug mode|strict mode)\\b') THEN 'Mode' WHEN regexp_matches(l, '\\b(expected outcome|outcome|result should be|success means|target result)\\b')
    THEN 'Outcome' WHEN regexp_matches(l, '\\b(tooling|tool choice|preferred tool|use tool)\\b') THEN 'Tool'
  WHEN regexp_matches(l, '\\b(must|must not|should not|cannot|can''t|never|forbid|required|constraint)\\b') THEN 'Constraint' WHEN regexp_matches(l,
    '(^|\\n)\\s*(step\\s*\\d+|next step|\\d+[.)])') THEN 'Step' WHEN regexp_matches(l, '\\b(process|workflow|pipeline|roadmap|phase|stage)\\b')
    THEN 'Process'
  WHEN regexp_matches(l, '\\b(risk|warning|blocker|blocked|conflict|failure|issue)\\b') THEN 'Risk' WHEN regexp_matches(l, '\\b(rule|policy|guideline)\\b')
    THEN 'Rule' WHEN regexp_matches(l, '\\b(skill|pattern|playbook)\\b') THEN 'Skill' ELSE 'State' END"""
_OWN = "CASE WHEN conv_id % 9 <> 4 THEN id ELSE sha256(session_id || '|{0}|' || content) END"
_KEY = "array_to_string([x FOR x IN ['{0}', lower(node_type), lower({1}), left(trim(regexp_replace(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 72)] IF x <> ''], '|')"


@query("ref_op009_content_flattening", "WITH " + SAID + ", " + FORMS + " SELECT id, sha256(regexp_replace(regexp_replace(flat, '^\\s+', ''), '\\s+$', '')) AS text_sha FROM forms")
def content_flattening(spark, d):
    return _said(spark, d).withColumn("json", F.concat(F.lit('{"content":'), _content(), F.lit("}"))).select("id", F.sha2(T.flattened(F.col("json"), "$.content"), 256).alias("text_sha"))


@query("ref_op191_transcript_text_type", "WITH " + SAID + f" SELECT id, {_TYPE} AS type FROM (SELECT *, lower(t) AS l FROM said)")
def transcript_text_type(spark, d):
    return _said(spark, d).select("id", T.text_type(F.col("t")).alias("type"))


@query(
    "ref_op004_message_records",
    "WITH " + SAID + ", " + FORMS
    + """, m AS (SELECT *, flat AS content, CASE WHEN turn % 4 = 3 THEN CASE WHEN conv_id % 2 = 0 THEN 'tool' ELSE 'user' END WHEN
    role IN ('assistant', 'system', 'tool') THEN role ELSE 'user' END AS r FROM forms WHERE turn % 4 IN (0, 3) AND form <> 4)"""
    + f""" SELECT {_OWN.format('message')} AS id, r AS role, CASE r WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool_output' ELSE
    'conversation' END AS source_type, CASE r WHEN 'user' THEN 'Intent' WHEN 'assistant' THEN 'Decision' WHEN 'tool' THEN 'State' END AS node_type,
    'raw' AS origin_kind, '2024-01-02T00:00:00Z' AS created_at, sha256(content) AS content_hash, CASE WHEN turn > 0 THEN 'e' || conv_id || '.'
    || (turn - 1) END AS parent_id FROM m""",
)
def message_records(spark, d):
    return T.message_records(entries(spark, d), F.col("session_id")).select("id", "role", "source_type", "node_type", "origin_kind", "created_at", "content_hash", "parent_id")


@query(
    "ref_op005_custom_records",
    "WITH " + SAID + ", " + FORMS
    + """, m AS (SELECT *, CASE WHEN form = 4 THEN 'more' ELSE flat || chr(10) || 'more' END AS content, (['project-rule', 'Constraint',
    'skill_card', 'mode', 'tool-hint', 'note', 'workflow', 'summary'])[((conv_id + turn * 3) % 8 + 1)::INTEGER] AS name FROM forms WHERE turn
    % 4 = 1)"""
    + f""", n AS (SELECT *, CASE name WHEN 'project-rule' THEN 'Rule' WHEN 'Constraint' THEN 'Constraint' WHEN 'skill_card' THEN 'Skill'
    WHEN 'mode' THEN 'Mode' WHEN 'tool-hint' THEN 'Tool' WHEN 'workflow' THEN 'Process' ELSE {_TYPE} END AS node_type FROM (SELECT *, lower(content)
    AS l FROM m))"""
    + f""" SELECT {_OWN.format('custom_message')} AS id, node_type, CASE WHEN node_type IN ('Rule', 'Constraint') THEN 'rule' WHEN
    node_type IN ('Process', 'Step', 'Outcome') THEN 'workflow' WHEN node_type = 'Skill' THEN 'skill' ELSE 'system' END AS source_type, CASE
    WHEN name = 'summary' THEN 'compressed' ELSE 'raw' END AS origin_kind, sha256(content) AS content_hash, {_KEY.format('custom', 'name')} AS
    group_key FROM n""",
)
def custom_records(spark, d):
    return T.custom_records(entries(spark, d), F.col("session_id")).select("id", "node_type", "source_type", "origin_kind", "content_hash", "group_key")


@query(
    "ref_op006_compaction_records",
    "WITH " + SAID + ", " + FORMS
    + f""", m AS (SELECT *, CASE WHEN form = 4 THEN 'kept facts' ELSE 'kept facts' || chr(10) || flat END AS content FROM forms WHERE
    turn % 4 = 2), n AS (SELECT *, {_TYPE} AS node_type FROM (SELECT *, lower(content) AS l FROM m))"""
    + f""" SELECT {_OWN.format('compaction')} AS id, node_type, CASE WHEN node_type IN ('Rule', 'Constraint') THEN 'rule' ELSE 'workflow'
    END AS source_type, 'compressed' AS origin_kind, sha256(content) AS content_hash, {_KEY.format('compaction', chr(39) + chr(39) + ' || CASE WHEN conv_id % 2 = 0 THEN ' + chr(39) + 'E1' + chr(39) + ' ELSE ' + chr(39) + chr(39) + ' END')}
    AS group_key FROM n""",
)
def compaction_records(spark, d):
    return T.compaction_records(entries(spark, d), F.col("session_id")).select("id", "node_type", "source_type", "origin_kind", "content_hash", "group_key")


@query(
    "ref_op008_hook_records",
    "WITH " + SAID + ", " + FORMS
    + """ SELECT session_id || ':' || id AS id, CASE role WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' WHEN 'tool'
    THEN 'tool' ELSE 'user' END AS role, CASE role WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool_output' ELSE 'conversation' END AS source_type,
    sha256(flat) AS content_hash, CASE role WHEN 'tool' THEN 'tool_output_raw' ELSE 'hook_message_snapshot' END AS source_stage, 'before_compaction'
    AS created_by_hook FROM forms WHERE form <> 4""",
)
def hook_records(spark, d):
    rows = _said(spark, d).withColumn("json", F.concat(F.lit('{"id":"'), "id", F.lit('","role":"'), "role", F.lit('","content":'), _content(), F.lit("}")))
    return T.hook_records(rows, F.col("session_id"), "before_compaction")
