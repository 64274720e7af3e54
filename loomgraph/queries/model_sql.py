"""The context graph of the driver's tables in DuckDB's SQL, for oracles: written apart from the readers."""

from __future__ import annotations

from loomgraph.functions.fixed import RELATIONS
from loomgraph.sources.corpus import TYPES


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _iso(seconds: str) -> str:
    return f"strftime(DATE '2024-01-01' + (({seconds}) // 86400)::INTEGER, '%Y-%m-%d') || 'T' || lpad(((({seconds}) % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad((((({seconds}) % 86400) // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((({seconds}) % 60)::VARCHAR, 2, '0') || '.000Z'"


NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[_-]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
STOP = _list(("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "we", "what", "when", "where", "why", "with"))

RECORDS = f"""records AS (SELECT 'c' || conv_id || '.' || turn AS id, 's' || conv_id AS session_id, 'w' || (conv_id // 16) AS workspace_id, conv_id, turn, role,
  CASE role WHEN 'user' THEN 'conversation' WHEN 'assistant' THEN 'transcript' WHEN 'system' THEN 'system' ELSE 'tool_output' END AS source_type, text AS content,
  {_iso("conv_id * 1000 + turn")} AS created_at FROM conversations)"""
NODES = f"""nodes AS (SELECT 'n' || conv_id || '.' || turn AS id, conv_id, turn, 's' || conv_id AS session_id, 'w' || (conv_id // 16) AS workspace_id,
  ({_list(TYPES)})[((conv_id * 31 + turn * 17) % {len(TYPES)} + 1)::INTEGER] AS type, (['workspace', 'session', 'global', 'session'])[((conv_id
    + turn) % 4 + 1)::INTEGER] AS scope,
  left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 96) AS label,
  '{{"sessionId":"s' || conv_id || '","workspaceId":"w' || (conv_id // 16) || '","role":"' || role || '","observationCount":' || ((conv_id *
    3 + turn) % 6) || ',"downgradeCount":' || ((conv_id + turn * 2) % 3) || '}}' AS payload,
  (['hard', 'soft', 'heuristic'])[(turn % 3 + 1)::INTEGER] AS strength, round(0.5 + ((conv_id * 13 + turn * 7) % 50) / 100.0, 2)::DOUBLE AS confidence,
  (['superseded', 'active', 'active', 'stale', 'active', 'active'])[((conv_id + turn) % 6 + 1)::INTEGER] AS freshness, (['compressed', 'raw',
    'raw', 'derived', 'raw'])[(turn % 5 + 1)::INTEGER] AS origin_kind,
  (conv_id * 3 + turn) % 6 AS observations, (conv_id + turn * 2) % 3 AS downgrades, (['candidate', 'candidate', 'promoted', 'downgraded', 'retired'])[((conv_id
    + turn) % 5 + 1)::INTEGER] AS promotion_state,
  'k' || (turn % 2) AS conflict_key, turn * 10 + conv_id % 3 AS override_priority, {_iso("conv_id * 1000 + turn")} AS updated_at FROM conversations)"""
EDGES = f"""edges AS (SELECT 'e' || a.conv_id || '.' || a.turn || '.' || h.hop AS id, 'n' || a.conv_id || '.' || a.turn AS from_id, 'n' || b.conv_id || '.' || b.turn AS to_id,
  ({_list(RELATIONS)})[((a.conv_id * 7 + a.turn * 3 + h.hop) % {len(RELATIONS)} + 1)::INTEGER] AS type, 's' || a.conv_id AS session_id, round(0.4
    + ((a.conv_id * 3 + a.turn * 11 + h.hop) % 60) / 100.0, 2)::DOUBLE AS confidence,
  {_iso("a.conv_id * 1000 + a.turn * 10 + h.hop")} AS updated_at
  FROM conversations a, (VALUES (1), (2)) h(hop), conversations b WHERE a.conv_id = b.conv_id AND a.turn + h.hop = b.turn)"""
REQUESTS = """requests AS (SELECT item_id AS request_id, 's' || (item_id % 40) AS session_id, 'w' || ((item_id % 40) // 16) AS workspace_id,
    text AS query, 400 + item_id % 30 * 20 AS token_budget FROM benchmark)"""
CORRECTIONS = f"""corrections AS (SELECT 'm' || event_id AS id, event_id, CASE event_type WHEN 'view' THEN 'label_override' WHEN 'click' THEN 'node_suppression'
    WHEN 'error' THEN 'noise_policy' WHEN 'purchase' THEN 'promotion_decision' WHEN 'signup' THEN 'concept_alias' END AS target_kind,
  'n' || user_id || '.' || (event_id % 3) AS target_id, CASE WHEN event_id % 4 = 3 THEN 'rollback' ELSE 'apply' END AS action, 'label ' || (event_id % 50) AS new_label,
  (['drop', 'evidence_only', 'hint_only', 'materialize'])[(event_id % 4 + 1)::INTEGER] AS disposition, {_iso("event_id * 60")} AS created_at FROM events)"""
CONTRACT = """contract(type, stable, usage, freshness, default_confidence, recall_priority, recall_order) AS (VALUES
  ('documents', TRUE, 'explain_only', 'active', 0.92, NULL, NULL), ('contains', TRUE, 'explain_only', 'active', 0.9, NULL, NULL), ('defines', TRUE, 'explain_only', 'active', 0.9, NULL, NULL),
  ('supported_by', TRUE, 'recall_eligible', 'active', 1.0, 2.5, 1), ('requires', TRUE, 'recall_eligible', 'active', 0.85, 1.75, 2), ('next_step', TRUE, 'recall_eligible', 'active', 0.8, 1.5, 3), ('overrides', TRUE, 'recall_eligible', 'active', 0.95, 1.25, 4),
  ('supersedes', TRUE, 'governance_only', 'superseded', 0.95, NULL, 5), ('conflicts_with', TRUE, 'governance_only', 'active', 0.9, NULL, NULL), ('derived_from', FALSE, 'explain_only', 'active', 0.75, NULL, NULL),
  ('applies_when', FALSE, 'explain_only', 'active', 0.7, NULL, NULL), ('forbids', FALSE, 'explain_only', 'active', 0.7, NULL, NULL), ('permits', FALSE, 'explain_only', 'active', 0.7, NULL, NULL), ('uses_skill', FALSE, 'explain_only', 'active', 0.7, NULL, NULL), ('produces', FALSE, 'explain_only', 'active', 0.7, NULL, NULL))"""


def terms(norm: str) -> str:
    raw = f"[t FOR t IN string_split({norm}, ' ') IF t <> '']"
    good = f"[t FOR t IN string_split({norm}, ' ') IF t <> '' AND (regexp_matches(t, '[^\\x00-\\x7F]') OR (length(t) >= 2 AND NOT list_contains({STOP}, t)))]"
    return f"list_distinct(CASE WHEN len({good}) > 0 THEN {good} ELSE {raw} END)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
