"""Queries of what is kept after each turn, taken in as several batches, and of what is assembled from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators.store import folder_of
from loomgraph.queries.model_sql import RECORDS, REQUESTS, with_
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C
from loomgraph.streaming.assembly import Assembly

_COST = "greatest(1, ceil(length(coalesce(content, '')) / 4.0)::BIGINT)"
_FLAT = "trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g'))"
WINDOWS = f"""b AS (SELECT *, greatest(1, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY session_id ORDER BY turn, id)) AS block FROM records),
l AS (SELECT *, block > max(block) OVER (PARTITION BY session_id) - 2 AS late, {_COST} AS cost, role || ': ' || CASE WHEN length({_FLAT}) <= 120 THEN {_FLAT} ELSE left({_FLAT}, 117) || '...' END AS line FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, late ORDER BY turn DESC, id DESC) AS back FROM l),
windows AS (SELECT session_id, count(*) AS messages, max(block) AS blocks, count(*) FILTER (late) AS tail, sum(cost)::BIGINT AS tokens, coalesce(sum(cost) FILTER (late), 0)::BIGINT AS tail_tokens,
  coalesce(string_agg(line, chr(10) ORDER BY back DESC) FILTER (NOT late AND back <= 8), '') AS baseline, count(*) FILTER (NOT late AND back <= 8) AS baseline_lines, count(*) FILTER (NOT late) > 0 AS compacted, max(created_at) AS updated_at FROM k GROUP BY 1)"""
KEPT = f"""kept AS (SELECT sha256('semantic|' || session_id || '|' || type || '|' || id) AS id, session_id, type, {_COST} AS cost, created_at FROM (SELECT *, CASE role WHEN 'user' THEN 'Intent' WHEN 'assistant' THEN 'Decision'
  WHEN 'system' THEN 'Rule' ELSE 'State' END AS type FROM records) WHERE trim(coalesce(content, '')) <> '')"""


def taken_in(spark, d, batches: int = 3) -> Assembly:
    """All turns in batches by their number, the last of them twice."""
    r = C.records(spark, d).select("id", "session_id", "workspace_id", "turn", "role", "content", "created_at")
    a = Assembly(spark, folder_of(r, "assembly"), 16)
    for k in [*range(batches), batches - 1]:
        a.after_turns(r.where(F.col("turn") % batches == k), k)
    return a


@query("ref_op271_after_turns", with_(RECORDS, WINDOWS) + "SELECT session_id, messages, blocks, tail, tokens, tail_tokens, sha256(baseline) AS baseline_sha, baseline_lines, compacted, updated_at FROM windows")
def after_turns(spark, d):
    return taken_in(spark, d).windows.read().select("session_id", "messages", "blocks", "tail", "tokens", "tail_tokens", F.sha2("baseline", 256).alias("baseline_sha"), "baseline_lines", "compacted", "updated_at")


@query("ref_op270_assemble", with_(RECORDS, WINDOWS, KEPT, REQUESTS) + """SELECT request_id, session_id, id, type, cost, used, compacted FROM (SELECT r.request_id, r.session_id, k.id, k.type, k.cost, w.compacted, r.token_budget - CASE WHEN w.compacted THEN greatest(1, ceil(length(w.baseline) / 4.0)::BIGINT) ELSE 0 END AS room,
    sum(k.cost) OVER (PARTITION BY r.request_id ORDER BY k.created_at DESC, k.id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM requests r JOIN windows w ON w.session_id = r.session_id JOIN kept k ON k.session_id = r.session_id) WHERE used <= room""")
def assemble(spark, d):
    return taken_in(spark, d).assembled(C.requests(spark, d))
