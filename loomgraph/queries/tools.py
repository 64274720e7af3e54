"""Queries of tool results: pages as what tools returned, in every form that a result can have."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import tools as T
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

_JS = "replace(replace(replace(replace(replace(html, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
MESSAGES = f"""messages AS (SELECT page_id AS id, CASE WHEN page_id % 9 = 8 THEN 'assistant' ELSE 'tool' END AS role, CASE page_id % 6
  WHEN 0 THEN '{{"command":"npm test -- unit","stdout":"' || j || '","exitCode":' || (page_id % 4) || '}}' WHEN 1 THEN '{{"toolName":"search_docs","hits":["/src/a'
    || page_id || '.py","plain"],"totalHits":' || (page_id % 40) || ',"log":"' || left(j, 0) || 'run"}}'
  WHEN 2 THEN '{{"tool":"read_file","path":"/data/p' || page_id || '.html","text":"' || j || '"}}' WHEN 3 THEN html WHEN 4 THEN '{{"name":"shell","status":"warning","stderr":"'
    || j || '","error":{{"code":"E42","message":"bad input"}}}}'
  ELSE '{{"summary":"done","toolName":"shell","keySignals":[],"provenance":{{"originKind":"compressed","sourceStage":"tool_result_persist"}},"truncation":{{"policyId":"unknown.success.v1"}},"text":"'
    || j || '"}}' END AS content FROM (SELECT page_id, html, {_JS} AS j FROM pages))"""
RESULTS = """raw AS (SELECT *, page_id_kind AS k FROM (SELECT *, id % 6 AS page_id_kind FROM messages)),
fields AS (SELECT id, role, content, k, length(content) AS raw_size, CASE k WHEN 0 THEN trim(content->>'$.stdout') END AS stdout, CASE k WHEN
    4 THEN trim(content->>'$.stderr') END AS stderr, CASE k WHEN 3 THEN trim(content) WHEN 2 THEN trim(content->>'$.text') WHEN 5 THEN trim(content->>'$.text')
    ELSE '' END AS output,
  CASE k WHEN 0 THEN content->>'$.command' END AS command, CASE k WHEN 0 THEN 'npm' WHEN 1 THEN 'search_docs' WHEN 2 THEN 'read_file' WHEN 3
    THEN 'tool_output' ELSE 'shell' END AS tool, CASE k WHEN 0 THEN (content->>'$.exitCode')::INTEGER END AS exit_code, CASE k WHEN 1 THEN (content->>'$.totalHits')::INTEGER
    END AS items,
  CASE k WHEN 2 THEN content->>'$.path' END AS path, CASE k WHEN 0 THEN content->>'$.exitCode' WHEN 4 THEN 'E42' END AS error_code FROM raw),
results AS (SELECT *, CASE k WHEN 0 THEN 'failure' WHEN 1 THEN 'empty' WHEN 4 THEN 'partial' ELSE CASE WHEN output = '' THEN 'empty' ELSE 'success' END END AS status,
  CASE k WHEN 0 THEN 'test_run' WHEN 1 THEN 'search_listing' WHEN 2 THEN 'file_read' WHEN 3 THEN CASE WHEN regexp_matches(output, '^[\\[{]')
    THEN 'structured_query' ELSE 'unknown' END WHEN 4 THEN 'command_execution' ELSE 'unknown' END AS kind,
  role = 'tool' AND k <> 5 AND (raw_size > 1800 OR greatest(coalesce(length(stdout), 0), coalesce(length(stderr), 0), length(output)) > 900 OR coalesce(items, 0) > 20) AS reduced,
  len(string_split_regex(CASE k WHEN 0 THEN stdout WHEN 4 THEN stderr WHEN 1 THEN content ELSE output END, '\\r?\\n')) AS n_lines FROM fields)"""
WITH = "WITH " + MESSAGES + ",\n" + RESULTS + " "


def results(spark, d):
    p, n, k = C.read(spark, d, "pages"), F.col("page_id"), F.col("page_id") % 6
    j = F.col("html")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        j = F.replace(j, F.lit(a), F.lit(b))
    s = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    content = (
        F.when(k == 0, s('{"command":"npm test -- unit","stdout":"', j, '","exitCode":', n % 4, "}")).when(k == 1, s('{"toolName":"search_docs","hits":["/src/a', n, '.py","plain"],"totalHits":', n % 40, ',"log":"run"}'))
        .when(k == 2, s('{"tool":"read_file","path":"/data/p', n, '.html","text":"', j, '"}')).when(k == 3, F.col("html")).when(k == 4, s('{"name":"shell","status":"warning","stderr":"', j, '","error":{"code":"E42","message":"bad input"}}'))
        .otherwise(s('{"summary":"done","toolName":"shell","keySignals":[],"provenance":{"originKind":"compressed","sourceStage":"tool_result_persist"},"truncation":{"policyId":"unknown.success.v1"},"text":"', j, '"}'))
    )
    return T.read(p.select(n.alias("id"), F.when(n % 9 == 8, "assistant").otherwise("tool").alias("role"), content.alias("content")))


@query("ref_op275_tool_result_policy", WITH + "SELECT id, reduced, k = 5 AS compressed, raw_size FROM results")
def policy(spark, d):
    return results(spark, d).select("id", T.reduced().alias("reduced"), "compressed", "raw_size")


@query("ref_op197_tool_classes", WITH + "SELECT id, tool, status, kind, items, error_code FROM results WHERE k <> 5")
def classes(spark, d):
    return results(spark, d).where(~F.col("compressed")).select("id", "tool", T.status().alias("status"), T.kind().alias("kind"), "items", "error_code")


@query(
    "ref_op194_tool_summaries",
    WITH + """SELECT id, CASE k WHEN 0 THEN 'npm ran npm test -- unit and reported test failures' WHEN 1 THEN 'search_docs returned ' || items || ' search hits'
    WHEN 2 THEN 'read_file loaded ' || path WHEN 3 THEN CASE WHEN kind = 'unknown' THEN 'tool_output produced tool output' ELSE 'tool_output returned structured output'
    END ELSE 'shell produced tool output' END AS summary,
  array_to_string([x FOR x IN ['exitCode=' || exit_code, 'itemCount=' || items, 'lineCount=' || n_lines, CASE WHEN status <> 'success' THEN 'status='
    || status END, 'errorCode=' || error_code, 'command=' || command, 'sourcePath=' || path] IF x IS NOT NULL][1:6], ' | ') AS signals,
  array_to_string([x FOR x IN [CASE WHEN raw_size > 1800 THEN 'serialized output exceeded 1800 chars' END, CASE WHEN length(stdout) > 900 THEN
    'stdout was reduced to head/tail preview' END, CASE WHEN length(stderr) > 900 THEN 'stderr was reduced to head/tail preview' END,
    CASE WHEN k IN (2, 3) AND length(output) > 900 THEN 'generic output was reduced to head/tail preview' END, CASE WHEN items > 20 THEN 'result list exceeded 20 items'
    END] IF x IS NOT NULL], '; ') AS reason FROM results WHERE reduced""",
)
def summaries(spark, d):
    return T.compressed(results(spark, d)).select("id", "summary", F.array_join("signals", " | ").alias("signals"), "reason")


@query(
    "ref_op276_compressed_results",
    WITH + """SELECT id, kind || '.' || status || '.v1' AS policy_id, sha256(content) AS content_hash, raw_size, n_lines::INTEGER AS line_count, sha256(CASE
    WHEN length(o) <= 520 THEN o ELSE left(o, 320) || '|' || right(o, 200) END) AS preview_sha, CASE WHEN length(o) > 520 THEN length(o) - 520
    END AS omitted_chars,
  CASE WHEN length(o) > 520 THEN greatest(len(string_split_regex(o, '\\r?\\n')) - len(string_split_regex(left(o, 320), '\\r?\\n')) - len(string_split_regex(right(o,
    200), '\\r?\\n')), 0)::INTEGER END AS omitted_lines,
  array_to_string([x FOR x IN [CASE WHEN length(stdout) > 520 THEN 'stdout.middle' END, CASE WHEN length(stderr) > 520 THEN 'stderr.middle' END,
    CASE WHEN k IN (2, 3) AND length(output) > 520 THEN 'output.middle' END, CASE WHEN items > 20 THEN 'result.items.tail' END] IF x IS NOT NULL],
    ',') AS dropped
  FROM (SELECT *, CASE k WHEN 0 THEN stdout WHEN 4 THEN stderr WHEN 1 THEN NULL ELSE output END AS o FROM results) WHERE reduced""",
)
def compressed(spark, d):
    p = F.col("preview")
    shown = F.when(p["tail"].isNull(), p["head"]).otherwise(F.concat(p["head"], F.lit("|"), p["tail"]))
    return T.compressed(results(spark, d)).select("id", "policy_id", "content_hash", "raw_size", "line_count", F.sha2(shown, 256).alias("preview_sha"), p["omitted_chars"].alias("omitted_chars"), p["omitted_lines"].alias("omitted_lines"), F.array_join("dropped", ",").alias("dropped"))


@query(
    "ref_op277_compression_metadata",
    WITH + "SELECT kind, status, count(*) AS n, sum(raw_size)::BIGINT AS raw_size, count(error_code) AS with_error, max(items) AS most_items FROM results WHERE reduced GROUP BY 1, 2",
)
def metadata(spark, d):
    return T.compressed(results(spark, d)).groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("raw_size").alias("raw_size"), F.count("error_code").alias("with_error"), F.max("items").alias("most_items"))


_PAIR = '"([A-Za-z_]+)":("(?:[^"\\\\]|\\\\.)*"|\\[[^\\]\\[{}]*\\])'
_CUT = "CASE WHEN length({0}) <= 160 THEN {0} ELSE left({0}, 157) || '...' END"


@query(
    "ref_op196_affected_paths",
    WITH + f""", pairs AS (SELECT id, generate_subscripts(ks, 1) AS i, unnest(ks) AS key, unnest(vs) AS v FROM (SELECT id, regexp_extract_all(content, '{_PAIR}',
    1) AS ks, regexp_extract_all(content, '{_PAIR}', 2) AS vs FROM results WHERE k <> 3)),
  said AS (SELECT id, i, key, generate_subscripts(vs, 1) AS j, trim(unnest(vs)) AS v FROM (SELECT id, i, key, regexp_extract_all(v, '"((?:[^"\\\\]|\\\\.)*)"',
    1) AS vs FROM pairs)),
  good AS (SELECT id, i, j, {_CUT.format("v")} AS v FROM said WHERE v <> '' AND (regexp_matches(key, '(?i)(path|file|files|filepath|sourcepath|changed|affected|match|artifact|log)')
    OR regexp_matches(v, '[\\\\/]|(?i:\\.([cm]?[jt]sx?|json|md|txt|log|yml|yaml|toml|ini|py|rs|go|java|cs)$)'))),
  loose AS (SELECT id, generate_subscripts(ps, 1) AS i, 1 AS j, unnest(ps) AS p FROM (SELECT id, regexp_extract_all(content, '(?:[A-Za-z]:)?[\\\\/][^\\s"''`<>|]+')
    AS ps FROM results WHERE k = 3 OR id NOT IN (SELECT id FROM good))),
  every AS (SELECT id, v, min(i * 100000 + j) AS at_ FROM (SELECT * FROM good UNION ALL SELECT id, i, j, {_CUT.format("p")} FROM loose) GROUP BY 1, 2),
  kept AS (SELECT id, v, at_, row_number() OVER (PARTITION BY id ORDER BY at_) AS r FROM every)
  SELECT id, count(*) AS n_paths, sha256(string_agg(v, chr(10) ORDER BY at_)) AS paths_sha FROM kept WHERE r <= 8 GROUP BY 1""",
)
def paths(spark, d):
    found = results(spark, d).select("id", T.affected_paths().alias("p")).where(F.size("p") > 0)
    return found.select("id", F.size("p").cast("long").alias("n_paths"), F.sha2(F.array_join("p", "\n"), 256).alias("paths_sha"))
