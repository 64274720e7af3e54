"""Queries of entities: what pages' addresses, titles and scripts say of where they come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import entities as E
from loomgraph.queries.registry import query
from loomgraph.sources import corpus as C

#: an address's host is a repository, its folders are modules, its last part is a file, a query an interface, a mark stated
ENTITIES = r"""parts AS (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$', ['host', 'path', 'query', 'mark']) AS x FROM pages),
page AS (SELECT 'p' || page_id AS r, page_id, url, nullif(trim(x.host), '') AS host, nullif(regexp_replace(x.path, '^/+|/+$', '', 'g'), '') AS path, nullif(x.query, '') AS q, nullif(x.mark, '') AS mark,
  coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(left(trim(regexp_extract(coalesce(html, ''), '[^\r\n]*\S[^\r\n]*')), 96), ''), url, 'p' || page_id) AS title,
  contains(coalesce(html, ''), 'track(') AS tracked FROM parts),
keyed AS (SELECT *, lower(host) AS repo, lower(CASE WHEN contains(path, '/') THEN host || '/' || regexp_replace(path, '/[^/]*$', '') END) AS module, lower(host || '/' || path) AS file,
  CASE WHEN contains(path, '/') THEN host || '/' || regexp_replace(path, '/[^/]*$', '') END AS module_path, host || '/' || path AS file_path FROM page),
raw AS (SELECT r, page_id, 0 AS place, 'Document' AS kind, coalesce(lower(trim(regexp_replace(url, '\s+', ' ', 'g'))), lower(trim(regexp_replace(title, '\s+', ' ', 'g')))) AS key, 'document:' || title AS label, NULL AS parent, NULL AS relation, FALSE AS explicit FROM keyed
  UNION ALL SELECT r, page_id, 1, 'Repo', repo, 'repo:' || host, NULL, NULL, FALSE FROM keyed
  UNION ALL SELECT r, page_id, 1 + k, 'Module', array_to_string(ps[1:k], '/'), 'module:' || array_to_string(ps[1:k], '/'), array_to_string(ps[1:k - 1], '/'), 'contains', FALSE FROM (SELECT r, page_id, string_split(module, '/') AS ps, unnest(range(2, len(string_split(module, '/')))) AS k FROM keyed WHERE module IS NOT NULL)
  UNION ALL SELECT r, page_id, 100000, 'Module', module, 'module:' || module_path, CASE WHEN len(string_split(module, '/')) > 1 THEN regexp_replace(module, '/[^/]*$', '') END, 'contains', FALSE FROM keyed
  UNION ALL SELECT r, page_id, 100001, 'File', file, 'file:' || file_path, coalesce(module, repo), 'contains', FALSE FROM keyed
  UNION ALL SELECT r, page_id, 100002, 'API', lower('GET ' || file_path), 'api:GET ' || file_path, file, 'defines', FALSE FROM keyed WHERE q IS NOT NULL
  UNION ALL SELECT r, page_id, 100003, 'Command', 'track', 'command:track', coalesce(file, repo), 'defines', FALSE FROM keyed WHERE tracked
  UNION ALL SELECT r, page_id, 100004, 'File', coalesce(file, repo), 'marked ' || mark, repo, 'contains', TRUE FROM keyed WHERE mark IS NOT NULL),
specs AS (SELECT r, page_id, kind, key, arg_max(label, place) AS label, arg_max(parent, place) FILTER (parent IS NOT NULL) AS parent, arg_max(relation, place) FILTER (parent IS NOT NULL) AS relation, bool_or(explicit) AS explicit, min(place) AS place,
  sha256('source-entity|workspace|' || kind || '|' || key) AS node_id FROM raw WHERE key IS NOT NULL GROUP BY ALL),
links AS (SELECT p.node_id AS from_id, s.node_id AS to_id, s.relation AS type FROM specs s JOIN (SELECT r, key, arg_max(node_id, place) AS node_id FROM specs GROUP BY 1, 2) p ON p.r = s.r AND p.key = s.parent WHERE s.relation IS NOT NULL
  UNION SELECT node_id, sha256('evidence|' || r), 'documents' FROM specs WHERE kind = 'Document'
  UNION SELECT d.node_id, s.node_id, 'documents' FROM specs d JOIN specs s ON s.r = d.r AND s.node_id <> d.node_id WHERE d.kind = 'Document'),
entity_edges AS (SELECT sha256('source-entity-edge|' || from_id || '|' || to_id || '|' || type || '|workspace') AS edge_id, from_id, to_id, type, CASE type WHEN 'documents' THEN 0.92 ELSE 0.9 END::DOUBLE AS confidence FROM links)"""


def records(spark, d):
    """Pages as records of route ``document``."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract("url", r"^https?://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$", k)), F.lit(""))
    p = C.read(spark, d, "pages").withColumns({"host": part(1), "path": F.nullif(F.regexp_replace(part(2), "^/+|/+$", ""), F.lit("")), "query": part(3), "mark": part(4)})
    p = p.withColumns({"module_path": F.when(F.contains("path", F.lit("/")), F.concat("host", F.lit("/"), F.regexp_replace("path", "/[^/]*$", ""))), "file_path": F.concat("host", F.lit("/"), "path")})
    meta = {"documentTitle": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "documentKind": F.lit("page"), "repoName": F.col("host"), "modulePath": F.col("module_path"), "filePath": F.col("file_path")}
    meta |= {"apiName": F.when(F.col("query").isNotNull(), F.concat(F.lit("GET "), "file_path")), "apiSignature": F.col("query"), "commandName": F.when(F.contains("html", F.lit("track(")), "track")}
    marked = F.array(F.struct(F.lit("File").alias("kind"), F.coalesce("file_path", "host").alias("key"), F.concat(F.lit("marked "), "mark").alias("label"), F.col("host").alias("parent_key"), F.lit("contains").alias("relation"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("source_span"), F.create_map(F.lit("mark"), F.col("mark")).alias("payload")))
    record_id = F.concat(F.lit("p"), "page_id")
    return p.select(
        record_id.alias("record_id"), F.col("page_id").alias("at"), F.lit("workspace").alias("scope"), F.lit("document").alias("route"), F.col("url").alias("source_path"), F.col("html").alias("content"),
        F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v))).alias("meta"), F.when(F.col("mark").isNotNull(), marked).cast(E.STATED).alias("entities"), F.sha2(F.concat(F.lit("evidence|"), record_id), 256).alias("evidence_id"),
    )


@query(
    "ref_op237_entity_nodes",
    "WITH " + ENTITIES + """ SELECT node_id, kind, key, arg_max(label, (page_id, r)) AS label, arg_max(explicit, (page_id, r)) AS explicit, count(*) AS records, CASE kind WHEN 'Command' THEN 'process' ELSE 'fact' END AS knowledge,
    CASE WHEN arg_max(explicit, (page_id, r)) THEN 0.97 ELSE 0.93 END::DOUBLE AS confidence, 'v:' || left(sha256('source-entity-version|' || kind || '|' || key || '|' || arg_max(label, (page_id, r))), 12) AS version FROM specs GROUP BY node_id, kind, key""",
)
def entity_nodes(spark, d):
    return E.nodes(E.specs(records(spark, d))).select("node_id", "kind", "key", "label", "explicit", "records", "knowledge", "confidence", "version")


@query("ref_op237_entity_edges", "WITH " + ENTITIES + " SELECT * FROM entity_edges")
def entity_edges(spark, d):
    return E.edges(E.specs(records(spark, d))).select("edge_id", "from_id", "to_id", "type", "confidence")
