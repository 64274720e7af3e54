"""Scans, filters and orders of nodes, edges and histories, and writes by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def node_filter(types: Sequence[str] = (), scopes: Sequence[str] = (), freshness: Sequence[str] = (), origins: Sequence[str] = (), session_id: str | None = None, workspace_id: str | None = None, query: str | None = None) -> Column:
    """The conjunction of the given predicates; ids come from the payload, text may match label or payload."""
    out = F.lit(True)
    for column, values in (("type", types), ("scope", scopes), ("freshness", freshness)):
        if values:
            out &= F.col(column).isin(*values)
    if origins:
        out &= F.coalesce("origin_kind", F.lit("raw")).isin(*origins)
    for path, value in (("$.sessionId", session_id), ("$.workspaceId", workspace_id)):
        if value:
            out &= F.get_json_object("payload", path) == value
    if query:
        norm = T.normalized(F.lit(query))
        out &= T.passes(T.normalized(F.col("label")), norm, T.terms(norm)) | T.passes(T.normalized(F.col("payload")), norm, T.terms(norm))
    return out


def edge_filter(types: Sequence[str] = (), node_id: str | None = None, session_id: str | None = None) -> Column:
    out = F.lit(True)
    if types:
        out &= F.col("type").isin(*types)
    if node_id:
        out &= (F.col("from_id") == node_id) | (F.col("to_id") == node_id)
    if session_id:
        out &= F.col("session_id") == session_id
    return out


def in_node_order(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, then by label and id; the limit is a top-k that needs no full sort."""
    out = nodes.orderBy(F.desc("updated_at"), "label", "id")
    return out.limit(limit) if limit is not None else out


def in_edge_order(edges: DataFrame, limit: int | None = None) -> DataFrame:
    out = edges.orderBy(F.desc("updated_at"), "id")
    return out.limit(limit) if limit is not None else out


def by_ids(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``wanted`` (``list_id, ids``) looked up: input order and repeats stay, missing ids go."""
    each = wanted.select("list_id", F.posexplode("ids").alias("pos", "id"))
    return each.join(nodes, "id")


def edges_of(node_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with either end among ``node_ids`` (``id``), each once."""
    from_ = edges.join(node_ids.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    to = edges.join(node_ids.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    return from_.unionByName(to.select(*from_.columns)).dropDuplicates(["id"])


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each ``key`` in ``order``."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def listed(saved: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` of what each session has saved of each kind (``session_id, kind, id, created_at``), with their ``place``."""
    w = Window.partitionBy("session_id", "kind").orderBy(F.desc("created_at"), "id")
    return saved.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def upserted(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` overwritten by ``batch`` (which has ``order``): of a key the last row of the batch wins, whole."""
    newest = latest(batch, key, F.desc(order)).drop(order)
    return existing.join(newest.select(key), key, "left_anti").unionByName(newest.select(*existing.columns))


def source_dimension(rows: DataFrame, *fields: str) -> DataFrame:
    """Distinct sources by the hash of their canonical JSON, nulls written out."""
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.select(F.sha2(text, 256).alias("source_id"), *fields).distinct()


def artifacts(rows: DataFrame, content: str) -> DataFrame:
    """Content-addressed artifacts: the first of equal contents is written, at ``aa/hash.json``."""
    h = F.sha2(F.col(content), 256)
    return rows.select(h.alias("content_hash"), F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit(".json")).alias("path"), F.col(content).alias("content")).dropDuplicates(["content_hash"])


def page(rows: DataFrame, key: str, offset: int, limit: int, *order: Column) -> DataFrame:
    """A page of each key's history, with the total and whether more follow."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return numbered.where((F.col("pos") > offset) & (F.col("pos") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit)
