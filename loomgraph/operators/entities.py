"""Entities that records come from: documents, repositories, modules, files, interfaces and commands, and how they lie in one another.

A record's metadata imply specs; those that it states are laid over these.  A module's path is a chain of modules, each
in the one above.  A spec finds its parent by key within its record; the same entity in several records is one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.functions import text as T

#: Kinds of entities, relations to a parent, and how sure an implied and a stated entity is.
KINDS = ("Document", "Repo", "Module", "File", "API", "Command")
PARENT_RELATIONS = ("documents", "contains", "defines")
CONFIDENCE = {"implied": 0.93, "stated": 0.97}
TITLE = 96

SPEC = "struct<kind:string,key:string,label:string,parent:string,relation:string,path:string,span:string,payload:map<string,string>,explicit:boolean>"
STATED = "array<struct<kind:string,key:string,label:string,parent_key:string,relation:string,source_path:string,source_span:string,payload:map<string,string>>>"


def _said(value: Column) -> Column:
    """A text without the space around it; null if nothing is left."""
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def key_of(value: Column) -> Column:
    """How entities are told apart: compatibility forms folded, single spaces, lower case."""
    return F.nullif(F.lower(F.regexp_replace(_said(T.compatible(value)), r"\s+", " ")), F.lit(""))


def _spec(kind: str, key: Column, label: Column, parent: Column | None = None, relation: str | None = None, path: Column | None = None, span: Column | None = None, **payload: Column) -> Column:
    none = F.lit(None).cast("string")
    parent, path, span = (none if c is None else c for c in (parent, path, span))
    held = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in payload.items())) if payload else F.array().cast("array<struct<key:string,value:string>>")
    said = F.map_from_entries(F.filter(held, lambda e: e["value"].isNotNull()))
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), label.alias("label"), parent.alias("parent"), F.when(parent.isNotNull(), F.lit(relation)).cast("string").alias("relation"),
        path.alias("path"), span.alias("span"), said.cast("map<string,string>").alias("payload"), F.lit(False).alias("explicit"),
    ).cast(SPEC)


def first_line(content: Column) -> Column:
    """The first line that has text, without the marks of a heading, cut to TITLE characters."""
    line = F.get(F.filter(F.transform(F.split(content, r"\r?\n"), _said), lambda x: x.isNotNull()), F.lit(0))
    return F.substring(F.regexp_replace(line, r"^#+\s*", ""), 1, TITLE)


NAMES = (
    "repoKey", "repoPath", "repoName", "moduleKey", "modulePath", "moduleName", "fileKey", "filePath", "apiKey", "apiName", "apiSignature", "commandKey", "commandName", "command",
    "documentKey", "documentTitle", "documentKind", "documentPath", "structuredInputKind", "structuredInputFormat", "curatedBy", "curatedReason",
)


def implied(said: str = "said") -> Column:
    """The specs that a record's metadata mean, in order, from columns ``said`` (a struct of NAMES), ``route, title, source_path, content``.

    Keys are still as they were said; those of modules above the stated one are marked by ``above``.
    """
    m = lambda *names: F.coalesce(*(F.col(f"{said}.{n}") for n in names))
    repo, module, file, api, command = m("repoKey", "repoPath", "repoName"), m("moduleKey", "modulePath", "moduleName"), m("fileKey", "filePath"), m("apiKey", "apiName"), m("commandName", "command")
    command_key = F.coalesce(m("commandKey"), command)
    signal = (F.col("route") == "document") | m("documentKind", "documentTitle", "documentKey", "documentPath", "structuredInputKind", "structuredInputFormat", "curatedBy", "curatedReason").isNotNull()
    title, path = F.col("title"), F.col("source_path")
    document_key = F.coalesce(m("documentKey"), _said(path), _said(title), F.sha2(F.concat_ws("|", F.lit("document"), F.coalesce("content", F.lit(""))), 256))
    document = _spec("Document", document_key, F.concat(F.lit("document:"), title), path=F.coalesce(path, m("documentPath")), documentKind=m("documentKind"), title=title, structuredInputKind=m("structuredInputKind"), structuredInputFormat=m("structuredInputFormat"), curatedBy=m("curatedBy"), curatedReason=m("curatedReason"))
    repository = _spec("Repo", repo, F.concat(F.lit("repo:"), F.coalesce(m("repoName"), F.lower(repo))), path=m("repoPath"), repoName=m("repoName"), repoPath=m("repoPath"))
    part = lambda i: F.array_join(F.slice(F.col("parts"), F.lit(1), i), "/")
    chain = F.transform(F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1)).otherwise(F.array().cast("array<int>")), lambda i: _spec("Module", part(i), F.concat(F.lit("module:"), F.lower(part(i))), F.when(i > 1, part(i - 1)).otherwise(repo), "contains", part(i)).withField("above", F.lit(True)))
    over_module = F.when(F.size("parts") > 1, part(F.size("parts") - 1)).otherwise(repo)
    specs = [
        _spec("Module", module, F.concat(F.lit("module:"), F.coalesce(m("moduleName", "modulePath"), F.lower(module))), over_module, "contains", m("modulePath"), moduleName=m("moduleName"), modulePath=m("modulePath")),
        _spec("File", file, F.concat(F.lit("file:"), F.coalesce(m("filePath"), F.lower(file))), F.coalesce(module, repo), "contains", m("filePath"), filePath=m("filePath")),
        _spec("API", api, F.concat(F.lit("api:"), F.coalesce(m("apiName"), F.lower(api))), F.coalesce(file, module), "defines", m("filePath", "modulePath"), m("apiName"), apiName=m("apiName"), apiSignature=m("apiSignature")),
        _spec("Command", command_key, F.concat(F.lit("command:"), F.coalesce(command, F.lower(command_key))), F.coalesce(file, repo), "defines", m("filePath"), command, command=command, structuredInputKind=m("structuredInputKind"), structuredInputFormat=m("structuredInputFormat")),
    ]
    plain = [x.withField("above", F.lit(False)) for x in (repository, *specs)]
    return F.concat(F.array(F.when(signal, document.withField("above", F.lit(False))), plain[0]), chain, F.array(*plain[1:]))


def stated() -> Column:
    """The specs that a record states (``entities``, STATED), without those that lack a known kind or a label."""
    spec = F.transform(F.coalesce("entities", F.array().cast(STATED)), lambda e: F.struct(
        e["kind"].alias("kind"), e["key"].alias("key"), _said(e["label"]).alias("label"), e["parent_key"].alias("parent"), F.when(e["relation"].isin(*PARENT_RELATIONS), e["relation"]).alias("relation"),
        e["source_path"].alias("path"), e["source_span"].alias("span"), F.coalesce(e["payload"], F.create_map().cast("map<string,string>")).alias("payload"), F.lit(True).alias("explicit"),
    ).cast(SPEC).withField("above", F.lit(False)))
    return F.filter(spec, lambda s: s["kind"].isin(*KINDS) & s["label"].isNotNull())


def specs(records: DataFrame) -> DataFrame:
    """One row for each entity of a record: ``record_id, at, scope, evidence_id, kind, key, label, parent, relation, path, span, payload, explicit, place, node_id``.

    Of several specs of one kind and key the later ones' fields count where they have them, payloads are laid over each
    other, and the entity is explicit if any is.  Above a module by its path are those of its folders, from the
    repository down.  ``records``: ``record_id, at, scope, route, source_path, content, meta, entities, evidence_id``.
    """
    own = ["record_id", "at", "scope", "evidence_id"]
    said = F.struct(*(_said(F.try_element_at("meta", F.lit(n))).alias(n) for n in NAMES)).alias("said")
    read = records.select(*own, "route", "source_path", "content", "entities", said)
    read = read.withColumns({"title": F.coalesce("said.documentTitle", first_line(F.col("content")), "source_path", "record_id"), "parts": F.split(F.col("said.modulePath"), "/")})
    limits = F.struct(F.coalesce("said.repoKey", "said.repoPath", "said.repoName").alias("repo"), F.coalesce("said.moduleKey", "said.modulePath", "said.moduleName").alias("module")).alias("limits")
    each = read.select(*own, limits, F.posexplode(F.concat(implied(), stated())).alias("place", "s")).select(*own, "limits", "place", "s.*").where("kind is not null")
    # all keys by one expression, since folding is a long one
    keys = F.transform(F.array("key", "parent", "limits.repo", "limits.module"), key_of)
    each = each.withColumn("keys", keys).withColumns({"key": F.get("keys", F.lit(0)), "parent": F.get("keys", F.lit(1)), "repo": F.get("keys", F.lit(2)), "module": F.get("keys", F.lit(3))})
    each = each.withColumn("relation", F.when(F.col("explicit") | F.col("parent").isNotNull(), F.col("relation"))).where(F.col("key").isNotNull() & ~(F.col("above") & (F.col("key").eqNullSafe(F.col("repo")) | F.col("key").eqNullSafe(F.col("module")))))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.map_entries("payload").alias("e")))), lambda x: x["e"])).alias("entries")
    one = each.groupBy(*own, "kind", "key").agg(*map(last, ("label", "parent", "relation", "path", "span")), F.max("explicit").alias("explicit"), entries, F.min("place").alias("place"))
    names = F.array_distinct(F.transform("entries", lambda e: e["key"]))
    payload = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter("entries", lambda e: e["key"] == k), -1)["value"]))
    return one.withColumn("payload", payload).drop("entries").withColumn("node_id", F.sha2(F.concat_ws("|", F.lit("source-entity"), "scope", "kind", "key"), 256))


def nodes(found: DataFrame) -> DataFrame:
    """The nodes of ``specs``: each entity once, as the latest record has it, with the number of its records."""
    latest = F.max_by(F.struct("label", "path", "span", "payload", "explicit"), F.struct("at", "record_id")).alias("m")
    one = found.groupBy("node_id", "scope", "kind", "key").agg(latest, F.count("*").alias("records"))
    sure = F.when(F.col("m.explicit"), CONFIDENCE["stated"]).otherwise(CONFIDENCE["implied"])
    version = F.concat(F.lit("v:"), F.substring(F.sha2(F.concat_ws("|", F.lit("source-entity-version"), "kind", "key", "m.label"), 256), 1, 12))
    return one.select("node_id", "scope", "kind", "key", "m.*", "records", F.when(F.col("kind") == "Command", "process").otherwise("fact").alias("knowledge"), sure.alias("confidence"), version.alias("version"))


def edges(found: DataFrame) -> DataFrame:
    """The edges of ``specs``: from a parent to what it contains or defines, from a document to its record's evidence and other entities; each once."""
    by_key = found.groupBy("record_id", "key").agg(F.max_by("node_id", "place").alias("from_id")).withColumnRenamed("key", "parent")
    inside = found.where("relation is not null").join(by_key, ["record_id", "parent"]).select("scope", "from_id", F.col("node_id").alias("to_id"), F.col("relation").alias("type"))
    documents = found.where("kind = 'Document'").select("record_id", F.col("node_id").alias("from_id"), "scope", "evidence_id")
    about = documents.select("scope", "from_id", F.col("evidence_id").alias("to_id"), F.lit("documents").alias("type"))
    others = documents.select("record_id", "from_id").join(found.select("record_id", "scope", F.col("node_id").alias("to_id")), "record_id").where("from_id <> to_id").select("scope", "from_id", "to_id", F.lit("documents").alias("type"))
    every = inside.unionByName(about).unionByName(others).distinct()
    edge_id = F.sha2(F.concat_ws("|", F.lit("source-entity-edge"), "from_id", "to_id", "type", "scope"), 256)
    return every.select(edge_id.alias("edge_id"), "from_id", "to_id", "type", "scope", X.lookup(F.col("type"), {k: v[3] for k, v in X.RELATIONS.items()}).alias("confidence"))
