"""Entities of records: what metadata imply, what is laid over it, and what is left out."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from loomgraph.operators import entities as E

RECORD = f"record_id string, at long, scope string, route string, source_path string, content string, meta map<string,string>, entities {E.STATED}, evidence_id string"


def node(kind, key, scope="session"):
    return hashlib.sha256(f"source-entity|{scope}|{kind}|{key}".encode()).hexdigest()


def found(spark, *records):
    rows = [(f"r{k}", k, "session", r.get("route", "tool"), r.get("path"), r.get("content"), r.get("meta"), r.get("entities"), f"ev{k}") for k, r in enumerate(records)]
    return E.specs(spark.createDataFrame(rows, RECORD))


def stated(kind, key, label, parent=None, relation=None, **payload):
    return (kind, key, label, parent, relation, None, None, payload or None)


def test_implied_and_stated_entities(spark):
    meta = {"repoName": "My  Repo", "modulePath": "My Repo/src/core", "filePath": "src/core/A.py", "apiName": " run ", "command": "make ALL", "curatedBy": " "}
    over = [stated("File", "SRC/core/a.PY", "the file", "my repo", "contains", note="n"), stated("Widget", "x", "x"), stated("API", " ", "x"), stated("API", "run", ""), stated("API", "walk", "Walk", "src/core/a.py", "likes"), stated("Command", "deep", "Deep", "run", "defines")]
    rows = {(r.kind, r.key): r for r in found(spark, {"meta": meta, "entities": over}).collect()}
    assert set(rows) == {("Repo", "my repo"), ("Module", "my repo/src"), ("Module", "my repo/src/core"), ("File", "src/core/a.py"), ("API", "run"), ("API", "walk"), ("Command", "make all"), ("Command", "deep")}
    file = rows["File", "src/core/a.py"]
    assert (file.label, file.parent, file.explicit, file.payload) == ("the file", "my repo", True, {"filePath": "src/core/A.py", "note": "n"})
    assert rows["Repo", "my repo"].label == "repo:My  Repo" and rows["API", "walk"].relation is None and rows["API", "run"].span == "run"
    edges = {(r.from_id, r.to_id, r.type) for r in E.edges(found(spark, {"meta": meta, "entities": over})).collect()}
    chain = [("Repo", "my repo", "Module", "my repo/src", "contains"), ("Module", "my repo/src", "Module", "my repo/src/core", "contains"), ("Repo", "my repo", "File", "src/core/a.py", "contains"), ("File", "src/core/a.py", "API", "run", "defines"), ("File", "src/core/a.py", "Command", "make all", "defines"), ("API", "run", "Command", "deep", "defines")]
    assert edges == {(node(a, b), node(c, d), t) for a, b, c, d, t in chain}


def test_documents(spark):
    records = [{"route": "document", "content": "\n  ## A title \nrest"}, {"meta": {"documentKind": "guide", "repoKey": "R"}, "path": "docs/G.md"}, {"route": "document"}, {"content": "plain"}, {"meta": {}}, {"route": "document", "path": "docs/g.md", "content": "later"}]
    specs = found(spark, *records)
    rows = sorted((r.record_id, r.kind, r.key, r.label) for r in specs.collect())
    assert rows == [("r0", "Document", "a title", "document:A title"), ("r1", "Document", "docs/g.md", "document:docs/G.md"), ("r1", "Repo", "r", "repo:r"), ("r2", "Document", "r2", "document:r2"), ("r5", "Document", "docs/g.md", "document:later")]
    nodes = {r.key: (r.label, r.records, r.confidence, r.knowledge) for r in E.nodes(specs).collect()}
    assert nodes["docs/g.md"] == ("document:later", 2, 0.93, "fact") and len(nodes) == 4
    edges = {(r.from_id, r.to_id) for r in E.edges(specs).where(F.col("type") == "documents").collect()}
    guide = node("Document", "docs/g.md")
    assert edges == {(node("Document", "a title"), "ev0"), (guide, "ev1"), (guide, "ev5"), (guide, node("Repo", "r")), (node("Document", "r2"), "ev2")}
    assert E.edges(specs.limit(0)).count() == E.nodes(specs.limit(0)).count() == 0
