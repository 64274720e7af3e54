"""Remembered results: a second run processes what is new alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import memo as M


def test_only_new_contents_are_processed(spark, tmp_path):
    table, runs = M.memo(spark, str(tmp_path / "m"), "word string, n long", 8), []

    def run(rows):
        runs.append(rows.count())
        return rows.select("id", F.explode(F.filter(F.split("content", " "), lambda w: w != "")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))

    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    texts = [f"a b{k} a" for k in range(90)] + ["a b1 a", "", None]
    first = {r.id: (r.met, sorted((x.word, x.n) for x in r.kept)) for r in M.remembered(rows(texts), table, run, "v1").collect()}
    assert first[1] == first[90] == (False, [("a", 2), ("b1", 1)]) and first[91] == first[92] == (False, [])
    again = {r.id: r.met for r in M.remembered(rows(texts + [f"new {k}" for k in range(10)]), table, run, "v1").collect()}
    assert sum(not m for m in again.values()) == 10 and len(again) == 103
    M.remembered(rows(texts), table, run, "v2").count()
    M.remembered(rows(texts[:0]), table, run, "v1").count()
    assert runs == [92, 10, 92, 0]
