"""Keyed tables: what a batch writes follows the batch, what fails leaves no trace, what is repeated changes nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import store as P
from loomgraph.sources.keyed import KeyedTable

SCHEMA = "id string, body string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", seq long")


def files(path) -> dict:
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("*.parquet")}


def test_batches_in_any_order_are_as_a_dictionary(spark, tmp_path):
    table, draw, want = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 8), random.Random(4), {}
    assert table.read().count() == 0 and table.last()["version"] == 0
    for k in range(4):
        rows = [(draw.choice([None, *(f"k{j}" for j in range(30))]), f"b{k}.{j}", j) for j in range(draw.choice([0, 1, 20]))]
        if k % 2:
            table.insert(frame(spark, rows).dropDuplicates(["id"]))
            firsts = {}
            for r in rows:
                firsts.setdefault(r[0], []).append(r)
            held = {r.id: (r.body, r.n) for r in table.read().collect()}
            for key, options in firsts.items():
                if key is not None and key not in want:
                    assert held[key] in [o[1:] for o in options]
                    want[key] = held[key]
        else:
            table.upsert(frame(spark, rows), "seq")
            want |= {r[0]: r[1:] for r in rows if r[0] is not None}
        assert {r.id: (r.body, r.n) for r in table.read().collect()} == want
    scanned, gone = table.delete(F.col("n") % 2 == 0)
    assert (scanned, gone) == (len(want), sum(n % 2 == 0 for _, n in want.values()))
    want = {k: v for k, v in want.items() if v[1] % 2}
    table.vacuum()
    assert {r.id: (r.body, r.n) for r in table.read().collect()} == want and table.vacuum() == []


def test_a_small_batch_writes_little(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 64)
    table.insert(frame(spark, [(f"k{j}", "x" * 200 + str(random.Random(j).random()), j) for j in range(20_000)]))
    before = files(tmp_path)
    table.upsert(frame(spark, [("k5", "new", 1), ("k5", "newer", 2)]), "seq")
    new = {k: v for k, v in files(tmp_path).items() if k not in before}
    assert len(new) == 1 and sum(new.values()) < sum(before.values()) / 30
    before = files(tmp_path)
    table.insert(frame(spark, [("k5", "late", 3), ("fresh", "f", 4)]))
    new = {k: v for k, v in files(tmp_path).items() if k not in before}
    assert len(new) == 1 and sum(new.values()) < 3000  # beside the bucket's rows, not with them
    assert all(files(tmp_path)[k] == v for k, v in before.items())
    got = {r.id: r.body for r in table.read().where("id in ('k5', 'fresh')").collect()}
    assert got == {"k5": "newer", "fresh": "f"} and table.read().count() == 20_001
    before = files(tmp_path)
    assert table.insert(frame(spark, [("k5", "again", 3)])) == 3 and files(tmp_path) == before


def test_what_fails_or_is_repeated_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 4)
    assert table.upsert(frame(spark, [("a", "1", 1), ("b", "1", 1)]), "seq", "stream", 0) == 1
    broken = frame(spark, [("a", "2", 2), ("c", "2", 2)]).withColumn("body", F.when(F.col("id") == "c", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, "seq", "stream", 1)
    assert sorted((r.id, r.body) for r in table.read().collect()) == [("a", "1"), ("b", "1")]
    # a version's data without its commit, as after a crash between the two
    stray = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 4)
    stray._commit = lambda before, rows, *_: rows.withColumn("bucket", stray.bucket()).write.partitionBy("bucket").parquet(f"{stray.path}/data/stray")
    stray.upsert(frame(spark, [("a", "stray", 9)]), "seq")
    assert sorted(r.body for r in table.read().collect()) == ["1", "1"]
    for _ in range(2):
        assert table.upsert(frame(spark, [("a", "2", 2), ("c", "2", 2)]), "seq", "stream", 1) == 2
    table.upsert(frame(spark, [("a", "old", 0)]), "seq", "stream", 0)
    assert sorted((r.id, r.body) for r in table.read().collect()) == [("a", "2"), ("b", "1"), ("c", "2")] and table.last()["writers"] == {"stream": 1}
    # two that write one version at a time: the second fails and its rows aren't read
    other, start = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 4), table.last()
    table.upsert(frame(spark, [("d", "3", 3)]), "seq")
    other.last = lambda: start
    with pytest.raises(Exception, match="(?i)exist"):
        other.upsert(frame(spark, [("e", "3", 3)]), "seq")
    assert sorted(r.id for r in table.read().collect()) == ["a", "b", "c", "d"]


def test_artifacts_are_written_once(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([("x",), ("y",), ("x",)], "props string")
    assert P.artifacts_written(rows, "props", path).count() == 2
    before = files(tmp_path)
    assert P.artifacts_written(rows, "props", path).count() == 2 and files(tmp_path) == before
    assert P.artifacts_written(spark.createDataFrame([("x",), ("z",)], "props string"), "props", path).count() == 3
    assert all(files(tmp_path)[k] == v for k, v in before.items())


def test_snapshots_of_many_sessions_lie_in_few_files(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators import store as P

    rows = lambda at, ids: ids.select(F.lit(at).cast("string").alias("captured_at"), F.col("id").cast("string").alias("body"), F.concat(F.lit("s"), "id").alias("session_id"))
    back = P.snapshots_written(rows("a", spark.range(300)), rows("b", spark.range(0, 300, 3)).unionByName(rows(None, spark.range(300, 302))))
    assert {(r.session_id, r.captured_at, r.body) for r in back.collect()} == {(f"s{k}", None if k > 299 else "a" if k % 3 else "b", str(k)) for k in range(302)}
    assert back.count() == 302 and len(back.inputFiles()) <= 64
