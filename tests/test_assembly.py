"""What is kept after turns is the same in one batch, in several, out of order, repeated, and after a restart between two writes."""

from __future__ import annotations

import pytest

from loomgraph.sources.keyed import KeyedTable
from loomgraph.streaming.assembly import RECORD, Assembly


def rows_of(a: Assembly) -> list:
    return [sorted(map(tuple, t.read().select(*sorted(t.read().columns)).collect()), key=repr) for t in (a.records, a.nodes, a.windows)]


def turns(spark):
    rows = [(f"c{k}", f"s{k % 5}", "w", k, ("system", "user", "assistant", "user", "tool")[k % 7 % 5], None if k % 11 == 3 else f"said {k} " * (k % 9), f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}") for k in range(90)]
    return spark.createDataFrame(rows, RECORD)


def test_batches_streams_and_restarts_agree(spark, tmp_path, monkeypatch):
    every = turns(spark)
    one = Assembly(spark, str(tmp_path / "one"), 4)
    one.after_turns(every, 0)
    want = rows_of(one)
    assert len(want[0]) == 90 and len(want[2]) == 5
    for k in range(4):
        every.where(f"(turn * 7) % 4 = {k}").coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    many = Assembly(spark, str(tmp_path / "many"), 4)
    stream = lambda: many.stream(spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*")), str(tmp_path / "check"))
    # the third write of the windows is lost: records and nodes of that batch are committed, its windows not
    plain, calls = KeyedTable.upsert, []

    def lossy(self, *args):
        if self is many.windows:
            calls.append(args)
            if len(calls) == 3:
                raise RuntimeError("lost")
        return plain(self, *args)

    monkeypatch.setattr(KeyedTable, "upsert", lossy)
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination(120)
    assert rows_of(many) != want
    monkeypatch.setattr(KeyedTable, "upsert", plain)
    stream().awaitTermination(120)
    assert rows_of(many) == want and many.windows.last()["writers"] == {"turns": 3}
    version = many.records.last()["version"]
    many.after_turns(every.where("turn < 5"), 3)
    many.after_turns(every.limit(0), 4)
    assert rows_of(many) == want and many.records.last()["version"] == version + 1
    requests = spark.createDataFrame([(1, "s1", 200), (2, "s1", 10_000), (3, "none", 50)], "request_id int, session_id string, token_budget int")
    got = one.assembled(requests).collect()
    assert {r.request_id for r in got} == {1, 2} and all(r.used <= 200 for r in got if r.request_id == 1)
