"""Index-backed retrieval against all pairs, and budgeted bundles against a plain greedy over SQL's ranks."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.operators import bundles as B
from loomgraph.operators import compiling as K
from loomgraph.operators import retrieval as R
from loomgraph.operators import selection as S
from loomgraph.queries import QUERIES
from loomgraph.queries import compile as QC
from loomgraph.queries import compiling as QK

FOLDER = "/root/testdata/sf0.001"
NODE = "id string, session_id string, workspace_id string, type string, scope string, label string, payload string, strength string, confidence double, freshness string, origin_kind string, observations int, downgrades int, promotion_state string"
REQUEST = "request_id int, session_id string, workspace_id string, query string, token_budget int"
WORDS = ["alpha", "beta", "gammaalpha", "de", "délta", "x", "ab", "abc", "abcd", "the", "on", "moon", "7", "漢字"]


def graph(spark, seed: int):
    draw = random.Random(seed)
    phrase = lambda n: " ".join(draw.choices(WORDS, k=draw.randint(0, n)))
    kinds = [*R.MOST, "Topic"]
    rows = [(f"n{k}", f"s{k % 7}", f"w{k % 3}", draw.choice(kinds), draw.choice(["global"] * 4 + ["session", "workspace"]), phrase(4), phrase(3), draw.choice(["hard", "soft", "heuristic"]), draw.choice([0.5, 0.75, 0.9]), draw.choice(["active", "active", "stale"]), draw.choice(["raw", "raw", "compressed", "derived"]), 1, 0, "candidate") for k in range(900)]
    edges = [(f"e{k}", f"n{draw.randrange(900)}", f"n{draw.randrange(900)}", draw.choice(list(X.RELATIONS)[3:8]), f"s{k % 7}", 0.8, "") for k in range(2500)]
    asked = [(k, f"s{k % 9}", f"w{k % 4}", phrase(6), 100 + 20 * k) for k in range(25)] + [(25, None, None, "the on", 80), (26, "s1", None, None, 80), (27, "s2", "w2", "gammaalpha délta abcd moon", 300)]
    return spark.createDataFrame(asked, REQUEST), spark.createDataFrame(rows, NODE), spark.createDataFrame(edges, "id string, from_id string, to_id string, type string, session_id string, confidence double, updated_at string")


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed, depth", [(1, 1), (3, 64)])
def test_the_best_are_those_of_all_pairs(spark, seed, depth):
    requests, nodes, edges = graph(spark, seed)
    every, columns = S.candidates(requests, nodes), ("request_id", "type", "id", "score", "direct", "rank")
    top = lambda rows: S.ranked(rows.where(F.col("type").isin(*R.MOST)), "request_id", "type").where(F.col("rank") <= X.lookup(F.col("type"), R.MOST, "int"))
    assert rows_of(top(R.recalled(requests, nodes, depth=depth)), *columns) == rows_of(top(every), *columns)
    assert rows_of(R.matches(requests, nodes), "request_id", "id", "score") == rows_of(every.where("direct"), "request_id", "id", "score")
    slots = ("request_id", "slot", "id", "rank", "bonus")
    plain = K.passes(every, edges, nodes)
    ours = K.retrieved_passes(requests, nodes, edges, depth)
    assert rows_of(K.ranked(ours), *slots) == rows_of(K.ranked(plain), *slots)
    assert rows_of(ours.where("bonus > 0"), "request_id", "id", "bonus") == rows_of(plain.where("bonus > 0"), "request_id", "id", "bonus")


def test_nothing_to_recall(spark):
    requests, nodes, edges = graph(spark, 4)
    assert R.recalled(requests, nodes.limit(0)).count() == R.matches(requests.limit(0), nodes).count() == R.recalled(requests.limit(0), nodes).count() == 0
    assert K.compiled(requests, nodes.limit(0), edges).count() == 0


def test_no_join_without_a_key(spark):
    for name in ("ref_op083_text_match_scores", "ref_op157_category_limits", "ref_op173_bundle_budget", "ref_op240_bundle_slots", "ref_op240_compile_context"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def greedy(items: list[dict], total: int) -> dict:
    """The items that a budget takes, with the pass that takes each."""
    fixed = {s: next((i for i in items if i["slot"] == s), None) for s in ("goal", "intent", "process")}
    used = sum(fixed[s]["cost"] for s in ("goal", "intent") if fixed[s])
    if fixed["process"] and used + fixed["process"]["cost"] <= total:
        used += fixed["process"]["cost"]
    room, taken, left = max(total - used, 0), {}, []
    for slot, (share, _) in X.CATEGORIES.items():
        pool, spent, n = int(round(room * share, 6) // 1), 0, 0
        for item in sorted((i for i in items if i["slot"] == slot), key=lambda i: i["rank"]):
            if used + item["cost"] <= total and (spent + item["cost"] <= pool or n == 0):
                used, spent, n = used + item["cost"], spent + item["cost"], n + 1
                taken[item["id"]] = 1
            else:
                left.append(item)
    for item in left:
        if used + item["cost"] <= total:
            used += item["cost"]
            taken[item["id"]] = 2
    return {"taken": taken, "used": used}


@pytest.mark.parametrize("name, sql", [
    ("ref_op173_bundle_budget", QC.MODEL + QC.LIMITED.replace("WHEN 'Skill' THEN 'skills'", "WHEN 'Skill' THEN 'skills' WHEN 'Goal' THEN 'goal' WHEN 'Intent' THEN 'intent' WHEN 'Step' THEN 'process' WHEN 'Process' THEN 'process'").replace("ELSE 4 END)", "WHEN 'goal' THEN 1 WHEN 'intent' THEN 1 WHEN 'process' THEN 1 ELSE 4 END)") + " SELECT request_id, token_budget, category AS slot, id, rank, cost FROM limited"),
    ("ref_op240_compile_context", QK.MODEL + " SELECT request_id, token_budget, slot, id, rank, cost FROM best"),
])
def test_budgets_over_whole_tables(spark, name, sql):
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    items = defaultdict(list)
    for request, budget, slot, node, rank, cost in connection.execute(sql).fetchall():
        items[request, budget].append({"slot": slot, "id": node, "rank": rank, "cost": cost})
    want = {(request, budget): greedy(rows, budget) for (request, budget), rows in items.items()}
    got = defaultdict(lambda: {"taken": {}})
    for r in QUERIES[name](spark, FOLDER).collect():
        got[r.request_id, r.token_budget]["taken"][r.id] = r["pass"]
        got[r.request_id, r.token_budget]["used"] = r.used
    assert {k: v for k, v in want.items() if v["taken"]} == dict(got) and len(got) > 30


def test_text_match_scores_every_pair(spark):
    """Pairs that share no term have a score, too; nodes alone are shuffled, not pairs."""
    run, nodes, requests = QUERIES["ref_op083_text_match_scores"], QC.C.nodes(spark, FOLDER), QC.C.requests(spark, FOLDER)
    every = S.candidates(requests, nodes)
    matching = R.matches(requests, nodes).count()
    assert run(spark, FOLDER).count() == every.count() > matching == every.where("direct").count() > 0
    assert run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0


def test_recalled_nodes_list_pairs_without_ranks(spark):
    """The list of all candidates takes neither scores nor ranks, and is dealt once."""
    plan = QUERIES["ref_op114_recalled_nodes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning(request_id") <= 2


def test_recalled_nodes_of_several_rows_and_slots(spark):
    """An id of two rows of which one is selected, an id in two slots, a related candidate, and one that is related alone."""
    listed = spark.createDataFrame([(1, "a", "rules"), (1, "a", "rules"), (1, "b", "risks"), (1, "b", "goal"), (2, "b", "risks")], "request_id int, id string, slot string")
    items = spark.createDataFrame([(1, "a", "rules"), (1, "b", "goal")], listed.schema)
    related = spark.createDataFrame([(2, "b"), (2, "z")], "request_id int, id string")
    got = {(r.request_id, r.id): (r.included, r.reasons, r.primary_kind, r.direct) for r in B.recalled_nodes(listed, items, related).collect()}
    assert got == {
        (1, "a"): (True, "selected for rules; skipped in rules", "direct_text", True), (1, "b"): (True, "selected for goal; skipped in risks", "direct_text", True),
        (2, "b"): (False, "related to a selection; skipped in risks", "relation_graph", True), (2, "z"): (False, "related to a selection", "relation_graph", False),
    }


def test_rounds_deal_pairs_once(spark, monkeypatch):
    """Pairs come to the nodes by one shuffle of ids, without the requests' texts, and postings aren't ranked again."""
    requests, nodes, _ = graph(spark, 5)
    r, n = R.written(S.asked(requests)), R.written(S.recallable(nodes).where("scope = 'global'"))
    plans, scored = [], S.scored
    monkeypatch.setattr(S, "scored", lambda found: plans.append(found._jdf.queryExecution().executedPlan().toString()) or scored(found))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert R.best(r, n, depth=2).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 1
    for plan in plans:
        # the pairs' and the nodes'; none of pairs by both ids, and none of pairs that hold a request's terms
        assert plan.count("Exchange hashpartitioning(id") == 2 and "Window" not in plan and not re.search(r"hashpartitioning\(request_id#\d+, id#", plan), plan
