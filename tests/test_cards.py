"""Cards whose metric is half as much again as its limit, and odd events, held against SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.operators.control import metric_status
from loomgraph.queries import ORACLE_SQL, QUERIES

TYPES = {"e": "error", "v": "view", "c": "click", "p": "purchase", "-": None}
#: Users' events: first letters of their kinds, and the value of each (None: null).
USERS = [(1, "eeevvvcccp", 12.0), (2, "eeeevvcccp", 8.0), (3, "eeevvvvvvp", 12.0), (4, "e--vvc", 6.0), (5, "----", None), (7, "vvvvv", 0.0), (8, "eeeeeecccccppppppppp", 12.0), (None, "eeevvvcccp", 12.0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("cards")
    rows = [(user, TYPES[k], value) for user, kinds, value in USERS for k in kinds]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    connection.executemany("INSERT INTO events VALUES (?, '2024-01-01', ?, ?, ?, NULL)", [(k, *row) for k, row in enumerate(rows)])
    connection.execute(f"COPY events TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


def both(spark, folder, name):
    """Rows of the query and of its SQL, columns by name."""
    ours = QUERIES[name](spark, folder)
    columns = ", ".join(sorted(ours.columns))
    theirs = duckdb.sql(ORACLE_SQL[name].replace("FROM events", f"FROM '{folder}/events.parquet'")).query("q", f"SELECT {columns} FROM q").fetchall()
    return sorted(map(tuple, ours.select(*sorted(ours.columns)).collect()), key=repr), sorted(theirs, key=repr)


def test_critical_limit_of_doubles_and_of_decimals(spark):
    """0.2 and 0.4 times 1.5 are above 0.3 and 0.6 as doubles, not as decimals."""
    rows = spark.createDataFrame([(0.3, 0.2), (0.6, 0.4), (0.30000000000000004, 0.2), (0.59, 0.4), (0.1, 0.0)], "value double, threshold double")
    of = lambda **kw: [r[0] for r in rows.select(metric_status(F.col("value"), F.lit("max"), F.col("threshold"), **kw)).collect()]
    assert of() == ["warning", "warning", "critical", "warning", "critical"]
    assert of(places=9) == ["critical", "critical", "critical", "warning", "critical"]


def test_changes_between_releases(spark, folder):
    ours, theirs = both(spark, folder, "ref_op098_release_comparison")
    assert ours == theirs
    assert {metric: changed for changed, metric, n in ours}["fallback"] == 3


def test_counts_of_statuses(spark, folder):
    ours, theirs = both(spark, folder, "ref_op301_metric_status")
    assert ours == theirs
    assert {(metric, status): n for metric, n, status in ours if metric == "fallback"} == {("fallback", "healthy"): 1, ("fallback", "warning"): 6, ("fallback", "critical"): 1}


def test_messages_of_alerts(spark, folder):
    ours, theirs = both(spark, folder, "ref_op302_alerts")
    assert ours == theirs
    assert {user for message, user in ours if message == "fallback is warning"} == {1, 3, 4, 5, 8, None}
    assert {user for message, user in ours if message == "pollution is warning"} == {1, 3, 8, None}
