"""Admission, scores, ranks and budgets: how a request's nodes are chosen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.functions import text as T


#: Requests that are sent to every task at once.
REQUESTS = 20_000
#: What a match adds to a score for the whole phrase, each term, coverage, and full coverage.
LABEL_WEIGHTS, PAYLOAD_WEIGHTS = (4, 0.75, 1.5, 1), (2, 0.5, 1, 0.5)


def promotion(kind: Column, confidence: Column, observations: Column, downgrades: Column, state: Column) -> Column:
    """Class, contamination risk, workspace eligibility and decision of promoted knowledge; null for other types."""
    often = (observations >= 3) & (confidence >= 0.78)
    cls = (
        F.when(kind == "FailurePattern", F.when((observations >= 4) & (confidence >= 0.9), "hard_constraint_candidate").otherwise("failure_experience"))
        .when(kind == "SuccessfulProcedure", F.when(often, "stable_skill").otherwise("local_procedure"))
        .when(downgrades > 0, "local_procedure").when(often, "stable_skill").otherwise("local_procedure")
    )
    risk = (
        F.when((state == "retired") | (state == "downgraded") | (downgrades >= 2), "high").when(cls.isin("hard_constraint_candidate", "stable_skill"), "low")
        .when(cls == "failure_experience", F.when((observations >= 4) & (confidence >= 0.88), "medium").otherwise("high"))
        .when(F.when(kind == "SuccessfulProcedure", observations >= 1).otherwise(observations >= 2) & (confidence >= 0.72), "medium").otherwise("high")
    )
    workspace = (state != "retired") & (cls.isin("hard_constraint_candidate", "stable_skill") | ((cls == "local_procedure") & (risk != "high")) | ((cls == "failure_experience") & (risk == "medium")))
    found = F.struct(cls.alias("knowledge_class"), risk.alias("risk"), workspace.alias("workspace_eligible"))
    return F.when(kind.isin(*X.PROMOTED_TYPES), found)


def admitted(node: str = "") -> Column:
    """Whether a node above its session may be recalled: traces never, promoted knowledge by its governance, others yes."""
    c = lambda n: F.col(f"{node}{n}")
    g = promotion(c("type"), c("confidence"), c("observations"), c("downgrades"), c("promotion_state"))
    high = F.when(c("scope") == "workspace", g["workspace_eligible"]).otherwise((g["risk"] == "low") & g["knowledge_class"].isin("stable_skill", "hard_constraint_candidate"))
    return (c("scope") == "session") | (~c("type").isin(*X.TRACE_TYPES) & F.coalesce(high, F.lit(True)))


def scope_promotion(scope: Column, kind: Column, workspace: Column) -> Column:
    """Where a node may rise: eligible, target, and whether a review is needed."""
    up = lambda ok, target: F.struct(ok.alias("eligible"), F.when(ok, target).alias("target"), F.lit(True).alias("review"))
    none = F.struct(F.lit(False).alias("eligible"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("review"))
    return F.when(scope == "global", none).when(scope == "session", up(workspace.isNotNull() & kind.isin(*X.WORKSPACE_TYPES), "workspace")).otherwise(up(kind.isin(*X.GLOBAL_TYPES), "global"))


def eligible(kind: Column) -> Column:
    """Whether a type may be in a prompt."""
    return ~kind.isin(*X.INELIGIBLE_TYPES)


def base_score() -> Column:
    """What a node scores before any query: strength, provenance, freshness and confidence."""
    strength = F.coalesce(X.lookup(F.col("strength"), X.STRENGTH_SCORE), F.lit(1.0))
    origin = F.coalesce(X.lookup(F.col("origin_kind"), X.ORIGIN_SCORE), F.lit(2.0))
    return strength + origin + F.when(F.col("freshness") == "active", 2.0).otherwise(0.0) + F.col("confidence")


def asked(requests: DataFrame) -> DataFrame:
    """Requests with their normalised query and its terms."""
    return requests.withColumn("norm", T.normalized(F.col("query"))).withColumn("terms", T.terms(F.col("norm"))).withColumnsRenamed({"session_id": "r_session", "workspace_id": "r_workspace"})


def may_be_recalled() -> Column:
    """Whether any request may recall a node: it isn't superseded, and its type may be in a prompt."""
    return (F.col("freshness") != "superseded") & eligible(F.col("type"))


def recallable(nodes: DataFrame) -> DataFrame:
    """Nodes that any request may recall, with their normalised texts and base scores.

    Types that a prompt may hold are neither traces nor promoted knowledge, so ``admitted`` holds for all of them.
    """
    kept = nodes.where(may_be_recalled())
    return kept.withColumn("label_norm", T.normalized(F.col("label"))).withColumn("payload_norm", T.normalized(F.col("payload"))).withColumn("base", base_score())


def near(r: DataFrame, n: DataFrame) -> DataFrame:
    """Each of ``asked`` requests with the ``recallable`` nodes of its session and its workspace."""
    session = r.join(n.where("scope = 'session'"), F.col("r_session") == F.col("session_id"))
    workspace = r.join(n.where("scope = 'workspace'"), F.col("r_workspace") == F.col("workspace_id"))
    return session.unionByName(workspace)


def scored(found: DataFrame) -> DataFrame:
    """Pairs of ``asked`` requests and ``recallable`` nodes with what selection needs of them."""
    label = T.score(F.col("label_norm"), F.col("norm"), F.col("terms"), *LABEL_WEIGHTS)
    payload = T.score(F.col("payload_norm"), F.col("norm"), F.col("terms"), *PAYLOAD_WEIGHTS)
    cost = T.estimated_tokens(F.col("label")) + T.estimated_tokens(F.col("payload"))
    return found.select("request_id", "token_budget", "id", "type", "scope", "label", "confidence", "origin_kind", ((label + payload) > 0).alias("direct"), F.round(F.col("base") + label + payload, 6).alias("score"), cost.alias("cost"), X.lookup(F.col("scope"), X.SCOPE_PRECEDENCE, "int").alias("precedence"))


def spread(frame: DataFrame, *by: str) -> DataFrame:
    """``frame`` over at least as many partitions as there are cores, for work that is heavy a row rather than a byte.

    With ``by`` rows are dealt by these columns, into as many partitions as shuffles have at least; otherwise a frame
    that has enough partitions stays as it is.
    """
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if by:
        return frame.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


def _blocks(requests: DataFrame) -> list[DataFrame]:
    """``asked`` requests once for each scope that they ask for (``asks``, with its owner), in blocks of REQUESTS, counted first."""
    scope = lambda name, owner: F.struct(F.lit(name).alias("name"), owner.alias("owner"))
    asks = asked(requests).withColumn("asks", F.explode(F.array(scope("session", F.col("r_session")), scope("workspace", F.col("r_workspace")), scope("global", F.lit("")))))
    blocks = max(1, -(-requests.count() // REQUESTS))
    block = F.pmod(F.xxhash64("request_id"), F.lit(blocks))
    return [asks.where(block == k) for k in range(blocks)]


def _owned(n: DataFrame) -> DataFrame:
    """Nodes with the owner of their scope."""
    return n.withColumn("owner", F.when(F.col("scope") == "session", F.col("session_id")).when(F.col("scope") == "workspace", F.col("workspace_id")).otherwise(""))


def _met(owned: DataFrame, asks: DataFrame) -> DataFrame:
    return owned.join(F.broadcast(asks), (F.col("scope") == F.col("asks.name")) & (F.col("owner") == F.col("asks.owner")))


def listed(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of ``candidates`` without their scores: ``request_id, id, type``."""
    owned = _owned(spread(nodes).where(may_be_recalled())).select("id", "type", "scope", "owner")
    return reduce(DataFrame.unionByName, [_met(owned, b.select("request_id", "asks")).select("request_id", "id", "type") for b in _blocks(requests)])


def candidates(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each request with all nodes of its session, its workspace and all scopes that it may recall, and their scores.

    This is for reports on every pair; what needs the best nodes alone, or those that match, comes from ``retrieval``.
    A request asks for three scopes, each with its owner, and a node lies in one; so pairs come by one equality join, of
    nodes where they lie.  Requests are a stated query set: they are sent in blocks of REQUESTS, counted first.
    """
    owned = _owned(recallable(spread(nodes)))
    return scored(reduce(DataFrame.unionByName, [_met(owned, b) for b in _blocks(requests)]))


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """``rank`` within each ``by``: closest scope first, then score, label and id."""
    w = Window.partitionBy(*by).orderBy(F.desc("precedence"), F.desc("score"), "label", "id")
    return rows.withColumn("rank", F.row_number().over(w))


def within_limits(rows: DataFrame, slots: bool = False) -> DataFrame:
    """The best nodes of each category of each request, up to the category's limit; with ``slots`` the fixed ones, too."""
    category = X.lookup(F.col("type"), X.CATEGORY_OF | (X.SLOTS if slots else {}), "string")
    most = F.coalesce(X.lookup(F.col("category"), {k: v[1] for k, v in X.CATEGORIES.items()}, "int"), F.lit(1))
    best = ranked(rows.withColumn("category", category).where("category is not null"), "request_id", "category")
    # the largest limit is a number, so each task keeps no more than that before the shuffle
    return best.where(F.col("rank") <= max(v[1] for v in X.CATEGORIES.values())).where(F.col("rank") <= most)


def taken(items: Column, total: Column, used: Column, pool: Column, soft_first: bool) -> Column:
    """Greedy choice over ordered ``items`` (structs with ``cost``): one that doesn't fit is passed over, later ones still may.

    An item must fit the total; beyond the category's pool only the first may go.  Gives ``used``, the items ``taken`` and
    those ``left``.
    """

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] + x["cost"] <= total) & ((s["spent"] + x["cost"] <= pool) | (F.lit(soft_first) & (F.size(s["taken"]) == 0)))
        spend = F.when(fits, x["cost"]).otherwise(0)
        return F.struct((s["used"] + spend).cast("long").alias("used"), (s["spent"] + spend).cast("long").alias("spent"), F.when(fits, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"), F.when(fits, s["left"]).otherwise(F.concat(s["left"], F.array(x))).alias("left"))

    none = F.slice(items, 1, 0)
    return F.aggregate(items, F.struct(used.cast("long").alias("used"), F.lit(0).cast("long").alias("spent"), none.alias("taken"), none.alias("left")), step)


def packed(chosen: DataFrame) -> DataFrame:
    """Each request's choice under its budget: ``request_id, token_budget, used, category, id, rank, pass, cost``.

    The fixed slots are charged first, goal and intent always and the process if it fits; what they leave is shared by the categories
    in their order, and a second pass offers what is left over to all.  One row a request carries its few ordered
    candidates, and a pass is one fold over them, so the greedy choice stays an expression and requests are spread over
    tasks.
    """
    names = list(X.CATEGORIES)
    at = X.lookup(F.col("category"), {"goal": -3, "intent": -2, "process": -1} | {c: k for k, c in enumerate(names)}, "int")
    item = F.struct(at.alias("at"), "rank", "id", F.col("cost").cast("long").alias("cost"))
    rows = chosen.groupBy("request_id", "token_budget").agg(F.array_sort(F.collect_list(item)).alias("items"))
    add = lambda s, x: s + x["cost"]
    zero = F.lit(0).cast("long")
    always = F.aggregate(F.filter("items", lambda x: x["at"] < -1), zero, add)
    fits_too = F.filter("items", lambda x: (x["at"] == -1) & (F.col("always") + x["cost"] <= F.col("token_budget")))
    rows = rows.withColumn("always", always).withColumn("start", F.col("always") + F.aggregate(fits_too, zero, add))
    room = F.greatest(F.col("token_budget") - F.col("start"), F.lit(0))
    rows = rows.withColumn("pools", F.array(*(F.floor(F.round(room * share, 6)).cast("long") for share, _ in X.CATEGORIES.values())))
    none = F.array().cast("array<struct<at:int,rank:int,id:string,cost:bigint>>")

    def first(s: Column, x: Column) -> Column:
        same = s["at"] == x["at"]
        spent, count = F.when(same, s["spent"]).otherwise(F.lit(0)), F.when(same, s["count"]).otherwise(F.lit(0))
        pool = F.element_at("pools", F.greatest(x["at"], F.lit(0)) + 1)
        fits = (x["at"] >= 0) & (s["used"] + x["cost"] <= F.col("token_budget")) & ((spent + x["cost"] <= pool) | (count == 0))
        cost = F.when(fits, x["cost"]).otherwise(F.lit(0))
        left = F.when(fits | (x["at"] < 0), s["left"]).otherwise(F.concat(s["left"], F.array(x)))
        return F.struct(x["at"].alias("at"), (s["used"] + cost).cast("long").alias("used"), (spent + cost).cast("long").alias("spent"), (count + fits.cast("int")).cast("int").alias("count"), F.when(fits, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"), left.alias("left"))

    def again(s: Column, x: Column) -> Column:
        fits = s["used"] + x["cost"] <= F.col("token_budget")
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"))

    begin = F.struct(F.lit(-9).alias("at"), F.col("start").alias("used"), zero.alias("spent"), F.lit(0).alias("count"), none.alias("taken"), none.alias("left"))
    rows = rows.withColumn("one", F.aggregate("items", begin, first))
    rows = rows.withColumn("two", F.aggregate("one.left", F.struct(F.col("one.used").alias("used"), none.alias("taken")), again))
    label = lambda p: lambda x: F.struct(F.element_at(F.array(*map(F.lit, names)), x["at"] + 1).alias("category"), x["id"].alias("id"), x["rank"].alias("rank"), F.lit(p).alias("pass"), x["cost"].alias("cost"))
    both = F.concat(F.transform("one.taken", label(1)), F.transform("two.taken", label(2)))
    return rows.select("request_id", "token_budget", "two.used", F.explode(both).alias("x")).select("request_id", "token_budget", "used", "x.*")
