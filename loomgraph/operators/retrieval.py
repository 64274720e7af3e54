"""Retrieval of nodes of all scopes: an inverted index of words, and a threshold search over postings ordered by base score.

A query's term matches where a text contains it, also inside a word.  So the index has two levels: words of nodes with
the nodes that hold them, and short substrings of words, by which a term finds the words that contain it.

The best nodes of a type for a request are sought as far as they can still be bettered.  A node that shares no term
with the request scores its base, so of such nodes only the head of its type can be among the best.  Of each term the
nodes of highest base are read; a node that none of the request's terms has shown yet has at most the base at which the
reading stopped, and what its terms could add.  If this is less than the last of the best nodes found, they are final; the
other requests read deeper, and score only nodes whose known terms could better what they have.  Postings of a term and
type are ranked by one task, once for all rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.functions import text as T
from loomgraph.operators import selection as S
from loomgraph.operators.selection import spread
from loomgraph.sources.transcripts import written

#: Characters of the substrings by which terms find words.
GRAM = 3
#: Nodes of a term and type that are read first, and how much deeper each round goes.
DEPTH, DEEPER = 64, 8
#: Scores are rounded to so many places; a bound must be below by more than half of the last.
MARGIN = 1e-6

#: How many nodes of each type a bundle can hold: the limit of its slot.
SLOT_OF = {**X.CATEGORY_OF, **X.SLOTS, "Mode": "constraints", "Outcome": "states", "Tool": "evidence"}
MOST = {kind: X.CATEGORIES[slot][1] if slot in X.CATEGORIES else 1 for kind, slot in SLOT_OF.items()}


def _grams(word: Column, least: Column) -> Column:
    """Distinct substrings of ``word`` of ``least`` to GRAM characters."""
    characters = F.filter(F.split(word, ""), lambda c: c != "")

    def of(chars: Column) -> Column:
        size = F.size(chars)
        places = lambda n: F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.flatten(F.transform(F.sequence(least, F.lit(GRAM)), lambda n: F.transform(places(n), lambda i: F.array_join(F.slice(chars, i, n), "")))))

    return F.element_at(F.transform(F.array(characters), of), 1)


def containing(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``term, word``: the distinct ``words`` that contain each of the distinct ``terms``, by the term's rarest substring."""
    # few bytes but much work a word: sessions' names are words, too, so their number grows with the input
    grams = written(spread(words, "word").select("word", F.explode(_grams(F.col("word"), F.lit(1))).alias("gram")))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = spread(terms, "term").select("term", F.explode(_grams(F.col("term"), F.least(F.char_length("term"), F.lit(GRAM)))).alias("gram"))
    rarest = own.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).select("term", "m.gram")
    return spread(rarest, "gram").join(spread(grams, "gram"), "gram").where(F.contains("word", "term")).select("term", "word")


def index(n: DataFrame) -> DataFrame:
    """The index of ``recallable`` nodes: a row for each word of a node's label and payload, with the node's type, base and label."""
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", "label_norm", "payload_norm"), " "), lambda w: w != ""))
    return n.select(F.explode(words).alias("word"), "id", "type", "base", "label")


def postings(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``term, id, type, base, label``: the nodes of an ``index`` whose texts contain each of ``terms``."""
    words = written(words)
    pairs = containing(terms.select("term").distinct(), words.select("word").distinct())
    return words.join(pairs, "word").groupBy("term", "id").agg(*(F.first(c).alias(c) for c in ("type", "base", "label")))


def _terms(r: DataFrame) -> DataFrame:
    return r.select("request_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))


def matches(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every pair of a request and a node that it may recall and whose label or payload holds one of its terms, scored.

    Nodes of the request's session and workspace come by their keys, those of all scopes by the index.
    """
    r, n = written(S.asked(requests)), written(S.recallable(spread(nodes)))
    own, everywhere = S.scored(S.near(r, n)).where("direct"), n.where("scope = 'global'")
    hit = _terms(r).join(postings(_terms(r), index(everywhere)), "term").select("request_id", "id")
    hit = spread(hit, "request_id", "id").distinct()
    return own.unionByName(S.scored(hit.join(r, "request_id").join(everywhere, "id")))


def filtered(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``request_id, id``: the global ``nodes`` (``id, label``) whose labels pass the text filter of each request's ``query``.

    A label that passes holds the query's terms, so the index of labels gives all of them; an empty query passes every
    label and is left to the caller, who knows how many are wanted.
    """
    r = written(requests.select("request_id", T.normalized(F.col("query")).alias("norm")).withColumn("terms", T.terms(F.col("norm"))).where("norm <> ''"))
    n = written(nodes.select("id", T.normalized(F.col("label")).alias("label_norm")))
    words = n.select(F.explode(F.array_distinct(F.split("label_norm", " "))).alias("word"), "id", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("base"), F.lit(None).cast("string").alias("label"))
    hit = _terms(r).join(postings(_terms(r), words), "term").select("request_id", "id").distinct()
    return hit.join(r, "request_id").join(n, "id").where(T.passes(F.col("label_norm"), F.col("norm"), F.col("terms"))).select("request_id", "id")


def _gain(k: Column, n: Column) -> Column:
    """The most that ``k`` of a query's ``n`` terms can add to a score."""
    phrase, term, coverage, full = (a + b for a, b in zip(S.LABEL_WEIGHTS, S.PAYLOAD_WEIGHTS, strict=True))
    return k * F.lit(float(term)) + k / n * float(coverage) + F.when(k == n, float(full + phrase)).otherwise(0.0)


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """``place`` of each row within its ``by`` in the order of ties: base, label, id."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("base"), "label", "id")))


def _head(rows: DataFrame, depth: int, *by: str) -> DataFrame:
    """The first ``depth`` rows of each ``by``."""
    return _placed(rows, *by).where(F.col("place") <= depth)


def best(r: DataFrame, n: DataFrame, most: dict[str, int] = MOST, depth: int = DEPTH) -> DataFrame:
    """The ``most`` best of the global nodes ``n`` of each type for each request of ``r``, as ``scored`` gives them.

    ``r`` are ``asked`` requests, ``n`` ``recallable`` nodes; both are read several times, so they should be written.
    """
    limit = X.lookup(F.col("type"), most, "int")
    n = n.where(F.col("type").isin(*most))
    terms = written(_terms(r))
    # ranked once: a round reads places up to its depth, and what is at that place is the base at which it stops
    posted = written(_placed(postings(terms, index(n)), "term", "type").select("term", "type", "id", "base", "place"))
    heads = written(_head(n.select("id", "type", "base", "label"), max(most.values()), "type").where(F.col("place") <= limit).select("id", "type", "base"))
    wanted = r.select("request_id", F.explode(F.lit(list(most))).alias("type"))
    done: list[DataFrame] = []
    few = F.broadcast if r.count() <= S.REQUESTS else lambda frame: frame
    least: DataFrame | None = None
    while True:
        asking = wanted.join(terms, "request_id")
        unread = posted.where(F.col("place") == depth).select("term", "type", F.col("base").alias("low"))
        lows = asking.join(unread, ["term", "type"]).groupBy("request_id", "type").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("low"), asc=False).alias("lows"))
        lows = written(lows)
        hit = asking.join(posted.where(F.col("place") <= depth), ["term", "type"]).select("request_id", "id", "type", "base", "n", F.lit(1).alias("hits"))
        head = wanted.join(heads, "type").select("request_id", "id", "type", "base", F.lit(None).cast("int").alias("n"), F.lit(0).alias("hits"))
        pairs = spread(hit.unionByName(head), "id").groupBy("request_id", "id", "type").agg(F.first("base").alias("base"), F.max("n").alias("n"), F.sum("hits").alias("hits"))
        if least is not None:
            # what is known of a pair bounds its score: the terms that showed it, and those read to its base at most; below the last of the best it isn't scored
            known = pairs.join(few(least), ["request_id", "type"], "left").join(few(lows.select("request_id", "type", "lows", F.col("n").alias("of"))), ["request_id", "type"], "left")
            n_terms = F.coalesce("n", "of", F.lit(1))
            unshown = F.when(F.col("lows").isNull(), 0).otherwise(F.size(F.filter("lows", lambda low: low >= F.col("base"))))
            terms_at_most = F.least(n_terms, F.col("hits") + unshown)
            pairs = known.where(F.col("least").isNull() | (F.col("base") + _gain(terms_at_most, n_terms) >= F.col("least") - MARGIN))
        found = S.scored(pairs.select("request_id", "id").join(n, "id").join(few(r), "request_id"))
        w = Window.partitionBy("request_id", "type").orderBy(F.desc("score"), "label", "id")
        kept = written(found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(most.values())).where(F.col("place") <= limit))
        least = kept.groupBy("request_id", "type").agg(F.when(F.count("*") == F.first(limit), F.min("score")).alias("least"))
        bound = F.array_max(F.transform("lows", lambda low, k: low + _gain(k + 1, F.col("n"))))
        open_ = lows.join(least, ["request_id", "type"], "left").where(F.col("least").isNull() | (bound >= F.col("least") - MARGIN)).select("request_id", "type")
        open_ = written(open_)
        done.append(kept.join(open_, ["request_id", "type"], "left_anti").drop("place"))
        if not open_.limit(1).count():
            break
        wanted, depth = open_, depth * DEEPER
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def recalled(requests: DataFrame, nodes: DataFrame, most: dict[str, int] = MOST, depth: int = DEPTH) -> DataFrame:
    """What can be among the ``most`` best of a type for each request: all nodes of its session and workspace, and the best global ones."""
    r, n = written(S.asked(requests)), written(S.recallable(spread(nodes)))
    own = S.scored(S.near(r, n)).where(F.col("type").isin(*most))
    return own.unionByName(best(r, n.where("scope = 'global'"), most, depth))


class Recall:
    """What ``compiling.passes`` starts from: candidates of all requests, and the pairs that relations lead to beyond them.

    Of each request and type raw nodes alone count, if there are any.  Where raw global nodes of a type exist, no others
    are retrieved.
    """

    def __init__(self, requests: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> None:
        self.r, n = written(S.asked(requests)), written(S.recallable(spread(nodes)))
        everywhere = n.where((F.col("scope") == "global") & F.col("type").isin(*MOST))
        raw = everywhere.where("origin_kind = 'raw'").select("type", F.lit(True).alias("raw")).distinct()
        pool = everywhere.join(F.broadcast(raw), "type", "left")  # a row a type
        self.pool = written(pool.where(F.col("raw").isNull() | (F.col("origin_kind") == "raw")).drop("raw"))
        own = S.scored(S.near(self.r, n)).where(F.col("type").isin(*MOST))
        self.own_raw = written(own.where("origin_kind = 'raw'").select("request_id", "type").distinct())
        self.candidates = own.unionByName(best(self.r, self.pool, MOST, depth))

    def beyond(self, support: DataFrame, rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
        """Supported pairs (``request_id, id``) of global nodes of ``types`` that ``rows`` lack."""
        pairs = support.select("request_id", "id").distinct().join(rows.select("request_id", "id"), ["request_id", "id"], "left_anti")
        found = S.scored(pairs.join(self.pool.where(F.col("type").isin(*types)), "id").join(self.r, "request_id"))
        compressed = found.where("origin_kind <> 'raw'").join(self.own_raw, ["request_id", "type"], "left_anti")
        return found.where("origin_kind = 'raw'").unionByName(compressed)
