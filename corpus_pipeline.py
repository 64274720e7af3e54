"""A cleaning pipeline over ``documents``: each stage works on all that the stage before it kept.

Language ID drops texts without a language; of each group of near duplicates one document stays; documents that hold
benchmark items go; secrets are masked; what is left is encoded.  A stage returns the columns of ``documents``, the last
one the encoding's digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe_codec, decontamination, lang_id, near_texts, secret_scans
from loomgraph.llm.common import cut, prepared, table
from loomgraph.llm.queries import tokenizer_path

#: Of held-out texts whose language is found, so many have a score below the least that counts as a language's ...
UNSURE = 0.01
#: ... times this: a text must be much less sure than the least sure of those to be in no language.
MARGIN = 0.5
#: Ids that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by place (``c0``, ``c1`` ...), with which no others clash."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def own(docs: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` of ``docs`` in ``by_place(docs)``, as ``kind``."""
    return F.col(f"c{docs.columns.index(name)}").cast(kind).alias(name)


def as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` alone, under their own names."""
    return rows.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``by_place(docs)`` with a number ``row`` for each row, whether it has an id of its own or not; written, so that it stays the same."""
    return cut(by_place(docs).withColumn("row", F.monotonically_increasing_id()))


def least_score(docs: DataFrame, net: lang_id.ByteNet | None) -> float:
    """The score below which a text is in no language, from held-out labelled texts; 0 if there are none."""
    held_out = docs.where((lang_id.fold() == 0) & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    said = lang_id.predict(held_out, net, "lang").where(F.col("lang_pred") == F.col("lang"))
    found = said.agg(F.percentile_approx("score", UNSURE, 10_000).alias("score")).first().score
    return MARGIN * (found or 0.0)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without letters, null and empty ones included, or in none clearly enough, go.

    Each row is judged by its own text, repeated ones and those without id too; other columns may have any names; of an
    empty table nothing is left.
    """
    rows, net = by_place(docs), lang_id.train(docs)
    said = lang_id.predict(rows.select(own(docs, "doc_id", "long"), own(docs, "text", "string"), "*"), net, *rows.columns)
    return as_before(said.where((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= least_score(docs, net))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near-duplicate links hold together: that of the smallest id, one without id only if none has any.

    Null texts and those without words have no links and stay; a repeated row is a copy like any other; other columns may
    have any names; of an empty table nothing is left.
    """
    rows = numbered(docs)
    found = near_texts.jaccard_join(rows.select(F.col("row").alias("doc_id"), own(docs, "text", "string"))).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    kept = found.join(rows.select("row", own(docs, "doc_id", "long")), "row").groupBy("component_id").agg(first).select("first.row")
    return as_before(rows.join(kept, "row", "left_semi"), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text, repeated ones and those without id too.

    Null and empty texts stay; other columns may have any names; of an empty table nothing is left.
    """
    rows = numbered(docs)
    found = decontamination.leaks(rows.select(F.col("row").alias("doc_id"), own(docs, "text", "string")), table(spark, sf_dir, "benchmark"))
    leaks = cut(found.select(F.col("doc_id").alias("row")).distinct())
    few = leaks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return as_before(rows.join(F.broadcast(leaks) if few else leaks, "row", "left_anti"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars``, where it is a column, that of the masked text.

    Null and empty texts stay as they are; repeated rows and those without id are masked each for itself; other columns
    may have any names; an empty table gives an empty one.
    """
    kinds, names = dict(docs.dtypes), docs.columns
    rows = by_place(docs).select("*", own(docs, "text", "string"))
    masked = secret_scans.redact(rows.withColumn("before", F.col("text")))
    new = masked.withColumn(f"c{names.index('text')}", F.col("text").cast(kinds["text"]))
    if "n_chars" in names:
        c = f"c{names.index('n_chars')}"
        new = new.withColumn(c, F.when(F.col("text").eqNullSafe(F.col("before")), F.col(c)).otherwise(F.char_length("text").cast(kinds["n_chars"])))
    return as_before(new, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and those without id are encoded each
    for itself; other columns are ignored; an empty table gives an empty result.
    """
    return bpe_codec.digests(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("secrets", secrets), ("encoding", encoding)]

#: No SQL expresses the learned stages; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage returns is a table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{prepared(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
