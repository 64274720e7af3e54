"""Texts to sentences, concepts, semantic classes and noise decisions; tool results to digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import fixed as X
from loomgraph.functions.text import compatible, let

#: Concepts and what they are called.
CONCEPTS = {
    "context_compression": ("context compression", "prompt compression", "compact context", "compressed context", "ctx compression", "上下文压缩", "提示词压缩", "压缩上下文", "紧凑上下文"),
    "knowledge_graph": ("knowledge graph", "kg", "semantic graph", "知识图谱", "语义图谱", "图谱"),
    "provenance": ("provenance", "source lineage", "source trail", "来源追踪", "来源链路", "溯源", "出处"),
    "checkpoint": ("checkpoint", "state checkpoint", "memory checkpoint", "检查点", "状态检查点", "记忆检查点"),
    "runtime_bundle": ("runtime bundle", "context bundle", "bundle", "运行时上下文包", "上下文包", "bundle 诊断"),
    "traceability": ("traceability", "trace view", "trace", "可追溯性", "追踪视图", "追踪链路"),
    "artifact_sidecar": ("artifact sidecar", "sidecar artifact", "sidecar", "工件 sidecar", "旁路产物", "侧挂产物"),
}
#: What only acknowledges; sizes of a digest's head and tail, and beyond what a result is digested.
ACKNOWLEDGEMENT = r"^(?:ok|okay|yes|yep|yeah|sure|thanks|thank you|got it|understood|fine|cool|roger|copy|好的|行|恩|嗯|明白|收到|谢谢|好吧)$"
HEAD, TAIL, INLINE = 320, 200, 900


def ascii_words(pattern: str) -> str:
    """``\\b`` as a border of ASCII words, whatever letters stand outside them."""
    return pattern.replace(r"\b(?:", r"(?<![A-Za-z0-9_])(?:").replace(r")\b", r")(?![A-Za-z0-9_])")


def flat(text: Column) -> Column:
    """Compatibility forms folded, lower case and single spaces."""
    return F.trim(F.regexp_replace(F.lower(compatible(F.coalesce(text, F.lit("")))), r"\s+", " "))


def concepts(text: Column) -> Column:
    """Ids of the concepts that a text names: Latin names between spaces, others anywhere."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(flat(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))

    def named(padded: Column) -> Column:
        found = [F.when(F.greatest(*(F.contains(padded, F.lit(f" {a} " if a.isascii() else a)) for a in names)), c) for c, names in CONCEPTS.items()]
        return F.array_compact(F.array(*found))

    return let(F.concat(F.lit(" "), norm, F.lit(" ")), named)


def digested(results: DataFrame, text: str) -> DataFrame:
    """Large results as head and tail with what is left out; small ones as they are."""
    t = F.coalesce(F.col(text), F.lit(""))
    big = F.char_length(t) > INLINE
    left_out = F.when(big, F.char_length(t) - HEAD - TAIL).otherwise(0)
    preview = F.when(big, F.concat(F.substring(t, 1, HEAD), F.lit("\n...\n"), F.right(t, F.lit(TAIL)))).otherwise(t)
    return results.withColumn("compressed", big).withColumn("omitted_chars", left_out).withColumn("lines", F.size(F.split(t, "\n"))).withColumn("preview", preview)


def title(text: Column) -> Column:
    """The first line with something in it, without heading marks, at most 96 characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, "^#+", ""))), lambda s: s != "")
    return F.substring(F.get(lines, F.lit(0)), 1, 96)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by dashes, at most 72 characters."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 72)
    return F.when(s == "", "unspecified").otherwise(s)
