"""Tool results: read from their messages, classified, and reduced to what a transcript keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond these a result is reduced; how many signals and paths it keeps, and what of a long output.
SERIALIZED, INLINE, ITEMS = 1800, 900, 20
SIGNALS, PATHS = 6, 8
HEAD, TAIL = 320, 200
RESULT = (
    "toolName string, tool string, name string, command string, cmd string, stdout string, stderr string, exitCode int, code int, status string, state string, ok boolean, error struct<name:string,type:string,code:string,message:string>, "
    "itemCount int, count int, total int, totalHits int, items array<string>, results array<string>, nodes array<string>, edges array<string>, matches array<string>, hits array<string>, files array<string>, "
    "sourcePath string, path string, filePath string, file string, url string, sourceUrl string, summary string, message string, text string, content string, keySignals array<string>, provenance struct<originKind:string,sourceStage:string>, truncation struct<policyId:string>"
)
PATH_HINT = "(?i)(path|file|files|filepath|sourcepath|changed|affected|match|artifact|log)"
PATH_LIKE = r"[\\/]|(?i:\.([cm]?[jt]sx?|json|md|txt|log|yml|yaml|toml|ini|py|rs|go|java|cs)$)"


def cut(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def _first(*columns: str) -> Column:
    """The first of string fields that has something in it, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, r"\r?\n")))


def read(messages: DataFrame) -> DataFrame:
    """``messages`` (``id, role, content``; content is text or a JSON object) with what their results say."""
    rows = messages.withColumn("r", F.when(F.col("content").startswith("{"), F.from_json("content", RESULT)))
    lists = F.coalesce(*(F.when(F.col(f"r.{c}").isNotNull(), F.size(f"r.{c}")) for c in ("items", "results", "nodes", "edges", "matches", "hits", "files")))
    command = _first("r.command", "r.cmd")
    stderr_line = F.get(F.filter(F.transform(F.split("r.stderr", r"\r?\n"), F.trim), lambda x: x != ""), F.lit(0))
    exit_code = F.coalesce("r.exitCode", "r.code")
    fields = {
        "raw_size": F.char_length("content"), "output": F.when(F.col("r").isNull(), F.trim("content")).otherwise(F.coalesce(F.trim("r.text"), F.trim("r.content"), F.lit(""))), "command": command,
        "tool": F.coalesce(_first("r.toolName", "r.tool", "r.name"), F.lower(F.get(F.split(command, r"\s+"), F.lit(0))), F.lit("tool_output")), "exit_code": exit_code,
        "items": F.coalesce("r.itemCount", "r.count", "r.total", "r.totalHits", lists), "path": _first("r.sourcePath", "r.path", "r.filePath", "r.file"), "url": _first("r.sourceUrl", "r.url"),
        "error_code": F.coalesce(_first("r.error.code"), exit_code.cast("string")), "error_message": F.coalesce(_first("r.error.message"), stderr_line), "error_name": _first("r.error.name", "r.error.type"),
        "compressed": F.coalesce((F.col("r.provenance.originKind") == "compressed") & (F.col("r.provenance.sourceStage") == "tool_result_persist") & F.col("r.summary").isNotNull() & F.col("r.toolName").isNotNull() & F.col("r.keySignals").isNotNull() & F.col("r.truncation").isNotNull(), F.lit(False)),
        "arrays": F.coalesce(F.col("r.items"), F.col("r.results"), F.col("r.nodes"), F.col("r.edges")).isNotNull(), "found": F.coalesce(F.col("r.matches"), F.col("r.hits")).isNotNull(),
    }
    return rows.select("*", *(c.alias(n) for n, c in fields.items())).withColumns({"stdout": F.trim("r.stdout"), "stderr": F.trim("r.stderr")})


def has_error() -> Column:
    return F.coalesce("error_name", "error_code", "error_message").isNotNull()


def status() -> Column:
    said = F.lower(_first("r.status", "r.state"))
    return (
        F.when(said.isin("failure", "failed", "error"), "failure").when(said.isin("partial", "warning"), "partial").when(F.col("r.ok").isNotNull(), F.when(F.col("r.ok"), "success").otherwise("failure"))
        .when(has_error(), "failure").when(F.coalesce(F.trim("output"), F.lit("")) == "", "empty").otherwise("success")
    )


def kind() -> Column:
    name, command = F.lower("tool"), F.lower(F.coalesce("command", F.lit("")))
    word = lambda names: command.rlike(rf"(?<![A-Za-z0-9_])({names})(?![A-Za-z0-9_])")
    return (
        F.when(name.rlike("patch|apply_patch|edit"), "patch_apply").when(name.rlike("pytest|jest|vitest|mocha|test") | word("pytest|jest|vitest|mocha|pnpm test|npm test"), "test_run")
        .when(name.rlike("build|tsc|webpack|vite") | word("tsc|webpack|vite build|npm run build|pnpm build"), "build_run")
        .when(name.rlike("read|fetch|open") & F.coalesce(_first("r.path", "r.sourcePath"), F.col("url")).isNotNull(), F.when(F.col("url").isNotNull(), "document_fetch").otherwise("file_read"))
        .when(name.rlike("search|grep|find|query") & F.col("found"), "search_listing").when(F.col("arrays"), F.when(F.col("found"), "search_listing").otherwise("structured_query"))
        .when(F.coalesce(F.nullif("stdout", F.lit("")), F.nullif("stderr", F.lit("")), F.col("command")).isNotNull(), "command_execution").when(F.col("output").rlike(r"^[\[{]"), "structured_query").otherwise("unknown")
    )


def too_large() -> Column:
    longest = F.greatest(*(F.coalesce(F.char_length(c), F.lit(0)) for c in ("stdout", "stderr", "output")))
    return (F.col("raw_size") > SERIALIZED) | (longest > INLINE) | (F.coalesce("items", F.lit(0)) > ITEMS)


def reduced() -> Column:
    """The policy: results of tools alone, none that is reduced already, and only what is too large."""
    return F.col("role").isin("tool", "toolResult") & ~F.col("compressed") & too_large()


def affected_paths() -> Column:
    """Values under keys that speak of paths, or that look like one, at any depth; else paths anywhere in the text."""
    pairs = F.regexp_extract_all("content", F.lit(r'"([A-Za-z_]+)":("(?:[^"\\]++|\\.)*+"|\[[^\]\[{}]*+\])'), F.lit(1)), F.regexp_extract_all("content", F.lit(r'"([A-Za-z_]+)":("(?:[^"\\]++|\\.)*+"|\[[^\]\[{}]*+\])'), F.lit(2))
    each = lambda k, v: F.transform(F.regexp_extract_all(v, F.lit(r'"((?:[^"\\]++|\\.)*+)"'), F.lit(1)), lambda x: F.struct(k.alias("k"), F.trim(x).alias("v")))
    said = F.filter(F.flatten(F.zip_with(*pairs, each)), lambda p: (p["v"] != "") & (p["k"].rlike(PATH_HINT) | p["v"].rlike(PATH_LIKE)))
    keyed = F.array_distinct(F.transform(said, lambda p: cut(p["v"], 160)))
    loose = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"((?:[A-Za-z]:)?[\\/][^\s\"'`<>|]+)"), F.lit(1)), lambda x: cut(x, 160)))
    return F.slice(F.when(F.col("r").isNotNull() & (F.size(keyed) > 0), keyed).otherwise(loose), 1, PATHS)


def summary() -> Column:
    tool, command, failed = F.col("tool"), F.col("command"), F.col("status") == "failure"
    ran = lambda what: F.when(failed, F.concat(tool, F.lit(" ran "), F.coalesce(cut(command, 120), F.lit(f"{what} command")), F.lit(f" and reported {what} failures"))).otherwise(F.concat(tool, F.lit(" completed "), F.coalesce(cut(command, 120), F.lit(f"{what} execution"))))
    n = F.col("items").cast("string")
    by_kind = (
        F.when(F.col("kind") == "test_run", ran("test")).when(F.col("kind") == "build_run", ran("build"))
        .when(F.col("kind") == "search_listing", F.coalesce(F.concat(tool, F.lit(" returned "), n, F.lit(" search hits")), F.concat(tool, F.lit(" returned search results"))))
        .when(F.col("kind") == "structured_query", F.coalesce(F.concat(tool, F.lit(" returned "), n, F.lit(" structured items")), F.concat(tool, F.lit(" returned structured output"))))
        .when(F.col("kind").isin("document_fetch", "file_read"), F.concat(tool, F.lit(" loaded "), F.coalesce("path", F.lit("source content"))))
        .when(F.col("kind") == "patch_apply", F.concat(tool, F.when(failed, " failed to apply a patch").otherwise(" applied a patch")))
        .otherwise(F.coalesce(F.concat(tool, F.lit(" ran "), cut(command, 120)), F.concat(tool, F.lit(" produced tool output"))))
    )
    return F.coalesce(cut(_first("r.summary", "r.message"), 220), by_kind)


def line_count() -> Column:
    return lines(F.coalesce(F.nullif("stdout", F.lit("")), F.nullif("stderr", F.lit("")), F.nullif("output", F.lit("")), F.col("content")))


def key_signals() -> Column:
    said = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{name}="), value.cast("string")))
    found = F.array(
        said("exitCode", F.col("exit_code")), said("itemCount", F.col("items")), said("lineCount", line_count(), line_count() > 0), said("status", F.col("status"), F.col("status") != "success"), said("errorCode", F.col("error_code")),
        said("command", cut(F.col("command"), 80)), said("sourcePath", cut(F.col("path"), 80)), said("sourceUrl", cut(F.col("url"), 80)),
    )
    return F.slice(F.array_compact(found), 1, SIGNALS)


def reason() -> Column:
    long = lambda c, text, also=None: F.when((F.coalesce(F.char_length(c), F.lit(0)) > INLINE) & (F.lit(True) if also is None else also), text)
    alone = (F.coalesce("stdout", F.lit("")) == "") & (F.coalesce("stderr", F.lit("")) == "")
    found = F.array_compact(F.array(
        F.when(F.col("raw_size") > SERIALIZED, f"serialized output exceeded {SERIALIZED} chars"), long("stdout", "stdout was reduced to head/tail preview"), long("stderr", "stderr was reduced to head/tail preview"),
        long("output", "generic output was reduced to head/tail preview", alone), F.when(F.col("items") > ITEMS, f"result list exceeded {ITEMS} items"),
    ))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("tool output was normalized for transcript persistence")


def preview(text: Column) -> Column:
    """Head and tail of a long text, with how much is between them."""
    t = F.trim(text)
    short = F.char_length(t) <= HEAD + TAIL
    head, tail = F.substring(t, 1, HEAD), F.right(t, F.lit(TAIL))
    left_out = F.greatest(lines(t) - lines(head) - lines(tail), F.lit(0))
    return F.when(t != "", F.struct(F.when(short, t).otherwise(head).alias("head"), F.when(~short, tail).alias("tail"), F.when(~short, left_out).alias("omitted_lines"), F.when(~short, F.char_length(t) - HEAD - TAIL).alias("omitted_chars")))


def compressed(results: DataFrame) -> DataFrame:
    """What is kept of each result that the policy reduces: policy, summary, signals, preview, dropped parts, hash."""
    rows = results.where(reduced()).withColumns({"status": status(), "kind": kind()})
    output = F.coalesce(F.nullif("stdout", F.lit("")), F.nullif("stderr", F.lit("")), F.nullif("output", F.lit("")))
    alone = (F.coalesce("stdout", F.lit("")) == "") & (F.coalesce("stderr", F.lit("")) == "")
    long = lambda c: F.coalesce(F.char_length(c), F.lit(0)) > HEAD + TAIL
    dropped = F.array_compact(F.array(F.when(long("stdout"), "stdout.middle"), F.when(long("stderr"), "stderr.middle"), F.when(alone & long("output"), "output.middle"), F.when(F.col("items") > ITEMS, "result.items.tail")))
    return rows.select(
        "id", "tool", "status", "kind", F.concat("kind", F.lit("."), "status", F.lit(".v1")).alias("policy_id"), summary().alias("summary"), key_signals().alias("signals"), preview(output).alias("preview"), dropped.alias("dropped"),
        reason().alias("reason"), affected_paths().alias("paths"), F.sha2("content", 256).alias("content_hash"), "raw_size", line_count().alias("line_count"), "items", "error_code",
    )
