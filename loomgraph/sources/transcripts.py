"""Transcripts: lines of JSON with branches, of which the one that ends at the last leaf counts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "type string, id string, parentId string, timestamp string, message struct<role:string,content:string>, content string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, json`` of every line of text files; the order within a file is that of its lines."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("json"))
    return rows.where(F.trim("json") != "")


def entries(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, but for a file's header; malformed ones go."""
    parsed = lines.withColumn("e", F.from_json(F.trim("json"), ENTRY, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("e.type").isNotNull() & (F.col("e.type") != "session")).select("file", "line_no", "e.*")


def written(frame: DataFrame) -> DataFrame:
    """``frame`` from the checkpoint folder, so that rounds don't grow its lineage; only a local session gets a folder where none is set."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return frame.checkpoint(eager=True)


def branches(rows: DataFrame) -> DataFrame:
    """Each file's entries from its leaf back to the root, in the order of lines.

    The leaf is the last entry with an id that is nobody's parent; without any, or where no entry has an id, all
    entries stay.  Chains of any length are followed upwards for all files at once, twice as far in each round; a chain
    that comes to a cycle ends when it has gone round.
    """
    known = rows.where("id is not null")
    parents = known.select("file", F.col("parentId").alias("id")).where("id is not null").distinct()
    leaf = known.join(parents, ["file", "id"], "left_anti").groupBy("file").agg(F.max_by("id", "line_no").alias("leaf"))
    up = known.groupBy("file", "id").agg(F.max_by("parentId", "line_no").alias("parent"))
    # after k rounds ``chain`` has the leaf's 2^k nearest ancestors and ``jump`` leads 2^k entries up
    jump = written(up.where("parent is not null").select("file", "id", "parent"))
    chain, size = written(leaf.select("file", F.col("leaf").alias("id"))), 0
    while (now := chain.count()) > size:
        size = now
        chain = written(chain.unionByName(chain.join(jump, ["file", "id"]).select("file", F.col("parent").alias("id"))).distinct())
        further = jump.select("file", F.col("id").alias("parent"), F.col("parent").alias("above"))
        jump = written(jump.join(further, ["file", "parent"]).select("file", "id", F.col("above").alias("parent")))
    kept = rows.join(chain, ["file", "id"], "left_semi")
    whole = rows.join(leaf.select("file"), "file", "left_anti")
    return kept.select(*rows.columns).unionByName(whole)


def messages(rows: DataFrame) -> DataFrame:
    """Message entries of a branch as records: position, role and content, with the type that the role stands for."""
    kind = F.when(F.col("message.role") == "user", "Intent").when(F.col("message.role") == "assistant", "Decision").otherwise("State")
    m = rows.where("type = 'message'")
    return m.select("file", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("pos"), "id", "parentId", "timestamp", F.col("message.role").alias("role"), F.col("message.content").alias("content"), kind.alias("node_type"))


#: What a custom entry's type says of its node, and a text's words where that says nothing; the first that applies.
CUSTOM_TYPES = (("constraint", "Constraint"), ("rule", "Rule"), ("skill", "Skill"), ("mode", "Mode"), ("outcome|result", "Outcome"), ("tool", "Tool"), ("step", "Step"), ("risk|warning", "Risk"), ("process|workflow", "Process"))
TEXT_TYPES = (
    (r"\b(?:mode|operating mode|debug mode|strict mode)\b|模式|调试模式|严格模式", "Mode"), (r"\b(?:expected outcome|outcome|result should be|success means|target result)\b|结果应该|预期结果|产出|目标结果", "Outcome"),
    (r"\b(?:tooling|tool choice|preferred tool|use tool)\b|工具选择|推荐工具|使用工具", "Tool"), (r"\b(?:must|must not|should not|cannot|can't|never|forbid|required|constraint)\b|必须|不能|不可|禁止|约束|要求", "Constraint"),
    (r"(?:^|\n)\s*(?:step\s*\d+|next step|\d+[.)]|第[一二三四五六七八九十\d]+步|下一步)", "Step"), (r"\b(?:process|workflow|pipeline|roadmap|phase|stage)\b|流程|工作流|阶段", "Process"),
    (r"\b(?:risk|warning|blocker|blocked|conflict|failure|issue)\b|风险|警告|阻塞|冲突|失败", "Risk"), (r"\b(?:rule|policy|guideline)\b|规则|规范|准则", "Rule"), (r"\b(?:skill|pattern|playbook)\b|技能|模式|手册", "Skill"),
)
SOURCE_OF = {"Rule": "rule", "Constraint": "rule", "Process": "workflow", "Step": "workflow", "Outcome": "workflow", "Skill": "skill"}


def _item(value: Column) -> Column:
    """One item of a content: text as it is; an object's text, or its content, which may be a list; else its JSON."""
    part = lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), x)).otherwise(x)
    inner = F.get_json_object(value, "$.content")
    listed = F.when(inner.startswith("["), F.array_join(F.transform(F.from_json(inner, "array<string>"), part), "\n"))
    return F.when(value.startswith("{"), F.coalesce(F.get_json_object(value, "$.text"), listed, inner, value)).otherwise(value)


def flattened(json: Column, path: str) -> Column:
    """The text of a content at ``path``: a string, a list of parts, or an object; nothing is the empty string."""
    value = F.get_json_object(json, path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))
    parts = F.filter(F.transform(F.from_json(value, "array<string>"), _item), lambda x: x != "")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.coalesce(F.when(kind == "STRING", strip(value)).when(kind.startswith("ARRAY"), strip(F.array_join(parts, "\n"))).when(kind.startswith("OBJECT"), _item(value)), F.lit(""))


def text_type(text: Column) -> Column:
    """The node type that a transcript's text speaks of."""
    low, out = F.lower(text), F.when(F.lit(False), "")
    for pattern, kind in TEXT_TYPES:
        out = out.when(low.rlike(pattern.replace(r"\b(?:", r"(?<![A-Za-z0-9_])(?:").replace(r")\b", r")(?![A-Za-z0-9_])")), kind)
    return out.otherwise("State")


def role_of(role: Column) -> Column:
    return F.when(role.isin("assistant", "system", "tool"), role).when(role == "toolResult", "tool").otherwise("user")


def _record(rows: DataFrame, session: Column, stage: str, content: Column, node_type: Column, source_type: Column, role: Column, origin: Column, hint: Column) -> DataFrame:
    get = lambda k: F.get_json_object("json", f"$.{k}")
    some = rows.withColumn("content", content).where("content <> ''")
    anchor = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}\s]", " "), r"\s+", " ")), 1, 72)
    key = F.array_join(F.filter(F.array(F.lit(stage), F.lower(node_type), F.lower(F.coalesce(hint, F.lit(""))), anchor), lambda x: x != ""), "|")
    own = F.coalesce(get("id"), F.sha2(F.concat_ws("|", session, get("type"), "content"), 256))
    return some.select(
        own.alias("id"), source_type.alias("source_type"), role.alias("role"), "content", F.nullif(F.trim(F.coalesce(get("timestamp"), get("message.timestamp"))), F.lit("")).alias("created_at"), node_type.alias("node_type"), origin.alias("origin_kind"),
        F.lit(f"transcript_{stage}").alias("source_stage"), F.sha2("content", 256).alias("content_hash"), get("parentId").alias("parent_id"), key.alias("group_key"),
    )


def message_records(rows: DataFrame, session: Column) -> DataFrame:
    """Message entries (``json``) as records; those without text go."""
    role = role_of(F.get_json_object("json", "$.message.role"))
    kind = F.when(role == "user", "Intent").when(role == "assistant", "Decision").when(role == "tool", "State")
    source = F.when(role == "system", "system").when(role == "tool", "tool_output").otherwise("conversation")
    return _record(rows.where(F.get_json_object("json", "$.type") == "message"), session, "message", flattened(F.col("json"), "$.message.content"), kind, source, role, F.lit("raw"), F.lit(None).cast("string")).drop("group_key")


def custom_records(rows: DataFrame, session: Column) -> DataFrame:
    """Custom entries as records: content, display and details joined; the type by name, else by words."""
    said = F.lower(F.coalesce(F.get_json_object("json", "$.customType"), F.lit("")))
    by_name = F.when(F.lit(False), "")
    for pattern, name in CUSTOM_TYPES:
        by_name = by_name.when(said.rlike(pattern), name)
    parts = [flattened(F.col("json"), f"$.{p}") for p in ("content", "display", "details")]
    content = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")
    kind = F.coalesce(by_name, text_type(F.col("content")))
    packed = F.lower(F.concat_ws(" ", said, *parts[1:])).rlike("summary|compact|compression|checkpoint")
    source = F.coalesce(F.create_map(*(F.lit(x) for p in SOURCE_OF.items() for x in p))[kind], F.lit("system"))
    return _record(rows.where(F.get_json_object("json", "$.type") == "custom_message"), session, "custom", content, kind, source, F.lit("system"), F.when(packed, "compressed").otherwise("raw"), F.get_json_object("json", "$.customType"))


def compaction_records(rows: DataFrame, session: Column) -> DataFrame:
    """Compaction entries as records of compressed origin: summary and details joined."""
    parts = [F.coalesce(F.trim(F.get_json_object("json", "$.summary")), F.lit("")), flattened(F.col("json"), "$.details")]
    kind = text_type(F.col("content"))
    source = F.when(kind.isin("Rule", "Constraint"), "rule").otherwise("workflow")
    return _record(rows.where(F.get_json_object("json", "$.type") == "compaction"), session, "compaction", F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n"), kind, source, F.lit("system"), F.lit("compressed"), F.get_json_object("json", "$.firstKeptEntryId"))


def hook_records(rows: DataFrame, session: Column, hook: str) -> DataFrame:
    """Messages (``json``) that a hook has taken a snapshot of, as records without a route."""
    role = role_of(F.get_json_object("json", "$.role"))
    some = rows.withColumn("content", flattened(F.col("json"), "$.content")).where("content <> ''")
    source = F.when(role == "system", "system").when(role == "tool", "tool_output").otherwise("conversation")
    own = F.coalesce(F.concat(session, F.lit(":"), F.get_json_object("json", "$.id")), F.sha2(F.concat_ws("|", session, "json"), 256))
    stage = F.when(role == "tool", "tool_output_raw").otherwise("hook_message_snapshot")
    return some.select(own.alias("id"), source.alias("source_type"), role.alias("role"), F.sha2("content", 256).alias("content_hash"), stage.alias("source_stage"), F.lit(hook).alias("created_by_hook"))
