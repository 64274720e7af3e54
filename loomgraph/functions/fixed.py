"""Fixed values that results depend on: types, contracts, policies, thresholds, word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "we", "what", "when", "where", "why", "with")

#: Fixed values of the relation contract: edge type -> (stable, usage, freshness, default confidence, recall priority, recall order).
RELATIONS = {
    "documents": (True, "explain_only", "active", 0.92, None, None),
    "contains": (True, "explain_only", "active", 0.9, None, None),
    "defines": (True, "explain_only", "active", 0.9, None, None),
    "supported_by": (True, "recall_eligible", "active", 1.0, 2.5, 1),
    "requires": (True, "recall_eligible", "active", 0.85, 1.75, 2),
    "next_step": (True, "recall_eligible", "active", 0.8, 1.5, 3),
    "overrides": (True, "recall_eligible", "active", 0.95, 1.25, 4),
    "supersedes": (True, "governance_only", "superseded", 0.95, None, 5),
    "conflicts_with": (True, "governance_only", "active", 0.9, None, None),
    "derived_from": (False, "explain_only", "active", 0.75, None, None),
    "applies_when": (False, "explain_only", "active", 0.7, None, None),
    "forbids": (False, "explain_only", "active", 0.7, None, None),
    "permits": (False, "explain_only", "active", 0.7, None, None),
    "uses_skill": (False, "explain_only", "active", 0.7, None, None),
    "produces": (False, "explain_only", "active", 0.7, None, None),
}
#: Shares of what the fixed slots leave of a budget, and how many nodes each category takes at most.
CATEGORIES = {"rules": (0.2, 8), "constraints": (0.16, 6), "risks": (0.14, 4), "decisions": (0.12, 4), "states": (0.14, 4), "evidence": (0.16, 6), "skills": (0.08, 4)}
#: Fixed slots, charged before the categories: the first two always, the last if it fits.
SLOTS = {"Goal": "goal", "Intent": "intent", "Step": "process", "Process": "process"}
CATEGORY_OF = {"Rule": "rules", "Constraint": "constraints", "Risk": "risks", "Decision": "decisions", "State": "states", "Evidence": "evidence", "Skill": "skills"}
#: Who may act on proposals of a scope; dashboard thresholds (direction, value).
AUTHORITIES = {"session": ("session_operator", "workspace_reviewer", "global_reviewer"), "workspace": ("workspace_reviewer", "global_reviewer"), "global": ("global_reviewer",)}
THRESHOLDS = {"live": ("min", 0.5), "fallback": ("max", 0.4), "noise": ("max", 0.35), "promotion": ("min", 0.6), "pollution": ("max", 0.2), "reuse": ("min", 0.4), "intrusion": ("max", 0.3), "multi_source": ("min", 0.5)}
SCOPE_PRECEDENCE = {"session": 12, "workspace": 8, "global": 4}
STRENGTH_SCORE = {"hard": 4.0, "soft": 2.0, "heuristic": 1.0}
ORIGIN_SCORE = {"raw": 3.0, "compressed": 1.0, "derived": 0.5}
#: Types that are recalled in their own session alone, that may rise to a workspace, and to all.
TRACE_TYPES = ("Attempt", "Episode", "FailureSignal", "ProcedureCandidate")
PROMOTED_TYPES = ("Pattern", "FailurePattern", "SuccessfulProcedure")
WORKSPACE_TYPES = ("Rule", "Constraint", "Mode", "Process", "Step", "Skill")
GLOBAL_TYPES = ("Rule", "Constraint", "Mode", "Skill")
INELIGIBLE_TYPES = (*TRACE_TYPES, *PROMOTED_TYPES, "Document", "Repo", "Module", "File", "API", "Command")
#: Word patterns of semantic classes, tested on lower-case text.
PATTERNS = {
    "Goal": r"\b(?:need|goal|want|trying to|aim to)\b|需要|目标|想要|打算|准备",
    "Constraint": r"\b(?:must|must not|should|should not|cannot|can not|can't|never|required|requirement)\b|必须|不能|不可以|不要|禁止|要求",
    "Step": r"\b(?:step|next step|first|second|before|after|then)\b|第.{0,3}步|下一步|先|再|之后|然后",
    "Process": r"\b(?:process|workflow|pipeline|phase|stage)\b|流程|工作流|阶段|管线",
    "Risk": r"\b(?:risk|warning|blocked|failure|failed|error|exception|timeout|incident)\b|风险|警告|失败|错误|异常|超时|阻塞",
    "Outcome": r"\b(?:result|outcome|success|succeeded|completed)\b|结果|产出|成功|完成",
    "Tool": r"\b(?:tool|cli|command|api|script|artifact)\b|工具|命令|脚本|接口|产物",
    "Question": r"\?$|怎么|如何|为何|为什么|哪一步|哪个|什么|\b(?:what|why|how|which)\b",
}
NEGATIVE = r"\b(?:must not|should not|do not|don't|never|forbid|forbidden|disable|stop|remove|avoid)\b|不要|不能|不可|禁止|禁用|停止|移除|避免"
POSITIVE = r"\b(?:must|should|enable|continue|keep|preserve|use|required)\b|必须|应该|启用|继续|保留|使用|要求"


def lookup(key: Column, values: dict, kind: str = "double") -> Column:
    """The value of ``key`` in a small fixed table; null if it isn't there."""
    entries = [F.lit(x) for k, v in values.items() if v is not None for x in (k, v)]
    return F.create_map(*entries)[key].cast(kind)


def relation_contract(spark: SparkSession) -> DataFrame:
    """The relation contract, one row an edge type."""
    rows = [(k, *v, v[1] == "recall_eligible", True) for k, v in RELATIONS.items()]
    return spark.createDataFrame(rows, "type string, stable boolean, usage string, freshness string, default_confidence double, recall_priority double, recall_order int, recall_eligible boolean, explain_visible boolean")
