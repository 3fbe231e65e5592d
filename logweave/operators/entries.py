"""Deduplication, guards, content blocks, tool calls and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.scalars import at, kind_of, strict_string, truthy

# The entry types that have a guard of their own.
ENTRY_TYPES = [
    "user", "assistant", "system", "summary", "file-history-snapshot", "queue-operation", "attachment",
    "permission-mode", "progress", "last-prompt", "agent-name", "custom-title", "pr-link", "worktree-state",
]
BLOCK_TYPES = ["text", "thinking", "tool_use", "tool_result", "image"]
# Tools that start a sub-agent.
TASK_TOOLS = ["Agent", "Task"]


def deduplicate(entries: DataFrame) -> DataFrame:
    """Of the entries of a session with the same request, the last one, in its own place; all others stay.

    Needs session_key, line_no, request_key (null: no request). The last line is a plain maximum over the
    group: no sort by line.
    """
    last = F.max("line_no").over(Window.partitionBy("session_key", "request_key"))
    kept = entries.withColumn("__last", F.when(F.col("request_key").isNotNull(), last))
    return kept.where(F.col("__last").isNull() | (F.col("__last") == F.col("line_no"))).drop("__last")


def of_type(entries: DataFrame, name: str) -> DataFrame:
    """The guard of an entry type; any name is allowed, known or not."""
    return entries.where(F.col("type") == name)


def main_chain(entries: DataFrame) -> DataFrame:
    """Assistant entries that are neither of a side chain nor synthetic."""
    return entries.where((F.col("type") == "assistant") & ~F.coalesce("is_sidechain", F.lit(False)) & ~F.coalesce(F.col("model") == "<synthetic>", F.lit(False)))


def blocks(entries: DataFrame) -> DataFrame:
    """(session_key, line_no, block_no, entry_type, entry_uuid, block_type, block) of the content arrays."""
    out = entries.select("session_key", "line_no", F.col("type").alias("entry_type"), F.col("uuid").alias("entry_uuid"), F.posexplode("content_blocks").alias("block_no", "block"))
    return out.withColumn("block_type", strict_string(F.col("block"), "$.type"))


def blocks_of_type(block_rows: DataFrame, name: str) -> DataFrame:
    return block_rows.where(F.col("block_type") == name)


def tool_calls(block_rows: DataFrame) -> DataFrame:
    """One row per tool use of an assistant: id, name, input, is_task."""
    b = F.col("block")
    name = strict_string(b, "$.name")
    used = block_rows.where((F.col("entry_type") == "assistant") & (F.col("block_type") == "tool_use"))
    return used.select("session_key", "line_no", "block_no", "entry_uuid", strict_string(b, "$.id").alias("tool_id"), name.alias("name"), at(b, "$.input").alias("input"), F.coalesce(name.isin(TASK_TOOLS), F.lit(False)).alias("is_task"))


def tool_results(block_rows: DataFrame) -> DataFrame:
    """One row per tool result of a user entry: tool_use_id, content, is_error."""
    b = F.col("block")
    got = block_rows.where((F.col("entry_type") == "user") & (F.col("block_type") == "tool_result"))
    return got.select("session_key", "line_no", "block_no", "entry_uuid", strict_string(b, "$.tool_use_id").alias("tool_use_id"), at(b, "$.content").alias("content"), truthy(at(b, "$.is_error")).alias("is_error"))


def calls_with_results(calls: DataFrame, results: DataFrame, how: str = "left") -> DataFrame:
    """Calls joined to results by session and id; ``how`` is left, inner, left_semi, or left_anti (pending calls)."""
    right = results if how in ("left_semi", "left_anti") else results.select("session_key", "tool_use_id", F.col("line_no").alias("result_line_no"), F.col("block_no").alias("result_block_no"), "content", "is_error")
    return calls.join(right.withColumnRenamed("tool_use_id", "tool_id"), ["session_key", "tool_id"], how)


def orphan_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Results whose call is not there (deduplication drops calls)."""
    return results.join(calls.select("session_key", F.col("tool_id").alias("tool_use_id")), ["session_key", "tool_use_id"], "left_anti")


def find_first(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The first row, in order of the log, whose ``column`` is ``value``; empty if there is none."""
    return rows.where(F.col(column) == value).orderBy("session_key", "line_no", "block_no").limit(1)


def malformed(entries: DataFrame) -> DataFrame:
    """(session_key, line_no, method): entries that lack a nested field on which the named operator depends.

    tasks and fileHistory need a session id that can name a folder; messages needs a request id that can be told
    from others, which an object or array cannot.
    """
    raw = F.col("raw")

    def lacks(path: str, kinds: list[str]):
        return ~F.coalesce(kind_of(at(raw, path)).isin(kinds), F.lit(False))

    assistant, user, attachment, snapshot = (F.col("type") == t for t in ("assistant", "user", "attachment", "file-history-snapshot"))
    named = ~kind_of(at(raw, "$.sessionId")).isin("number", "boolean", "object", "array") | at(raw, "$.sessionId").isNull()
    checks = {
        "messages": assistant & F.coalesce(kind_of(at(raw, "$.requestId")).isin("object", "array"), F.lit(False)),
        "tasks": ~named,
        "metrics": assistant & lacks("$.message.usage", ["object"]),
        "compaction": assistant & ~F.col("is_sidechain") & lacks("$.message.usage", ["object"]),
        "toolCalls": assistant & lacks("$.message.content", ["array", "string"]),
        "toolResults": user & lacks("$.message", ["object"]),
        "firstUserMessage": user & lacks("$.message.content", ["array", "string"]),
        "isOngoing": assistant & lacks("$.message.content", ["array", "string"]),
        "skills": attachment & lacks("$.attachment", ["object"]),
        "deferredTools": attachment & lacks("$.attachment", ["object"]),
        "fileHistory": (snapshot & lacks("$.snapshot", ["object"])) | ~named,
    }
    found = F.array(*(F.when(c, F.lit(m)) for m, c in checks.items()))
    return entries.select("session_key", "line_no", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("method"))
