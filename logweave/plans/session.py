"""The facade: all derived relations of a set of session logs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import derive
from logweave.operators import entries as ops
from logweave.sources import discovery, file_history, jsonl, persisted, tasks
from logweave.sources.files import default_dir, frame, matching


class SessionLogs:
    """Logs of any number of sessions; every method gives a lazy DataFrame keyed by session_key.

    The parsed entries are shared: they are persisted at first use, as all relations start from them. Call
    :meth:`close` to let them go. Files are read once; open anew to see later lines.
    """

    def __init__(self, spark: SparkSession, paths: str | list[str], persist: bool = True):
        self.spark, self.paths, self.persist = jsonl.configure(spark), paths, persist

    @cached_property
    def raw_entries(self) -> DataFrame:
        """Entries before deduplication."""
        rows = jsonl.read_entries(self.spark, self.paths)
        return rows.persist() if self.persist else rows

    @cached_property
    def sessions(self) -> DataFrame:
        """(session_key, size) of every file, empty ones included: a listing, no file is opened."""
        return frame(self.spark, matching(self.spark, self.paths), "session_key string, size long")

    @cached_property
    def entries(self) -> DataFrame:
        """Entries with the last of each request's lines only."""
        return ops.deduplicate(self.raw_entries)

    @property
    def messages(self) -> DataFrame:
        return self.entries

    def close(self) -> None:
        if "raw_entries" in self.__dict__ and self.persist:
            self.raw_entries.unpersist()

    def of_type(self, name: str) -> DataFrame:
        return ops.of_type(self.entries, name)

    def blocks(self) -> DataFrame:
        return ops.blocks(self.entries)

    def metadata(self) -> DataFrame:
        """session_id (empty if none), version, git_branch, cwd, permission_mode."""
        found = self.sessions.select("session_key").join(derive.first_observed(self.entries), "session_key", "left")
        return found.withColumn("session_id", F.coalesce("session_id", F.lit("")))

    def metrics(self) -> DataFrame:
        return derive.metrics(self.entries, self.sessions)

    def first_user_message(self) -> DataFrame:
        return derive.first_user_message(self.entries.withColumn("text", derive.user_text(self.entries)))

    def is_ongoing(self) -> DataFrame:
        return derive.ongoing(derive.activity_events(self.entries), self.sessions)

    def compaction(self) -> DataFrame:
        return derive.compaction(self.entries)

    def compaction_phases(self) -> DataFrame:
        return derive.compaction_phases(self.entries)

    def tool_calls(self) -> DataFrame:
        return ops.tool_calls(self.blocks())

    def tool_results(self) -> DataFrame:
        return ops.tool_results(self.blocks())

    def find_tool_call(self, tool_id: str) -> DataFrame:
        return ops.find_first(self.tool_calls(), "tool_id", tool_id)

    def find_tool_result(self, tool_use_id: str) -> DataFrame:
        return ops.find_first(self.tool_results(), "tool_use_id", tool_use_id)

    def skills(self) -> DataFrame:
        return derive.skills(derive.skill_listings(self.entries))

    def deferred_tools(self) -> DataFrame:
        return derive.deferred_tools(derive.deferred_deltas(self.entries))

    def persisted_outputs(self) -> DataFrame:
        """References to spilled results: one row per tool result whose content is a wrapper."""
        text = self.tool_results().withColumn("content", F.when(F.schema_of_variant("content") == "STRING", F.try_variant_get(F.col("content"), "$", "string")))
        return persisted.parse_persisted(text)

    def load_persisted(self, paths: str | list[str], strict: bool = False) -> DataFrame:
        return persisted.load_persisted(self.persisted_outputs(), persisted.read_spilled(self.spark, paths), strict)

    def file_history(self, base: str | None = None) -> DataFrame:
        versions = file_history.latest_versions(file_history.snapshot_rows(self.entries))
        blobs = file_history.list_blobs(self.spark, base)
        return file_history.file_history(versions, self.metadata(), blobs).orderBy("session_key", *file_history.history_order())

    def read_file_history(self, base: str | None = None) -> DataFrame:
        return file_history.read_blobs(self.spark, self.file_history(base), base or default_dir("file-history"))

    def tasks(self, base: str | None = None) -> DataFrame:
        found = tasks.read_tasks(self.spark, base)
        return self.metadata().select("session_key", "session_id").join(found, "session_id").orderBy("session_key", *tasks.task_order())

    def subagents(self, files: DataFrame | None = None) -> DataFrame:
        """Edges to the sub-agent logs among ``files`` (session_key, size); without it, to those beside these sessions."""
        own = [r["session_key"] for r in self.sessions.select("session_key").collect()]  # names, which were listed on the driver
        if files is None:
            folders = sorted({path.rsplit("/", 1)[0] for path in own})
            globs = [glob for f in folders for glob in (f"{f}/agent-*.jsonl", f"{f}/*/subagents/agent-*.jsonl")]
            files = frame(self.spark, matching(self.spark, globs), "session_key string, size long")
        paths = sorted({r["session_key"] for r in files.select("session_key").collect()} | set(own))
        if not paths:
            return frame(self.spark, [], "parent_key string, child_key string, layout string")
        return discovery.subagent_files(self.sessions, files, jsonl.first_lines(self.spark, paths))

    def malformed(self) -> DataFrame:
        return ops.malformed(self.entries)

    def views(self, prefix: str = "") -> list[str]:
        """Register the relations as temporary views and return their names."""
        made = {
            "entries": self.entries, "metrics": self.metrics(), "session_metadata": self.metadata(), "tool_calls": self.tool_calls(),
            "tool_results": self.tool_results(), "compaction": self.compaction(), "compaction_phases": self.compaction_phases(),
            "first_messages": self.first_user_message(), "ongoing": self.is_ongoing(), "skills": self.skills(), "deferred_tools": self.deferred_tools(),
        }
        for name, df in made.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in made]


def open_logs(spark: SparkSession, paths: str | list[str], persist: bool = True) -> SessionLogs:
    return SessionLogs(spark, paths, persist)


def is_subagent(key: Column) -> Column:
    return key.contains("/subagents/") | key.rlike(r"/agent-[^/]*\.jsonl$")
