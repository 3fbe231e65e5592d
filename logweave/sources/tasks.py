"""The task store: one folder per session, one JSON file per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.scalars import at, base_name, dir_name, file_key, kind_of, strict_json, strict_string
from logweave.sources.files import default_dir, exists, listing
from logweave.sources.jsonl import configure, once

# Fixed values.
STATUSES = ["pending", "in_progress", "completed"]
TASK_DDL = "session_id string, file_stem string, id string, subject string, description string, status string, blocks array<string>, blocked_by array<string>, active_form string, owner string, metadata variant"


def find_tasks_dir(spark: SparkSession, session_id: str, base: str | None = None) -> str | None:
    """The session's folder if there is one."""
    folder = f"{base or default_dir('tasks')}/{session_id}"
    return folder if exists(spark, folder, folder=True) else None


def list_task_sessions(spark: SparkSession, base: str | None = None) -> DataFrame:
    """(session_id) of the folders that aren't hidden, in code point order."""
    names = [(n,) for n, _, is_dir, _ in listing(spark, base or default_dir("tasks")) if is_dir and not n.startswith(".")]
    return spark.createDataFrame(names, "session_id string").orderBy("session_id")


def _strings(value: Column) -> Column:
    """An array whose every element is a string, else null."""
    items = F.when(kind_of(value) == "array", F.try_variant_get(value, "$", "array<variant>"))
    return F.when(F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


def valid_tasks(files: DataFrame) -> DataFrame:
    """Tasks of (session_id, file_stem, raw): those with all required fields of the right kind; optional ones only if they fit."""
    raw, files = F.col("raw"), once(files.withColumnRenamed("raw", "__raw"), F.col("__raw"))
    metadata = at(raw, "$.metadata")
    rows = files.select(
        "session_id",
        "file_stem",
        *(strict_string(raw, f"$.{name}").alias(name) for name in ("id", "subject", "description", "status")),
        _strings(at(raw, "$.blocks")).alias("blocks"),
        _strings(at(raw, "$.blockedBy")).alias("blocked_by"),
        strict_string(raw, "$.activeForm").alias("active_form"),
        strict_string(raw, "$.owner").alias("owner"),
        F.when(kind_of(metadata) == "object", metadata).alias("metadata"),
    )
    return well_formed(rows)


def well_formed(rows: DataFrame) -> DataFrame:
    required = [F.col(c).isNotNull() for c in ("id", "subject", "description", "blocks", "blocked_by")]
    good = F.col("status").isin(STATUSES)
    for r in required:
        good = good & r
    return rows.where(good)


def task_order(column: str = "id") -> list[Column]:
    """Numeric ids by number, then all others by name."""
    number = F.when(F.trim(F.col(column)) == "", 0.0).otherwise(F.try_cast(F.col(column), "double") if hasattr(F, "try_cast") else F.col(column).try_cast("double"))
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return [F.asc_nulls_last(finite), F.collate(F.col(column), "UNICODE"), F.col(column)]


def read_tasks(spark: SparkSession, base: str | None = None, session_id: str | None = None) -> DataFrame:
    """All valid tasks of one session or, without ``session_id``, of all; unreadable and malformed files are left out.

    Hidden files (names that start with a dot or underscore) are not read.
    """
    base = base or default_dir("tasks")
    if not exists(spark, base, folder=True) or (session_id is not None and find_tasks_dir(spark, session_id, base) is None):
        return spark.createDataFrame([], TASK_DDL)
    folders = [session_id] if session_id is not None else [n for n, _, is_dir, _ in listing(spark, base) if is_dir and not n.startswith(".")]
    return _read_files(spark, [f"{base}/{f}" for f in folders])


def _read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The valid tasks of the files, or of those in the folders, named."""
    if not paths:
        return spark.createDataFrame([], TASK_DDL)
    text = configure(spark).read.option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    path = file_key(F.col("_metadata.file_path"))
    name = base_name(path)
    files = text.select(base_name(dir_name(path)).alias("session_id"), F.left(name, F.length(name) - 5).alias("file_stem"), strict_json(F.trim(F.col("value"))).alias("raw"))
    return valid_tasks(files)


def list_tasks(spark: SparkSession, session_id: str, base: str | None = None) -> DataFrame:
    """A session's tasks in order of their ids."""
    return read_tasks(spark, base, session_id).orderBy(*task_order())


def read_task(spark: SparkSession, session_id: str, task_id: str, base: str | None = None) -> DataFrame:
    """The task of the file ``<task_id>.json``, or no row; no other file is read."""
    path = f"{base or default_dir('tasks')}/{session_id}/{task_id}.json"
    return _read_files(spark, [path] if exists(spark, path) else [])


def session_tasks(sessions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sessions (with session_id) and their tasks; sessions without any keep a row."""
    return sessions.join(tasks, "session_id", "left")
