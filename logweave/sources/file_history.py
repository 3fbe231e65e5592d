"""File versions: snapshots in the logs, joined to the blobs of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.scalars import base_name, dir_name, strict_number, strict_string
from logweave.sources.files import default_dir, exists, listing

BLOB_DDL = "session_id string, backup_file_name string, blob_path string, size long"


def find_history_dir(spark: SparkSession, session_id: str, base: str | None = None) -> str | None:
    path = f"{base or default_dir('file-history')}/{session_id}".rstrip("/")
    return path if exists(spark, path) else None


def list_blobs(spark: SparkSession, base: str | None = None, session_id: str | None = None) -> DataFrame:
    """(session_id, backup_file_name, blob_path, size) of the files whose names hold ``@v``; contents are not read."""
    base = base or default_dir("file-history")
    folders = [session_id] if session_id is not None else [n for n, _, is_dir, _ in listing(spark, base) if is_dir]
    paths = [f"{base}/{f}" for f in folders if exists(spark, f"{base}/{f}", folder=True)]
    if not paths:
        return spark.createDataFrame([], BLOB_DDL)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*@v*").load(paths)
    return found.select(base_name(dir_name(F.col("path"))).alias("session_id"), base_name(F.col("path")).alias("backup_file_name"), F.col("path").alias("blob_path"), F.col("length").alias("size"))


def read_blobs(spark: SparkSession, versions: DataFrame, base: str) -> DataFrame:
    """``versions`` with their blob's text as ``content``; null where there is no blob or it cannot be read.

    Only the folders of sessions that have a version with a blob are read (their names reach the driver).
    Bytes that are no UTF-8 become U+FFFD.
    """
    named = versions.where(F.col("blob_path").isNotNull()).select(base_name(dir_name(F.col("blob_path"))).alias("folder")).distinct()
    folders = sorted(f"{base}/{r['folder']}" for r in named.collect())
    paths = [f for f in folders if exists(spark, f, folder=True)]
    if not paths:
        return versions.withColumn("content", F.lit(None).cast("string"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*@v*").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(paths)
    text = files.select(F.col("path").alias("blob_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return versions.join(text, "blob_path", "left")


def snapshot_rows(entries: DataFrame) -> DataFrame:
    """(session_key, line_no, file_path, version, backup_time, backup_file_name) of the snapshots' maps."""
    rows = entries.where(F.col("type") == "file-history-snapshot")
    backups = F.try_variant_get(F.col("raw"), "$.snapshot.trackedFileBackups", "map<string,variant>")
    b = F.col("b")
    exploded = rows.select("session_key", "line_no", F.explode(backups).alias("file_path", "b"))
    return exploded.select("session_key", "line_no", "file_path", strict_number(b, "$.version").alias("version"), strict_string(b, "$.backupTime").alias("backup_time"), strict_string(b, "$.backupFileName").alias("backup_file_name"))


def latest_versions(rows: DataFrame) -> DataFrame:
    """The last observation of each (session_key, file_path, version), by a partial aggregate."""
    last = F.max_by(F.struct("backup_time", "backup_file_name"), "line_no").alias("l")
    return rows.groupBy("session_key", "file_path", "version").agg(last).select("session_key", "file_path", "version", "l.backup_time", "l.backup_file_name")


def file_history(versions: DataFrame, sessions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Versions with session_id (from ``sessions``: session_key, session_id), blob_path and size, null without a blob."""
    named = versions.join(sessions.select("session_key", F.coalesce("session_id", F.lit("")).alias("session_id")), "session_key", "left")
    return named.join(blobs, ["session_id", "backup_file_name"], "left")


def history_order() -> list:
    return [F.collate(F.col("file_path"), "UNICODE"), F.col("version")]


def orphan_blobs(blobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Blobs that no snapshot names; ``versions`` has session_id."""
    return blobs.join(versions.where(F.col("backup_file_name").isNotNull()), ["session_id", "backup_file_name"], "left_anti")


def version_pairs(versions: DataFrame) -> DataFrame:
    """Each version of a file with the one before it (null for the first)."""
    order = Window.partitionBy("session_key", "file_path").orderBy("version")
    return versions.withColumn("previous_version", F.lag("version").over(order)).withColumn("previous_backup", F.lag("backup_file_name").over(order))
