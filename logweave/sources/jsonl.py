"""Scans of JSON-lines logs: one row per line, with its place in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.scalars import at, file_key, kind_of, strict_json, strict_number, strict_string, trim_all, truthy

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """The session settings that the readers rely on: UTC, and the last of repeated JSON keys holds."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_key, file_size, block, mid, line): block is the start of the split, mid the order in it."""
    return (
        spark.read.text(paths)
        .select(
            file_key(F.col("_metadata.file_path")).alias("session_key"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("mid"),
            F.col("value").alias("line"),
        )
        .withColumn("line", trim_all(F.col("line")))
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_key, file_size, line_no, nonblank_no, line) of every line of the files.

    line_no counts lines from 0; nonblank_no counts those that are not blank from 1. Lines are numbered by
    the start of their split and their order in it, in one window per file, which the exchange on session_key
    that later steps need serves as well.
    """
    order = Window.partitionBy("session_key").orderBy("block", "mid")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _raw_lines(spark, paths).select(
        "session_key",
        "file_size",
        (F.row_number().over(order) - 1).cast("long").alias("line_no"),
        F.sum((F.col("line") != "").cast("long")).over(running).alias("nonblank_no"),
        "line",
    )


def _least_lines(lines: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each file, with nonblank_no from 1.

    Each task keeps that many of its rows of a file before they are exchanged, so what is exchanged is in
    proportion to files, not to their sizes.
    """
    order = Window.partitionBy("session_key").orderBy("block", "mid")
    return lines.withColumn("nonblank_no", F.row_number().over(order)).where(F.col("nonblank_no") <= most).withColumn("nonblank_no", F.col("nonblank_no").cast("long"))


def head_lines(spark: SparkSession, paths: str | list[str], lines: int) -> DataFrame:
    """(session_key, file_size, line_no, nonblank_no, line) of the first ``lines`` lines of each file that are not blank, one at least.

    Here line_no counts these lines alone, from 0.
    """
    least = _least_lines(_raw_lines(spark, paths).where(F.col("line") != ""), max(lines, 1))
    return least.select("session_key", "file_size", (F.col("nonblank_no") - 1).alias("line_no"), "nonblank_no", "line")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines that are JSON, as ``raw`` VARIANT; blank and malformed ones are left out."""
    return once(lines, strict_json(F.col("line"))).drop("line")


def once(rows: DataFrame, raw: Column) -> DataFrame:
    """``rows`` with the column ``raw``, without those where it is null.

    The generator keeps later predicates from being moved below the parse, where each would parse again.
    """
    return rows.select("*", F.explode(F.array(raw)).alias("raw")).where(F.col("raw").isNotNull())


def accepted(raw: Column) -> Column:
    """A line is an entry if it is an object whose ``type`` is a string."""
    return (kind_of(raw) == "object") & strict_string(raw, "$.type").isNotNull()


# Column of an entry and the field it comes from, for texts, flags and numbers of usage.
TEXTS = {
    "type": "type", "uuid": "uuid", "parent_uuid": "parentUuid", "session_id": "sessionId", "version": "version",
    "git_branch": "gitBranch", "cwd": "cwd", "timestamp": "timestamp", "permission_mode": "permissionMode",
}
FLAGS = {"is_sidechain": "isSidechain", "is_meta": "isMeta", "is_compact": "isCompactSummary"}
USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_creation_tokens": "cache_creation_input_tokens"}


def fields(value: Column, names: list[str]) -> Column:
    """The named fields of an object, each as VARIANT, by one pass over it; null where it is no object."""
    return F.try_variant_get(value, "$", "struct<" + ", ".join(f"{n}: variant" for n in names) + ">")


def canonical(rows: DataFrame) -> DataFrame:
    """Entries: the columns that the operators use, beside ``raw``."""
    place = [F.col(c) for c in ("session_key", "file_size", "line_no", "nonblank_no", "raw")]
    opened = rows.select(*place, fields(F.col("raw"), [*TEXTS.values(), *FLAGS.values(), "requestId", "toolUseResult", "attachment", "message"]).alias("e"))
    e, m = F.col("e"), F.col("m")
    inner = opened.where(strict_string(e["type"]).isNotNull()).select(*place, "e", fields(e["message"], ["model", "stop_reason", "content", "usage"]).alias("m"), strict_string(at(e["attachment"], "$.type")).alias("attachment_type"))
    request, content = e["requestId"], m["content"]
    return inner.select(
        *place,
        *(strict_string(e[path]).alias(name) for name, path in TEXTS.items()),
        "attachment_type",
        strict_string(m["model"]).alias("model"),
        strict_string(m["stop_reason"]).alias("stop_reason"),
        strict_string(content).alias("content_text"),
        # any truthy request id groups lines; the kind keeps 5 and "5" apart
        F.when(truthy(request) & ~kind_of(request).isin("object", "array"), F.concat_ws(":", kind_of(request), request.cast("string"))).alias("request_key"),
        *(truthy(e[path]).alias(name) for name, path in FLAGS.items()),
        *(strict_number(m["usage"], f"$.{path}").alias(name) for name, path in USAGE.items()),
        F.try_variant_get(content, "$", "array<variant>").alias("content_blocks"),
        e["toolUseResult"].alias("tool_use_result"),
        e["attachment"].alias("attachment"),
        F.unix_millis(F.try_to_timestamp(strict_string(e["timestamp"]))).alias("ts_ms"),
    )


def read_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All entries of the files, before any deduplication."""
    return canonical(parsed(read_lines(configure(spark), paths)))


def head(rows: DataFrame, lines: int) -> DataFrame:
    """The rows of each file's first ``lines`` non-blank lines, malformed ones counted; one at least."""
    return rows.where(F.col("nonblank_no") <= max(lines, 1))


def read_head(spark: SparkSession, paths: str | list[str], lines: int) -> DataFrame:
    """The entries among the first ``lines`` non-blank lines of each file, as :func:`head` gives them of all entries."""
    return canonical(parsed(head_lines(configure(spark), paths, lines)))


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_key, first_session_id): the session id of each file's very first line, whatever value it is.

    The id is given with its kind, so that equality is strict; files without one are left out. Only rows of a
    file's first split are looked at, of which each task sends on one.
    """
    first = _least_lines(_raw_lines(configure(spark), paths).where(F.col("block") == 0), 1)
    value = at(strict_json(F.col("line")), "$.sessionId")
    found = first.select("session_key", F.when(kind_of(value) != "null", F.concat_ws(":", kind_of(value), value.cast("string"))).alias("first_session_id"))
    return found.where(F.col("first_session_id").isNotNull())
