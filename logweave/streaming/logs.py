"""Log files as a stream.

Files of the folder are taken as they are when they are found, so writers should put finished segments there.
State is bounded by watermarks where a window allows it; :func:`latest_usage` keeps every request, as late lines of a
request replace earlier ones, and :func:`recent_usage` only those of windows that are open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.scalars import at, file_key, strict_json, strict_number, strict_string, trim_all, truthy
from logweave.sources.jsonl import accepted, configure


def stream_entries(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(session_key, ord, type, request_id, ts, tokens...) of the lines of new files under ``path`` (a glob).

    A file is read whole, as the order of its lines is needed and a stream has no other; files are segments of
    logs, some MB each. ord is (time of the file, number of the line).
    """
    files = configure(spark).readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    lines = files.select(file_key(F.col("_metadata.file_path")).alias("session_key"), F.col("_metadata.file_modification_time").alias("at"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("n", "line"))
    raw = lines.select("session_key", F.struct("at", "n").alias("ord"), strict_json(trim_all(F.col("line"))).alias("raw"))
    v = F.col("raw")
    usage = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_creation_tokens": "cache_creation_input_tokens"}
    return raw.where(v.isNotNull() & accepted(v)).select(
        "session_key",
        "ord",
        strict_string(v, "$.type").alias("type"),
        F.when(truthy(at(v, "$.requestId")), strict_string(v, "$.requestId")).alias("request_id"),
        F.try_to_timestamp(strict_string(v, "$.timestamp")).alias("ts"),
        *(F.coalesce(strict_number(v, f"$.message.usage.{p}"), F.lit(0)).alias(n) for n, p in usage.items()),
    )


def latest_usage(entries: DataFrame) -> DataFrame:
    """Usage of each request's last line so far (output mode update or complete); requests are the state."""
    tokens = F.struct("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    asked = entries.where((F.col("type") == "assistant") & F.col("request_id").isNotNull())
    return asked.groupBy("session_key", "request_id").agg(F.max_by(tokens, "ord").alias("u")).select("session_key", "request_id", "u.*")


def recent_usage(entries: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Usage of each request's last line within a window of the entries' own time, final once the watermark has passed it.

    Unlike :func:`latest_usage` this lets go of its state: lines of a request that fall into several windows give a
    row in each, and lines without a time, or later than the watermark, none.
    """
    tokens = F.struct("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    asked = entries.where((F.col("type") == "assistant") & F.col("request_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    last = asked.groupBy(F.window("ts", window), "session_key", "request_id").agg(F.max_by(tokens, "ord").alias("u"))
    return last.select("window.start", "window.end", "session_key", "request_id", "u.*")


def throughput(entries: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Entries and tokens per window of the entries' own time; windows are final once the watermark has passed them."""
    timed = entries.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return timed.groupBy(F.window("ts", window)).agg(F.count("*").alias("entries"), F.sum(total).alias("tokens")).select("window.start", "window.end", "entries", "tokens")
