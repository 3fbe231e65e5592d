"""The driver's tables as session logs: projections to the columns that the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.jsonl import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k, the number in props."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user, one entry per event: clicks are assistant entries with usage, views and signups user
    entries (signups compaction markers), errors attachments, purchases system entries."""
    kind = F.col("event_type")
    click = kind == "click"
    k = F.col("k")
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session_key"),
        F.col("event_id").alias("line_no"),
        F.when(click, "assistant").when(kind.isin("view", "signup"), "user").when(kind == "error", "attachment").otherwise("system").alias("type"),
        F.when(click, (k % 10).cast("string")).alias("request_key"),
        (k % 11 == 0).alias("is_sidechain"),
        F.when(k % 13 == 0, "<synthetic>").otherwise("m").alias("model"),
        (kind == "signup").alias("is_compact"),
        F.when(click, F.floor("value").cast("bigint")).alias("input_tokens"),
        F.when(click, k % 7).alias("output_tokens"),
        F.when(click, k).alias("cache_read_tokens"),
        F.lit(None).cast("bigint").alias("cache_creation_tokens"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session_id"),
        F.when(k % 4 == 0, F.concat(F.lit("v"), (k % 9).cast("string"))).alias("version"),
        F.when(k % 5 == 0, F.concat(F.lit("b"), (k % 8).cast("string"))).alias("git_branch"),
        F.when(k % 6 == 0, F.lit("")).alias("cwd"),
        F.when(k % 2 == 0, F.concat(F.lit("p"), (k % 5).cast("string"))).alias("permission_mode"),
        "k",
        kind.alias("event_type"),
    )


def event_blocks(entries: DataFrame) -> DataFrame:
    """The same entries with one content block each: clicks use a tool, views bring a result."""
    k = F.col("k")
    use = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 4 == 0, "Agent").when(k % 4 == 1, "Task").otherwise("Bash").alias("name"), F.struct(k.alias("k")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), k.cast("string")).alias("tool_use_id"), F.lit("out").alias("content"), F.when(k % 3 == 0, True).alias("is_error"))
    block = F.when(F.col("event_type") == "click", F.to_json(use)).when(F.col("event_type") == "view", F.to_json(result))
    return entries.select("session_key", "line_no", "type", F.lit(None).cast("string").alias("uuid"), F.when(block.isNotNull(), F.array(F.parse_json(block))).alias("content_blocks"))


def event_activity(entries: DataFrame) -> DataFrame:
    """Events of activity: clicks open, end or shut down by k; views bring results for ids."""
    k, kind = F.col("k"), F.col("event_type")
    what = F.when((kind == "click") & (k % 5 == 0), "ending").when((kind == "click") & (k % 5 == 1), "shutdown").when(kind == "click", "open").when(kind == "view", "result")
    return entries.select("session_key", "line_no", F.lit(0).alias("block_no"), what.alias("kind"), (k % 20).cast("string").alias("tool_id")).where(F.col("kind").isNotNull())


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per conversation, one entry per turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_key"), F.col("turn").alias("line_no"), F.col("role").alias("type"), "text", F.concat_ws("-", "conv_id", "turn").alias("timestamp"), "conv_id", "turn"
    )


def json_text(*parts: str | Column) -> Column:
    """A JSON text from literal parts and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def event_json(rows: DataFrame) -> DataFrame:
    """(session_key, line_no, k, raw): each event as a JSON object whose fields depend on k."""
    k = F.col("k")
    odd = F.col("event_id") % 2 == 1
    opt = F.when(k % 3 == 0, ',"opt":true').when(k % 3 == 1, ',"opt":"x"').otherwise("")
    extra = F.when(odd & (k % 10 == 0), ',"extra":{"deep":[{"n":1},null]}').when(~odd & (k % 10 == 0), ',"old":null').otherwise("")
    number = F.when(odd & (k % 7 == 0), ',"size":"big"').otherwise(',"size":1')
    text = json_text('{"type":"', F.col("event_type"), '","user":{"id":', F.col("user_id"), '},"tags":[', k, ',"a",null]', opt, extra, number, "}")
    return once(rows.select(F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("line_no"), "k", text.alias("text")), F.parse_json("text")).drop("text")


def event_log_lines(rows: DataFrame) -> DataFrame:
    """(session_key, file_size, line_no, nonblank_no, raw): log lines some of which lack fields that operators need."""
    k, kind = F.col("k"), F.col("event_type")
    usage = F.when(k % 6 == 0, "").otherwise(',"usage":{"input_tokens":1}')
    content = F.when(k % 5 == 0, '"content":null').otherwise('"content":[{"type":"text","text":"x"}]')
    message = F.when(k % 9 == 0, "").otherwise(json_text(',"message":{', content, usage, "}"))
    entry = F.when(kind == "click", "assistant").when(kind == "view", "user").when(kind == "error", "attachment").when(kind == "purchase", "file-history-snapshot").otherwise("system")
    body = F.when(kind.isin("click", "view"), message).when((kind == "error") & (k % 4 == 0), ',"attachment":{"type":"other"}').when((kind == "purchase") & (k % 4 > 0), ',"snapshot":{}').otherwise("")
    text = json_text('{"type":"', entry, '"', body, "}")
    lines = rows.select(F.col("user_id").cast("string").alias("session_key"), F.lit(0).cast("bigint").alias("file_size"), F.col("event_id").alias("line_no"), F.col("event_id").alias("nonblank_no"), text.alias("text"))
    return once(lines, F.parse_json("text")).drop("text")
