"""Tool results that were too large and lie in files of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.scalars import file_key, strict_json, trim_right
from logweave.sources.jsonl import configure

# How the wrapper of such a result begins (groups are size and path) and ends; the preview is between.
OPENING = r"^<persisted-output>\nOutput too large \(([^)]+)\)\. Full output saved to: ([^\n]+)\n\nPreview \(first [^)]+\):\n"
CLOSING = "</persisted-output>"


def parse_wrapper(content: Column) -> Column:
    """struct(size_label, file_path, preview) of a wrapper text, null for any other.

    Patterns see the first lines alone, however long the preview.
    """
    whole, size, path = (F.regexp_extract(content, OPENING, k) for k in range(3))
    rest = F.substr(content, F.length(whole) + 1)
    bare = trim_right(rest)
    inner = F.substr(bare, F.lit(1), F.length(bare) - len(CLOSING))
    return F.when(content.rlike(OPENING), F.struct(size.alias("size_label"), path.alias("file_path"), F.when(bare.endswith(CLOSING), trim_right(inner)).otherwise(bare).alias("preview")))


def parse_persisted(rows: DataFrame, column: str = "content") -> DataFrame:
    """The rows whose text is a wrapper, with size_label, file_path and preview."""
    parsed = rows.withColumn("__p", parse_wrapper(F.col(column))).where(F.col("__p").isNotNull())
    return parsed.select(*(c for c in rows.columns if c != column), "__p.*")


def load_persisted(refs: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """``refs`` (file_path) with text, blocks (VARIANT, of .json files) and found, joined to ``files`` (file_path, text).

    With ``strict`` a missing file or malformed JSON is an error.
    """
    joined = refs.join(files.select("file_path", "text", F.lit(True).alias("__found")), "file_path", "left")
    is_json = F.col("file_path").endswith(".json")
    blocks = F.when(is_json, strict_json(F.trim(F.col("text"))))
    out = joined.withColumn("found", F.coalesce("__found", F.lit(False))).withColumn("blocks", blocks).drop("__found")
    if strict:
        bad = ~F.col("found") | (is_json & F.col("blocks").isNull())
        out = out.withColumn("found", F.when(bad, F.raise_error(F.concat(F.lit("cannot load "), F.col("file_path"))).cast("boolean")).otherwise(F.col("found")))
    return out


def read_spilled(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, text) of spilled files, whole; the path without a ``file:`` scheme, as wrappers spell it."""
    configure(spark)
    text = spark.read.text(paths, wholetext=True)
    return text.select(F.regexp_replace(file_key(F.col("_metadata.file_path")), "^file:", "").alias("file_path"), F.col("value").alias("text"))
