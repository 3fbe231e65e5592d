"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from logweave.plans.lineage import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TEXT_ROWS, SMALL_ROWS = 1000, 10_000  # rows of a batch with texts, without


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table stays for the plans that read it and is deleted when the application ends. The shuffles that made it go
    as soon as it is there: else they lie on disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`; only for tables that no lazy plan still reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        break


def quoted(name: str) -> str:
    """A column's name as an expression spells it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df`` by name, but for those named (in any case)."""
    gone = {c.lower() for c in without}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as make it no column of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame, made: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(docs)`` with the columns of ``docs`` alone; those that ``run`` would replace (named in ``made``) come back as they were."""
    clash = [c for c in docs.columns if c.lower() in {m.lower() for m in made}]
    other = dict(zip(clash, free_names(docs, *(f"{c}_" for c in clash))))
    out = run(docs.toDF(*(other.get(c, c) for c in docs.columns)))
    return out.select(*(F.col(quoted(other.get(c, c))).alias(c) for c in docs.columns))


def map_rows(df: DataFrame, run, fields: list[StructField]) -> DataFrame:
    """``df.mapInArrow(run)`` with the result's fields, whatever signs the names hold: ``run`` meets numbered columns.

    What it yields are arrays in the order of the fields.
    """
    schema = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(numbered, schema).toDF(*(f.name for f in fields))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_batches(spark: SparkSession, rows: int) -> None:
    """From now on the session hands ``rows`` rows at once to Python, and reads no more at once from Parquet.

    Batches of whole texts must be small: they lie in the JVM and in the worker at the same time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(min(rows, 4096)))


def id_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id has no bucket."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def text_slices(batch: pa.RecordBatch, k: int, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in runs of about ``limit`` bytes, so that what is made of them stays small."""
    column = batch.column(k).cast(pa.binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    run = np.cumsum(sizes) // limit
    for at in np.flatnonzero(np.diff(run, prepend=-1)):
        end = int(np.searchsorted(run, run[at], side="right"))
        yield int(at), [b"" if x is None else x for x in column.slice(int(at), end - int(at)).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (xor, shift, multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
