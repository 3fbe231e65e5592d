"""Operator 5: line deduplication by two Bloom filters.

1. Each task hashes the keys of its documents' lines and sends on every hash once, with a mark if two of
   its own documents hold it. A key in a third of all documents is one hash per task here.
2. The hashes are dealt by their leading bits (the slice). Per slice one task fills two Bloom filters:
   of hashes seen once, and of hashes seen again while the first filter already held them.
   A filter can only err towards "seen", so the second one misses no repeated key.
3. The second filters, of ``MAX_FILTER_BITS`` bits in all at most, go to all workers. Only lines that
   they suspect are shuffled, by key, to count documents exactly and to choose the one that stays.
   Where the corpus outgrows the filters, more lines are suspected and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from logweave.llm.common import TEXT_ROWS, arrow_batches, columns_of, free_names, map_rows, mix64, partitions, quoted, text_slices

MIN_DOCS = 3
MIN_CHARS = 20
SLICES = 4096
MAX_FILTER_BITS = 1 << 30
BITS_PER_HASH = 16
PROBES = 4
FLUSH_AT = 1_000_000
COLD_ROWS = 64
SALTS = 64

SLICE_SCHEMA = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])
FILTER_SCHEMA = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without outer white space and with A-Z lower-cased, or None if that is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars):
        return None
    return key


def document_keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(x, min_chars) for x in text.split(b"\n")}
    keys.discard(None)
    return keys


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each hash its positions in a filter of ``bits`` (a power of two) bits."""
    a = mix64(hashes)
    b = (a >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


class Slice:
    """The two filters of one slice; sized by what it gets until it has reached its bound."""

    def __init__(self, most_bits: int):
        self.most_bits, self.rows, self.held, self.bits = most_bits, [], 0, 0

    def add(self, once: np.ndarray, again: np.ndarray) -> None:
        if self.bits:
            self.insert(once, again)
            return
        self.rows.append((once, again))
        self.held += len(once)
        if self.held * BITS_PER_HASH >= self.most_bits:
            self.settle()

    def settle(self) -> None:
        self.bits = min(self.most_bits, max(64, 1 << (self.held * BITS_PER_HASH - 1).bit_length()))
        self.first, self.second = np.zeros(self.bits, bool), np.zeros(self.bits, bool)
        for row in self.rows:
            self.insert(*row)
        self.rows = []

    def insert(self, once: np.ndarray, again: np.ndarray) -> None:
        where = _positions(once, self.bits)
        self.second[where[self.first[where].all(axis=1)]] = True
        self.first[where] = True
        self.second[_positions(again, self.bits)] = True

    def result(self) -> bytes:
        if not self.bits:
            self.settle()
        return np.packbits(self.second, bitorder="little").tobytes() if self.second.any() else b""


def _hash_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[int] = set()
        again: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            a, b = (np.sort(np.fromiter(x, np.uint64, len(x))) for x in (once, again))
            edges = np.arange(1, SLICES, dtype=np.uint64) << np.uint64(64 - SLICES.bit_length() + 1)
            parts = [(k, x, y) for k, (x, y) in enumerate(zip(np.split(a, np.searchsorted(a, edges)), np.split(b, np.searchsorted(b, edges)))) if len(x)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *(pa.array([p[i].tobytes() for p in parts], pa.binary()) for i in (1, 2))], schema=SLICE_SCHEMA)
            once.clear()
            again.clear()

        for batch in batches:
            for _, texts in text_slices(batch, 0):
                for text in texts:
                    found = {xxhash.xxh3_64_intdigest(k) for k in document_keys(text, min_chars)}
                    again.update(found & once)
                    once.update(found)
                if len(once) >= FLUSH_AT:
                    yield from flush()
        yield from flush()

    return run


def _build_filters(most_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, current = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([current.result()], pa.binary())], schema=FILTER_SCHEMA)

        for batch in batches:
            for k, once, again in zip(*(c.to_pylist() for c in batch.columns)):
                if k != number:
                    if current is not None:
                        yield out()
                    number, current = k, Slice(most_bits)
                current.add(np.frombuffer(once, np.uint64), np.frombuffer(again, np.uint64))
        if current is not None:
            yield out()

    return run


class Suspects:
    """The second filters of all slices, for lookups of many hashes at once."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.offset, self.size = np.zeros(SLICES, np.int64), np.zeros(SLICES, np.int64)
        at = 0
        for k, bits in rows:
            self.offset[k], self.size[k] = at, 8 * len(bits)
            at += len(bits)
        self.bytes = np.frombuffer(b"".join(bits for _, bits in rows) or b"\0", np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        k = (hashes >> np.uint64(64 - SLICES.bit_length() + 1)).astype(np.int64)
        size = self.size[k]
        a = mix64(hashes)
        b = (a >> np.uint64(32)) | np.uint64(1)
        hit = size > 0
        mask = np.maximum(size - 1, 0).astype(np.uint64)
        for j in range(PROBES):
            where = ((a + b * np.uint64(j)) & mask).astype(np.int64)
            byte = np.minimum(self.offset[k] + (where >> 3), len(self.bytes) - 1)
            hit &= (self.bytes[byte] >> (where & 7).astype(np.uint8)) & 1 > 0
        return hit


def suspected_keys(docs: DataFrame, min_chars: int, max_filter_bits: int) -> DataFrame:
    """(doc_id, key, salt) of the lines whose key may stand in more than one document.

    salt is 0 for the first ``COLD_ROWS`` rows of a key in a task, and then goes round: so a key of fewer rows in
    all has salt 0 alone, and the rows of a hot one are dealt to ``SALTS`` parts.
    """
    spark = docs.sparkSession
    arrow_batches(spark, TEXT_ROWS)
    rows = (
        docs.select("text")
        .mapInArrow(_hash_rows(min_chars), "slice int, once binary, again binary")
        .repartition(partitions(spark), "slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_build_filters(max_filter_bits // SLICES), "slice int, bits binary")
        .where(F.length("bits") > 0)
        .collect()  # max_filter_bits in all at most
    )
    shared = spark.sparkContext.broadcast(sorted((r["slice"], bytes(r["bits"])) for r in rows))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspects = Suspects(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("salt", pa.int32())])
        met: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in text_slices(batch, 1):
                owners, keys = [], []
                for k, text in enumerate(texts, at):
                    found = document_keys(text, min_chars)
                    keys += found
                    owners += [ids[k]] * len(found)
                if keys:
                    hit = suspects.test(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                    where = np.flatnonzero(hit)
                    some = [keys[i] for i in where]
                    salts = []
                    for key in some:
                        n = met[key] = met.get(key, -1) + 1
                        salts.append(n // COLD_ROWS % SALTS)
                    yield pa.RecordBatch.from_arrays([pa.array([owners[i] for i in where], pa.int64()), pa.array(some, pa.binary()), pa.array(salts, pa.int32())], schema=schema)
                if len(met) > FLUSH_AT:
                    met.clear()

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(probe, "doc_id long, key binary, salt int")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """Drop lines that stand in ``min_docs`` (2 at least) or more documents, except in the largest id that holds them.

    Returns the rows of ``docs`` with all their columns, the text without the dropped lines, and n_lines
    (before) and n_dropped; columns of these two names in ``docs`` are replaced. A null or empty text is one
    empty line and comes out empty. Rows with a null id keep all lines and count nowhere; rows that repeat an
    id are one document when documents are counted, and each loses the lines. An empty table stays empty.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least")
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    own_lost, lost_id = free_names(docs, "lost", "lost_id")
    suspects = suspected_keys(plain, min_chars, max_filter_bits)
    # a document's own keys are distinct, so only repeated ids make equal rows
    holders = suspects.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    repeated = holders.groupBy("key").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("doc_id").alias("stays")).where(F.col("n") >= min_docs)
    salts = F.when(F.col("rows") > COLD_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lost = suspects.join(repeated.select("key", "stays", F.explode(salts).alias("salt")), ["key", "salt"]).where(F.col("doc_id") != F.col("stays")).groupBy("doc_id").agg(F.collect_set("key").alias(own_lost)).withColumnRenamed("doc_id", lost_id)
    kept = docs.select(*columns_of(docs, "n_lines", "n_dropped"))
    joined = kept.join(lost, F.col(quoted(id_col)).cast("long") == F.col(lost_id), "left").select(*columns_of(kept), F.col(own_lost))
    return _without_lost(joined, text_col, kept.schema.fields, min_chars)


def _without_lost(joined: DataFrame, text_col: str, fields: list[StructField], min_chars: int) -> DataFrame:
    """``joined`` has the fields, and the lost keys as its last column."""
    where = [f.name.lower() for f in fields].index(text_col.lower())

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            lost = batch.column(len(fields)).to_pylist()
            for at, texts in text_slices(batch, where, 8 << 20):
                kept, before, dropped = [], [], []
                for k, text in enumerate(texts, at):
                    lines = text.split(b"\n")
                    before.append(len(lines))
                    if lost[k]:
                        gone = set(lost[k])
                        lines = [x for x in lines if line_key(x, min_chars) not in gone]
                        text = b"\n".join(lines)
                    kept.append(text)
                    dropped.append(before[-1] - len(lines))
                columns = [c.slice(at, len(texts)) for c in batch.columns[: len(fields)]]
                columns[where] = pa.array(kept, pa.binary()).cast(pa.string())
                yield [*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]

    return map_rows(joined, drop, [*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])


def kept_digest(deduped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return deduped.select(F.col(quoted(id_col)).alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col(quoted(text_col)).cast("binary"), 256).alias("kept_sha256"))
