"""Operator 8: nearest neighbours by vantage-point trees, one tree per shard.

Vectors are dealt to shards by a hash of their ids; each shard of about ``SHARD_ROWS`` rows becomes one tree, once.
Only queries travel: every query visits every shard. A shard's queries come behind its vectors and are searched
block by block as they stream by, so a task holds one shard and one block; the k best of all shards are merged per
query.

A subtree is skipped if the triangle inequality keeps it farther than the k-th best found so far; the bound
is multiplied by ``factor``: 1 skips only what cannot matter (exact), more skips sooner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from logweave.llm.common import TEXT_ROWS, arrow_batches, partitions, quoted

K = 10
SHARD_ROWS = 8192
LEAF_ROWS = 256
BLOCK_QUERIES = 1024
FACTOR = 1.0
#: Slack of a bound against rounding: distances are sums of about a hundred rounded squares.
ROUNDING = 1e-9

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class VPTree:
    """A vantage-point tree over float64 rows; leaves hold up to ``leaf_rows`` rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.leaf_rows = ids[order], rows[order], leaf_rows
        self.root = self.build(np.arange(len(ids)))

    def build(self, at: np.ndarray) -> tuple:
        if len(at) <= self.leaf_rows:
            return (at,)
        spread = np.linalg.norm(self.rows[at] - self.rows[at[0]], axis=1)
        vantage = at[int(np.argmax(spread))]  # a far point separates better than a central one
        d = np.linalg.norm(self.rows[at] - self.rows[vantage], axis=1)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            inside = d < radius
        if not inside.any():  # all at one distance: nothing to split by
            return (at,)
        near, far = d[inside], d[~inside]
        return vantage, self.build(at[inside]), self.build(at[~inside]), float(near.max()), float(far.min()), float(far.max())

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """Per query the positions of its k nearest rows (-1: none) and their distances; a query's own id is left out."""
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), -1, np.int64)

        def take(on: np.ndarray, at: np.ndarray) -> None:
            step = max(1, (1 << 20) // max(1, len(at) * queries.shape[1]))
            for s in range(0, len(on), step):
                q = on[s : s + step]
                d = np.sqrt(((queries[q][:, None, :] - self.rows[at][None, :, :]) ** 2).sum(axis=2))
                d[query_ids[q][:, None] == self.ids[at][None, :]] = np.inf
                every, names = np.concatenate([best[q], d], axis=1), np.concatenate([who[q], np.broadcast_to(at, d.shape)], axis=1)
                pick = np.lexsort((names, every), axis=1)[:, :k]  # ties to the smaller id: rows are sorted by id
                best[q], who[q] = np.take_along_axis(every, pick, 1), np.take_along_axis(names, pick, 1)
            who[~np.isfinite(best)] = -1

        def measured(q: int) -> np.ndarray:
            """The distances found, summed component by component."""
            found = self.rows[who[q][who[q] >= 0]]
            return np.sqrt(np.cumsum((queries[q] - found) ** 2, axis=1)[:, -1]) if len(found) else np.zeros(0)

        def visit(node: tuple, on: np.ndarray) -> None:
            if not len(on):
                return
            if len(node) == 1:
                take(on, node[0])
                return
            vantage, inner, outer, near_max, far_min, far_max = node
            d = np.linalg.norm(queries[on] - self.rows[vantage], axis=1)
            first_in = d <= (near_max + far_min) / 2
            visit(inner, on[first_in])
            visit(outer, on[~first_in])
            slack = ROUNDING * (1 + d)
            reach = best[:, -1]
            to_outer = first_in & ~(factor * np.maximum(far_min - d, d - far_max) > reach[on] + slack)
            to_inner = ~first_in & ~(factor * (d - near_max) > reach[on] + slack)
            visit(outer, on[to_outer])
            visit(inner, on[to_inner])

        if len(self.ids):
            visit(self.root, np.arange(len(queries)))
        for q in range(len(queries)):
            best[q, who[q] >= 0] = measured(q)
        return who, best


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v) of the rows that take part: an id, and a vector of finite components that are not all zero.

    Floats stay floats on their way (half the bytes); other numbers become doubles.
    """
    kind = vectors.select(F.col(quoted(vector_col))).schema[0].dataType
    plain = F.col(quoted(vector_col)) if kind == ArrayType(FloatType(), kind.containsNull) else F.col(quoted(vector_col)).cast("array<double>")
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.size(plain).alias("dim"), plain.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _search(k: int, factor: float, block_queries: int):
    """Of rows (dim, shard, kind, vec_id, v), sorted: a shard's vectors (kind 0), then its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c)) for c in range(3)])
            names = np.asarray(batch.column(3))
            for a in np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0).any(axis=0)])[: batch.num_rows]):
                same = (place == place[:, a : a + 1]).all(axis=0)
                b = int(np.flatnonzero(same)[-1]) + 1
                if tuple(place[:2, a]) != shard:
                    shard, held, tree = tuple(place[:2, a]), [], None
                rows = np.asarray(batch.column(4).slice(a, b - a).flatten(), dtype=np.float64).reshape(b - a, -1)
                if place[2, a] == 0:
                    held.append((names[a:b], rows))
                    continue
                if held:
                    tree, held = VPTree(*map(np.concatenate, zip(*held))), []
                for s in range(0, b - a if tree else 0, block_queries):
                    asked = names[a + s : min(b, a + s + block_queries)]
                    who, score = tree.search(asked, rows[s : s + block_queries], k, factor)
                    hit = who >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, hit.sum(axis=1))), pa.array(tree.ids[who[hit]]), pa.array(score[hit])], schema=FOUND)

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k nearest rows of ``vectors`` by Euclidean distance for each row of ``queries``, itself (by id) left out.

    Returns query_id, rank (from 1), vec_id and score (the distance in double precision), ties to the smaller
    id. Rows that are null, all zero or hold null or non-finite components take no part on either side.
    Vectors meet only those of their own length. Rows that repeat an id are candidates of their own; a query
    id that repeats is searched once. Fewer than k candidates give fewer rows; empty tables give none. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    sent = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    n = max(1, min(shards, 4 * partitions(spark)))
    arrow_batches(spark, TEXT_ROWS)
    met = dealt.union(sent).repartition(n, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = met.mapInArrow(_search(k, factor, block_queries), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
