"""Operator 6: quality classifier on random-indexing word vectors.

A word's index vector is a few +1 and -1 at places that hashes of its parts choose (runs of letters or
digits, runs of other signs, its letter case), so unseen words have one too. Its context vector is the sum
of the index vectors of its neighbours in the training sample (random indexing); the ``VOCABULARY`` most
frequent words have one. A document is the mean of its words' vectors, the length of that mean (which
repetition raises), the share of repeated neighbours and its log length. A two-layer network in numpy gives a
logit, and a temperature fitted on a part of the sample that the network did not see makes it a probability.

Runs of digits of nine and more are one part, and runs of signs are told apart by their first four signs; words beyond
the ``VOCABULARY`` most frequent of the sample have an index vector alone. All words of a text count.

The fit uses ``SAMPLE_ROWS`` labelled rows at most (those of the least hashes of ids); only their features
reach the driver. The vocabulary, the network and so the broadcast have fixed bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from logweave.llm.common import TEXT_ROWS, arrow_batches, columns_of, id_bucket, map_rows, partitions, quoted, text_slices, written

DIM = 64
NONZERO = 4
WIDTH = 2 * DIM + 3
SAMPLE_ROWS = 20_000
VOCABULARY = 20_000
HIDDEN = 32
STEPS = 4000
BATCH = 256
RATE = 3e-3
DECAY = 1e-4
CALIBRATION_SHARE = 0.2
THRESHOLD = 0.3
CACHED_WORDS = 250_000
SEED = 7

_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def parts(word: str) -> list[str]:
    """What a word's index vector is made of."""
    out = []
    for part in _PARTS.findall(word):
        if part[0].isalpha():
            out.append(part.lower())
            if len(part) > 1:
                out.append("<upper>" if part.isupper() else "<lower>" if part.islower() else "<mixed>")
        elif part[0].isdigit():
            out.append(f"<{min(len(part), 9)} digits>")
        else:
            out.append(part[:4])
    return out


def index_vectors(words: list[bytes]) -> np.ndarray:
    """Per word the sum of its parts' sparse random vectors: small integers."""
    hashes, owners, digest = [], [], xxhash.xxh64_intdigest
    for k, word in enumerate(words):
        found = parts(word.decode("utf-8"))
        hashes += [digest(p.encode("utf-8"), SEED) for p in found]
        owners += [k] * len(found)
    h, k = np.array(hashes, np.uint64), np.array(owners, np.int64)
    v = np.zeros(len(words) * DIM)
    for j in range(NONZERO):
        part = h >> np.uint64(16 * j)
        where = k * DIM + (part % np.uint64(DIM)).astype(np.int64)
        v += np.bincount(where, weights=np.where(part >> np.uint64(8) & np.uint64(1), 1.0, -1.0), minlength=len(v))
    return np.clip(v, -127, 127).astype(np.int8).reshape(-1, DIM)


class WordVectors:
    """Vectors of words (index, and context where known), with a bounded memory."""

    def __init__(self, context: dict[bytes, np.ndarray] | None = None):
        self.known = {w: k for k, w in enumerate(context or {}, 1)}
        self.context = np.stack([np.zeros(DIM, np.float32), *(context or {}).values()])
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.rows = np.zeros((1 << 14, DIM), np.int8)
        self.scale, self.contexts = np.zeros(1 << 14, np.float32), np.zeros(1 << 14, np.int32)

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """Index vectors of length one."""
        return self.rows[at] * self.scale[at][:, None]

    def at(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in ``rows``, ``scale`` and ``contexts``."""
        if len(self.index) > CACHED_WORDS:
            self.clear()
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        fresh = self.index.new
        if len(self.index) > len(self.rows):
            more = len(self.index) - len(self.rows) + (1 << 14)
            self.rows, self.scale, self.contexts = (np.concatenate([x, np.zeros((more, *x.shape[1:]), x.dtype)]) for x in (self.rows, self.scale, self.contexts))
        for s in range(0, len(fresh), 20_000):
            some = fresh[s : s + 20_000]
            first = len(self.index) - len(fresh) + s
            at = slice(first, first + len(some))
            self.rows[at] = vectors = index_vectors(some)
            lengths = np.sqrt((vectors.astype(np.float32) ** 2).sum(axis=1))
            self.scale[at] = np.where(lengths > 0, 1 / np.maximum(lengths, 1), 0)
            self.contexts[first : first + len(some)] = [self.known.get(w.lower(), 0) for w in some]
        fresh.clear()
        return out


class _Index(dict):
    """Numbers of words in the order they come; new ones are noted."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


def features(texts: list[bytes], vectors: WordVectors) -> np.ndarray:
    """One row per text."""
    words, ends = [], []
    for text in texts:
        words += text.split()
        ends.append(len(words))
    at = vectors.at(words)
    ends = np.array(ends)
    firsts = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(texts), WIDTH))
    for k, (a, b) in enumerate(zip(firsts, ends)):
        for s in range(a, b, 1 << 14):
            some = at[s : min(b, s + (1 << 14))]
            out[k, :DIM] += vectors.scale[some] @ vectors.rows[some].astype(np.float32)
            out[k, DIM : 2 * DIM] += vectors.context[vectors.contexts[some]].sum(axis=0, dtype=np.float64)
        out[k, : 2 * DIM] /= max(1, b - a)
        out[k, -2] = np.count_nonzero(at[a + 1 : b] == at[a : b - 1]) / max(1, b - a)
    out[:, -3] = np.sqrt((out[:, :DIM] ** 2).sum(axis=1))
    out[:, -1] = np.log1p(ends - firsts)
    return out


class Network:
    """Two layers (ReLU, then one logit), trained by Adam on the log loss, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
        self.temperature = 1.0
        order = rng.permutation(len(x))
        held = order[: int(len(x) * CALIBRATION_SHARE)]
        used = order[len(held) :]
        self.train(self.scaled(x[used]), y[used], rng)
        if len(held) and 0 < y[held].sum() < len(held):
            self.calibrate(self.logits(x[held]), y[held])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(z @ self.p[0] + self.p[1], 0)
        return hidden, hidden @ self.p[2] + self.p[3]

    def train(self, z: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        first, second, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        while step < STEPS:
            order = rng.permutation(len(z))
            for s in range(0, len(z), BATCH):
                a, b = z[order[s : s + BATCH]], y[order[s : s + BATCH]]
                hidden, logit = self.forward(a)
                d = (sigmoid(logit) - b) / len(b)
                back = np.outer(d, self.p[2]) * (hidden > 0)
                grads = [a.T @ back + DECAY * self.p[0], back.sum(axis=0), hidden.T @ d + DECAY * self.p[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log loss, by golden section on its logarithm."""

        def loss(t: float) -> float:
            m = logits / np.exp(t)
            return float(np.mean(np.logaddexp(0, m) - y * m))

        low, high, g = -2.0, 3.0, (np.sqrt(5) - 1) / 2
        for _ in range(50):
            a, b = high - g * (high - low), low + g * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x))[1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Constant:
    """Where there is nothing to learn from: the share of label 1, or a half."""

    def __init__(self, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _contexts(words: dict[bytes, int]):
    """Sums of the neighbours' index vectors of each word of the vocabulary, one row per task and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = WordVectors()
        total = np.zeros((len(words), DIM), np.float64)
        for batch in batches:
            for _, texts in text_slices(batch, 0, 1 << 18):
                for text in texts:
                    found = text.split()
                    own = np.fromiter((words.get(w.lower(), -1) for w in found), np.int64, len(found))
                    at = vectors.at(found)  # may make new rows
                    v = vectors.vectors(at)
                    around = np.zeros_like(v)
                    around[1:] += v[:-1]
                    around[:-1] += v[1:]
                    hit = np.flatnonzero(own >= 0)
                    if len(hit):
                        order = hit[np.argsort(own[hit], kind="stable")]
                        first = np.flatnonzero(np.diff(own[order], prepend=-1))
                        total[own[order][first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.float64)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([total[k].tobytes() for k in some], pa.binary())], names=["k", "v"])

    return run


def _add_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(v, np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "v"])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled training documents: those of the least hashes of ids."""
    ids = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (id_bucket(F.col(id_col), modulus) != held_out))
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.max(F.col(label_col)).cast("int").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "__id").select("__id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS):
    """(context vectors, network), learnt from labelled rows whose crc32(id) modulo ``modulus`` is not ``held_out``."""
    spark = docs.sparkSession
    arrow_batches(spark, TEXT_ROWS)
    sample = written(labelled_sample(docs, labels, id_col, text_col, label_col, modulus, held_out, rows))
    word = F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"))
    counted = sample.select(word.alias("w")).where("w != ''").groupBy("w").count().orderBy(F.desc("count"), "w").limit(VOCABULARY).collect()
    vocabulary = [r["w"].encode("utf-8") for r in counted]
    sent = spark.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contexts(sent.value)(batches)

    sums = sample.select("text").mapInArrow(contexts, "k long, v binary").repartition(partitions(spark), "k").mapInArrow(_add_contexts, "k long, v binary").collect()
    context = {}
    for r in sums:
        v = np.frombuffer(bytes(r["v"]), np.float64)
        length = float(np.sqrt(v @ v))
        if length:
            context[vocabulary[r["k"]]] = (v / length).astype(np.float32)
    shared = spark.sparkContext.broadcast(context)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = WordVectors(shared.value)
        for batch in batches:
            for at, texts in text_slices(batch, 0):
                x = features(texts, vectors)
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()), batch.column(1).slice(at, len(texts)), batch.column(2).slice(at, len(texts))], names=["x", "y", "i"])

    got = sample.select("text", "y", "__id").mapInArrow(featurize, "x binary, y int, i long").toArrow()  # rows times WIDTH numbers
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    order = np.lexsort((x[:, 0], x[:, -1], np.asarray(got.column("i"))))  # the same at every run
    x, y = x[order].astype(np.float64), np.asarray(got.column("y")).astype(np.float64)[order]
    if not 0 < y.sum() < len(y):
        return shared, Constant(y)
    return shared, Network(x, y)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 5,
    held_out: int = 0,
    threshold: float = THRESHOLD,
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows of ``docs`` with all their columns and held_out, score (0 to 1) and predicted (1: score >= threshold).

    Columns of these three names in ``docs`` are replaced. Only texts enter a score. Null texts count as
    empty and get the score of no words. A null id is not held out. Labels that are null or neither 0 nor 1
    are left aside; of repeated ones the larger holds. Without both labels every score is the share of label
    1 (a half without any). Repeated rows get equal scores; an empty table stays empty.
    """
    context, model = fit(docs, labels, id_col, text_col, label_col, modulus, held_out, rows)
    network = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*columns_of(docs, "held_out", "score", "predicted"))
    where = [c.lower() for c in plain.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        vectors = WordVectors(context.value)
        for batch in batches:
            for at, texts in text_slices(batch, where):
                score = network.value.predict(features(texts, vectors))
                yield [*(c.slice(at, len(texts)) for c in batch.columns), pa.array(score)]

    held = F.coalesce(id_bucket(F.col(quoted(id_col)), modulus) == held_out, F.lit(False))
    scored = map_rows(plain, run, [*plain.schema.fields, StructField("score", DoubleType())])
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
