"""Operator 4: language-model scores from a log-frequency Bloom filter.

1. Every text becomes numbers of words where it is read, in chunks of about ``CHUNK_TOKENS`` tokens, written to
   the shared folder.
2. A chunk sends the hashes of its distinct words, pairs and triples of neighbours, with their counts in training
   texts, by slices of the hash. So all of an n-gram meets in one task, which sums the counts of its slice. Triples
   go after the others, whose shuffle is deleted then, so both don't lie on disk at once.
3. A count c becomes the level 1 + floor(log2 c). The filter of the slice holds each n-gram once per level up to
   its own (Talbot and Osborne, 2007) in ``BITS_PER_ENTRY`` bits per entry, so a count is read by probing level
   after level until one is missing. The slice probes for all chunks that asked and sends the levels back (and the
   exact counts of words, which the unigram base needs). What a level stands for is the mean count of its n-grams,
   by exact histograms.
4. A chunk meets its levels, which is all that a score needs of its tokens. From the training tokens come the
   weights: interpolated absolute discounting (Ney, Essen and Kneser, 1994) with the discount n1 / (n1 + 2 n2) of
   each order, and back-off weights tied by the level of the context: the discount times the n-gram types seen
   after contexts of the level, over the tokens there. A token's n-gram of count c is 1 / c of a type, so sums
   over tokens count types.
5. The documents of each chunk are scored: triples over pairs over add-one words.

The filter grows with the n-grams: its slices grow in number with the corpus, and none leaves its task. So nothing
is left out at any size, and nothing is broadcast but the levels' values and weights. Words are told apart by 64
bits, so exact counts are exact up to a collision among them (a chance of 3 in 10,000 for 100 million words);
pairs and triples by 32 bits beside those of the slice: fewer than one in 1000 meets another, less than the
filter errs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import TEXT_ROWS, arrow_batches, id_bucket, mix64, partitions, quoted, text_slices, written

END = b"\n"
SEED = 42
BITS_PER_ENTRY = 24
PROBES = 4
LEAST_BITS = 4096  # of a slice: in a smaller filter the places of an n-gram often fall together
CHUNK_TOKENS = 1_000_000
SLICE_TOKENS = 1 << 20  # a slice takes the n-grams of about so many tokens
LEAST_SLICE_BITS = 12
START_HASH = 0x9E3779B97F4A7C15
START_LEVEL = 80  # of the context at the start of a document, above all levels of counts
LEVELS = 96


class WordIndex(dict):
    """Numbers of words in the order they come; ``new`` notes those that have come since it was cleared."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


def packed(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype)


def _joined(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1) + hashes)


def pair_hashes(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Hashes of (word before, word) for the words of documents in a row; those at ``firsts`` follow a start mark."""
    before = np.concatenate([[np.uint64(START_HASH)], hashes[:-1]])
    before[firsts] = np.uint64(START_HASH)
    return _joined(before, hashes)


def triple_hashes(pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of (pair before, word); a document's first word has none (what stands there means nothing)."""
    return _joined(np.concatenate([[np.uint64(0)], pairs[:-1]]) ^ np.uint64(START_HASH), hashes)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for none."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.uint8)


CHUNK = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("starts", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary())])
CHUNK_DDL = "chunk long, n long, starts long, ids array<long>, held array<boolean>, sizes binary, tokens binary, hashes binary"


class Coder:
    """Texts as numbers of words, a chunk at a time."""

    def __init__(self) -> None:
        self.index, self.hashes, self.n = WordIndex(), [], 0
        self.tokens: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.ids: list[int | None] = []
        self.held: list[bool] = []

    def add(self, ids: list[int | None], held: list[bool], texts: list[bytes]) -> None:
        number = self.index.__getitem__
        for text in texts:
            words = text.lower().split()
            words.append(END)
            self.tokens.append(np.fromiter(map(number, words), np.uint32, len(words)))
            self.sizes.append(len(words))
            self.n += len(words)
        new = self.index.new
        self.hashes.append(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in new), np.uint64, len(new)))
        new.clear()
        self.ids += ids
        self.held += held

    def row(self, number: int) -> pa.RecordBatch:
        starts = len(self.held) - sum(self.held)
        columns = [[number], [self.n], [starts], [self.ids], [self.held], [packed(np.array(self.sizes, np.uint32))], [packed(np.concatenate(self.tokens))], [np.concatenate(self.hashes).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CHUNK)], schema=CHUNK)


def _coder(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = Coder(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, texts in text_slices(batch, 1):
                coder.add(ids[at : at + len(texts)], held[at : at + len(texts)], texts)
                if coder.n >= chunk_tokens:
                    yield coder.row(number)
                    coder, number = Coder(), number + 1
        if coder.ids:
            yield coder.row(number)

    return run


class Chunk:
    """The arrays of a chunk's row: its tokens by number, and the n-grams that it asks for, by order."""

    def __init__(self, held: list[bool], sizes: bytes, tokens: bytes, hashes: bytes, slice_bits: int):
        self.tokens, self.sizes, words = unpacked(tokens, np.uint32), unpacked(sizes, np.uint32).astype(np.int64), np.frombuffer(hashes, np.uint64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.trained = np.repeat(~np.array(held, bool), self.sizes)
        own = words[self.tokens]
        pairs = pair_hashes(own, self.firsts)
        drop = np.uint64(32 - slice_bits)
        # of pairs and triples the bits of the slice and 32 more
        self.asked = [words, pairs >> drop, triple_hashes(pairs, own) >> drop]

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct n-grams in order, place among them of each word's number or of each token)."""
        return np.unique(self.asked[order - 1], return_inverse=True)

    def counts(self, order: int, where: np.ndarray, n: int) -> np.ndarray:
        """How often each distinct n-gram stands in training texts."""
        if order == 1:
            return np.bincount(where[self.tokens[self.trained]], minlength=n)
        valid = self.trained.copy()
        if order == 3:
            valid[self.firsts] = False
        return np.bincount(where[valid], minlength=n)


PASSES = [(1, 2), (3,)]  # orders that are asked for together


def _asked_ddl(orders: tuple[int, ...]) -> str:
    return "slice int, chunk long, " + ", ".join(f"{kind}{k} binary" for k in orders for kind in ("h", "c", "more"))


def _ask(slice_bits: int, orders: tuple[int, ...]):
    """Of every chunk the distinct n-grams of each slice, in order, with their counts: a byte, and four more from 255 on."""
    schema = pa.schema([("slice", pa.int32()), ("chunk", pa.int64()), *((f"{kind}{k}", pa.binary()) for k in orders for kind in ("h", "c", "more"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = np.arange(1 << slice_bits, dtype=np.uint64)
        for batch in batches:
            for number, *row in zip(*(c.to_pylist() for c in batch.columns)):
                chunk = Chunk(*row, slice_bits)
                parts, rows = [], np.zeros(len(slices), np.int64)
                for order in orders:
                    h, where = chunk.distinct(order)
                    c = chunk.counts(order, where, len(h))
                    cut = np.append(np.searchsorted(h, slices << np.uint64(64 - slice_bits if order == 1 else 32)), len(h))
                    sent, many = (h if order == 1 else h.astype(np.uint32)).tobytes(), c >= 255
                    wide = 8 if order == 1 else 4
                    before = np.concatenate([[0], np.cumsum(many)])[cut]
                    parts += [(sent, cut * wide), (np.minimum(c, 255).astype(np.uint8).tobytes(), cut), (c[many].astype(np.uint32).tobytes(), before * 4)]
                    rows += np.diff(cut)
                some = np.flatnonzero(rows)
                for s in range(0, len(some), 4096):
                    ks = some[s : s + 4096]
                    columns = [pa.array([data[a:b] for a, b in zip(cut[ks].tolist(), cut[ks + 1].tolist())], pa.binary()) for data, cut in parts]
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(np.full(len(ks), number)), *columns], schema=schema)

    return run


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """The rows (without the first column) of each value of the first column, by which the batches are sorted."""
    number, rows = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if k != number:
                if rows:
                    yield number, rows
                number, rows = k, []
            rows.append(row)
    if rows:
        yield number, rows


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, sums of their counts, place of each hash among them)."""
    h, where = np.unique(hashes, return_inverse=True)
    return h, np.bincount(where, weights=counts, minlength=len(h)).astype(np.int64), where


def _places(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix64(hashes.astype(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64))
    return a, (a >> np.uint64(32)) | np.uint64(1)


def fill(bits: np.ndarray, hashes: np.ndarray, q: np.ndarray) -> None:
    """Set the bits of all levels of the hashes, up to ``q`` of each."""
    size = np.uint64(len(bits))
    for level in range(1, int(q.max(initial=0)) + 1):
        a, b = _places(hashes[q >= level], level)
        for j in range(PROBES):
            bits[((a + b * np.uint64(j)) % size).astype(np.int64)] = True


def probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The levels of the hashes in the filter; 0 if it has none."""
    level, left, size = np.zeros(len(hashes), np.uint8), np.arange(len(hashes)), np.uint64(len(bits))
    for q in range(1, 65):
        a, b = _places(hashes[left], q)
        for j in range(PROBES):
            hit = bits[((a + b * np.uint64(j)) % size).astype(np.int64)]
            left, a, b = left[hit], a[hit], b[hit]
        if not len(left):
            break
        level[left] = q
    return level


# rows of a chunk: the exact counts of its words (a byte, and eight more from 255 on), and levels by order; other rows: of an order the n-grams (n) of a
# level, and the tokens that they are; level 0 has the n-grams of count 2
TOLD = pa.schema([("chunk", pa.int64()), ("slice", pa.int32()), ("exact", pa.binary()), ("more", pa.binary()), *((f"q{k}", pa.binary()) for k in (1, 2, 3)), ("order", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
TOLD_DDL = "chunk long, slice int, exact binary, more binary, q1 binary, q2 binary, q3 binary, `order` int, level int, n long, total long"


def _rows(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _tell(bits_per_entry: int, orders: tuple[int, ...]):
    """Per slice: what its n-grams are to each chunk, in the order asked, and the histograms of the levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in _by_first(batches):
            told = {}
            for at, order in zip((1, 4), orders):
                parts = [np.frombuffer(row[at], np.uint64 if order == 1 else np.uint32) for row in rows]
                asked = np.concatenate(parts)
                counts = np.concatenate([np.frombuffer(row[at + 1], np.uint8) for row in rows]).astype(np.int64)
                counts[counts == 255] = np.concatenate([np.frombuffer(row[at + 2], np.uint32) for row in rows])
                h, c, where = summed(asked, counts)
                q, held = levels(c), c > 0
                bits = np.zeros(max(LEAST_BITS, bits_per_entry * int(q.sum(dtype=np.int64))), bool)
                fill(bits, h[held], q[held])
                n, total = np.bincount(q, minlength=65), np.bincount(q, weights=c, minlength=65).astype(np.int64)
                n[0], total[0] = np.count_nonzero(c == 2), 0
                some = np.flatnonzero(n)
                if len(some):
                    yield _rows(TOLD, len(some), order=np.full(len(some), order), level=some, n=n[some], total=total[some])
                cuts = np.cumsum([len(p) for p in parts])[:-1]
                told[f"q{order}"] = [p.tobytes() for p in np.split(probe(bits, h)[where], cuts)]
                if order == 1:
                    exact = np.split(c[where], cuts)
                    told["exact"] = [np.minimum(p, 255).astype(np.uint8).tobytes() for p in exact]
                    told["more"] = [p[p >= 255].astype(np.int64).tobytes() for p in exact]
            yield _rows(TOLD, len(rows), chunk=[row[0] for row in rows], slice=np.full(len(rows), k), **told)

    return run


class Model:
    """What the histograms say: tokens, types, the values of levels and the discounts by order; and back-off weights."""

    def __init__(self, histograms: dict[int, dict[int, tuple[int, int]]], starts: int):
        words = [x for level, x in histograms[1].items() if level]
        self.types, self.tokens, self.starts = sum(n for n, _ in words), sum(t for _, t in words), starts
        self.room = 1.0 * (self.tokens + self.types + 1)
        self.value, self.discount = {}, {}
        for order, h in histograms.items():
            value = np.zeros(LEVELS)
            for level, (n, total) in h.items():
                if level:
                    value[level] = total / n
            value[1:] = np.maximum.accumulate(value[1:])  # a level that is empty stands for the one below
            value[START_LEVEL] = starts
            self.value[order] = value
            one, two = h.get(1, (0, 0))[0], h.get(0, (0, 0))[0]
            self.discount[order] = one / (one + 2 * two) if one else 0.5
        self.backoff = {2: np.ones(LEVELS), 3: np.ones(LEVELS)}

    def weigh(self, seen: dict[tuple[int, int], tuple[int, float]]) -> None:
        """Back-off weights from (order, level of the context): (training tokens, n-gram types) there."""
        for (order, level), (tokens, types) in seen.items():
            if level and tokens:
                self.backoff[order][level] = min(1.0, self.discount[order] * types / tokens)

    def probabilities(self, q: np.ndarray, contexts: dict[int, np.ndarray]) -> np.ndarray:
        """Of tokens by the levels of their n-grams (rows: order) and of their contexts; level 0: never seen."""
        p = (self.value[1][q[0]] + 1) / self.room
        for order in (2, 3):
            context = contexts[order]
            among = self.value[order - 1][context]
            share = np.maximum(np.minimum(self.value[order][q[order - 1]], among) - self.discount[order], 0) / np.maximum(among, 1)
            p = np.where(context > 0, np.minimum(share + self.backoff[order][context] * p, 1.0), p)
        return p


def context_levels(q: np.ndarray, firsts: np.ndarray) -> dict[int, np.ndarray]:
    """Levels of the contexts of each token by order: of the word before, of the pair before (none at a start)."""
    word, pair = (np.concatenate([[0], q[k][:-1]]).astype(np.uint8) for k in (0, 1))
    word[firsts], pair[firsts] = START_LEVEL, 0
    return {2: word, 3: pair}


MET = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("q", pa.binary()), ("order", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("types", pa.float64())])
MET_DDL = "ids array<long>, held array<boolean>, sizes binary, known binary, base binary, q binary, `order` int, level int, n long, types double"
MEET = ["chunk", "slice", "ids", "held", "sizes", "tokens", "hashes", "exact", "more", "q1", "q2", "q3"]


def _meet(model: Model, slice_bits: int):
    """Per chunk (its own row before those of its slices): the unigram base and the levels of all its tokens, and
    of the training tokens how many follow contexts of each level, with the n-gram types that they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (own, *told) in _by_first(batches):
            _, ids, held, sizes, tokens, hashes, *_ = own
            chunk = Chunk(held, sizes, tokens, hashes, slice_bits)
            exact = np.frombuffer(b"".join(r[6] or b"" for r in told), np.uint8).astype(np.int64)
            exact[exact == 255] = np.frombuffer(b"".join(r[7] or b"" for r in told), np.int64)
            q = np.zeros((3, len(chunk.tokens)), np.uint8)
            for order in (1, 2, 3):
                level, where = np.frombuffer(b"".join(r[7 + order] or b"" for r in told), np.uint8), chunk.distinct(order)[1]
                if order == 1:
                    count = exact[where][chunk.tokens]
                    where = where[chunk.tokens]
                q[order - 1] = level[where]
            q[2, chunk.firsts] = 0
            base = np.add.reduceat(np.log10((count + 1) / model.room), chunk.firsts)
            known = np.add.reduceat((count > 0).astype(np.int64), chunk.firsts)
            yield _rows(MET, 1, ids=[ids], held=[held], sizes=[sizes], known=[known.tobytes()], base=[base.tobytes()], q=[packed(q)])
            for order, context in context_levels(q, chunk.firsts).items():
                context = context[chunk.trained]
                n = np.bincount(context, minlength=LEVELS)
                types = np.bincount(context, weights=1 / np.maximum(model.value[order][q[order - 1][chunk.trained]], 1), minlength=LEVELS)
                some = np.flatnonzero(n)
                yield _rows(MET, len(some), order=np.full(len(some), order), level=some, n=n[some], types=types[some])

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, sizes, known, base, q in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = unpacked(sizes, np.uint32).astype(np.int64)
                firsts, q = np.cumsum(sizes) - sizes, unpacked(q, np.uint8).reshape(3, -1)
                score = np.add.reduceat(np.log10(model.probabilities(q, context_levels(q, firsts))), firsts)
                columns = [ids, held, sizes, np.frombuffer(known, np.int64), np.frombuffer(base, np.float64), score]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORES)], schema=SCORES)

    return run


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    held_out: int = 2,
    chunk_tokens: int = CHUNK_TOKENS,
    bits_per_entry: int = BITS_PER_ENTRY,
) -> DataFrame:
    """Score every document with a model of those whose crc32(id) modulo ``modulus`` is not ``held_out``.

    Returns per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams, exact
    counts) and score (log10 probability by the filter's model of words, pairs and triples). Null and empty texts
    are the end alone. A null id has no bucket: its text is trained on. Rows that repeat an id stay rows. Other
    columns are not read. An empty table gives none; without training documents every count is 0.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.coalesce(id_bucket(F.col(quoted(id_col)), modulus) == held_out, F.lit(False)).alias("held_out"))
    arrow_batches(spark, TEXT_ROWS)
    chunks = written(plain.mapInArrow(_coder(chunk_tokens), CHUNK_DDL))
    size = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("starts"), F.lit(0)).alias("starts")).first()
    slice_bits = max(LEAST_SLICE_BITS, (size["n"] // SLICE_TOKENS).bit_length())

    def passed(orders: tuple[int, ...]) -> DataFrame:
        asked = chunks.select("chunk", "held", "sizes", "tokens", "hashes").mapInArrow(_ask(slice_bits, orders), _asked_ddl(orders))
        return written(asked.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(_tell(bits_per_entry, orders), TOLD_DDL))

    told = reduce(DataFrame.union, [passed(orders) for orders in PASSES])
    histograms: dict[int, dict[int, tuple[int, int]]] = {1: {}, 2: {}, 3: {}}
    for r in told.where(F.col("chunk").isNull()).groupBy("order", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        histograms[r["order"]][r["level"]] = r["n"], r["total"]
    model = Model(histograms, size["starts"])

    own = chunks.drop("n", "starts").withColumn("slice", F.lit(-1))
    meet = own.unionByName(told.where(F.col("chunk").isNotNull()).select("chunk", "slice", "exact", "more", "q1", "q2", "q3"), allowMissingColumns=True)
    met = written(meet.select(MEET).repartition(n, "chunk").sortWithinPartitions("chunk", "slice").mapInArrow(_meet(model, slice_bits), MET_DDL))
    weights = met.where(F.col("ids").isNull()).groupBy("order", "level").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    model.weigh({(r["order"], r["level"]): (r["n"], r["types"]) for r in weights})

    scored = met.where(F.col("ids").isNotNull()).select("ids", "held", "sizes", "known", "base", "q").mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
