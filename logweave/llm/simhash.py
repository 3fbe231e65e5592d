"""Operator 10: SimHash near-duplicates by meet-in-the-middle ball hashing.

Equal fingerprints are one from the start. Two others within three bits are found where their balls meet:
of the three bits at least one lies in one of ``BLOCKS`` blocks of the 64. Where that block is erased, two
bits at most are left, and the word midway is within one bit of both fingerprints. So every fingerprint
emits, for each erased block, all variants within one bit (half of the two that are left); equal variants
meet by a shuffle, and pairs that meet are verified on all 64 bits. The plain ball of the radius two that
three bits would need without erasing has 2081 variants per fingerprint; this has about 130, and misses none.

Fingerprints that meet are not turned into all pairs: a bucket gives a spanning forest of its verified links,
and one of more than ``WIDE`` fingerprints a row for each to the least of its component there, found by rules that
take about linear time. Components are then found by rounds of
joins on fingerprints (large-star, small-star), each round written to the shared folder.

:func:`similar_documents` goes farther, to texts whose five-word shingles are alike by 0.8 (Jaccard): three bits of a
shingles' fingerprint only find almost equal texts, and more bits have too large a ball. So texts meet by a
fingerprint of their distinct words, which differ less than shingles do: two of four blocks are erased, of which the
two that differ least leave two bits at most of any six (of seven in 85 % of cases, of eight in 65 %), and the balls
of one bit meet as above. Pairs that meet within ``WORD_RADIUS`` bits are verified by a second SimHash, 1024
bits of the five-word shingles, and where that leaves a doubt by the shingles themselves. That links most near copies
cheaply, not all: words may differ by more bits, and buckets give their nearest links only. So what is still apart is
joined exactly, by prefixes of the shingles (:mod:`logweave.llm.shingle_join`), and verified by the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import SMALL_ROWS, TEXT_ROWS, arrow_batches, columns_of, drop_written, free_names, mix64, partitions, quoted, text_slices, written
from logweave.llm.shingle_join import PARITY_LONGS, common_elements, most_differing, order_of, pairs_met, parity, prefix

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 3
SEED = 42
NUMBER_SHIFT = 60  # where a key has the number of its block
SIMILAR_WORDS, SIMILARITY = 5, 0.8
WORD_BLOCKS, WORD_ERASED, WORD_RADIUS = 4, 2, 10
TREES, FAR = 2, 99  # trees of a bucket; more bits than there are
SKETCH_LONGS = 16
BROADCAST_TEXTS = 500_000  # ids of texts to fetch, some 10 MB; more of them meet the documents by a shuffle
WIDE = 256  # larger buckets are linked by rules, not by rows of distances

LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: a bit is set if more than half of the shingles' hashes have it."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[: len(tokens) - words + 1].tolist(), (ends - 1)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long. Null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(prints)], schema=schema)

    arrow_batches(docs.sparkSession, TEXT_ROWS)
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, erased: int = 1) -> list[int]:
    """The bits that are erased: those of each block, or of each choice of ``erased`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [sum(some) for some in combinations([(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])], erased)]


def _erased(prints: np.ndarray, mask: int) -> np.ndarray:
    """The bits outside of a mask, moved together."""
    out, at, low = np.zeros_like(prints), 0, 0
    while low < 64:
        high = low
        while high < 64 and mask >> high & 1 == mask >> low & 1:
            high += 1
        if not mask >> low & 1:
            out |= (prints >> np.uint64(low) & np.uint64((1 << high - low) - 1)) << np.uint64(at)
            at += high - low
        low = high
    return out


def variants(prints: np.ndarray, blocks: int = BLOCKS, erased: int = 1) -> Iterator[np.ndarray]:
    """Per mask an array of (prints x variants) keys: the number of the mask on top, the bits that are left below.

    So keys of different masks never meet (64 bits less a block leave room for the number).
    """
    for number, mask in enumerate(block_masks(blocks, erased)):
        flips = np.array([0, *(1 << k for k in range(64 - mask.bit_count()))], np.uint64)
        yield (_erased(prints, mask)[:, None] ^ flips) | np.uint64(number << NUMBER_SHIFT)


def _emit(blocks: int, erased: int):
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column(0)).view(np.uint64)
            for k in range(0, len(prints), 1000):
                part = prints[k : k + 1000]
                for keys in variants(part, blocks, erased):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], schema=schema)

    return run


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by rows of distances: no pair list is kept."""
    left, links = np.ones(len(prints), bool), []
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue[0]] = False
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(prints ^ prints[at]) <= radius))
            left[near] = False
            queue += near.tolist()
            links += [(at, int(k)) for k in near]
    return links


@cache
def _flips(width: int, most: int) -> np.ndarray:
    """All words of ``width`` bits with 1 to ``most`` of them set."""
    return np.array([sum(1 << b for b in bits) for n in range(1, most + 1) for bits in combinations(range(width), n)], np.uint64)


def _neighbours(values: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Positions (i, j) of sorted distinct values that differ by one of the flips, each pair once."""
    found = []
    for k in range(0, len(values), 1000):
        wanted = values[k : k + 1000, None] ^ flips
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        i, j = np.nonzero((values[at] == wanted) & (wanted > values[k : k + 1000, None]))
        found.append(np.stack([i + k, at[i, j]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def wide_links(prints: np.ndarray, key: int, blocks: int = BLOCKS) -> np.ndarray:
    """Links (a, b) of a large bucket, in about linear time; ``prints`` are sorted and distinct.

    All members are within one bit of the key outside of the erased block, so two of them differ by two bits
    there at most. Equal erased blocks therefore link, and so do those that differ by one bit. Blocks that
    differ by two bits with one at most outside, or none, meet in the bucket of another block, where this rule
    holds. What is left is two or three bits in the block and none outside: members that equal the key
    outside are looked up by all such flips.
    """
    mask = block_masks(blocks)[key >> NUMBER_SHIFT]
    rest = np.uint64(key & ((1 << NUMBER_SHIFT) - 1))
    shift, width = np.uint64((mask & -mask).bit_length() - 1), mask.bit_count()
    block = (prints & np.uint64(mask)) >> shift
    order = np.argsort(block, kind="stable")
    block, members = block[order], prints[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    sizes = np.diff(np.append(first, len(block)))
    same = np.stack([np.repeat(members[first], sizes), members], axis=1)
    near = members[first][_neighbours(block[first], _flips(width, 1))]
    exact = _erased(members, mask) == rest  # blocks of these are distinct and in order
    inside = members[exact][_neighbours(block[exact], _flips(width, RADIUS))]
    out = np.concatenate([same, near, inside])
    return out[out[:, 0] != out[:, 1]]


def rooted(prints: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The components of a bucket as (least member, member): fewer rows than members, however many links."""
    i, j = np.searchsorted(prints, links[:, 0]), np.searchsorted(prints, links[:, 1])
    root = np.arange(len(prints))
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    child = np.flatnonzero(root != np.arange(len(prints)))
    return np.stack([prints[root[child]], prints[child]], axis=1)


def exact_links(group: np.ndarray, key: int) -> np.ndarray:
    """Links (a, b) of a bucket whose components are those of all its links within ``RADIUS``."""
    if len(group) > WIDE:
        return rooted(group, wide_links(group, key))
    return group[np.array(forest(group), np.int64).reshape(-1, 2)]


def nearest_links(group: np.ndarray, key: int) -> np.ndarray:
    """Links (a, b) of a bucket to what is near: ``TREES`` trees of least distances, or stars where there are very many.

    The trees share no link, so among a few members all pairs are there, and many get links in proportion. The
    middles of stars are the members next to the majority of the bits, so that copies meet what they are copies of.
    Other links of the bucket are left to the exact join of :func:`similar_roots`.
    """
    links, left = [], group
    while len(left) > WIDE:
        middles = left[np.argsort(np.bitwise_count(left ^ np.uint64(majority(left))), kind="stable")[:TREES]]
        near = np.bitwise_count(left ^ middles[0]) <= WORD_RADIUS
        links += [np.stack([np.full(near.sum(), middle), left[near]], axis=1) for middle in middles]
        left = left[~near]
    apart = np.bitwise_count(left[:, None] ^ left).astype(np.int64)
    apart[apart > WORD_RADIUS] = FAR
    np.fill_diagonal(apart, FAR)
    for _ in range(TREES if len(left) else 0):
        distance, to, out = apart[0].copy(), np.zeros(len(left), np.int64), np.ones(len(left), bool)
        out[0] = False
        for _ in range(len(left) - 1):
            k = int(np.argmin(np.where(out, distance, FAR + 1)))
            out[k] = False
            if distance[k] < FAR:
                links.append(np.array([[left[to[k]], left[k]]], np.uint64))
                apart[to[k], k] = apart[k, to[k]] = FAR
            closer = out & (apart[k] < distance)
            distance[closer], to[closer] = apart[k][closer], k
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def _bucket_links(radius: int, linked: Callable[[np.ndarray, int], np.ndarray]):
    """Links of each bucket of equal keys, of more than two by ``linked``; the rows come sorted by key."""

    def links(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        two = starts[ends - starts == 2]
        pairs = np.stack([prints[two], prints[two + 1]], axis=1)
        found = [pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]]
        found += [linked(np.unique(prints[starts[k] : ends[k]]), int(keys[starts[k]]) % 2**64) for k in np.flatnonzero(ends - starts > 2)]
        pair = np.concatenate(found)
        pair = pair[pair[:, 0] != pair[:, 1]]
        if len(pair):
            pair = np.unique(np.sort(pair, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array(pair[:, 1].copy().view(np.int64))], schema=LINK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut or (held and held[-1][0][0] != keys[0]):
                held.append((keys[:cut], prints[:cut]))
                yield from links(*map(np.concatenate, zip(*held)))
                held = []
            held.append((keys[cut:], prints[cut:]))
        if held:
            yield from links(*map(np.concatenate, zip(*held)))

    return run


def _meet(distinct: DataFrame, blocks: int, erased: int, radius: int, linked: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    n = partitions(distinct.sparkSession)
    arrow_batches(distinct.sparkSession, SMALL_ROWS)
    # dealt anew (by another key, else the planner leaves it out): few bytes come in, over a hundred times as many rows go out
    met = distinct.select("fp").repartition(n, F.xxhash64("fp")).mapInArrow(_emit(blocks, erased), "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    return met.mapInArrow(_bucket_links(radius, linked), "a long, b long").distinct()


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) whose components are those of all links within the radius."""
    return _meet(distinct, BLOCKS, 1, RADIUS, exact_links)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node of the component.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Each step is a grouped
    minimum and an equi-join; where one node has very many links, adaptive execution splits its rows.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    edges = written(links.select("a", "b"))
    before = state(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        edges, old = written(star(star(edges, True), False)), edges
        after = state(edges)
        drop_written(old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _membership(prints: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints in ``prints``; the root is the least fingerprint of the component."""
    distinct = prints.select("fp").distinct()
    roots = components(fingerprint_links(distinct))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long) and component_id, the least doc_id reachable by links.

    Fingerprints of three-word shingles link at three or fewer differing bits; equal ones link. A text of
    fewer words is one shingle; a null or empty one has fingerprint zero, which links like any other. Null
    ids belong to a component but do not name it (a component of null ids alone has none). Repeated rows come
    out repeated. Other columns are not read. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = _membership(prints).join(least, "fp")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # rows of equal fingerprints, such as a third of all, are spread: AQE splits the skewed side of this join
    return prints.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def wide_majority(hashes: np.ndarray) -> list[int]:
    """:func:`majority` of ``SKETCH_LONGS`` further hashes of each hash."""
    votes = np.zeros(64 * SKETCH_LONGS, np.int64)
    for k in range(0, len(hashes), 2048):
        more = mix64((hashes[k : k + 2048, None] + np.arange(SKETCH_LONGS, dtype=np.uint64)).reshape(-1))
        votes += np.unpackbits(more.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8 * SKETCH_LONGS), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8").tolist()


def sketch(text: bytes, hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """(hash of the words, SimHash of the distinct words, ``SKETCH_LONGS`` SimHashes of the distinct shingles); zeros without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0, 0, [0] * SKETCH_LONGS
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    distinct = set(tokens)
    own = majority(np.fromiter((digest(w, SEED) for w in distinct), np.uint64, len(distinct)))
    return digest(joined, SEED), own, wide_majority(hashes)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, copy, fp, s0..., n, p0..., keys) of every row; text_hash is the XXH64 of the text. Null texts count as empty.

    By :func:`sketch`; n is the number of distinct shingles, p their parity and keys their prefix.
    """
    text = F.col(quoted(text_col))
    order = order_of(common_elements(docs.select(text.alias("text")), lambda t: shingle_hashes(t, words)))
    names = ["copy", "fp", *(f"s{k}" for k in range(SKETCH_LONGS)), "n", *(f"p{k}" for k in range(PARITY_LONGS))]
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "text_hash", *names)), ("keys", pa.binary())])

    def row(text: bytes) -> tuple[list[int], bytes]:
        hashes = shingle_hashes(text, words)
        copy, fp, more = sketch(text, hashes)
        return [copy, fp, *more, len(hashes), *parity(hashes)], prefix(hashes, order, similarity).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, 2):
                longs, keys = zip(*map(row, texts))
                made = np.array(longs, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:2]), *(pa.array(made[:, k].copy()) for k in range(len(names))), pa.array(keys, pa.binary())], schema=schema)

    arrow_batches(docs.sparkSession, TEXT_ROWS)
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return plain.mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.name == 'keys' else 'long'}" for f in schema))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the shingles, in order; a text of fewer words is one shingle."""
    tokens = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[: len(tokens) - words + 1].tolist(), (ends - 1)[words - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def bits_between(similarity: float, deviations: float) -> float:
    """The bits that sketches of sets of that Jaccard similarity differ by, and so many deviations more.

    Sets of one size have the cosine 2J / (1 + J), and a bit differs with the chance angle / pi.
    """
    n = 64 * SKETCH_LONGS
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return n * chance + deviations * math.sqrt(n * chance * (1 - chance))


def _candidates(nodes: DataFrame, most: float) -> DataFrame:
    """(a, b, d): pairs of texts (by copy) that meet by their words' fingerprints, and the bits between their sketches.

    Of texts with equal words one stands for all in the buckets; every text is compared with those that stand for
    what its fingerprint has met, and with the one that stands for itself.
    """
    longs = [f"s{k}" for k in range(SKETCH_LONGS)]
    first = written(nodes.groupBy("fp").agg(F.min(F.struct("copy", *longs)).alias("x")).select("fp", "x.*"))

    def side(texts: DataFrame, name: str) -> DataFrame:
        return texts.select(F.col("fp").alias(name), F.col("copy").alias(f"{name}_copy"), *(F.col(c).alias(f"{name}_{c}") for c in longs))

    met = written(_meet(first, WORD_BLOCKS, WORD_ERASED, WORD_RADIUS, nearest_links))
    both = met.union(met.select("b", "a"))
    other = both.join(side(first, "a"), "a").join(side(nodes, "b"), "b").drop("a", "b")
    same = side(nodes, "b").withColumnRenamed("b", "a").join(side(first, "a"), "a").where(F.col("a_copy") != F.col("b_copy")).drop("a")
    differing = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in longs), F.lit(0))
    found = other.unionByName(same).select(F.least("a_copy", "b_copy").alias("a"), F.greatest("a_copy", "b_copy").alias("b"), differing.alias("d"))
    return found.where(F.col("d") <= most)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingles have the similarity, by the texts themselves.

    ``docs`` has doc_id, text_hash and text. Only texts that stand in a pair are fetched, one of each copy.
    """
    copies = pairs.select(F.col("a").alias("copy")).union(pairs.select("b")).distinct()
    wanted = written(nodes.join(copies, "copy", "left_semi").select("copy", "rep.doc_id", "rep.text_hash"))
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    texts = docs.join(some, ["doc_id", "text_hash"]).select("copy", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array([shingle_hashes(t, words).tobytes() for t in found], pa.binary())], names=["copy", "hashes"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    arrow_batches(docs.sparkSession, TEXT_ROWS)
    # rows that repeat id and text are one
    sets = written(texts.mapInArrow(hashed, "copy long, hashes binary").dropDuplicates(["copy"]))
    joined = pairs.select("a", "b").join(sets.select(F.col("copy").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("copy").alias("b"), F.col("hashes").alias("y")), "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are of different components."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return written(joined.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(*pairs.columns))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, d) those that are the nearest of one of their texts."""
    ends = pairs.select(F.col("a").alias("u"), F.struct("d", "a", "b").alias("p")).union(pairs.select("b", F.struct("d", "a", "b")))
    return ends.groupBy("u").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()


def _rest(nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b, d): all pairs of texts of different components that may have the similarity; d bits of their parities differ."""
    longs = [f"p{k}" for k in range(PARITY_LONGS)]
    sets = nodes.join(roots, nodes["copy"] == roots["node"], "left").select(F.col("copy").alias("id"), F.coalesce("root", "copy").alias("root"), "n", "keys")
    side = lambda name: nodes.select(F.col("copy").alias(name), F.col("n").alias(f"{name}_n"), *(F.col(c).alias(f"{name}_{c}") for c in longs))
    both = pairs_met(sets, similarity).join(side("a"), "a").join(side("b"), "b")
    differing = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in longs), F.lit(0))
    found = both.select("a", "b", differing.alias("d"), (F.col("a_n") + F.col("b_n")).alias("n"))
    return written(found.where(F.col("d") <= most_differing(F.col("n"), similarity)).select("a", "b", "d"))


def similar_roots(prints: DataFrame, docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the texts (column copy of :func:`sketches`) that have near copies.

    Where the sketches leave no doubt (three deviations) they decide, of other pairs the shingles: each text's nearest,
    where sure links don't connect it anyway. Then the same for all pairs that are still apart.
    """
    longs = ["fp", "n", *(f"s{k}" for k in range(SKETCH_LONGS)), *(f"p{k}" for k in range(PARITY_LONGS))]
    nodes = written(prints.groupBy("copy").agg(*(F.min(c).alias(c) for c in longs), F.min("keys").alias("keys"), F.min(F.struct("doc_id", "text_hash")).alias("rep")))
    pairs = written(_candidates(nodes, bits_between(similarity, 3)).distinct())
    links = pairs.where(F.col("d") <= bits_between(similarity, -3)).select("a", "b")
    doubtful = _apart(pairs.where(F.col("d") > bits_between(similarity, -3)), components(links))
    roots = components(links.union(_verified(_nearest(doubtful), nodes, docs, words, similarity)))
    rest = _rest(nodes, roots, similarity)
    for some in (_nearest, lambda pairs: pairs.select("a", "b")):
        if rest.isEmpty():
            break
        known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(known.union(_verified(some(rest), nodes, docs, words, similarity)))
        rest = _apart(rest, roots)
    return roots


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root) of every row with an id; rows of one root are near copies.

    Texts of equal words (A-Z lower-cased, white space aside) are one. Others link if their shingles of ``words``
    words have that Jaccard similarity. A text of fewer words is one shingle. Empty and null texts are one.
    Repeated rows come out repeated. Other columns are not read. An empty table gives an empty result.
    """
    known = docs.where(F.col(quoted(id_col)).isNotNull())
    prints = written(sketches(known, id_col, text_col, words, similarity))
    text = F.col(quoted(text_col))
    plain = known.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    roots = similar_roots(prints, plain, words, similarity)
    return prints.join(roots, prints["copy"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "copy").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies (:func:`similar_documents`), that of the least id, and all its columns.

    Of rows with the least id the one whose text has the least hash stays, so every group keeps one row also
    where ids repeat. Rows with a null id are kept and name nothing. An empty table stays empty.
    """
    own_id, own_text, row, stays_id, stays_text = free_names(docs, "id", "text_hash", "row", "stays_id", "stays_text")
    text_hash = F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    known = docs.where(F.col(quoted(id_col)).isNotNull()).withColumns({own_id: F.col(quoted(id_col)).cast("long"), own_text: text_hash})
    # equal (id, text) is one document; the limit of one row a group holds in each task before the shuffle
    first = Window.partitionBy(own_id, own_text).orderBy(own_id)
    single = known.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    stays = similar_documents(docs, id_col, text_col, words, similarity).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    stays = stays.select(F.col("x.doc_id").alias(stays_id), F.col("x.text_hash").alias(stays_text))
    kept = single.join(stays, (F.col(own_id) == F.col(stays_id)) & (F.col(own_text) == F.col(stays_text)), "left_semi")
    return kept.select(*columns_of(docs)).union(docs.where(F.col(quoted(id_col)).isNull()))
