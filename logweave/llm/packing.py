"""Operator 1: cost-balanced packing of token sequences.

Every document is tokenised where it is read and packed there: a task reads its share of the
documents once, keeps a bounded block of them, and hands out finished pieces. There is no shuffle,
nothing is gathered on the driver, and a lost task repeats only its own share. Sequence ids carry the
number of the partition, so tasks need not agree on anything.

A block is packed so: the attention cost of a piece of n tokens is ``linear * n + quadratic * n**2``;
pieces go in descending order of cost, each to the sequence of the lowest cost so far that still has
room for it. A block opens exactly as many sequences as its tokens fill. Pieces that fit nowhere are
then cut to fill the gaps, and what is left over (less than one sequence) opens the next block.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import TEXT_ROWS, arrow_batches, quoted, text_slices

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 21
LINEAR = 1.0
QUADRATIC = 1.0 / 4096
CACHED_WORDS, KEPT_WORDS = 1_000_000, 250_000  # within a task, from one to the next
WORD_END = "</w>"
SIGNS = b".,;:!?*%$&#"
#: A special token may begin, or a combining mark (with which lower-casing and composing don't commute).
DELICATE = (b"<|", b"\xcc", b"\xcd")

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Index(dict):
    """Numbers of words; a word that is not there yet gets the next number and is noted in ``new``."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


class WordTokenizer:
    """Token ids of texts, word by word, with a bounded cache of words.

    The vocabulary's rules never look across white space (it is squeezed, then dropped, and no rule
    spans it), so a text's ids are those of its words one after the other. Texts are cut at spaces and
    line feeds only; any other white space stays inside a word and is left to the tokenizer. Letters come
    lower-cased, as the tokenizer would make them, except in a text that may hold a special token or combining marks. Signs
    at the end of a word are a piece of their own to the tokenizer, so such words are made of two others.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        dict.update(self.index, {b"\n": 0, b"": 1})  # the end of a document, and what lies between two spaces
        self.flat, self.used = np.full(1 << 16, self.end_id, np.uint32), 1
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.sizes[0] = 1

    def put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Note the ids of words, given one after the other."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, where each word's end)."""
        sizes = self.sizes[numbers]
        upto = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - (upto - sizes), sizes) + np.arange(upto[-1])], upto

    def learn(self) -> None:
        """Ids for the words that are new since the last call."""
        new, single, other, made = self.index.new, [], [], []
        for word in new:  # grows on the way
            stem = word.rstrip(SIGNS)
            if stem and len(stem) < len(word) and stem[-1:].isalnum():
                made.append((self.index[word], self.index[stem], self.index[word[len(stem) :]]))
            elif word.isalpha() or (text := word.decode("utf-8")).isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                single.append(word)
            else:
                other.append(word)
        while len(self.index) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        for s in range(0, len(single), 1000):
            words = single[s : s + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(words).decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words):  # words of letters are one piece each
                self.put(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)), np.diff(ends, prepend=0), ids)
            else:
                other += words
        if other:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in other], add_special_tokens=False)]
            self.put(np.fromiter(map(self.index.__getitem__, other), np.int64, len(other)), np.fromiter(map(len, encoded), np.int64, len(encoded)), np.fromiter((k for e in encoded for k in e), np.uint32))
        if made:
            numbers = np.array(made, np.int64)
            ids, _ = self.get(numbers[:, 1:].ravel())
            self.put(numbers[:, 0], self.sizes[numbers[:, 1:]].sum(axis=1), ids)
        new.clear()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text its ids and the end id."""
        if len(self.index) > CACHED_WORDS or self.used > 8 * CACHED_WORDS:
            self.clear()
        words: list[bytes] = []
        ends = []
        for text in texts:
            if not any(x in text for x in DELICATE):
                text = text.lower()
            words += text.replace(b"\n", b" ").split(b" ")
            words.append(b"\n")
            ends.append(len(words))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self.learn()
        ids, upto = self.get(at)
        return np.split(ids, upto[np.array(ends) - 1][:-1])


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def word_tokenizer(path: str | None, end_id: int) -> WordTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


class Packer:
    """Packs (document, ids) into sequences; :meth:`add` and :meth:`finish` return finished pieces.

    A piece is (document, start, ids, tokens of the document, sequence, offset).
    """

    def __init__(self, capacity: int, block_tokens: int, linear: float, quadratic: float, first_sequence: int = 0):
        self.capacity, self.block_tokens = capacity, max(block_tokens, capacity)
        self.linear, self.quadratic = linear, quadratic
        self.next, self.pool, self.pooled = first_sequence, [], 0

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        done, total, at = [], len(ids), 0
        while total - at >= self.capacity:
            done.append((doc, at, ids[at : at + self.capacity], total, self.next, 0))
            self.next += 1
            at += self.capacity
        if at < total:
            self.pool.append((doc, at, ids[at:], total))
            self.pooled += total - at
        if self.pooled >= self.block_tokens:
            done += self.pack()
        return done

    def finish(self) -> list[tuple]:
        done = self.pack()
        left = self.pooled
        while left:  # the rest of the share: sequences of powers of two, which need no padding
            size = 1 << (left.bit_length() - 1)
            done += self.fill(self.next, 0, size)
            self.next += 1
            left -= size
        return done

    def fill(self, sequence: int, offset: int, room: int) -> list[tuple]:
        """Take ``room`` tokens from the end of the pool, cutting its last piece if need be."""
        done = []
        while room:
            doc, start, ids, total = self.pool.pop()
            if len(ids) > room:
                self.pool.append((doc, start + room, ids[room:], total))
                ids = ids[:room]
            done.append((doc, start, ids, total, sequence, offset))
            offset, room, self.pooled = offset + len(ids), room - len(ids), self.pooled - len(ids)
        return done

    def pack(self) -> list[tuple]:
        count = self.pooled // self.capacity
        if not count:
            return []
        pieces = sorted(self.pool, key=lambda p: -self.cost(len(p[2])))
        costs, room = np.zeros(count), np.full(count, self.capacity, np.int64)
        done, self.pool = [], []
        for doc, start, ids, total in pieces:
            n = len(ids)
            at = int(np.argmin(np.where(room >= n, costs, np.inf)))
            if room[at] < n:
                self.pool.append((doc, start, ids, total))
                continue
            done.append((doc, start, ids, total, self.next + at, self.capacity - int(room[at])))
            room[at] -= n
            costs[at] += self.cost(n)
            self.pooled -= n
        for at in np.argsort(costs, kind="stable"):
            if room[at]:
                done += self.fill(self.next + int(at), self.capacity - int(room[at]), int(room[at]))
        self.next += count
        return done


def _record(pieces: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*pieces)
    columns = [doc, start, [len(x) for x in ids], total, sequence, offset, [x.astype("<u4", copy=False).tobytes() for x in ids]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens; one row per piece, with its token ids.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).
    A null or empty text is the end id alone. A null id stays null; rows that repeat an id are packed as
    documents of their own. Other columns of ``docs`` are not read. An empty table gives no pieces.
    """

    arrow_batches(docs.sparkSession, TEXT_ROWS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer_path, end_id)
        packer = Packer(capacity, block_tokens, linear, quadratic, TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in text_slices(batch, 1):
                done = []
                for k, doc in enumerate(tokens.encode(texts)):
                    done += packer.add(ids[at + k], doc)
                for k in range(0, len(done), 2000):
                    yield _record(done[k : k + 2000])
        if len(tokens.index) > KEPT_WORDS:
            tokens.clear()
        done = packer.finish()
        for k in range(0, len(done), 2000):
            yield _record(done[k : k + 2000])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(pack, DDL)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
