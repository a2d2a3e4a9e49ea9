"""Cost-balanced packing of tokenised documents into training sequences.

A piece of n tokens costs n + n * n / capacity: the linear layers and its own attention.
Each task tokenises its documents, cuts full sequences off long ones, and packs the rest
in rounds of about a million tokens: in descending order of cost, a piece goes to the
cheapest sequence with room for it; where none has room, it is cut to fill the emptiest
one. A round makes only full sequences and carries what is left over into the next, so at
most one sequence of a task is padded. Partitions are put together, without a shuffle, until
tasks have some megabytes of text, so that this one sequence is a small part of them.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import give_back, pieces

#: Tokens that a round packs together, the words whose ids a worker remembers, and those whose ids it joins at once.
ROUND, REMEMBERED, BLOCK = 1 << 20, 700_000, 1 << 17
#: Bytes of text, and four for each row, that a task has at least, on average: some 500 sequences, of which one is padded.
TASK_BYTES = 4 << 20
END = np.array([1], "<u4").tobytes()


def _plain() -> str:
    """Characters that composition leaves alone, one lower case each, no odd white space."""
    spans = [(0x21, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
    return "".join(chr(c) for a, b in spans for c in range(a, b + 1) if c != 0x130)


def _kind(letter: str) -> str:
    return re.escape("".join(c for c in _plain() if unicodedata.category(c)[0] == letter))


class Known:
    """Strings and the ids of each, in a few Arrow and numpy arrays: some 45 bytes a word, which a dict takes many times.

    A word is found by its hash, in order of which the numbers of words lie, and then compared itself.
    """

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.hashes, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, "<u4")

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 where it is unknown."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.searchsorted(self.hashes, np.fromiter(map(hash, words), np.int64, len(words)))
        number = self.numbers[np.minimum(at, len(self.hashes) - 1)]
        same = pc.equal(self.words.take(pa.array(number)), pa.array(words, pa.string()))
        return np.where(same.to_numpy(zero_copy_only=False), number, -1)

    def get(self, n: int) -> bytes:
        return self.ids[self.ends[n] : self.ends[n + 1]].tobytes()

    def add(self, words: dict[str, bytes]) -> None:
        """Remember the ids of words that are not known; they are numbered on in their order."""
        size = np.fromiter((len(x) // 4 for x in words.values()), np.int64, len(words))
        key = np.fromiter(map(hash, words), np.int64, len(words))
        order = np.argsort(key)
        at = np.searchsorted(self.hashes, key[order])
        self.hashes = np.insert(self.hashes, at, key[order])
        self.numbers = np.insert(self.numbers, at, order + len(self.words))
        self.words = pa.concat_arrays([self.words, pa.array(list(words), pa.string())])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(words.values()), "<u4")])

    def joined(self, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of words by their numbers, in a row, and where each begins and the last ends."""
        size = self.ends[at + 1] - self.ends[at]
        stop = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        parts = []
        for n in range(0, len(at), BLOCK):
            some, length = at[n : n + BLOCK], size[n : n + BLOCK]
            shift = np.repeat(self.ends[some] - stop[n : n + len(some)], length)
            parts.append(self.ids[np.arange(stop[n], stop[n] + len(shift)) + shift].tobytes())
        return b"".join(parts), stop


class WordTokenizer:
    """Ids of whole texts by the tokenizer file, with the ids of words remembered.

    Its pre-tokenizer cuts at a fixed pattern and no merge crosses a cut, so the ids of a
    text are those of its words in a row. Texts with unusual characters or special tokens
    go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known()
        white = r"\t\n\x0b\x0c\r "
        self.simple = re.compile(f"[{white}{re.escape(_plain())}]*").fullmatch
        letters, numbers = _kind("L"), _kind("N")
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+"
        ).findall

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens."""
        out: dict[str, bytes] = {}
        for n in range(0, len(words), 4000):
            some = words[n : n + 4000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            word = np.array(got.word_ids)
            if len(word) and np.array_equal(np.unique(word), np.arange(len(some))):
                raw = np.array(got.ids, "<u4").tobytes()
                at = (np.searchsorted(word, np.arange(len(some) + 1)) * 4).tolist()
                out.update((w, raw[i:j]) for w, i, j in zip(some, at, at[1:]))
            else:
                out.update((w, self.whole(w)) for w in some)
        return out

    def meet(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words, as written between white space; new ones are remembered, with their pre-tokens."""
        known, at = self.known, self.known.find(words)
        new = [words[n] for n in np.flatnonzero(at < 0)]
        if new:
            cut = list(map(self.words, new))
            parts = list({x for pre in cut for x in pre})
            there = known.find(parts).tolist()
            ids = {x: known.get(n) for x, n in zip(parts, there) if n >= 0}
            more = self.learn([x for x, n in zip(parts, there) if n < 0])
            ids |= more
            # A word of one pre-token is among these.
            more |= {w: b"".join([ids[x] for x in pre]) for w, pre in zip(new, cut) if len(pre) != 1}
            number = dict(zip(more, range(len(known.words), len(known.words) + len(more))))
            known.add(more)
            at[at < 0] = [number[w] for w in new]
        return at

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known.words) > REMEMBERED:
            self.known = Known()
        simple = [bool(self.simple(t)) and "<|" not in t for t in texts]
        rows = pc.ascii_split_whitespace(pa.array([t.lower() for t, s in zip(texts, simple) if s], pa.string()))
        words = rows.values.dictionary_encode()
        raw, stop = self.known.joined(self.meet(words.dictionary.to_pylist())[words.indices.to_numpy()])
        at = (stop[rows.offsets.to_numpy()] * 4).tolist()
        cut = iter(zip(at, at[1:]))
        return [raw[slice(*next(cut))] if s else self.whole(t) for t, s in zip(texts, simple)]


_workers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


class Packer:
    """Packs pieces of one task; ``out`` collects (doc, start, length, ids, crc, tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.rest: list[tuple[int, int, int, int]] = []
        self.left = 0
        self.docs: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.capacity
        for s in range(0, whole, self.capacity):
            self.place(doc, ids, n, s, self.capacity, self.next, 0)
            self.next += 1
        if n > whole:
            self.docs.append((doc, ids, n))
            self.rest.append((len(self.docs) - 1, whole, n - whole))
            self.left += n - whole
            if self.left >= ROUND:
                self.round(self.left // self.capacity)

    def place(self, doc, ids: bytes, n: int, s: int, length: int, sequence: int, offset: int) -> None:
        piece = ids[4 * s : 4 * (s + length)]
        self.out.append((doc, s, length, piece, zlib.crc32(piece), n, sequence, offset))

    def round(self, count: int) -> None:
        """Fill ``count`` sequences; pieces beyond their room stay for the next round."""
        size = self.capacity
        cost, room = np.zeros(count), np.full(count, size)
        todo = sorted(self.rest, key=lambda p: (-p[2], p[0]))
        later, space = [], count * size
        for d, s, length in todo:
            while length and space:
                fits = np.flatnonzero(room >= length)
                at = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
                part = min(length, int(room[at]))
                self.place(*self.docs[d], s, part, self.next + at, size - int(room[at]))
                cost[at] += part + part * part / size
                room[at] -= part
                space -= part
                s, length = s + part, length - part
            if length:
                later.append((d, s, length))
        self.next += count
        self.docs = [self.docs[d] for d, _, _ in later]
        self.rest = [(k, s, length) for k, (_, s, length) in enumerate(later)]
        self.left = sum(p[2] for p in self.rest)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


SCHEMA = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(path: str, capacity: int):
    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = dict(zip(names, list(zip(*rows)) or [()] * len(names)))
        ends = np.cumsum([0, *columns["length"]], dtype="<i4")
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(columns["ids"]), "<i4")))
        return pa.RecordBatch.from_arrays([ids if k == "ids" else pa.array(c, pa.int64()) for k, c in columns.items()], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = tokenizer(path), Packer(capacity, TaskContext.get().partitionId() << 33)
        for b in pieces(batches, "text"):
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for doc, ids in zip(docs, tok.encode([t or "" for t in texts])):
                packer.add(doc, ids + END)
            yield table(packer.taken())
            # Small objects between those that stay would hold some 100 MB by the task's end.
            give_back()
        if packer.left:
            packer.round(packer.left // capacity)
        if packer.left:
            packer.round(1)
        yield table(packer.taken())

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's tokens; those of a sequence in order of ``offset`` are its training text.

    A document is the ids of its text by the tokenizer at ``path`` and then id 1; a null or
    empty text is that id alone. Every row is packed, also repeated rows and rows of a null
    id. Every id lies in one piece, sequences hold at most ``capacity`` ids without gaps, and
    ``sequence_id`` is unique over all tasks. Texts of any length are packed whole; a task
    holds the ids of one text and of a round at a time. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # A row is a token at least, also without a text, and a token some four bytes.
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 4)).first()[0] or 0
    # No effect where there are fewer partitions already.
    return rows.coalesce(max(1, math.ceil(size / TASK_BYTES))).mapInArrow(_packed(path, capacity), SCHEMA)
