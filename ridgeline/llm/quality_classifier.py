"""Quality classifier: supervised subword embeddings (numpy) scored over whole texts.

Features are hashed words, pairs of words, and character n-grams of words with their boundaries. Each has a
learned vector; a document is the average of its features' vectors, and a softmax layer reads
it. Training is plain stochastic gradient descent on the driver, over the feature counts of a
bounded sample of labelled documents; texts stay in the tasks that count. As the output layer
is linear, a feature's vector reduces to one number for scoring, so a task adds up one table
entry for each feature of the text and divides by their count.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import give_back, materialize, pieces
from ._text import mix

BITS, DIM, GRAMS = 18, 16, (3, 4, 5)
#: Most labelled documents to learn from, those of the smallest hashes of their ids.
SAMPLE = 8000
#: Most feature counts of all of them together (8 bytes each on the driver); documents beyond it are left out.
FEATURES = 12_000_000
EPOCHS, RATE, BATCH = 4, 10.0, 8
#: Characters that a task turns into features at once.
RUN = 400_000
_WHITE = re.compile(r"[\x20\x09-\x0d]")
_U = np.uint64
_BASE = _U(0x9E6C63D0876A9A6D)


def _runs(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and pieces of texts, about ``RUN`` characters at a time; long texts part at white space."""
    numbers, parts, size = [], [], 0
    for n, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = _WHITE.search(text, at + RUN) if len(text) - at > RUN else None
            end = cut.start() if cut else len(text)
            numbers.append(n), parts.append(text[at:end])
            size, at = size + end - at + 1, end
            if size >= RUN:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def features(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pieces of the batch: bucket numbers and, for each, the text it belongs to."""
    for numbers, part in _runs(texts):
        raw = "".join([" ", *(t + " " for t in part)]).encode("utf-32-le", "replace")
        chars = np.frombuffer(raw, "<u4").astype(_U)
        white = (chars == 32) | ((chars >= 9) & (chars <= 13))
        chars[white] = 32
        doc = np.repeat(numbers, [len(t) + 1 for t in part])
        # Features belong to the text of their second character, so boundaries count with it.
        yield from _grams(chars, white, doc, bits)
        begin = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        if len(begin):
            end = np.flatnonzero(~white[:-1] & white[1:]) + 1
            place = np.arange(len(chars), dtype=_U) - np.repeat(
                np.concatenate([[0], begin]).astype(_U), np.diff(np.concatenate([[0], begin, [len(chars)]]))
            )
            value = mix(chars + place * _BASE)
            value[white] = 0
            total = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])
            word, at = mix(total[end] - total[begin]), doc[begin - 1]
            yield (word >> _U(64 - bits)).astype(np.int64), at
            both = np.flatnonzero(at[1:] == at[:-1])
            yield (mix(word[both] * _BASE + word[both + 1]) >> _U(64 - bits)).astype(np.int64), at[both]


def _grams(chars, white, doc, bits):
    rolling = chars
    inner = np.zeros(len(chars), bool)
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:-1] * _BASE + chars[n - 1 :]
        # Interior characters are 1 .. n - 2.
        inner = inner[:-1] | white[n - 2 : -1] if n > 2 else np.zeros(len(rolling), bool)
        if n in GRAMS:
            at = np.flatnonzero(~inner)
            at = at[at < len(doc)]
            yield (((rolling[at] + _U(n)) * _U(0xD6E8FEB86659FD93)) >> _U(64 - bits)).astype(np.int64), doc[at]


@dataclass
class Model:
    """What each feature adds to the log-odds of label 1, before averaging; and the bias."""

    table: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; the bias alone for a text without features."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, doc in features(texts, self.bits):
            total += np.bincount(doc, self.table[bucket], len(texts))
            count += np.bincount(doc, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def bags(texts: list[str], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text, and their shares of its features."""
    size, out = 1 << bits, []
    for n, text in enumerate(texts):
        parts = [np.unique(b, return_counts=True) for b, _ in features([text], bits)]
        key = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.int64)])
        total = np.bincount(key, np.concatenate([c for _, c in parts] or [np.zeros(0)]), size) if len(key) else np.zeros(0)
        bucket = np.flatnonzero(total)
        out.append((bucket.astype(np.int32), (total[bucket] / max(1, total.sum())).astype(np.float32)))
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 5) -> Model:
    """Learn feature vectors and the output layer by stochastic gradient descent over ``bags``."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    y = np.eye(2, dtype=np.float32)[np.asarray(labels, int)] if labels else np.zeros((0, 2), np.float32)
    steps, done = max(1, EPOCHS * len(docs)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for n in range(0, len(order), BATCH):
            some = order[n : n + BATCH]
            rate = RATE * (1 - done / steps)
            hidden = np.stack([docs[k][1] @ vectors[docs[k][0]] for k in some])
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - y[some]) / len(some)
            back = g @ out.T
            out -= rate * hidden.T @ g
            bias -= 0.1 * rate * g.sum(0)
            for k, b in zip(some, back):
                vectors[docs[k][0]] -= (rate * len(some) * docs[k][1])[:, None] * b
            done += len(some)
    table = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return Model(table, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> Model:
    """Learn from at most ``sample`` documents that have a label; ``labels`` has ``doc_id, label``.

    The sample is of the smallest hashes of the ids in both tables. Repeated labels of an id
    count once (the largest), as do repeated rows of an id (the largest text); null ids and
    labels are left out. Without any labelled document, every text scores one half.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    # At most ``sample`` rows of two numbers.
    chosen = F.broadcast(known.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = text.join(chosen, "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "label")).alias("x"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = bags(b.column("text").to_pylist())
            data = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *data], ["doc_id", "label", "bucket", "share"])

    made = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("x.label").cast("int").alias("label"), "x.text")
    made = made.mapInArrow(counted, "doc_id long, label int, bucket binary, share binary")
    made = materialize(made)
    # Of bounded rows, those of the smallest hashes whose features fit together.
    order = made.select("doc_id", (F.octet_length("bucket") / 4).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fit_in = [r.doc_id for r, total in zip(order, itertools.accumulate(r.n for r in order)) if total <= FEATURES]
    if len(fit_in) < len(order):
        made = made.join(F.broadcast(spark.createDataFrame([(i,) for i in fit_in], "doc_id long")), "doc_id")
    found = sorted((r.doc_id, r.label, bytes(r.bucket), bytes(r.share)) for r in made.toLocalIterator())
    model = train([(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for _, _, b, s in found], [y for _, y, _, _ in found])
    # The driver keeps freed memory otherwise, for all stages to come.
    del found
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, of the whole text.

    A null text counts as empty and scores by the bias alone; repeated rows and null ids
    are scored like any other, and texts of any length are read whole. An empty table gives
    an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            got = shared.value.score([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns.

    Null and empty texts score by the bias alone; repeated rows are each judged, and an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            got = shared.value.score([t or "" for t in b.column(text_col).to_pylist()])
            yield b.filter(pa.array(got >= least))

    return docs.mapInArrow(run, docs.schema)
