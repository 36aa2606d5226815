"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every document has a sparse ternary index vector, made of its text's hash; the
vector of a token (of its bucket: tokens are hashed) is the sum of the index vectors of the documents
it occurs in, over the whole corpus, scaled to length 1.  Sums of integers come out the same in any
order.  A document is pooled as the mean of its tokens' vectors and, for each of LAGS, the mean of the
products of the vectors of tokens so far apart, number by number: for equal tokens these are squares.
The network's logits are divided by a temperature fitted on labelled rows that it wasn't trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, process_cache, small_batches

#: Buckets of tokens, numbers in a vector, and how many of an index vector's are drawn.
BUCKETS, SIZE, NONZERO = 32_768, 64, 8
LAGS = (1, 2, 3)
WIDTH = SIZE * (1 + len(LAGS))
#: Bound of the labelled sample.
LABELLED = 8192
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.02, 5e-3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
REMEMBERED = 200_000
#: Tokens of a text whose vectors are held at a time.
HELD_TOKENS = 1 << 16


class Tokens(dict):
    """token -> its bucket."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[token] = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
        return out


def document_tokens(text: str | None, memory: Tokens) -> np.ndarray:
    """The buckets of a text's tokens, in order."""
    return np.array(list(map(memory.__getitem__, TOKEN.findall(text or ""))), np.int64)


def index_vector(text: str | None) -> np.ndarray:
    """int32, SIZE: the sum of NONZERO entries of 1 or -1 at places that the text's hash draws."""
    import xxhash

    h = xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace"), 20)
    out = np.zeros(SIZE, np.int32)
    for i in range(NONZERO):
        out[(h >> 6 * i) % SIZE] += 1 if h >> 48 + i & 1 else -1
    return out


def _memory() -> Tokens:
    return process_cache("quality:tokens", Tokens)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((BUCKETS, SIZE), np.int32)
    for batch in batches:
        for x in batch.column(0):
            text = x.as_py()
            sums[np.unique(document_tokens(text, _memory()))] += index_vector(text)
    used = np.flatnonzero(sums.any(axis=1))
    for at in range(0, len(used), 2048):
        own = used[at : at + 2048]
        values = pa.FixedSizeListArray.from_arrays(pa.array(sums[own].ravel()), SIZE).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), values], ["bucket", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """float32, BUCKETS x SIZE: unit vectors by random indexing over all texts; zero for unused buckets.

    Tasks return one row per bucket; the driver gets BUCKETS rows at most.
    """
    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(_accumulate, "bucket int, sums array<int>")
    found = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(SIZE)]).alias("sums")).toArrow()
    out = np.zeros((BUCKETS, SIZE), np.float32)
    for batch in found.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).flatten().to_numpy().reshape(-1, SIZE)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def pool(text: str | None, vectors: np.ndarray, memory: Tokens) -> np.ndarray:
    """float32, WIDTH: the mean of the tokens' vectors, then for each lag the sum of products over the
    number of tokens.  Zero without tokens."""
    found = document_tokens(text, memory)
    out = np.zeros((1 + len(LAGS), SIZE), np.float32)
    for at in range(0, len(found), HELD_TOKENS):
        # the tokens before it that lags reach back to come along
        back = min(at, max(LAGS))
        x = vectors[found[at - back : at + HELD_TOKENS]]
        out[0] += x[back:].sum(axis=0)
        for i, lag in enumerate(LAGS, 1):
            first = max(back, lag)
            out[i] += np.einsum("ij,ij->j", x[first:], x[first - lag : len(x) - lag])
    return out.ravel() / np.float32(max(1, len(found)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, -np.where(y > 0, logits, -logits))))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss between 1/4 and 16, by golden-section search on its logarithm."""
    low, high, part = np.log(0.25), np.log(16.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        if _loss(logits / np.exp(a), y) < _loss(logits / np.exp(b), y):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss plus half of DECAY times the squares of the two layers' weights, by back propagation."""
    hidden = np.tanh(x @ params[0] + params[1])
    error = (_sigmoid(hidden @ params[2] + params[3][0]) - y) / len(y)
    back = np.outer(error, params[2]) * (1 - hidden**2)
    return [x.T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ error + DECAY * params[2], np.array([error.sum()])]


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Train on four of five rows and calibrate on the fifth.  With one class or none: its share, shrunk."""
    rng = np.random.default_rng(7)
    x = np.array(x, np.float64).reshape(-1, WIDTH)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    net = Network(mean, scale, rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if len(set(y.tolist())) < 2:
        return net
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart].tolist())) < 2:
        apart[:] = False
    # standardised in place: the rows are the largest thing that the driver holds
    x -= mean
    x /= scale
    tx, ty = x[~apart], y[~apart]
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, EPOCHS + 1):
        for p, g, m, v in zip(params, gradients(params, tx, ty), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    net.b2 = float(params[3][0])
    if apart.any():
        net.temperature = fit_temperature(np.tanh(x[apart] @ net.w1 + net.b1) @ net.w2 + net.b2, y[apart])
    return net


@dataclass
class Scorer:
    vectors: np.ndarray
    network: Network

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; that of the zero vector for null and empty ones."""
        every = [pool(x.as_py(), self.vectors, _memory()) for x in texts]
        return self.network.probability(np.array(every, np.float64).reshape(-1, WIDTH))


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Word vectors from all of ``docs`` (doc_id, text); the network from a sample of labelled rows.

    The sample is the LABELLED ids with the least hashes among ``labels`` (doc_id, quality 0 or 1;
    other values are passed over) whose crc32(doc_id) mod 3 is not 1.  An id with both labels
    counts as 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = word_vectors(rows)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [pool(x.as_py(), vectors, _memory()).tolist() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, pa.list_(pa.float32()))], ["doc_id", "quality", "vector"])

    # LABELLED rows of two numbers at most are broadcast
    found = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, vector array<float>")
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("vector").alias("vector"))
    # by Arrow: lists of numbers would take many times the memory of the driver
    got = found.select("quality", "vector", F.xxhash64("doc_id", F.lit(9)).alias("h")).toArrow().sort_by("h")
    x = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in got.column("vector").chunks)]).reshape(-1, WIDTH)
    return Scorer(vectors, fit(x, got.column("quality").to_numpy().astype(np.float64)))


def classify(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for column ``text``; other columns pass through."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer.probabilities(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    The score is the probability of label 1; empty and null texts get that of the zero vector.
    Without labels every score is 0.5.  Texts are pooled whole, HELD_TOKENS at a time.  Repeated rows
    and null ids are kept.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = classify(rows, learn(docs, labels)).drop("text")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
