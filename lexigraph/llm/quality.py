"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed features: words, pairs of neighbouring words, a mark for a
word that repeats the one before, and n-grams of characters that mark the words' edges. A softmax over two classes
reads the mean. Vectors and output are trained by stochastic gradient descent in numpy, STEPS rows one after the other
whatever the sample's size, on a bounded sample of labelled rows, equally many of each class; the output is then
shifted to the classes' true frequencies.

The mean and the output are linear, so a feature's vector enters a score only as the difference it makes to the two
outputs. Scoring uses that table of one number per bucket, whose size is fixed and which every executor gets.

Null texts are empty; a document without features scores what its class frequencies say. Without labels all score 0.5.
Repeated rows score alike, an empty table gives an empty result, a very long text is scored whole as a block of its own.
Columns other than the id and the text are not read; ``kept`` returns them as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import term_hashes as H
from lexigraph.llm.blocks import sliced, texts
from lexigraph.llm.labelled import held_out, training_rows
from lexigraph.llm.scratch import table

BITS = 18
SIZES = (3, 4, 5)
REPEATED = 1
#: Documents of each class that the model is fitted on, at most.
PER_CLASS = 2500
#: Rows that training goes through, again and again in new orders.
STEPS = 20_000


def features(block: H.Bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each kind of feature, by place, and where each text's begin among them, one more at the end."""
    shift64, shift32 = np.uint64(64 - BITS), np.uint32(32 - BITS)
    starts, ends = block.words(~H.SPACES)
    words = H.word_hashes(block.data, starts, ends)
    yield (words >> shift64).astype(np.int64), block.bounds(starts)
    if len(words) > 1:
        of = block.of(starts)
        near = np.flatnonzero(of[1:] == of[:-1])
        pairs = H.mixed(words[near] * np.uint64(3) + words[near + 1])
        yield (pairs >> shift64).astype(np.int64), block.bounds(starts[near + 1])
        again = near[words[near] == words[near + 1]]
        yield np.full(len(again), REPEATED), block.bounds(starts[again + 1])
    points, begins = block.characters()
    for grams, places in H.ngram_hashes(points, SIZES):
        yield (grams >> shift32).astype(np.int64), np.searchsorted(places, begins)


@dataclass
class Model:
    weights: np.ndarray  # by bucket: what the feature adds to the log-odds of label 1
    bias: float

    def scores(self, rows: list[str]) -> np.ndarray:
        out = []
        for data in H.blocks(rows):
            block = H.Bytes(data)
            sums, counts = np.zeros(len(data)), np.zeros(len(data), np.int64)
            for buckets, bounds in features(block):
                totals = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
                sums += np.diff(totals[bounds])
                counts += np.diff(bounds)
            odds = self.bias + sums / np.maximum(counts, 1)
            out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        return np.round(np.concatenate(out), 6) if out else np.zeros(0)


def fit(rows: list[str], labels: list[int], counts: dict[int, int], dim: int = 8, steps: int = STEPS, rate: float = 0.4, seed: int = 6) -> Model:
    """Train on ``rows``; ``counts`` has how often each label occurs in all."""
    size = 1 << BITS
    if len(set(labels)) < 2:
        n = sum(counts.values())
        return Model(np.zeros(size, np.float32), float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))) if n else 0.0)
    at, buckets_, shares_ = [0], [], []  # of all rows in a row: thousands of small arrays would stay with the driver
    for k in range(0, len(rows), 256):
        part = []
        for row in rows[k : k + 256]:
            block = H.Bytes([row.encode("utf-8", "surrogatepass")])
            buckets, n = np.unique(np.concatenate([b for b, _ in features(block)]), return_counts=True)
            part.append((buckets.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
            at.append(at[-1] + len(buckets))
        buckets_.append(np.concatenate([b for b, _ in part]))
        shares_.append(np.concatenate([n for _, n in part]))
    all_buckets, all_shares = np.concatenate(buckets_), np.concatenate(shares_)
    del buckets_, shares_
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    output = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    order = np.zeros(0, np.int64)
    for step in range(steps):
        if step % len(rows) == 0:
            order = rng.permutation(len(rows))
        i = order[step % len(rows)]
        buckets, shares = all_buckets[at[i] : at[i + 1]], all_shares[at[i] : at[i + 1]]
        now = rate * (1 - step / steps)
        mean = shares @ vectors[buckets]
        odds = output @ mean + bias
        p = np.exp(odds - odds.max())
        error = p / p.sum()
        error[labels[i]] -= 1
        back = error @ output
        output -= now * np.outer(error, mean)
        bias -= now * error
        # The mean is over thousands of features: its gradient reaches each by its share, made up for by their number.
        vectors[buckets] -= (now * len(buckets)) * np.outer(shares, back)
    sampled = np.bincount(labels, minlength=2)
    shift = np.log(counts[1] / counts[0]) - np.log(sampled[1] / sampled[0])
    difference = output[1] - output[0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0] + shift))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*training_rows(docs, labels, "quality", per_class, seed=6))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score, the probability of label 1, of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(texts(batch.column("__text"))))], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text")).mapInArrow(run, f"doc_id {kind}, score double")


def kept(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array(own.scores(texts(batch.column(text))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
