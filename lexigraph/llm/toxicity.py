"""Toxicity: a factorization machine over hashed terms.

Terms are the 64-bit hashes of lower-case words and of their first four and five bytes, present or not in a document.
The log-odds are a sum of term weights and of the inner products of the factors of all pairs of present terms, so the
pair of an insult and a group's name can weigh more than both alone. All terms of the sample have a weight and factors,
in a table of bounded size. Weights are trained by follow-the-regularised-leader with an L1 penalty that is the larger
the less a term's presence depends on the label; the pairs of a text count in proportion to SHORT over its number of
terms, and factors shrink. So long documents gather little noise, and no term or pair is ruled out beforehand.

Null texts are empty. Without labels of both classes the score is the classes' smoothed frequency. Repeated rows score
alike, an empty table gives an empty result, a very long text is scored whole as a block of its own. Columns other than
the id and the text are not read, whatever their names.
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

PREFIXES = (4, 5)
#: Documents of each class that the model is fitted on, at most.
PER_CLASS = 3000
#: Terms share the buckets of a table of 2 ** TABLE_BITS; factors up to TINY count as none.
TABLE_BITS, TINY = 22, 1e-3
#: G statistic of a term from which its weight has the least penalty; terms of a text from which its pairs count less.
RELEVANCE, SHORT = 24.0, 10


def lowered(rows: list[str]) -> list[str]:
    return [x.lower() for x in rows]


def terms(block: H.Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the terms and the text of each."""
    starts, ends = block.words(H.LETTERS)
    of = block.of(starts)
    found, texts_ = [H.word_hashes(block.data, starts, ends)], [of]
    for n in PREFIXES:
        long = ends - starts > n
        found.append(H.word_hashes(block.data, starts[long], ends[long], n, salt=n))
        texts_.append(of[long])
    return (np.concatenate(found) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.concatenate(texts_)


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray  # terms x rank
    bias: float

    def __post_init__(self):
        self.place = np.full(1 << TABLE_BITS, -1, np.int32)
        self.place[self.buckets] = np.arange(len(self.buckets))

    def present(self, block: H.Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair of a text and a known term in it, once, and the number of terms of each text."""
        buckets, of = terms(block)
        of, buckets = np.divmod(np.unique(of << TABLE_BITS | buckets), 1 << TABLE_BITS)
        at = self.place[buckets]
        return of[at >= 0], at[at >= 0], np.bincount(of, minlength=len(block.starts) - 1)

    def scores(self, rows: list[str]) -> np.ndarray:
        out = []
        for data in H.blocks(lowered(rows)):
            of, term, sizes = self.present(H.Bytes(data))
            odds = self.bias + np.bincount(of, self.weights[term], len(data))
            share = np.minimum(1.0, SHORT / np.maximum(1, sizes))
            for factor in self.factors.T:
                total = np.bincount(of, factor[term], len(data))
                odds += 0.5 * share * (total**2 - np.bincount(of, factor[term] ** 2, len(data)))
            out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        return np.round(np.concatenate(out), 6) if out else np.zeros(0)


def dependence(at: np.ndarray, sizes: list[int], labels: np.ndarray, terms_: int) -> np.ndarray:
    """The G statistic of each term's presence and the label; ``at`` has the terms of the texts in turn."""
    label = np.repeat(labels, sizes)
    total, g = np.bincount(labels, minlength=2), np.zeros(terms_)
    n = np.bincount(at, minlength=terms_)
    for c in (0, 1):
        k = np.bincount(at[label == c], minlength=terms_)
        for seen, expected in ((k, n * total[c] / total.sum()), (total[c] - k, (total.sum() - n) * total[c] / total.sum())):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(seen > 0, 2 * seen * np.log(seen / expected), 0.0)
    return g


def fit(
    rows: list[str],
    labels: list[int],
    counts: dict[int, int],
    rank: int = 4,
    epochs: int = 30,
    rate: float = 1.0,
    l1: float = 0.3,
    l2: float = 0.01,
    seed: int = 8,
) -> Model:
    """Train on ``rows``; ``counts`` has how often each label occurs in all."""
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank), np.float32)
    if len(set(labels)) < 2:
        return Model(*none, float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))))
    found = [np.unique(terms(H.Bytes([x.encode("utf-8", "surrogatepass")]))[0]) for x in lowered(rows)]
    buckets, at = np.unique(np.concatenate(found), return_inverse=True)
    sizes = [len(x) for x in found]
    index = np.split(at, np.cumsum(sizes)[:-1])
    # No term is left out: the less its presence alone tells of the label, the more evidence its weight needs.
    l1_of = l1 * np.maximum(1.0, RELEVANCE / np.maximum(dependence(at, sizes, np.array(labels), len(buckets)), 1e-9))

    rng = np.random.default_rng(seed)
    size = len(buckets)
    z, squares, w = np.zeros(size), np.zeros(size), np.zeros(size)
    v, v_squares = rng.normal(0, 0.01, (size, rank)), np.ones((size, rank))
    bias, bias_squares = 0.0, 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = index[i]
            own = v[x]
            total = own.sum(0)
            share = min(1.0, SHORT / max(1, len(x)))
            odds = bias + w[x].sum() + 0.5 * share * (total @ total - (own**2).sum())
            error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[i]
            bias_squares += error * error
            bias -= rate * error / np.sqrt(bias_squares)
            sigma = (np.sqrt(squares[x] + error * error) - np.sqrt(squares[x])) / rate
            z[x] += error - sigma * w[x]
            squares[x] += error * error
            w[x] = np.where(np.abs(z[x]) <= l1_of[x], 0.0, -(z[x] - np.sign(z[x]) * l1_of[x]) / ((1 + np.sqrt(squares[x])) / rate + l2))
            slope = share * error * (total - own) + 0.1 * own
            v_squares[x] += slope**2
            v[x] = own - 0.02 * slope / np.sqrt(v_squares[x])
    sampled = np.bincount(labels, minlength=2)
    shift = np.log(counts[1] / counts[0]) - np.log(sampled[1] / sampled[0])
    stays = (w != 0) | (np.abs(v).max(axis=1, initial=0) > TINY)
    return Model(buckets[stays], w[stays], v[stays].astype(np.float32), bias + shift)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*training_rows(docs, labels, "toxic", per_class, seed=8))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score, the probability of label 1, of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.factors, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(texts(batch.column("__text"))))], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text")).mapInArrow(run, f"doc_id {kind}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
