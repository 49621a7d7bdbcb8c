"""Toxic documents, learned from confirmed toxic examples and unlabelled text.

The classifier is linear over the words of a document (each counted once) and is trained in
numpy by the non-negative positive-unlabelled risk::

    prior * E+[loss(f)] + max(0, E_u[loss(-f)] - prior * E+[loss(-f)])

where the unlabelled mean stands for all documents and the positive part that hides in it is
subtracted by the class prior; where that difference turns negative, a step goes against it.
With the logistic loss, ``1 / (1 + exp(-f))`` is the score. Words enter the model if they
occur in more of the positive than of the unlabelled examples by a likelihood-ratio test.

The training sample is bounded (``POSITIVES``, ``UNLABELLED``, taken by hash of the id); every
document is scored on its whole text. Labels are read only from training folds, that is
where ``crc32(id as text) % 3`` is not 1; unlabelled examples are the documents
of these folds that are not confirmed. The prior is taken from the labels, which then must be a
fair sample of the documents; else give it. It is a little above the toxic share of the
unlabelled, since confirmed ones are taken out, which favours finding toxic documents.

Defined results: null and empty texts have no words and get the score of the bias; without
positive examples every score is that of ``NO_POSITIVES``; labels that are null or of an unknown id are ignored, of
repeated labels the largest counts; rows that repeat are scored alike; a null id is held
out of nothing and never trained on; further columns are ignored by ``scored`` and carried by
``without_toxic``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.tables import map_arrow, whole_text
from fleetlint.llm.words import IS_SPACE, LOWER, steps, text_buffers, word_hashes
from fleetlint.plans.storage import materialise

#: Most training documents of each kind, words of the model, and bits of the first look-up.
POSITIVES, UNLABELLED, FEATURES, LOOKUP_BITS = 4000, 12_000, 4096, 20
#: A word must occur in this many positives, and its likelihood ratio (chi-square, one degree) must reach this.
LEAST_POSITIVES, LEAST_RATIO = 3, 15.0
#: Training steps, step size, weight decay, and bias without positive examples.
STEPS, RATE, DECAY, NO_POSITIVES = 400, 0.05, 1e-4, -4.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.7

_IN_WORD = ~IS_SPACE
for _byte in map(ord, "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"):
    _IN_WORD[_byte] = False


@dataclass
class Model:
    """Words by hash (ascending), their weights and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << LOOKUP_BITS, bool)
        self.maybe[self.words & np.uint64((1 << LOOKUP_BITS) - 1)] = True

    def known(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and feature numbers of the words that the model knows, each once per row."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64((1 << LOOKUP_BITS) - 1)]) if len(self.words) else np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.words, hashes[at]), max(0, len(self.words) - 1))
        keep = self.words[found] == hashes[at] if len(at) else np.zeros(0, bool)
        pairs = np.unique(rows[at][keep] * np.int64(1 << 32) + found[keep])
        return pairs >> 32, pairs & 0xFFFFFFFF

    def scores(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        row, feature = self.known(hashes, rows)
        margin = self.bias + np.bincount(row, self.weights[feature], n)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _word_rows(batch: pa.RecordBatch):
    data, offsets = text_buffers(batch.column("text"))
    for first, last in steps(offsets):
        hashes, counts = word_hashes(data, offsets[first:last + 1], _IN_WORD, LOWER)
        yield first, last, hashes, np.repeat(np.arange(last - first), counts)


def select_words(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Words that mark positives, by the likelihood ratio of document counts."""
    p_words, p_counts = np.unique(np.concatenate(positive), return_counts=True)
    u_words, u_counts = np.unique(np.concatenate(unlabelled), return_counts=True) if unlabelled else (p_words[:0], p_counts[:0])
    often = p_counts >= LEAST_POSITIVES
    p_words, a = p_words[often], p_counts[often].astype(float)
    b = np.zeros(len(p_words))
    if len(u_words):
        at = np.minimum(np.searchsorted(u_words, p_words), len(u_words) - 1)
        b = np.where(u_words[at] == p_words, u_counts[at], 0).astype(float)
    n_p, n_u = len(positive), max(1, len(unlabelled))

    def part(k, n, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * share)), 0) + np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - share))), 0)

    share = np.clip((a + b) / (n_p + n_u), 1e-12, 1 - 1e-12)
    ratio = 2 * (part(a, n_p, share) + part(b, n_u, share))
    score = np.where(a / n_p > b / n_u, ratio, 0)
    best = np.argsort(-score, kind="stable")[:FEATURES]
    return np.sort(p_words[best[score[best] >= LEAST_RATIO]])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """A classifier from the distinct word hashes of positive and unlabelled documents."""
    if not positive:
        return Model(np.zeros(0, np.uint64), np.zeros(0), NO_POSITIVES)
    model = Model(words := select_words(positive, unlabelled), np.zeros(len(words)), float(np.log(prior / (1 - prior))))
    sides = []
    for docs in (positive, unlabelled or positive):
        rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        sides.append((*model.known(np.concatenate(docs), rows), len(docs)))
    values = np.append(model.weights, model.bias)
    first, second = np.zeros_like(values), np.zeros_like(values)

    def slopes(side, sign: float) -> tuple[float, np.ndarray]:
        """Mean logistic loss of ``sign * f`` and its gradient."""
        row, feature, n = side
        f = values[-1] + np.bincount(row, values[:-1][feature], n)
        weight = -sign / (1 + np.exp(np.clip(sign * f, -30, 30))) / n
        return float(np.logaddexp(0, -sign * f).mean()), np.append(
            np.bincount(feature, weight[row], len(values) - 1), weight.sum())

    for step in range(1, STEPS + 1):
        (_, as_positive), (hidden, hidden_slope), (rest, rest_slope) = slopes(sides[0], 1), slopes(sides[0], -1), slopes(sides[1], -1)
        negative_slope = rest_slope - prior * hidden_slope
        slope = prior * as_positive + negative_slope if rest - prior * hidden >= 0 else -negative_slope
        slope[:-1] += DECAY * values[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        values = values - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model(model.words, values[:-1], float(values[-1]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Train on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; the prior is the toxic share of labels unless given."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") == 1).alias("toxic"))
    known = materialise(known, "training-labels")
    toxic, total = known.agg(F.sum(F.col("toxic").cast("int")), F.count("*")).first()
    prior = min(0.5, max(1e-3, prior or (toxic or 0) / max(1, total)))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    ids = ids.join(known.where("toxic"), "doc_id", "left").select("doc_id", F.col("toxic").isNotNull().alias("positive"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = ids.where("positive").orderBy(*order).limit(POSITIVES).union(ids.where("not positive").orderBy(*order).limit(UNLABELLED))
    sample = materialise(sample, "training-ids")  # at most POSITIVES + UNLABELLED rows
    examples = docs.join(F.broadcast(sample), "doc_id").select("positive", "text")

    def run(batches):
        for batch in batches:
            for first, last, hashes, rows in _word_rows(batch):
                words = [np.unique(hashes[rows == k]) for k in range(last - first)] if last - first < 50 else [
                    np.unique(w) for w in np.split(hashes, np.searchsorted(rows, np.arange(1, last - first)))]
                yield pa.RecordBatch.from_arrays([
                    batch.column("positive").slice(first, last - first),
                    pa.array([w.tobytes() for w in words], pa.binary())], ["positive", "words"])

    # as Arrow: neither rows as Python objects nor a second copy of the words in the driver
    rows = map_arrow(examples, run, "positive boolean, words binary").toArrow()
    sets = [np.frombuffer(w.as_buffer(), np.uint64) for w in rows["words"]]
    positive = [s for s, p in zip(sets, rows["positive"].to_pylist(), strict=True) if p]
    unlabelled = [s for s, p in zip(sets, rows["positive"].to_pylist(), strict=True) if not p]
    return train(positive, unlabelled, prior)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text_column).alias("text"))


def score_column(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with ``text``) and the column ``_score``, rows in place."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "_score double"])

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for first, last, hashes, words_of in _word_rows(batch):
                scores.append(model.scores(hashes, words_of, last - first))
            yield batch.append_column("_score", pa.array(np.concatenate(scores)))

    return map_arrow(rows, run, schema)


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           prior: float | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    texts = _texts(docs, id_column, text_column)
    rows = score_column(texts, fit(texts, labels, prior)).select("doc_id", F.col("_score").alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  prior: float | None = None) -> DataFrame:
    """The documents scored below the threshold, with their own columns."""
    model = fit(_texts(docs, id_column, text_column), labels, prior)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = score_column(docs.select(row, whole_text(docs, text_column).alias("text")), model)
    return rows.where(F.col("_score") < THRESHOLD).select("_row.*")
