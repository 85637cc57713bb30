"""Soft-membership mixing: domain posteriors of a classifier, and document rates that bring domain totals to targets."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import documents, each_batch, fresh_name, given_back, numbered, staged_texts

DOMAINS = ("good", "poor", "toxic")
#: Labelled rows that the classifier is fitted on, at most: those with the least hash of their id.
SAMPLE_ROWS = 10_000
#: Hashed word features, and features of a text's form after them.
WORD_FEATURES, FORM_FEATURES = 1 << 20, 16
#: A feature is used if so many sample rows have it, so many standard deviations more or less often in a domain than in all.
LEAST_ROWS, LEAST_DEVIATIONS = 5, 4.0
#: Share of all tokens that each domain should have. The total is such that good documents are wanted as they are.
WEIGHTS = {"good": 0.94, "poor": 0.05, "toxic": 0.01}
#: Weight of the distance from a rate of 1, and the error of a rate (its slope by that weight) that ends the fit.
NEARNESS, ENOUGH = 1e-5, 1e-3
#: Parts of a second-order step that a pass tries.
STEPS = (1.0, 0.5, 0.2, 0.05, 0.01)
#: A rate this near to 1 is 1, and the others are fitted again.
SNAP = 0.1
#: Starts of the draw that are compared.
STARTS = 64
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEPT_WORDS = 300_000


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh32_intdigest(word.strip(_MARKS) or word) % WORD_FEATURES
        return found


_BUCKETS = _Buckets()


def features(text: bytes) -> tuple[int, list[int]]:
    """(words, features present) of a text."""
    words = text.lower().split()
    n, distinct = max(1, len(words)), set(words)
    found = set(map(_BUCKETS.__getitem__, distinct))
    size = max(1, len(text))
    upper = (len(text) - len(text.translate(None, _UPPER))) / size
    marks = (len(text) - len(text.translate(None, _MARKS))) / size
    form = (upper > 0.3, upper > 0.1, marks > 0.05, marks > 0.1, marks > 0.2, len(distinct) < 0.2 * n, len(distinct) < 0.5 * n,
            n < 5, n < 20, n < 50, text.count(b"|") > 0.2 * n, size > 15 * n, size < 3 * n)
    found.update(WORD_FEATURES + i for i, x in enumerate(form) if x)
    return len(words), list(found)


@dataclass(frozen=True)
class Model:
    """A multinomial logistic regression over chosen features; the last row of the weights is the bias."""

    chosen: np.ndarray
    weights: np.ndarray

    def posteriors(self, rows: list[list[int]]) -> np.ndarray:
        at, row = self.known(rows)
        score = np.tile(self.weights[-1], (len(rows), 1))
        for j in range(score.shape[1]):
            score[:, j] += np.bincount(row, self.weights[at, j], len(rows))
        return softmax(score)

    def known(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(chosen feature, row) of all features that are chosen ones."""
        found = np.fromiter((i for r in rows for i in r), np.int64)
        row = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
        at = np.searchsorted(self.chosen, found)
        hit = np.append(self.chosen, -1)[at] == found
        return at[hit], row[hit]


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def choose(labels: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """Features that some domain has clearly more or less often than all rows have."""
    found = np.concatenate([np.asarray(r, np.int64) for r in rows])
    domain = np.repeat(labels, list(map(len, rows)))
    names, at = np.unique(found, return_inverse=True)
    seen = np.stack([np.bincount(at[domain == j], minlength=len(names)) for j in range(len(DOMAINS))], 1)
    share = np.bincount(labels, minlength=len(DOMAINS)) / len(labels)
    expected = seen.sum(1, keepdims=True) * share
    deviations = np.abs(seen - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    return names[(seen.sum(1) >= LEAST_ROWS) & (deviations.max(1) >= LEAST_DEVIATIONS)]


def fit(labels: np.ndarray, rows: list[list[int]], rounds: int = 200, decay: float = 1e-4) -> Model:
    k = len(DOMAINS)
    if not len(rows):
        return Model(np.zeros(0, np.int64), np.zeros((1, k)))
    model = Model(chosen := choose(labels, rows), np.zeros((len(chosen) + 1, k)))
    (at, row), truth, weights = model.known(rows), np.eye(k)[labels], model.weights
    one, two, rate = np.zeros_like(weights), np.zeros_like(weights), 0.1
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(row, weights[at, j], len(rows)) for j in range(k)], 1) + weights[-1]
        error = (softmax(score) - truth) / len(rows)
        slope = np.stack([np.bincount(at, error[row, j], len(chosen)) for j in range(k)], 1)
        slope = np.concatenate([slope, error.sum(0)[None]]) + decay * weights
        one, two = 0.9 * one + 0.1 * slope, 0.999 * two + 0.001 * slope**2
        weights -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(features(t)[1]) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(found, pa.list_(pa.int32()))], names=["domain", "features"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, fitted on labelled documents: toxic ones, and others by quality. Null labels count as 0.

    At most SAMPLE_ROWS rows, so the fit and what is collected for it are bounded at any input size.
    """
    each = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(
        F.coalesce("quality", F.lit(0)) == 1, 0).otherwise(1)).alias("domain"))
    sample = each.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    chosen = documents(docs).join(sample, F.col("doc_id") == F.col("_id")).select("domain", "text")
    rows = each_batch(chosen, "domain int, features array<int>", _featured).toArrow()
    held = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))   # the same fit whatever the order
    return fit(np.array([d for d, _ in held], np.int64), [f for _, f in held])


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            p = model.posteriors([f for _, f in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "mark")), pa.array([n for n, _ in found], pa.int64()),
                                              *[pa.array(p[:, j]) for j in range(p.shape[1])]], names=["doc_id", "row", "mark", "n_tokens", *DOMAINS])
        _BUCKETS.clear()
    return run


def predict(docs: DataFrame, model: Model, number: str | None = None) -> DataFrame:
    """doc_id, row (its number, if it has one, or else the mark), mark (a hash of both), n_tokens (words), domain posteriors."""
    mark = F.xxhash64("doc_id", "text")
    rows = documents(docs, *[number] * bool(number)).select("doc_id", (F.col(number) if number else mark).alias("row"), mark.alias("mark"), "text")
    return each_batch(rows, "doc_id long, row long, mark long, n_tokens long, " + ", ".join(f"{d} double" for d in DOMAINS), _predictor(model))


def descend(posterior: np.ndarray, prices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, which of them the last prices set) of some documents.

    A rate is 1 less the document's posteriors times the domains' prices, and never below zero. Those that are near to 1
    at some prices are 1 at all later ones.
    """
    rate, free = np.ones(len(posterior)), np.ones(len(posterior), bool)
    for k, price in enumerate(prices):
        if k:
            free = free & (np.abs(rate - 1) > SNAP)
        rate = np.where(free, np.maximum(0, 1 - posterior @ price), 1.0)
    return rate, free


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(d).to_numpy() for d in DOMAINS], 1)


def _totals(prices: list[np.ndarray], tried: list[np.ndarray]):
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tried), 1 + k + k * k))
        for batch in batches:
            p, n = _matrix(batch), batch.column("n_tokens").to_numpy()
            for i, price in enumerate(tried):
                rate, free = descend(p, [*prices, price])
                live = free & (rate > 0)
                sums[i, 0] += n @ np.where(free, rate**2 / 2, -(p @ price))
                sums[i, 1 : 1 + k] += (n * rate) @ p
                sums[i, 1 + k :] += ((p[live] * n[live, None]).T @ p[live]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.ravel()], names=[f"s{i}" for i in range(sums.size)])
    return run


def _summed(rows: DataFrame, step, *shape: int) -> np.ndarray:
    """The sum of what `step` adds up in each task."""
    names = [f"s{i}" for i in range(int(np.prod(shape)))]
    row = rows.mapInArrow(given_back(step), ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
    return np.array([x or 0.0 for x in row]).reshape(shape)


def fit_rates(predicted: DataFrame, weights: dict[str, float] | None = None, refit: bool = False) -> list[np.ndarray]:
    """The prices of the domains, from which any document's rate follows.

    Minimised are the squared differences between expected domain totals and their targets, as shares of all tokens, and
    NEARNESS times the documents' squared distances from a rate of 1, weighted by tokens. Its dual has one price per
    domain and is solved by second-order steps. A step is one pass over the table that adds up a few numbers per domain
    in the tasks; only those come to the driver. It ends when no rate is further than ENOUGH from the best, or with a warning
    when no step helps any more. With `refit`
    the rates that came near to 1 are then 1, and all prices but that of good text are fitted again.
    """
    k, share = len(DOMAINS), np.array([{**WEIGHTS, **(weights or {})}[d] for d in DOMAINS])

    def totals(prices: list[np.ndarray], tried: list[np.ndarray]) -> np.ndarray:
        return _summed(predicted.select("n_tokens", *DOMAINS), _totals(prices, tried), len(tried), 1 + k + k * k)

    price = np.zeros(k)
    now = totals([], [price])[0, 1 : 1 + k]
    whole = now.sum()
    if not whole:
        return []
    target, prices = share / share[0] * now[0] / whole, []
    for fixed in range(2 if refit else 1):
        tried, best = [price], np.inf
        while True:
            sums = totals(prices, tried) / whole
            values = sums[:, 0] + [target @ x + NEARNESS / 2 * (x @ x) for x in tried]
            at = int(values.argmin())
            if values[at] >= best:   # no step is better by more than rounding
                warnings.warn(f"the rates are within {np.abs(slope).max() / NEARNESS:.3g} of the best, not within {ENOUGH}", stacklevel=2)
                break
            price, best = tried[at], values[at]
            slope = (NEARNESS * price + target - sums[at, 1 : 1 + k])[fixed:]
            if np.abs(slope).max() <= NEARNESS * ENOUGH:
                break
            curve = sums[at, 1 + k :].reshape(k, k) + NEARNESS * np.eye(k)
            step = np.append(np.zeros(fixed), np.linalg.solve(curve[fixed:, fixed:], slope))
            tried = [price - part * step for part in STEPS]
        prices.append(price)
    return prices


def _rater(prices: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(descend(_matrix(batch), prices)[0])], names=[*batch.schema.names, "rate"])
    return run


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((STARTS + 1, len(DOMAINS)))
    for batch in batches:
        p, n, rate, draw = _matrix(batch), *(batch.column(c).to_numpy() for c in ("n_tokens", "rate", "draw"))
        sums[STARTS] += (n * rate) @ p
        for i in range(STARTS):
            sums[i] += (n * np.floor(rate + (draw + i / STARTS) % 1)) @ p
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.ravel()], names=[f"s{i}" for i in range(sums.size)])


def draw_start(rated: DataFrame) -> float:
    """What is added to all draws: of STARTS values, that whose copies come nearest to the fitted totals."""
    sums = _summed(rated.select("n_tokens", *DOMAINS, "rate", "draw"), _drawn, STARTS + 1, len(DOMAINS))
    return int(np.abs(sums[:STARTS] / np.maximum(sums[STARTS], 1e-9) - 1).max(1).argmin()) / STARTS


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, number: str | None = None) -> DataFrame:
    """One row per document: doc_id, row, n_tokens, the domain posteriors, its rate and the copies drawn at that rate.

    A rate is drawn by a hash of the row: its whole part, and one more with the probability of the rest. Rates near to 1
    are 1, so that clean documents stay, and the others are fitted again.

    Null or empty text: no tokens, posteriors from the form of an empty text. A null doc_id is a document like any other.
    Without labelled rows all domains are equally likely. Repeated rows get the same rate and copies each. An empty table
    gives no rows. Other columns are not read.
    """
    predicted = staged_texts(predict(docs, train(docs, labels), number))
    prices = fit_rates(predicted, weights, refit=True)
    rated = predicted.mapInArrow(given_back(_rater(prices)), predicted.schema.simpleString()[7:-1].replace(":", " ") + ", rate double")
    rated = rated.withColumn("draw", F.pmod(F.xxhash64("mark", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30))
    drawn = (F.col("draw") + draw_start(rated)) % 1.0
    return rated.withColumn("copies", F.floor(F.col("rate") + drawn).cast("long")).drop("draw", "mark")


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as often as drawn, with all their columns.

    Rows are told apart by number, so repeated rows are drawn each; whole texts are shuffled once. Null or empty texts have no
    tokens and count for nothing in the totals, and are drawn like others. An empty table gives no rows. Columns of any name
    are kept.
    """
    rows, number = numbered(docs)
    copies, copy = fresh_name(rows, "copies"), fresh_name(rows, "copy")
    drawn = mix(rows, labels, weights, number).filter("copies > 0").select(F.col("row").alias(number), F.col("copies").alias(copies))
    return rows.join(drawn, number).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
