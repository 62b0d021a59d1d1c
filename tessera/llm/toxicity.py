"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; the model of each sees the probabilities of the categories before it
beside the text's features. In training those are out-of-fold predictions, so that later models learn from
probabilities as uncertain as the ones they get when documents are scored.

Features are the presence of words (runs of letters and digits, lower-cased) and of their first four, five and six
letters. The models are fitted on at most ``max_train`` labelled rows, those with the smallest hashes of their ids;
features are counted on the executors, and the ``vocabulary`` with the largest chi-squares of each category are
used. Everything else covers every document whole.

Defined results: a null or empty text has no features and gets the intercept's probability; rows with a null label
don't train that category; a category whose labels are all alike, or that has none, has that share (0 for none) as
the probability of every document; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, lean, text_of

_WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
#: Words whose features a worker remembers at a time.
REMEMBERED = 100_000


def features_of_word(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


def features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features_of_word(w)}


class Featurizer:
    """Indexes of the features that a text has, by a vocabulary."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.known = vocabulary, {}

    def __call__(self, text: str) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found: set[int] = set()
        known = self.known
        for word in set(_WORD.findall(text.lower())):
            if (at := known.get(word)) is None:
                at = known[word] = tuple(i for f in features_of_word(word) if (i := self.vocabulary.get(f)) is not None)
            if at:
                found.update(at)
        return sorted(found)


@dataclass
class Linear:
    """Logistic regression on present features and the chain's earlier probabilities."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def predict(self, flat: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[flat])])
        z = np.diff(sums[np.concatenate([[0], ends])]) + before @ self.chain + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, size: int, l2: float = 0.1, steps: int = 300) -> Linear:
    """Accelerated gradient descent on the log loss. The same rows give the same model."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Linear(np.zeros(size), np.zeros(before.shape[1]), float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    lengths = np.array([len(r) for r in rows])
    flat, of = np.concatenate([*rows, np.empty(0, int)]).astype(int), np.repeat(np.arange(len(rows)), lengths)
    extra = np.hstack([before, np.ones((len(y), 1))])
    # Weights are fitted in units of the log ratio of a feature's shares in the two classes (as in naive Bayes), so
    # that telling words, common or rare, move far before the others do.
    yes, no = np.bincount(flat, weights=y[of], minlength=size), np.bincount(flat, weights=1 - y[of], minlength=size)
    unit = np.abs(np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / (len(y) - y.sum() + 2)))
    flat_unit = unit[flat]

    def forward(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=(u * unit)[flat], minlength=len(y)) + extra @ v

    def backward(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(flat, weights=flat_unit * z[of], minlength=size), extra.T @ z / np.sqrt(len(y))

    u, v = np.ones(size), np.ones(extra.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        u, v = backward(forward(u, v / np.sqrt(len(y))))
        norm = float(np.sqrt(u @ u + v @ v))
        u, v = u / norm, v / norm
    rate = 1 / (0.3 * norm + l2)
    # The intercept starts where it belongs for a text without features: on its own it moves slowly.
    u, v = np.zeros(size), np.zeros(extra.shape[1])
    v[-1] = np.log(y.mean() / (1 - y.mean())) * np.sqrt(len(y))
    last_u, last_v = u, v
    for k in range(steps):
        mu, mv = u + (u - last_u) * k / (k + 3), v + (v - last_v) * k / (k + 3)
        last_u, last_v = u, v
        z = forward(mu, mv / np.sqrt(len(y)))
        du, dv = backward(1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        u, v = mu - rate * (du + l2 * mu), mv - rate * dv
    w, v = u * unit, v / np.sqrt(len(y))
    return Linear(w, v[:-1], float(v[-1]))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]

    def predict(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.array([i for r in rows for i in r], dtype=int)
        ends = np.cumsum([len(r) for r in rows], dtype=int)
        out = np.zeros((len(rows), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.predict(flat, ends, out[:, :k])
        return out


def fit_chain(categories: list[str], vocabulary: dict[str, int], rows: list[list[int]], labels: np.ndarray, folds: int = 3) -> Chain:
    """``labels``: a row for each of ``rows``, a column for each category, NaN where there is none."""
    sparse = [np.array(r, dtype=int) for r in rows]
    fold, before, models = np.arange(len(rows)) % folds, np.zeros((len(rows), len(categories))), []
    for k in range(len(categories)):
        has = ~np.isnan(labels[:, k])

        def on(pick: np.ndarray, k: int = k) -> Linear:
            at = np.flatnonzero(pick)
            return fit([sparse[i] for i in at], before[at, :k], labels[at, k], len(vocabulary))

        models.append(on(has))
        for f in range(folds) if k + 1 < len(categories) else ():
            at = np.flatnonzero(fold == f)
            model = on(has & (fold != f))
            flat = np.concatenate([*[sparse[i] for i in at], np.empty(0, int)]).astype(int)
            before[at, k] = model.predict(flat, np.cumsum([len(sparse[i]) for i in at], dtype=int), before[at, :k])
    return Chain(categories, vocabulary, models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", max_train: int = 10_000, vocabulary: int = 2_000) -> Chain:
    """``categories``: for each name, in the chain's order, a SQL expression over the columns of ``labels``."""
    names = list(categories)
    said = labels.select(F.col(f"`{label_id}`").alias("id"), *[F.expr(e).cast("double").alias(f"y{k}") for k, e in enumerate(categories.values())])
    sample = said.orderBy(F.xxhash64("id"), "id", *[f"y{k}" for k in range(len(names))]).limit(max_train)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    # Broadcast: max_train rows of numbers. One row of each text: words of a text that is copied often would tell too much.
    rows = rows.join(F.broadcast(sample), "id").groupBy("text", *[f"y{k}" for k in range(len(names))]).agg(F.min("id").alias("id"))
    rows = durable(rows, "labelled")
    counts = T.StructType([T.StructField("feature", T.StringType()), T.StructField("n", T.LongType())] + [T.StructField(f"n{k}", T.LongType()) for k in range(len(names))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("toxicity")
        n, per = Counter(), [Counter() for _ in names]
        for batch in batches:
            ys = [batch.column(f"y{k}").to_pylist() for k in range(len(names))]
            for i, text in enumerate(batch.column("text")):
                found = features(text.as_py())
                n.update(found)
                for k, y in enumerate(ys):
                    if y[i]:
                        per[k].update(found)
        each = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(each, pa.string()), pa.array([n[f] for f in each], pa.int64()), *[pa.array([c[f] for f in each], pa.int64()) for c in per]], names=counts.names)

    table = rows.mapInArrow(counted, counts).groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))]).filter("n >= 3")
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"y{k}"), F.lit(0.0)).alias(f"n{k}") for k in range(len(names))]).first()
    table, chosen = durable(table, "features"), {}
    for k in range(len(names)):
        a, n, y = F.col(f"n{k}").cast("double"), F.col("n").cast("double"), float(total[f"n{k}"])
        gap = a * total["n"] - n * y
        square = gap * gap / (n * (total["n"] - n + 1) * max(y, 1.0) * max(total["n"] - y, 1.0))
        for row in table.select("feature", square.alias("s")).orderBy(F.desc("s"), "feature").limit(vocabulary).collect():
            chosen.setdefault(row["feature"], len(chosen))

    at = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType()))] + [T.StructField(f"y{k}", T.DoubleType()) for k in range(len(names))] + [rows.schema["id"]])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = Featurizer(chosen)
        for batch in batches:
            found = pa.array([featurize(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, *[batch.column(f"y{k}") for k in range(len(names))], batch.column("id")], names=at.names)

    got = rows.mapInArrow(indexed, at).orderBy(F.xxhash64("id"), "id", "at").collect()
    ys = np.array([[np.nan if r[f"y{k}"] is None else r[f"y{k}"] for k in range(len(names))] for r in got], dtype=float).reshape(len(got), len(names))
    return fit_chain(names, chosen, [list(r["at"]) for r in got], ys)


def score(docs: DataFrame, chain: Chain, text_col: str = "text", out_col: str = "probabilities") -> DataFrame:
    """The input's columns, and last ``out_col``, which must be no column of it: probabilities in the chain's order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        featurize = Featurizer(model.vocabulary)
        for batch in batches:
            rows = [featurize(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(model.predict(rows)), pa.list_(pa.float64()))], schema=arrow)
        lean("toxicity")

    return docs.mapInArrow(scored, out)
