"""Toxic severity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: At most so many labelled rows of each side (toxic, not toxic) are fitted, the first by a hash of
#: doc_id.  Scoring covers every row.
SAMPLE_ROWS = 2500
PREFIX = 4
#: A feature counts if it is in so many sampled rows and its share among graded rows differs from
#: that among the others by so many standard errors; most words of a text tell nothing.
MIN_ROWS = 4
MIN_ERRORS = 4.0
TRIM = ".,;:!?\"'()[]{}<>*#$%&|-_"


def features(text: str | None) -> set[str]:
    """Words in lower case without outer punctuation, and the first letters of longer ones."""
    words = {w.strip(TRIM) for w in set((text or "").lower().split())}
    words.discard("")
    return words | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - cuts[k - 1]): one weight vector, ordered cuts."""

    weights: dict[str, float]
    cuts: list[float]

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(text))

    def severity(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the probability of any grade above 0."""
        above = 1.0 / (1.0 + np.exp(np.clip(np.array(self.cuts)[None, :] - scores[:, None], -60, 60)))
        return above.sum(1), above[:, 0]


def grade(texts: list[str | None], toxic: np.ndarray) -> np.ndarray:
    """Severity grades of labelled rows: 0 not toxic, 1 toxic, 2 toxic with more than the
    median number of words that are ten times as common among toxic rows as among the others."""
    bags = [features(t) for t in texts]
    seen: dict[str, list[int]] = {}
    for bag, hit in zip(bags, toxic):
        for f in bag:
            seen.setdefault(f, [0, 0])[int(hit)] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marks = {f for f, (a, b) in seen.items() if b >= MIN_ROWS and b / n1 > 10 * (a + 0.5) / n0}
    number = np.array([len(bag & marks) for bag in bags], dtype=np.int64)
    middle = np.median(number[toxic == 1]) if toxic.any() else 0.0
    return np.where(toxic == 1, 1 + (number > middle), 0)


def fit(
    texts: list[str | None], grades: np.ndarray, row_weights: np.ndarray | None = None,
    steps: int = 150, ridge: float = 0.3, rate: float = 0.15,
) -> OrdinalModel:
    """Penalised maximum likelihood by Adam on the features that MIN_ROWS and MIN_ERRORS let in.

    Without rows of at least two grades nothing can be told apart: all scores are 0 and every
    severity is nearly 0.
    """
    levels = int(grades.max()) if len(grades) else 0
    if levels == 0 or (grades > 0).all():
        return OrdinalModel({}, [50.0])
    bags = [features(t) for t in texts]
    count: dict[str, list[int]] = {}
    for bag, hit in zip(bags, grades > 0):
        for f in bag:
            count.setdefault(f, [0, 0])[int(hit)] += 1
    n1 = int((grades > 0).sum())
    n0 = len(grades) - n1

    def tells(without: int, with_: int) -> bool:
        if without + with_ < MIN_ROWS:
            return False
        share = (without + with_) / len(grades)
        error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        return abs(with_ / n1 - without / n0) > min(MIN_ERRORS, 0.2 * np.sqrt(len(grades))) * error

    names = sorted(f for f, c in count.items() if tells(*c))
    place = {f: i for i, f in enumerate(names)}
    pairs = [(r, place[f]) for r, bag in enumerate(bags) for f in bag if f in place]
    at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    rows, cols, n = at[:, 0], at[:, 1], len(bags)
    rw = np.ones(n) if row_weights is None else row_weights
    rw = rw / rw.sum()
    # Cuts are a first value and positive gaps, so they stay ordered.
    theta = np.concatenate([np.zeros(len(names)), [2.0], np.zeros(levels - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(names)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[k + 1 :])
        cuts = theta[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, theta[cols], n) if len(rows) else np.zeros(n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high = 1 / (1 + np.exp(-np.clip(edges[grades + 1] - z, -40, 40)))
        low = 1 / (1 + np.exp(-np.clip(edges[grades] - z, -40, 40)))
        high[grades == levels], low[grades == 0] = 1.0, 0.0
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p * rw, low * (1 - low) / p * rw
        g = np.zeros_like(theta)
        g[:k] = np.bincount(cols, (dh - dl)[rows], k) + ridge / n * theta[:k]
        d_cut = np.array([dl[grades == j + 1].sum() - dh[grades == j].sum() for j in range(levels)])
        g[k] = d_cut.sum()
        g[k + 1 :] = np.cumsum(d_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[k] + np.concatenate([[0.0], np.cumsum(np.exp(theta[k + 1 :]))])
    weights = {f: float(w) for f, w in zip(names, theta[:k]) if abs(w) > 1e-3}
    return OrdinalModel(weights, [float(c) for c in cuts])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on a bounded, hash-ordered sample of the labelled rows, in one task.

    Rows with a null id or label are left out; an id labelled twice counts as toxic if any label
    says so, an id with several texts counts once, with the smallest.  Row weights restore the sides' shares among all labelled rows.
    """
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    sizes = dict(known.groupBy("toxic").count().collect())
    order = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = [known.filter(F.col("toxic") == side).orderBy(*order).limit(sample_rows) for side in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample_rows ids
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(ids, "label_id")
    # Rows repeated under one id give one, so the task's input stays bounded.
    rows = rows.groupBy("label_id", "toxic").agg(F.min("text").alias("text"))

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        toxic = table.column("toxic").to_numpy().astype(np.int64)
        share = np.array([sizes.get(0, 0), sizes.get(1, 0)], float) / np.maximum(
            1, np.bincount(toxic, minlength=2)[:2]
        )
        model = fit(texts, grade(texts, toxic), share[toxic])
        names = list(model.weights)
        return pa.table({
            "feature": pa.array(names + [None] * len(model.cuts), pa.string()),
            "value": pa.array([*model.weights.values(), *model.cuts], pa.float64()),
        })

    parts = rows.groupBy(F.lit(1).alias("one")).applyInArrow(run, "feature string, value double").collect()
    if not parts:
        return OrdinalModel({}, [50.0])
    return OrdinalModel(
        {r.feature: r.value for r in parts if r.feature is not None},
        sorted(r.value for r in parts if r.feature is None),
    )


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with ``severity`` (expected grade) and ``p_toxic`` (probability of a grade above 0).

    Input columns of these names are replaced.  Null and empty texts have no features and get the
    score of an empty text; repeated rows stay repeated.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most the features of the bounded sample
    kept = [c for c in docs.columns if c.lower() not in ("severity", "p_toxic")]
    schema = docs.select(*kept).schema.add("severity", "double").add("p_toxic", "double")

    def run(batches):
        model = sent.value
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column("text").to_pylist()])
            severity, p_toxic = model.severity(scores.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(severity), pa.array(p_toxic)],
                [*batch.schema.names, "severity", "p_toxic"],
            )

    return docs.select(*kept).mapInArrow(run, schema)


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, p_toxic and toxic (more likely than not) of every row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", "severity", "p_toxic", (F.col("p_toxic") > 0.5).alias("toxic"))


def clean_documents(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose text is toxic with a probability of at most ``limit``.

    No column is added or replaced, whatever the columns' names.  Null and empty texts are judged as
    an empty text, very long ones whole, repeated rows alike; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        model = sent.value
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.severity(scores.reshape(-1))[1] <= limit))

    return docs.mapInArrow(run, docs.schema)
