"""Language identification by a sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams of the whole text. Document
frequencies are counted over all training rows. The weights are learnt by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of training
rows, about `SAMPLE_TEXTS` in all and alike for every language, chosen by a hash of the id;
a fifth of it is held back to fit the temperature of the probabilities. The model has a
fixed size and goes to the tasks; a prediction reads the text only.

Defined cases: a null text and one without a letter are `und` with score 0; rows with a
null language or a null id are not learnt from; without training rows everything is `und`;
repeated rows are each judged; an empty table gives an empty result; other columns are not
touched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
FEATURES = 1 << 14
ORDERS = (1, 2, 3)
SAMPLE_TEXTS = 4_000
#: Follow-the-regularised-leader: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 3
#: A document whose best language is less likely than this is rejected by the filter.
LEAST_SCORE = 0.5
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def counts(text: str) -> np.ndarray:
    """How often every hashed n-gram occurs; runs without letters count as one space."""
    line = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
    total = np.zeros(FEATURES, dtype=np.int64)
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, dtype=np.uint32)
        for i in range(order):
            h = h * np.uint32(0x85EBCA6B) + points[i : i + n]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        total += np.bincount(h >> np.uint32(18), minlength=FEATURES)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def weighted(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and unit-length TF-IDF weights of the features that occur."""
    at = np.flatnonzero(found)
    values = np.log1p(found[at]) * idf[at]
    return at, values / max(np.linalg.norm(values), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, values = weighted(counts(text), self.idf)
        logits = (values @ self.weights[at] + self.bias) / self.temperature
        odds = np.exp(logits - logits.max())
        best = int(odds.argmax())
        return self.languages[best], float(min(1.0, odds[best] / odds.sum()))


def follow_the_leader(
    examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; per-coordinate rates, and weights at 0 until their gradient outgrows L1."""
    z = np.zeros((FEATURES + 1, classes))
    n = np.zeros((FEATURES + 1, classes))

    def current(rows: np.ndarray) -> np.ndarray:
        zr, nr = z[rows], n[rows]
        w = -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(nr)) / ALPHA + L2)
        return np.where(np.abs(zr) <= L1, 0.0, w)

    order = np.random.default_rng(17)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, values, label = examples[i]
            rows, x = np.append(at, FEATURES), np.append(values, 1.0)
            w = current(rows)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p[None, :]
            grown = n[rows] + g * g
            z[rows] += g - (np.sqrt(grown) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = grown
    every = current(np.arange(FEATURES + 1))
    return every[:-1], every[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least loss on held-back rows.

    Labels are smoothed by one row in all, so that rows without any mistake do not ask for
    certainty.
    """
    if not len(labels):
        return 1.0
    slack = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        scaled = logits / t
        top = scaled.max(axis=1)
        whole = top + np.log(np.exp(scaled - top[:, None]).sum(axis=1))
        own = scaled[np.arange(len(labels)), labels]
        return float(np.mean(whole - (1 - slack) * own - slack * scaled.mean(axis=1)))

    grid = np.exp(np.linspace(math.log(0.05), math.log(10), 80))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def _feature_rows(rows: DataFrame) -> DataFrame:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, times = [], []
            for text in batch.column(1):
                found = counts(text.as_py())
                at.append(np.flatnonzero(found).astype(np.int32))
                times.append(found[at[-1]].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, kind), pa.array(times, kind), batch.column(2)],
                names=["lang", "at", "times", "draw"],
            )

    return rows.select("lang", "text", "draw").mapInArrow(
        extract, "lang string, at array<int>, times array<int>, draw bigint"
    )


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training rows every feature occurs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total += counts(text.as_py()) > 0
                n += 1
        at = np.append(np.flatnonzero(total), FEATURES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int64)), pa.array(np.append(total, n)[at])], names=["feature", "n"]
        )

    found = rows.select("text").mapInArrow(gather, "feature bigint, n bigint")
    # At most one row for each feature, whatever the input.
    table = found.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(FEATURES + 1, dtype=np.int64)
    total[table["feature"].to_numpy()] = table["n"].to_numpy()
    return total[:-1], int(total[-1])


def fit(rows: DataFrame, sample: int = SAMPLE_TEXTS) -> Model:
    """Learn from `(doc_id, text, lang)`; rows without language, id or a letter are left out."""
    usable = rows.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"[\p{L}]")
    )
    per_language = {r["lang"]: r["count"] for r in rows.where("lang is not null").groupBy("lang").count().collect()}
    languages = sorted(per_language)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    frequency, n = _document_frequencies(usable)
    idf = np.log((1 + n) / (1 + frequency)) + 0.05
    share = max(1, sample // len(languages))
    limit = 1 << 30
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(limit))
    most = F.create_map(
        *(F.lit(x) for lang, count in per_language.items() for x in (lang, min(limit, limit * share // count)))
    )
    chosen = usable.withColumn("draw", draw).where(F.col("draw") < most[F.col("lang")])
    table = _feature_rows(chosen).toArrow()
    index = {lang: i for i, lang in enumerate(languages)}
    examples = []
    for lang, at, times, drawn in zip(*(table[c].to_pylist() for c in ("lang", "at", "times", "draw"))):
        at, times = np.array(at, dtype=np.int64), np.array(times)
        values = np.log1p(times) * idf[at]
        examples.append((at, values / max(np.linalg.norm(values), 1e-12), index[lang], drawn))
    examples.sort(key=lambda e: e[3])
    back = [e[:3] for i, e in enumerate(examples) if i % 5 == 4]
    weights, bias = follow_the_leader([e[:3] for i, e in enumerate(examples) if i % 5 != 4], len(languages))
    logits = np.array([values @ weights[at] + bias for at, values, _ in back]).reshape(-1, len(languages))
    temperature = fit_temperature(logits, np.array([e[2] for e in back], dtype=np.int64))
    return Model(languages, idf, weights.astype(np.float32), bias, temperature)


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the ids that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, lang_pred, score)` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` with a known language, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shared.value.predict(t.as_py()) for t in batch.column(column))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
