"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

One weight per feature is shared by all thresholds: P(grade <= k) = s(threshold_k - w.x) with the
logistic s and ordered thresholds.  The features are words, and the first and last three to six
letters of words; a feature's value is the logarithm of one plus its count in the whole text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.llm.tokens import give_back, held, text_slices, tidy
from stayspark.session import durable

LETTERS = re.compile(r"[^\W\d_]+")
# Text that is taken at a time, and chunks of text whose features a worker remembers.
SLICE_BYTES = 4 << 20
CACHED_CHUNKS = 200_000


@dataclass(frozen=True)
class Fit:
    """How a model is fitted.

    ``per_grade`` labelled documents of each given grade (by the hash of their id) are the whole training
    sample, and ``features`` the most features chosen, by the z-value of their log odds to stand in toxic
    texts (``least_z`` or more, in ``least_docs`` texts or more).  ``grades`` are the numbers of indicative words from which on a
    toxic text has grade 2, 3, ...; None takes the given grades as they are.
    """

    per_grade: int = 6000
    features: int = 2048
    least_docs: int = 3
    least_z: float = 2.5
    grades: Sequence[int] | None = (3, 8)
    penalty: float = 1e-4
    steps: int = 400


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (float("inf"),)


def word_features(word: str) -> list[str]:
    """Features of a lower-case word."""
    found = [f"={word}"]
    for n in range(3, min(6, len(word)) + 1):
        found += [f"^{word[:n]}", f"{word[-n:]}$"]
    return found


def text_features(text: str) -> Counter:
    counts: Counter = Counter()
    for word, n in Counter(LETTERS.findall(text.lower())).items():
        for name in word_features(word):
            counts[name] += n
    return counts


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature stands, by toxic and other; summed per slice of a batch."""
    for batch in batches:
        for first, last in text_slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(first, last - first)
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, grade in zip(part.column("text"), part.column("grade"), strict=True):
                counts[grade.as_py() > 0].update(text_features(text.as_py()).keys())
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.record_batch(
                [
                    pa.array(names, pa.string()),
                    pa.array([counts[1][n] for n in names], pa.int64()),
                    pa.array([counts[0][n] for n in names], pa.int64()),
                ],
                ["feature", "toxic", "other"],
            )


def _choose(sample: DataFrame, toxic: int, other: int, fit: Fit) -> list[str]:
    """The features that tell toxic texts best; none that speak for clean ones, which could hide them."""
    counts = sample.mapInArrow(tidy(_document_counts), "feature string, toxic long, other long")
    p, q = F.col("toxic") + 0.5, F.col("other") + 0.5
    z = (F.log(p / (toxic + 1.0)) - F.log(q / (other + 1.0))) / F.sqrt(1 / p + 1 / q)
    sums = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    chosen = sums.where(F.col("toxic") + F.col("other") >= fit.least_docs).withColumn("z", z)
    chosen = chosen.where(F.col("z") >= fit.least_z).orderBy(F.col("z").desc(), "feature")
    return [r["feature"] for r in chosen.limit(fit.features).collect()]


def _matrix(sample: DataFrame, names: list[str]) -> list:
    """Each sampled text's grade, its words with a chosen feature, and those features with their counts."""
    index = {name: i for i, name in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"grade": [], "hits": [], "at": [], "counts": []}
            for text, grade in zip(batch.column("text"), batch.column("grade").to_pylist(), strict=True):
                words = Counter(LETTERS.findall(text.as_py().lower()))
                counts: Counter = Counter()
                hits = 0
                for word, n in words.items():
                    found = [f for f in word_features(word) if f in index]
                    hits += n * bool(found)
                    for name in found:
                        counts[index[name]] += n
                for key, value in zip(out, (grade, hits, list(counts), list(counts.values())), strict=True):
                    out[key].append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return sample.mapInArrow(tidy(rows), "grade long, hits long, at array<long>, counts array<long>").collect()


def ordinal_fit(
    grade: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, features: int,
    weight: np.ndarray, penalty: float, steps: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps (Adam) on the penalised likelihood.

    ``row``, ``at``, ``value`` are the entries of the sparse matrix.  Thresholds are the first one and
    the logarithms of the steps to the next, which keeps them in order.
    """
    top = int(grade.max())
    total = weight.sum()
    below = np.clip([weight[grade <= k].sum() / total for k in range(top)], 1e-4, 1 - 1e-4)
    first = np.log(below / (1 - below))
    free = np.concatenate((np.zeros(features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    mean, square = np.zeros_like(free), np.zeros_like(free)

    def logistic(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(x / 2))

    for step in range(1, steps + 1):
        w, gaps = free[:features], np.exp(free[features + 1 :])
        cuts = free[features] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, w[at] * value, len(grade))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        upper, lower = edges[grade + 1] - score, edges[grade] - score
        high, low = logistic(upper), logistic(lower)
        chance = np.maximum(high - low, 1e-9)
        # Slopes of the logarithm of the chance by the upper and the lower edge.
        up, down = weight * high * (1 - high) / chance, -weight * low * (1 - low) / chance
        by_score = up + down
        slope = np.zeros_like(free)
        slope[:features] = np.bincount(at, by_score[row] * value, features) / total + penalty * w
        by_cut = np.zeros(top + 2)
        np.add.at(by_cut, grade + 1, -up)
        np.add.at(by_cut, grade, -down)
        by_cut = by_cut[1:-1] / total
        slope[features] = by_cut.sum()
        slope[features + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        free = free - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    cuts = free[features] + np.concatenate(([0.0], np.cumsum(np.exp(free[features + 1 :]))))
    return free[:features], cuts


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from ``labels`` (``doc_id``, ``grade``: 0 for clean) of documents.

    Of a document with several labels the highest counts; rows with a null id, grade or text are left
    out, and equal texts count once.  Without clean or without toxic labels no text is toxic.
    The sample is bounded by ``fit.per_grade``; its statistics and the fit use all of it.
    """
    graded = (
        labels.where("doc_id IS NOT NULL AND grade IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max(F.col("grade").cast("int")).alias("grade"))
    )
    graded = durable(graded)
    sizes = {r["grade"]: r["rows"] for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if min(sizes, default=1) > 0 or max(sizes, default=0) <= 0:
        return Model()
    parts = [
        graded.where(F.col("grade") == g).orderBy(F.xxhash64("label_id"), "label_id").limit(fit.per_grade)
        for g in sorted(sizes)
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    # ``per_grade`` rows of each grade: a proven bound.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sample = sample.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("label_id"))
    sample = durable(sample.groupBy("text").agg(F.max("grade").alias("grade")))
    by_kind = sample.groupBy((F.col("grade") > 0).alias("toxic"))
    held = {r["toxic"]: r["rows"] for r in by_kind.agg(F.count(F.lit(1)).alias("rows")).collect()}
    if len(held) < 2:
        return Model()
    names = _choose(sample, held[True], held[False], fit)
    if not names:
        return Model()
    rows = _matrix(sample, names)
    given = np.array([r["grade"] for r in rows])
    grade = given
    if fit.grades is not None:
        hits = np.array([r["hits"] for r in rows])
        grade = np.where(given > 0, 1 + np.searchsorted(np.array(fit.grades), hits, side="right"), 0)
    # Grades without a text would leave a threshold open.
    present = np.unique(grade)
    # Between equal weight of toxic and clean texts, and weight by how many there are.
    weight = np.where(given > 0, held[True] ** -0.5, held[False] ** -0.5)
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([i for r in rows for i in r["at"]], np.int64)
    value = np.log1p(np.array([n for r in rows for n in r["counts"]], float))
    w, cuts = ordinal_fit(
        np.searchsorted(present, grade), row, at, value, len(names), weight, fit.penalty, fit.steps
    )
    return Model(dict(zip(names, w.tolist(), strict=True)), tuple(cuts.tolist()))


class Scorer:
    """w.x of whole texts, for use inside Arrow tasks."""

    def __init__(self, weights: dict[str, float]):
        self.index = {name: i for i, name in enumerate(weights)}
        self.weights = np.array(list(weights.values()), float)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _features(self, chunks: list[str]) -> list[tuple[int, ...]]:
        cache, index, out = self.cache, self.index, []
        for chunk in chunks:
            found = cache.get(chunk)
            if found is None:
                words = LETTERS.findall(chunk.lower())
                found = tuple(index[f] for w in words for f in word_features(w) if f in index)
                if len(cache) < CACHED_CHUNKS:
                    cache[chunk] = found
            out.append(found)
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        scores = np.zeros(len(texts))
        for first, last in text_slices(texts, SLICE_BYTES):
            lists = pc.utf8_split_whitespace(texts.slice(first, last - first))
            chunks = lists.flatten().dictionary_encode()
            features = self._features(chunks.dictionary.to_pylist())
            sizes = np.fromiter(map(len, features), np.int64, len(features))
            flat = np.array([f for found in features for f in found], np.int64)
            starts = np.cumsum(sizes) - sizes
            codes = chunks.indices.to_numpy()
            ends = lists.offsets.to_numpy()
            doc = np.repeat(np.arange(last - first), np.diff(ends))
            some = sizes[codes] > 0
            codes, doc = codes[some], doc[some]
            if not len(codes):
                continue
            n = sizes[codes]
            at = flat[np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs, counts = np.unique(np.repeat(doc, n) * len(self.weights) + at, return_counts=True)
            doc, at = np.divmod(pairs, len(self.weights))
            scores[first:last] += np.bincount(doc, self.weights[at] * np.log1p(counts), last - first)
        return scores


def linear_score(model: Model, text: Column) -> Column:
    """w.x of each text; a null text scores as an empty one, 0."""
    weights = model.weights
    key = ("scorer", uuid.uuid4().hex)

    def score(texts: pa.Array) -> pa.Array:
        found = held(key, lambda: Scorer(weights))(texts)
        give_back()
        return pa.array(found)

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(text.cast("string"))


def severity(model: Model, score: Column) -> Column:
    """Expected grade: the sum over the thresholds of the chance to be beyond."""
    total = F.lit(0.0)
    for cut in model.thresholds:
        if np.isfinite(cut):
            total = total + 1 / (1 + F.exp(F.lit(float(cut)) - score))
    return total


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade) and ``toxic`` (grade 0 is not the likelier) for every row.

    An empty or null text has no features, so its severity is that of a text without any.  An empty
    table gives no rows; other columns are ignored.
    """
    scored = docs.select("doc_id", linear_score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        severity(model, F.col("score")).alias("severity"),
        (F.col("score") >= F.lit(float(model.thresholds[0]))).alias("toxic"),
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that are toxic; all columns unchanged."""
    score = linear_score(model, F.col("text"))
    kept = docs.withColumn("_tox_score", score).where(F.col("_tox_score") < F.lit(float(model.thresholds[0])))
    return kept.select(*[F.col(f"`{name}`") for name in docs.columns])
