"""The severity model: held-out accuracy, its gradient, and odd rows."""

import numpy as np
import pytest
from llm_tables import documents
from pyspark.sql import functions as F

from stayspark.llm import queries, toxicity

TABLES = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    """Fitted on three quarters of the labels, judged on the others."""
    docs = queries.read(spark, TABLES, "documents")
    labels = queries.toxic_labels(spark, TABLES)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit_model(docs, labels.where(~held_out))
    scored = toxicity.score_documents(docs, model).join(labels.where(held_out), "doc_id").collect()
    toxic = [r for r in scored if r.grade]
    clean = [r for r in scored if not r.grade]
    assert len(toxic) > 80 and len(clean) > 700
    assert sum(r.toxic for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert np.mean([r.severity for r in toxic]) > 1 > 0.1 > np.mean([r.severity for r in clean])


def likelihood(free, grade, rows, features, weight, penalty):
    w = free[:features]
    cuts = free[features] + np.concatenate(([0.0], np.cumsum(np.exp(free[features + 1 :]))))
    edges = np.concatenate(([-np.inf], cuts, [np.inf]))
    score = rows @ w
    s = lambda x: 1 / (1 + np.exp(-x))
    chance = s(edges[grade + 1] - score) - s(edges[grade] - score)
    return -(weight * np.log(chance)).sum() / weight.sum() + penalty * (w @ w) / 2


def test_fit_is_near_the_optimum_and_ordered():
    rng = np.random.default_rng(0)
    rows = rng.poisson(0.5, (400, 6)).astype(float)
    true = np.array([1.5, -1.0, 0.0, 0.7, 0.0, 2.0])
    noisy = rows @ true + rng.logistic(size=400)
    grade = np.searchsorted([0.5, 2.0, 4.0], noisy)
    at = np.nonzero(rows)
    weight = rng.uniform(0.5, 2, 400)
    w, cuts = toxicity.ordinal_fit(grade, at[0], at[1], rows[at], 6, weight, 1e-3, 1500)
    assert (np.diff(cuts) > 0).all() and np.abs(w - true).max() < 0.6
    free = np.concatenate((w, cuts[:1], np.log(np.diff(cuts))))
    best = likelihood(free, grade, rows, 6, weight, 1e-3)
    for i in range(len(free)):
        for step in (-0.05, 0.05):
            other = free.copy()
            other[i] += step
            assert likelihood(other, grade, rows, 6, weight, 1e-3) >= best - 1e-6


def graded(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, grade int")


def small(spark):
    texts = [(i, f"plain words {'more ' * (i % 12)} here {i}") for i in range(200)]
    texts += [(1000 + i, f"plain words {'vileness ' * (1 + i % 12)} here {i}") for i in range(100)]
    labels = [(k, int(k >= 1000)) for k, _ in texts]
    return documents(spark, texts), graded(spark, [*labels, (5, 0), (7, None), (None, 1), (99999, 1)])


FIT = toxicity.Fit(least_docs=3, least_z=2.0)


def test_odd_texts_are_scored(spark):
    model = toxicity.fit_model(*small(spark), FIT)
    rows = [(1, None), (2, ""), (3, "Vileness!"), (4, "VILENESS, " * 30_000), (5, "é 日本"), (5, "é 日本"), (None, "vileness")]
    docs = documents(spark, rows)
    got = toxicity.score_documents(docs, model).collect()
    assert sorted((r.doc_id or 0, r.toxic) for r in got) == [
        (0, True), (1, False), (2, False), (3, True), (4, True), (5, False), (5, False)
    ]
    severity = {r.doc_id: r.severity for r in got}
    assert severity[4] > severity[3] > severity[1] == severity[2]
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 5]
    assert toxicity.score_documents(documents(spark, []), model).collect() == []


def test_given_grades_are_taken_as_they_are(spark):
    docs, _ = small(spark)
    labels = [(i, 0) for i in range(200)] + [(1000 + i, 1 + (i % 12 > 5)) for i in range(100)]
    fit = toxicity.Fit(least_docs=3, least_z=2.0, grades=None)
    model = toxicity.fit_model(docs, graded(spark, labels), fit)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    score = {r.doc_id: r.severity for r in toxicity.score_documents(docs, model).collect()}
    assert score[1011] > 1.4 > score[1000] > 0.6 > score[0]


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(4000, 1), (4001, 0)], [(None, 1)]])
def test_too_few_labels_make_nothing_toxic(spark, labels):
    docs, _ = small(spark)
    model = toxicity.fit_model(docs, graded(spark, labels), FIT)
    assert toxicity.drop_toxic(docs, model).count() == 300
    assert {r.severity for r in toxicity.score_documents(docs, model).collect()} == {0.0}


def test_scorer_sees_the_features_of_whole_texts():
    weights = {"=abc": 1.0, "^abc": 0.5, "bcd$": -2.0}
    import pyarrow as pa

    texts = ["abc Abcd abc-abc", "x", None, "ABC,abc\nzabcd " * 9]
    got = toxicity.Scorer(weights)(pa.array(texts, pa.string()))
    for text, score in zip(texts, got, strict=True):
        counts = toxicity.text_features(text or "")
        assert score == pytest.approx(sum(w * np.log1p(counts[f]) for f, w in weights.items()))


def planted(rng, grade):
    """Text of 40 to 120 words whose share of mild and of harsh words follows a planted severity, with noise.

    No word tells a grade by itself, and lengths do not depend on it.
    """
    harsh = np.clip((grade - 1) * 0.08 + rng.normal(0, 0.02), 0, 1)
    mild = np.clip(grade * 0.06 + rng.normal(0, 0.02), 0, 1) if grade < 3 else 0.06
    kinds = rng.choice(3, rng.integers(40, 120), p=[1 - harsh - mild, mild, harsh])
    words = ("zebra lemon table river cloud paper stone glass".split(), "gruff snarky pesky".split(),
             "vilebrute scumlout hatemonger".split())
    return " ".join(words[kind][rng.integers(len(words[kind]))] for kind in kinds)


def test_planted_grades_are_ranked(spark):
    """Grades that come from a planted severity, not from the features: fitted on half, judged on the others."""
    rng = np.random.default_rng(5)
    grades = {i: i % 4 for i in range(1200)}
    docs = documents(spark, [(i, planted(rng, grade)) for i, grade in grades.items()])
    labels = graded(spark, list(grades.items()))
    model = toxicity.fit_model(docs, labels.where("doc_id < 600"), toxicity.Fit(grades=None, least_z=2.0))
    assert len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)
    rows = toxicity.score_documents(docs.where("doc_id >= 600"), model).select("doc_id", "severity").collect()
    assert len(rows) == 600
    by_grade = [np.array([r.severity for r in rows if grades[r.doc_id] == g]) for g in range(4)]
    means = [float(s.mean()) for s in by_grade]
    off = float(np.abs(np.concatenate([s - g for g, s in enumerate(by_grade)])).mean())
    # Guessing 1.5 for every text would be off by 1.  How well neighbouring grades are told apart is in the README.
    assert means == sorted(means) and off < 0.5
