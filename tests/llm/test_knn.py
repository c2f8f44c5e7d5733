"""Top-k against brute force, with ties, odd vectors and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayspark.llm import knn, queries


def plain(queries, data, k):
    width = max([len(v) for _, v in queries + data], default=0)
    full = lambda v: [int(x) for x in v] + [0] * (width - len(v))
    out = set()
    for key in {q for q, _ in queries}:
        best = {}
        for q, v in queries:
            for i, w in data:
                if q == key and i != q:
                    score = sum(a * b for a, b in zip(full(v), full(w), strict=True))
                    best[i] = max(best.get(i, score), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(key, r + 1, i, s) for r, (i, s) in enumerate(ranked)}
    return out


def run(spark, queries, data, k):
    frames = [spark.createDataFrame(rows, "id long, vector array<double>").repartition(3) for rows in (queries, data)]
    got = knn.top_k(*frames, k).collect()
    assert len(set(map(tuple, got))) == len(got)
    return {tuple(r) for r in got}


@pytest.mark.parametrize("sizes", [(2048, 8192, 4096, 256), (7, 40, 30, 5)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("GROUP", "PART", "SAMPLE", "PIVOTS"), sizes, strict=True):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 30, (6, 8))
    data = [(i, np.floor(centres[i % 6] + rng.normal(0, 3, 8)).tolist()) for i in range(260)]
    data += [(1000 + i, [1.0] * 8) for i in range(90)]  # a hot vector: ties
    data += [(2000, [0.0] * 8), (2001, []), (2002, [5.0]), (2003, [1e6] * 8), (2004, [-1e6] * 9), (3, data[3][1]), (4, data[5][1])]
    queries = data[::9] + [data[-1], data[3]]
    assert run(spark, queries, data, 20) == plain(queries, data, 20)


def test_few_candidates_and_large_numbers(spark):
    big = 2.0**24
    data = [(1, [big] * 64), (2, [big, -big] * 32), (3, [big - 1] * 64)]
    assert run(spark, data, data, 20) == plain(data, data, 20)
    assert run(spark, [(9, [1.0])], data, 2) == plain([(9, [1.0])], data, 2)


@pytest.mark.parametrize("sizes", [(2048, 8192, 4096, 256), (7, 16, 30, 5)])
def test_outliers_beside_usual_vectors(spark, monkeypatch, sizes):
    for name, value in zip(("GROUP", "PART", "SAMPLE", "PIVOTS"), sizes, strict=True):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(6)
    data = [(i, np.floor(rng.normal(0, 30, 4)).tolist()) for i in range(60)]
    # Products beyond longs cancel out; doubles lose the small parts.
    data = [(i, [v[0], v[1], v[0], v[3]]) if i % 2 else (i, [0.0, v[1], 0.0, v[3]]) for i, v in data]
    data += [
        (100, [2.0**62, 5.0, -(2.0**62), 2.0]), (101, [0.0, 2.0**40 + 1, 0.0, 9.0]), (102, [2.0**62, 6.0, -(2.0**62), 2.0]), (103, [0.0] * 4),
    ]
    asked = [(200, [0.0, 2.0**20 + 1, 0.0, 9.0]), (201, [1.0, 2.0, 1.0, 0.0]), (202, [2.0**45, 1.0, 2.0**45, 3.0])]
    asked += [data[i] for i in (0, 1, 4, -1)]
    want = plain(asked, data, 12)
    assert max(abs(s) for *_, s in want) < 2**63
    assert run(spark, asked, data, 12) == want


def test_scores_that_fit_no_long(spark):
    large = [(1, [2.0**62]), (2, [2.0**62]), (3, [-(2.0**62)]), (4, [1.0])]
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(9, [4.0])], large, 1)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(9, [-4.0])], large, 4)
    below = [(9, [-4.0])], [(1, [2.0**62]), (2, [2.0**62]), (4, [1.0]), (5, [0.0])]
    assert run(spark, *below, 2) == plain(*below, 2)


def test_query_keeps_all_finite_vectors(spark, tmp_path):
    rows = [(0, [300_000.0, 1.0]), (1, [1.0, 2.0]), (2, [3e9, 0.5]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [-2e8, 7.0])]
    rows += [(20, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    f32 = lambda v: [int(np.floor(64 * float(np.float32(x)))) for x in v]
    data = [(k, f32(v)) for k, v in rows if k not in (3, 4)]
    got = {tuple(r) for r in queries.QUERIES["op6_top_k"](spark, str(tmp_path)).collect()}
    assert got == plain([r for r in data if r[0] % 20 == 0], data, 20) and len(got) == 8


def test_no_rows(spark):
    one = [(1, [1.0])]
    assert run(spark, [], one, 3) == set() == run(spark, one, [], 3) == run(spark, one, one, 3)


def test_which_vectors_take_part(spark):
    rows = [
        (1, [0.5, -0.01]), (2, None), (3, [None, 1.0]), (4, [float("nan")]), (5, [float("inf")]), (6, []), (7, [3e38]),
    ]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {r.id: r.v for r in frame.select("id", knn.integer_vectors(F.col("embedding")).alias("v")).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: [], 7: [64 * float(np.float32(3e38))]}


@pytest.mark.parametrize("size", [2.0**499, 2.0**500, 2.0**600, 2.0**1015])
def test_components_of_any_finite_size(spark, monkeypatch, size):
    monkeypatch.setattr(knn, "PIVOTS", 3)
    rng = np.random.default_rng(7)
    data = [(i, [0.0, *map(float, rng.integers(-90, 90, 3))]) for i in range(60)]
    data += [(100, [size, 1.0, 2.0, 3.0]), (101, [-size, 80.0, 80.0, 80.0]), (102, [size, 0.0, 0.0, 0.0])]
    asked = [(200, [0.0, 3.0, -2.0, 5.0]), (201, [0.0, 1.0, 1.0, 9.0]), data[0], (202, [0.0] * 4)]
    assert run(spark, asked, data, 5) == plain(asked, data, 5)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(300, [4.0])], data, 1)
