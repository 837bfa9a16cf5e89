"""Operators on vectors, and components, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm.common import connected_components
from caseflow.llm.vector_links import link_vectors
from caseflow.llm.vector_search import top_k

ODD = [None, [], [float("nan")] + [0.5] * 7, [float("inf")] + [0.5] * 7, [None] + [0.5] * 7, [0.0] * 8, [0.5] * 4]


def rows(seed, n=300):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, 8))
    x = centers[rng.integers(0, 12, n)] + 0.15 * rng.standard_normal((n, 8))
    x[: n // 4] = x[0]  # very many equal ones
    out = [(int(i), [float(np.float32(v)) for v in x[k]]) for k, i in enumerate(rng.permutation(n) * 5)]
    return out + [(10_000 + 100 * k, v) for k, v in enumerate(ODD)] + [(None, [0.5] * 8), out[3], out[7]]


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, rank int")


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed):
    data = rows(seed)
    got = top_k(frame(spark, data), F.col("id") % 100 == 0).collect()
    usable = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)), len(v)) for i, v in data if i is not None and good(v)]
    expected = []
    for i, q, d in {i: (i, q, d) for i, q, d in usable if i % 100 == 0}.values():
        found = sorted((-int(q @ v), j) for j, v, e in usable if e == d and j != i)[:10]
        expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(expected)


def test_top_k_of_few_and_of_huge_numbers(spark):
    few = [(0, [1.0, 2.0]), (5, [1e9, -1e9]), (7, [3.0, -1.0])]
    got = top_k(spark.createDataFrame(few, "vec_id long, embedding array<double>"), F.col("id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(7, 1024 * 3072 - 2048 * 1024), (5, 1024 * 1024 * 10**9 - 2048 * 1024 * 10**9)]
    assert top_k(frame(spark, rows(1)).limit(0), F.col("id") == 0).count() == 0


def brute_links(data, threshold=0.9):
    ok = [(k, np.array(v, np.float32).astype(float)) for k, (i, v) in enumerate(data) if i is not None and good(v) and any(x != 0 for x in v)]
    links, parent = [0] * len(data), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(ok):
        for j, y in ok[a + 1 :]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i if i is not None else -1, links[k], least.get(find(k), -1) if i is not None else -1) for k, (i, _) in enumerate(data))


@pytest.mark.parametrize("seed", [3, 4])
def test_links(spark, seed):
    data = rows(seed)
    got = link_vectors(frame(spark, data)).collect()
    found = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in got)
    assert found == brute_links(data)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_clashing_columns_and_long_vectors(spark):
    x = np.random.default_rng(2).standard_normal(5000)
    data = [(1, [float(v) for v in x]), (2, [float(v) for v in x * 1e200]), (3, [float(-v) for v in x]), (4, None)]
    given = spark.createDataFrame([(i, v, i, "a", 7, 8) for i, v in data], "vec_id long, embedding array<double>, n_links long, component_id string, rep int, kept int")
    assert sorted(map(tuple, link_vectors(given).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    got = sorted(map(tuple, top_k(given.where("vec_id in (1, 3, 4)").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y")), F.col("id") == 1).collect()))
    assert [r[:3] for r in got] == [(1, 1, 3)]


def test_scores_of_any_size(spark):
    large = [[1e306, 1.0], [1e308, -1.0], [-1e308, 0.5], [1e17, 3.0], [0.001, 2.0], [1.7e308, 1.7e308], [1e306, 1.0]]
    got = {}
    for r in top_k(spark.createDataFrame(list(enumerate(large)), "vec_id long, embedding array<double>"), F.col("id") >= 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    whole = [[int(v) * 1024 if abs(v) > 2.0**53 else math.floor(1024 * v) for v in x] for x in large]
    for q, x in enumerate(whole):
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in enumerate(whole) if i != q)[:3]
        assert sorted(got[q]) == [(rank, i) for rank, (_, i) in enumerate(best, 1)], q


@pytest.mark.parametrize("bucket", [8, 64])
def test_planted_pairs_are_found_in_many_small_buckets(spark, monkeypatch, bucket):
    """Pairs at cosines from 0.9 on, among vectors of no partner; nothing below 0.9 is linked."""
    monkeypatch.setattr("caseflow.llm.vector_links.BUCKET", bucket)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 1000, 2):
        other = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        cosine = rng.uniform(0.88, 1)
        x[i + 1] = cosine * x[i] + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
    x = x.astype(np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (y @ y.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in link_vectors(frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])).collect()}
    found = np.array([got[i] for i in range(1500)])
    assert (found <= links).all() and found.sum() >= 0.995 * links.sum() > 700


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr("caseflow.llm.vector_links.BLOCK", 500)
    rng = np.random.default_rng(9)
    x = np.array([1.0] * 8) + 0.05 * rng.standard_normal((2600, 8))
    data = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    got = {r["vec_id"]: r for r in link_vectors(frame(spark, data)).collect()}
    y = np.array([v for _, v in data], np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= 0.9).sum(1) - 1
    assert [got[i]["n_links"] for i in range(2600)] == links.tolist() and {r["component_id"] for r in got.values()} == {0}


def test_links_of_nothing(spark):
    assert link_vectors(frame(spark, rows(1)).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, k) for k in range(1001, 1300)] + [(2000 + k, 2001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
