import random

import numpy as np
import pytest

from strata.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k=20):
    own = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own.setdefault(i, []).append(tuple(np.float32(x) for x in v))
    lengths = [len(v) for vs in own.values() for v in vs]
    if not lengths:
        return {}
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    own = {i: min(v for v in vs if len(v) == d) for i, vs in own.items() if any(len(v) == d for v in vs)}
    ids, x = np.array(list(own)), np.array([own[i] for i in own], float)
    out = {}
    for i in own:
        if is_query(i):
            s = (x * np.array(own[i], float)).sum(axis=1)
            order = np.lexsort((ids, -s))
            out[i] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != i][:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, wanted):
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in wanted.items()) / max(1, sum(map(len, wanted.values())))


@pytest.mark.parametrize("spread", ["isotropic", "clusters", "norms"])
def test_recall_and_scores(spark, spread, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 200)
    monkeypatch.setattr(ann, "CHUNK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 32))
    if spread == "clusters":
        x = x * 0.2 + rng.normal(size=(25, 32))[rng.integers(0, 25, 2500)]
    if spread == "norms":
        x *= rng.gamma(2, 1, size=(2500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    found = got(ann.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(6), "vec_id % 20 = 0"))
    wanted = brute(rows, lambda i: i % 20 == 0)
    assert set(found) == set(wanted) and all(len(v) == 20 for v in found.values())
    assert recall(found, wanted) >= 0.95
    scores = {(q, i): s for q in found for i, s in found[q]}
    for (q, i), s in scores.items():
        assert abs(s - float(np.dot(np.float32(x[q]).astype(float), np.float32(x[i]).astype(float)))) < 1e-9


def test_hot_vector_ties_and_edges(spark):
    rng = random.Random(1)
    hot = [0.5, 0.25, 1.0]
    nan, inf = float("nan"), float("inf")
    rows = [(i, hot if i % 3 else [rng.random(), rng.random(), -1.0]) for i in range(400)]
    rows += [(400, None), (401, [nan, 1.0, 1.0]), (402, [0.0, 0.0, 0.0]), (403, [inf, 1.0, 1.0]), (404, [None, 1.0, 1.0]), (405, []), (406, [1.0]), (None, hot), (40, hot), (60, rows[60][1]), (60, rows[60][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert got(ann.nearest(df, "vec_id % 20 = 0")) == brute(rows, lambda i: i % 20 == 0)
    few = df.where("vec_id < 5")
    assert got(ann.nearest(few, "vec_id % 2 = 0")) == brute([r for r in rows if r[0] is not None and r[0] < 5], lambda i: i % 2 == 0)
    assert ann.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    clash = df.selectExpr("vec_id", "embedding", "1 as id", "2 as key", "'x' as vector", "0 as block", "0 as ids")
    assert got(ann.nearest(clash, "vec_id % 20 = 0")) == brute(rows, lambda i: i % 20 == 0)


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 2) - 5.99146) < 1e-4
    assert abs(ann.chi_square_quantile(0.95, 10) - 18.30704) < 1e-4


def test_equal_scores_of_unequal_vectors_go_to_the_smaller_ids(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, i * 37 % 61 / 64]) for i in range(1, 61)]  # one leaf: the stopping test skips none
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 21)) and {r.score for r in found} == {1.0}
