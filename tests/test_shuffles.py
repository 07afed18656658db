"""Permutations of their own for every feature and repeat."""

import hashlib

import pytest

import __spark_entry__ as entry
from strata.operators import score

FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("bucket", [score.SHUFFLE_BUCKET, 1])
def test_every_feature_is_shuffled_apart(spark, monkeypatch, bucket):
    monkeypatch.setattr(score, "SHUFFLE_BUCKET", bucket)
    data = [("g" if i % 3 else "h", i * 37 % 1000 - 300, i * 1.5, None if i % 7 == 0 else float(-i), f"t{i}" if i % 5 else None) for i in range(300)]
    rows = spark.createDataFrame(data, "grp string, id bigint, a double, b double, c string")
    got = {}
    for r in score.shuffled_rows(rows, ["grp"], "id", ["id"], ["a", "b"], ["c"], repeats=2, seed=7).collect():
        got[r.grp, r.id, r.rep] = tuple(r[f"{f}_perm"] for f in FEATURES)
        assert (r.grp, r.id, r.a, r.b, r.c) in set(data)
    assert len(got) == 2 * len(data)
    for g in "gh":
        own = sorted((x for x in data if x[0] == g), key=lambda x: x[1])
        for rep in range(2):
            for j, f in enumerate(FEATURES):
                order = sorted(own, key=lambda x: (hashlib.md5(f"7|{f}|{rep}|{x[1]}".encode()).hexdigest(), x[1]))
                assert [got[g, x[1], rep][j] for x in own] == [x[2 + j] for x in order]


def test_rows_that_share_an_id_are_all_kept(spark):
    rows = spark.createDataFrame([("g", 1, float(i)) for i in range(6)], "grp string, id bigint, a double")
    got = score.shuffled_rows(rows, ["grp"], "id", ["id"], ["a"], repeats=2).collect()
    for rep in range(2):
        assert sorted(r.a_perm for r in got if r.rep == rep) == sorted(r.a for r in got if r.rep == rep) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_statements_shuffle_each_feature_and_repeat():
    sql = entry.oracle_sql()
    for name in ("R05_combine_scores", "R06_top_m_per_fold", "R07_global_scope", "R09_selection_report"):
        assert "PARTITION BY environment, k, feature, rep" in sql[name] and "|| feature || '|' || rep || '|' || row_id" in sql[name]
