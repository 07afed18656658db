import os

import corpus_pipeline as cp
from strata.llm import pii, queries
from tests.oracle import compare, duck

from . import cases
from .test_decontam import brute as contaminated
from .test_jaccard import brute as classes

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_last_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        seen[name] = docs
        out = stage(spark, docs, SF)
        assert name == "encoding" or out.columns == columns
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        seen[name + " out"] = docs
    rows = lambda name: [(r.doc_id, r.text) for r in seen[name].collect()]
    scored = queries.quality.quality(seen["quality"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(i for i, _ in rows("quality out")) == sorted(r.doc_id for r in scored.collect() if r.predicted)
    assert sorted(i for i, _ in rows("near_duplicates out")) == sorted(i for i, _, c in classes(rows("near_duplicates")) if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows("decontamination out")) == sorted(r[0] for r in contaminated(rows("decontamination"), items) if not r[-1])
    redacted = dict(rows("personal_data out"))
    assert redacted == {i: pii.redact(t, pii.find(t)) for i, t in rows("personal_data")}
    assert all(r.n_chars == len(r.text) for r in seen["personal_data out"].collect() if r.text != dict(rows("personal_data"))[r.doc_id])
    last = {r.doc_id: r for r in seen["encoding out"].collect()}
    assert set(last) == set(redacted) and all(r.parity and len(r.ids) == r.n_ids for r in last.values())


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    for docs in (cases.docs(spark), cases.clashing(spark).withColumn("n_chars", cp.F.lit(1)), cases.empty(spark)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            if name in ("personal_data", "encoding"):
                assert out.count() == docs.count()
    kept = cp.drop_near_duplicates(spark, cases.docs(spark), SF).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4, 5, 7, 9, 10] and sum(r.doc_id is None for r in kept) == 2


def test_near_duplicates_judges_rows_that_share_an_id_apart(spark):
    words = lambda x: " ".join(f"{x}{i}" for i in range(40))
    t, u = words("t"), words("u")
    docs = spark.createDataFrame([(1, t, "en", "s", 1), (2, t, "en", "s", 1), (2, None, "en", "s", 1), (2, u, "en", "s", 1), (2, u, "en", "s", 1), (3, t, "en", "s", 1), (3, u + " more", "en", "s", 1)], cases.SCHEMA)
    kept = cp.drop_near_duplicates(spark, docs.withColumn("__row", cp.F.lit(0)), SF).collect()
    assert sorted(((r.doc_id, r.text or "") for r in kept)) == [(1, t), (2, ""), (2, u)]


def test_sql_checked_queries(spark):
    con = duck(SF)
    for name, sql in queries.ORACLES.items():
        ok, why = compare(queries.QUERIES[name](spark, SF), con, sql)
        assert ok, (name, why)


def test_entry_lists_all(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and os.path.exists(cp.__file__)
