"""Held-out accuracy and defined results of the trained operators."""

from strata.llm import quality, queries, secret_scan, toxicity

from . import cases

SF = "/root/testdata/sf0.01"


def held_out(spark, found, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return found.join(labels, "doc_id").where("held_out").select(label, "score", "predicted").collect()


def test_quality_on_held_out_labels(spark):
    rows = held_out(spark, queries.op3_quality(spark, SF), "quality")
    assert len(rows) > 80 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95


def test_toxicity_on_held_out_labels(spark):
    rows = held_out(spark, queries.op8_toxicity(spark, SF), "toxic")
    assert len(rows) > 60 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = ([r.score for r in rows if r.toxic == y] for y in (0, 1))
    pairs = [(g < b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) >= 0.75


def test_fit_equals_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = {0: rng.normal(size=(60, d)), 1: rng.normal(size=(90, d)) @ rng.normal(size=(d, d)) + 1}
    df = spark.createDataFrame([(v.tolist(), y) for y in x for v in x[y]], "statistics array<double>, label int").repartition(4)
    model = quality.fit(df, pooled=0.2, diagonal=0.3)
    both = np.vstack([x[0] - x[0].mean(0), x[1] - x[1].mean(0)])
    scale = both.std(axis=0)
    pooled = np.cov((both / scale).T, bias=True)
    probe = rng.normal(size=(5, d))
    logs = []
    for y in (0, 1):
        s = 0.8 * np.cov((x[y] / scale).T, bias=True) + 0.2 * pooled
        s = 0.7 * s + 0.3 * np.diag(np.diag(s)) + quality.RIDGE * np.eye(d)
        z = probe / scale - x[y].mean(0) / scale
        logs.append(np.log(len(x[y]) / 150) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_edges(spark):
    some = labels(spark, [(1, 1, 0), (3, 0, 0), (5, 0, 1), (7, 1, 0), (7, 1, 0), (None, 1, 1), (8, None, None), (9, 5, 5)])
    for docs in (cases.docs(spark), cases.clashing(spark)):
        found = quality.quality(docs, some).collect()
        assert len(found) == len(cases.DOCS) and all(0 <= r.score <= 1 for r in found)
        assert all(not r.held_out for r in found if r.doc_id is None)
    for rows, share in (([], 0.5), ([(1, 1, 0)], 1.0)):
        assert {r.score for r in quality.quality(cases.docs(spark), labels(spark, rows)).collect()} <= {share, 0.5}
    assert quality.quality(cases.empty(spark), some).count() == 0
    assert quality.reject(cases.clashing(spark), some).columns == cases.clashing(spark).columns


def test_toxicity_locates_the_sentence(spark):
    rows = [(i, f"the day is fine{i % 7}. " + ("you are scum. " if i % 3 == 0 else "all is well. ") + "ü ends here", i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, labels(spark, [(i, 1, int(y)) for i, _, y in rows]))
    for r in toxicity.toxicity(docs, model).collect():
        assert [r.text[s.start:s.end].strip() for s in r.toxic_spans] == (["you are scum"] if r.doc_id % 3 == 0 else [])


def test_toxicity_edges(spark):
    some = labels(spark, [(1, 1, 1), (3, 0, 0), (5, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None)])
    for docs in (cases.docs(spark), cases.clashing(spark)):
        assert toxicity.scores(docs, some).count() == len(cases.DOCS)
    assert {r.score for r in toxicity.scores(cases.docs(spark), some.limit(0)).collect()} == {0.0}
    assert toxicity.scores(cases.empty(spark), some).count() == 0


WORDS = ("there", "other", "would", "about", "which", "their", "people", "commit", "value", "because", "between", "nothing")


def test_secret_forest_learns_labelled_findings(spark):
    import random
    rng = random.Random(2)
    rows, truth = [], []
    for i in range(200):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        word = "".join(rng.choice(WORDS) for _ in range(4))
        text = f'token = "{key}" and commit {key[::-1]} by {word}'
        rows.append((i, text))
        truth += [(i, text.index(v), text.index(v) + len(v), y) for v, y in ((key, 1), (key[::-1], 0), (word, 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = spark.createDataFrame(truth, "doc_id long, start long, end long, label int")
    found = {(r.doc_id, r.start, r.end): r.secret for r in secret_scan.scan(docs, WORDS, judged.where("doc_id % 2 = 0")).collect()}
    held = [(found[(i, a, b)], bool(y)) for i, a, b, y in truth if i % 2 and (i, a, b) in found]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_secret_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, 'key="0a1b2c3d4e5f60718293"'), (3, 'key="0a1b2c3d4e5f60718293"'), (3, 'key="0a1b2c3d4e5f60718293"'), (4, "9f" * 50_000)], "doc_id long, text string")
    found = secret_scan.scan(docs, WORDS).collect()
    assert sum(r.doc_id == 3 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1
    assert secret_scan.scan(cases.clashing(spark), (), None, path_col="digest").count() >= 0
    assert secret_scan.scan(cases.empty(spark), WORDS).count() == 0


def test_secret_candidates_are_read_whole(spark):
    import random
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(40))
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))
    docs = spark.createDataFrame([(1, "=" * 1500 + key), (2, "-" * 60 + key + "-" * 2000), (3, 'key="' + long + '7"'), (4, long), (5, "=" * 5000)], "doc_id long, text string")
    found = secret_scan.candidates(docs, WORDS, secret_scan.transitions(list(WORDS))).withColumn("label", secret_scan.weak_label()).collect()
    assert {r.id: (r.value, r.label) for r in found} == {1: (key, None), 2: (key, None), 3: (long + "7", 1), 4: (long, 0)}
    assert all(r.end - r.start == len(r.value) for r in found) and len(found) == 4


def test_joined_words_are_labelled_as_before(spark):
    import random
    import re
    rng = random.Random(3)
    words = ["".join(rng.choice("aBc-_") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["a" + "-bc" * 50_000]
    rows = spark.createDataFrame(list(enumerate(words)), "i long, value string").selectExpr("*", "'' as before").withColumn("label", secret_scan.weak_label()).collect()
    rule = re.compile("^[A-Za-z][a-z]*$|^[A-Z]+$|^[A-Za-z][a-z]+([-_][A-Z]?[a-z]+)+$|^[0-9-]+$|^[=_/+-]+$")
    assert [r.value[:20] for r in rows if (r.label == 0) != bool(rule.match(r.value))] == []
