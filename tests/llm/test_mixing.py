import hashlib

from strata.llm import mixing
from strata.llm.order import in_order, running

from . import cases


def brute(docs, weights, share=1.5, epochs=2, seed="mix"):
    """{(doc_id, source): ...} by filling the sources round by round."""
    size = lambda t: len((t or "").encode().split())
    names = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(d[1]) for d in docs if d[3] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= epochs * sizes[s]}
        if not full:
            goal |= {s: level * weight[s] for s in free}
            break
        goal |= {s: float(epochs * sizes[s]) for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        free -= full
    out = []
    for s in names:
        own = sorted((d for d in docs if d[3] == s), key=lambda d: (hashlib.md5(f"{seed}:{'-' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0, size(d[1])))
        rest, before = int(goal[s]), 0
        times = rest // sizes[s] if sizes[s] else 0
        rest -= times * sizes[s]
        for d in own:
            n = size(d[1])
            out.append((d[0], n, sizes[s], round(goal[s], 6), times * n + max(0, min(n, rest - before))))
            before += n
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows.collect()), key=str)


def test_against_brute_force(spark):
    rows = [(i % 90, " ".join(["w"] * (i * 7 % 23)), None, [None, "a", "b", "é", "", "z"][min(i % 11, 5)], None) for i in range(150)] + cases.DOCS
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(5)
    for weights, share in (((3, 1, 2), 1.5), ((1, 100), 0.4), ((2,), 9.0)):
        found = mixing.mix(docs, weights, share)
        assert got(found) == brute(rows, weights, share)
    goal = {s: t for _, _, s, t, _ in got(mixing.mix(docs, (3, 1, 2)))}
    assert abs(sum(r[4] for r in got(mixing.mix(docs, (3, 1, 2)))) - sum(r[1] for r in got(mixing.mix(docs, (3, 1, 2)))) * 1.5) <= len(goal)


def test_weight_table_and_drawn_texts(spark):
    docs = spark.createDataFrame([(i, f" w{i} x{i}  y{i}\n", "en", "ab"[i % 2], 1) for i in range(40)], cases.SCHEMA)
    weights = spark.createDataFrame([("a", 1.0), ("b", None)], "source string, weight double")
    mixed = mixing.mix(docs, weights, share=0.71, keep=("text", "doc_id"))
    rows = mixed.collect()
    assert all(r.taken == 0 for r in rows if r.doc_id % 2) and sum(r.taken for r in rows) == int(120 * 0.71)
    drawn = mixing.drawn(mixed).collect()
    words = {}
    for r in drawn:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.text == f" w{r.doc_id} x{r.doc_id}  y{r.doc_id}\n" or f" w{r.doc_id} x{r.doc_id}  y{r.doc_id}".startswith(r.text)
    assert words == {r.doc_id: r.taken for r in rows if r.taken}


def test_hot_key_clashes_and_empty(spark):
    same = [(1, "a b c", "en", "s", 1)] * 300 + [(i, "d e", "en", "t", 1) for i in range(30)]
    docs = spark.createDataFrame(same, cases.SCHEMA)
    first = got(mixing.mix(docs, (3, 1, 2)))
    assert first == got(mixing.mix(docs.repartition(7), (3, 1, 2))) == brute(same, (3, 1, 2))
    assert mixing.mix(cases.empty(spark), (3, 1, 2)).count() == 0
    for name in ("size", "id", "kept", "order_key", "source_key", "part", "row"):
        assert mixing.mix(docs.withColumn(name, mixing.F.lit("z")), (3, 1, 2)).count() == 330
    assert mixing.mix(cases.clashing(spark).withColumn("source", mixing.F.lit(None).cast("string")), (3, 1, 2)).count() == len(cases.DOCS)


def test_order_and_prefix_sums(spark):
    rows = spark.range(3000).select((mixing.F.col("id") % 3).alias("g"), mixing.F.when(mixing.F.col("id") % 2 == 0, 7).otherwise(mixing.F.col("id") * 7919 % 101).alias("x"), (mixing.F.col("id") % 5).alias("v"), "id")
    ordered = in_order(rows, ["x"], 3000, part_rows=100)
    parts = ordered.groupBy("part").count().collect()
    assert len(parts) >= 20 and max(r["count"] for r in parts) < 600  # half of the rows tie, and are cut apart all the same
    xs = [r.x for r in ordered.orderBy("row").collect()]
    assert xs == sorted(xs)
    placed = running(rows, ["x", "id"], ["v"], 3000, ["g"]).collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in placed if r.g == g), key=lambda r: (r.x, r.id)):
            assert r.before_v == total
            total += r.v
