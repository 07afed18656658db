import hashlib
import random
import re

from strata.llm import decontam

from . import cases


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            v = words(text)
            k = min(13, len(v))
            for a in range(len(v) - k + 1 if k and item is not None else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == v[a:a + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        out.append((-1 if i is None else i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def cases_with_hits(seed=1):
    rng = random.Random(seed)
    vocab = ["Ab", "cd", "ef", "ü1", "gh", "x9"]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 5, 13, 14, 30])))) for n in range(25)]
    items += [(99, None), (None, "ab cd"), (100, items[-1][1]), (100, items[-1][1])]
    docs = []
    for n in range(60):
        parts = [rng.choice(items[:25])[1].upper() if rng.random() < 0.6 else " ".join(rng.choice(["no", "yes", "Ab", "cd", "ef"]) for _ in range(12)) for _ in range(4)]
        docs.append((n, rng.choice([". ", "--", "\n"]).join(parts)))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (70, ""), (71, None)], items


def test_against_brute_force(spark):
    docs, items = cases_with_hits()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.contamination(d, b)) == brute(docs, items)


def test_several_probe_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "TABLE_WORDS", 40)
    docs, items = cases_with_hits(2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.contamination(d, b)) == brute(docs, items)


def test_edges(spark):
    items = [(1, "f g h"), (2, "consectetur lorem ipsum"), (3, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in cases.DOCS]
    assert got(decontam.contamination(cases.docs(spark), b)) == brute(rows, items)
    assert got(decontam.contamination(cases.clashing(spark), b)) == brute(rows, items)
    assert got(decontam.contamination(cases.docs(spark), b.limit(0))) == brute(rows, [])
    assert decontam.contamination(cases.empty(spark), b).count() == 0
