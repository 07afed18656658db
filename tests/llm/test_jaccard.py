import random
import re
from collections import defaultdict

import pytest

from strata.llm import jaccard
from strata.llm.components import components

from . import cases


def brute(rows):
    """All pairs that share a shingle; rows without an id take no part."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = defaultdict(list)
    for i, s in sets:
        for x in s if i is not None else ():
            lists[x].append((i, s))
    for i, s in sets:
        if i is None:
            continue
        for j, t in {(j, t) for x in s for j, t in lists[x]}:
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted((i, len(s), find(i)) if i is not None else (-1, len(s), None) for i, s in sets)


def got(df):
    return sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in df.collect())


def edited(rng, words, share):
    return [rng.choice("pqrstuvw") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    """Chains, families of close copies, a passage in every text, and short texts."""
    rng = random.Random(seed)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 8)  # salted lists at this size
    monkeypatch.setattr(jaccard, "ABOVE", 0.5)
    passage = [f"common{i}" for i in range(30)]
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))
            rows.append((rng.randrange(10**12), " ".join(words + passage * (rng.random() < 0.5))))
    hot = [f"h{i}" for i in range(150)]
    rows += [(10**12 + i, " ".join(edited(rng, hot, 0.012))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard.near_duplicates(df)) == brute(rows)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in cases.DOCS]
    assert got(jaccard.near_duplicates(cases.docs(spark))) == brute(rows)
    assert got(jaccard.near_duplicates(cases.clashing(spark))) == brute(rows)
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0


def test_bitmap_never_exceeds_the_difference():
    import numpy as np
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (10, 13), (70, 60), (500, 400), (5000, 4000)):
        both = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        x, y = np.unique(np.r_[both, rng.integers(0, 2**63, m).astype(np.uint64)]), both
        assert jaccard._differ(jaccard._parity(x), jaccard._parity(y)) <= len(np.setxor1d(x, y))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (None, 4), (160, 7)] * 2
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: 7 for i in [7, *range(100, 161), *range(200, 260)]}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
