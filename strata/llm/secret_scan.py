"""Secret scan: entropy proposes candidates, a random forest removes the false positives.

A candidate is a long run of token characters with enough entropy, as a whole or in one of
its windows.  The forest sees its
length, its character transitions, how much of it dictionary words cover, what its path
says, and the words around it.  It is trained from labelled findings.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import text as tx

LEAST_CHARS, LEAST_ENTROPY = 16, 3.0
# Characters before and after a candidate in which words are looked for.
NEAR = 40
# Windows of a long run whose entropy counts by itself: their characters, and the step between them.
WINDOW, STEP = 1024, 512
# Bound of the fit: findings of either label (those with the smallest hashes).
SAMPLE = 10_000
TREES, DEPTH, SEED, THRESHOLD = 40, 8, 7, 0.5

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
# Words before a candidate that speak for or against a secret, and parts of a path.
FOR = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey", "private")
AGAINST = ("sha", "sha1", "sha256", "md5", "hash", "commit", "checksum", "digest", "fingerprint", "uuid", "id", "version", "example", "test", "dummy")
PATHS = ("test", "example", "sample", "doc", "lock", "fixture", "vendor", "config", "env")

FEATURES = ("length", "entropy", "digits", "upper", "lower", "other", "distinct", "switches", "longest_run", "hex", "likelihood",
            "dictionary", "longest_word", "assigned", "quoted", "words_for", "words_against", "path_parts", "line_share")


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in map(s.count, set(s)))


def dense(s: str) -> list[tuple[int, int]]:
    """The stretches of a run that are candidates: all of it where its entropy is enough, else what windows of ``LEAST_CHARS`` with enough
    entropy cover (without repeats of the character beside it), else all of it where a long window has enough."""
    if entropy(s) >= LEAST_ENTROPY:
        return [(0, len(s))]
    if len(set(s)) < 2**LEAST_ENTROPY:
        return []
    n, counts, held, found = LEAST_CHARS, dict.fromkeys(s, 0), 0.0, []
    part = [c * math.log2(c) if c else 0.0 for c in range(n + 2)]
    for i, c in enumerate(s):
        held += part[counts[c] + 1] - part[counts[c]]
        counts[c] += 1
        if i >= n:
            held += part[counts[s[i - n]] - 1] - part[counts[s[i - n]]]
            counts[s[i - n]] -= 1
        if i >= n - 1 and math.log2(n) - held / n >= LEAST_ENTROPY - 1e-9:
            if found and i + 1 - n <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([i + 1 - n, i + 1])
    for f in found:
        a, b = f
        while 0 < a < b and s[a] == s[a - 1]:
            a += 1
        while a < b < len(s) and s[b - 1] == s[b]:
            b -= 1
        f[:] = a, b
    if not found and any(entropy(s[a:a + WINDOW]) >= LEAST_ENTROPY for a in {*range(0, max(1, len(s) - WINDOW), STEP), max(0, len(s) - WINDOW)}):
        return [(0, len(s))]
    return [(a, b) for a, b in found if b > a]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


@lru_cache(maxsize=2)
def _dictionary(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, len(w))
    if words:
        out.make_automaton()
    return out


def _covered(s: str, words: tuple[str, ...]) -> tuple[float, int]:
    """Share of characters inside a dictionary word, and the longest such word."""
    if not words:
        return 0.0, 0
    inside, longest = np.zeros(len(s), bool), 0
    for end, n in _dictionary(words).iter(s.lower()):
        inside[end + 1 - n:end + 1] = True
        longest = max(longest, n)
    return float(inside.mean()), longest


def transitions(texts: list[str]) -> np.ndarray:
    """Log-probabilities of one character kind and letter class following another, from plain texts (smoothed)."""
    counts = np.ones((128, 128))
    for t in texts:
        codes = np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), 127)
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def features(text: str, start: int, end: int, path: str, words: tuple[str, ...], follows: np.ndarray) -> list[float]:
    s = text[start:end]
    kinds = [_kind(c) for c in s]
    n = len(s)
    run = best = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    codes = np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), 127)
    covered, longest = _covered(s, words)
    before = text[max(0, start - NEAR):start]
    near = re.findall(r"[a-z0-9]+", (before + " " + text[end:end + NEAR]).lower())
    line = text[text.rfind("\n", max(0, start - 400), start) + 1:start].strip()
    return [math.log1p(end - start), entropy(s), *(kinds.count(k) / n for k in range(4)), len(set(s)) / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, best / n,
            float(all(c in "0123456789abcdefABCDEF" for c in s)), float(follows[codes[:-1], codes[1:]].mean()), covered, float(longest),
            float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in ("'", '"') and before[-1:] == text[end:end + 1]),
            float(sum(w in FOR for w in near)), float(sum(w in AGAINST for w in near)), float(sum(p in path.lower() for p in PATHS)), 1 / (1 + len(line))]


_OUT = "start bigint, end bigint, value string, before string, after string, features array<double>"


def candidates(docs: DataFrame, words: tuple[str, ...], follows: np.ndarray, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, start, end, value, before, after, features) of every candidate; offsets are code points, end exclusive.

    Null and empty texts have none; a null path is an empty one; rows may repeat.
    """
    rows = tx.in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(path_col).cast("string") if path_col else F.lit("")).alias("path"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for i, text, path in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "path")), strict=True):
            for m in _CANDIDATE.finditer(text or ""):
                for a, b in dense(m.group()):
                    a, b = m.start() + a, m.start() + b
                    for c, x in zip(out, (i, a, b, text[a:b], text[max(0, a - NEAR):a], text[b:b + NEAR], features(text, a, b, path or "", words, follows)), strict=True):
                        c.append(x)
        kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "start", "end", "value", "before", "after", "features"])

    return rows.mapInArrow(tx.by_slices(one), f"id bigint, {_OUT}")


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A forest from rows (features, label) with label 0 or 1, of each at most ``sample``; None unless both occur."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    some = [labelled.where(f"label = {y}").orderBy(F.xxhash64("features"), "features").limit(sample) for y in (0, 1)]
    rows = staged(some[0].union(some[1]).select(array_to_vector("features").alias("__x"), F.col("label").cast("double").alias("label")), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(rows.repartition(1).sortWithinPartitions("label", F.xxhash64(vector_to_array("__x"))))


def judge(found: DataFrame, model) -> DataFrame:
    """The findings with the forest's score and whether it keeps them; without a model all are kept with score 1."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model is None:
        return found.withColumns({"score": F.lit(1.0), "secret": F.lit(True)})
    judged = model.transform(found.withColumn("__x", array_to_vector("features")).withColumnRenamed("features", "__f"))
    return (judged.withColumn("score", vector_to_array(model.getProbabilityCol())[1]).withColumnRenamed("__f", "features")
            .drop("__x", model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol()).withColumn("secret", F.col("score") >= THRESHOLD))


def weak_label() -> Column:
    """A label for findings nobody has judged: 1 where a secret's name is assigned the value, 0 where all letters are of one dictionary-like word or a hash is named, else null."""
    named = r"(?i)(token|key|secret|password|passwd|pwd)[a-z_]*[\"']?\s*[=:]\s*[\"']?$"
    v = F.col("value")
    # words joined by - or _, without a repeated group: values can be long
    joined = v.rlike("^[A-Za-z][a-z][A-Za-z_-]*+$") & v.rlike("[-_]") & v.rlike("[a-z]$") & ~v.rlike("[-_](?![A-Z]?[a-z])|(?<=[^-_])[A-Z]")
    return (F.when(F.col("before").rlike(named) & F.col("value").rlike("[0-9]"), 1)
            .when(F.col("before").rlike(r"(?i)(sha1?|sha256|md5|commit|checksum|fingerprint|digest|uuid)[a-z_]*[\"']?\s*[=:]?\s*[\"']?$"), 0)
            .when(joined | v.rlike("^[A-Za-z][a-z]*+$|^[A-Z]++$|^[0-9-]++$|^[=_/+-]++$"), 0))


def scan(docs: DataFrame, words: tuple[str, ...], labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, start, end, value, score, secret) of every candidate in ``docs``.

    ``labelled`` holds judged findings (id, start, end, label); without it findings are
    labelled by ``weak_label`` where that applies.  The character model comes from the
    dictionary ``words``.  Repeated rows give repeated findings; with labels of one kind
    only, every candidate is kept.  An empty table gives an empty result.
    """
    found = staged(candidates(docs, words, transitions(list(words)), id_col, text_col, path_col), "candidates")
    if labelled is None:
        known = found.withColumn("label", weak_label())
    else:
        known = found.join(labelled.select(F.col(id_col).alias("id"), "start", "end", "label"), ["id", "start", "end"])
    model = train(known.where("label in (0, 1)"))
    return judge(found, model).select(F.col("id").alias(id_col), "start", "end", "value", "score", "secret")
