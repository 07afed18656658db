"""Toxicity by multiple-instance learning: document labels train a sentence score.

A document is toxic if one of its sentences is: its probability is the noisy-or of its
sentences' probabilities and of a leak that stands for labels no sentence explains.  A
sentence's probability is logistic in the vocabulary words it holds; a sentence without
any is never toxic, so long clean texts stay clean.  The vocabulary is chosen, and the
weights are trained, from document labels alone; the same scores then point out the
offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .quality import held_out

# Bounds of the fit: labelled training rows (those with the smallest hashes of their id), words.
SAMPLE, WORDS = 40_000, 2_000
# A word enters the vocabulary from this many toxic documents and this chi-square on.
LEAST, CHI_SQUARE = 4, 25.0
# Beginnings of a word that count besides the word, in bytes.
BEGIN = (5, 6, 7)
RIDGE, STEPS, RATE = 2.0, 400, 0.05
# Document and sentence probabilities from which they count as toxic.
THRESHOLD = 0.3


def marks(words: Iterable[bytes]) -> set[bytes]:
    """The words and, with a star, their beginnings."""
    found = set(words)
    return found | {w[:k] + b"*" for w in found for k in BEGIN if len(w) > k}


_BREAK = re.compile(rb"[.!?\n]+")


def sentences(data: bytes):
    """(start, end, bytes) of every stretch between full stops, exclamation and question marks and line ends."""
    at = 0
    for m in _BREAK.finditer(data):
        if m.start() > at:
            yield at, m.start(), data[at:m.start()]
        at = m.end()
    if at < len(data):
        yield at, len(data), data[at:]


@dataclass
class Model:
    words: dict[bytes, int]
    weights: np.ndarray
    bias: float
    leak: float

    def instances(self, data: bytes) -> list[tuple[int, int, list[int]]]:
        """The sentences that hold vocabulary words, as (start byte, end byte, word numbers)."""
        if self.words.keys().isdisjoint(marks(tx.alnum_words(data))):
            return []
        return [(a, b, own) for a, b, s in sentences(data) if (own := sorted(self.words[w] for w in marks(tx.alnum_words(s)) if w in self.words))]

    def score(self, data: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start byte, end byte, probability) of sentences with vocabulary words."""
        clean, found = 1 - self.leak, []
        for a, b, own in self.instances(data):
            p = float(1 / (1 + np.exp(-(self.weights[own].sum() + self.bias))))
            clean *= 1 - p
            found.append((a, b, p))
        return min(1.0, max(0.0, 1 - clean)), found


def _word_counts(batches):
    """Per task: documents of either label that hold each word."""
    seen: dict[bytes, list[int]] = {}

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["word", "clean", "toxic"])
        seen.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, tx.ROWS):
            part = batch.slice(at, tx.ROWS)
            for data, y in zip(tx.utf8(part.column("text")), part.column("label").to_pylist(), strict=True):
                for w in marks(tx.alnum_words(data)):
                    seen.setdefault(w, [0, 0])[y] += 1
            if len(seen) > 200_000:
                yield rows()
    yield rows()


def _bags(model: Model):
    """Per document its label and its distinct instances with their numbers, as text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = []
        for data in tx.utf8(batch.column("text")):
            times = Counter(tuple(own) for _, _, own in model.instances(data))
            bags.append(";".join(f"{n}:{','.join(map(str, own))}" for own, n in sorted(times.items())))
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bags, pa.string())], ["label", "bag"])
    return tx.by_slices(run)


def _train(bags: list[tuple[int, str, int]], n_words: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that minimise the log loss of the noisy-or; bags are (label, bag, how often)."""
    label, often, doc, times, row, col = [], [], [], [], [], []
    for y, bag, n in bags:
        for part in bag.split(";") if bag else ():
            k, _, own = part.partition(":")
            for w in own.split(","):
                row.append(len(doc)), col.append(int(w))
            doc.append(len(label)), times.append(int(k))
        label.append(y), often.append(n)
    y, often = np.array(label, float), np.array(often, float)
    doc, times, row, col = np.array(doc, int), np.array(times, float), np.array(row, int), np.array(col, int)
    total = max(1.0, often.sum())
    x = np.concatenate([np.full(n_words, 1.0), [-2.0, np.log((often * y).sum() + 1) - np.log(total) - 2]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, x[col], minlength=len(doc)) + x[-2]
        leak = 1 / (1 + np.exp(-x[-1]))
        evidence = np.bincount(doc, times * np.logaddexp(0, z), minlength=len(y)) - np.log1p(-leak)
        slope = often * np.where(y > 0, -1 / np.expm1(np.clip(evidence, 1e-9, 500)), 1.0)
        own = slope[doc] * times / (1 + np.exp(-z)) if len(doc) else np.zeros(0)
        g = np.concatenate([np.bincount(col, own[row], minlength=n_words) + RIDGE * x[:-2], [own.sum(), (slope * leak).sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return x[:-2], float(x[-2]), float(1 / (1 + np.exp(-x[-1])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled rows whose crc32(id as text) mod 4 is not 2."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id", 4, 2))
             .orderBy(F.xxhash64("id"), "id", "label").limit(sample))
    # at most ``sample`` rows of two numbers
    texts = tx.in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("label", "text")
    counts = texts.mapInArrow(_word_counts, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = (known.where(f"label = {y}").count() for y in (0, 1))
    if not n0 or not n1:
        return Model({}, np.zeros(0), 0.0, float(n1 / (n0 + n1)) if n0 + n1 else 0.0)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n = float(n0 + n1)
    gap = a * (n0 - b) - b * (n1 - a)
    chosen = (counts.where(f"toxic >= {LEAST}").withColumn("chi", n * gap * gap / (n1 * float(n0) * (a + b) * (n - a - b) + 1e-9))
              .where((gap > 0) & (F.col("chi") >= CHI_SQUARE)).orderBy(F.desc("chi"), "word").limit(WORDS).collect())
    draft = Model({bytes(r["word"]): i for i, r in enumerate(chosen)}, np.zeros(len(chosen)), 0.0, 0.0)
    bags = texts.mapInArrow(_bags(draft), "label int, bag string").groupBy("label", "bag").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "bag").collect()
    return Model(draft.words, *_train([tuple(r) for r in bags], len(chosen)))


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", spans_col: str = "toxic_spans", keep_text: bool = True) -> DataFrame:
    """``docs`` with a toxicity score and the offending sentences (start, end in code points, score).

    Offending are sentences with a score of at least ``THRESHOLD``.  Null and empty texts
    get the leak as score and no spans.  Rows are handled one by one: repeated rows, null
    ids and other columns pass through (columns named like the outputs are replaced); an
    empty table gives an empty result.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(texts: pa.Array) -> list[pa.Array]:
        scores, spans = [], []
        for data in tx.utf8(texts):
            s, found = model.score(data)
            at = lambda i: len(data[:i].decode())  # noqa: B023, E731
            scores.append(s), spans.append([{"start": at(a), "end": at(b), "score": p} for a, b, p in found if p >= THRESHOLD])
        return [pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))]

    return tx.mapped(docs, text_col, run, {score_col: "double", spans_col: "array<struct<start:bigint,end:bigint,score:double>>"}, keep_text)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, n_offending) of every row; learns only outside the held-out quarter.

    Label rows with a null id or label, or another value than 0 and 1, are ignored, and
    repeated ones count each time.  Without labels of both classes every text scores the
    share of label 1 (0 if there are none).
    """
    model = fit(docs, labels, id_col, text_col)
    found = toxicity(docs.select(id_col, text_col), model, text_col, "score", "toxic_spans", False)
    return found.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
                        F.size("toxic_spans").cast("long").alias("n_offending"))
