"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Both classes get a mean and a covariance that is shrunk towards the pooled one and towards
its own diagonal.  A text's score is the logistic of the difference of the two Gaussian log
densities, each a Mahalanobis distance taken with the class's cached Cholesky factor.
Fitting needs only sums of the statistics and of their products, which Spark adds up over
all labelled training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import text as tx

# Shrinkage of a class covariance: share of the pooled covariance, share of the diagonal.
POOLED, DIAGONAL = 0.1, 0.1
# Ridge on every variance (statistics are scaled to unit pooled variance).
RIDGE = 1e-3

_BYTES = np.arange(256)
_SETS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "stop": np.isin(_BYTES, list(b".,;:'\"?-")),
    "wide": _BYTES >= 0xC0,
    "blank": np.isin(_BYTES, list(b" \t\r\v\f")),
    "line": _BYTES == 10,
}
_SETS["symbol"] = ~np.any([*_SETS.values()], axis=0) & (_BYTES < 0x80)
STATISTICS = ("log_bytes", "log_words", "word_length", *(f"root_{k}" for k in _SETS), "new_words", "new_lines", "top_word", "marked_words", "shout_words", "line_words")


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one text: logarithms of counts, square roots of shares."""
    n = len(data)
    words = data.split()
    m = len(words)
    if not m:
        return [np.log1p(n), 0.0] + [0.0] * (len(STATISTICS) - 2)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [np.sqrt(counts[s].sum() / n) for s in _SETS.values()]
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = shout = 0
    for w, c in times.items():
        if not (w[-1:].isalnum() or w[-1] in b".,;:!?" or w[-1] >= 0x80):
            marked += c
        if len(w) > 1 and w.isupper():
            shout += c
    return [np.log1p(n), np.log1p(m), np.log1p(n / m), *shares, np.sqrt(len(times) / m), np.sqrt(len(set(lines)) / max(1, len(lines))),
            np.sqrt(max(times.values()) / m), np.sqrt(marked / m), np.sqrt(shout / m), np.log1p(m / max(1, len(lines)))]


def _statistics(texts: pa.Array) -> list[pa.Array]:
    return [pa.array([statistics(d) for d in tx.utf8(texts)], pa.list_(pa.float64()))]


def with_statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    return tx.mapped(docs, text_col, _statistics, {"statistics": "array<double>"}, keep_text)


@dataclass
class Discriminant:
    """Per class: prior, mean, inverse Cholesky factor and log determinant, on scaled statistics."""

    scale: np.ndarray
    prior: list[float]
    mean: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1); the share of label 1 (one half without labels) where a class was never seen."""
        if len(self.mean) < 2:
            return np.full(len(x), self.prior[1])
        density = []
        for p, mean, inverse, log_det in zip(self.prior, self.mean, self.inverse, self.log_det, strict=True):
            z = (x / self.scale - mean) @ inverse.T
            density.append(np.log(p) - 0.5 * log_det - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def _moments(batches):
    """Per task and label: number of rows, sums, and sums of products, as (label, place, value)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        x = np.array(batch.column("statistics").to_pylist(), float).reshape(batch.num_rows, -1)
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for label in np.unique(y).tolist():
            own = np.hstack([np.ones(((y == label).sum(), 1)), x[y == label]])
            total[label] = total.get(label, 0) + own.T @ own
    for label, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([label] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], ["label", "place", "value"])


def fit(labelled: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Fit on rows (statistics, label); labels other than 0 and 1 are left out."""
    rows = (labelled.where("label in (0, 1) and statistics is not null").select("statistics", F.col("label").cast("int").alias("label"))
            .mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect())
    d = len(STATISTICS) + 1
    m = np.zeros((2, d * d))
    for r in rows:
        m[r["label"], r["place"]] = r["value"]
    m = m.reshape(2, d, d)
    n = m[:, 0, 0]
    if not n.all():
        return Discriminant(np.ones(d - 1), [1 - (p := n[1] / n.sum() if n.sum() else 0.5), p], [], [], [])
    mean = m[:, 0, 1:] / n[:, None]
    cov = np.array([m[c, 1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    both = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both), 1e-12))
    both = both / np.outer(scale, scale)
    inverse, log_det = [], []
    for c in (0, 1):
        s = (1 - pooled) * cov[c] / np.outer(scale, scale) + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + RIDGE * np.eye(d - 1)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(scale, (n / n.sum()).tolist(), [*(mean / scale)], inverse, log_det)


def held_out(id_col: str, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``which``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == which, F.lit(False))


def train(statistics_of: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on the labelled rows outside the held-out third; a repeated label row counts each time."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out("id", 3, 1) & F.col("label").isin(0, 1))
    return fit(statistics_of.select(F.col(id_col).alias("id"), "statistics").join(known, "id"))


def with_scores(rows: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """Rows with ``statistics`` get score and predicted (1 if score >= threshold)."""
    names = [c for c in rows.columns if c not in ("statistics", "score", "predicted")]
    packed = rows.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), "statistics")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("statistics").to_pylist(), float).reshape(batch.num_rows, -1)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(x))], ["row", "score"])

    schema = packed.select("row").schema.add("score", "double")
    scored = packed.mapInArrow(tx.by_slices(run), schema)
    return (scored.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)), "score")
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Learns only from label rows whose crc32(id as text) mod 3 is not 1.  Null and empty
    texts are scored like any other, from statistics that are all zero.  Rows may repeat;
    a null id is never labelled and not held out.  Label values other than 0 and 1 are
    ignored; without labels of both classes every score is the share of label 1 (one half
    if there are none).  Other columns are ignored, an empty table gives an empty result.
    """
    known = staged(with_statistics(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")), "text", False), "statistics")
    scored = with_scores(known, train(known, labels, id_col))
    return scored.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with predicted = 1, all columns unchanged."""
    known = staged(with_statistics(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", False), "statistics")
    model = train(known, labels, id_col)

    def keep(texts: pa.Array) -> list[pa.Array]:
        x = np.array([statistics(d) for d in tx.utf8(texts)], float).reshape(len(texts), -1)
        return [pa.array(model.score(x) >= 0.5, pa.bool_())]

    return tx.same_columns(tx.mapped(docs, text_col, keep, {"__kept": "boolean"}).where("__kept"), docs)
