"""Helpers for whole texts inside Arrow tasks: words, shingle hashes, small batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a task unpacks at a time; a batch from Spark may hold thousands of long ones.
ROWS = 256

# Rows of an Arrow batch: Spark's default of 10,000 whole texts would be held several times over
# by the JVM and the worker.  A session that sets its own number keeps it.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Bytes outside [0-9a-z] and non-ASCII become blanks, for the alphanumeric words of decontamination.
_ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def release() -> None:
    """Gives memory that a finished partition used back to the system, so that workers waiting for the next one stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def by_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch], after: Callable[[], None] | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over slices of at most ``ROWS`` rows, as the function of a ``mapInArrow``; ``after`` is called when the partition is done."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield fn(batch.slice(at, ROWS))
        if after:
            after()
        release()
    return run


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after its session is told to hand texts to Python in batches of BATCH_ROWS."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return docs


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blank_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes.split cuts at exactly these six)."""
    return data.lower().split()


def alnum_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return data.lower().translate(_ALNUM).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words in order; of fewer words, the whole run as one."""
    k = min(k, len(words))
    if not k:
        return words
    m = len(words) - k + 1
    out = np.full(m, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j:j + m]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def same_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``rows``, whatever their names."""
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def boxed(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` as (box, text) for operators that add columns, and the way back to its columns, whatever their names."""
    rest = [c for c in docs.columns if c != text_col]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("none")]
    slim = docs.select(F.struct(*fields).alias("__box"), F.col(f"`{text_col}`").alias("text"))

    def back(rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col("text").alias(c) if c == text_col else F.col(f"__box.c{rest.index(c)}").alias(c) for c in docs.columns))

    return slim, back


def mapped(docs: DataFrame, text_col: str, fn: Callable[[pa.Array], list[pa.Array]], outputs: dict[str, str], keep_text: bool = True,
           after: Callable[[], None] | None = None) -> DataFrame:
    """``docs`` with further columns that ``fn`` computes from slices of the text column.

    Other columns pass through in one struct, whatever their names and types; a column
    named like an output is replaced by it.
    """
    kept = [c for c in docs.columns if c not in outputs]
    rest = [c for c in kept if c != text_col]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("none")]
    packed = in_small_batches(docs).select(F.struct(*fields).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = [f"o{i}" for i in range(len(outputs))]
    schema = T.StructType([packed.schema["row"], *[packed.schema["text"]] * keep_text, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, outputs.values(), strict=True))])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("text")
        return pa.RecordBatch.from_arrays([batch.column("row"), *[text] * keep_text, *fn(text)], ["row", *["text"] * keep_text, *names])

    found = packed.mapInArrow(by_slices(one, after), schema)
    return found.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.c{rest.index(c)}").alias(c) for c in kept if keep_text or c != text_col),
                        *(F.col(n).alias(c) for n, c in zip(names, outputs, strict=True)))
