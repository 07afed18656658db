"""Benchmark decontamination: prefix-filtered set join of item windows and document shingles.

A window is 13 consecutive item words (the whole item where it has fewer).  A document
holds a window only if it holds every shingle of it, so the necessary prefix is one
shingle: the window's rarest one, by its count over all documents.  Documents are probed
for these shingles alone; the shingle's offset in the window fixes where the window would
start (positional bound), the window must lie inside the document (length bound), and the
words at that place are then compared one by one.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

WINDOW = 13
SHINGLE = 4
# Item words in one probe table (a few hundred MB at most in a task); a larger benchmark is
# dealt over several tables, each matched by a scan of its own.
TABLE_WORDS = 1_000_000


def _windows(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i:i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))] if words else []


class _Probe:
    """Finds wanted 64-bit hashes among many; a bitmap of their low bits turns most away."""

    def __init__(self, hashes):
        self.keys = np.unique(np.fromiter(hashes, np.uint64))
        self.low = np.zeros(1 << 20, bool)
        self.low[self._bits(self.keys)] = True

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << 20) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions in ``hashes`` that hold a wanted one."""
        at = np.flatnonzero(self.low[self._bits(hashes)])
        if not len(at):
            return at
        where = np.searchsorted(self.keys, hashes[at]).clip(max=len(self.keys) - 1)
        return at[self.keys[where] == hashes[at]]


def _count(probes: dict[int, _Probe]):
    """Per task, how often each wanted shingle occurs in the texts."""
    def run(batches):
        counts: Counter[int] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, tx.ROWS):
                for data in tx.utf8(batch.slice(at, tx.ROWS).column("text")):
                    h = tx.word_hashes(tx.alnum_words(data))
                    for k, probe in probes.items():
                        if len(h) >= k:
                            s = tx.shingle_hashes(h, k)
                            counts.update(s[probe.find(s)].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["shingle", "n"])
    return run


class _Table:
    """Windows of some items, under the rarest of their shingles."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.windows: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            for w in _windows(words):
                self.windows[w].add(item)
        self.signed: dict[int, list[tuple[int, tuple[bytes, ...]]]] = {}
        self.probes: dict[int, _Probe] = {}

    @staticmethod
    def _hashes(window: tuple[bytes, ...]) -> list[int]:
        return tx.shingle_hashes(tx.word_hashes(list(window)), SHINGLE).tolist()

    def wanted(self) -> dict[int, _Probe]:
        """The hashes of all window shingles, by shingle length."""
        by: dict[int, set[int]] = defaultdict(set)
        for w in self.windows:
            by[min(SHINGLE, len(w))].update(self._hashes(w))
        return {k: _Probe(v) for k, v in by.items()}

    def sign(self, frequency: dict[int, int]) -> None:
        """Put every window under its rarest shingle."""
        signed, keys = defaultdict(list), defaultdict(set)
        for w in self.windows:
            h = self._hashes(w)
            at = min(range(len(h)), key=lambda i: (frequency.get(h[i], 0), h[i]))
            signed[h[at]].append((at, w))
            keys[min(SHINGLE, len(w))].add(h[at])
        self.signed = dict(signed)
        self.probes = {k: _Probe(v) for k, v in keys.items()}

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word ranges of all window occurrences, and the items that have one."""
        spans, items = [], set()
        hashes = tx.word_hashes(words)
        for k, probe in self.probes.items():
            if len(words) < k:
                continue
            s = tx.shingle_hashes(hashes, k)
            for p in probe.find(s).tolist():
                for offset, window in self.signed[int(s[p])]:
                    start = p - offset
                    end = start + len(window)
                    if start >= 0 and end <= len(words) and tuple(words[start:end]) == window:
                        spans.append((start, end))
                        items |= self.windows[window]
        merged: list[tuple[int, int]] = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged, items


_SPANS = "array<struct<start:bigint,end:bigint>>"
_OUT = {"digest": "binary", "n_words": "bigint", "spans": _SPANS, "items": "array<string>"}


def _match(table: _Table):
    def run(texts: pa.Array) -> list[pa.Array]:
        n, spans, items, digests = [], [], [], []
        for data in tx.utf8(texts):
            words = tx.alnum_words(data)
            found, of = table.match(words)
            n.append(len(words)), spans.append([{"start": a, "end": b} for a, b in found]), items.append(sorted(of))
            digests.append(xxhash.xxh3_128_digest(data))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return [pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
    return run


def _tables(benchmark: DataFrame, item_col: str, text_col: str):
    """Item tables of at most TABLE_WORDS words each (one item at least); the items pass through the driver one table at a time."""
    held, words = [], 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull()).toLocalIterator(prefetchPartitions=True):
        own = tx.alnum_words((r[1] or "").encode())
        if held and words + len(own) > TABLE_WORDS:
            yield _Table(held)
            held, words = [], 0
        held.append((r[0], own))
        words += len(own)
    yield _Table(held)


def _with(found: DataFrame, more: DataFrame) -> DataFrame:
    """Add the hits of a further table; equal texts have equal hits, so they meet by digest."""
    hits = more.where("size(items) > 0").select("digest", F.col("spans").alias("s2"), F.col("items").alias("i2")).dropDuplicates(["digest"])
    return (found.join(hits, "digest", "left").withColumns({"spans": F.expr("concat(spans, coalesce(s2, array()))"), "items": F.expr("concat(items, coalesce(i2, array()))")})
            .drop("s2", "i2"))


_HIT = """aggregate(array_sort(spans), named_struct('reach', 0L, 'hit', 0L), (a, s) -> named_struct(
    'reach', greatest(a.reach, s.end), 'hit', a.hit + greatest(0L, s.end - greatest(a.reach, s.start))), a -> a.hit)"""


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and spans.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
    lower-cased.  A document word inside any occurrence of an item window is hit;
    contaminated means n_hit > 0 and 20 * n_hit >= n_words; spans are the hit word ranges,
    end exclusive.  Null and empty texts have no words and no hits; items with a null id or
    no words match nothing; equal windows count for every item that has them.  Repeated
    rows are returned each and other columns pass through (columns named like an output
    are replaced).  An empty benchmark hits nothing; empty documents give an empty result.

    The benchmark is cut into probe tables of at most ``TABLE_WORDS`` words, so what a task
    holds is bounded; further tables cost a scan each.
    """
    texts = tx.in_small_batches(docs).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = None
    for t in _tables(benchmark, item_col, item_text_col):
        if t.windows:
            counted = texts.mapInArrow(_count(t.wanted()), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
            # at most one row per shingle of the bounded table
            t.sign({r["shingle"] % 2**64: r["n"] for r in counted.collect()})
        if found is None:
            found = tx.mapped(docs.drop("s2", "i2"), text_col, _match(t), _OUT, keep_text)
        else:
            found = _with(found, tx.mapped(texts, "text", _match(t), _OUT, False))
    return (found.withColumn("items", F.expr("array_sort(array_distinct(items))"))
            .withColumns({"n_hit": F.expr(_HIT), "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
            .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")).drop("digest", "items"))
