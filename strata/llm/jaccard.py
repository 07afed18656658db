"""Exact near-duplicate classes: 5-word shingle sets linked at Jaccard similarity >= 0.75.

Set-relation skipping.  Every set is indexed under the tokens of its necessary prefix
(tokens ordered from rare to frequent), with its size and the token's position.

* Index level: an inverted list is cut into blocks of similar size and position, and two
  blocks whose best member pair cannot reach the threshold (length and positional bounds)
  are skipped as a whole.  Blocks whose members already share one class are skipped too.
* Answer level: every list first compares its entries with one set only, its leader.  The
  links found there put most entries into classes.  What is left are pairs from different
  classes; of two entries with the same leader, whose distances to it are known, the
  triangle inequality of the Jaccard distance decides most without looking at the sets.

Pairs that are left are first held against parity bitmaps of their sets (the bits in which
two bitmaps differ are a lower bound of the set difference), then compared exactly.  Equal
sets are one class from the start, so copies cost nothing beyond the first scan.  Sets are
compared by 64-bit shingle hashes and named by 128-bit hashes; the shorter tokens and nodes
of the index can only add candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, staged
from . import text as tx
from .components import components

SHINGLE = 5
# Buckets of the frequency sketch, of a slice that is added up on its own, and how many standard
# deviations above the mean a bucket counts as frequent.  The KEPT most frequent ones set the
# order of tokens; any order gives the same links.
BUCKET_BITS, SLICE, ABOVE, KEPT = 22, 1 << 16, 4.0, 262_144
# Postings of one (token, salt) list; a longer list is dealt over several salts.
LIST_ROWS = 4096
# Leaders that each set is compared with before the lists are completed.
LEADERS = 2


def _set(data: bytes) -> np.ndarray:
    return np.unique(tx.shingle_hashes(tx.word_hashes(tx.blank_words(data)), SHINGLE))


def _name(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _node(name: bytes) -> int:
    return int.from_bytes(name[:6], "big")


def _parity(shingles: np.ndarray) -> bytes:
    """Bit i is the parity of the number of hashes that leave i; about one bit for each shingle."""
    size = 1 << max(6, int(len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _scan(batches):
    """Rows (id, n, name, bits) of every text; then, per task, slices of the frequency sketch as (slice, counts)."""
    counts = np.zeros(1 << BUCKET_BITS, np.uint32)
    shift = np.uint64(64 - BUCKET_BITS)
    names = ["id", "n", "name", "bits", "bucket"]

    for batch in batches:
        for at in range(0, batch.num_rows, tx.ROWS):
            part = batch.slice(at, tx.ROWS)
            ns, called, bits = [], [], []
            for data in tx.utf8(part.column("text")):
                s = _set(data)
                ns.append(len(s)), called.append(_name(s)), bits.append(_parity(s) if len(s) else b"")
                np.add.at(counts, (s >> shift).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ns, pa.int64()), pa.array(called, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(len(ns), pa.int64())], names)
    parts = np.minimum(counts, 65_535).astype(np.uint16).reshape(-1, SLICE)
    busy = np.flatnonzero(parts.any(axis=1))
    packed = pa.array([pa.compress(parts[i].tobytes(), "zstd", asbytes=True) for i in busy], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(busy), pa.int64()), pa.nulls(len(busy), pa.int64()), pa.nulls(len(busy), pa.binary()), packed, pa.array(busy)], names)
    del counts, parts, packed
    tx.release()


def _frequent(batches):
    """Adds up the slices of a partition, one row at a time, and yields the frequent buckets (bucket, n)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            own = np.frombuffer(pa.decompress(data, 2 * SLICE, "zstd", asbytes=True), np.uint16)
            total[i] = total.get(i, 0) + own.astype(np.int64)
    for i, counts in total.items():
        at = np.flatnonzero(counts > counts.mean() + ABOVE * np.sqrt(counts.mean()) + ABOVE)
        yield pa.RecordBatch.from_arrays([pa.array(at + i * SLICE), pa.array(counts[at])], ["bucket", "n"])


def _postings(heavy: np.ndarray):
    """The prefix postings of every distinct set of the task; heavy holds rows (bucket, count)."""
    names = ["token", "pos", "n", "node", "salt", "salted"]
    shift = np.uint64(64 - BUCKET_BITS)

    def run(batches):
        weights = np.zeros(1 << BUCKET_BITS, np.int32)
        weights[heavy[:, 0]] = np.minimum(heavy[:, 1], 2**31 - 1)
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, tx.ROWS):
                cols: list[list[np.ndarray]] = [[] for _ in names]
                for data in tx.utf8(batch.slice(at, tx.ROWS).column("text")):
                    s = _set(data)
                    if not (n := len(s)) or (name := _name(s)) in seen:
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(name)
                    w = weights[(s >> shift).astype(np.int64)]
                    p = n - (3 * n + 3) // 4 + 1
                    # sets are sorted by hash, so a stable sort by weight leaves ties in hash order
                    first = np.argsort(w, kind="stable")[:p] if w.any() else np.arange(p)
                    lists, node = 1 + w[first].astype(np.int64) // LIST_ROWS, _node(name)
                    row = ((s[first] >> np.uint64(16)).view(np.int64), np.arange(p, dtype=np.int32), np.full(p, n, np.int32), np.full(p, node), (node % lists).astype(np.int32), lists > 1)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)
        del weights
        seen.clear()
        tx.release()
    return run


def _lists(batches):
    """Of one partition of postings, the lists with at least two entries (and parts of salted ones), each entry with its list's leader.

    A partition holds six numbers a posting in memory, as many as Spark deals to a task.
    """
    cols = [np.concatenate(c) for c in zip(*([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)] for b in batches), strict=True)]
    if not cols:
        return
    order = np.argsort(cols[0], kind="stable")
    token = cols[0][order]
    again = np.zeros(len(token) + 1, bool)
    again[1:-1] = token[1:] == token[:-1]
    kept = order[again[:-1] | again[1:] | cols[5][order]]
    token, pos, n, node, salt, salted = (c[kept] for c in cols)
    order = np.lexsort((node, n, pos, salt, token))
    token, pos, n, node, salt, salted = (c[order] for c in (token, pos, n, node, salt, salted))
    if not len(token):
        return
    start = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
    lead = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
    out = [token, salted, node, n, pos, node[lead], n[lead], pos[lead]]
    for at in range(0, len(token), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 50_000]) for c in out], ["token", "salted", "node", "n", "pos", "l_node", "l_n", "l_pos"])
    del cols, token, pos, n, node, salt, salted, order, out
    tx.release()


def _shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [_set(data) for data in tx.utf8(batch.column("text"))]
    return pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "shingles"])


_PAIR = ["a", "b", "a_name", "b_name", "a_rep", "b_rep", "a_n", "b_n"]
_PAIR_TYPES = "a long, b long, a_name binary, b_name binary, a_rep long, b_rep long, a_n long, b_n long"


def _near(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs whose bitmaps and sizes leave room for the threshold: common <= (n + m - differ) / 2."""
    room = [7 * (n + m - _differ(x, y)) >= 6 * (n + m) for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_bits", "b_bits")), strict=True)]
    return batch.select(_PAIR).filter(pa.array(room, pa.bool_()))


def _common(batch: pa.RecordBatch) -> pa.RecordBatch:
    same = [np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).size
            for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True)]
    keep = ["a", "b", "a_rep", "b_rep", "a_n", "b_n"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(same, pa.int64())], [*keep, "common"])


def _reach(n: str, pos: str, m: str, qos: str) -> str:
    """Length and positional bounds: can sets of n and m tokens that first meet at pos and qos reach the threshold."""
    return f"4 * least({n}, {m}) >= 3 * greatest({n}, {m}) and 7 * least({n} - {pos}, {m} - {qos}) >= 3 * ({n} + {m})"


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.docs = tx.in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        found = staged(self.docs.mapInArrow(_scan, "id long, n long, name binary, bits binary, bucket long"), "scan")
        self.rows = found.where("bucket is null").select("id", "n", "name")
        # One row per distinct set; a row without an id takes no part in links.
        classes = found.where("bucket is null and n > 0 and id is not null").groupBy("name").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits"))
        self.classes = staged(classes.withColumn("node", F.expr("conv(hex(substring(name, 1, 6)), 16, 10)").cast("long")), "classes")
        slices = found.where("bucket is not null").select("bucket", "bits").repartition("bucket")
        heavy = slices.mapInArrow(_frequent, "bucket long, n long").orderBy(F.desc("n"), "bucket").limit(KEPT).toArrow()
        weights = np.stack([heavy.column(c).to_numpy() for c in ("bucket", "n")], axis=1)
        live = self.docs.where("id is not null").select("text")
        post = live.mapInArrow(_postings(weights), "token long, pos int, n int, node long, salt int, salted boolean")
        self.entries = staged(post.repartition("token", "salt").mapInArrow(_lists, "token long, salted boolean, node long, n int, pos int, l_node long, l_n int, l_pos int"), "lists")

    def _leader_pairs(self) -> DataFrame:
        """Every set with the LEADERS leaders that it shares most lists with."""
        own = self.entries.where("node <> l_node and " + _reach("n", "pos", "l_n", "l_pos")).select("node", "l_node")
        over = self.entries.where("salted").select("token", "l_node", "l_n", "l_pos").distinct()
        w = Window.partitionBy("token").orderBy("l_pos", "l_n", "l_node")
        over = (over.withColumn("lead", F.first(F.struct("l_node", "l_n", "l_pos")).over(w)).where("l_node <> lead.l_node and " + _reach("l_n", "l_pos", "lead.l_n", "lead.l_pos"))
                .select(F.col("l_node").alias("node"), F.col("lead.l_node").alias("l_node")))
        shared = own.union(over).groupBy("node", "l_node").agg(F.count(F.lit(1)).alias("lists"))
        best = Window.partitionBy("node").orderBy(F.desc("lists"), "l_node")
        return shared.withColumn("r", F.row_number().over(best)).where(f"r <= {LEADERS}").select(F.col("node").alias("a"), F.col("l_node").alias("b"))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """The pairs of nodes that may reach the threshold, with their classes, set sizes and common shingles."""
        side = lambda s: self.classes.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("name", "rep", "n", "bits")))
        near = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tx.by_slices(_near), _PAIR_TYPES), "near")
        ids = near.select(F.col("a_rep").alias("id")).union(near.select(F.col("b_rep").alias("id"))).distinct()
        names = near.select(F.col("a_name").alias("name")).union(near.select(F.col("b_name").alias("name"))).distinct()
        # the sets are computed again from one text of each class; an id may stand for several texts
        texts = self.docs.join(bounded(ids), "id", "left_semi").select("text")
        sets = staged(texts.mapInArrow(tx.by_slices(_shingles), "name binary, shingles binary").join(names, "name", "left_semi").dropDuplicates(["name"]), "sets")
        of = lambda s: sets.select(F.col("name").alias(f"{s}_name"), F.col("shingles").alias(f"{s}_set"))
        both = near.join(of("a"), "a_name").join(of("b"), "b_name")
        return staged(both.mapInArrow(tx.by_slices(_common), "a long, b long, a_rep long, b_rep long, a_n long, b_n long, common long"), "compared")

    def _open_pairs(self, labels: DataFrame, compared: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs of one list, from different classes, that no bound decides."""
        far = compared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.max(F.expr("1 - common / (a_n + b_n - common)")).alias("far")).where("k = 1")
        classes = self.classes.join(labels, self.classes.rep == labels.node, "left").select(self.classes.node, F.coalesce("component", "rep").alias("class"))
        mixed = self.entries.join(classes, "node")
        open_lists = mixed.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("token")
        mixed = (mixed.join(open_lists, "token", "left_semi")
                 .join(far.select(F.col("a").alias("node"), F.col("b").alias("l_node"), "far"), ["node", "l_node"], "left")
                 .select("token", "node", "n", "pos", "class", "l_node", F.when(F.expr("node = l_node"), 0.0).otherwise(F.col("far")).alias("far"),
                         F.expr("int(floor(log(n) / log(4 / 3D)))").alias("size_block"), F.expr("int(8 * pos / n)").alias("pos_block")))
        mixed = staged(mixed, "open")
        blocks = mixed.groupBy("token", "size_block", "pos_block").agg(F.min("n").alias("lo_n"), F.max("n").alias("hi_n"), F.max(F.expr("n - pos")).alias("rest"), F.min("class").alias("lo_c"), F.max("class").alias("hi_c"))
        a, b = (blocks.select("token", *(F.col(c).alias(f"{s}_{c}") for c in blocks.columns[1:])) for s in "xy")
        kept = a.join(b, "token").where(
            "(x_size_block < y_size_block or x_size_block = y_size_block and x_pos_block <= y_pos_block)"
            " and not (x_lo_c = x_hi_c and y_lo_c = y_hi_c and x_lo_c = y_lo_c)"
            " and 4 * x_hi_n >= 3 * y_lo_n and 4 * y_hi_n >= 3 * x_lo_n and 7 * least(x_rest, y_rest) >= 3 * (x_lo_n + y_lo_n)"
        ).select("token", "x_size_block", "x_pos_block", "y_size_block", "y_pos_block")
        x, y = (mixed.select("token", *(F.col(c).alias(f"{s}_{c}") for c in mixed.columns[1:])) for s in "xy")
        pairs = (kept.join(x, ["token", "x_size_block", "x_pos_block"])
                 .join(y, (kept.token == y.token) & (kept.y_size_block == y.y_size_block) & (kept.y_pos_block == y.y_pos_block) & F.expr(
                     "x_class <> y_class and " + _reach("x_n", "x_pos", "y_n", "y_pos") +
                     " and (x_l_node <> y_l_node or x_far is null or y_far is null or abs(x_far - y_far) <= 0.25000001)"))
                 .select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct())
        return pairs.join(done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("100 * common >= 75 * (a_n + b_n - common)").select("a_rep", "b_rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two rows link when their sets of distinct 5-word shingles have 100 * intersection >=
    75 * union; component_id is the smallest id reachable by links.  Words are runs of
    characters other than blank, tab, line feed, vertical tab, form feed and carriage
    return, with A-Z lower-cased.  A text of fewer words is one shingle; null, empty and
    blank texts have none and link with nothing (component_id is the row's own id).  Rows
    may repeat an id or a text; each is returned.  A row with a null id is returned with a
    null component and links nothing.  Other columns are ignored, an empty table gives an
    empty result.
    """
    j = _Join(docs, id_col, text_col)
    first = staged(j._leader_pairs(), "pairs")
    compared = j.compare(first)
    labels = staged(components(_links(compared), "a_rep", "b_rep"), "labels")
    extra = _links(j.compare(j._open_pairs(labels, compared, first)))
    if not extra.isEmpty():
        labels = components(_links(compared).union(extra), "a_rep", "b_rep")
    named = j.classes.join(labels, j.classes.rep == labels.node, "left").select("name", F.coalesce("component", "rep").alias("component"))
    return (j.rows.join(named, "name", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.expr("case when id is not null then coalesce(component, id) end").alias("component_id")))
