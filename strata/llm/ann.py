"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Every vector is projected on DIMS Gaussian directions, so the squared projected distance of
two vectors is their squared distance times a chi-square variable with DIMS degrees of
freedom.  A kd-tree over the projections yields neighbours in the order of projected
distance; each is verified on the original vectors, until the chi-square test holds: the
frontier is so far out that a vector nearer than the worst neighbour found would have shown
up before it with probability CONFIDENCE.

Largest inner product becomes smallest distance by one more coordinate that gives all
vectors the same norm (queries have 0 there).  The top of the kd-tree cuts the vectors into
blocks of bounded size that Spark deals out; within a block the tree goes on in numpy.  A
query first searches its own block, then only blocks that its test leaves in reach.  Equal
vectors are one point that carries as many of the smallest ids as an answer can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

DIMS, CONFIDENCE, SEED = 12, 0.97, 20
# Rows of a block, leaf size of its tree, queries searched together in a block.
BLOCK, LEAF, CHUNK = 4096, 64, 2048
# The splits of the top tree are fitted on at most this many points (those with the smallest keys); every point is indexed.
SAMPLE, BLOCKS = 65_536, 4096


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile for an even number of degrees of freedom, whose distribution is a finite sum."""
    def cdf(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))

    lo, hi = 0.0, 10.0 * k + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


REACH = chi_square_quantile(CONFIDENCE, DIMS)


def _split(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a median kd-tree that always cuts the widest side."""
    if len(rows) <= size:
        return [rows]
    own = points[rows]
    axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
    order = np.argsort(own[:, axis], kind="stable")
    half = len(rows) // 2
    return _split(points, rows[order[:half]], size) + _split(points, rows[order[half:]], size)


class TopTree:
    """Split planes fitted on a sample: node i has children 2i + 1 and 2i + 2; leaves are blocks."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, int)
        self.at = np.zeros((1 << depth) - 1)
        parts = [np.arange(len(sample))]
        for node in range(len(self.axis)):
            rows = parts[node]
            if len(rows):
                own = sample[rows]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.axis[node], self.at[node] = axis, np.median(own[:, axis])
                left = own[:, axis] < self.at[node]
                parts += [rows[left], rows[~left]]
            else:
                parts += [rows, rows]

    def block(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - ((1 << self.depth) - 1)


def _apart(lo: np.ndarray, hi: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(lo)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(lo[None, :, d] - x, x - hi[None, :, d]), 0)
        out += gap * gap
    return out


def _best(both: np.ndarray, names: np.ndarray, vectors: np.ndarray, queries: np.ndarray, first: np.ndarray, k: int):
    """The k best of each query (row): scores and names.  Where scores come within rounding of the
    k-th, the plainly summed products decide, and at equal ones the smaller id."""
    best = np.argpartition(-both, k - 1, axis=1)[:, :k]
    scores, found = np.take_along_axis(both, best, axis=1), np.take_along_axis(names, best, axis=1)
    last = scores.min(axis=1)
    near = both >= (last - 1e-12 * np.abs(np.where(np.isfinite(both), both, 0)).max(axis=1))[:, None]
    for i in np.flatnonzero(np.isfinite(last) & (near.sum(axis=1) > k)):
        at = np.flatnonzero(near[i])
        exact = (vectors[names[i, at]] * queries[i]).sum(axis=1)
        at = at[np.lexsort((first[names[i, at]], -exact))[:k]]
        scores[i], found[i] = both[i, at], names[i, at]
    return scores, found


def _search(vectors: np.ndarray, points: np.ndarray, queries: np.ndarray, seen: np.ndarray, worst: np.ndarray, base: np.ndarray, first: np.ndarray, k: int):
    """(scores, rows) of up to k best vectors of one block for each query; at equal scores those of the smallest ``first`` ids.

    ``points`` and ``seen`` are the projections of vectors and queries; ``worst`` is the
    squared distance of the k-th best so far (infinite if unknown), ``base`` what the squared
    distance exceeds minus twice the inner product by.
    """
    leaves = _split(points, np.arange(len(points)), LEAF)
    lo = np.array([points[r].min(axis=0) for r in leaves])
    hi = np.array([points[r].max(axis=0) for r in leaves])
    bound = _apart(lo, hi, seen)
    order = np.argsort(bound, axis=1, kind="stable")
    scores, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    at, width = 0, 1
    while at < len(leaves):
        steps = order[:, at:at + width]
        near = np.take_along_axis(bound, steps, axis=1) <= (worst * REACH)[:, None]  # the test does not hold yet
        if not near.any():
            break
        for leaf in np.unique(steps[near]):
            who = np.flatnonzero(((steps == leaf) & near).any(axis=1))
            rows = leaves[leaf]
            both = np.hstack([scores[who], queries[who] @ vectors[rows].T])
            names = np.hstack([found[who], np.broadcast_to(rows, (len(who), len(rows)))])
            scores[who], found[who] = _best(both, names, vectors, queries[who], first, k)
        worst = np.minimum(worst, np.maximum(base - 2 * scores.min(axis=1), 0) * (1 + 1e-9))
        at, width = at + width, width * 2
    return scores, found


def _floats(column) -> np.ndarray:
    """A column of equally long binaries as a matrix of doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), float).reshape(len(values), -1) if values else np.zeros((0, 0))


_TOP = pa.list_(pa.struct([("order", pa.float64()), ("vec_id", pa.int64())]))
_TOP_SQL = "array<struct<order:double,vec_id:bigint>>"


def _visit(k: int):
    """Rows (block members, queries) to rows (key, worst, top)."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                members, asked = batch.column("members")[i].values, batch.column("asked")[i].values
                vectors, points = _floats(members.field("vector")), _floats(members.field("point"))
                ids = members.field("ids").to_pylist()
                queries, seen = _floats(asked.field("vector")), _floats(asked.field("point"))
                worst = np.array(asked.field("worst").to_pylist(), float)
                base = np.array(asked.field("base").to_pylist(), float)
                first = np.array([x[0] for x in ids], np.int64)
                scores, found = _search(vectors, points, queries, seen, worst, base, first, k)
                tops, far = [], []
                for q, s, rows in zip(queries, scores, found, strict=True):
                    rows = rows[rows >= 0]
                    exact = (vectors[rows] * q).sum(axis=1)
                    own = sorted((-float(e), x) for e, r in zip(exact, rows, strict=True) for x in ids[r])[:k]
                    tops.append([{"order": o, "vec_id": x} for o, x in own])
                    far.append(float(s.min()))
                far = np.minimum(worst, np.maximum(base - 2 * np.array(far), 0) * (1 + 1e-9))
                yield pa.RecordBatch.from_arrays([asked.field("key"), pa.array(far, pa.float64()), pa.array(tops, _TOP)], ["key", "worst", "top"])
    return run


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Valid vectors as binaries of doubles, with a key that equal ones share and their squared norm."""
    ids, vectors, keys, norms = [], [], [], []
    for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
        x = np.array(v, float) + 0.0  # no negative zeros
        data = x.tobytes()
        ids.append(i), vectors.append(data), keys.append(xxhash.xxh3_128_digest(data)), norms.append(float((x * x).sum()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], ["id", "key", "vector", "norm"])


def _each(fn):
    return lambda batches: (fn(b) for b in batches)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product of every query row.

    ``is_query`` is a condition on ``vec_id``; candidates are all other rows.  Ranks begin
    at 1, ties go to the smaller id, scores are inner products in double precision.  Rows
    with a null id, and vectors that are null, empty, zero or hold a null or non-finite
    component, take no part; nor do vectors of another length than most (of equally frequent
    lengths the longest).  Rows that repeat an id are one row, with the smallest of its
    vectors.  Fewer than k candidates are all returned.  Other columns are ignored; an
    empty table gives an empty result.
    """
    x = F.col(vector_col).cast("array<double>")
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("vector")).where(
        "id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    length = valid.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    spark = vectors.sparkSession
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid.where(F.size("vector") == length["d"]).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = staged(rows.mapInArrow(_each(_pack), "id long, key binary, vector binary, norm double"), "vectors")
    top_norm = rows.agg(F.max("norm")).first()[0]

    # One point for each distinct vector; an answer holds k ids besides the query's own.
    first = Window.partitionBy("key").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(first)).where(f"place <= {k + 1}")
    grouped = few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("vector").alias("vector"), F.min("norm").alias("norm"))
    axes = np.random.default_rng(SEED).standard_normal((length["d"] + 1, DIMS))

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, norm = _floats(batch.column("vector")), np.array(batch.column("norm").to_pylist(), float)
        flat = v @ axes[:-1] if len(v) else np.zeros((0, DIMS))
        points = flat + np.sqrt(np.maximum(top_norm - norm, 0))[:, None] * axes[-1]
        binary = lambda m: pa.array([p.tobytes() for p in m], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "ids", "vector", "norm")), binary(points), binary(flat)], ["key", "ids", "vector", "norm", "point", "seen"])

    points = staged(grouped.mapInArrow(_each(project), "key binary, ids array<long>, vector binary, norm double, point binary, seen binary"), "points")
    n = points.count()
    depth = min(max(0, math.ceil(math.log2(n / BLOCK))), int(math.log2(BLOCKS)))
    sample = points.orderBy("key").limit(min(SAMPLE, 64 << depth)).select("point").toArrow() if depth else None
    tree = TopTree(_floats(sample.column("point")) if depth else np.zeros((0, DIMS)), depth)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not batch.num_rows:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([], pa.int64()), pa.array([], pa.int64())], [*batch.schema.names, "block", "home"])
        own, home = (tree.block(_floats(batch.column(c))) for c in ("point", "seen"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(home)], [*batch.schema.names, "block", "home"])

    placed = staged(points.mapInArrow(_each(place), "key binary, ids array<long>, vector binary, norm double, point binary, seen binary, block long, home long"), "placed")
    # At most BLOCKS rows: sizes and boxes.  A block that came out too large is dealt over parts by key.
    sizes = {r["block"]: r["n"] for r in placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {b: max(1, -(-c // (2 * BLOCK))) for b, c in sizes.items()}
    split = F.create_map(*(F.lit(x) for b, p in parts.items() if p > 1 for x in (b, p))) if any(p > 1 for p in parts.values()) else None
    part = F.pmod(F.xxhash64("key"), F.coalesce(split[F.col("block")], F.lit(1))) if split is not None else F.lit(0).cast("long")
    members = staged(placed.groupBy("block", part.alias("part")).agg(F.collect_list(F.struct("vector", "point", "ids")).alias("members")), "members")

    asked = placed.join(rows.where(F.expr(is_query.replace("vec_id", "id"))).select("key").distinct(), "key", "left_semi").select(
        "key", "vector", F.col("seen").alias("point"), F.col("home"), (F.col("norm") + top_norm).alias("base"))
    asked = staged(asked, "asked")
    chunks = max(1, -(-asked.count() // CHUNK))
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk")
    query = F.struct("key", "vector", "point", "worst", "base")

    def visit(visits: DataFrame) -> DataFrame:
        packed = visits.groupBy("block", chunk).agg(F.collect_list(query).alias("asked"))
        return members.join(packed, "block").select("members", "asked").mapInArrow(_visit(k + 1), f"key binary, worst double, top {_TOP_SQL}")

    home = staged(visit(asked.select(*asked.columns[:3], F.col("home").alias("block"), F.lit(float("inf")).alias("worst"), "base")), "home")
    boxes = _boxes(members)
    known = asked.join(home.groupBy("key").agg(F.min("worst").alias("worst")), "key", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
    kinds = "key binary, vector binary, point binary, block long, worst double, base double"
    rest = visit(known.select(*asked.columns, "worst").mapInArrow(_reachable(boxes), kinds))
    best = (home.select("key", "top").union(rest.select("key", "top")).groupBy("key")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k + 1).alias("top")))
    queries = rows.where(F.expr(is_query.replace("vec_id", "id"))).select(F.col("id").alias("query_id"), "key")
    answers = queries.join(best, "key").select("query_id", F.posexplode(F.expr(f"slice(filter(top, t -> t.vec_id <> query_id), 1, {k})")).alias("place", "t"))
    return answers.select("query_id", (F.col("place") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.order")).alias("score"))


def _boxes(members: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The box of every block, at most BLOCKS of them (times the parts of oversized ones)."""
    def corners(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p = _floats(batch.column("members")[i].values.field("point"))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([p.min(axis=0).tobytes()], pa.binary()), pa.array([p.max(axis=0).tobytes()], pa.binary())], ["block", "lo", "hi"])

    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in members.select("block", "members").mapInArrow(corners, "block long, lo binary, hi binary").collect():
        lo, hi = np.frombuffer(r["lo"]), np.frombuffer(r["hi"])
        if r["block"] in found:
            lo, hi = np.minimum(lo, found[r["block"]][0]), np.maximum(hi, found[r["block"]][1])
        found[r["block"]] = (lo, hi)
    return found


def _reachable(boxes: dict[int, tuple[np.ndarray, np.ndarray]]):
    """A row for every query and every other block that its chi-square test leaves in reach."""
    names = sorted(boxes)
    lo, hi = np.array([boxes[b][0] for b in names]), np.array([boxes[b][1] for b in names])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                seen, worst = _floats(batch.column("point")), batch.column("worst").to_numpy(zero_copy_only=False)
                home = np.array(batch.column("home").to_pylist())
                near = (_apart(lo, hi, seen) <= (worst * REACH)[:, None]) & (np.array(names)[None, :] != home[:, None])
                row, block = np.nonzero(near)
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("vector"), own.column("point"), pa.array(np.array(names)[block], pa.int64()), own.column("worst"), own.column("base")],
                                                 ["key", "vector", "point", "block", "worst", "base"])
    return run
