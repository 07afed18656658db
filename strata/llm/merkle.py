"""Merkle manifest of a dataset: a content-addressed store of digests and proofs by descent.

Leaves are numbered per group by range-sorting; runs of ``fanout`` neighbours hash to their
parent until one node is left, the group's subroot; the subroots' tree gives the root.
A page is a subtree of LEVELS levels.  The store keeps, under the digest of a page's top
node, the records digest -> children of the page's nodes; equal subtrees are stored once.
Proofs come from a descent: requests start at the root, take at each node the child that
the next digit of their rank (in base fanout) names, and collect the children not taken.
Requests under one page walk together, and the path of a request is reversed at the end, so
that it reads from the leaf up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import join_stats
from ..session import staged
from .order import group_key, running

# Levels of a page: 3^5 = 243 leaves.
LEVELS = 5
_RECORDS = "array<struct<digest:string,children:array<string>>>"


def field(column: str, replaced: Column | None = None) -> Column:
    """The column as it enters a leaf: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    value = (F.col(f"`{column}`") if replaced is None else replaced).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: Sequence[str], replaced: dict[str, Column] | None = None) -> Column:
    """Digest of a row: lowercase hex sha256 of its fields in the order of ``columns``; ``replaced`` gives other values for some."""
    return F.sha2(F.concat(*(field(c, (replaced or {}).get(c)) for c in columns)), 256)


def _height(n: str, fanout: int) -> Column:
    """Levels above n leaves until one node is left."""
    steps, power = [], 1
    while power < 1 << 62:
        steps.append(F.lit(power))
        power *= fanout
    return F.size(F.filter(F.array(*steps), lambda p: p < F.col(n))).cast("int")


@dataclass(frozen=True)
class Tree:
    """Trees of all groups: ``pages[b]`` (g, page, top, height) and ``store[b]`` (top, records) start at level b * LEVELS; ``tops`` (g, height, digest) are their top nodes."""

    fanout: int
    pages: list[DataFrame]
    store: list[DataFrame]
    tops: DataFrame


def grow(leaves: DataFrame, fanout: int = 3) -> Tree:
    """The trees over ``leaves`` (g, rank, digest), ranks 0, 1, ... in every group.

    Each round builds the pages of the next LEVELS levels, a page in a row of at most
    fanout^LEVELS digests; rows shrink by that factor from round to round.
    """
    wide = fanout ** LEVELS
    n = staged(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", _height("n", fanout).alias("height")), "merkle")
    highest = n.agg(F.max("height")).first()[0] or 0
    nodes, pages, store, tops = join_stats(leaves, n, ["g"]), [], [], []
    for base in range(0, max(highest, 1), LEVELS):
        level = nodes.groupBy("g", "height", F.expr(f"rank div {wide}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("l"))
        level = level.withColumn("l0", F.expr("transform(l, x -> x.digest)")).drop("l")
        for s in range(1, LEVELS + 1):  # a level exists where the group's tree is that high
            runs = f"transform(sequence(0, (size(l{s - 1}) - 1) div {fanout}), i -> slice(l{s - 1}, i * {fanout} + 1, {fanout}))"
            level = level.withColumn(f"r{s}", F.expr(f"if(height >= {base + s}, {runs}, cast(array() as array<array<string>>))"))
            level = level.withColumn(f"l{s}", F.expr(f"if(height >= {base + s}, transform(r{s}, x -> sha2(array_join(x, ''), 256)), l{s - 1})"))
        records = F.concat(*(F.expr(f"if(height >= {base + s}, zip_with(l{s}, r{s}, (d, c) -> named_struct('digest', d, 'children', c)), cast(array() as {_RECORDS}))") for s in range(1, LEVELS + 1)))
        built = staged(level.select("g", "height", "page", F.element_at(f"l{LEVELS}", 1).alias("top"), records.alias("records")), "merkle")
        pages.append(built.select("g", "height", "page", "top"))
        store.append(built.select("top", "records").dropDuplicates(["top"]))
        tops.append(built.where((F.col("height") <= base + LEVELS) & ((F.col("height") > base) | F.lit(base == 0))).select("g", "height", F.col("top").alias("digest")))
        nodes = built.where(F.col("height") > base + LEVELS).select("g", "height", F.col("page").alias("rank"), F.col("top").alias("digest"))
    ends = tops[0]
    for t in tops[1:]:
        ends = ends.unionByName(t)
    return Tree(fanout, pages, store, ends)


def _walk(base: int, fanout: int, names: list[str]):
    """Requests of a page, from its top node down to level ``base``: a mapInArrow function, one output batch per page."""
    def descend(page, schema):
        records = {r["digest"]: r["children"] for r in page["records"]}
        levels = min(LEVELS, page["height"] - base)
        out = {n: [] for n in schema.names}
        for w in page["wanted"]:
            node, low, left, right = page["top"], w["rank"] - page["page"] * fanout ** LEVELS, [], []
            for level in range(levels - 1, -1, -1):
                digit, children = low // fanout ** level % fanout, records[node]
                left.append("".join(children[:digit]))
                right.append("".join(children[digit + 1:]))
                node = children[digit]
            for n in names:
                out[n].append(page[n])
            out["rank"].append(w["rank"])
            out["digest"].append(node)
            out["body"].append(w["body"])
            out["left"].append(page["left"] + left)
            out["right"].append(page["right"] + right)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        for batch in batches:
            wanted = batch.schema.field("wanted").type.value_type
            text = pa.list_(pa.string())
            schema = pa.schema([*(batch.schema.field(n) for n in names), ("rank", pa.int64()), ("digest", pa.string()), ("body", wanted.field("body").type), ("left", text), ("right", text)])
            for at in range(batch.num_rows):
                yield descend(batch.slice(at, 1).to_pylist()[0], schema)
    return run


def descend(tree: Tree, start: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (g, rank, body) with digest and the siblings passed, left and right of the path, from the top down.

    start (g, digest, left, right, and columns to hand on) gives every group's top node and the path above it.
    """
    names = ["g", "height", *(c for c in start.columns if c not in ("g", "digest", "left", "right"))]
    at = join_stats(tree.tops.select("g", "height"), start, ["g"]).withColumn("page", F.lit(0).cast("long"))
    for base in range(len(tree.pages) - 1, -1, -1):
        here = at.where(F.col("height") > base * LEVELS) if base else at
        waiting = at.where(F.col("height") <= base * LEVELS) if base else None
        below = requests if base == 0 else tree.pages[base - 1].where(F.col("height") > base * LEVELS).select("g", F.col("page").alias("rank"), F.lit(None).cast("string").alias("body"))
        wide = tree.fanout ** LEVELS
        wanted = below.groupBy("g", F.expr(f"rank div {wide}").alias("page")).agg(F.collect_list(F.struct("rank", "body")).alias("wanted"))
        pages = here.join(wanted, ["g", "page"]).withColumnRenamed("digest", "top").join(tree.store[base], "top")
        body = below.schema["body"].dataType
        types = {f.name: f.dataType for f in pages.schema.fields}
        schema = T.StructType([*(T.StructField(n, types[n]) for n in names), T.StructField("rank", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("body", body),
                               *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("left", "right"))])
        found = pages.mapInArrow(_walk(base * LEVELS, tree.fanout, names), schema)
        if base:
            found = found.select(*names, F.col("rank").alias("page"), "digest", "left", "right")
            at = staged(found.unionByName(waiting.select(found.columns)), "merkle")
    return found


def proofs(docs: DataFrame, columns: Sequence[str], group_col: str = "source", order_col: str = "doc_id", fanout: int = 3, carried: dict[str, Column] | None = None, wanted: str = "true") -> DataFrame:
    """(leaf, group, rank, subroot, root, left, right) and the ``carried`` columns for every row of ``docs`` that ``wanted`` selects.

    left[i] and right[i] are the digests before and after the path at its i-th step from the
    leaf to the root, joined; ``folded`` goes back up with them.  Leaves ascend by order_col
    (null first) and digest in their group; groups ascend as text, null first.  Rows that are
    alike are leaves of their own; nulls, empty and long texts enter a leaf as ``field`` says.
    A group of one row has its leaf as subroot, a single group its subroot as root and then no
    steps of its own.  Other columns, whatever their names, stay out.  Empty tables give an
    empty result.
    """
    own = {f"c{i}": c for i, c in enumerate((carried or {}).values())}
    body = F.struct(F.expr(wanted).alias("wanted"), *(c.alias(n) for n, c in own.items()))
    slim = staged(docs.select(group_key(group_col).alias("g"), F.col(f"`{order_col}`").alias("o"), leaf(columns).alias("digest"), F.lit(1).cast("long").alias("n"), body.alias("body")), "merkle")
    numbered = staged(running(slim, ["o", "digest"], ["n"], slim.count(), ["g"]).select("g", F.col("before_n").alias("rank"), "digest", "body"), "merkle")
    groups = grow(numbered.select("g", "rank", "digest"), fanout)
    ends = staged(groups.tops, "merkle")
    named = running(ends.withColumn("n", F.lit(1).cast("long")), ["g"], ["n"], ends.count()).select(F.lit("").alias("g"), F.col("before_n").alias("rank"), "digest", F.col("g").alias("body"))
    named = staged(named, "merkle")
    whole = grow(named.select("g", "rank", "digest"), fanout)
    nothing = F.array().cast("array<string>")
    top = whole.tops.select("g", "digest", F.col("digest").alias("root"), nothing.alias("left"), nothing.alias("right"))
    start = staged(descend(whole, top, named.select("g", "rank", "body")).select(F.col("body").alias("g"), "digest", F.col("digest").alias("subroot"), "root", "left", "right"), "merkle")
    found = descend(groups, start, numbered.where("body.wanted").select("g", "rank", "body"))
    return found.select(F.col("digest").alias("leaf"), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group_col), "rank", "subroot", "root",
                        F.reverse("left").alias("left"), F.reverse("right").alias("right"), *(F.col(f"body.{n}").alias(c) for n, c in zip(own, carried or {}, strict=True)))


def folded(start: str, left: str = "left", right: str = "right") -> Column:
    """The root that a leaf digest leads to with the siblings of a proof."""
    return F.expr(f"aggregate(zip_with({left}, {right}, (l, r) -> named_struct('l', l, 'r', r)), {start}, (node, s) -> sha2(concat(s.l, node, s.r), 256))")
