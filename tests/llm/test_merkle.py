import hashlib
import zlib

from strata.llm import merkle, queries
from strata.llm.merkle import F

from . import cases

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], doc[1])))


def tree(nodes, fanout=3):
    """(top, siblings of every node up to it)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at):
            p += [nodes[j] for j in range(i - i % fanout, min(len(nodes), i - i % fanout + fanout)) if j != i]
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[3], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in names:
        own = sorted(groups[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        grown[s] = (own, *tree([leaf(d) for d in own]))
    root, above = tree([grown[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        own, sub, proofs = grown[s]
        for d, p in zip(own, proofs):
            forged = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[1] is not None and "\n" in d[1]
            out.append((d[0], leaf(d), sub, root, h(*p, *up), not forged))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in rows.collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    sources = [None, "", "a", "ä", "b", "only"]
    rows = [(i if i % 50 else None, f"line {i}\nnext" if i % 3 else None, "en", sources[min(i % 9, 4)], i % 4 or None) for i in range(900)] + [(7, "x\ny", None, "only", None)] + cases.DOCS
    spark.createDataFrame(rows, cases.SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op12_merkle_manifest(spark, str(tmp_path))) == brute(rows)


def test_small_groups_and_empty(spark, tmp_path):
    for n, rows in enumerate(([(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1)] * 4, [])):
        spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert got(queries.op12_merkle_manifest(spark, f"{tmp_path}/{n}")) == (brute(rows) if rows else [])


def test_wanted_rows_other_fanout_and_clashes(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(40)], cases.SCHEMA)
    for name in ("g", "o", "n", "digest", "body", "rank"):
        docs = docs.withColumn(name, F.lit("z"))
    rows = merkle.proofs(docs, COLUMNS, fanout=4, carried={"doc_id": F.col("doc_id")}, wanted="doc_id % 7 = 3").withColumn("up", merkle.folded("leaf")).collect()
    top, siblings = tree([leaf((i, f"t{i}", "en", "s", i)) for i in range(40)], 4)
    assert sorted(r.doc_id for r in rows) == [3, 10, 17, 24, 31, 38]
    for r in rows:
        assert r.up == r.root == r.subroot == top and r.rank == r.doc_id
        assert "".join(a + b for a, b in zip(r.left, r.right)) == "".join(siblings[r.doc_id])


def test_store_keeps_equal_subtrees_once(spark):
    leaves = spark.range(3 ** 6).select(F.lit("").alias("g"), F.col("id").alias("rank"), F.sha2(F.lit("same").cast("binary"), 256).alias("digest"))
    grown = merkle.grow(leaves)
    assert grown.pages[0].count() == 3 and grown.store[0].count() == 1
