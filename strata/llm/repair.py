"""Conversation structure repair: the cheapest edits, found by an auction for shortest paths.

A conversation's turns and the role grammar ``(s?(ua)+)?`` span a lattice of nodes
(turns consumed, grammar state); arcs are the edits Keep, Rerole, Delete and Insert with
integer costs.  The auction holds a price per node and a path that is extended along an
arc whose cost equals the fall of price, or contracted with a rise of its last node's price
where there is none.  Starts are taken from the back of the lattice, so a path ends as soon
as it meets a node that an earlier path has connected with the end.  With converged prices
every cheapest path consists of tight arcs (cost = fall of price); the audit is the
ASCII-least walk over tight arcs that lead to the end.

Turns are cut into segments of bounded length.  A conversation that lies in several is
solved by the costs of its segments from each state to each, which give the prices at the
segments' borders; every segment is then walked under these prices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .order import group_key, in_order

# Turns of a segment at most: a power of two.
SEGMENT = 512

# The edits' costs, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# Grammar states: nothing yet, after system, after user, after assistant; the last and the first may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FREE = (0, None, None, 0)
#: The state's next role, by which Rerole and Insert are bound, and the state after it.
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: The state that keeping a turn of an initial leads to.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Starts of the auction lie this many turns apart.
STRIDE = 8


def _arcs(codes: str, ends: Sequence[int | None], final: bool) -> tuple[list, list]:
    """The lattice: for node 4 * i + state its arcs (letter, cost, next node), letters ascending, and whether it can reach the end.

    codes holds two characters per turn: role initial (s, u, a or -), and its fault: b (blank),
    d (duplicate), t (truncated) or k (none).  ends are the costs from the states after the last turn to the end
    (node 4 * (n + 1)); only a final segment inserts there.
    """
    n = len(codes) // 2
    arcs, reach = [[] for _ in range(4 * n + 5)], [False] * (4 * n + 5)
    reach[-1] = True
    for i in range(n, -1, -1):
        own = [[] for _ in range(4)]
        for q in range(4):
            if i == n:
                own[q] += [("", ends[q], 4 * n + 4)] * (ends[q] is not None)
                continue
            initial, fault = codes[2 * i], codes[2 * i + 1]
            own[q].append(("D", DELETE, 4 * (i + 1) + q))
            if fault not in "bd":
                more = TRUNCATED if fault == "t" else 0
                if (q, initial) in KEPT:
                    own[q].append(("K", more, 4 * (i + 1) + KEPT[q, initial]))
                own[q].append(("R", REROLE + more, 4 * (i + 1) + NEXT[q][1]))
            own[q] = [a for a in own[q] if reach[a[2]]]
        for q in range(4):
            reach[4 * i + q] = bool(own[q])
        if i < n or final:
            after = [4 * i + NEXT[q][1] for q in range(4)]
            for q in (USER, ASSISTANT, USER, START, SYSTEM):
                reach[4 * i + q] |= reach[after[q]]
            for q in range(4):
                own[q] += [("I", INSERT, after[q])] * reach[after[q]]
        arcs[4 * i:4 * i + 4] = map(sorted, own)
    return arcs, reach


def _auction(arcs: list, reach: list) -> list[int]:
    """Prices of the nodes under which every start's price is its distance to the end; others' are lower bounds.

    The nodes before a finished row of starts begin at the least of its prices: no arc from
    them costs less than the fall of price, and they need not climb there step by step.
    """
    n = len(arcs) // 4 - 1
    price, done = [0] * len(arcs), [False] * len(arcs)
    done[-1] = True
    later = n
    for i in dict.fromkeys([*range(n, -1, -STRIDE), 0]):
        if i < later:
            price[4 * i:4 * later] = [min(price[4 * later + q] for q in range(4) if reach[4 * later + q])] * (4 * (later - i))
            later = i
        for q in range(4):
            if not reach[4 * i + q]:
                continue
            path = [4 * i + q]
            while not done[node := path[-1]]:
                least = min((cost + price[to], to) for _, cost, to in arcs[node])
                if price[node] < least[0]:  # contract
                    price[node] = least[0]
                    if len(path) > 1:
                        path.pop()
                else:  # extend
                    path.append(least[1])
            for node in path:
                done[node] = True
    return price


def _trace(arcs: list, reach: list, price: list[int], start: int) -> tuple[str, int]:
    """The ASCII-least audit from a start along tight arcs to the end, and the state at the last turn's end."""
    n = len(arcs) // 4 - 1
    tight = [[(x, to) for x, cost, to in own if price[node] == cost + price[to]] for node, own in enumerate(arcs)]
    live = [False] * len(arcs)
    live[-1] = True
    for i in range(n, -1, -1):
        for q in (*range(3, -1, -1), *range(3, -1, -1)):
            node = 4 * i + q
            live[node] = live[node] or reach[node] and any(live[to] for _, to in tight[node])
    audit, node, last = [], start, START
    while node != len(arcs) - 1:
        if node >= 4 * n:
            last = node - 4 * n
        letter, node = next(a for a in tight[node] if live[a[1]])  # letters ascend; the end comes first
        audit.append(letter)
    return "".join(audit), last


@lru_cache(maxsize=20_000)
def solved(codes: str, ends: tuple, final: bool) -> tuple:
    """For each state at a segment's start: (cost, audit, state at its end), or None where the end is out of reach."""
    arcs, reach = _arcs(codes, ends, final)
    price = _auction(arcs, reach)
    return tuple((price[q], *_trace(arcs, reach, price, q)) if reach[q] else None for q in range(4))


def crossings(codes: str) -> list[int | None]:
    """Costs of an inner segment from each state (rows) to each (columns), None where there is no way."""
    columns = [solved(codes, tuple(0 if q == e else None for q in range(4)), False) for e in range(4)]
    return [c[q] and c[q][0] for q in range(4) for c in columns]


def _edited(codes: str, audit: str, state: int) -> tuple[list[str], list[str], list[str], str]:
    """Per turn the initials of roles inserted before it, its letter and the role that Rerole gives it; and the initials inserted after all."""
    befores, letters, roles, before = [], [], [], ""
    for letter in audit:
        role, after = NEXT[state]
        if letter == "I":
            before, state = before + role[0], after
            continue
        if letter != "D":
            state = KEPT[state, codes[2 * len(letters)]] if letter == "K" else after
        befores.append(before)
        letters.append(letter)
        roles.append(role if letter == "R" else None)
        before = ""
    return befores, letters, roles, before


def _illegal(initials: str) -> int:
    """Neighbours that the grammar doesn't allow."""
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _by_row(fn, schema: pa.Schema):
    """A mapInArrow function that gives for every row (as a dict) one row of ``schema``."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([fn(r) for r in batch.to_pylist()], schema=schema)
    return run


_PLAN = "g string, seg long, row0 long, codes string, state int, audit string, cost long, illegal long"
_KEYS = [("g", pa.string()), ("seg", pa.int64())]
_OWN = [("row0", pa.int64()), ("codes", pa.string()), ("state", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]


def _lone(r: dict) -> dict:
    cost, audit, _ = solved(r["codes"], FREE, True)[START]
    return {k: r[k] for k in ("g", "seg", "row0", "codes")} | {"state": START, "audit": audit, "cost": cost, "illegal": _illegal(r["codes"][::2])}


def _crossed(r: dict) -> dict:
    ways = [way[0] for way in solved(r["codes"], FREE, True)] if r["final"] else crossings(r["codes"])
    return {"g": r["g"], "seg": r["seg"], "ways": ways, "edge": r["codes"][0] + r["codes"][-2], "illegal": _illegal(r["codes"][::2])}


def _borders(rows: pd.DataFrame) -> pd.DataFrame:
    """Prices at the end of every segment of a conversation, from the last one back; and the illegal neighbours, those across borders included."""
    rows = rows.sort_values("seg", ignore_index=True)
    far = np.iinfo(np.int64).max // 4
    ends, price = [None] * len(rows), None
    for i in range(len(rows) - 1, -1, -1):
        ways = np.array([far if w is None or w != w else int(w) for w in rows.ways[i]], np.int64)
        if price is None:
            ends[i], price = [-1 if c is None else c for c in FREE], ways
        else:
            ends[i] = [-1 if p >= far else int(p) for p in price]
            price = np.minimum((ways.reshape(4, 4) + price).min(axis=1), far)
    edge = rows.edge.tolist()
    across = [0, *(_illegal(a[1] + b[0]) for a, b in zip(edge, edge[1:]))]
    return pd.DataFrame({"g": rows.g, "seg": rows.seg, "ends": ends, "illegal": rows.illegal + across})


def _walked(r: dict) -> dict:
    ways = solved(r["codes"], tuple(None if e < 0 else e for e in r["ends"]), r["final"])
    return {"g": r["g"], "seg": r["seg"], "audits": [w and w[1] for w in ways], "outs": [w[2] if w else -1 for w in ways], "costs": [w[0] if w else -1 for w in ways]}


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which the audit enters every segment of a conversation."""
    rows, states = rows.sort_values("seg", ignore_index=True), [START]
    for outs in rows.outs[:-1]:
        states.append(int(outs[states[-1]]))
    cost = [int(rows.costs[0][START]), *[0] * (len(rows) - 1)]
    return pd.DataFrame({"g": rows.g, "seg": rows.seg, "state": pd.Series(states, dtype="int32"), "cost": cost})


def _plan(segments: DataFrame) -> DataFrame:
    """The edits of every segment: _PLAN; cost stands at a conversation's first segment only."""
    sizes = segments.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("seg").alias("last"))
    known = staged(segments.join(sizes, "g").withColumn("final", F.col("seg") == F.col("last")), "repair")
    lone = known.where("n = 1").drop("n", "last", "final").mapInArrow(_by_row(_lone, pa.schema(_KEYS + _OWN)), _PLAN)
    many = known.where("n > 1").select("g", "seg", "row0", "codes", "final")
    ints = pa.list_(pa.int64())
    ways = many.mapInArrow(_by_row(_crossed, pa.schema([*_KEYS, ("ways", ints), ("edge", pa.string()), ("illegal", pa.int64())])), "g string, seg long, ways array<long>, edge string, illegal long")
    borders = staged(ways.groupBy("g").applyInPandas(_borders, "g string, seg long, ends array<long>, illegal long"), "repair")
    walks = staged(many.join(borders, ["g", "seg"]).mapInArrow(_by_row(_walked, pa.schema([*_KEYS, ("audits", pa.list_(pa.string())), ("outs", ints), ("costs", ints)])),
                                                               "g string, seg long, audits array<string>, outs array<long>, costs array<long>"), "repair")
    states = walks.select("g", "seg", "outs", "costs").groupBy("g").applyInPandas(_chained, "g string, seg long, state int, cost long")
    joined = many.join(borders, ["g", "seg"]).join(walks, ["g", "seg"]).join(states, ["g", "seg"])
    return lone.unionByName(joined.select("g", "seg", "row0", "codes", "state", F.expr("element_at(audits, state + 1)").alias("audit"), "cost", "illegal"))


def _turn_edits(batches):
    schema = pa.schema([("row", pa.int64()), ("before", pa.string()), ("letter", pa.string()), ("new_role", pa.string()), ("after", pa.string())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            befores, letters, roles, after = _edited(r["codes"], r["audit"], r["state"])
            rows += [{"row": r["row0"] + i, "before": b, "letter": x, "new_role": role, "after": after if i == len(letters) - 1 else ""} for i, (b, x, role) in enumerate(zip(befores, letters, roles))]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _marked(turns: DataFrame, id_col: str) -> DataFrame:
    """The turns in order with their marks, written once."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(group_key(id_col).alias("g"), F.col(f"`{id_col}`").alias("id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    body = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), "blank": body == "", "open": ~F.right(body, F.lit(1)).isin(".", "!", "?"),
                             "digest": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))})
    return in_order(rows, ["g", "turn", "role", "text"], turns.count(), "repair")


def repair(turns: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turns with their edits, a row per conversation) for rows (id_col, turn, role, text); other columns stay out.

    Turns of a conversation go by turn (null first), role and text; a null role or text is
    one blank, a null id is a conversation of its own.  A turn's fault is the first of blank,
    duplicate (role and text seen earlier) and truncated (its last character that is no
    blank is none of ``.!?``).  A role counts by its first letter; an empty or other role
    fits nowhere in the grammar.  Repeated rows are turns of their own.

    First table: id_col, turn, role, text, g, row (place in the order), fault (b, d, t, k),
    letter (K, R, D), new_role, before and after (initials of inserted roles around it; after
    only at the last turn).  Second table: g, gaps, blank, duplicate, truncated, illegal,
    cost.  Cost is the least over all edits, the audit the ASCII-least of the cheapest.  An
    empty table gives empty tables.  No task holds a conversation: the order is range-sorted,
    edits are found per segment, and what a conversation brings together is a few numbers
    for each of its segments.
    """
    marked = _marked(turns, id_col)
    first = marked.groupBy("g", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    slim = marked.select("row", "g", "initial", "blank", "open").join(first, "row", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("open"), "t").otherwise("k")
    coded = slim.select("g", "row", F.concat("initial", fault).alias("code"))
    segments = coded.groupBy("g", F.expr(f"row div {SEGMENT}").alias("seg")).agg(F.min("row").alias("row0"), F.array_sort(F.collect_list(F.struct("row", "code"))).alias("c"))
    plan = staged(_plan(segments.select("g", "seg", "row0", F.expr("array_join(transform(c, x -> x.code), '')").alias("codes"))), "repair")
    edits = plan.select("row0", "codes", "state", "audit").mapInArrow(_turn_edits, "row long, before string, letter string, new_role string, after string")
    edited = marked.select("g", "id", "turn", "role", "text", "row", "blank", "open").join(edits, "row").join(first, "row", "left")
    edited = edited.select(F.col("id").alias(id_col), "turn", "role", "text", "g", "row", fault.alias("fault"), "letter", "new_role", "before", "after")
    faults = [F.sum(F.expr(f"size(filter(sequence(1, cast(length(codes) div 2 as int)), i -> substr(codes, 2 * i, 1) = '{x}'))")).alias(name) for x, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    sums = plan.groupBy("g").agg(*faults, F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    span = marked.groupBy("g", "turn").agg(F.lit(1).alias("one")).groupBy("g").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return edited, span.join(sums, "g").select("g", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows() -> Column:
    """What a turn becomes: the rows inserted before it, itself unless deleted, and those inserted after it, as (role, text)."""
    role = lambda x: F.when(x == "u", "user").otherwise("assistant")
    made = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(role(x).alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    return F.concat(made("before"), F.when(F.col("letter") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(own), made("after"))


def repaired_rows(edited: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The repaired conversations: (id_col, g, row, place, role, text) for every turn that is kept or inserted; row and place order them."""
    return edited.select(id_col, "g", "row", F.posexplode(_rows()).alias("place", "r")).select(id_col, "g", "row", "place", "r.role", "r.text")


def _hashed(batches):
    """Audit and sha256 of the lines of each conversation, whose segments come in order."""
    now, audit, sha, empty = None, [], None, True
    schema = pa.schema([("g", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    done = lambda: pa.RecordBatch.from_pylist([{"g": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=schema)
    for batch in batches:
        for r in batch.to_pylist():
            if r["g"] != now:
                if now is not None:
                    yield done()
                now, audit, sha, empty = r["g"], [], hashlib.sha256(), True
            audit.append(r["audit"])
            for line in r["lines"]:
                sha.update((line if empty else "\n" + line).encode())
                empty = False
    if now is not None:
        yield done()


def digests(edited: DataFrame) -> DataFrame:
    """(g, audit, repaired_sha256) per conversation: all its edits' letters, and the hash of its repaired ``role:text`` lines.

    Segments' lines are gathered first; a conversation's segments then pass one after the
    other through one hash, which holds no more than one of them.
    """
    lines = F.transform(_rows(), lambda r: F.concat(r.role, F.lit(":"), r.text))
    letters = F.concat(F.repeat(F.lit("I"), F.length("before")), "letter", F.repeat(F.lit("I"), F.length("after")))
    parts = edited.groupBy("g", F.expr(f"row div {SEGMENT}").alias("seg")).agg(F.array_sort(F.collect_list(F.struct("row", letters.alias("audit"), lines.alias("lines")))).alias("p"))
    parts = parts.select("g", "seg", F.expr("array_join(transform(p, x -> x.audit), '')").alias("audit"), F.expr("flatten(transform(p, x -> x.lines))").alias("lines"))
    return parts.repartition("g").sortWithinPartitions("g", "seg").mapInArrow(_hashed, "g string, audit string, repaired_sha256 string")
