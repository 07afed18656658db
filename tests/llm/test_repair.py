import hashlib
import heapq
import random
import re
import zlib

from strata.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"0": ("user", "U"), "S": ("user", "U"), "U": ("assistant", "A"), "A": ("user", "U")}
KEPT = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def least(marks):
    """(cost, audit) of the cheapest edits, by a search in the order of cost and audit."""
    heap, seen = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        if i == len(marks) and q in "0A":
            return cost, audit
        seen.add((i, q))
        ways = [(2, "I", i, NEXT[q][1])]
        if i < len(marks):
            initial, fault = marks[i]
            ways.append((3, "D", i + 1, q))
            if fault not in "bd":
                more = fault == "t"
                ways += [(more, "K", i + 1, KEPT[q, initial])] * 1 if (q, initial) in KEPT else []
                ways.append((2 + more, "R", i + 1, NEXT[q][1]))
        for w, letter, j, r in ways:
            heapq.heappush(heap, (cost + w, audit + letter, j, r))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute(rows):
    whole, out = damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in whole if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks, seen = [], set()
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            marks.append((role[:1] if role[:1] in ("s", "u", "a") else "-", "b" if not body else "d" if (role, text) in seen else "k" if body[-1] in ".!?" else "t"))
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit = least(marks)
        lines, i, q = [], 0, "0"
        for letter in audit:
            if letter == "I":
                lines.append(f"{NEXT[q][0]}:")
                q = NEXT[q][1]
                continue
            if letter == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
                q = KEPT[q, marks[i][0]]
            elif letter == "R":
                lines.append(f"{NEXT[q][0]}:{own[i][2]}")
                q = NEXT[q][1]
            i += 1
        faults = [sum(f == x for _, f in marks) for x in "bdt"]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def made(rng, n, long=0):
    rows = []
    for c in [*range(n), None]:
        for t in range(long if c == 0 else rng.randrange(9)):
            role = rng.choice(["system", "user", "assistant", "tool", "", None]) if rng.random() < 0.25 else ("user", "assistant")[t % 2]
            text = rng.choice(["Fine.", "cut off", "", None, " \t", "Ends! \n", "ü?", "a. b"]) if rng.random() < 0.5 else f"Turn {t}."
            rows.append((c, t + (rng.random() < 0.1) if rng.random() < 0.95 else None, role, text))
    return rows + rows[:9]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_auction_against_search():
    rng = random.Random(1)
    for _ in range(1500):
        marks = [(rng.choice("sua-") if rng.random() < 0.5 else "ua"[i % 2], rng.choice("bdtkkk")) for i in range(rng.randrange(14))]
        assert repair.solved("".join(map("".join, marks)), repair.FREE, True)[0][:2] == least(marks)


def test_query_against_brute_force(spark, tmp_path):
    rows = made(random.Random(3), 120)
    assert got(queries.op13_conversation_repair(spark, write(spark, rows, tmp_path))) == brute(rows)


def test_conversations_over_many_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 8)
    rows = made(random.Random(4), 60, long=300)
    path = write(spark, rows, tmp_path)
    found = got(queries.op13_conversation_repair(spark, path))
    assert found == brute(rows) and len(found[0][6]) > 200
    edited, _ = repair.repair(queries.damaged(spark.read.parquet(f"{path}/conversations.parquet")))
    lines = repair.repaired_rows(edited).orderBy("row", "place").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines if r.conv_id == 0).encode()).hexdigest() == found[0][7]


def test_long_text_clashes_and_empty(spark, tmp_path):
    rows = [(1, 0, "user", "word " * 200_000 + "?"), (1, 1, "assistant", "."), (2, 0, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("g", "id", "row", "part", "blank", "open", "digest", "initial"):
        frame = frame.withColumn(name, repair.F.lit("z"))
    edited, summary = repair.repair(frame)
    assert [(r.audit, len(r.g)) for r in repair.digests(edited).orderBy("g").collect()] == [("KK", 2), ("D", 2)] and summary.count() == 2
    empty = queries.op13_conversation_repair(spark, write(spark, [], tmp_path / "none"))
    assert empty.count() == 0
    gone = [(c, t, "user", "x") for c in range(40) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    assert set(got(queries.op13_conversation_repair(spark, write(spark, gone, tmp_path / "gone"))).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
