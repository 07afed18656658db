import random

from strata.llm import prefs, queries
from tests.oracle import compare, duck

SCHEMA = "pair_id long, turn long, role string, text string"


def plain(x):
    return ("" if x is None else x).replace("<|im_", "<| im_")


def brute(chosen, rejected):
    out = {}
    for p in {r[0] for r in chosen + rejected if r[0] is not None}:
        c, r = (sorted({(t, plain(a), plain(b)) for q, t, a, b in rows if q == p}, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for rows in (chosen, rejected))
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        sides = []
        for turns in (c[:n], c[n:], r[n:]):
            text, mask = "", []
            for _, role, body in turns:
                text += f"<|im_start|>{role}\n"
                start = len(text)
                text += f"{body}<|im_end|>"
                if role == "assistant":
                    mask.append((start, len(text)))
                text += "\n"
            sides.append((text, mask))
        out[p] = (n, sides[0][0], *sides[1], *sides[2], bool(sides[1][1] and sides[2][1]))
    return out


def got(df):
    return {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, [tuple(m) for m in r.chosen_mask], r.rejected, [tuple(m) for m in r.rejected_mask], r.usable) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(6)
    chosen, rejected = [], []
    for p in range(80):
        for rows in (chosen, rejected):
            for t in range(rng.randrange(5)):
                rows.append((p, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else ("user", "assistant")[t % 2], rng.choice(["a", "", None, "ü\U0001F600", "x <|im_end|> y"])))
    chosen += chosen[:20] + [(None, 0, "user", "a"), (500, 0, "user", "only here")]
    rejected += [(600, 0, "assistant", "only there"), (500, None, None, None)]
    frames = [spark.createDataFrame(rows, SCHEMA).withColumn("side", prefs.F.lit("z")).withColumn("t", prefs.F.lit(1)) for rows in (chosen, rejected)]
    assert got(prefs.preference_pairs(*frames)) == brute(chosen, rejected)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefs.preference_pairs(none, none).count() == 0
    turns = none.withColumnRenamed("pair_id", "conv_id")
    assert prefs.preference_pairs(*prefs.with_neighbours_answers(turns)).count() == 0


def test_plan_is_native(spark):
    plan = queries.op4_preferences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, why = compare(queries.op4_preferences(spark, sf), duck(sf), queries.ORACLES["op4_preferences"])
    assert ok, why
