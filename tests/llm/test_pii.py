import hashlib
import random
import re

from strata.llm import pii

from . import cases

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= sum(c.isdigit() for c in s) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
}


def base(text):
    return [(k, *m.span()) for k, (rule, holds) in RULES.items() for m in re.finditer(rule, text or "") if holds(m.group())]


def test_base_spans_against_the_plain_expressions():
    rng = random.Random(5)
    for n in range(4000):
        alphabet = rng.choice(["a@.-_%é ", "0123456789. ", "0123456789 -", "+0123456789()-. ", "aZ0@.+ -9"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == base(text), (n, text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001") and not pii.mod97("DE8937040044053201300")
    kinds = [s[0] for s in pii.find("my IBAN is DE89 3704 0044 0532 0130 00 and social security 123-45-6789")]
    assert kinds == ["iban", "ssn"]
    assert [s[0] for s in pii.find("part 123-45-6789 of a serial")] == []  # nothing near speaks for it


def test_redaction_and_context():
    text = "mail bob@example.org or +1 (555) 010-9999, card 4111 1111 1111 1111."
    assert pii.redact(text, pii.find(text)) == "mail <email> or <phone>, card <card>."
    scores = {s[0]: s[3] for s in pii.find(text)}
    assert scores["card"] == 1.0 and scores["phone"] == 0.6


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 150_000, "A1" * 100_000):
        pii.find(text)


def test_query_columns_and_edges(spark):
    rows = [*cases.DOCS, (20, "ü call +49 30 1234567 \U0001F600 a@b.co", "de", "s", 1)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    found = pii.digests(pii.personal_data(df)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        own = base(text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(o[0] == k for o in own) for k in RULES)
    out = pii.personal_data(cases.clashing(spark))
    assert out.columns[-2:] == ["pii_spans", "redacted"] and out.count() == len(cases.DOCS)
    assert {r.doc_id: r.redacted for r in out.collect()}[4] is None
    assert pii.personal_data(cases.empty(spark)).count() == 0


def test_an_iban_ends_at_its_countrys_length():
    spans = lambda text: [text[a:b] for k, a, b, _ in pii.find(text) if k == "iban"]
    one, two = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    for behind in (" BIC COBADEFFXXX", " EUR 50", " 50", " " + two, "", ".", " and"):
        assert spans(one + behind)[0] == one, behind
    assert spans(f"{one} {two}") == [one, two]
    assert pii.redact(f"{one} EUR 50", pii.find(f"{one} EUR 50")) == "<iban> EUR 50"
    assert spans(one + "1") == spans("X" + one) == spans(one[:-1]) == spans("DE89 3704 0044 0532 0130 01 EUR") == []
    assert spans(f"AT61 1904 3002 3457 3202 {one}")[-1] == one  # a wrong one in front hides nothing behind it
    for iban in ("RO49AAAA1B31007593840000", "BG80BNBG96611020345678", "HR1210010051863000160", "SK3112000000198742637541", "SI56263300012039086",
                 "LT121000011101001000", "LV80BANK0000435195001", "EE382200221020145685", "MT84MALT011000012345MTLCAST001S", "CY17002001280000001200527600",
                 "TR330006100519786457841326", "AE070331234567890123456", "SA0380000000608010167519"):
        assert spans(iban) == [iban]
