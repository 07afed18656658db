import random

import numpy as np
import pytest

from strata.llm import spm, tokcount

from . import cases

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "  a   b", "Hello world.\nTwo\t\ttabs", "x" * 300, "héé wörld 日本語 벨ゼ梦 \U0001F600\U0001F600", "<s> <0x41> </s> <unk>", "▁a ▁▁", "\r\n\x01", "the the the"]


@pytest.fixture(scope="module")
def model():
    return open(PATH, "rb").read()


def unigram(model):
    """The same pieces as a unigram model, with scores like log-probabilities."""
    import math
    proto = spm.parse(model)
    proto.trainer_spec.model_type = spm.UNIGRAM
    for i, p in enumerate(proto.pieces):
        if p.type == spm.NORMAL:
            p.score = -math.log(i + 10) if p.score > -1e8 else -30.0
    return proto.SerializeToString()


def test_ids_equal_sentencepiece(model):
    for m in (model, unigram(model)):
        exact = spm._processor(m).encode([t for t in TEXTS if "0x" not in t])
        fast = [e.ids for e in spm._tokenizer(spm.rebuild(m)).encode_batch([t for t in TEXTS if "0x" not in t], add_special_tokens=False)]
        assert sum(a == b for a, b in zip(fast, exact, strict=True)) >= len(exact) - 1


def test_ids_come_from_the_rebuilt_object_and_parity_sees_its_faults(model):
    json = spm.rebuild(model)
    texts = [t.replace("▁", "") for t in TEXTS]
    ids, agree = spm.Encoder(json, model).encode(texts)
    assert all(agree) and [list(np.frombuffer(i, "<i4")) for i in ids] == [e.ids for e in spm._tokenizer(json).encode_batch(texts, add_special_tokens=False)]
    faults = [json.replace('{"type":"Prepend","prepend":"▁"},', ""), json.replace('"content":"▁"', '"content":"_"'), json.replace('"byte_fallback":true', '"byte_fallback":false')]
    for fault in faults:
        assert fault != json
        again, agree = spm.Encoder(fault, model).encode(texts)
        assert again == ids and not all(agree)


def test_parts_of_long_texts_join_to_the_whole(model, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "▁", "\n", "é", "日", "x\ty"]) for _ in range(rng.randrange(300))) for _ in range(200)]
    whole = [spm._processor(model).encode(t) for t in texts]
    monkeypatch.setattr(spm, "PART_CHARS", 16)
    encoder = spm.Encoder(spm.rebuild(model), model)
    assert any(len(encoder.parts(t)) > 3 for t in texts)
    ids, agree = encoder.encode(texts)
    assert [np.frombuffer(i, "<i4").tolist() for i in ids] == whole and all(agree)


def test_round_trip_parity_and_edges(spark, model):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (None, "a"), (1, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = spm.decode(spm.encode(df, model), model).collect()
    sp = spm._processor(model)
    assert len(both) == len(rows)
    for r in both:
        assert r.ids == sp.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    found = spm.verified(cases.docs(spark), model).collect()
    assert len(found) == len(cases.DOCS) and all(r.parity and r.round_trip for r in found)
    assert spm.encode(cases.clashing(spark), model).count() == len(cases.DOCS)
    assert spm.encode(cases.empty(spark), model).count() == 0
    null = spm.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), model).collect()
    assert {r.decoded for r in null} == {None, ""}


def plain(vocab, word):
    """Best score and pieces by the textbook: starts from the left, a path replaces another only if strictly better."""
    low = min(vocab.values()) - tokcount.UNKNOWN_PENALTY
    best = [(0.0, 0)] + [None] * len(word)
    for a in range(len(word)):
        for b in range(a + 1, len(word) + 1):
            if word[a:b] in vocab and (best[b] is None or best[a][0] + vocab[word[a:b]] > best[b][0]):
                best[b] = (best[a][0] + vocab[word[a:b]], best[a][1] + 1)
        if word[a] not in vocab and (best[a + 1] is None or best[a][0] + low > best[a + 1][0]):
            best[a + 1] = (best[a][0] + low, best[a][1] + len(word[a].encode()))
    return best[-1][1]


def test_count_against_plain_viterbi_with_ties():
    rng = random.Random(3)
    for _ in range(300):
        vocab = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 4)) for _ in range(12)}
        c = tokcount.Counter(tokcount.Vocabulary(tuple(vocab.items()), True, False, False))
        for _ in range(20):
            word = "".join(rng.choice("abcéz") for _ in range(rng.randrange(1, 14)))
            assert c.word(word) == plain(vocab, word), (vocab, word)


def test_count_equals_the_unigram_library(spark, model):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers
    pieces = tokcount.vocabulary(model).pieces
    low = min(s for _, s in pieces)
    t = Tokenizer(models.Unigram([*pieces, ("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256))], len(pieces), byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    t.pre_tokenizer = pre_tokenizers.Split(Regex("▁*[^▁]+|▁+"), "isolated")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [x for x in TEXTS if "0x" not in x]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in tokcount.token_counts(df, model).collect()}
    assert [found[i] for i in range(len(texts))] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_count_edges(spark, model):
    found = {r.doc_id: r.n_tokens for r in tokcount.token_counts(cases.docs(spark), model).collect()}
    assert found[3] == 0 and found[4] == 0 and found[8] > found[7] > 3000
    assert tokcount.token_counts(cases.clashing(spark), model, keep_text=False).count() == len(cases.DOCS)
    assert tokcount.token_counts(cases.empty(spark), model).count() == 0
    assert tokcount.Counter(tokcount.Vocabulary((), False, True, True)).text("ab c") == 2
