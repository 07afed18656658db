"""SentencePiece models on the tokenizers library, with every result held against sentencepiece.

The model's protobuf is parsed once; its normaliser, the marker for blanks, the pieces (BPE
merges in the order of their scores, or unigram scores) and byte fallback are rebuilt as a
``tokenizers`` object, which encodes batches of whole texts with several threads and gives
the ids.  Each text's ids are compared with those that sentencepiece finds on the same text,
so a fault of the rebuilt normaliser, marker or pieces shows; only where the two
differ sentencepiece's are returned, and the text's ``parity`` is false.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

T = TypeVar("T")

MARK = "▁"
# Texts of a batch are encoded together by this many threads, as many as a task has cores.
THREADS = 2
# Characters handed to the libraries at a time; a longer text goes in parts.
PART_CHARS = 1 << 18
# A blank between words: the character before it is no blank and no marker, and the text goes on.
_GAP = re.compile(f"(?<=[^ {MARK}]) (?!\\Z)")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file, from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def parse(model: bytes):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return proto


def rebuild(model: bytes) -> str:
    """The JSON of a ``tokenizers`` object that does what the sentencepiece model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    proto = parse(model)
    train, norm, pieces = proto.trainer_spec, proto.normalizer_spec, proto.pieces
    if train.model_type not in (UNIGRAM, BPE) or train.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with the marker in front of words are rebuilt")
    unknown = next((i for i, p in enumerate(pieces) if p.type == UNKNOWN), 0)
    if train.model_type == UNIGRAM:
        # pieces that never stand for their own characters must not win a path
        low = min(p.score for p in pieces) - 1e6
        core = models.Unigram([(p.piece, p.score if p.type in (NORMAL, USER_DEFINED) else low) for p in pieces], unknown, byte_fallback=train.byte_fallback)
    else:
        ids = {p.piece: i for i, p in enumerate(pieces)}
        own = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER_DEFINED)}
        splits = [(-score, ids[piece[:i]], ids[piece[i:]], piece[:i], piece[i:])
                  for piece, score in own.items() for i in range(1, len(piece)) if piece[:i] in own and piece[i:] in own]
        core = models.BPE(ids, [s[3:] for s in sorted(splits)], unk_token=pieces[unknown].piece, fuse_unk=True, byte_fallback=train.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(True, True), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if norm.escape_whitespaces else " "))
    if norm.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                     *([decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else [])])
    return out.to_str()


@lru_cache(maxsize=4)
def _tokenizer(json: str):
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json)


@lru_cache(maxsize=4)
def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


class Encoder:
    """Encodes whole texts by the rebuilt ``tokenizers`` object and holds them against sentencepiece.

    Where no piece has the marker behind another character, no merge crosses from a word into
    the next, so nothing splits a text into words before the merges; and a text longer than PART_CHARS is
    handed over in parts, cut at blanks between words: the marker that the normaliser puts in
    front of a part stands for the blank, so the parts' ids joined are the text's.
    """

    def __init__(self, json: str, model: bytes):
        proto = parse(model)
        norm = proto.normalizer_spec
        self.tokenizer, self.exact = _tokenizer(json), _processor(model)
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix
        self.cuts = plain and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (NORMAL, USER_DEFINED))

    def parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.cuts and len(text) - at > PART_CHARS and (gap := _GAP.search(text, at + PART_CHARS)):
            out.append(text[at:gap.start()])
            at = gap.end()
        return [*out, text[at:]]

    def each(self, texts: list[str], finish: Callable[[list[int], bool], T]) -> list[T]:
        """``finish`` of every text's ids and whether both libraries agreed on all of it, called when the text's last part is done."""
        out, group, ends, size = [], [], [], 0
        open_ids, open_agree = [], True

        def run():
            nonlocal open_ids, open_agree
            fast = self.tokenizer.encode_batch_fast(group, add_special_tokens=False)
            exact = self.exact.encode(group, num_threads=THREADS)
            for own, wanted, last in zip(fast, exact, ends, strict=True):
                found = own.ids
                same = found == wanted
                if open_ids or not last:
                    open_ids += found if same else wanted
                else:
                    open_ids = found if same else wanted
                open_agree &= same
                if last:
                    out.append(finish(open_ids, open_agree))
                    open_ids, open_agree = [], True

        for text in texts:
            parts = self.parts(text)
            for i, part in enumerate(parts, 1):
                group.append(part), ends.append(i == len(parts))
                size += len(part)
                if size >= PART_CHARS:
                    run()
                    group, ends, size = [], [], 0
        if group:
            run()
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of every text as little-endian int32, and whether both libraries agreed on all of it."""
        found = self.each(texts, lambda ids, agree: (packed(ids), agree))
        return [ids for ids, _ in found], [agree for _, agree in found]


def packed(ids: list[int]) -> bytes:
    """The ids as little-endian int32."""
    return np.array(ids, "<i4").tobytes()


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


@lru_cache(maxsize=4)
def _encoder(json: str, model: bytes) -> Encoder:
    return Encoder(json, model)


class Decoder:
    """Joins the bytes of pieces, markers as blanks and byte pieces as their byte; ids that are
    no valid UTF-8 together go through the rebuilt decoder."""

    def __init__(self, json: str):
        self.tokenizer = _tokenizer(json)
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(MARK, " ").encode() for p in pieces]
        # a leading blank is dropped where the model puts one
        mark = self.tokenizer.token_to_id(MARK)
        self.strip = mark is not None and self.tokenizer.decode([mark]) == ""

    def decode(self, ids: list[int]) -> str:
        try:
            text = b"".join(map(self.bytes.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.strip and text[:1] == " " else text


@lru_cache(maxsize=4)
def _decoder(json: str) -> Decoder:
    return Decoder(json)


def _encode(json: str, model: bytes):
    def run(texts: pa.Array) -> list[pa.Array]:
        ids, agree = _encoder(json, model).encode([t or "" for t in texts.to_pylist()])
        return [_lists(ids), pa.array(agree, pa.bool_())]
    return run


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", parity_col: str = "parity", keep_text: bool = True) -> DataFrame:
    """``docs`` with the piece ids of every whole text and whether both libraries agree on them.

    Null and empty texts have no ids.  The strings of control pieces are ordinary text.
    Rows are handled one by one: repeated rows, null ids and other columns pass through
    (columns named like the outputs are replaced); an empty table gives an empty result.
    """
    json = rebuild(model)
    return tx.mapped(docs, text_col, _encode(json, model), {ids_col: "array<int>", parity_col: "boolean"}, keep_text)


def _decode(json: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids").to_pylist()
        decode = _decoder(json).decode
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([None if i is None else decode(i) for i in ids], pa.string())], ["row", "text"])
    return tx.by_slices(run)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of every id list; null ids give null, no ids the empty text."""
    names = [c for c in rows.columns if c != text_col]
    packed = rows.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.col(f"`{ids_col}`").alias("ids"))
    found = packed.mapInArrow(_decode(rebuild(model)), packed.select("row").schema.add("text", "string"))
    return found.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)), F.col("text").alias(text_col))


def _verify(json: str, model: bytes):
    def run(texts: pa.Array) -> list[pa.Array]:
        own = [t or "" for t in texts.to_pylist()]
        decode = _decoder(json).decode
        text = iter(own)  # texts are finished in their order
        found = _encoder(json, model).each(own, lambda ids, agree: (len(ids), agree, decode(ids) == next(text), hashlib.sha256(packed(ids)).hexdigest()))
        types = (pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        return [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
    return run


def verified(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_ids, parity of the two libraries, round_trip (decoding
    gives the text back) and ids_sha256 (of the ids as little-endian int32).

    Null and empty texts have no ids.  Rows are handled one by one, so repeated rows give equal
    rows; very long texts are encoded whole, in parts of bounded size.  Columns named like the
    outputs are replaced; an empty table gives an empty result.
    """
    outputs = {"n_ids": "bigint", "parity": "boolean", "round_trip": "boolean", "ids_sha256": "string"}
    json = rebuild(model)
    return tx.mapped(docs, text_col, _verify(json, model), outputs, False)
