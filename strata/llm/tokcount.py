"""Token counts of a unigram vocabulary without the tokens: a Viterbi that only counts.

An Aho-Corasick automaton lists every vocabulary match of a word in one pass, by its end;
dynamic programming keeps, for every place, the best score and the pieces it took.  Ties
are broken as the tokenizer does: of equal scores the path found first stays, and starts
are visited from the left, so the longer last piece wins.  A character without a piece of
its own costs ten less than the lowest score; with byte fallback it counts one piece for
each of its bytes, without it a run of such characters counts one.

No piece has the blank marker behind another character, so a best path always cuts in front
of a word's marker and words can be counted one by one; a bounded memo holds counts seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import spm
from . import text as tx

# Words remembered by a task, and the longest that is.
MEMO, MEMO_CHARS = 400_000, 64
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(f"{spm.MARK}*[^{spm.MARK}]+|{spm.MARK}+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores, whether unknown characters fall back to bytes, and how a text starts and marks blanks."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool
    prefix: bool
    escape: bool


def vocabulary(model: bytes) -> Vocabulary:
    """The pieces and scores of a sentencepiece model whose normaliser changes nothing but blanks."""
    proto = spm.parse(model)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("the model's normaliser rewrites texts: normalise them first")
    pieces = tuple((p.piece, p.score) for p in proto.pieces if p.type in (spm.NORMAL, spm.USER_DEFINED))
    if any(spm.MARK in p.lstrip(spm.MARK) for p, _ in pieces):
        raise ValueError("a piece holds a blank behind another character")
    return Vocabulary(pieces, proto.trainer_spec.byte_fallback, norm.add_dummy_prefix, norm.escape_whitespaces)


class Counter:
    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if vocab.pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab.pieces), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best path through one word."""
        n = len(word)
        score, count, strange = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, best, single, known = 1, None, False, False
        matches = self.automaton.iter(word) if self.vocab.pieces else iter(())
        found = next(matches, None)
        while at <= n:
            best, single = None, False
            while found is not None and found[0] + 1 == at:  # all matches that end here, longest first
                length, own = found[1]
                path = score[at - length] + own
                if best is None or path > best:
                    best, pieces, known = path, count[at - length] + 1, True
                single = single or length == 1
                found = next(matches, None)
            if not single and (best is None or score[at - 1] + self.unknown > best):
                best, known = score[at - 1] + self.unknown, False
                if self.vocab.byte_fallback:
                    pieces = count[at - 1] + len(word[at - 1].encode())
                else:
                    pieces = count[at - 1] + (not strange[at - 1])
            score[at], count[at], strange[at] = best, pieces, not known
            at += 1
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        if self.vocab.escape:
            text = text.replace(" ", spm.MARK)
        if self.vocab.prefix:
            text = (spm.MARK if self.vocab.escape else " ") + text
        total, memo = 0, self.memo
        for w in _WORDS.findall(text):
            c = memo.get(w)
            if c is None:
                c = self.word(w)
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = c
            total += c
        return total


@lru_cache(maxsize=2)
def _counter(model: bytes) -> Counter:
    return Counter(vocabulary(model))


def _count(model: bytes):
    def run(texts: pa.Array) -> list[pa.Array]:
        counter = _counter(model)
        return [pa.array([counter.text(t or "") for t in texts.to_pylist()], pa.int64())]
    return run


def token_counts(docs: DataFrame, model: bytes, text_col: str = "text", count_col: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``docs`` with the number of pieces of every whole text under the model's unigram scores.

    Null and empty texts have none.  Rows are handled one by one: repeated rows, null ids
    and other columns pass through (a column named like the output is replaced); an empty
    table gives an empty result.
    """
    vocabulary(model)  # unfit models fail here, not in a task
    return tx.mapped(docs, text_col, _count(model), {count_col: "bigint"}, keep_text, lambda: _counter(model).memo.clear())
