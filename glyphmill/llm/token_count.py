"""Operator 10: token counts by a count-only Viterbi over a unigram vocabulary.

The vocabulary (pieces with scores) comes from a file of a public tokenizer.
White space U+0020 becomes U+2581, which starts every word, as in unigram
tokenizers with a metaspace pre-tokenizer; words are independent.  For each
distinct word an Aho-Corasick automaton lists all vocabulary matches, and
dynamic programming carries, for each position, the best score and the number
of pieces on the best path.  No piece is ever built.

Tie rules, as in the tokenizer: matches at a position are taken by ascending
start, and a later one must score strictly more; a character without a match
of its own is unknown, scores the least score less 10, and counts as its UTF-8
bytes (byte fallback).

Defined cases: null text counts as empty, which has 0 tokens; very long texts
are counted whole, word by word; ties follow the tokenizer's rules; a null id is
carried along; repeated rows are all kept; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Memo, bounded_batches, kept, slices, split, sums

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file; control, unknown and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """Counts the pieces of single words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.empty = not pieces

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces, reached, single = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * n
        at = 0

        def settle(upto: int) -> None:
            """Positions before ``upto`` get no more matches; the unknown character comes last at its end."""
            nonlocal at
            while at < upto:
                if not single[at]:
                    score = best[at] + self.unknown
                    if not reached[at + 1] or score > best[at + 1]:
                        best[at + 1], pieces[at + 1], reached[at + 1] = score, pieces[at] + len(word[at].encode("utf-8", "surrogatepass")), True
                at += 1

        if not self.empty:
            # matches come by end, and for an end the longest first, so by ascending start
            for last, (length, value) in self.automaton.iter(word):
                settle(last)
                end, start = last + 1, last + 1 - length
                score = best[start] + value
                if not reached[end] or score > best[end]:
                    best[end], pieces[end], reached[end] = score, pieces[start] + 1, True
                if length == 1:
                    single[start] = True
        settle(n)
        return pieces[n]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_words) of every whole text; no shuffle."""
    path = path or default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> tuple[Counter, Memo]:
            counter = Counter(vocabulary(path))
            return counter, Memo(lambda words: np.array([counter.count(SPACE + w) for w in words], np.int64))

        _, memo = kept(f"unigram {path}", start)
        for batch, text in slices(batches, "text"):
            text = pc.replace_substring(text, SPACE, " ")
            # a space before the text starts its first word; where one stands there already, none is added
            text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
            codes, words, starts = split(text, " ")
            total = sums(memo(words)[codes], starts).astype(np.int64)
            n = np.diff(starts)
            none = pc.equal(pc.binary_length(batch.column(1).fill_null("")), 0).to_numpy(zero_copy_only=False)
            total[none], n = 0, np.where(none, 0, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(n)], ["doc_id", "n_tokens", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_words long")
