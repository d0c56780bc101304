"""Operator 2: language identification, words first, n-grams for unseen words.

A word that training has seen scores its log frequency in each language.  A
word that it hasn't falls back to its character n-grams of order 5 (with word
ends), then 4, and so on to 1: the longest order of which any n-gram is known
decides, by the mean log frequency of the known ones.  A text's scores are
sums over all its words; their softmax over languages is the score.

Learned from every text that has a language and isn't held out, whole.  Words are
counted by language where the texts are; n-grams are counted from the counted
words, of which the ``WORDS`` most frequent are taken (words of equal frequency
together or not at all), so that this work and the tables don't grow with the
corpus.  A table holds the most frequent entries, ``CELLS`` numbers at most; the
driver and the tasks hold only tables.  The ``LANGS`` most frequent languages are
learned.

Defined cases: null text, or text without a letter: ``und``, score 0; ties go
to the language that sorts first; no learnable row: everything is ``und``; a
null id is never held out; repeated rows count as often as they are there and are
predicted alike; very long texts are read whole; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Memo, bounded_batches, distinct, grams, kept, materialise, plain, scoped, slices, split, sums, word_hash

#: Words whose n-grams are counted, numbers in a table, and languages, at most.
WORDS, CELLS, LANGS = 1_000_000, 1_000_000, 200
#: Counted words whose n-grams are added up at once.
BLOCK = 100_000
ORDERS = (5, 4, 3, 2, 1)
LEAST = 2


@dataclass
class Model:
    """For words (order 0) and each n-gram order: sorted hashes and a row of log frequencies for each."""

    langs: list[str]
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    key: str = ""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _frequent(rows: DataFrame, total: Column, most: int, *by: str) -> DataFrame:
    """The rows of each key ``by`` with the greatest totals, as many whole steps of an eighth of a doubling as hold ``most`` rows at most; of a first step that holds more, about so many by a hash."""
    step = F.floor(F.log2(total) * 8).cast("int")
    found = rows.groupBy(*by, step.alias("step")).count().collect()  # some hundred steps a key
    bars: dict[tuple, int] = {}
    held: dict[tuple, int] = {}
    part: dict[tuple, float] = {}
    for r in sorted(found, key=lambda r: -r["step"]):
        key = tuple(r[c] for c in by)
        held[key] = held.get(key, 0) + r["count"]
        if held[key] <= most or key not in bars:
            bars[key] = r["step"]
            part[key] = most / held[key]
    keep = F.lit(False)
    for key, bar in bars.items():
        here = step >= bar
        for c, v in zip(by, key):
            here = here & (F.col(c) == v)
        if part[key] < 1:
            here = here & (F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(1 << 20)) < int(part[key] * (1 << 20)))
        keep = keep | here
    return rows.where(keep)


def _counted(base: DataFrame, langs: list[str]) -> DataFrame:
    """Rows (word, c0, c1, ...): how often each word with a letter stands in the texts of each language."""
    k, number = len(langs), {x: i for i, x in enumerate(langs)}
    columns = [f"c{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, "text"):
            of = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            codes, tokens, starts = split(text)
            lang = np.repeat(of, np.diff(starts))
            real = lang >= 0
            by_token = np.bincount(codes[real].astype(np.int64) * k + lang[real], minlength=len(tokens) * k).reshape(-1, k)
            words, inverse = distinct([plain(t) for t in tokens])
            n = np.stack([np.bincount(inverse, by_token[:, i], len(words)) for i in range(k)], axis=1).astype(np.int64)
            some = np.flatnonzero(n.any(axis=1) & np.fromiter((any(c.isalpha() for c in w) for w in words), bool, len(words)))
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.string()), *(pa.array(n[some, i]) for i in range(k))], ["word", *columns])

    rows = base.select("text", "lang").mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in columns))
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])


def _entries(words: DataFrame, k: int) -> DataFrame:
    """Rows (ord, h, c0, c1, ...): counts of the words (order 0) and of their n-grams, by hash."""
    columns = [f"c{i}" for i in range(k)]

    def of_block(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [w for b in block for w in b.column(0).to_pylist()]
        n = np.stack([np.concatenate([b.column(1 + i).to_numpy() for b in block]) for i in range(k)], axis=1)
        for order in (0, *ORDERS):
            of, h = grams(texts, order) if order else (np.arange(len(texts)), word_hash(texts))
            known, at = np.unique(h, return_inverse=True)
            total = [pa.array(np.bincount(at, n[of, i], len(known)).astype(np.int64)) for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), order, np.int32)), pa.array(known.view(np.int64)), *total], ["ord", "h", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                block.append(batch)
            if sum(b.num_rows for b in block) >= BLOCK:
                yield from of_block(block)
                block = []
        if block:
            yield from of_block(block)

    return words.mapInArrow(run, "ord int, h long, " + ", ".join(f"{c} long" for c in columns)).groupBy("ord", "h").agg(*[F.sum(c).alias(c) for c in columns])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = base.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    model = Model(sorted((r["lang"] for r in counts), key=lambda x: x.encode()), key=f"lang {uuid.uuid4().hex}")
    if not counts:
        return model
    k = len(model.langs)
    total = functools.reduce(operator.add, [F.col(f"c{i}") for i in range(k)])
    with scoped(spark):
        words = materialise(_counted(base, model.langs), "words")
        entries = materialise(_entries(_frequent(words, total, WORDS), k), "entries")
        sums_ = {r["ord"]: np.array(r[1:], np.float64) for r in entries.groupBy("ord").agg(*[F.sum(f"c{i}") for i in range(k)]).collect()}
        kept_ = _frequent(entries.where(total >= LEAST), total, CELLS // k, "ord").toArrow()
    orders, h = kept_["ord"].to_numpy(), kept_["h"].to_numpy().view(np.uint64)
    n = np.stack([kept_[f"c{i}"].to_numpy() for i in range(k)], axis=1).astype(np.float64)
    for order, all_ in sums_.items():
        mine = np.flatnonzero(orders == order)
        mine = mine[np.argsort(h[mine])]
        model.hashes[order] = h[mine]
        # smoothed by half a count in each language
        model.logs[order] = np.log((n[mine] + 0.5) / (all_ + 0.5 * (len(mine) + 1)))
    return model


def word_scores(model: Model, tokens: list[str]) -> np.ndarray:
    """Log frequency of each token in each language, then 1 if the token has a letter."""
    k = len(model.langs)
    out = np.zeros((len(tokens), k + 1))
    words = [plain(t) for t in tokens]
    at = np.flatnonzero(np.fromiter((any(c.isalpha() for c in w) for w in words), bool, len(words)))
    real = [words[i] for i in at]
    scores, open_ = np.zeros((len(real), k)), np.ones(len(real), bool)

    def find(order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = model.hashes.get(order, np.empty(0, np.uint64))
        if not len(known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        p = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return p, known[p] == h

    if real and k:
        p, hit = find(0, word_hash(real))
        scores[hit] = model.logs[0][p[hit]] if hit.any() else 0
        open_ &= ~hit
        for order in ORDERS:
            left = np.flatnonzero(open_)
            if not len(left):
                break
            of, h = grams([real[i] for i in left], order)
            p, hit = find(order, h)
            if hit.any():
                n = np.bincount(of[hit], minlength=len(left))
                got = n > 0
                mean = np.stack([np.bincount(of[hit], model.logs[order][p[hit], i], len(left)) for i in range(k)], axis=1)[got] / n[got, None]
                scores[left[got]] = mean
                open_[left[got]] = False
    out[at, :k], out[at, k] = scores, 1
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of every whole text; no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.langs)
        names = np.array([*m.langs, "und"], dtype=object)
        memo = kept(m.key, lambda: Memo(lambda tokens: word_scores(m, tokens)))
        for batch, text in slices(batches, "text"):
            codes, tokens, starts = split(text)
            total = sums(memo(tokens)[codes], starts)
            best, score = np.full(len(text), k), np.zeros(len(text))
            if k:
                decided = total[:, k] > 0
                x = total[decided, :k]
                best[decided] = x.argmax(axis=1)
                score[decided] = 1 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
