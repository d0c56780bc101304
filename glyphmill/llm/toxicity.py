"""Operator 5: toxicity scores from subword-bag embeddings.

A word is the bag of its character n-grams and itself, each hashed to a row of
one embedding table.  A text is the mean of its words, a repeated word
weighing little more than once (``POWER``), with ``NEUTRAL`` neutral words
added; a linear softmax reads that mean.  Table and softmax are trained jointly
in numpy on a bounded sample of labelled rows (Adam on batches of texts), so a
misspelling that was never seen shares n-gram vectors with the words it
imitates.  The sample, at most ``SAMPLE_ROWS`` rows of a class and
``SAMPLE_BYTES`` of text, is trained in one task, so neither texts nor training
take the driver's memory; the driver gets one float a bucket.

Scoring a text needs one number for each word: the mean over the word's rows
of the row's projection on the softmax's direction.  That vector of
projections (one float a bucket) is all that workers receive.

Defined cases: a null text counts as empty; a text without words scores by
the bias alone; a null id is never held out and never trained on; labels that
are null are no labels, repeated labels of a document count once (the larger);
with one class or no labels the score is the smoothed share of label 1 (0.5
without labels); very long texts are scored and trained on whole, and
where texts fill a class's half of ``SAMPLE_BYTES`` fewer rows are trained on, in
the order of a hash; a text that a document has several times counts once; scores don't depend on
other rows, so ties and repeated rows score alike; an empty table gives no
rows; other columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Memo, bounded_batches, distinct, grams, kept, plain, slices, split, word_hash

BUCKETS = 1 << 17
ORDERS = (3, 4, 5)
DIM = 8
#: The fit sees about so many rows of each class at most.
SAMPLE_ROWS = 1_500
#: Bytes of text of the sample at most, half of it for each class.
SAMPLE_BYTES = 256 << 20
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 100, 0.3, 3e-6, 7
#: Words without any leaning that are added to each mean, so that a few odd words don't decide short texts.
NEUTRAL = 30
#: A word that comes n times weighs 1 + POWER * ln n.
POWER = 0.3
#: Texts of the sample that must use a row of the table before it is trained, whatever the sample's size; steps of the fit at least.
LEAST, STEPS = 2, 240
#: A row that n texts use counts n / (n + SHRINK): rare rows say something, but less, so that noise doesn't add up.  Chosen on four folds of the training rows.
SHRINK = 3


@dataclass
class Model:
    """``projection`` of each bucket on the softmax's direction, and ``bias``."""

    projection: np.ndarray
    bias: float
    key: str


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bucket of every n-gram of the words, and of the words themselves."""
    parts = [grams(words, n) for n in ORDERS]
    parts.append((np.arange(len(words)), word_hash(words, 1)))
    return np.concatenate([w for w, _ in parts]).astype(np.int32), (np.concatenate([h for _, h in parts]) % np.uint64(BUCKETS)).astype(np.int32)


def word_projection(model: Model, tokens: list[str]) -> np.ndarray:
    """(projection, 40-bit name of the word) of each token; the name is -1 for tokens that are no words."""
    words = [plain(t) for t in tokens]
    out = np.zeros((len(words), 2))
    out[:, 1] = -1
    is_word = np.fromiter(map(bool, words), bool, len(words))
    real = [w for w in words if w]
    if real:
        of, bucket = features(real)
        n = np.bincount(of, minlength=len(real))
        out[is_word, 0] = np.bincount(of, model.projection[bucket], len(real)) / n
        out[is_word, 1] = (word_hash(real, 9) >> np.uint64(24)).astype(np.float64)
    return out


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> tuple[DataFrame, float]:
    """Texts and labels (text, toxic) of the sample, of each class about ``rows`` rows, by a hash of the id; and the share of label 1 among all labels.

    The labels that are picked are bounded by ``rows``, so they are broadcast.
    """
    label = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in label.groupBy("toxic").count().collect()}  # two rows at most
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    rate = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, rows / n))) for k, n in counts.items()], F.lit(0.0))
    picked = label.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < rate * 1_000_000)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sample = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    # in the order of a hash, until a class has its share of the bytes; its first text is taken whatever its size
    named = sample.withColumn("digest", F.sha2("text", 256))
    sizes = named.groupBy("doc_id", "digest").agg(F.max("toxic").alias("toxic"), F.max(F.octet_length("text").cast("long")).alias("size"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumns({"upto": F.sum("size").over(before), "nth": F.count(F.lit(1)).over(before)})
    taken = placed.where((F.col("nth") == 1) | (F.col("upto") <= SAMPLE_BYTES // 2) & (F.col("nth") <= 2 * rows)).select("doc_id", "digest")
    return named.join(F.broadcast(taken), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).drop("digest"), share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Train on a sample of the labelled rows that aren't held out, in one task."""
    bounded_batches(docs.sparkSession)
    sample, share = _training_rows(docs, labels, id_col, text_col, rows)
    # halfway, in log odds, between the labels' own share of label 1 and an even one
    odds = (share / (1 - share)) ** 0.5 if 0 < share < 1 else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        text = pa.concat_arrays([b.column(0) for b in held]) if held else pa.array([], pa.string())
        toxic = np.concatenate([b.column(1).to_numpy() for b in held]) if held else np.empty(0)
        model = train(text, toxic, odds / (1 + odds))
        yield pa.RecordBatch.from_arrays([pa.array([model.projection.tobytes()], pa.binary()), pa.array([model.bias])], ["projection", "bias"])

    # the sample is bounded; its order is that of ids and texts, however it arrives
    one = sample.repartition(1).sortWithinPartitions("doc_id", "text").select("text", F.col("toxic").cast("int").alias("toxic"))
    got = one.mapInArrow(run, "projection binary, bias double").first()
    untrained = train(pa.array([], pa.string()), np.empty(0))
    return untrained if got is None else replace(untrained, projection=np.frombuffer(got["projection"], np.float32), bias=got["bias"])


def _rows(first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Positions of the runs of some words, one after the other; ``first`` is where each word's run starts."""
    size = first[held + 1] - first[held]
    return np.arange(size.sum()) + np.repeat(first[held] - (np.cumsum(size) - size), size)


def train(text: pa.Array, toxic: np.ndarray, prior: float | None = None) -> Model:
    """Train on texts in memory; ``prior`` is the share of label 1 that the sample stands for."""
    y = (toxic > 0).astype(np.float64)
    key = f"toxicity {uuid.uuid4().hex}"
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))), key)
    codes, tokens, starts = split(text)
    words, inverse = distinct([plain(t) for t in tokens])
    del tokens
    doc = np.repeat(np.arange(len(y)), np.diff(starts))
    # one entry for each (document, word), weighted by its share of the document's words
    pair, n = np.unique(doc * len(words) + inverse[codes], return_counts=True)
    doc, word = pair // len(words), pair % len(words)
    real = np.array([bool(w) for w in words])[word]
    doc, word, n = doc[real], word[real], n[real].astype(np.float64)
    n = 1 + POWER * np.log(n)
    share = n / (NEUTRAL + np.bincount(doc, n, len(y)))[doc]
    # rows of the table of each word, one word after the other
    parts, sizes = [], []
    for k in range(0, len(words), 20_000):
        of, row = features(words[k : k + 20_000])
        parts.append(row[np.argsort(of, kind="stable")])
        sizes.append(np.bincount(of, minlength=len(words[k : k + 20_000])))
    bucket, size = np.concatenate(parts), np.concatenate(sizes)
    del parts, words
    each, first = 1 / size, np.concatenate([[0], np.cumsum(size)])
    # rows of the table that a single training text uses stay zero: they can't be told from its name
    by_text = np.zeros(BUCKETS, np.int64)
    for held in np.split(word, np.searchsorted(doc, np.arange(1, len(y)))):
        if len(held):
            by_text[np.unique(bucket[_rows(first, held)])] += 1
    used = np.flatnonzero(by_text >= LEAST)
    enough = (by_text >= LEAST)[bucket]
    first = np.concatenate([[0], np.cumsum(enough)])[first]
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    bucket = place[bucket[enough]]
    trust = by_text[used] / (by_text[used] + SHRINK)
    # texts in a random order, so that a batch of them is a run of entries, and words by their runs of rows
    rng = np.random.default_rng(SEED)
    place = rng.permutation(len(y))
    order = np.argsort(place[doc], kind="stable")
    doc, word, share = place[doc][order], word[order], share[order]
    label = np.empty(len(y))
    label[place] = y
    table, out, bias = rng.normal(0, 0.1, (DIM, len(used))), rng.normal(0, 0.5, DIM), 0.0
    state = [[np.zeros_like(table), np.zeros_like(table)], [np.zeros(DIM), np.zeros(DIM)], [0.0, 0.0]]
    share_1 = label.mean() if prior is None else prior
    weight = np.where(label > 0, share_1 / label.mean(), (1 - share_1) / (1 - label.mean()))
    batches = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    steps, step = epochs * batches, 0
    for start in [k for _ in range(epochs) for k in range(0, len(y), BATCH)]:
        step += 1
        end = min(start + BATCH, len(y))
        i, j = np.searchsorted(doc, [start, end])
        held, at = np.unique(word[i:j], return_inverse=True)
        size = first[held + 1] - first[held]
        mine, b, e = np.repeat(np.arange(len(held)), size), bucket[_rows(first, held)], np.repeat(each[held], size)
        e = e * trust[b]
        text_of, s, n_words, n_texts = doc[i:j] - start, share[i:j], len(held), end - start
        mean = np.stack([np.bincount(text_of, s * np.bincount(mine, e * row[b], n_words)[at], n_texts) for row in table])
        # a softmax over two classes has one free direction, ``out``
        error = (1 / (1 + np.exp(-np.clip(out @ mean + bias, -60, 60))) - label[start:end]) * weight[start:end] / n_texts
        by_word = np.bincount(at, s * error[text_of], n_words)
        by_bucket = np.bincount(b, e * by_word[mine], len(used))
        rate = RATE * (1 - (step - 1) / steps)
        for k, grad in enumerate((np.outer(out, by_bucket) + DECAY * table, mean @ error, error.sum())):
            m, v = state[k]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            state[k] = [m, v]
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            if k == 0:
                table = table - move
            elif k == 1:
                out = out - move
            else:
                bias = bias - move
    projection = np.zeros(BUCKETS, np.float32)
    projection[used] = trust * (out @ table)
    return Model(projection, float(bias), key)


def means(memo: Memo, text: pa.Array) -> np.ndarray:
    """Mean projection of the words of each text."""
    codes, tokens, starts = split(text)
    values = memo(tokens)
    # tokens that differ by case or punctuation only are one word
    word = values[:, 1].astype(np.int64)
    pair = np.repeat(np.arange(len(text)), np.diff(starts)) * np.int64(1 << 40) + word[codes]
    order = np.argsort(pair[word[codes] >= 0])
    pair, value = pair[word[codes] >= 0][order], values[codes, 0][word[codes] >= 0][order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    weight = 1 + POWER * np.log(np.diff(np.append(first, len(pair))))
    doc = pair[first] >> 40
    return np.bincount(doc, weight * value[first], len(text)) / (NEUTRAL + np.bincount(doc, weight, len(text)))


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """All columns of ``docs`` under the names k0, k1 ..., with the score of the text; no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    head = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)], F.col(f"`{text_col}`").cast("string").alias("read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        memo = kept(m.key, lambda: Memo(lambda tokens: word_projection(m, tokens)))
        for batch, text in slices(batches, "read"):
            p = 1 / (1 + np.exp(-np.clip(means(memo, text) + m.bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "score"])

    return head.mapInArrow(run, T.StructType([*head.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) of every whole text; no shuffle."""
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _scored(two, model, "text").select(F.col("k0").alias("doc_id"), "score")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    return _scored(docs, model, text_col).where(F.col("score") < threshold).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
