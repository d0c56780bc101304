"""Operator 8: language-model scores by masked pseudo-likelihood.

A small bidirectional window network predicts every word of a text from the
two words on either side, with the word itself masked: position-wise
embeddings of the neighbours are added, squashed, and read by a two-step
softmax (a class of words, then the word in its class).  The sum of the
conditional log-probabilities over all words scores a text; their mean is
comparable between texts.

Everything comes from the whole corpus.  Word counts cover all words of all
texts; the most frequent words are symbols of the network, and all other words
share ``RARE`` symbols by a hash of their last two letters.  A word that shares
a symbol has the symbol's probability times its own within the symbol, which is
its count over the symbol's, from the table of all words' counts (Witten-Bell:
words that were never counted get the rest, by their characters).  The values
of up to ``HELD`` words travel to the workers, all others are joined by word,
which changes where a value is found and not the value.

Texts are split twice: to count words, and to write each text's symbols, two
bytes a word, in a table that training and scoring read.  Training sees every
position of every text once: each task trains in numpy from the same start on
the positions of its rows, and the models are averaged by the number of
positions they saw.  Sums of models are formed in two steps with constant
memory, first over groups of tasks, then over all.  What is gathered grows
with the input; what the driver holds is one model.

Defined cases: null, empty and wordless texts have 0 tokens and score 0; very
long texts are one row, and scored whole; of equally frequent words the first
by name is a symbol; repeated rows score alike; a null id is carried along; an
empty table gives no rows, a corpus without words an untrained model; other
columns, whatever their names, are ignored.  Probabilities of all words at a
place sum to at most 1.  Rerun on files that are split alike, scores agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Memo, bounded_batches, kept, materialise, plain, slices, split, sums, word_hash

CLASSES, IN_CLASS = 64, 64
SYMBOLS = CLASSES * IN_CLASS
RARE = 64
FREQUENT = SYMBOLS - RARE
#: Words beyond the frequent ones whose values workers hold; characters there are; units of a sum of logarithms, so that its order doesn't matter.
HELD, CHARACTERS, UNITS = 200_000, 0x110000, 1 << 30
#: Tokens that a task counts before it hands its counts on.
COUNTED = 500_000
OFFSETS = (-2, -1, 1, 2)
DIM = 16
BATCH, RATE, SEED = 8192, 3.0, 5
#: Floats of a row in which models travel; groups of tasks that are summed first.
BLOCK, GROUPS = 8192, 64

#: Parameters; the last of the DIM + 1 inputs of ``cls`` and ``word`` is always 1, so their last rows are biases.
SHAPES = {"embed": (len(OFFSETS), SYMBOLS + 1, DIM), "hidden": (DIM,), "cls": (DIM + 1, CLASSES), "word": (CLASSES, DIM + 1, IN_CLASS)}
#: A text ready for training and scoring: symbols of its words, two bytes each, the sum of what workers know within symbols, and the words that are to be joined.
ENCODED = "doc_id long, row long, symbols binary, inside double, words array<struct<name: long, new: float>>"


@dataclass
class Model:
    """``symbols`` of frequent words by rank, parameters by name, what tells the words of a symbol apart, how many positions were trained on, and the texts it was trained on, encoded."""

    symbols: dict[str, int]
    params: dict[str, np.ndarray]
    key: str
    within: Within
    seen: int = 0
    encoded: DataFrame | None = None


#: What is known of a token: its symbol (-1: no word), the hash of a word that is to be joined (else 0), its log-probability within the symbol, for joined words as if never counted.
TOKEN = np.dtype([("symbol", "i4"), ("name", "i8"), ("log_p", "f8")])


@dataclass
class Within:
    """Words of the ``RARE`` symbols: log-probabilities of ``held`` words, log share of words never counted by symbol, their characters' log-probabilities, and ``rest``, rows (name, log_p) of all others."""

    held: dict[str, float] = field(default_factory=dict)
    new: np.ndarray = field(default_factory=lambda: np.zeros(RARE))
    chars: np.ndarray = field(default_factory=lambda: np.full(1, -np.log(CHARACTERS + 1)))
    rest: DataFrame | None = None

    def sent(self) -> Within:
        """Without the rows, which stay a table."""
        return Within(self.held, self.new, self.chars)

    def tokens(self, symbols: dict[str, int], tokens: list[str]) -> np.ndarray:
        out = np.zeros(len(tokens), TOKEN)
        all_ = [plain(t) for t in tokens]
        out["symbol"] = symbol_of(symbols, all_)
        at = np.flatnonzero(out["symbol"] >= FREQUENT)
        words = [all_[i] for i in at]
        value = np.fromiter((self.held.get(w, np.nan) for w in words), np.float64, len(words))
        other = np.flatnonzero(np.isnan(value))
        if len(other):
            words = [words[i] for i in other]
            value[other] = self.new[out["symbol"][at[other]] - FREQUENT] + self.spelled(words)
            out["name"][at[other]] = names(words)
        out["log_p"][at] = value
        return out

    def spelled(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word's characters and its end; the last entry of ``chars`` is for unseen ones, the first for the end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        return sums(self.chars[np.minimum(codes, len(self.chars) - 1)], np.concatenate([[0], np.cumsum(lengths)])) + self.chars[0]


def names(words: list[str]) -> np.ndarray:
    """A hash of each word that is never 0."""
    return (word_hash(words, 11) | np.uint64(1)).view(np.int64)


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in SHAPES]).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n) over all words of all texts: counted in each task, then shuffled by word."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words are numbered as they come, and their counts leave when a task ends or holds ``COUNTED`` of them
        seen: dict[str, int] = {}
        words: dict[str, int] = {}
        total = np.zeros(0, np.int64)

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(total[: len(words)])], ["word", "n"])

        for _, text in slices(batches, "text"):
            codes, tokens, _ = split(text)
            get = seen.get
            at = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
            for i in np.flatnonzero(at < 0).tolist():
                seen[tokens[i]] = at[i] = words.setdefault(plain(tokens[i]), len(words))
            if len(words) > len(total):
                total = np.concatenate([total, np.zeros(max(len(words), 2 * len(total)) - len(total), np.int64)])
            total += np.bincount(at, np.bincount(codes, minlength=len(tokens)), len(total)).astype(np.int64)
            if len(seen) > COUNTED:
                yield counts()
                seen.clear()
                words.clear()
                total = np.zeros(0, np.int64)
        if words:
            yield counts()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").where(F.col("word") != "").groupBy("word").agg(F.sum("n").alias("n"))


def symbol_of(symbols: dict[str, int], words: list[str]) -> np.ndarray:
    """Symbol of each plain word, -1 for empty ones."""
    out = np.fromiter((symbols.get(w, -1) for w in words), np.int64, len(words))
    rare = [i for i, w in enumerate(words) if w and out[i] < 0]
    if rare:
        out[rare] = FREQUENT + (word_hash([words[i][-2:] for i in rare], 3) % np.uint64(RARE)).astype(np.int64)
    return out


def within(counted: DataFrame, symbols: dict[str, int]) -> Within:
    """Counts of all words that share symbols, by symbol, by word and by character; one narrow pass over the counted words and one over the rest."""
    spark = counted.sparkSession
    sent = spark.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            s = symbol_of(sent.value, words)
            at = np.flatnonzero(s >= FREQUENT)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(names([words[i] for i in at])), pa.array((s[at] - FREQUENT).astype(np.int32)), b.column(1).take(pa.array(at))], ["word", "name", "symbol", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHARACTERS + 1, np.int64)
        for b in batches:
            codes = np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.bincount(codes)
            total[1 : len(n) + 1] += n
            total[0] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rare = materialise(counted.mapInArrow(run, "word string, name long, symbol int, n long"), "rare")
    by_symbol = rare.groupBy("symbol").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    if not by_symbol:
        return Within()
    total, kinds = np.ones(RARE), np.ones(RARE)
    for r in by_symbol:
        total[r["symbol"]], kinds[r["symbol"]] = r["n"] + r["words"], r["words"]
    # words that were counted once or more are spelled as new ones will be
    by_char = rare.select("word").mapInArrow(spell, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = by_char["code"].to_numpy(), by_char["n"].to_numpy()
    chars = np.ones(code.max() + 2)
    chars[code] += n
    chars = np.log(chars / (n.sum() + CHARACTERS + 1))
    # the least count of which there are few enough words
    times = rare.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().sort_by([("n", "descending")])
    fit_in = np.flatnonzero(np.cumsum(times["words"].to_numpy()) <= HELD)
    bar = times["n"][int(fit_in[-1])].as_py() if len(fit_in) else times["n"][0].as_py() + 1
    top = rare.where(F.col("n") >= bar).select("word", "symbol", "n").toArrow()
    held = dict(zip(top["word"].to_pylist(), np.log(top["n"].to_numpy() / total[top["symbol"].to_numpy()]).tolist()))
    logs = F.element_at(F.array(*[F.lit(float(x)) for x in np.log(total)]), F.col("symbol") + 1)
    rest = rare.where(F.col("n") < bar).groupBy("name").agg(F.sum("n").alias("n"), F.min("symbol").alias("symbol")).select("name", (F.log("n") - logs).alias("log_p"))
    return Within(held, np.log(kinds / total), chars, rest)


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Untrained parameters whose biases already give the unigram distribution of ``counts`` by symbol."""
    rng = np.random.default_rng(SEED)
    p = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    for k, scale in (("embed", 0.1), ("cls", 0.1), ("word", 0.1)):
        p[k] = rng.normal(0, scale, SHAPES[k]).astype(np.float32)
    by_class = (counts + 0.5).reshape(CLASSES, IN_CLASS)
    p["cls"][-1] = np.log(by_class.sum(axis=1) / by_class.sum())
    p["word"][:, -1] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return p


def windows(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Neighbours of every position; SYMBOLS where the text has none."""
    n = len(symbols)
    out = np.full((len(OFFSETS), n), SYMBOLS, np.uint16)
    for k, d in enumerate(OFFSETS):
        a, b = max(0, -d), min(n, n - d)
        if a < b:
            same = doc[a + d : b + d] == doc[a:b]
            out[k, a:b][same] = symbols[a + d : b + d][same]
    return out


def _level(x: np.ndarray, weights: np.ndarray) -> None:
    """Shift rows by their largest value, in place, where powers of e might leave the range of floats otherwise; inputs are at most 1, which bounds what weights give."""
    if np.abs(weights).sum(axis=-2).max() > 60:
        x -= x.max(axis=1, keepdims=True)


def _add_up(x: np.ndarray) -> np.ndarray:
    """Sum of each row; a product is faster than a sum over a short axis."""
    return x @ np.ones(x.shape[1], x.dtype)


def _softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    _level(x, weights)
    np.exp(x, out=x)
    x *= (1 / _add_up(x))[:, None]
    return x


def _hidden(p: dict[str, np.ndarray], near: np.ndarray) -> np.ndarray:
    """The inputs of both steps: squashed sums of neighbours, and 1."""
    total = p["embed"][0].take(near[0], axis=0)
    for k in range(1, len(OFFSETS)):
        total += p["embed"][k].take(near[k], axis=0)
    total += p["hidden"]
    out = np.empty((len(total), DIM + 1), total.dtype)
    np.tanh(total, out=out[:, :DIM])
    out[:, DIM] = 1
    return out


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the positions by class, and (class, first, last + 1) of each class there."""
    cls = (target // IN_CLASS).astype(np.uint8)  # small numbers are sorted by their digits
    order = np.argsort(cls, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))]).tolist()
    return order, [(c, edges[c], edges[c + 1]) for c in range(CLASSES) if edges[c] < edges[c + 1]]


def _in_class(p: dict[str, np.ndarray], h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits of the words of each position's class, for positions ordered by class."""
    y = np.empty((len(h), IN_CLASS), h.dtype)
    for c, a, b in runs:
        np.matmul(h[a:b], p["word"][c], out=y[a:b])
    return y


def _log_softmax_at(x: np.ndarray, column: np.ndarray, weights: np.ndarray) -> np.ndarray:
    _level(x, weights)
    picked = x[np.arange(len(x)), column]
    np.exp(x, out=x)
    return picked - np.log(_add_up(x))


def log_probs(p: dict[str, np.ndarray], near: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of every target given its neighbours."""
    out = np.empty(len(target), np.float64)
    for a in range(0, len(target), BATCH):
        order, runs = _by_class(target[a : a + BATCH])
        order = order + a
        t = target[order]
        h = _hidden(p, near[:, order])
        out[order] = _log_softmax_at(h @ p["cls"], t // IN_CLASS, p["cls"]) + _log_softmax_at(_in_class(p, h, runs), t % IN_CLASS, p["word"])
    return out


def step(p: dict[str, np.ndarray], near: np.ndarray, target: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One step of stochastic gradient descent, in place, on the positions ``at``."""
    n = len(at)
    order, runs = _by_class(target[at])
    at = at[order]
    near, target = near[:, at], target[at]
    h = _hidden(p, near)
    place = np.arange(n)
    g = _softmax(h @ p["cls"], p["cls"])
    g[place, target // IN_CLASS] -= 1
    back = g @ p["cls"][:DIM].T
    y = _softmax(_in_class(p, h, runs), p["word"])
    y[place, target % IN_CLASS] -= 1
    p["cls"] -= (rate / n) * (h.T @ g)
    for c, a, b in runs:
        w = p["word"][c]
        back[a:b] += y[a:b] @ w[:DIM].T
        # a class moves by the mean over its own positions, so rare classes learn too
        w -= np.float32(rate / np.sqrt((b - a) * n)) * (h[a:b].T @ y[a:b])
    squashed = h[:, :DIM]
    back *= 1 - squashed * squashed
    p["hidden"] -= (rate / n) * (np.ones(n, np.float32) @ back)
    for k in range(len(OFFSETS)):
        order = np.argsort(near[k], kind="stable")
        symbol = near[k].take(order)
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        times = np.diff(first, append=n)
        move = np.add.reduceat(back.take(order, axis=0), first, axis=0)
        move *= (rate / np.sqrt(times * n)).astype(np.float32)[:, None]
        p["embed"][k][symbol[first]] -= move


def _known(symbols: dict[str, int], inside: Within, key: str, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is known of the distinct tokens, the token of every word, and the text each is in."""
    memo = kept(f"tokens {key}", lambda: Memo(lambda tokens: inside.tokens(symbols, tokens)))
    codes, tokens, starts = split(text)
    known = memo(tokens)
    doc = np.repeat(np.arange(len(text)), np.diff(starts))
    real = known["symbol"][codes] >= 0
    return known, codes[real], doc[real]


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``ENCODED`` of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.symbols, model.within.sent(), model.key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, inside, key = sent.value
        for batch, text in slices(batches, "text"):
            known, code, doc = _known(symbols, inside, key, text)
            small = known["symbol"].astype("<u2")[code]
            ends = np.searchsorted(doc, np.arange(len(text) + 1)).tolist()
            joined = known["name"][code] != 0
            log_p = known["log_p"][code]
            total = np.bincount(doc, np.where(joined, 0.0, log_p), len(text))
            starts = np.concatenate([[0], np.cumsum(np.bincount(doc[joined], minlength=len(text)))]).astype(np.int32)
            words = pa.StructArray.from_arrays([pa.array(known["name"][code[joined]]), pa.array(log_p[joined].astype(np.float32))], ["name", "new"])
            flat = [small[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.binary()), pa.array(total), pa.ListArray.from_arrays(pa.array(starts), words)], ["doc_id", "row", "symbols", "inside", "words"])

    numbered = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return numbered.mapInArrow(run, ENCODED)


def _positions(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words of a batch of encoded texts, the neighbours of each, and where texts start (one more than texts)."""
    n = (pc.binary_length(column).to_numpy(zero_copy_only=False) // 2).astype(np.int64)
    s = np.frombuffer(b"".join(column.to_pylist()), "<u2")
    return s, windows(s, np.repeat(np.arange(len(n)), n)), np.concatenate([[0], np.cumsum(n)])


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the models' rows (group, block, seen, values) by keys, in memory of one model a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for g, k, n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                x = np.frombuffer(v.as_buffer(), "<f8")
                got = total.setdefault((g if "group" in keys else 0, k), [0.0, 0.0])
                got[0] += n
                got[1] = got[1] + x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v[0] for v in total.values()], pa.float64()), pa.array([v[1].tobytes() for v in total.values()], pa.binary())], ["group", "block", "seen", "values"])

    return rows.repartition(*keys).mapInArrow(run, "group int, block int, seen double, values binary")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count all words, encode all texts, train in every task, average the models."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = materialise(word_counts(docs, text_col), "words")
    top = counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    symbols = {r["word"]: i for i, r in enumerate(top)}
    by_symbol = np.zeros(SYMBOLS)
    by_symbol[: len(top)] = [r["n"] for r in top]
    rest = (counted.agg(F.sum("n")).first()[0] or 0) - by_symbol.sum()
    by_symbol[FREQUENT:] = rest / RARE
    model = Model(symbols, start(by_symbol), f"lm {uuid.uuid4().hex}", within(counted, symbols))
    model.encoded = materialise(encode(docs, model, id_col, text_col), "encoded")
    sent = spark.sparkContext.broadcast(model.params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, seen = {k: v.copy() for k, v in sent.value.items()}, 0
        for batch in batches:
            s, near, _ = _positions(batch.column(0))
            # each step takes positions from all texts of the batch
            steps = -(-len(s) // BATCH)
            for k in range(steps):
                at = np.arange(k, len(s), steps)
                step(p, near, s, at, RATE / (1 + seen / 5e6))
                seen += len(at)
        if seen:
            flat = pack(p).astype("<f8") * seen
            parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([float(seen)] * n), pa.array(parts, pa.binary())], ["group", "block", "seen", "values"])

    trained = model.encoded.select("symbols").mapInArrow(run, "group int, block int, seen double, values binary")
    rows = _summed(_summed(trained, ["group", "block"]), ["block"]).orderBy("block").collect()
    if rows:
        model.params, model.seen = unpack(np.concatenate([np.frombuffer(r["values"], "<f8") / r["seen"] for r in rows])), int(rows[0]["seen"])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, log_prob, score) of every whole text: sum and mean of the words' log-probabilities."""
    return scored(materialise(encode(docs, model, id_col, text_col), "encoded"), model)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the texts that the model is trained on, which are encoded once."""
    model = fit(docs, id_col, text_col)
    return scored(model.encoded, model)


def scored(encoded: DataFrame, model: Model) -> DataFrame:
    """Scores of encoded texts.  Only words whose values the workers don't hold are shuffled, as numbers."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model.params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, near, starts = _positions(batch.column(2))
            total = sums(log_probs(sent.value, near, s), starts) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array(total)], ["doc_id", "row", "n_tokens", "log_prob"])

    each = encoded.select("doc_id", "row", "symbols", "inside").mapInArrow(run, "doc_id long, row long, n_tokens long, log_prob double")
    rest = model.within.rest if model.within.rest is not None else spark.createDataFrame([], "name long, log_p double")
    found = encoded.select("row", F.inline("words")).join(rest, "name", "left")
    more = found.groupBy("row").agg((F.sum(F.round(F.coalesce("log_p", F.col("new").cast("double")) * UNITS).cast("long")) / UNITS).alias("more"))
    whole = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    return each.join(more, "row", "left").select("doc_id", "n_tokens", whole.alias("log_prob"), (whole / F.greatest("n_tokens", F.lit(1))).alias("score"))
