"""Helpers shared by the training-data operators.

Text work in Python goes through three steps that keep every per-word cost in
native code: an Arrow kernel splits a batch of texts, dictionary encoding
reduces it to distinct tokens, and a bounded per-worker memo maps each
distinct token to numbers.  What remains per word is one integer gather.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text one worker handles at once; bounds a worker's memory.
SLICE_BYTES = 6 << 20
#: Rows and bytes of an Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the dataset in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to these bounds, so that long texts can't fill a Python worker; lower ones stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: Paths that ``scratch`` gave out inside ``scoped``.
_SCOPES: list[list[str]] = []
#: Folders of applications whose session names none, or that ``rooted`` names.
_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, one machine) gets a local folder,
    the same for the whole application; on a cluster that is an error, as
    executors don't share local folders.  The setting itself is only read.
    """
    app = spark.sparkContext.applicationId
    named = _ROOTS.get(app) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    return f"{named.rstrip('/')}/glyphmill/{app}"


@contextmanager
def rooted(spark: SparkSession, path: str) -> Iterator[None]:
    """Keep tables made inside under ``path``, a folder that the driver and all executors share."""
    app = spark.sparkContext.applicationId
    before = _ROOTS.get(app)
    _ROOTS[app] = path
    try:
        yield
    finally:
        if before is None:
            del _ROOTS[app]
        else:
            _ROOTS[app] = before


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads; nothing happens where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Delete the tables made inside at the end, where results that read them have been written elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder, at a new path or the given one.

    The files survive lost executors, and later passes read only the columns
    they need.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a number for each row, written once: scans of one table may be split otherwise, and numbers made in each would differ."""
    return materialise(df.withColumn(column, F.monotonically_increasing_id()), "numbered")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(big: DataFrame, small: DataFrame, key: str, rows: str, total: int, share: float = 1e-3) -> DataFrame:
    """``big`` joined with the one row that ``small`` has for each of its keys, without hot tasks.

    The column ``rows`` of ``small`` counts a key's rows in ``big``, ``total``
    all of them.  Keys of more than ``share`` of the rows, at most 1 / share
    of them, are broadcast; all others are shuffled.
    """
    bar = max(1, int(total * share))
    hot = small.where(F.col(rows) > bar)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col(rows) <= bar), key)
    return big.join(F.broadcast(hot), key).unionByName(rest)


def purge(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder."""
    delete(spark, root(spark))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with about ``SLICE_BYTES`` of text each, and that text with nulls as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        text = pc.fill_null(text, "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at), pa.concat_arrays([text.slice(at, to - at)])
            at = to
    pa.default_memory_pool().release_unused()


def split(text: pa.Array, pattern: str | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of the tokens of all texts, the distinct tokens, and where each text's codes start (one more than texts).

    ``pattern`` None splits at white space, else at the literal pattern.
    Empty tokens at the ends are kept; callers give them no weight.
    """
    parts = pc.utf8_split_whitespace(text) if pattern is None else pc.split_pattern(text, pattern)
    starts = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), starts - starts[0]


def distinct(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words as they come, and the number of each word among them."""
    ids: dict[str, int] = {}
    inverse = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    return list(ids), inverse


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each of the runs that ``starts`` delimits; empty runs give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


class Memo:
    """Values of distinct tokens, kept between the tasks of one worker process.

    ``make`` turns a list of tokens into an array with a row for each.  At
    most ``limit`` tokens are kept; the first to come are mostly the frequent
    ones, and the values of later ones are made again when needed.  So memory
    is bounded whatever the vocabulary.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 300_000):
        self.make, self.limit, self.ids, self.rows = make, limit, {}, None

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if not tokens:
            return self.make([])
        get = self.ids.get
        at = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.rows[at]
        new = [tokens[i] for i in missing]
        made = self.make(new)
        base = len(self.ids)
        keep = min(len(new), self.limit - base)
        if keep > 0:
            if self.rows is None or base + keep > len(self.rows):
                rows = np.empty((min(self.limit, max(2 * (base + keep), 1024)), *made.shape[1:]), made.dtype)
                if base:
                    rows[:base] = self.rows[:base]
                self.rows = rows
            self.rows[base : base + keep] = made[:keep]
            self.ids.update(zip(new[:keep], range(base, base + keep)))
        out = np.empty((len(tokens), *made.shape[1:]), made.dtype)
        known = at >= 0
        if base:
            out[known] = self.rows[at[known]]
        out[missing] = made
        return out


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a worker process for each ``key``; only the last key is kept, so that the steps of a pipeline don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each character n-gram of ``<word>``: the word's index and a 64-bit hash."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    if len(chars) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(len(chars) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[k : len(chars) - n + 1 + k] + np.uint64(1)
    inside = of[: len(h)] == of[n - 1 :]
    return of[: len(h)][inside], mix64(h[inside])


def word_hash(words: list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word that is the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(chars)) - np.repeat(starts, lengths)).astype(np.uint64)
    each = mix64((chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (place + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    return mix64(total[starts + lengths] - total[starts] + lengths.astype(np.uint64) + np.uint64(seed))


#: Characters that a word loses at its ends.
EDGES = " \t\r\n.,;:!?\"'()[]{}<>«»„“”‘’¿¡…·|/\\*_~`^=+#&%$@-–—"


def plain(word: str) -> str:
    """A token in lower case without punctuation at its ends; may be empty."""
    return word.lower().strip(EDGES)


def single_threaded() -> None:
    """Keep a worker's libraries to the one core that Spark gave its task."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
