"""Operator 9: token ids in Parquet list columns.

``encode`` tokenises whole texts, ``write`` lays the id lists out in ascending
document order, ``read`` brings rows back, by range of documents if asked.

Layout, for selective reads: a file for each range of documents, about
``FILE_BYTES`` of text each and ``MOST_FILES`` at most, so that one shuffle
reaches them all whatever the corpus; the id lists dictionary encoded (a vocabulary fits one dictionary page) with delta packing
where a dictionary overflows; document ids and lengths delta packed in columns
of their own, so metadata is read without tokens; small pages with page
indexes, so a range of documents reads only its own pages.

Encoding with a memo is exact.  A byte-level BPE pre-tokenizer never joins
characters across a single space that stands between two characters that
aren't white space, since the space can only start a new pre-token there.
Texts are cut before such spaces, each distinct piece is encoded once by the
tokenizers library, and ids are concatenated.  Texts where a space touches
other white space, or that hold an added token of the vocabulary, are encoded
whole.  So ids are those of ``Tokenizer.encode`` with its own settings; a
literal ``<|endoftext|>`` in a text becomes the added token's id.

Defined cases: null text counts as empty; an empty text has only the end id;
very long texts are encoded whole and are one row; a null id sorts first;
repeated rows and equal ids are all kept, ordered by a hash of their texts, by
which an id (or none) of many rows is dealt to several files; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, kept, scratch, single_threaded, slices, split

END_ID = 2
#: Bytes of text of a file, and files at most.
FILE_BYTES, MOST_FILES = 64 << 20, 16_384
#: Layout of the Parquet files: bytes of a row group and a page, rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 8 << 20, 256 << 10, 512

def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Pieces encoded in one call, joined; each starts at a place where a pre-token must start.
_JOINED = 100


class _Pieces:
    """Ids of distinct pieces as runs of one flat array; up to ``limit`` pieces are kept in a worker process."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that the library finds in a text before all else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.model._resize_cache(0)  # its own cache holds frequent words, which never come here twice
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of text that an id stands for; the alphabet has a character for each byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.limit, self.at = limit, {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of pieces that start with a single space and then no white space.

        Joined, they are encoded as they would be alone; bytes tell them apart.
        """
        ids = self._encode(["".join(pieces[i : i + _JOINED]) for i in range(0, len(pieces), _JOINED)])
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        upto = np.searchsorted(np.cumsum(self.bytes_of[flat]), ends, "left") + 1
        return flat, np.diff(upto, prepend=0)

    def __call__(self, spaced: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where the run of each piece starts and how long it is: spaced pieces, then other texts."""
        get = self.at.get
        at = np.fromiter((get(p, -1) for p in spaced), np.int64, len(spaced))
        missing = np.flatnonzero(at < 0)
        new = [spaced[i] for i in missing]
        flat, lengths = self._spaced(new)
        keep = min(len(new), self.limit - len(self.at))
        if keep > 0:
            base = len(self.at)
            self.at.update(zip(new[:keep], range(base, base + keep)))
            self.flat = np.concatenate([self.flat, flat[: int(lengths[:keep].sum())]])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths[:keep])])
        whole = self._encode(other)
        whole_lengths = np.fromiter(map(len, whole), np.int64, len(whole))
        known = at >= 0
        first, size = np.empty(len(spaced), np.int64), np.empty(len(spaced), np.int64)
        first[known], size[known] = self.starts[at[known]], self.starts[at[known] + 1] - self.starts[at[known]]
        first[missing], size[missing] = len(self.flat) + np.cumsum(lengths) - lengths, lengths
        base = len(self.flat) + len(flat)
        return np.concatenate([self.flat, flat, *whole]), np.concatenate([first, base + np.cumsum(whole_lengths) - whole_lengths]), np.concatenate([size, whole_lengths])


def _runs(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start at ``first``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)]


def encode_array(text: pa.Array, pieces: _Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each text's ids start (one more than texts)."""
    odd = pc.match_substring_regex(text, "^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}] | [\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]| $").to_numpy(zero_copy_only=False)
    for token in pieces.added:
        odd = odd | pc.match_substring(text, token).to_numpy(zero_copy_only=False)
    # a space before the text keeps its first piece like the others; its ids are made apart
    even = pc.if_else(pa.array(odd), "", text)
    codes, tokens, starts = split(even, " ")
    head = np.zeros(len(codes), bool)
    head[starts[:-1]] = True
    bare, inverse = np.unique(codes[head], return_inverse=True)
    spaced = [" " + t if t else " ." for t in tokens]  # an empty token is only ever the first of an empty text
    put_aside = pc.filter(text, pa.array(odd)).to_pylist()
    flat, first, lengths = pieces(spaced, [tokens[i] for i in bare] + put_aside)
    row = codes.astype(np.int64)
    row[head] = len(spaced) + inverse
    row[starts[:-1][odd]] = len(spaced) + len(bare) + np.arange(len(put_aside))
    size = lengths[row]
    total = np.concatenate([[0], np.cumsum(size)])
    return _runs(flat, first[row], size), total[starts]


def parts_of(known: np.ndarray, tie: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The file of each (id, tie) for sorted ``edges``, in ascending order of both; an id that is several edges has as many files, by ranges of ties."""
    low, high = np.searchsorted(edges, known, "left"), np.searchsorted(edges, known, "right")
    share = (tie.astype(np.float64) + 2.0**63) / 2.0**64
    files = np.maximum(high - low, 1)
    return np.where(high - low > 1, low + 1 + np.minimum((share * files).astype(np.int64), files - 1), high).astype(np.int32)


#: Stands for a null id, below all others.
NONE = -(2**63)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, edges: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, part, n_tokens, tie, ids): the ids of each whole text and the end id.

    ``edges`` are document ids where files begin, as ``cut_points`` gives them;
    ``tie`` is a hash of the text that orders rows with equal ids of documents.
    """
    path, at = vocabulary or default_vocabulary(), np.asarray(edges or [], np.int64)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        pieces = kept(f"pieces {path}", lambda: _Pieces(path))
        for batch, text in slices(batches, "text"):
            ids, starts = encode_array(text, pieces)
            ids = np.insert(ids, starts[1:], end_id).astype(np.int32)
            starts = starts + np.arange(len(text) + 1)
            doc, tie = batch.column(0), batch.column(1)
            known = np.where(doc.is_null().to_numpy(zero_copy_only=False), NONE, np.maximum(pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), NONE + 1))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(parts_of(known, tie.to_numpy(), at)), pa.array(np.diff(starts)), tie, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))],
                ["doc_id", "part", "n_tokens", "tie", "ids"],
            )

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, "doc_id long, part int, n_tokens long, tie long, ids array<int>")


def cut_points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> list[int]:
    """Ids where the files after the first begin, in order, each as often as files begin in its rows; ``NONE`` for null ids."""
    ids = F.col(f"`{id_col}`").cast("long")
    n, nulls, size = docs.select(F.count(F.lit(1)), F.count(F.when(ids.isNull(), 1)), F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()
    files = min(MOST_FILES, math.ceil((size or 0) / file_bytes), n)
    if files < 2:
        return []
    of_null = round(nulls * files / n)
    rest = files - of_null
    at = [k / rest for k in range(1, rest)]
    found = docs.select(F.percentile_approx(ids, F.lit(at), F.lit(max(10_000, 20 * files)))).first()[0] if at else []
    return [NONE] * of_null + sorted(found or [])


def write(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES, encoding: str = "dictionary") -> None:
    """Encode whole texts and write a file for each range of documents, in ascending order.

    The lists are shuffled once, straight to the file they belong to.
    ``encoding``: of the id lists, dictionary or delta.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r} is neither dictionary nor delta")
    edges = cut_points(docs, id_col, text_col, file_bytes)
    (
        encode(docs, vocabulary, id_col, text_col, end_id, edges)
        .repartitionById(len(edges) + 1, F.col("part"))
        .sortWithinPartitions("doc_id", "tie")
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read(spark, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of a written folder; a range of documents prunes files, row groups and pages."""
    df = spark.read.schema("doc_id long, part int, n_tokens long, tie long, ids array<int>").parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def digests(store: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of a store that was read back.

    A part's rows are few by construction, so running sums stay within parts;
    the offsets of parts are sums over one narrow column.
    """
    bounded_batches(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "tie", "n_tokens", "ids_crc32"])

    rows = store.select("doc_id", "part", "tie", "ids").mapInArrow(run, "doc_id long, part int, tie long, n_tokens long, ids_crc32 long")
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("part").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("inside", F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .join(F.broadcast(before), "part")  # a row for each file
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def store_and_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and return the digests of what was read back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, vocabulary)
    return digests(read(spark, path))
