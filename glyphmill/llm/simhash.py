"""Operator 13: near-duplicates by SimHash, linked through anchor points.

A text is lower-cased in A-Z, cut into words ``[^\\x20\\x09-\\x0D]+`` and
shingles of ``WIDTH`` words joined by one space, repeats included; fewer words
are one shingle, none give fingerprint zero.  A fingerprint bit is 1 if it is set
in more than half of the shingles' XXH64 (seed 42).  Fingerprints link at
``RADIUS`` or fewer differing bits; components are connected by such links.

Anchors.  The 64 bits are cut into parts, and two fingerprints within the radius
differ in at most ``radius // parts`` bits of one of them: that is the part's
threshold.  A part's anchors are the words of a covering code: perfect Hamming
codes of 7, 15 or 31 bits, which cover with radius one each, and single bits.  A
fingerprint's home is the anchor that it decodes to; it is replicated to every
anchor within covering radius plus threshold, blocks taken together: these are the
homes of all words within the threshold.  So the home of one of two near
fingerprints holds the other, and each anchor compares the fingerprints at home
there with all that came.  No near pair is missed, whatever the data.

Three parts (threshold 1) make some 40 rows a fingerprint, and one in 2,000
unrelated pairs meets; two parts (threshold 2) make some 400 rows, and one pair in
400,000 meets.  Past ``MANY`` fingerprints comparing would outweigh replicating,
and the latter is taken; both give the same links.

Links.  Equal fingerprints are one vertex.  Where a group of near copies shares
its anchors, comparing all pairs would be quadratic: first every fingerprint is
compared with one centre of each home it has, then with the centre of each anchor
it came to (the most frequent fingerprint, which in a group of copies is mostly
their original); links merge classes, and only pairs of different classes are
compared in full.  No link between classes is lost, and pairs within a class are
never made.  Keys that more than a thousandth of the rows share are broadcast
where rows meet the one row of their key, and all others are shuffled.

Defined cases: null, empty and wordless texts have fingerprint zero and link like
any other; very long texts are read in pieces, of whole words; a word without end
is a piece; ties have no part, as all links count; repeated rows and equal ids are
rows of one vertex; a null id is carried along and is no component's name unless
all its ids are null; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import beside, bounded_batches, materialise, slices
from glyphmill.llm.near_dedup import components

WIDTH, RADIUS, SEED = 4, 4, 42
#: Bytes of a text that are split at once, and shingles whose bits are counted at once.
PIECE, COUNTED = 1 << 20, 1 << 16
#: Fingerprints up to which three parts are used.
MANY = 20_000_000
#: Blocks of each part of the 64 bits: lengths of Hamming codes, 1 for single bits.
THREE = ((15, 1, 1, 1, 1, 1, 1), (15, 1, 1, 1, 1, 1, 1), (15, 7))
TWO = ((31, 1), (31, 1))
#: White space, which ends words.
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end at white space."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, min(at + PIECE, len(text)))
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def hashes(text: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in pieces."""
    digest, carried, any_ = xxhash.xxh64_intdigest, [], False
    for piece in _pieces(text):
        words = [*carried, *piece.lower().split()]  # of bytes: A-Z, and the six characters of white space
        carried = words[max(0, len(words) - width + 1) :]
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - width + 1
        any_ = True
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    if carried and not any_:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64 bits of a text."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes(text, width):
        n += len(h)
        for at in range(0, len(h), COUNTED):
            bits = np.unpackbits(h[at : at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, fp) from rows (doc_id, text); ``fp`` holds the 64 bits as a signed integer."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, "text"):
            out = np.fromiter((fingerprint(t.as_py(), width) for t in text.cast(pa.binary())), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def decoded(words: np.ndarray, blocks: tuple[int, ...]) -> np.ndarray:
    """The anchor of each word of a part: in each Hamming block the bit that the syndrome names is flipped."""
    out, at = words.copy(), 0
    for n in blocks:
        if n > 1:
            syndrome = np.zeros(words.shape, np.uint64)
            for k in range(n):
                syndrome ^= (words >> np.uint64(at + k) & np.uint64(1)) * np.uint64(k + 1)
            out ^= np.where(syndrome > 0, np.uint64(1) << (np.uint64(at) + np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        at += n
    return out


def anchors(fp: np.ndarray, parts: tuple[tuple[int, ...], ...], radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part: homes, and all anchors within covering radius plus threshold, a row for each fingerprint with -1 for repeats."""
    at = 0
    for number, blocks in enumerate(parts):
        size = sum(blocks)
        word = fp >> np.uint64(at) & np.uint64((1 << size) - 1)
        at += size
        flips = [0, *(sum(1 << b for b in bits) for e in range(1, radius // len(parts) + 1) for bits in combinations(range(size), e))]
        # a bit flipped in the word is its bit and its place in the syndrome; decoding is done for all flips at once
        near = np.sort(decoded(word[:, None] ^ np.array(flips, np.uint64), blocks), axis=1).astype(np.int64)
        name = np.int64(number) << np.int64(40)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1 - name
        yield decoded(word, blocks).astype(np.int64) + name, near + name


def dealt(vertices: DataFrame, parts: tuple[tuple[int, ...], ...], home: bool, radius: int = RADIUS) -> DataFrame:
    """Rows (anchor, fp) from rows (fp): each fingerprint at its homes, or at all anchors within covering radius plus threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for own, near in anchors(fp.view(np.uint64), parts, radius):
                if home:
                    yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0)], ["anchor", "fp"])
                    continue
                real = near >= 0
                yield pa.RecordBatch.from_arrays([pa.array(near[real]), pa.array(np.repeat(fp, real.sum(axis=1)))], ["anchor", "fp"])

    return vertices.select("fp").mapInArrow(run, "anchor long, fp long")


def _near(a: str, b: str, radius: int) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _joined(root: DataFrame | None, links: DataFrame) -> DataFrame:
    """Rows (v, root) after more links (a, b)."""
    if root is not None:
        links = links.unionAll(root.where(F.col("v") != F.col("root")).select(F.col("root").alias("a"), F.col("v").alias("b")))
    return components(links)


def linked(vertices: DataFrame, radius: int = RADIUS, parts: tuple[tuple[int, ...], ...] | None = None) -> DataFrame:
    """Rows (v, root) of all fingerprints that have links, from a written table (fp, n) without repeats."""
    parts = parts or (THREE if vertices.count() <= MANY else TWO)
    homes = materialise(dealt(vertices, parts, True, radius), "homes")
    # the centre of a home: its most frequent fingerprint
    weighed = homes.join(vertices.select("fp", "n").where(F.col("n") > 1), "fp", "left").withColumn("w", F.struct(-F.coalesce("n", F.lit(1)), "fp"))
    centres = materialise(weighed.groupBy("anchor").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n")).select("anchor", F.col("w.fp").alias("c"), "n"), "centres")
    total = homes.count()
    shared = beside(homes, centres.where(F.col("n") > 1), "anchor", "n", total)
    first = shared.where((F.col("fp") != F.col("c")) & _near("fp", "c", radius)).select(F.col("c").alias("a"), F.col("fp").alias("b")).distinct()
    root = materialise(_joined(None, materialise(first, "links-1")), "classes-1")
    # every fingerprint that came to an anchor meets the centre there, unless both are of one class
    came = materialise(_classed(dealt(vertices, parts, False, radius), root), "replicated")
    centred = _classed(centres.select("anchor", F.col("c").alias("fp")), root).select("anchor", F.col("fp").alias("c"), F.col("root").alias("c_root"))
    second = came.join(centred, "anchor").where((F.col("root") != F.col("c_root")) & _near("fp", "c", radius)).select(F.col("c").alias("a"), F.col("fp").alias("b")).distinct()
    second = materialise(second, "links-2")
    if second.take(1):
        root = materialise(_joined(root, second), "classes-2")
    # what is left: pairs of different classes, where one of the two is at home
    at_home = _classed(homes, root).select("anchor", F.col("fp").alias("h"), F.col("root").alias("h_root"))
    rest = _classed(came.select("anchor", "fp"), root).join(at_home, "anchor").where((F.col("root") != F.col("h_root")) & _near("fp", "h", radius))
    third = materialise(rest.select(F.least("fp", "h").alias("a"), F.greatest("fp", "h").alias("b")).distinct(), "links-3")
    return _joined(root, third) if third.take(1) else root


def _classed(rows: DataFrame, root: DataFrame) -> DataFrame:
    """Rows with the class of ``fp``; one without links is its own."""
    return rows.join(root.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, parts: tuple[tuple[int, ...], ...] | None = None) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, component_size): of each component the least id names it."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = materialise(fingerprints(docs, width), "fingerprints")
    vertices = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "vertices")
    root = linked(vertices, radius, parts)
    placed = materialise(_classed(vertices, root), "placed")
    heads = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("members")), "heads")
    named = beside(placed, heads, "root", "members", placed.count()).select("fp", "n", "component_id", "component_size")
    out = beside(rows, materialise(named, "named"), "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
