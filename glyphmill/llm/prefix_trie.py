"""Operator 12: the trie of conversation prefixes, by Patricia construction.

A conversation's turns are ordered by ``turn`` (null first); it is rebuilt from
the first h turns of conversation ``conv_id - conv_id % 20`` and its own turns
after its first h, with h = crc32(conv_id) % 4.  A node is a distinct sequence of
first turns (role, text); the root has none.

Construction.  A turn becomes a fixed-width code of its digest and word count, and
a conversation the path of its turns' codes; texts are read once and never
shuffled.  Equal paths are counted as one, and sorted, so that the members of a
node stand together.  A pass over the sorted paths keeps the open points of the
last path on a stack: a path's end and the place where it leaves the path before
are points, and nothing else is, so leaves, ends and branches come out with the
compressed edge above them.  Sums over a point's subtree are sums over its paths
(of words, with and without multiplicity), so each is made as paths go by.

Ranges.  The sort deals paths to ranges, each a task.  The nodes that two
neighbouring ranges share are those on the common prefix of the paths on either
side; both ranges make all of these points, with the sums of their own paths, and
one aggregate by node adds them up.  The driver sees one number for each range.

Expansion.  The unary nodes of an edge have the members of the point below; their
saved tokens are that point's and a suffix sum of the edge's words.  Parents meet
children by node, where hot parents are broadcast.

The digest of ends.  Ids are joined to texts of some 64 kB in the ranges of a sort
by (path, id); only the hash itself, which is sequential, runs over a path's
texts one by one, in one task and with bounded memory.

Defined cases: rows without a conversation are left out; a null role or text is an
empty one; turns of equal number are ordered by the digest of role and text, and
repeated ones are turns of their own; a conversation that has too few turns is a
member of the root alone; very long texts are digested whole; negative ids have
the remainder of their size, with its sign; an empty table gives no rows, not even
a root; other columns, whatever their names, are ignored.  A conversation's path is one row, of 40
characters a turn, whatever its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import beside, bounded_batches, materialise, mix64

BLOCK, HEADS = 20, 4
#: Characters of a turn's code: a digest of 32 and a word count of 8, in hexadecimal digits.
DIGEST, CODE = 32, 40
#: Characters of ids that are joined before they are hashed.
CHUNK = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "p1", "p2"]
POINT = "depth int, p1 long, p2 long, up_depth int, up1 long, up2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved decimal(38,0), path_key string, edge array<long>, shared boolean"


def turn_code(role: Column, text: Column) -> Column:
    """A turn's digest and number of words, of fixed width."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return F.concat(digest, F.lpad(F.lower(F.hex(words.cast("long"))), CODE - DIGEST, "0"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, path) from rows (conv_id, turn, role, text)."""
    entry = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), turn_code(F.col("role"), F.col("text")).alias("code"))
    entries = turns.where(F.col("conv_id").isNotNull()).select("conv_id", entry.alias("e"))
    own = entries.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["code"]).alias("codes"))
    own = materialise(own, "turns")
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("codes", 1, HEADS - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    joined = own.withColumns({"h": h.cast("int"), "base": F.col("conv_id") - F.col("conv_id") % BLOCK}).join(heads, "base", "left")
    both = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("codes", F.col("h") + 1, F.size("codes")))
    return joined.select("conv_id", F.array_join(both, "").alias("path"))


def common_turns(a: str, b: str) -> int:
    """Turns that two paths share from their start."""
    return len(commonprefix([a, b])) // CODE


class _Point:
    """An open point on the stack: a depth on the last path, and what the paths below it have added."""

    __slots__ = ("depth", "first_lcp", "first_ends", "conv_id", "n", "children", "leaves", "all_words", "new_words", "path_key", "shared")

    def __init__(self, depth: int, first_lcp: int, first_ends: bool, shared: bool = False):
        self.depth, self.first_lcp, self.first_ends, self.shared = depth, first_lcp, first_ends, shared
        self.conv_id, self.n, self.children, self.leaves, self.all_words, self.new_words, self.path_key = None, 0, 0, 0, 0, 0, None

    def add(self, other: _Point) -> None:
        self.conv_id = other.conv_id if self.conv_id is None else self.conv_id if other.conv_id is None else min(self.conv_id, other.conv_id)
        self.n += other.n
        self.leaves += other.leaves
        self.all_words += other.all_words
        self.new_words += other.new_words


class _Path:
    """A path's prefix keys and words before each depth."""

    def __init__(self, path: str):
        raw = np.frombuffer(bytes.fromhex(path), np.uint8).reshape(-1, CODE // 2)
        place = np.arange(1, len(raw) + 1, dtype=np.uint64)[:, None]
        digest = np.ascontiguousarray(raw[:, : DIGEST // 2]).view("<u8").astype(np.uint64)
        keys = np.bitwise_xor.accumulate(mix64(digest + place * np.uint64(0x9E3779B97F4A7C15)), axis=0) if len(raw) else digest.reshape(0, 2)
        self.keys = [(0, 0), *map(tuple, keys.view(np.int64).tolist())]
        words = np.ascontiguousarray(raw[:, DIGEST // 2 :]).view(">u4").astype(np.int64).ravel()
        self.words = [0, *np.cumsum(words).tolist()]
        self.size = len(raw)


def points_of_range(rows: Iterator[tuple[str, int, int, str]], before: int, after: int) -> Iterator[tuple]:
    """Points of a range of sorted distinct paths, from rows (path, least id, members, key of the path).

    ``before`` and ``after`` are the turns that the first path shares with the
    range before and the last one with the range after, -1 where there is none.
    """
    stack: list[_Point] = []
    last_text, last = None, None

    def closed(down_to: int, explicit: bool) -> Iterator[tuple]:
        """Close the points below a depth, and open one there if there is none."""
        while stack and stack[-1].depth > down_to:
            p = stack.pop()
            if not stack or stack[-1].depth < down_to:
                q = _Point(down_to, p.first_lcp, False, explicit)
                q.children = 1 if p.first_lcp < down_to else 0
                stack.append(q)
            up = stack[-1]
            up.add(p)
            yield emitted(p, up.depth)

    def emitted(p: _Point, up: int) -> tuple:
        w = last.words
        top = w[p.depth - 1] if p.depth else 0
        # words of all members from this depth on, less those of distinct nodes; the first path brings its nodes from here, not from where it left the one before
        saved = p.all_words - p.n * top - p.new_words
        if p.first_lcp < p.depth:
            saved += top - (w[p.first_lcp] if p.first_lcp > 0 else 0)
        edge = [w[p.depth - 1] - w[k - 1] for k in range(up + 1, p.depth + 1)] if p.depth else [0]
        return (p.depth, *last.keys[p.depth], up if p.depth else None, *(last.keys[up] if p.depth else (None, None)), p.conv_id, p.n, p.children, p.leaves, saved, p.path_key, edge, p.shared)

    waiting = None  # a path is a leaf if the next one doesn't go on from it, so it is taken when the next is known

    def taken(row: tuple, lcp: int, leaf: bool) -> None:
        text, conv_id, n, key = row
        size = last.size
        if stack[-1].depth < size:
            stack.append(_Point(size, lcp, True))
        p = stack[-1]
        if lcp >= 0 and lcp < size:  # a new child where it leaves the path before
            next(q for q in reversed(stack) if q.depth == lcp).children += 1
        p.path_key = key
        p.conv_id = conv_id if p.conv_id is None else min(p.conv_id, conv_id)
        p.n += n
        p.leaves += leaf
        p.all_words += n * last.words[size]
        p.new_words += last.words[size] - (last.words[lcp] if lcp > 0 else 0)

    for row in rows:
        if last is None:
            last, lcp = _Path(row[0]), before
            # nodes that the range before has too are points here, each of them; the root always is one
            stack.extend(_Point(d, before, False, before >= 0) for d in range(max(before, 0) + 1))
            if before < 0:
                stack[0].children, stack[0].first_ends = int(last.size > 0), last.size == 0
        else:
            lcp = common_turns(last_text, row[0])
            taken(waiting, waiting_lcp, lcp < last.size)
            yield from closed(lcp, False)
            last = _Path(row[0])
        waiting, waiting_lcp, last_text = row, lcp, row[0]
    if last is None:
        return
    taken(waiting, waiting_lcp, after < last.size)
    for depth in range(max(after, 0), -1, -1):
        yield from closed(depth, True)
        stack[-1].shared |= after >= 0
    yield emitted(stack.pop(), -1)


def _ranges(paths: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Sorted paths with the number of their range, and for each range the turns that it shares with those before and after."""
    ranged = materialise(paths.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("part").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    ends = ends.withColumn("before", F.lag("hi").over(Window.orderBy("part")))  # a row for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [-1 if a is None else common_turns(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int32())], ["part", "n"])

    found = sorted((r.part, r.n) for r in ends.select("part", "before", "lo").mapInArrow(run, "part int, n int").collect())
    after = [n for _, n in found[1:]] + [-1]
    return ranged, {part: (n, next_) for (part, n), next_ in zip(found, after)}


def points(paths: DataFrame) -> DataFrame:
    """The compressed tree, from rows (path, conv_id, n) of distinct paths: a row for each root, branch, end and leaf with the edge above it."""
    ranged, borders = _ranges(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in POINT.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.decimal128(38, 0), pa.string(), pa.list_(pa.int64()), pa.bool_()]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def made() -> Iterator[tuple]:
            source, held = rows(), []

            def one(part: int, first: tuple) -> Iterator[tuple]:
                yield first[1:]
                for r in source:
                    if r[0] != part:
                        held.append(r)
                        return
                    yield r[1:]

            row = next(source, None)
            while row is not None:
                held.clear()
                yield from points_of_range(one(row[0], row), *borders[row[0]])
                row = held[0] if held else None

        def batch_of(buffer: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*buffer)]
            columns[10] = [None if x is None else __import__("decimal").Decimal(x) for x in columns[10]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        buffer: list[tuple] = []
        size = 0
        for p in made():
            buffer.append(p)
            size += 1 + len(p[12])
            if size >= 20_000:
                yield batch_of(buffer)
                buffer, size = [], 0
        if buffer:
            yield batch_of(buffer)

    dealt = ranged.repartition("part").sortWithinPartitions("part", "path").select("part", "path", "conv_id", "n", F.md5("path").alias("path_key"))
    found = materialise(dealt.mapInArrow(run, POINT), "points")
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).cast(t).alias(c) for c, t in (("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved", "decimal(38,0)"))], F.max("path_key").alias("path_key")]
    up = [F.max(c).alias(c) for c in ("up_depth", "up1", "up2")]  # equal in all ranges
    shared = found.where("shared").groupBy(*KEY).agg(*up, *sums).withColumn("edge", F.array(F.lit(0).cast("long")))
    whole = found.where("NOT shared").drop("shared").unionByName(shared)
    return materialise(whole, "tree")


def ends(members: DataFrame) -> DataFrame:
    """Rows (path_key, ends_sha256) from rows (path_key, conv_id): the digest of each path's ids in ascending order, joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, size, out = None, None, [], 0, []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or size >= CHUNK:
                    if parts:
                        out.append((key, first, ",".join(parts)))
                    key, first, parts, size = k, c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["path_key", "first", "ids"])
                out = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, first, ",".join(parts))], ["path_key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if h:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["path_key", "ends_sha256"])
                out = []
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["path_key", "ends_sha256"])

    texts = members.repartitionByRange("path_key", "conv_id").sortWithinPartitions("path_key", "conv_id").select("path_key", "conv_id").mapInArrow(joined, "path_key string, first long, ids string")
    # repeats of an id are one member
    return texts.repartition("path_key").sortWithinPartitions("path_key", "first").select("path_key", "ids").mapInArrow(hashed, "path_key string, ends_sha256 string")


def expanded(tree: DataFrame, digests: DataFrame) -> DataFrame:
    """All nodes of the compressed tree, with their parents' names."""
    named = tree.join(digests, "path_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    up = [F.col(c) for c in ("up_depth", "up1", "up2")]
    # compressed children of a point are its children
    parents = materialise(tree.where("n_children > 0").select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(KEY)]).alias("up"), F.col("conv_id").alias("up_conv"), F.col("n_children").alias("rows")), "parents")
    below = named.where("up_depth IS NOT NULL").withColumn("up", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(up)]))
    met = beside(below, parents, "up", "rows", tree.count()).drop("up", "rows")
    root = named.where("up_depth IS NULL").withColumn("up_conv", F.lit(None).cast("long"))
    whole = root.unionByName(met)
    size = F.size("edge")
    nodes = whole.select("*", size.alias("length"), F.posexplode("edge").alias("at", "suffix"))
    last = F.col("at") == F.col("length") - 1
    return nodes.select(
        "conv_id",
        (F.col("depth") - F.col("length") + 1 + F.col("at")).cast("long").alias("depth"),
        F.when(F.col("at") == 0, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("suffix")).cast("long").alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    bounded_batches(turns.sparkSession)
    turns = turns.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    paths = materialise(rebuilt(turns), "paths")
    distinct = paths.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    tree = points(distinct)
    digests = materialise(ends(paths.select(F.md5("path").alias("path_key"), "conv_id")), "ends")
    return expanded(tree, digests)


SQL = r"""
    WITH ordered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM ordered GROUP BY conv_id),
    bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc FROM range(256) r(i)),
    crc AS (SELECT list(crc ORDER BY i) AS t FROM bits),
    hs AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM convs, crc),
    rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM hs a LEFT JOIN convs b ON b.conv_id = a.conv_id - a.conv_id % 20),
    steps AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
    members AS (SELECT conv_id, n, depth, turns[1:depth] AS prefix, CASE WHEN depth > 0 THEN len(list_filter(regexp_split_to_array(turns[depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) ELSE 0 END AS words FROM steps),
    nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM members GROUP BY depth, prefix),
    above AS (SELECT c.depth, c.conv_id, p.conv_id AS parent_conv_id FROM nodes c JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]),
    kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM above GROUP BY ALL),
    full_ AS (SELECT n.*, a.parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN above a USING (depth, conv_id) LEFT JOIN kids k USING (depth, conv_id)),
    under AS (SELECT unnest(range(0, depth + 1)) AS d, prefix, n_children, (n_convs - 1) * words AS saved FROM full_),
    sums AS (SELECT d AS depth, prefix[1:d] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM under GROUP BY 1, 2)
    SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM full_ f JOIN sums s ON f.depth = s.depth AND f.prefix = s.prefix"""
