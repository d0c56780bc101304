"""Operator 6: near-duplicates by BagMinHash, banding and exact verification.

Texts become words (lower case, without punctuation at the ends) and multisets
of five-word shingles; a text of fewer words is one shingle.  Two texts are
near-duplicates when the weighted Jaccard similarity of their multisets (sum of
least over sum of greatest multiplicities) is at least ``SIMILARITY``; classes
are connected by such links.

Signatures.  A shingle of weight w owns independent Poisson processes over the
dyadic weight levels [0,1), [1,2), [2,4), [4,8) ..., each with the level's
length as rate.  A point has a time, a weight cell inside its level, and a
signature component; points in cells at or beyond w don't count, so texts that
hold a shingle w and w' times share exactly the points below min(w, w').  A
component keeps its earliest point; two texts agree in a component with the
probability of their weighted Jaccard similarity.  Only points before a bound
are made: the bound is set so that nearly all components are met, and doubled
for the texts where one isn't, so signatures don't depend on it.

Bands.  ``BANDS`` bands of ``ROWS`` components: a pair at the threshold shares
none with a probability of 3e-6.

Links.  Texts with equal multisets are one vertex, so copies are never paired.
Round 1 links each vertex to the least vertex of all its buckets, one pair a
vertex, and later rounds link the vertices of each bucket that still holds
several classes to one centre of another class; verified links merge classes.
There are ``ROUNDS`` of them at least, and more while the comparisons that are
left would be many and each round takes a good part of them away.
What is left is compared in full: the pairs of small buckets, and large
buckets in tiles of about ``TILE`` vertices and ``TILE_ELEMENTS`` elements at
most, a task for each two tiles, which holds only those two and returns no pairs
but the few links that join classes.
So no link between classes is lost and pairs within a class are never made.  A
bucket of n undecided vertices still costs n * n / ``TILE`` shuffled rows and n
* n comparisons there, which single links at a threshold near a group's usual
similarity need; the rounds keep n small, and no task or memory grows with it.

Hot classes and stars.  Where rows meet the one row of their class or star,
keys of more than a thousandth of all rows are broadcast (a thousand at most),
and all others are shuffled.

Verification counts the shared multiset elements of a pair, from sorted arrays
of 64-bit hashes.

Defined cases: null, empty and wordless texts have no shingles, form no links
and are classes of their own; very long texts are one row like others and are
compared whole; of equal similarities none is preferred, as all links count;
repeated rows and equal ids are vertices' copies, of which the least (id, row)
is kept; a null id is carried along and sorts first; an empty table gives no
rows; other columns, whatever their names, are ignored by ``classes`` and kept
with their values by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Memo, beside, bounded_batches, kept, materialise, mix64, numbered, plain, scoped, scratch, slices, split, unused, word_hash

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
ROUNDS, MOST_ROUNDS = 2, 8
#: Vertices of buckets that are compared pair by pair; vertices of a tile of larger ones; elements compared at once.
SMALL, TILE, COLUMNS = 16, 512, 4096
#: Elements of a tile, unless one vertex has more; tasks that share the pairs of a hot centre.
TILE_ELEMENTS, SALTS = 4_000_000, 64
#: Pairs that one centre may hold alone.
FEW = 100_000
#: Vertices up to which a set of vertices is broadcast; their number is counted first.
BROADCAST_ROWS = 1_000_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _word_codes(tokens: list[str]) -> np.ndarray:
    """A hash of each token's word, 0 for tokens that are no words."""
    words = [plain(t) for t in tokens]
    out = np.zeros(len(words), np.uint64)
    real = [i for i, w in enumerate(words) if w]
    if real:
        out[real] = word_hash([words[i] for i in real]) | np.uint64(1)
    return out


def multisets(text: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: text number, hash and multiplicity of each distinct shingle, by text."""
    codes, tokens, starts = split(text)
    h = memo(tokens)[codes]
    doc = np.repeat(np.arange(len(text)), np.diff(starts))
    real = h != 0
    h, doc = h[real], doc[real]
    n = np.bincount(doc, minlength=len(text))
    ends = np.cumsum(n)
    # a text of fewer words than the width is one shingle, of the words it has
    at = np.arange(len(h))
    first = (ends - n)[doc] if len(h) else at
    full = at + WIDTH <= ends[doc] if len(h) else np.zeros(0, bool)
    start = np.flatnonzero(full | ((n[doc] < WIDTH) & (at == first))) if len(h) else at
    of = doc[start]
    padded = np.concatenate([h, np.zeros(WIDTH, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    for k in range(WIDTH):
        inside = start + k < ends[of]
        total = mix64(total * np.uint64(31) + np.where(inside, padded[start + k], np.uint64(0)) + GOLDEN)
    # sort inside texts: by text number in the high bits of a sort key would cut the hash, so sort a scrambled pair
    key = mix64(total ^ mix64(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    where = np.flatnonzero(new)
    count = np.diff(np.append(where, len(key)))
    picked = order[where]
    of, total = of[picked], total[picked]
    by = np.argsort(of, kind="stable")
    return of[by], total[by], count[by]


def bag_minhash(of: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Times of the earliest points: a row of ``size`` components for each of ``n`` texts, infinite for texts without shingles."""
    out = np.full((n, size), np.inf)
    weight = np.bincount(of, count, n)
    bound = np.where(weight > 0, size * (np.log(size) + 3) / np.maximum(weight, 1), 0)
    todo = weight > 0
    while todo.any():
        mine = todo[of]
        o, x, w = of[mine], h[mine], count[mine]
        levels = 1 + np.frexp((w - 1).astype(np.float64))[1].astype(np.int64)  # one more than the bits of w - 1
        level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
        o, x, w = np.repeat(o, levels), np.repeat(x, levels), np.repeat(w, levels)
        low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
        rate = np.maximum(low, 1).astype(np.float64)
        state = mix64(x + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        time, end = np.zeros(len(o)), bound[o]
        flat = np.full(n * size, np.inf)
        while len(o):
            state = state + GOLDEN
            bits = mix64(state)
            time = time - np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
            live = time < end
            o, w, low, rate, state, time, end, bits = o[live], w[live], low[live], rate[live], state[live], time[live], end[live], bits[live]
            more = mix64(bits ^ np.uint64(0xA0761D6478BD642F))
            part = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
            cell = low + ((more >> np.uint64(32)).astype(np.float64) * rate * 2.0**-32).astype(np.int64)
            counts = cell < w
            np.minimum.at(flat, o[counts] * size + part[counts].astype(np.int64), time[counts])
        made = flat.reshape(n, size)
        out[todo] = made[todo]
        todo = todo & np.isinf(out).any(axis=1)
        bound = bound * 2
    return out


def _sum_by(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of unsigned integers by text, modulo 2^64; ``of`` is sorted."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.searchsorted(of, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def _memo() -> Memo:
    return kept("shingle words", lambda: Memo(_word_codes, 300_000))


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, n, d1, d2, bands) from rows (doc_id, row, text): size, digest and band keys of each text's multiset."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, "text"):
            n = len(text)
            of, h, count = multisets(text, _memo())
            sig = bag_minhash(of, h, count, n)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
            bits = sig.view(np.uint64).reshape(n, BANDS, ROWS)
            for r in range(ROWS):
                keys = mix64(keys * np.uint64(31) + bits[:, :, r] + GOLDEN)
            size = np.bincount(of, count, n).astype(np.int64)
            kept_bands = np.where(size > 0, BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept_bands)]).astype(np.int32)), pa.array(keys[size > 0].ravel().view(np.int64)))
            c = count.astype(np.uint64)
            digest = [_sum_by(of, mix64(h + np.uint64(s)) * mix64(c + np.uint64(s)), n).view(np.int64) for s in (17, 91)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), *map(pa.array, digest), bands], ["doc_id", "row", "n", "d1", "d2", "bands"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n long, d1 long, d2 long, bands array<long>")


def elements(docs: DataFrame) -> DataFrame:
    """Rows (v, els, size) from rows (row, text): the sorted 64-bit hashes of each text's multiset, repeats told apart, and their number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, "text"):
            of, h, count = multisets(text, _memo())
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of, x = np.repeat(of, count), mix64(np.repeat(h, count) + nth.astype(np.uint64) * GOLDEN)
            order = np.lexsort((x, of))
            x = x[order]
            ends = np.searchsorted(of[order], np.arange(len(text) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary()), pa.array(np.diff(ends).astype(np.int64))], ["v", "els", "size"])

    return docs.select("row", "text").mapInArrow(run, "v long, els binary, size long")


def verified(pairs: DataFrame, els: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), of a stored table, whose exact similarity reaches the threshold.

    Of more pairs than ``FEW``, centres that more than a thousandth of them
    share, a thousand at most, are dealt with their pairs over ``SALTS`` tasks each.
    """
    total = pairs.count()
    left = els.select(F.col("v").alias("a"), F.col("els").alias("x"))
    right = els.select(F.col("v").alias("b"), F.col("els").alias("y"))
    if total <= FEW:
        met = pairs.join(left, "a")
    else:
        hot = F.broadcast(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(SALTS, total // 1000)).select("a", F.lit(True).alias("hot")))
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        dealt = left.join(hot, "a", "left").select("a", "x", F.explode(salts).alias("salt"))
        salted = pairs.join(hot, "a", "left").select("a", "b", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
        met = salted.join(dealt, ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]), kind="stable") if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else np.empty(0, np.uint64)
                shared = int((both[1:] == both[:-1]).sum()) if len(both) else 0
                keep.append(shared >= similarity * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Rows (v, root): the least vertex connected to each vertex that has links, from links (a, b).

    Alternates large-star and small-star steps; each step is written to the
    shared folder, so lost executors cost one step.  The driver sees only two
    numbers of each.
    """
    now = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).where(F.col("u") != F.col("w")).distinct(), "links")
    seen = None
    while True:
        # a star's centre is met by its own side of each link: the row of a hot centre is broadcast
        both = now.unionAll(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"), F.sum((F.col("w") > F.col("u")).cast("long")).alias("n")), "least")
        total = now.count()
        large = beside(both.where(F.col("w") > F.col("u")), least, "u", "n", total).select(F.col("w").alias("u"), F.col("m").alias("w")).where(F.col("u") != F.col("w")).distinct()
        down = materialise(large, "large-star")
        lowest = materialise(down.groupBy("u").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
        small = beside(down, lowest, "u", "n", down.count()).select(F.col("w").alias("u"), F.col("m").alias("w")).unionAll(lowest.select("u", F.col("m").alias("w"))).where(F.col("u") != F.col("w")).distinct()
        now = materialise(small, "small-star")
        sign = now.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(20,0)"))).first()
        if sign == seen:
            return now.select(F.col("u").alias("v"), F.col("w").alias("root")).unionAll(now.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
        seen = sign


def _undecided(buckets: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, v, root) of all buckets, and (key, n) of those that hold several classes."""
    marked = buckets.select("key", "v").join(root, "v", "left").select("key", "v", F.coalesce("root", "v").alias("root"))
    counted = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    return marked, counted.where(F.col("lo") != F.col("hi")).select("key", "n")


def _merged(root: DataFrame, more: DataFrame) -> DataFrame:
    """Classes after more links; a class stands for itself by the star of its root."""
    if not more.take(1):
        return root
    star = root.where(F.col("v") != F.col("root")).select(F.col("root").alias("a"), F.col("v").alias("b"))
    return components(star.unionAll(more))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of elements that each left set shares with each right one."""
    sizes = np.array([len(x) for x in [*left, *right]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, col, times = np.unique(np.concatenate([*left, *right]) if len(row) else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [at, at + COLUMNS])
        held = np.zeros((len(sizes), COLUMNS), np.float32)
        held[row[i:j], col[i:j] - at] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _tiled(left: DataFrame, els: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join classes inside the buckets of ``left`` (key, v, root, n)."""
    held = left.join(els.select("v", "size"), "v").groupBy("key").agg(F.sum("size").alias("held"))
    parts = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("held") / TILE_ELEMENTS)).cast("int")
    placed = left.join(held, "key").withColumns({"parts": parts, "t": F.pmod(F.xxhash64("v", F.lit(77)), parts).cast("int")}).join(els.select("v", "els"), "v")
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "v", "root", "els")

    def run(group: pa.Table) -> pa.Table:
        t, v, root, i, j = (group[c].to_numpy() for c in ("t", "v", "root", "i", "j"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group["els"]]
        p, q = np.flatnonzero(t == i[0]), np.flatnonzero(t == j[0])
        a: list[int] = []
        b: list[int] = []
        if len(p) and len(q):
            size = np.array([len(x) for x in sets])
            shared = _overlaps([sets[k] for k in p], [sets[k] for k in q])
            alike = (shared > 0) & (shared >= similarity * (size[p][:, None] + size[q][None, :] - shared)) & (root[p][:, None] != root[q][None, :])
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while x in above:
                    x = above[x]
                return x

            for x, y in zip(*np.nonzero(alike)):
                one, other = top(int(root[p[x]])), top(int(root[q[y]]))
                if one != other:
                    above[max(one, other)] = min(one, other)
                    a.append(int(v[p[x]]))
                    b.append(int(v[q[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, row: str | None = None) -> DataFrame:
    """Rows (doc_id, row, class_id, class_size, kept): of each class the least (id, row) names it and is kept.

    ``row``, if given, is a stored column of ``docs`` that numbers its rows;
    else they are numbered in a table of their own, as they are read twice.
    """
    fields = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    docs = docs.select(*fields, F.col(f"`{row}`").alias("row")) if row else numbered(docs.select(*fields), "row")
    sigs = materialise(signatures(docs), "signatures")
    # vertices: texts with equal multisets are one, named by the least row
    vertices = sigs.where(F.col("n") > 0).groupBy("d1", "d2").agg(F.min("row").alias("v"))
    vertex = materialise(vertices, "vertices")
    keyed = sigs.select("row", F.explode("bands").alias("key")).join(vertex.select(F.col("v").alias("row")), "row", "left_semi").select("key", F.col("row").alias("v"))
    keyed = materialise(keyed, "bands")
    shared = keyed.groupBy("key").agg(F.min("v").alias("centre"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    buckets = materialise(keyed.join(shared, "key").select("key", "v", "centre"), "buckets")
    wanted = materialise(buckets.select("v").distinct(), "candidates")
    ids = wanted.select(F.col("v").alias("row"))
    wanted_rows = wanted.count()
    if wanted_rows <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    els = materialise(elements(docs.join(ids, "row", "left_semi")), "elements")

    first = buckets.where(F.col("v") != F.col("centre")).groupBy("v").agg(F.min("centre").alias("a")).select("a", F.col("v").alias("b"))
    tried = materialise(first, "tried-1")
    links = materialise(verified(tried, els, similarity), "links-1")
    root = components(links)
    before, k = None, 1
    while True:
        marked, several = _undecided(buckets, root)
        several = materialise(several, f"several-{k}")
        work = several.agg(F.sum(F.col("n") * F.ceil(F.col("n") / TILE))).first()[0] or 0
        if not work or k >= ROUNDS and (k >= MOST_ROUNDS or work <= wanted_rows or before is not None and work > 0.7 * before):
            break
        before, k = work, k + 1
        # a centre from another class each round: the least by a hash that changes
        centres = marked.join(several, "key").groupBy("key").agg(F.min_by(F.struct(F.col("v").alias("c"), F.col("root").alias("c_root")), F.xxhash64("v", F.lit(k))).alias("c")).select("key", "c.*")
        pairs = marked.join(centres, "key").where(F.col("root") != F.col("c_root")).select(F.least("v", "c").alias("a"), F.greatest("v", "c").alias("b"))
        fresh = materialise(pairs.distinct().join(tried, ["a", "b"], "left_anti"), f"pairs-{k}")
        tried = tried.unionAll(fresh)
        root = _merged(root, materialise(verified(fresh, els, similarity), f"links-{k}"))
    left = materialise(marked.join(several, "key").select("key", "v", "root", "n"), "undecided")
    few = left.where(F.col("n") <= SMALL)
    pairs = few.join(few.select("key", F.col("v").alias("c"), F.col("root").alias("c_root")), "key").where(F.col("root") < F.col("c_root")).select(F.least("v", "c").alias("a"), F.greatest("v", "c").alias("b"))
    fresh = materialise(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    small = materialise(verified(fresh, els, similarity), "links-small")
    large = materialise(_tiled(left.where(F.col("n") > SMALL), els, similarity), "links-large")
    root = _merged(root, small.unionAll(large))
    named = vertex.join(root, "v", "left").select("d1", "d2", F.coalesce("root", "v").alias("root"))
    rows = sigs.select("doc_id", "row", "n", "d1", "d2")
    wordy = rows.where(F.col("n") > 0).join(named, ["d1", "d2"]).select("doc_id", "row", "root")
    placed = materialise(wordy.unionAll(rows.where(F.col("n") == 0).select("doc_id", "row", F.col("row").alias("root"))), "placed")
    heads = materialise(placed.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.count(F.lit(1)).alias("class_size")), "heads")
    # most classes are one row, and need no join
    single = heads.where(F.col("class_size") == 1).select("head.doc_id", "head.row", "head", "class_size")
    several = heads.where(F.col("class_size") > 1)
    of_several = beside(placed, several, "root", "class_size", placed.count()).select("doc_id", "row", "head", "class_size")
    return single.unionAll(of_several).select("doc_id", "row", F.col("head.doc_id").alias("class_id"), "class_size", F.struct("doc_id", "row").eqNullSafe(F.col("head")).alias("kept"))


def keep_one(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each class."""
    spark, row = docs.sparkSession, unused(docs, "__row")
    whole, path = numbered(docs, row), scratch(spark, "copies")
    with scoped(spark):  # of all the tables made on the way only this one is needed
        copies = classes(whole, row, text_col, row=row).where(~F.col("kept")).select(F.col("row").alias(row))
        gone = materialise(copies, "copies", path)
    return whole.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
