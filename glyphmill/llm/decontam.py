"""Operator 4: benchmark decontamination by SimHash over item-sized windows.

Texts become words (lower case, runs of letters and digits) and shingles of
five words (items of fewer words are one shingle).  A window of a document has
as many words as the item it may match; a document that is shorter than an
item is one window.

1. Anchors.  One pass over all documents, for all widths of items at once,
   joins every shingle with the items' shingles.  At similarity t two multisets
   of n and m shingles share at least t / (1 + t) * (n + m) of them, so a
   document with fewer anchors for items of a length has no match of that
   length.  This loses no match and shuffles anchors only.
2. Windows.  The documents that are left are read again, from m shingles before
   the first anchor to m after the last.  Each shingle enters the sums of its
   window when it comes and leaves them m shingles later, so one running sum
   over these events gives every window, two rows a shingle whatever m is.
   Windows with too few anchors fall out by the same bound.
3. SimHash.  The 64 bit sums of a window travel in packed fields of 64-bit
   integers; each shingle weighs as often as it occurs.
4. Multi-index Hamming.  A fingerprint has 5 blocks of 13 bits (the last of
   12).  Two fingerprints within ``RADIUS`` = 19 bits agree within 3 bits in
   some block.  Items are indexed by all keys within 1 bit of their blocks, 69
   rows an item; a window looks up all keys within 2 bits of its own.  An
   unrelated window and item of one length meet with a chance of 0.23.
5. Verification.  Candidates within the radius are kept where the exact
   weighted Jaccard similarity of the two multisets of shingles is at least
   ``SIMILARITY``.  Of each document and item the best window is returned.

At similarity 0.8 the expected distance is 10 bits with a deviation of 3, so
the radius lies three deviations out; at 0.85 four; equal passages have
distance 0.

What is broadcast is counted first: the items' shingles and the index up to
``BROADCAST_ROWS`` rows each, the documents with anchors likewise; beyond, the
same joins shuffle.

Defined cases: null or wordless texts and items match nothing; repeated
documents each match on their own; items of equal text each match; of windows
with equal similarity the first is returned; very long texts are read whole,
and only their shingles' hashes meet in a task; a null id is carried along; an
empty table gives no rows; other columns, whatever their names, are ignored by
``matches`` and kept with their values by ``remove``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import materialise, numbered, scoped, scratch, unused

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 19
#: Bits of each block of a fingerprint; a pair within the radius agrees within 3 bits in one of them: one that the index turns, and two that a window turns.
BLOCKS, INDEX_TURNS, WINDOW_TURNS = (13, 13, 13, 13, 12), 1, 2
#: Rows of a side that is broadcast, at most; they are counted first.
BROADCAST_ROWS = 1_000_000


def once(column: Column) -> Column:
    """The column, marked as not deterministic, so that the optimiser neither copies it into later expressions nor moves filters on it below it."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(w: Column) -> Column:
    """Hashes of all words; each word is hashed once, and shingles are made of these numbers."""
    return F.transform(w, lambda x: F.xxhash64(x))


def shingles(w: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` hashed words of the array column ``w``, which should be a plain column."""
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def _of_width(w: Column, width: Column) -> Column:
    return F.coalesce(*[F.when(width == k, shingles(w, k)) for k in range(1, WIDTH + 1)])


def _item_tables(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item_id, item, width, hs, m): items that have words; ``item`` tells repeated rows apart, ``m`` counts shingles."""
    split = items.select(F.col(f"`{id_col}`").alias("item_id"), F.monotonically_increasing_id().alias("item"), once(hashed(words(F.col(f"`{text_col}`")))).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(WIDTH))
    return split.select("item_id", "item", width.alias("width"), _of_width(F.col("w"), width).alias("hs")).withColumn("m", F.size("hs"))


def _needed(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that multisets of n and m must share at least."""
    return F.lit(similarity / (1 + similarity)) * (n + m) - F.lit(1e-6)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _anchored(docs: DataFrame, own: DataFrame, widths: list[int], similarity: float) -> DataFrame:
    """Rows (row, of): documents with enough anchors, and the (m, width) of the items they may hold with the first and last anchor, from rows (row, text)."""
    split = docs.select("row", once(hashed(words(F.col("text")))).alias("w"))
    every = split.select("row", F.size("w").alias("words"), F.explode(F.array(*[shingles(F.col("w"), k) for k in widths])).alias("hs"))
    hits = every.select("row", "words", F.posexplode("hs").alias("p", "h")).join(own, "h")
    n = F.col("words") - F.col("width") + 1
    enough = hits.groupBy("row", "m", "width").agg(F.count(F.lit(1)).alias("anchors"), F.first("words").alias("words"), F.min("p").alias("first"), F.max("p").alias("last")).where(F.col("anchors") >= _needed(F.least(n, "m"), F.col("m"), similarity))
    # as many entries as items have lengths, at most
    return enough.groupBy("row").agg(F.collect_list(F.struct("m", "width", "first", "last")).alias("of"))


def _bit_sums(per_field: int, fold) -> dict[str, Column]:
    """``fold`` of the bits of ``h``, ``per_field`` bits wide each, packed into 64-bit integers.

    A product with ones at the right distances brings neighbouring bits to the starts of their fields.
    """
    fields = 64 // per_field
    spread = F.lit(sum(1 << f * (per_field - 1) for f in range(fields)))
    starts = F.lit(sum(1 << f * per_field for f in range(fields)))
    few = F.lit((1 << fields) - 1).cast("long")
    return {f"b{j}": fold((F.shiftrightunsigned("h", j * fields).bitwiseAND(few) * spread).bitwiseAND(starts)) for j in range(64 // fields)}


def _fingerprint(n: Column, per_field: int) -> Column:
    """64-bit fingerprint from packed sums: a bit is set where most of the n shingles have it."""
    fields = 64 // per_field
    bits = F.lit(0).cast("long")
    mask = F.lit((1 << per_field) - 1).cast("long")
    for j in range(64 // fields):
        for f in range(fields):
            count = F.shiftrightunsigned(f"b{j}", f * per_field).bitwiseAND(mask)
            bits = bits.bitwiseOR(F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("long"), j * fields + f)).otherwise(F.lit(0).cast("long")))
    return bits


def _windows(held: DataFrame, own: DataFrame, per_field: int, similarity: float) -> DataFrame:
    """Rows (row, m, s, nw, fp): the windows with enough anchors, from rows (row, m, n, hs)."""
    placed = held.select("row", "m", "n", F.posexplode("hs").alias("p", "h")).join(own.select("h", "m", F.lit(1).alias("anchor")), ["h", "m"], "left")
    # each shingle comes at its place and goes m later
    events = placed.select("row", "m", "n", "h", F.coalesce("anchor", F.lit(0)).alias("anchor"), F.explode(F.array(F.struct(F.col("p").alias("pos"), F.lit(1).alias("sign")), F.struct((F.col("p") + F.col("m")).alias("pos"), F.lit(-1).alias("sign")))).alias("e"))
    events = events.select("row", "m", "n", "h", "anchor", "e.*").where(F.col("pos") < F.col("n"))
    events = events.repartition("row", "m")  # the packed sums are made after the shuffle, which moves hashes alone
    upto = Window.partitionBy("row", "m").orderBy("pos")  # rows of one place are summed together
    sums = _bit_sums(per_field, lambda packed: F.sum(packed * F.col("sign")).over(upto))
    nw = F.least("n", "m")
    ends = events.withColumns({"anchors": F.sum(F.col("anchor") * F.col("sign")).over(upto), **sums})
    kept = ends.where((F.col("sign") > 0) & (F.col("pos") >= nw - 1) & (F.col("anchors") >= _needed(nw, F.col("m"), similarity)))
    return kept.select("row", "m", (F.col("pos") - nw + 1).alias("s"), nw.alias("nw"), _fingerprint(nw, per_field).alias("fp"))


def block_keys(m: Column, fp: Column, turns: int) -> Column:
    """All keys within ``turns`` bits of the blocks of a fingerprint: length, block and bits in one number."""
    at = [sum(BLOCKS[:b]) for b in range(len(BLOCKS))]
    keys = [F.shiftrightunsigned(fp, at[b]).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).bitwiseOR(F.lit(b << max(BLOCKS)).cast("long")).bitwiseOR(F.shiftleft(m.cast("long"), max(BLOCKS) + 3)) for b, bits in enumerate(BLOCKS)]
    masks = [[sum(1 << k for k in turned) for r in range(turns + 1) for turned in combinations(range(bits), r)] for bits in BLOCKS]
    return F.concat(*[F.transform(F.array(*[F.lit(x).cast("long") for x in masks[b]]), lambda x: x.bitwiseXOR(key)) for b, key in enumerate(keys)])


def candidates(windows: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs of ``windows`` (m, fp, ...) and ``index`` (key, item, item_fp) within the radius, each once."""
    columns = [c for c in windows.columns if c != "fp"]
    spread = windows.select(*columns, "fp", F.explode(block_keys(F.col("m"), F.col("fp"), WINDOW_TURNS)).alias("key"))
    return spread.join(index, "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*columns, "item").distinct()


def index_of(known: DataFrame) -> DataFrame:
    """Rows (key, item, item_fp) from rows (item, m, fp)."""
    return known.select(F.explode(block_keys(F.col("m"), F.col("fp"), INDEX_TURNS)).alias("key"), "item", F.col("fp").alias("item_fp"))


#: Rows of the index for each item.
INDEX_ROWS = sum(1 + bits for bits in BLOCKS)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, row: str | None = None) -> DataFrame:
    """Rows (doc_id, item_id, start, similarity): the best window of each document for each item it holds.

    ``start`` is the number of the window's first word.  ``row``, if given, is
    a stored column of ``docs`` that numbers its rows, and comes back as ``row``.
    """
    fields = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    # both passes read the same numbers
    docs = docs.select(*fields, F.col(f"`{row}`").alias("row")) if row else numbered(docs.select(*fields), "row")
    item = materialise(_item_tables(items, item_id_col, item_text_col), "items")
    stats = item.groupBy("width").agg(F.max("m").alias("longest"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("items")).collect()  # at most five rows
    if not stats:
        return docs.where("false").select(*(["row"] if row else []), "doc_id", F.lit(None).cast(item.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    total, n_items = sum(r["n"] for r in stats), sum(r["items"] for r in stats)
    per_field = 16 if max(r["longest"] for r in stats) < (1 << 15) - 1 else 32
    item_rows = item.select("item", "width", "m", F.explode("hs").alias("h"))
    own = _sent(item_rows.select("h", "m", "width").distinct(), total)
    found = materialise(_anchored(docs.select("row", "text"), own, sorted(r["width"] for r in stats), similarity), "anchored")
    split = docs.join(_sent(found, found.count()), "row").select("row", "doc_id", "of", once(hashed(words(F.col("text")))).alias("w")).select("row", "doc_id", "w", F.explode("of").alias("o"))
    whole = split.select("row", "doc_id", "o.m", "o.first", "o.last", once(_of_width(F.col("w"), F.col("o.width"))).alias("hs"))
    skip = F.greatest(F.col("first") - F.col("m") + 1, F.lit(0))
    held = whole.select("row", "doc_id", "m", skip.alias("skipped"), F.slice("hs", skip + 1, F.least(F.col("last") + F.col("m"), F.size("hs")) - skip).alias("hs")).withColumn("n", F.size("hs"))
    held = materialise(held, "held")
    known = item_rows.groupBy("item", "m").agg(F.count(F.lit(1)).alias("ni"), *[c.alias(k) for k, c in _bit_sums(per_field, F.sum).items()]).select("item", "m", _fingerprint(F.col("ni"), per_field).alias("fp"))
    index = _sent(index_of(known), n_items * INDEX_ROWS)
    near = candidates(_windows(held, own, per_field, similarity), index)
    overlap = (
        near.join(held.select("row", "m", "doc_id", "skipped", "hs"), ["row", "m"])
        .select("row", "doc_id", "m", "skipped", "s", "nw", "item", F.explode(F.slice("hs", F.col("s") + 1, F.col("m"))).alias("h"))
        .groupBy("row", "doc_id", "m", "skipped", "s", "nw", "item", "h")
        .agg(F.count(F.lit(1)).alias("c"))
        .join(_sent(item_rows.groupBy("item", "h").agg(F.count(F.lit(1)).alias("ci")), total), ["item", "h"])
        .groupBy("row", "doc_id", "m", "skipped", "s", "nw", "item")
        .agg(F.sum(F.least("c", "ci")).alias("shared"))
    )
    alike = overlap.withColumn("similarity", F.col("shared") / (F.col("nw") + F.col("m") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = alike.groupBy("row", "doc_id", "item").agg(F.max_by(F.struct((F.col("skipped") + F.col("s")).alias("start"), "similarity"), F.struct("similarity", -F.col("s"))).alias("w"))
    named = best.join(_sent(item.select("item", "item_id"), n_items), "item")
    return named.select(*(["row"] if row else []), "doc_id", "item_id", "w.start", "w.similarity")


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item.

    The rows to go carry a number each and are few columns; they leave by an
    anti join that Spark broadcasts only where their measured size allows.
    """
    spark, row = docs.sparkSession, unused(docs, "__row")
    whole, path = numbered(docs, row), scratch(spark, "contaminated")
    with scoped(spark):  # of all the tables made on the way only this one is needed
        gone = materialise(matches(whole, items, id_col=row, text_col=text_col, row=row).select(F.col("row").alias(row)).distinct(), "contaminated", path)
    return whole.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for ``matches``: all windows that share a shingle with an item, compared exactly.  It has no fingerprints,
#: so it would also name a window beyond the radius.
SQL = r"""
WITH i AS (
  SELECT row_number() OVER () AS item, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda w: w <> '') AS w FROM benchmark
), items AS (SELECT *, least(len(w), 5) AS width, len(w) - least(len(w), 5) + 1 AS m FROM i WHERE len(w) > 0),
item_shingles AS (
  SELECT item, width, array_to_string(w[k + 1 : k + width], ' ') AS h, count(*) AS ci
  FROM (SELECT *, unnest(range(0, m)) AS k FROM items) GROUP BY item, width, h
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda w: w <> '') AS w FROM documents
), places AS (
  SELECT rid, width, unnest(range(0, len(w) - width + 1)) AS p, w, len(w) - width + 1 AS n FROM d, (SELECT DISTINCT width FROM items) WHERE len(w) >= width
), shingles AS (SELECT rid, width, p, n, array_to_string(w[p + 1 : p + width], ' ') AS h FROM places),
hits AS (SELECT s.rid, s.width, s.p, s.n, x.item, t.m FROM shingles s JOIN item_shingles x ON s.h = x.h AND s.width = x.width JOIN items t ON t.item = x.item),
windows AS (SELECT DISTINCT rid, width, item, m, unnest(range(greatest(p - m + 1, 0), least(p, greatest(n - m, 0)) + 1)) AS s FROM hits),
held AS (
  SELECT v.rid, v.width, v.item, v.m, v.s, s.h, count(*) AS c FROM windows v JOIN shingles s ON s.rid = v.rid AND s.width = v.width AND s.p BETWEEN v.s AND v.s + v.m - 1 GROUP BY ALL
), compared AS (
  SELECT h.rid, h.item, h.m, h.s, sum(h.c) AS nw, sum(least(h.c, coalesce(x.ci, 0))) AS shared
  FROM held h LEFT JOIN item_shingles x ON x.item = h.item AND x.h = h.h GROUP BY ALL
), alike AS (SELECT *, shared::DOUBLE / (nw + m - shared)::DOUBLE AS similarity FROM compared WHERE shared::DOUBLE / (nw + m - shared)::DOUBLE >= 0.8),
best AS (SELECT rid, item, max(similarity) AS similarity, arg_min(s, (-similarity, s)) AS start FROM alike GROUP BY rid, item)
SELECT d.doc_id, t.item_id, b.start::INT AS start, b.similarity FROM best b JOIN d ON d.rid = b.rid JOIN items t ON t.item = b.item
"""
