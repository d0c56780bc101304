"""Operator 1: mixing sources to target weights by systematic sampling.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share
``BUDGET`` times all words; a target stops at ``CAP`` times its source's size
and the excess is shared anew by weight.  That fixed point is closed: with
sources sorted by cap over weight, all below one level are at their caps and
the others get the level times their weight.

Sampling: each document expects target / size of its source copies.  Prefix
sums of that run through each source, starting at one offset; a document is
emitted once for each whole number its sum crosses.  Sums are counts of
documents times a rate in fixed point (2^-28), so they are exact and at most
CAP copies are ever emitted.

Prefix sums at scale: a source is ordered by size class, then by a hash of id
and text, in 1,024 cells a class.  Cell counts are summed over cells, then over
classes, then ranks are taken inside cells, so no task holds a source, not
even where one source, one size, one text or one id (or none) has most rows;
only rows that are equal in both id and text share a cell.  Ordering by size
makes each source's words come near its target.

Defined cases: null text has size 0; null source is a source; sources without
words have target 0; repeated rows and equal ids are all counted, each row on
its own; ties are ordered by the hash, so reruns agree but for which of rows
equal in id and text is which; very long texts are sized whole, in the JVM; an
empty table gives no rows; other columns, whatever their names, are ignored by
``plan`` and kept with their values by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import materialise

BUDGET, CAP, WEIGHTS = 1.5, 2, (3, 1, 2)
SCALE = 1 << 28
CELLS = 1024


def size(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size); windows run over a row for each source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    levels = by.select(
        "*",
        (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    # the first source whose share at its level is within its cap sets the level for itself and all after it
    found = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)
    return levels.withColumn("found", found).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("found.level") * F.col("w"), F.col("cap"))).alias("target"))


def _size_class(n: Column) -> Column:
    """Exact up to 64 words, then 32 classes an octave: at most some thousand classes."""
    return F.when(n <= 64, n).otherwise(F.floor(F.log2(n.cast("double")) * 32) + 64).cast("int")


def order_key(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text; its low bits name the cell."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def crossed(rank: Column, rate: Column, offset_: Column) -> Column:
    """Whole numbers between the prefix sums before and after the document of that rank, in units of 1 / SCALE.

    A rank counts modulo SCALE: whole multiples add whole numbers to both sums, and products stay within 64 bits.
    """
    last = offset_ + rate * (rank % SCALE)
    return F.shiftright(last, 28) - F.shiftright(last - rate, 28)


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in units of 1 / SCALE."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary")), 1, 7), 16, 10).cast("long")


def sized(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """The columns that a row's place in its source follows from; all come from the row itself."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return {"doc_id": doc_id, "source": F.col(f"`{source_col}`").cast("string"), "size": size(text), "key": order_key(doc_id, text)}


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, copies."""
    rows = materialise(docs.select(*[c.alias(k) for k, c in sized(id_col, text_col, source_col).items()]), "sizes")
    return _counted(celled(rows), rows, seed).select("doc_id", "size", "source_size", "target", "copies")


def celled(rows: DataFrame) -> DataFrame:
    """The rows with their size class, cell, and source as a key that isn't null."""
    return rows.withColumns({"cls": _size_class(F.col("size")), "cell": F.pmod("key", F.lit(CELLS)).cast("int"), "src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))})


def _counted(placed: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """``placed``, whose rows have the columns of ``celled``, with source_size, target and copies.

    ``rows`` are the same rows without other columns.
    """
    by_source = targets(rows).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("src"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * SCALE)).otherwise(0).cast("long").alias("rate"),
        offset(F.col("source"), seed).alias("offset"),
    )
    narrow = celled(rows)
    cells = narrow.groupBy("src", "cls", "cell").agg(F.count(F.lit(1)).alias("n"))
    classes = narrow.groupBy("src", "cls").agg(F.count(F.lit(1)).alias("n"))
    up_to = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    class_base = classes.select("src", "cls", F.coalesce(F.sum("n").over(up_to("src").orderBy("cls")), F.lit(0)).alias("class_base"))
    bases = cells.select("src", "cls", "cell", F.coalesce(F.sum("n").over(up_to("src", "cls").orderBy("cell")), F.lit(0)).alias("cell_base")).join(class_base, ["src", "cls"]).join(by_source, "src")
    rank = F.row_number().over(Window.partitionBy("src", "cls", "cell").orderBy("size", "key", "doc_id"))
    # rows meet their cell's sums where they were ranked
    met = placed.withColumn("rank", rank).join(bases, ["src", "cls", "cell"])
    return met.withColumn("copies", crossed(F.col("class_base") + F.col("cell_base") + F.col("rank"), F.col("rate"), F.col("offset")))


def mixture(docs: DataFrame, **names) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    return plan(docs, **names).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """The mixed documents themselves: each row as often as its prefix sum crosses whole numbers.

    A row's place follows from the row alone, so the texts are shuffled once,
    to their cells, and need no numbers.
    """
    columns = sized(id_col, text_col, source_col)
    rows = materialise(docs.select(*[c.alias(k) for k, c in columns.items()]), "sizes")
    # the document travels as one column, so that no name of its columns meets another
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)]).alias("document"), *[c.alias(k) for k, c in columns.items()])
    taken = _counted(celled(whole), rows, seed).where(F.col("copies") > 0)
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*[F.col(f"document.k{i}").alias(c) for i, c in enumerate(docs.columns)])


#: DuckDB SQL for ``mixture``.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key,
         row_number() OVER () AS rid
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap
  FROM by_source
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), found AS (
  SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w <= cap
), targets AS (
  SELECT l.source, l.source_size, least(l.cap, coalesce(f.level * l.w, l.cap)) AS target FROM levels l CROSS JOIN found f
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 268435456)::BIGINT ELSE 0 END AS rate,
         ('0x' || substr(md5('1:' || coalesce('s' || source, 'null')), 1, 7))::BIGINT AS offs
  FROM targets
), ranked AS (
  SELECT d.*, row_number() OVER (
    PARTITION BY source
    ORDER BY CASE WHEN size <= 64 THEN size ELSE floor(log2(size::DOUBLE) * 32)::BIGINT + 64 END,
             key % 1024, size, key, doc_id NULLS FIRST, rid) AS k
  FROM d
)
SELECT r.doc_id, r.size, t.source_size, t.target,
       (((t.offs + t.rate * r.k) >> 28) - ((t.offs + t.rate * (r.k - 1)) >> 28)) * r.size AS taken
FROM ranked r JOIN rated t ON r.source IS NOT DISTINCT FROM t.source
"""
