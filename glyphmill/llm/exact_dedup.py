"""Operator 3: exact deduplication with a heavy-hitter split.

1. One pass over the texts writes a narrow table (id, row, SHA-256 digest).
2. Misra-Gries (Spark's mergeable frequent-items aggregate) names every digest
   that may hold more than ``SUPPORT`` of the rows: at most 1 / SUPPORT
   candidates, whatever the input, with false positives.
3. Verification counts the candidates exactly, partially in each task, and
   finds their winners; candidates under the support fall out.
4. Verified winners, at most 1 / SUPPORT rows, are broadcast and settle their
   copies where they are.  All other digests, each of at most SUPPORT of the
   rows, meet in one ordinary shuffle.

Texts are equal when their SHA-256 digests are.  The row with the largest id
stays.

Defined cases: null text equals the empty text; a null id sorts below all
others, so it stays only where all ids of its group are null; of repeated rows
and ties with the largest id exactly one is kept, the last as the table was
read; very long texts are hashed whole, in the JVM; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import materialise

#: Share of all rows beyond which a digest is settled by broadcast.
SUPPORT = 1e-3


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row, digest); ``row`` tells repeated rows apart once it is written."""
    return docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("digest"))


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Distinct digests that may hold more than ``support`` of the rows: at most 1 / support.

    The aggregate compares binary values by identity, so it gets them as text.
    """
    named = rows.select(F.hex("digest").alias("name"))
    return named.stat.freqItems(["name"], support).select(F.explode("name_freqItems").alias("name")).select(F.unhex("name").alias("digest"))


def groups(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, digest) for every row of a written fingerprint table."""
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    best = F.max(F.struct("doc_id", "row")).alias("best")
    candidates = F.broadcast(frequent(rows, support))  # at most 1 / support rows
    heavy = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best).join(total, F.col("group_size") > F.col("total") * F.lit(support)).drop("total")
    # the winners are written: they are read twice, and their number is proven
    winners = materialise(heavy, "heavy")
    shape = [F.col("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("group_size"), F.struct("doc_id", "row").eqNullSafe(F.col("best")).alias("kept"), F.col("digest")]
    settled = rows.join(F.broadcast(winners), "digest").select(*shape)
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("*", F.count(F.lit(1)).over(same).alias("group_size"), F.max(F.struct("doc_id", "row")).over(same).alias("best"))
    return settled.unionAll(rest.select(*shape))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(fingerprints(docs, id_col, text_col), "digests")
    return groups(rows, support).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
