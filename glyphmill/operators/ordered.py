"""Ordered operators: active time, numbering, sharding, last write wins, running bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IDLE_SECONDS = 120.0
#: Rows of a range of keys that are numbered by one task.
RANGE_ROWS = 1_000_000


def active_time(events: DataFrame, user: str, ts: str, tie: str, idle: float = IDLE_SECONDS) -> DataFrame:
    """Seconds a user was active: gaps between events that are longer than 0 and shorter than ``idle``."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (micros - F.lag(micros).over(Window.partitionBy(user).orderBy(ts, tie))) / 1e6
    return events.select(user, gap.alias("gap")).groupBy(user).agg(F.coalesce(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") < idle), F.col("gap"))), F.lit(0.0)).alias("active_seconds"), F.count(F.lit(1)).alias("n_events"))


def numbered(df: DataFrame, key: str, name: str = "idx", range_rows: int = RANGE_ROWS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows numbered from 0 in the order of a numeric key and then ``ties``, without one task that sees all rows.

    Cut points split the keys into ranges; ranges are counted, and rows are
    numbered inside their range.  Small inputs have a single range.
    """
    n = df.count()
    ranges = -(-n // range_rows) or 1
    if ranges == 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(key, *ties)) - 1)
    cuts = df.select(F.percentile_approx(key, F.lit([k / ranges for k in range(1, ranges)]), F.lit(max(10_000, 20 * ranges)))).first()[0]
    range_, inside, first, count = (f"{part} of {name}" for part in ("range", "place", "first", "count"))
    marked = df.withColumn(range_, range_of(F.col(key), sorted(set(cuts))))
    before = Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = marked.groupBy(range_).agg(F.count(F.lit(1)).alias(count)).select(range_, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(first))
    placed = marked.withColumn(inside, F.row_number().over(Window.partitionBy(range_).orderBy(key, *ties)) - 1)
    return placed.join(F.broadcast(base), range_).withColumn(name, F.col(first) + F.col(inside)).drop(range_, inside, first)


def range_of(key: Column, cuts: list) -> Column:
    """Number of cut points up to a key (0 for null), by a tree of comparisons, so a key meets about the logarithm of them.

    There is no lambda in it: Spark takes filters that it infers from an equality
    with a lambda's result to the other side of a join, where the key isn't.
    """

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(key.isNull(), 0).otherwise(between(0, len(cuts)))


def round_robin(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Shard of each row: its number modulo the number of shards."""
    return numbered(df, key).withColumn("shard", (F.col("idx") % shards).cast("int")).drop("idx")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Batch of each row: its number divided by the batch size."""
    return numbered(df, key).withColumn("batch", F.floor(F.col("idx") / size)).drop("idx")


def upsert(writes: DataFrame, key: str, order: list[str], text: str, user: str, status: str, default: str = "pending") -> DataFrame:
    """Last write wins by column: the latest text and user, and the latest status that a write set (``default`` if none did).

    One partial aggregate; a write that sets no status has null there.
    """
    at = F.struct(*order)
    has = lambda c: F.when(F.col(c).isNotNull(), at)
    return writes.groupBy(key).agg(F.max_by(text, has(text)).alias(text), F.max_by(user, at).alias(user), F.coalesce(F.max_by(status, has(status)), F.lit(default)).alias(status), F.count(F.lit(1)).alias("n_writes"))


#: Associative operations of a scan: over rows, and of two values, of which either may be null.
SCANS = {
    "least": (F.min, F.least),
    "greatest": (F.max, F.greatest),
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, inside: F.coalesce(inside, before)),
}


def cuts_of(df: DataFrame, order: str, range_rows: int) -> list:
    """Values of a number, date or time that cut its order into ranges of about so many rows; none where one range will do."""
    n = df.count()
    ranges = -(-n // range_rows) or 1
    if ranges == 1 or isinstance(df.schema[order].dataType, StringType):
        return []
    found = df.select(F.percentile_approx(order, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(max(10_000, 20 * ranges)))).first()[0]
    return sorted(set(found or []))


def scan(df: DataFrame, order: list[str], value: str, how: str, name: str, by: list[str] = (), range_rows: int | None = None) -> DataFrame:
    """``df`` with one running value, as ``scans`` has several."""
    return scans(df, order, {name: (value, how)}, by, range_rows)


def scans(df: DataFrame, order: list[str], running: dict[str, tuple[str, str]], by: list[str] = (), range_rows: int | None = None, backwards: bool = False) -> DataFrame:
    """``df`` with running values by name over all rows before each one in an order (null before the first), without one task that sees all rows.

    A running value is a column and an associative operation: least, greatest,
    sum, or last (the last value that isn't null).  Ranges of the order's first
    column are scanned each on its own; what stands before a range is a scan over
    the totals of ranges.  Rows of equal first columns stay in one range.  All
    values share the ranges and their passes.
    """
    cuts = cuts_of(df, order[0], range_rows or RANGE_ROWS)
    way = lambda c: F.col(c).desc() if backwards else F.col(c).asc()
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, -1)
    over = {name: SCANS[how][0](F.col(value)) for name, (value, how) in running.items()}
    if not cuts:
        return df.withColumns({name: f.over(before(by, order)) for name, f in over.items()})
    range_, its = (f"{part} of {', '.join(running)}" for part in ("range", "its range"))
    inside, offset = ({name: f"{part} of {name}" for name in running} for part in ("inside", "offset"))
    marked = df.withColumn(range_, range_of(F.col(order[0]), cuts))
    final = F.min_by if backwards else F.max_by
    # the last value of a range is that of its last row that has one
    known = {name: final(value, F.when(F.col(value).isNotNull(), F.struct(*order))) if how == "last" else over[name] for name, (value, how) in running.items()}
    totals = marked.groupBy(*by, range_).agg(*[f.alias(f"total of {name}") for name, f in known.items()])
    # without keys, a row for each range; keys may be null
    of = lambda c: f"{c} of {', '.join(running)} there"
    sofar = [SCANS[how][0](F.col(f"total of {name}")).over(before(by, [range_])).alias(offset[name]) for name, (_, how) in running.items()]
    offsets = totals.select(*[F.col(c).alias(of(c)) for c in by], F.col(range_).alias(its), *sofar)
    scanned = marked.withColumns({inside[name]: f.over(before([*by, range_], order)) for name, f in over.items()})
    meets = F.col(range_) == F.col(its)
    for c in by:
        meets = meets & F.col(c).eqNullSafe(F.col(of(c)))
    joined = scanned.join(offsets if by else F.broadcast(offsets), meets)
    return joined.select(*df.columns, *[SCANS[how][1](F.col(offset[name]), F.col(inside[name])).alias(name) for name, (_, how) in running.items()])


def running_best(df: DataFrame, order: str, loss: str, by: list[str] = (), range_rows: int | None = None) -> DataFrame:
    """Marks rows whose loss is strictly lower than all before."""
    held = "best so far"
    return scan(df, [order], loss, "least", held, by, range_rows).withColumn("is_best", F.coalesce(F.col(loss) < F.col(held), F.col(loss).isNotNull())).drop(held)


def next_flagged(items: DataFrame, group: str, index: str, flagged: Column, range_rows: int | None = None) -> DataFrame:
    """For each item, the next flagged item of its group in circular order; the item itself comes last."""
    marked = items.withColumn("flagged at", F.when(flagged, F.col(index)))
    # the least index of those before an item, backwards: one pass, and large groups are spread over tasks
    after = scans(marked, [index], {"flagged after": ("flagged at", "least")}, [group], range_rows, backwards=True)
    first = marked.groupBy(F.col(group).alias("flagged group")).agg(F.min("flagged at").alias("first flagged"))
    joined = after.join(first, F.col(group).eqNullSafe(F.col("flagged group")))
    return joined.select(*items.columns, F.coalesce("flagged after", "first flagged").alias("next_index"))


def marks(nodes: DataFrame) -> DataFrame:
    """0-based mark ids in the order of an image's nodes."""
    return nodes.withColumn("mark_id", F.row_number().over(Window.partitionBy("image_id").orderBy("place", "ord")) - 1)


def deduplicated_clicks(clicks: DataFrame, session: str, order: str) -> DataFrame:
    """Clicks that differ from the one before."""
    w = Window.partitionBy(session).orderBy(order)
    same = F.col("x").eqNullSafe(F.lag("x").over(w)) & F.col("y").eqNullSafe(F.lag("y").over(w)) & F.lag(F.lit(True)).over(w).isNotNull()
    return clicks.withColumn("__same", same).where(~F.col("__same")).drop("__same")


def content_dedup(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """The least key of each digest, and the number of rows that share it."""
    return df.groupBy(digest.alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n"))
