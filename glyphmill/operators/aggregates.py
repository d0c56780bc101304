"""Summaries: evaluation, progress, review states, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import let


def gate_scores(records: DataFrame, ok: Column, scores: list[str], reason: str = "skipped: compile failed") -> DataFrame:
    """Records that failed get no scores and a reason."""
    return records.withColumns({c: F.when(ok, F.col(c)) for c in scores} | {"rationale": F.when(~ok, F.lit(reason))})


def evaluation(records: DataFrame, ok: Column, scores: list[str], by: list[str] = ()) -> DataFrame:
    """Counts, share that compiled (0 without records), and for each score the mean and number of those that aren't null."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_compiled"), F.coalesce(F.try_divide(F.count_if(ok), F.count(F.lit(1))), F.lit(0.0)).alias("compile_rate")]
    for c in scores:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.count(c).alias(f"n_{c}")]
    return records.groupBy(*by).agg(*aggs)


def progress(samples: DataFrame, annotator: str, done: Column) -> DataFrame:
    """Done rows by annotator, with the number of all samples."""
    total = samples.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("total_done"))
    return samples.where(done).groupBy(annotator).agg(F.count(F.lit(1)).alias("done")).join(F.broadcast(total))  # one row


def state_counts(instances: DataFrame, key: str, states: list[str]) -> DataFrame:
    """For each image, the number of instances in each state."""
    return instances.groupBy(key).agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states], F.count(F.lit(1)).alias("n"))


def review_totals(counts: DataFrame, terminal: list[str]) -> DataFrame:
    """Totals over images that have any instance in a terminal state."""
    any_done = sum((F.col(f"n_{s}") for s in terminal[1:]), F.col(f"n_{terminal[0]}")) > 0
    return counts.where(any_done).agg(F.count(F.lit(1)).alias("images"), *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"total_{s}") for s in terminal])


#: Bounds of a histogram of values, and rows whose values one buffer may hold.
BOUNDS, AT_ONCE = 1000, 1_000_000


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] = (), bounds: int = BOUNDS) -> DataFrame:
    """Exact quantiles of each group, between the two values next to a rank where it lies between them: (*by, n, q0, q1, ...).

    A sketch gives ``bounds`` bounds; rows between them are counted, which
    tells the bucket that holds a rank; then only the values of such buckets
    are counted one by one.  No task and no buffer holds a group's values.
    """
    v = F.col(column).cast("double")
    values = df.select(*by, v.alias("__v")).where(v.isNotNull())
    wide = values.groupBy(*by).agg(F.percentile_approx("__v", F.array(*[F.lit(k / bounds) for k in range(1, bounds)]), F.lit(10 * bounds)).alias("__bounds"))
    # a row for each group
    placed = _beside(values, wide, by).withColumn("__bucket", _bucket(F.col("__bounds"), F.col("__v"))).drop("__bounds")
    buckets = placed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    running = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = buckets.withColumns({"__before": F.coalesce(F.sum("__rows").over(running), F.lit(0)), "n": F.sum("__rows").over(Window.partitionBy(*by))})
    # a rank's two neighbours, counted from 0
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    ranks = F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)])
    holding = counted.where(F.exists(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__rows"))))
    inside = _beside(placed, holding.select(*by, "__bucket", "__before", "n"), [*by, "__bucket"]).groupBy(*by, "__bucket", "__before", "n", "__v").agg(F.count(F.lit(1)).alias("__same"))
    upto = Window.partitionBy(*by, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    valued = inside.withColumn("__end", F.col("__before") + F.sum("__same").over(upto))
    here = lambda r: F.max(F.when((r >= F.col("__end") - F.col("__same")) & (r < F.col("__end")), F.col("__v")))
    found = valued.groupBy(*by, "n").agg(*[here(f(a).cast("long")).alias(f"__{name}{k}") for k, a in enumerate(at) for name, f in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(*by, "n", *[(F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * (a - F.floor(a))).alias(f"q{k}") for k, a in enumerate(at)])


def _bucket(bounds: Column, v: Column) -> Column:
    """Number of bounds up to a value, by halving."""
    low = F.lit(0)
    for step in (1 << k for k in range(BOUNDS.bit_length() - 1, -1, -1)):
        low = let(low, lambda at, step=step: F.when(F.coalesce(F.get(bounds, at + (step - 1)) <= v, F.lit(False)), at + step).otherwise(at))
    return low


def _beside(rows: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the row that ``one`` has for their group; a group's name may be null."""
    if not by:
        return rows.join(F.broadcast(one))  # one row
    other = one.select(*[F.col(c).alias(f"its {c}") for c in by], *[c for c in one.columns if c not in by])
    meets = F.lit(True)
    for c in by:
        meets = meets & F.col(c).eqNullSafe(F.col(f"its {c}"))
    return rows.join(other, meets).drop(*[f"its {c}" for c in by])


def validation(scores: DataFrame, column: str, levels: tuple[float, ...] = (0.5, 0.7, 0.9), by: list[str] = ()) -> DataFrame:
    """Mean, exact median and share at or above each level; the median of more than ``AT_ONCE`` rows in all is found by ``quantiles``."""
    v = F.col(column)
    means = scores.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), *[F.avg((v >= t).cast("int")).alias(f"share_{round(t * 100)}") for t in levels])
    if scores.count() <= AT_ONCE:
        return scores.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), *[F.avg((v >= t).cast("int")).alias(f"share_{round(t * 100)}") for t in levels])
    middle = quantiles(scores, column, [0.5], by).select(*by, F.col("q0").alias("median"))
    if not by:
        return means.join(middle, how="left").select("n", "mean", "median", *means.columns[2:])
    other = middle.select(*[F.col(c).alias(f"its {c}") for c in by], "median")
    meets = F.lit(True)
    for c in by:
        meets = meets & F.col(c).eqNullSafe(F.col(f"its {c}"))
    return means.join(other, meets, "left").select(*by, "n", "mean", "median", *means.columns[len(by) + 2 :])


def sizes(diagrams: DataFrame, parts: tuple[str, ...] = ("blocks", "nodes", "rasters", "arrows")) -> DataFrame:
    """Number of parts of each diagram."""
    return diagrams.select("image_id", *[F.size(p).alias(f"n_{p}") for p in parts])


def keep_gate(score: Column, least: float = 4) -> Column:
    """A score that is there and high enough."""
    return F.coalesce(score >= least, F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * 100, whole)), F.lit(0)).cast("int")


def counters(rows: DataFrame, flags: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Rows done, and how many of them each flag holds for; parts of shards add up."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_done"), *[F.count_if(f).alias(n) for n, f in flags.items()])


def epoch_losses(steps: DataFrame) -> DataFrame:
    """Mean loss of each epoch, from its steps (epoch, loss)."""
    return steps.groupBy("epoch").agg(F.avg("loss").alias("mean_loss"))
