"""Orders over a whole table without a task that holds it: slices by splitters, running totals, exact quantiles, runs.

Splitters are approximate quantiles of the order, a bounded row for each key, found by
an aggregate.  Rows are dealt into the slices between them; a slice is sorted in one task,
and what the slices before it hold is added from a small table of slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sliced(df: DataFrame, by: Sequence[str], order: str, slices: int = 64) -> DataFrame:
    """Adds ``_slice``, 0 to ``slices`` - 1, which does not fall as the number ``order`` rises within ``by``.

    Equal numbers share a slice, so an order with few distinct numbers has no more slices than these.
    """
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = df.groupBy(*by).agg(F.percentile_approx(F.col(order), shares, F.lit(100 * slices)).alias("_cuts"))
    joined = df.join(cuts, list(by)) if by else df.crossJoin(F.broadcast(cuts))  # without keys: one row
    place = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return joined.withColumn("_slice", F.coalesce(place, F.lit(0))).drop("_cuts")


def running_total(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str], amount: str, slices: int = 64) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows of the same key ahead of this one, by ``order``, then ``ties``, ascending."""
    rows = sliced(df, by, order, slices)
    held = rows.groupBy(*by, "_slice").agg(F.sum(amount).alias("_held"))
    ahead = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(*by, "_slice", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_ahead"))
    own = W.partitionBy(*by, "_slice").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    within = rows.withColumn("_own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return within.join(held, [*by, "_slice"]).select(*df.columns, (F.col("_ahead") + F.col("_own")).alias("before"))


def quantiles(df: DataFrame, by: Sequence[str], column: str, shares: Sequence[float], slices: int = 64) -> DataFrame:
    """(by, q0, q1, ...): exact interpolated quantiles of the known finite values, in the plan.

    Keys without any are left out; without ``by`` there is one row, of nulls where no value is known.

    Equal values are counted first, so a value that most rows have is one row.  Only
    the slices that hold a wanted place are sorted, each in a task of its own.
    """
    by = list(by)
    value = F.col(column).cast("double")
    known = df.select(*by, F.when(F.abs(value) < float("inf"), value).alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    counted = sliced(known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), by, "_v", slices)
    held = counted.groupBy(*by, "_slice").agg(F.sum("_n").alias("_held"))
    ahead = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("_ahead", F.coalesce(F.sum("_held").over(ahead), F.lit(0))).withColumn("_total", F.sum("_held").over(W.partitionBy(*by)))
    at = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), f(at(q)).cast("long").alias("place"), at(q).alias("exact")) for i, q in enumerate(shares) for f in (F.floor, F.ceil)])
    places = held.select(*by, "_slice", "_ahead", "_held", F.inline(wanted)).where("place >= _ahead AND place < _ahead + _held").select(*by, "_slice", "_ahead", "i", "place", "exact").distinct()
    own = W.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    some = counted.join(places.select(*by, "_slice", "_ahead").distinct(), [*by, "_slice"])
    numbered = some.withColumn("_first", F.col("_ahead") + F.coalesce(F.sum("_n").over(own), F.lit(0))).drop("_ahead")
    hit = numbered.join(places, [*by, "_slice"]).where("place >= _first AND place < _first + _n")
    ends = hit.groupBy(*by, "i").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max(F.col("exact") - F.floor("exact")).alias("part"))
    each = ends.withColumn("q", F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo")))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))])


def runs_in_slices(samples: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, value: str, length: str, large: int = 100_000, slices: int = 64) -> DataFrame:
    """Gaps and islands of keys of any length: consecutive rows of one non-null value as one row: keys, run, value, samples, run_length.

    ``at`` is a number that does not fall along ``order``.  A key of more than ``large`` rows is dealt
    into ``slices`` by it: rows are merged to pieces within a slice, and pieces, whose ends
    touch, over the slices.  ``run`` numbers all runs, those of null included, from 1.
    """
    keys, order = list(keys), list(order)
    placed = samples.withColumn("_at", at)
    many = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).drop("_n")
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = placed.join(many, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("_at", shares, F.lit(100 * slices)).alias("_cuts"))
    slice_of = F.coalesce(F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col("_at")))), F.lit(0))
    samples = placed.join(cuts, keys, "left").withColumn("_slice", slice_of).drop("_cuts", "_at")
    own = W.partitionBy(*keys, "_slice").orderBy(*order)
    new = F.when(F.row_number().over(own) == 1, 1).otherwise((~F.lag(value).over(own).eqNullSafe(F.col(value))).cast("int"))
    marked = samples.withColumn("_new", new).withColumn("_piece", F.sum("_new").over(own))
    pieces = marked.groupBy(*keys, "_slice", "_piece").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_length"))
    # Only the pieces at the ends of a slice can touch those of another.
    sizes = pieces.groupBy(*keys, "_slice").agg(
        F.max("_piece").alias("_pieces"), F.min_by(F.struct(F.col(value).alias("v")), "_piece").alias("_first"), F.max_by(F.struct(F.col(value).alias("v")), "_piece").alias("_last")
    )
    along = W.partitionBy(*keys).orderBy("_slice")
    touches = F.coalesce(F.lag("_last").over(along).eqNullSafe(F.col("_first")) & F.lag("_last").over(along).isNotNull(), F.lit(False))
    sizes = sizes.withColumn("_touch", touches.cast("int"))
    ahead = F.coalesce(F.sum(F.col("_pieces") - F.col("_touch")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_slice", (ahead - F.col("_touch")).alias("_ahead"))
    numbered = pieces.join(sizes, [*keys, "_slice"]).withColumn("run", (F.col("_ahead") + F.col("_piece")).cast("long"))
    return numbered.where(F.col(value).isNotNull()).groupBy(*keys, "run", value).agg(F.sum("_n").alias("samples"), F.sum("_length").alias("run_length"))
