"""Joins, deduplication, ranking and set operators with fixed tie-breaks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.operators.gates import Gate, require, unique_key


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "m:1") -> tuple[DataFrame, list[Gate]]:
    """The join, and gates that its keys are unique where ``validate`` (1:1 or m:1) says so."""
    gates = [Gate(f"unique right {','.join(on)}", unique_key(right, on))]
    if validate == "1:1":
        gates.append(Gate(f"unique left {','.join(on)}", unique_key(left, on)))
    return left.join(right, list(on), how), gates


def replace_columns(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which the right side's columns take the place of the left side's of the same name."""
    return left.drop(*[c for c in right.columns if c not in on]).join(right, list(on), how)


def join_renamed(left: DataFrame, right: DataFrame, keys: dict[str, str], suffix: str, how: str = "left", validate: str | None = None) -> DataFrame:
    """Join on keys that have other names on the right, ``keys``: left to right; the right's other columns get ``suffix`` where the left has their name, its keys go.

    ``validate`` m:1 makes a right key that occurs more than once an error, now.
    """
    if validate == "m:1":
        require([Gate(f"unique right {','.join(keys.values())}", unique_key(right, list(keys.values())))])
    back = {b: a for a, b in keys.items()}
    side = right.select(*[F.col(c).alias(back[c] if c in back else f"{c}{suffix}" if c in left.columns else c) for c in right.columns])
    return left.join(side, list(keys), how)


def unique_only(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once and has no null: those that occur more often go altogether."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.where(known).join(once, list(keys), "left_semi")


def cascade_lookup(df: DataFrame, steps: Sequence[tuple[Sequence[str], DataFrame, str]], values: Sequence[str], method_col: str, unmatched: str = "unmatched") -> DataFrame:
    """``values`` from the first step whose unique key matches, with the step's label; every step is a left join."""
    out, hits = df, []
    for i, (keys, lookup, label) in enumerate(steps):
        hit = f"_hit{i}"
        side = unique_only(lookup.select(*keys, *values), keys).select(*keys, *[F.col(v).alias(f"_{i}_{v}") for v in values], F.lit(True).alias(hit))
        out = out.join(side, list(keys), "left")
        hits.append((F.col(hit), label))
    method = reduce(lambda acc, h: acc.when(h[0], F.lit(h[1])), hits[1:], F.when(hits[0][0], F.lit(hits[0][1]))).otherwise(F.lit(unmatched))

    def chosen(v: str) -> Column:
        first = F.when(hits[0][0], F.col(f"_0_{v}"))
        return reduce(lambda acc, i: acc.when(hits[i][0], F.col(f"_{i}_{v}")), range(1, len(hits)), first).alias(v)

    return out.select(*df.columns, *[chosen(v) for v in values], method.alias(method_col))


def resolver(df: DataFrame, reference: DataFrame, value: str, steps: Sequence[Sequence[str]]) -> DataFrame:
    """``value`` kept where known, else taken from the first key that stands for a single distinct value in ``reference``; adds ``value_source``."""
    out, options = df, [(F.col(value), F.lit("existing"))]
    for i, keys in enumerate(steps):
        single = (
            reference.where(F.col(value).isNotNull())
            .groupBy(*keys)
            .agg(F.count_distinct(value).alias("_n"), F.min(value).alias(f"_v{i}"))
            .where("_n = 1")
            .drop("_n")
        )
        out = out.join(single, list(keys), "left")
        options.append((F.col(f"_v{i}"), F.lit("+".join(keys))))
    source = reduce(lambda acc, o: acc.when(o[0].isNotNull(), o[1]), options[1:], F.when(options[0][0].isNotNull(), options[0][1]))
    kept = [F.coalesce(*[o[0] for o in options]).alias(value) if c == value else F.col(c) for c in df.columns]
    return out.select(*kept, source.otherwise(F.lit("unresolved")).alias("value_source"))


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ascending ``order``, nulls first: a minimum, taken on the map side before rows are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.`{c}`") for c in df.columns])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, ranked from 1."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def missing_extra(expected: DataFrame, actual: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys that lack, keys that should not be there)."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def rank_within(df: DataFrame, keys: Sequence[str], value: str, bucket: Column, tie: Column) -> DataFrame:
    """Adds ``rank`` (min-rank, largest value first) and ``place`` (ties by ``tie``) within each key.

    ``bucket`` is an integer that does not fall as the value rises.  Rows are
    ranked within their bucket, and what larger buckets hold is added, so a key
    with all rows is dealt over its buckets.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    above = W.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    own = W.partitionBy(*keys, "_bucket")
    ranked = marked.withColumn("rank", F.rank().over(own.orderBy(F.desc(value)))).withColumn("place", F.row_number().over(own.orderBy(F.desc(value), tie)))
    joined = ranked.join(sizes, [*keys, "_bucket"])
    plus = lambda c: (F.col(c) + F.col("_above")).cast("long").alias(c)
    return joined.select(*df.columns, plus("rank"), plus("place"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], buckets: int = 4096, gather: int = 10_000) -> list[float | None]:
    """Interpolated quantiles of the known finite values; None when there are none.  Runs jobs.

    Values are counted in equal steps between their extremes; the steps that hold
    a wanted place are counted again, until one holds ``gather`` values at most or
    only equal ones.  The driver gets that many numbers, however many rows there are.
    """
    known = df.select(F.col(column).cast("double").alias("v")).where("abs(v) < double('infinity')").persist()
    try:
        span = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        if not span["n"]:
            return [None] * len(shares)
        places = [q * (span["n"] - 1) for q in shares]
        found: dict[int, float] = {}
        work = [(span["lo"], span["hi"], 0, span["n"], sorted({f(p) for p in places for f in (math.floor, math.ceil)}))]
        while work:
            low, high, before, n, wanted = work.pop()
            part = known.where(F.col("v").between(low, high))
            if low == high:
                found.update(dict.fromkeys(wanted, low))
            elif n <= gather:
                values = sorted(r["v"] for r in part.collect())
                found.update({p: values[p - before] for p in wanted})
            else:
                step = F.least(F.lit(buckets - 1), F.floor((F.col("v") - low) / (high - low) * buckets))
                counted = part.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                for r in sorted(counted.collect(), key=lambda r: r["b"]):  # at most `buckets` rows
                    inside = [p for p in wanted if before <= p < before + r["n"]]
                    if inside:
                        work.append((r["lo"], r["hi"], before, r["n"], inside))
                    before += r["n"]
        return [found[math.floor(p)] + (p - math.floor(p)) * (found[math.ceil(p)] - found[math.floor(p)]) for p in places]
    finally:
        known.unpersist()


def rank_gaps(df: DataFrame, keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """Keys whose ranks are not 1..n or whose values fall as ranks rise."""
    w = W.partitionBy(*keys).orderBy(rank)
    seen = df.withColumn("_before", F.lag(value).over(w))
    checked = seen.groupBy(*keys).agg(
        F.max(rank).alias("max_rank"), F.count(F.lit(1)).alias("rows"), F.count_distinct(rank).alias("ranks"), F.count_if(F.col(value) < F.col("_before")).alias("falls")
    )
    return checked.where("max_rank <> rows OR ranks <> rows OR falls > 0")


def merge_runs(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: str) -> DataFrame:
    """Gaps and islands: consecutive rows of one non-null value as one row: keys, run, value, samples, length."""
    w = W.partitionBy(*keys).orderBy(*order)
    change = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    marked = samples.withColumn("_change", F.when(F.row_number().over(w) == 1, 1).otherwise(change)).withColumn("run", F.sum("_change").over(w))
    return (
        marked.where(F.col(value).isNotNull())
        .groupBy(*keys, "run", value)
        .agg(F.count(F.lit(1)).alias("samples"), F.sum(length).alias("run_length"))
    )


def parity(left: DataFrame, right: DataFrame, on: Sequence[str], identity: str, distance: str, tolerance: float) -> DataFrame:
    """Left rows with both sides' identity, whether they agree (null-safe) and whether distances do, too."""
    other = right.select(*on, F.col(identity).alias("_identity"), F.col(distance).alias("_distance"))
    joined = left.join(other, list(on), "left")
    return joined.select(
        *on,
        F.col(identity).eqNullSafe(F.col("_identity")).alias("identity_match"),
        (F.col(distance) - F.col("_distance")).alias("distance_delta"),
        F.coalesce(F.abs(F.col(distance) - F.col("_distance")) <= tolerance, F.col(distance).isNull() & F.col("_distance").isNull()).alias("distance_match"),
    )


def collapse_capacity(shelters: DataFrame, key: str, capacity: str, status: str, signature: str) -> DataFrame:
    """One row per identity: capacities add up (null if none is known), statuses joined, and whether it stands for several places."""
    return shelters.groupBy(key).agg(
        F.sum(capacity).alias("capacity"),
        F.count(F.lit(1)).alias("records"),
        F.array_join(F.sort_array(F.collect_set(status)), ";").alias("statuses"),
        (F.count_distinct(signature) > 1).alias("ambiguous"),
    )


def plan_overlap(left: DataFrame, right: DataFrame, key: str, added: str, budget: float) -> DataFrame:
    """One row: shelters of each plan and shared, their Jaccard index (1 for two empty plans), shared capacity and its share of the budget."""
    a = left.where(F.col(added) > 0).select(key, F.col(added).alias("_a"))
    b = right.where(F.col(added) > 0).select(key, F.col(added).alias("_b"))
    both = a.join(b, key, "full")
    out = both.agg(
        F.count("_a").alias("left_shelters"),
        F.count("_b").alias("right_shelters"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared_shelters"),
        F.count(F.lit(1)).alias("_union"),
        F.coalesce(F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.least("_a", "_b"))), F.lit(0.0)).alias("shared_capacity"),
    )
    return out.select(
        "left_shelters",
        "right_shelters",
        "shared_shelters",
        F.when(F.col("_union") > 0, F.col("shared_shelters") / F.col("_union")).otherwise(1.0).alias("shelter_jaccard"),
        "shared_capacity",
        F.least(F.lit(1.0), F.col("shared_capacity") / F.lit(max(budget, 1e-9))).alias("shared_capacity_share"),
    )
