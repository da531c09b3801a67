"""Quality gates: named checks of a stage, evaluated together, and a comparison of nested results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A check: rows of ``frame`` (those where ``failing`` holds, or all) are failures; more than ``allowed`` fail it."""

    name: str
    frame: DataFrame
    failing: Column | None = None
    severity: str = "failure"
    allowed: int = 0


def evaluate(gates: Sequence[Gate]) -> DataFrame:
    """(gate, severity, failures, passed); gates over one frame are counted in one pass over it."""
    by_frame: dict[int, list[Gate]] = {}
    for g in gates:
        by_frame.setdefault(id(g.frame), []).append(g)
    parts = []
    for group in by_frame.values():
        counts = [F.count_if(F.coalesce(g.failing, F.lit(False)) if g.failing is not None else F.lit(True)).alias(f"n{i}") for i, g in enumerate(group)]
        rows = F.array(
            *[
                F.struct(F.lit(g.name).alias("gate"), F.lit(g.severity).alias("severity"), F.col(f"n{i}").alias("failures"), (F.col(f"n{i}") <= g.allowed).alias("passed"))
                for i, g in enumerate(group)
            ]
        )
        parts.append(group[0].frame.agg(*counts).select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def require(gates: Sequence[Gate]) -> None:
    """Evaluate the gates, now; an error names the failing ones that are not warnings."""
    failed = evaluate(gates).where("NOT passed AND severity = 'failure'").orderBy("gate").collect()
    if failed:
        raise ValueError("; ".join(f"{r['gate']}: {r['failures']}" for r in failed))


def summary(results: DataFrame) -> DataFrame:
    """One row for results of :func:`evaluate`: status (failure if any gate failed), failures and warnings."""
    failed = lambda severity: F.count_if(~F.col("passed") & (F.col("severity") == severity))
    return results.agg(
        F.when(failed("failure") > 0, "failure").otherwise("pass").alias("status"), failed("failure").alias("failure_count"), failed("warning").alias("warning_count")
    )


def expected_count(name: str, df: DataFrame, n: int) -> Gate:
    """A gate that fails unless ``df`` has ``n`` rows."""
    return Gate(name, df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n))


def set_equality(name: str, left: DataFrame, right: DataFrame, key: str) -> Gate:
    """A gate whose failures are the keys that only one side has."""
    one, other = left.select(key).distinct(), right.select(key).distinct()
    return Gate(name, one.join(other, key, "left_anti").unionByName(other.join(one, key, "left_anti")))


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "table") -> DataFrame:
    """Just ``columns``; an error names the missing ones."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")
    return df.select(*columns)


def subset_diff(expected: object, actual: object, abs_tol: float = 1e-6, rel_tol: float = 1e-12, at: str = "$") -> list[str]:
    """Where nested ``expected`` is not found in ``actual``; numbers within the tolerances are equal, further keys are ignored."""
    if isinstance(expected, dict):
        if not isinstance(actual, dict):
            return [f"{at}: not an object"]
        return [d for k, v in expected.items() for d in ([f"{at}.{k}: missing"] if k not in actual else subset_diff(v, actual[k], abs_tol, rel_tol, f"{at}.{k}"))]
    if isinstance(expected, list):
        if not isinstance(actual, list) or len(actual) != len(expected):
            return [f"{at}: lists differ in length"]
        return [d for i, (e, a) in enumerate(zip(expected, actual, strict=True)) for d in subset_diff(e, a, abs_tol, rel_tol, f"{at}[{i}]")]
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    if number(expected) and number(actual):
        return [] if math.isclose(expected, actual, abs_tol=abs_tol, rel_tol=rel_tol) else [f"{at}: {expected} != {actual}"]
    return [] if expected == actual and type(expected) is type(actual) else [f"{at}: {expected!r} != {actual!r}"]
