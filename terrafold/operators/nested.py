"""Nested documents compared in the plan: flattened level by level to paths and values, joined, compared with tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves(docs: DataFrame, depth: int = 12) -> DataFrame:
    """(doc, path, above, kind, size, value) of every value within (doc, body), body JSON text.

    ``kind`` is object, array, number, text, truth or null; objects and arrays have rows of
    their own, arrays their ``size``; the others have their ``value`` as JSON text.  ``above``
    are the paths of what holds the value.  Levels are unrolled ``depth`` times; objects and arrays that lie deeper are an error.
    """
    level = docs.select("doc", F.lit("$").alias("path"), F.array().cast("array<string>").alias("above"), F.parse_json("body").alias("v"))
    out = None
    for n in range(depth + 1):
        shape = F.schema_of_variant("v")
        kind = (
            F.when(F.col("v").isNull() | F.is_variant_null("v"), "null")
            .when(shape.startswith("OBJECT"), "object")
            .when(shape.startswith("ARRAY"), "array")
            .when(shape == "STRING", "text")
            .when(shape == "BOOLEAN", "truth")
            .otherwise("number")
        )
        named = level.withColumn("kind", kind)
        size = F.when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>")))
        text = F.when(~F.col("kind").isin("object", "array", "null"), F.to_json("v"))
        rows = named.select("doc", "path", "above", "kind", size.alias("size"), text.alias("value"))
        if n == depth:
            deeper = F.raise_error(F.concat(F.lit(f"values lie deeper than {depth} levels at "), F.col("path")))
            rows = rows.withColumn("kind", F.when(F.col("kind").isin("object", "array"), deeper.cast("string")).otherwise(F.col("kind")))
        out = rows if out is None else out.unionByName(rows)
        inner = named.where("kind IN ('object', 'array')")
        each = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = each.select("doc", F.concat("path", name).alias("path"), F.array_append("above", F.col("path")).alias("above"), F.col("value").alias("v"))
    return out


def differences(expected: DataFrame, actual: DataFrame, abs_tol: float = 1e-6, rel_tol: float = 1e-12, depth: int = 12) -> DataFrame:
    """(doc, path, problem) where ``expected`` documents (doc, body) are not found in ``actual`` ones.

    Numbers within the tolerances are equal; further keys of actual objects don't count, lists
    must be as long; ``problem`` is missing, kind, length or value.  Below a value that is
    missing, of another kind, or a list of another length nothing more is reported.
    """
    want, have = leaves(expected, depth), leaves(actual, depth)
    have = have.select("doc", "path", *[F.col(c).alias(f"_{c}") for c in ("kind", "size", "value")])
    joined = want.join(have, ["doc", "path"], "left")
    number = lambda c: F.col(c).try_cast("double")
    larger = F.greatest(F.abs(number("value")), F.abs(number("_value")))
    near = F.abs(number("value") - number("_value")) <= F.greatest(F.lit(rel_tol) * larger, F.lit(abs_tol))
    problem = (
        F.when(F.col("_kind").isNull(), "missing")
        .when(F.col("kind") != F.col("_kind"), "kind")
        .when((F.col("kind") == "array") & (F.col("size") != F.col("_size")), "length")
        .when((F.col("kind") == "number") & ~F.coalesce(near, F.lit(False)), "value")
        .when(F.col("kind").isin("text", "truth") & (F.col("value") != F.col("_value")), "value")
    )
    found = joined.select("doc", "path", "above", problem.alias("problem")).where("problem IS NOT NULL")
    # The topmost problem of a branch stands for what lies below it.
    tops = found.where("problem <> 'value'").select("doc", F.col("path").alias("top"))
    hidden = found.select("doc", "path", F.explode("above").alias("top")).join(tops, ["doc", "top"], "left_semi").select("doc", "path").distinct()
    return found.join(hidden, ["doc", "path"], "left_anti").select("doc", "path", "problem")
