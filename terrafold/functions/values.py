"""Column expressions on single values: null-preserving arithmetic, ladders, keys and parsers.

Missing is never zero: every function keeps null as null unless it says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrafold.session import workers_import

# Weights, labels and speeds of the composite score.
FULL_WEIGHTS = {
    "tsunami_exposure": 25.0,
    "vulnerable_population": 20.0,
    "walking_accessibility": 25.0,
    "route_inundation_exposure": 15.0,
    "shelter_capacity_pressure": 15.0,
}
CORE_WEIGHTS = {k: w for k, w in FULL_WEIGHTS.items() if k != "shelter_capacity_pressure"}
LABELS = {
    "tsunami_exposure": "津波浸水曝露が大きい",
    "vulnerable_population": "65歳以上人口割合が高い",
    "walking_accessibility": "避難場所までの徒歩距離が長い",
    "route_inundation_exposure": "避難経路の津波浸水曝露が大きい",
    "shelter_capacity_pressure": "割当需要に対して避難場所の収容余力が小さい",
}
WALKING_SPEEDS = {"1_0": 1.0, "0_62": 0.62, "0_5": 0.5}
NULL_TOKENS = ("", "-", "*", "***")


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def to_number(c: Column, null_tokens: Sequence[str] = ()) -> Column:
    """Text as a finite number; the tokens, and what is no number, as null."""
    text = F.trim(c.cast("string"))
    # Java's forms such as 1d or 0x1p3 are no numbers here.
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    known = ~text.isin(list(null_tokens)) if null_tokens else F.lit(True)
    return finite(F.when(known & plain, text.try_cast("double")))


def clip_keep_null(c: Column, low: float, high: float) -> Column:
    """``c`` within the bounds; ``least`` and ``greatest`` alone would turn null into a bound."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def minmax_0_100(c: Column, low: Column, high: Column) -> Column:
    return clip_keep_null((c - low) / (high - low) * 100.0, 0.0, 100.0)


def safe_ratio(num: Column, den: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(den > 0, num / den)


def ladder(*steps: tuple[Column, str], default: str | None = None) -> Column:
    """The label of the first step that holds."""
    first, *rest = steps
    chained = reduce(lambda acc, s: acc.when(s[0], F.lit(s[1])), rest, F.when(first[0], F.lit(first[1])))
    return chained.otherwise(F.lit(default))


def snap_status(distance: Column) -> Column:
    return ladder((distance.isNull(), "missing"), (distance <= 100, "normal"), (distance <= 250, "review"), (distance <= 500, "warning"), default="critical")


def capacity_status(capacity: Column) -> Column:
    return ladder((capacity.isNull(), "missing"), (capacity > 0, "available"), default="invalid")


def route_status(gap: Column, candidates: Column, snapped: Column, reached: Column) -> Column:
    """Why a route is missing, the first reason that holds, or complete."""
    return ladder(
        (gap, "network_coverage_gap"),
        (candidates == 0, "no_candidate_in_aoi"),
        (snapped == 0, "all_candidates_snap_excluded"),
        (~reached, "no_network_path"),
        default="complete",
    )


def snap_outlier(status: Column) -> Column:
    """Whether a snap is to be looked at: far, very far or a gap."""
    return F.coalesce(status.isin("warning", "critical", "network_coverage_gap"), F.lit(False))


def data_quality(inconsistent: Column, missing: Column) -> Column:
    """``partial`` where ages are missing or contradict each other, else ``complete``."""
    return F.when(F.coalesce(inconsistent, F.lit(False)) | missing, "partial").otherwise("complete")


def score_status(ready: Column, core: Column, full: Column) -> Column:
    return ladder((~ready, "route_unavailable"), (core.isNull(), "core_data_incomplete"), (full.isNull(), "core_only_missing_capacity"), default="complete")


def walking_minutes(distance: Column) -> list[Column]:
    return [(distance / speed / 60.0).alias(f"walking_minutes_{name}") for name, speed in WALKING_SPEEDS.items()]


def weighted_score(components: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean in the weights' order; null if any component is: weights are not renormalised."""
    total = reduce(lambda a, b: a + b, (components[k] * F.lit(w) for k, w in weights.items()))
    return clip_keep_null(total / F.lit(float(sum(weights.values()))), 0.0, 100.0)


def completeness(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns)) / float(len(columns))


def sum_all_or_null(c: Column) -> Column:
    """Sum over a group; null if any value of it is missing or it is empty."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(c)), F.sum(c))


def row_sum_or_null(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def any_null(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, (c.isNull() for c in columns))


def age_consistency(total: Column, over65: Column, over75: Column) -> tuple[Column, Column, Column]:
    """(65+, 75+, inconsistent): both null where known counts contradict each other."""
    wrong = F.coalesce((over65 > total) | (over75 > over65) | (over75 > total), F.lit(False)) & ~any_null([total, over65, over75])
    return F.when(~wrong, over65), F.when(~wrong, over75), wrong


def truthy(c: Column) -> Column:
    """``true`` in any case; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def nullable_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def normal_code(c: Column) -> Column:
    """A code without the ``.0`` that a float column gave it; blank is null."""
    return F.regexp_replace(nullable_text(c), r"^(\d+)\.0$", "$1")


def code_from_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"^E(\d{5})", 1), F.lit(""))


def code_from_city(c: Column, codes: Mapping[str, str]) -> Column:
    """Exact name, else the first name, in the mapping's order, that the text without spaces contains."""
    text = F.regexp_replace(c.cast("string"), r"[\s　]+", "")
    exact = [F.when(text == name, F.lit(code)) for name, code in codes.items()]
    held = [F.when(F.contains(text, F.lit(name)), F.lit(code)) for name, code in codes.items()]
    return F.coalesce(*exact, *held)


@F.pandas_udf(StringType())
def _normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def _nfkc(c: Column) -> Column:
    workers_import(SparkSession.active())
    return _normalize(c)


# The characters that a join key leaves out.
KEY_SKIPS = r"[\s　,，、。．・()（）「」『』\-‐‑‒–—ー_/／]+"
#: White space as Unicode has it, and the four separators that count as such in text.
SPACE = r"[\s\x1c-\x1f]"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def norm_text(c: Column) -> Column:
    """NFKC and trimmed; null is empty."""
    return _stripped(_nfkc(F.coalesce(c.cast("string"), F.lit(""))))


def norm_key_ascii(c: Column) -> Column:
    """The join key of a text that needs no NFKC: spaces and the fixed signs out, lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "(?U)" + KEY_SKIPS.replace("\\s", "\\s\\x1c-\\x1f"), ""))


def norm_key(c: Column) -> Column:
    return norm_key_ascii(_nfkc(F.coalesce(c.cast("string"), F.lit(""))))


def identity_key(ident: Column, name: Column) -> Column:
    """Both parts normalised and trimmed, so that full-width or padded forms are one identity."""
    return F.concat(norm_text(ident), F.lit("||"), norm_text(name))


def parse_capacity(c: Column) -> Column:
    """struct<value, status> of the normalised text: null missing; no leading number unparseable; not above zero nonpositive; else numeric or numeric_prefix."""
    text = norm_text(c)
    prefix = F.nullif(F.regexp_extract(text, r"^([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(""))
    value = F.regexp_replace(prefix, ",", "").try_cast("double")
    status = ladder((c.isNull(), "missing"), (value.isNull(), "unparseable"), (value <= 0, "nonpositive"), (text == prefix, "numeric"), default="numeric_prefix")
    return F.struct(F.when(value > 0, value).alias("value"), status.alias("status"))


def id_set(c: Column) -> Column:
    """The non-blank parts of a comma-separated list, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")))


def json_or_empty(c: Column) -> Column:
    """JSON text as it is, ``[]`` for null, blank or malformed text."""
    text = F.trim(c.cast("string"))
    # Every JSON value parses as a variant; what does not is null.
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise("[]")


def tri_state(c: Column) -> Column:
    """``true``, ``1`` and ``yes`` are true, other text false; null stays null."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")


def first_coordinates(new: Column, old: Column) -> Column:
    """Coordinates of the new column, or, where it is null or empty text, of the old one."""
    return parse_coordinates(F.coalesce(F.nullif(new, F.lit("")), old))


def parse_coordinates(c: Column) -> Column:
    """A JSON array of [lon, lat, ...], as pairs; anything malformed or not finite anywhere makes it empty."""
    parsed = F.from_json(c, "array<array<double>>")
    finite_pair = lambda p: F.forall(F.slice(p, 1, 2), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.forall(parsed, lambda p: (F.size(p) >= 2) & finite_pair(p))
    pairs = F.transform(parsed, lambda p: F.slice(p, 1, 2))
    return F.when(F.coalesce(good, F.lit(False)), pairs).otherwise(F.expr("CAST(array() AS array<array<double>>)"))


def reasons(components: Mapping[str, Column], weights: Mapping[str, float] = FULL_WEIGHTS) -> Column:
    """array<struct<key, label, component_score, weighted_contribution>> of the known components, largest contribution first; ties in the weights' order."""
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(k).alias("key"),
                F.lit(LABELS[k]).alias("label"),
                F.round(components[k], 3).alias("component_score"),
                F.round(components[k] * (w / 100.0), 3).alias("weighted_contribution"),
            )
            for i, (k, w) in enumerate(weights.items())
        ]
    )
    known = F.filter(items, lambda x: x["component_score"].isNotNull())
    ordered = F.array_sort(
        known,
        lambda a, b: F.when(a["weighted_contribution"] > b["weighted_contribution"], -1)
        .when(a["weighted_contribution"] < b["weighted_contribution"], 1)
        .otherwise(a["place"] - b["place"]),
    )
    return F.transform(ordered, lambda x: x.dropFields("place"))


def demand_units(c: Column, scale: int = 10) -> Column:
    """Fixed-point units, half to even, not below zero; a missing demand stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.bround(c * scale, 0)).cast("long"))


def capacity_units(c: Column, scale: int = 10) -> Column:
    """Whole units, with a billionth of slack for what floats lose; a missing capacity stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.floor(c * scale + 1e-9)).cast("long"))


def walk_cost(distance: Column, rank: Column, scale: int = 10, ties: int = 100) -> Column:
    return (F.bround(distance * scale, 0).cast("long") * ties + F.greatest(F.lit(0), F.least(rank, F.lit(ties - 1)))).cast("long")
