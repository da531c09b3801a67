"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A spaced seed is a fixed mask over a window of tokens: positions marked 1 are
hashed, those marked 0 are ignored, so a substitution that falls on a 0 still
hits.  Every window of every document is hashed under each mask inside one
generated-code stage (explode, hash, probe) and probed against the hashes of the
benchmark; a hit fixes a document, an item and an alignment (diagonal).  Neither
texts nor windows are shuffled: only hits are, without their tokens.  Each distinct
alignment is then verified against the tokens of its document and item: some
ungapped stretch of it must match enough tokens and agree in a share of its
length.  Of all such stretches the one that matches most counts.

What is broadcast is hash, item number and place of a seed, so a long item costs no
more than its seeds.  Benchmarks of any size are handled in blocks: each block's
hashes stay under ``block_seeds`` rows, which bounds the bytes that are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, without_ids, written

#: Masks over 9, 10 and 11 tokens with six hashed positions each.
MASKS = ("110101011", "1101001101", "11001010011")


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null or none give an empty array."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def _window_hash(mask: str, tokens: str, at: Column) -> Column:
    picked = [F.get(F.col(tokens), at + k) for k, c in enumerate(mask) if c == "1"]
    return F.xxhash64(F.lit(len(mask)), *picked)


def _whole_hash(tokens: Column, length: Column) -> Column:
    return F.xxhash64(-length, F.array_join(tokens, " "))


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(h, item, at): each window hash of each item of (item, item_tokens).

    Items shorter than the longest mask have one seed, of the whole item.
    """
    longest = max(map(len, masks))
    size = F.size("item_tokens")
    windows = (
        items.where(size >= longest)
        .select("item", "item_tokens", F.explode(F.sequence(F.lit(0), size - min(map(len, masks)))).alias("at"))
        .select("item", "at", F.explode(F.array(*[F.when(F.col("at") + len(m) <= size, _window_hash(m, "item_tokens", F.col("at"))) for m in masks])).alias("h"))
        .where("h is not null")
    )
    short = items.where((size > 0) & (size < longest)).select("item", F.lit(0).alias("at"), _whole_hash(F.col("item_tokens"), size).alias("h"))
    return windows.unionByName(short).select("h", "item", "at")


def _document_seeds(docs: DataFrame, masks: tuple[str, ...], short_lengths: list[int]) -> DataFrame:
    """(doc_id, doc_tokens, pos, h) for (doc_id, doc_tokens); lazily, inside the generated code of the probe."""
    size = F.size("doc_tokens")
    fewest = min([*map(len, masks), *short_lengths])
    pos = F.col("pos")
    hashes = [F.when(pos + len(m) <= size, _window_hash(m, "doc_tokens", pos)) for m in masks]
    hashes += [F.when(pos + n <= size, _whole_hash(F.slice(F.col("doc_tokens"), pos + 1, n), F.lit(n))) for n in short_lengths]
    # A condition here, not a filter: a filter would be pushed down and split every text twice.
    places = F.when(size >= fewest, F.sequence(F.lit(0), size - fewest))
    return (
        docs.select("doc_id", "doc_tokens", F.explode(places).alias("pos"))
        .select("doc_id", "doc_tokens", "pos", F.explode(F.array(*hashes)).alias("h"))
        .where("h is not null")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _best_stretch(matches: Column, min_identity: float) -> Column:
    """struct(hit, length) of the stretch with most matches of all that agree in ``min_identity`` of their length; the shortest of those.

    From the k-th to the l-th match, at places p, a stretch has l - k + 1 matches in
    p[l] - p[k] + 1 tokens, so it agrees enough where low[k] = k - share * p[k] is at
    most high[l] = l + 1 - share * (p[l] + 1).  The most matches are found in one walk
    over the least low up to k and the largest high from l on.
    """
    share, near = F.lit(min_identity), F.lit(1e-9)
    places = F.filter(F.transform(matches, lambda hit, i: F.when(hit, i)), lambda i: i.isNotNull())

    def most(p: Column) -> Column:
        low = F.transform(p, lambda x, k: k - share * x)
        high = F.transform(p, lambda x, k: k + 1 - share * (x + 1))
        least = _let(low, lambda a: F.transform(a, lambda x, k: F.array_min(F.slice(a, 1, k + 1))))
        largest = _let(high, lambda a: F.transform(a, lambda x, k: F.array_max(F.slice(a, k + 1, F.size(a)))))

        def walk(both: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                grows = F.get(both["largest"], at["l"]) >= F.get(both["least"], at["k"]) - near
                return (
                    F.when((at["l"] >= F.size(p)) | (at["k"] >= F.size(p)), at)
                    .when(grows, F.struct(at["k"].alias("k"), (at["l"] + 1).alias("l"), F.greatest(at["hit"], at["l"] - at["k"] + 1).alias("hit")))
                    .otherwise(F.struct((at["k"] + 1).alias("k"), at["l"].alias("l"), at["hit"].alias("hit")))
                )

            zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("l"), F.lit(0).alias("hit"))
            return F.aggregate(F.sequence(F.lit(1), 2 * F.size(p)), zero, step)["hit"]

        return _let(F.struct(least.alias("least"), largest.alias("largest")), walk)

    def shortest(p: Column, hit: Column) -> Column:
        spans = F.transform(F.slice(p, 1, F.size(p) - hit + 1), lambda x, k: F.get(p, k + hit - 1) - x + 1)
        return F.struct(hit.alias("hit"), F.array_min(spans).alias("length"))

    return _let(places, lambda p: F.when(F.size(p) > 0, _let(most(p), lambda hit: shortest(p, hit))))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_tokens: int = 13,
    min_identity: float = 0.8,
    block_seeds: int = 400_000,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Verified overlaps: id, item_id, doc_start, matched, length, item_tokens, covers.

    One row per document and item, of the best alignment: ``matched`` of
    ``length`` aligned tokens agree, from token ``doc_start`` on; ``covers`` is
    the matched share of the item.  An overlap counts when it matches at least
    ``min_tokens`` tokens (all of a shorter item) and ``min_identity`` of its
    length; every stretch of an alignment is considered, of which the one with most
    matches, then the shortest, is reported.  Null and empty texts, on either side, overlap nothing; repeated rows
    give the row of their id once; a null id overlaps nothing; ties go to the first alignment.  Extra columns
    are ignored; an empty table on either side gives an empty result.
    """
    items = (
        columns_of(benchmark, item_col, item_text_col)
        .select(F.col(f"`{item_col}`").alias("item_id"), tokens_of(F.col(f"`{item_text_col}`")).alias("item_tokens"))
        .where(F.size("item_tokens") > 0)
        .dropDuplicates()
    )
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    longest = max(map(len, masks))
    # Items are dealt to blocks by their seeds, so that each block broadcasts a bounded table.
    sizes = items.agg(
        F.sum(F.size("item_tokens") * len(masks)).alias("seeds"),
        F.array_sort(F.collect_set(F.when(F.size("item_tokens") < longest, F.size("item_tokens")))).alias("short"),
    ).first()
    blocks = max(1, -(-(sizes["seeds"] or 0) // block_seeds))
    rows = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seeds = written(benchmark_seeds(items, masks).withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks))), "benchmark-seeds")
    probes = _document_seeds(rows.select("doc_id", tokens_of(F.col("text")).alias("doc_tokens")), masks, list(sizes["short"] or []))

    def hits(block: int) -> DataFrame:
        own = F.broadcast(seeds.where(F.col("block") == block).drop("block"))  # block_seeds rows of three numbers, or little more
        return probes.join(own, "h").select("doc_id", "item", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()

    found = written(reduce(DataFrame.unionByName, [hits(b) for b in range(blocks)]).distinct(), "hits")
    # Only documents with a hit are cut into tokens again.
    few = found.count() <= broadcast_rows
    ids = found.select("doc_id").distinct()
    again = rows.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", tokens_of(F.col("text")).alias("doc_tokens"))
    aligned = again.join(F.broadcast(found) if few else found, "doc_id").join(items, "item")
    size, first = F.size("item_tokens"), F.greatest(F.col("diagonal"), F.lit(0))
    # A text that shares its id with another may be shorter than the place that the other was hit at.
    under = F.slice("doc_tokens", first + 1, F.greatest(size - (first - F.col("diagonal")), F.lit(0)))
    start = F.greatest(-F.col("diagonal"), F.lit(0))
    matches = F.zip_with(F.col("under"), F.slice(F.col("item_tokens"), start + 1, F.size("under")), lambda a, b: a.eqNullSafe(b))
    aligned = aligned.select("doc_id", "item_id", "item_tokens", "diagonal", under.alias("under"))
    scored = aligned.select(
        "doc_id", "item_id", F.greatest(F.col("diagonal"), F.lit(0)).alias("doc_start"), size.alias("item_tokens"), _best_stretch(matches, min_identity).alias("best")
    ).where(F.col("best.hit") >= F.least(F.lit(min_tokens), F.col("item_tokens")))
    rank = F.struct(F.col("best.hit").alias("hit"), -F.col("best.length"), -F.col("doc_start"))
    return (
        scored.groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("doc_start", F.col("best.hit").alias("matched"), F.col("best.length").alias("length"), "item_tokens"), rank).alias("o"))
        .select(F.col("doc_id").alias(id_col), "item_id", "o.*", (F.col("o.matched") / F.col("o.item_tokens")).alias("covers"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows whose id overlaps the benchmark; rows with a null id stay."""
    return without_ids(docs, overlaps(docs, benchmark, id_col=id_col, **how).select(f"`{id_col}`"), id_col)
