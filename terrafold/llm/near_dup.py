"""Near-duplicate documents by Order MinHash, candidates verified by banded alignment.

Two texts are near duplicates when the edit distance of their words is at most
``1 - threshold`` of the longer one's words.

A text's k-mers are its runs of five words, labelled by occurrence, so each is
unique in its text.  For each of ``bands`` hash functions the ``picked`` smallest
k-mers are taken and kept in the order of the text; the sequence is the band's
key.  Texts with equal keys are candidates: equal keys need the same k-mers in the
same order, which follows edit similarity, not just set similarity.

Links are found without forming all pairs of a bucket: every text is first held
against the smallest id of its buckets, components of those links are formed, and
in buckets that still have several, two more members are held against the rest.
Members of buckets that are mixed even then are compared inside the tasks, blocks
with blocks: counts of hashed words rule out most pairs many at a time, the others
are aligned, each pair in the first of the mixed buckets that it shares.

Texts of fewer than ``few`` words (and those long enough to be like one), whose keys
seldom agree, are joined exactly, by the rarest of their labelled pairs of words: of
two texts with n words at most that are alike, at least 0.6 n - 1 pairs are common,
so in one order of all pairs the first ones of both have one in common.

Classes are the connected components of all links, found by hooking to smaller
ids and written to the shared folder between rounds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, dropped, python_ready, without_ids, written

SKETCH = "id long, key string, words int, bands array<long>"
#: Cells that words are counted in: several times the words of a common text, so that few meet by chance.
CELLS = 1024
Batches = Iterator[pa.RecordBatch]


def codes_of(text: str) -> np.ndarray:
    """A hash of each lower-cased word, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(distinct, categorize=False)[codes]


def runs_of(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, labelled by occurrence, in order."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    if not fresh.all():
        starts = np.flatnonzero(fresh)
        label = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        h[order] = ranked ^ (label.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h


def sketch(kmers: np.ndarray, bands: int, picked: int) -> np.ndarray:
    """One key for each band from the ``picked`` smallest k-mers in the order of the text; none without k-mers."""
    if not len(kmers):
        return np.zeros(0, np.int64)
    # Odd multipliers: the k-mers are hashes already, so each product orders them anew.
    seeds = (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    seeds ^= (seeds >> np.uint64(23)) << np.uint64(1)
    out = np.zeros(bands, np.uint64)
    block = max(1, 200_000 // len(kmers))
    most = np.uint64(2**64 - 1)
    for at in range(0, bands, block):
        h = kmers[None, :] * seeds[at : at + block, None]
        each = np.arange(len(h))
        places = np.empty((len(h), min(picked, len(kmers))), np.int64)
        for column in range(places.shape[1]):
            places[:, column] = h.argmin(axis=1)
            h[each, places[:, column]] = most
        places.sort(axis=1)
        key = seeds[at : at + block].copy()
        for column in range(places.shape[1]):
            key = (key ^ kmers[places[:, column]]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[at : at + block] = key
    return out.view(np.int64)


def chain(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the longest chain of common k-mers, rising in both, whose places differ by at most ``band``."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    i, j = i[near][order], j[near][order]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, x in enumerate(j.tolist()):
        at = bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(x)
            ends.append(n)
        else:
            tails[at], ends[at] = x, n
    taken = [ends[-1]]
    while before[taken[-1]] >= 0:
        taken.append(before[taken[-1]])
    return i[taken[::-1]], j[taken[::-1]]


def distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two sequences if it is at most ``limit``, else ``limit`` + 1: rows of a band around the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return limit + 1
    # Cell o of row i is column i - limit + o.
    step = np.arange(2 * limit + 1)
    row = np.where(step >= limit, step - limit, limit + 1)
    column = np.full(2 * limit + len(a) + 1, -1, np.int64)
    codes, both = pd.factorize(np.concatenate([a, b]))
    column[limit : limit + len(b)] = codes[len(a) :][: len(column) - limit]
    for i in range(len(a)):
        new = row + (column[i : i + 2 * limit + 1] != codes[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
        if row.min() > limit:
            return limit + 1
    return min(int(row[len(b) - len(a) + limit]), limit + 1)


def within(a: np.ndarray, others: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Whether the edit distance of ``a`` to each of the others is at most its limit: :func:`distance` for all of them together."""
    sizes = np.array([len(b) for b in others])
    out, left = np.zeros(len(others), bool), np.flatnonzero(np.abs(sizes - len(a)) <= limits)
    if not len(left):
        return out
    # Texts side by side, cells of the band below each other: each step is over all texts.
    widest = int(limits[left].max())
    kind = np.int16 if 3 * (widest + len(a)) < 1 << 15 else np.int32
    step = np.arange(2 * widest + 1, dtype=kind)[:, None]
    known, own = np.unique(a, return_inverse=True)
    column = np.full((max(2 * widest + len(a) + 1, widest + int(sizes[left].max())), len(left)), -1, kind)
    for place, j in enumerate(left.tolist()):
        at = np.searchsorted(known, others[j])
        at[at == len(known)] = 0
        column[widest : widest + sizes[j], place] = np.where(known[at] == others[j], at, -1) if len(known) else -1
    row = np.repeat(np.where(step >= widest, step - widest, widest + 1).astype(kind), len(left), axis=1)
    for i, code in enumerate(own.tolist()):
        new = row + (column[i : i + len(step)] != code)
        np.minimum(new[:-1], row[1:] + kind(1), out=new[:-1])
        new -= step
        row = np.minimum.accumulate(new, axis=0)
        row += step
        if i % 8 == 7:
            alive = row.min(axis=0) <= limits[left]
            if not alive.all():
                left, row, column = left[alive], row[:, alive], column[:, alive]
                if not len(left):
                    return out
    out[left] = row[sizes[left] - len(a) + widest, np.arange(len(left))] <= limits[left]
    return out


class Text:
    """A text's words as hashes, their counts and, when needed, its k-mers."""

    def __init__(self, codes: np.ndarray, k: int) -> None:
        self.codes, self.k, self._kmers, self._pairs = codes, k, None, None
        self.distinct, self.times = np.unique(codes, return_counts=True)

    @property
    def kmers(self) -> np.ndarray:
        if self._kmers is None:
            self._kmers = runs_of(self.codes, self.k)
        return self._kmers

    @property
    def pairs(self) -> np.ndarray:
        """Labelled pairs of neighbouring words, sorted."""
        if self._pairs is None:
            self._pairs = np.sort(runs_of(self.codes, 2))
        return self._pairs


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def chained(a: Text, b: Text, limit: int) -> int:
    """Cost of the alignment through the longest chain of common k-mers; never less than the edit distance."""
    n, m, k = len(a.codes), len(b.codes), a.k
    i, j = chain(a.kmers, b.kmers, limit)
    if not len(i):
        return max(n, m)
    # Each k-mer pairs k words; of words that the one before has paired in either text it leaves out as many in both.
    gap_a, gap_b = i[1:] - i[:-1] - k, j[1:] - j[:-1] - k
    out = np.maximum(0, -np.minimum(gap_a, gap_b))
    between = np.maximum(gap_a, gap_b) + out
    return int(max(i[0], j[0]) + between.sum() + max(n - i[-1] - k, m - j[-1] - k))


def alike(a: Text, b: Text, threshold: float) -> bool:
    """Whether the edit distance of the words is at most 1 - ``threshold`` of the longer text's words."""
    longer = max(len(a.codes), len(b.codes))
    limit = int((1 - threshold) * longer + 1e-9)
    if longer - min(len(a.codes), len(b.codes)) > limit:
        return False
    _, i, j = np.intersect1d(a.distinct, b.distinct, assume_unique=True, return_indices=True)
    if longer - np.minimum(a.times[i], b.times[j]).sum() > limit:  # no alignment pairs more equal words than both have
        return False
    if in_common(a.pairs, b.pairs) < longer - 1 - 2 * limit:  # an edit takes two pairs at most from the longer text
        return False
    return chained(a, b, limit) <= limit or distance(a.codes, b.codes, limit) <= limit


def _sketch_batches(k: int, bands: int, picked: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            codes = [codes_of(t) for t in batch.column("content").to_pylist()]
            keys = [sketch(runs_of(x, k), bands, picked) for x in codes]
            columns = [pa.array(map(len, codes), pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *columns], names=["id", "key", "words", "bands"])

    return run


def _verify_batches(k: int, threshold: float) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            known: dict[str, Text] = {}
            linked = []
            for a, b in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True):
                for t in (a, b):
                    if t not in known:
                        known[t] = Text(codes_of(t), k)
                linked.append(alike(known[a], known[b], threshold))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _pair_batches(batches: Batches) -> Batches:
    """Labelled pairs of neighbouring words of each text."""
    for batch in batches:
        pairs = [runs_of(codes_of(t), 2).view(np.int64) for t in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("words"), pa.array(pairs, pa.list_(pa.int64()))], names=["id", "words", "pairs"])


def _code_batches(batches: Batches) -> Batches:
    """Texts as four-byte hashes of their words: enough to say which are not alike; links are verified on the words themselves."""
    for batch in batches:
        codes = [codes_of(t).astype(np.uint32).view(np.int32) for t in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("all_bands"), pa.array(codes, pa.list_(pa.int32()))], names=["id", "all_bands", "codes"])


def _texts(t: pa.Table, k: int) -> list[Text]:
    return [Text(np.array(x, np.int32).view(np.uint32).astype(np.uint64), k) for x in t.column("codes").to_pylist()]


def _counts(texts: list[Text], cells: int = CELLS) -> np.ndarray:
    """How many words of each text fall into each of ``cells``: the least of two texts' counts, added up, is no less than the words they have in common."""
    out = np.zeros((len(texts), cells), np.float32)
    for row, text in zip(out, texts, strict=True):
        row[:] = np.bincount((text.codes % np.uint64(cells)).astype(np.int64), minlength=cells)
    return out


def _met_before(base: pa.Table, asking: pa.Table) -> np.ndarray:
    """Which pairs (asking text, text of the block) share a bucket before this one, so that they are compared there: the same bucket is the first for both, whatever block they are in."""
    met = np.zeros((len(asking), len(base)), bool)
    band = base.column("band")[0].as_py()

    def members(t: pa.Table) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for row, bands in enumerate(t.column("all_bands").to_pylist()):
            for b in bands:
                if b < band:
                    out.setdefault(b, []).append(row)
        return out

    there, ask = members(base), members(asking)
    for b in there.keys() & ask.keys():
        met[np.ix_(ask[b], there[b])] = True
    return met


def _block_links(k: int, threshold: float, brief_words: int = 1000) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links of the asking texts to those of a block, one for each other component of the block: enough to join them.

    Of two texts outside the bucket's largest component, which both ask, the one with the smaller id does.
    Texts that share several mixed buckets are compared in the first of them alone.
    """

    def run(base: pa.Table, asking: pa.Table) -> pa.Table:
        a, b = [], []
        there, ask = (_texts(t, k) if len(base) and len(asking) else [] for t in (base, asking))
        if there and ask:
            cells, ones = _counts(there), np.ones(CELLS, np.float32)
            sizes, roots = np.array([len(t.codes) for t in there]), base.column("root").to_numpy()
            numbers, ids = base.column("id").to_numpy(), base.column("id").to_pylist()
            answers = roots == asking.column("major")[0].as_py()
            met = _met_before(base, asking)
            for own, root, text, row, elsewhere in zip(asking.column("id").to_pylist(), asking.column("root").to_pylist(), ask, _counts(ask), met, strict=True):
                longer = np.maximum(sizes, len(text.codes))
                limit = ((1 - threshold) * longer + 1e-9).astype(np.int64)
                near = (roots != root) & ~elsewhere & (answers | (numbers > own)) & (longer - np.minimum(sizes, len(text.codes)) <= limit)
                some = np.flatnonzero(near)
                some = some[longer[some] - np.minimum(cells[some], row) @ ones <= limit[some]]
                some = some[[in_common(text.pairs, there[j].pairs) >= longer[j] - 1 - 2 * limit[j] for j in some.tolist()]] if len(some) else some
                # Texts of some hundred words are aligned many at a time, longer ones one by one through their chains.
                brief = some[longer[some] <= brief_words]
                at_once = max(1, 400_000 // (2 * brief_words))
                parts = [brief[i : i + at_once] for i in range(0, len(brief), at_once)]
                linked = [j for part in parts for j in part[within(text.codes, [there[j].codes for j in part], limit[part])].tolist()]
                done = {root}
                for j in [*linked, *some[longer[some] > brief_words].tolist()]:
                    if int(roots[j]) not in done and (longer[j] <= brief_words or alike(text, there[j], threshold)):
                        a.append(ids[j])
                        b.append(own)
                        done.add(int(roots[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, root) for every id of the edges (a, b): root is the smallest id of its component.

    Alternates large-star and small-star steps, both by joins and minima, so no
    neighbourhood is gathered in one place; each round is written.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, name)
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, pairs = pairs, written(small.where("u <> v").distinct(), name)
        dropped(last)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def tree_roots(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for links (a, b) with one smaller ``a`` at most for each ``b``: the smallest id that leads to it, by pointer jumping."""
    up = written(links.select(F.col("b").alias("id"), F.col("a").alias("root")), "trees")
    jumped_from = up
    for _ in range(rounds):
        over = up.select(F.col("id").alias("root"), F.col("root").alias("over"))
        jumped = up.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved"))
        last, jumped = jumped_from, written(jumped, "trees")
        dropped(last)
        jumped_from, up = jumped, jumped.select("id", "root")
        if jumped.where("moved").isEmpty():
            return up
    raise RuntimeError(f"trees did not settle in {rounds} rounds")


def _united(batches: Batches) -> Batches:
    """(a, b) -> (id, root) of all ids, root the smallest of its component, by union-find in one task."""
    above: dict[int, int] = {}

    def top(i: int) -> int:
        above.setdefault(i, i)
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(i) for i in ids], pa.int64())], names=["id", "root"])


def merged(roots: DataFrame, links: DataFrame, one_task: int = 200_000) -> DataFrame:
    """``roots`` after ``links`` (a, b) have joined some of them: components of the roots alone.

    Up to ``one_task`` links, which are counted, are united in one task; more by joins, with the same result.
    """
    linked = written(_with_root(_with_root(links, roots, "a"), roots, "b").where("a_root <> b_root"), "over")
    n = linked.count()
    if not n:
        dropped(linked)
        return roots
    pairs = linked.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    over = components(pairs) if n > one_task else written(pairs.coalesce(1).mapInArrow(_united, "id long, root long"), "united")
    dropped(linked)
    moved = roots.join(over.select(F.col("id").alias("root"), F.col("root").alias("over")), "root", "left")
    moved = moved.select("id", F.coalesce("over", "root").alias("root"))
    tops = over.where("id <> root").join(roots.select("id"), "id", "left_anti")  # roots that now have one above them
    new = written(moved.unionByName(tops.select("id", "root")), "roots")
    dropped(over)
    dropped(roots)
    return new


def rarest(texts: DataFrame, threshold: float, scratch: list[DataFrame]) -> DataFrame:
    """(pair, id) for texts (id, words, pairs): each one's rarest pairs, as many as make texts that are alike share one.  ``scratch`` gets what is written for it."""
    each = written(texts.select("id", "words", F.explode("pairs").alias("pair")), "pairs")
    scratch.append(each)
    times = each.groupBy("pair").agg(F.count(F.lit(1)).alias("times"))
    # A pair of one text alone comes first and joins nothing.
    ranked = each.join(times.where("times > 1"), "pair").groupBy("id", "words").agg(F.sort_array(F.collect_list(F.struct("times", "pair"))).alias("ranked"))
    # An edit takes two pairs at most from either text.
    shared = F.greatest(F.lit(1), F.ceil((1 - 2 * (1 - F.lit(threshold))) * F.col("words") - 1 - 1e-9).cast("int"))
    prefix = (F.col("words") - 1) - shared + 1
    alone = (F.col("words") - 1) - F.size("ranked")
    return ranked.select("id", F.explode(F.slice("ranked", 1, F.greatest(prefix - alone, F.lit(0)))).alias("r")).select(F.col("r.pair").alias("pair"), "id")


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    k: int = 5,
    bands: int = 60,
    picked: int = 2,
    block: int = 1024,
    few: int = 50,
    one_task: int = 200_000,
) -> DataFrame:
    """One row per input row: id, class_id, class_size, kept.

    ``class_id`` is the smallest id of the class, and its row is the one kept.
    Texts equal after lower-casing and splitting into words are one class, and
    so are texts without words; of texts of less than 1 / (1 - ``threshold``) words only
    equal ones are alike.  A null text counts as empty.  Rows that share an id are
    one document.  A row with a null id is a class of its own: class_id null,
    class_size 1, kept.  Ids are integers.  Extra columns are ignored.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must lie over 0.5: below it, texts that are alike need not share a pair of words")
    spark = docs.sparkSession
    python_ready(spark)
    content = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), content.alias("content"))
    key = F.md5(F.trim(F.regexp_replace(F.lower("content"), r"\s+", " ")).cast("binary"))
    texts = rows.where("id IS NOT NULL").withColumn("key", key)
    sketches = written(texts.mapInArrow(_sketch_batches(k, bands, picked), SKETCH), "sketches")
    near = rows.where("id IS NOT NULL")

    firsts = written(sketches.groupBy("key").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("words", "bands")]), "first-of-copies")
    of_copy = written(sketches.select("id", "key").join(firsts.select("key", "rep"), "key").select("id", "rep").distinct(), "of-copies")
    dropped(sketches)

    keyed = firsts.select(F.explode("bands").alias("band"), F.col("rep").alias("id"), "words")
    leaders = keyed.groupBy("band").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = written(keyed.join(leaders, "band"), "buckets")
    sizes = members.select("id", "words").distinct()
    close = F.least("words", "b_words") >= threshold * F.greatest("words", "b_words")

    spent: list[DataFrame] = [members]

    def kept(df: DataFrame, name: str) -> DataFrame:
        spent.append(written(df, name))
        return spent[-1]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.join(sizes.select(F.col("id").alias("b"), F.col("words").alias("b_words")), "b")
        wanted = wanted.join(sizes.withColumnRenamed("id", "a"), "a").where(close).select("a", "b")
        both = wanted.join(near.select(F.col("id").alias("a"), F.col("content").alias("a_text")), "a")
        both = both.join(near.select(F.col("id").alias("b"), F.col("content").alias("b_text")), "b")
        return kept(both.mapInArrow(_verify_batches(k, threshold), "a long, b long"), name)

    leading = members.where("leader <> id")
    first = kept(leading.groupBy("id").agg(F.min("leader").alias("a")).select("a", F.col("id").alias("b")), "first-pairs")
    roots = tree_roots(verified(first, "first-links"))

    apart = _with_root(_with_root(leading.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), roots, "a"), roots, "b")
    second = kept(apart.where("a_root <> b_root").select("a", "b").join(first, ["a", "b"], "left_anti"), "second-pairs")
    roots = merged(roots, verified(second, "second-links"), one_task)

    # In a bucket that still has several components its leader is done; two more members take its place in turn.
    rest = leading.select("band", "id")
    for turn in range(3):
        rooted = _with_root(rest.withColumnRenamed("id", "a"), roots, "a").select("band", F.col("a").alias("id"), F.col("a_root").alias("root"))
        mixed = rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max(F.struct("id", "root")).alias("head")).where("least <> most")
        mixed = rooted.join(mixed.select("band", F.col("head.id").alias("head"), F.col("head.root").alias("head_root")), "band")
        mixed = kept(mixed, "mixed-buckets")
        if turn < 2:
            asked = mixed.where("root <> head_root").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
            roots = merged(roots, verified(asked, "next-links"), one_task)
            rest = mixed.where("id <> head").select("band", "id")

    # Short texts by their rarest pairs of words: each such pair is a bucket, too.
    short = firsts.where(F.col("words").between(2, int((few - 1) / threshold + 1e-9))).select(F.col("rep").alias("id"), "words")
    pairs = near.join(short, "id").mapInArrow(_pair_batches, "id long, words int, pairs array<long>")
    shared = kept(rarest(pairs, threshold, spent).distinct(), "shared-pairs")  # an id may have several texts: all of their pairs
    buckets = mixed.select("band", "id").unionByName(shared.select(F.xxhash64(F.lit("pair"), "pair").alias("band"), "id"))
    rooted = _with_root(buckets.withColumnRenamed("id", "a"), roots, "a").select("band", F.col("a").alias("id"), F.col("a_root").alias("root"))
    rooted = kept(rooted, "rooted")
    parts = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band")
    parts = parts.agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")
    # Those outside the largest component of a bucket are held against all of it, blocks with blocks.
    blocks = lambda n: F.ceil(n / block).cast("int")
    parts = kept(parts.select("band", "major", blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("most")).alias("others")), "parts")
    apart = kept(rooted.join(parts, "band"), "apart")
    # With each text go its mixed buckets, some 60 at most and, of a short one, its pairs: two texts are compared in the first that they share.
    mixed_of = apart.groupBy("id").agg(F.collect_set("band").alias("all_bands"))
    codes = near.join(mixed_of, "id").mapInArrow(_code_batches, "id long, all_bands array<long>, codes array<int>")
    codes = kept(codes, "codes")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = apart.select("band", "id", "root", own(F.col("blocks")).alias("block"), every(F.col("others")).alias("other")).join(codes, "id")
    asking = apart.where("root <> major").select("band", "id", "root", "major", own(F.col("others")).alias("other"), every(F.col("blocks")).alias("block")).join(codes, "id")
    base, asking = base.toDF(*base.columns), asking.toDF(*asking.columns)  # attributes of their own
    by = ["band", "block", "other"]
    third = base.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(_block_links(k, threshold), "a long, b long")
    wanted = kept(third.distinct(), "third-pairs")  # by short hashes; few, and verified on the texts
    both = wanted.join(near.select(F.col("id").alias("a"), F.col("content").alias("a_text")), "a").join(near.select(F.col("id").alias("b"), F.col("content").alias("b_text")), "b")
    third = both.mapInArrow(_verify_batches(k, threshold), "a long, b long")
    # An id with several texts joins their classes.
    least = of_copy.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a <> most").select("id", "a")
    several = of_copy.join(least, "id").where("rep <> a").select("a", F.col("rep").alias("b"))
    roots = merged(roots, kept(third.unionByName(several), "third-links"), one_task)
    for scratch in spent:
        dropped(scratch)

    named = of_copy.groupBy("id").agg(F.min("rep").alias("rep"))
    named = named.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    named = written(named, "classes")
    for scratch in (firsts, of_copy, roots):
        dropped(scratch)
    of = named.join(named.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    out = rows.select("id").join(of, "id", "left")
    root = F.coalesce(F.col("root"), F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        root.alias("class_id"),
        F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("class_size"),
        F.col("id").eqNullSafe(root).alias("kept"),
    )


def _with_root(pairs: DataFrame, roots: DataFrame, side: str) -> DataFrame:
    named = roots.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root"))
    return pairs.join(named, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each class."""
    return without_ids(docs, classes(docs, id_col=id_col, **how).where("NOT kept").select(f"`{id_col}`"), id_col)
