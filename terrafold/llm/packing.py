"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Which documents of one length go where does not matter, so the plan is made on
the counts by length - at most ``capacity`` numbers, whatever the corpus - and
then each piece finds its place by its rank among the pieces of its length:

* lengths over a third of the capacity are matched greedily, longest first, each
  with the longest partner that still fits: at most two of them share a sequence;
* shorter ones, longest first, go to the sequence with the smallest gap that
  takes them; new sequences are opened only when no gap does.

The plan is a list of runs: so many pieces of one length, so many to a sequence,
from this sequence and this offset on.  It is kept in numpy arrays whose length
depends on the capacity alone.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, id_type, python_ready, written

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def plan_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first_rank, n, first_sequence, per_sequence, offset), by length and rank."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    gaps: list[int] = []
    by_gap: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in by_gap:
                insort(gaps, gap)
                by_gap[gap] = []
            by_gap[gap].append((first, n))

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        if n:
            runs.append((length, used[length], n, first, each, offset))
            used[length] += n
            left[length] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        fit = bisect_left(large, capacity - s + 1) - 1
        partner = large[fit] if fit >= 0 else None
        if partner == s and left[s] > 1:
            n = left[s] // 2
            place(s, 2 * n, sequences, 2, 0)
            free(capacity - 2 * s, sequences, n)
        elif partner is not None and partner != s:
            n = min(left[s], left[partner])
            place(s, n, sequences, 1, 0)
            place(partner, n, sequences, 1, s)
            free(capacity - s - partner, sequences, n)
            if not left[partner]:
                large.remove(partner)
        elif partner == s and fit > 0:  # one is left of a length that pairs with itself
            partner, n = large[fit - 1], 1
            place(s, 1, sequences, 1, 0)
            place(partner, 1, sequences, 1, s)
            free(capacity - s - partner, sequences, 1)
            if not left[partner]:
                large.remove(partner)
        else:
            n = left[s]
            place(s, n, sequences, 1, 0)
            free(capacity - s, sequences, n)
        sequences += n
        if not left[s]:
            large.remove(s)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                n = -(-left[s] // (capacity // s))
                free(capacity, sequences, n)
                sequences += n
                at = bisect_left(gaps, s)
            gap = gaps[at]
            first, n = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            each = gap // s
            full = min(n, left[s] // each)
            place(s, full * each, first, each, capacity - gap)
            free(gap - each * s, first, full)
            first, n = first + full, n - full
            if n and left[s]:
                rest = left[s]
                place(s, rest, first, rest, capacity - gap)
                free(gap - rest * s, first, 1)
                first, n = first + 1, n - 1
            free(gap, first, n)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)


#: Characters whose classes no version of either library's tables changes; a test holds both libraries against each other on each of them.
PLAIN = r"\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2015\u2018-\u201f\u2026\u20ac"
#: Texts with other characters, or a run of so much white space that the quick library's backtracking could fail on it.
UNSURE = re.compile(rf"[^{PLAIN}]|[\t\n\r ]{{1000}}")


def _encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids by the tokenizers file.  Texts of plain characters, without its special strings, go through the same vocabulary as ranks, if there.

    Both cut a text by the same pattern and merge by the same ranks; for plain
    characters they give the same ids, several times faster.  All other texts go
    through the library itself.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    whole = lambda texts: [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]
    specials = [t.content for t in exact.get_added_tokens_decoder().values()]
    ranked = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranked):
        return whole
    import public_tokenizers
    import tiktoken

    with open(ranked, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [whole([t])[0] if UNSURE.search(t) or any(s in t for s in specials) else quick.encode_ordinary(t) for t in texts]

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones, but for the first."""
    head = n % capacity if n > capacity else n
    firsts = [(0, head)] if head else []
    return firsts + [(at, capacity) for at in range(head, n, capacity)]


def _piece_batches(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            out: list[list] = [[], [], [], []]
            owners: list[int] = []
            for i, ids in enumerate(encode(batch.column("content").to_pylist())):
                data = np.array([*ids, end_id], dtype="<u4").tobytes()
                for piece, (start, length) in enumerate(cut(len(ids) + 1, capacity)):
                    owners.append(i)
                    row = (piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            columns = [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owners, pa.int64())), *columns], names=["doc_id", *schema.names])

    return run


def _place_batches(runs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs are sorted by length and rank, so length and rank in one key find the run.
        span = int((runs[:, 1] + runs[:, 2]).max(initial=0)) + 1
        keys = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = runs[np.searchsorted(keys, length * span + rank, side="right") - 1]
            ahead = rank - own[:, 1]
            placed = [own[:, 3] + ahead // own[:, 4], own[:, 5] + ahead % own[:, 4] * length]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *(pa.array(c, pa.int64()) for c in placed)], names=[*kept.schema.names, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_rows: int = 4096,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and then ``end_id``, so the
    empty one has length 1; ids keep their type and may be null.  Only documents over the
    capacity are cut.  Repeated rows are packed each on their own.  Extra columns
    are ignored; an empty table gives an empty result.  Pieces are written to the
    shared folder, so that texts are encoded once.  Ranks within a length are
    counted in buckets of about ``rank_rows`` pieces, so a length that many
    documents have is dealt over many tasks.
    """
    spark = docs.sparkSession
    python_ready(spark)
    texts = columns_of(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("content")
    )
    kind = id_type(docs, id_col)
    pieces = written(texts.mapInArrow(_piece_batches(tokenizer_path, capacity, end_id), PIECES.format(id=kind)), "pieces")
    histogram = written(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")  # at most `capacity` rows
    runs = plan_runs({r["length"]: r["n"] for r in histogram.collect()}, capacity)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.ceil(F.col("n") / rank_rows).cast("long"))
    dealt = pieces.join(F.broadcast(histogram), "length").withColumn("bucket", bucket).drop("n")
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("length", "bucket", "sum(n) OVER (PARTITION BY length ORDER BY bucket) - n AS before")
    )
    ranked = dealt.selectExpr("*", "row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, ids_crc32) - 1 AS place")
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place_batches(runs), PLACED.format(id=kind))
    return placed.withColumnRenamed("doc_id", id_col)
