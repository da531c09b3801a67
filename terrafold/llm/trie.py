"""Prefix tries of conversations, in level order.

Distinct conversations, ordered by the digests of their turns, are dealt over parts.
The conversations below a node are neighbours in that order, so a part holds a piece
of the trie, and only the nodes on the paths of its first and its last conversation can
lie in other parts, too.  Each part builds its piece as a succinct trie: a LOUDS
bitvector (for each node in level order as many ones as it has children, then a
zero), and arrays of labels, words and members.  Counts are rolled up in reverse
level order with ``add.at``.  The nodes that parts may share, the heavy upper
levels among them, are merged apart, by groups of neighbouring parts, until
one group covers all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, python_ready, written
from terrafold.llm.ranges import merged, parts_for, spans

LABEL = 16
#: Turns that decide to which part a conversation goes; beyond them order is kept within a part.
ORDER_TURNS = 64
WORDS = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
#: An open node carries its digest, its parent's, its words, and on which side of the part it lies.
OPEN = f"part long, key binary, parent_key binary, words long, first boolean, last boolean, {NODE}"


@dataclass
class Louds:
    """A trie in level order.

    ``bits``: LOUDS bitvector; ``labels``: (nodes, 2) unsigned halves of the label that
    leads to a node; ``words``: of the node's turn; ``levels``: bounds of the levels.
    """

    bits: np.ndarray
    labels: np.ndarray
    words: np.ndarray
    levels: np.ndarray

    def parents(self) -> np.ndarray:
        """Parent of each node, the root's is -1: the zeros before the node's own one."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate([[-1], ones - np.arange(len(ones))]).astype(np.int64)

    def children(self) -> np.ndarray:
        """Number of children of each node: the ones between two zeros."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def find(self, path: list[bytes]) -> int:
        """The node that the labels of ``path`` lead to, or -1."""
        zeros, node = np.flatnonzero(~self.bits), 0
        for label in path:
            first = zeros[node - 1] + 1 - (node - 1) if node else 1  # ones before its children, and the root
            last = zeros[node] + 1 - node
            some = self.labels[first:last]
            hit = np.flatnonzero((some == np.frombuffer(label, ">u8")).all(axis=1))
            if not len(hit):
                return -1
            node = int(first + hit[0])
        return node


def build(lengths: np.ndarray, labels: np.ndarray, words: np.ndarray) -> tuple[Louds, np.ndarray]:
    """(trie, node at which each conversation ends) of conversations in the order of their labels.

    ``labels`` and ``words`` hold the turns of all conversations one after the other.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    node = np.zeros(len(lengths), np.int64)
    alive = np.flatnonzero(lengths > 0)
    level_labels, level_words, counts, bounds, size, depth = [np.zeros((1, 2), np.uint64)], [np.zeros(1, np.int64)], [], [0, 1], 1, 0
    while len(alive):
        at = starts[alive] + depth
        here, above = labels[at], node[alive]
        new = np.ones(len(alive), bool)
        new[1:] = (above[1:] != above[:-1]) | (here[1:] != here[:-1]).any(axis=1)
        node[alive] = size + np.cumsum(new) - 1
        counts.append(np.bincount(above[new] - bounds[-2], minlength=bounds[-1] - bounds[-2]))
        level_labels.append(here[new])
        level_words.append(words[at][new])
        size += int(new.sum())
        bounds.append(size)
        depth += 1
        alive = alive[lengths[alive] > depth]
    counts.append(np.zeros(bounds[-1] - bounds[-2], np.int64))
    children = np.concatenate(counts)
    bits = np.ones(int(children.sum()) + size, bool)
    bits[np.cumsum(children + 1) - 1] = False
    return Louds(bits, np.concatenate(level_labels), np.concatenate(level_words), np.array(bounds)), node


def rolled_up(parents: np.ndarray, levels: np.ndarray, values: np.ndarray, still: np.ndarray | None = None) -> np.ndarray:
    """``values`` with those of all nodes below; what nodes in ``still`` have goes no further up."""
    out = values.copy()
    for a, b in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
        moved = out[a:b] if still is None else np.where(still[a:b], 0, out[a:b])
        np.add.at(out, parents[a:b], moved)
    return out


def least(parents: np.ndarray, levels: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = values.copy()
    for a, b in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
        np.minimum.at(out, parents[a:b], out[a:b])
    return out


def _counts(parents: np.ndarray, levels: np.ndarray, members: np.ndarray, words: np.ndarray, still: np.ndarray, leaves: np.ndarray | None = None, saved: np.ndarray | None = None, childless: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, saved tokens) of subtrees.  Nodes in ``still`` get what the others below them have, and nothing of their own."""
    own_leaves = np.where(still | ~childless, 0, 1)
    own_saved = np.where(still, 0, (members - 1) * words)
    if leaves is not None:
        own_leaves, own_saved = own_leaves + leaves, own_saved + saved
    return rolled_up(parents, levels, own_leaves, still), rolled_up(parents, levels, own_saved, still)


def _chain(labels: np.ndarray) -> list[bytes]:
    """Digests of a path's prefixes, that of no turn first."""
    h = sha256()
    out = [h.digest()[:LABEL]]
    for label in labels.astype(">u8"):
        h.update(label.tobytes())
        out.append(h.copy().digest()[:LABEL])
    return out


def _ints(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def _flat(lists: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in lists.chunks]) if lists.num_chunks else pa.array([], lists.type.value_type)


def shard(rows: pa.Table) -> tuple[Louds, np.ndarray]:
    """The trie of a part's conversations: (trie, node at which each of them ends)."""
    lengths = pc.list_value_length(rows.column("labels")).to_numpy().astype(np.int64)
    flat = _flat(rows.column("labels")).cast(pa.binary())
    labels = np.frombuffer(b"".join(flat.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    words = _flat(rows.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
    return build(lengths, labels, words)


def _part_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a part: those that are its own, and those that it may share."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    trie, ends_at = shard(rows)
    parents, size = trie.parents(), len(trie.words)
    copies, first_id = rows.column("copies").to_numpy(), rows.column("first_id").to_numpy()
    members = np.zeros(size, np.int64)
    np.add.at(members, ends_at, copies)
    members = rolled_up(parents, trie.levels, members)
    ids = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(ids, ends_at, first_id)
    ids = least(parents, trie.levels, ids)
    ends: list[str | None] = [None] * size
    for node, e in zip(ends_at.tolist(), rows.column("ends").to_pylist(), strict=True):
        ends[node] = e

    first, last, keys = np.zeros(size, bool), np.zeros(size, bool), {}
    for side, end in ((first, int(ends_at[0])), (last, int(ends_at[-1]))):
        path = [end]
        while parents[path[-1]] >= 0:
            path.append(int(parents[path[-1]]))
        path.reverse()
        side[path] = True
        keys |= dict(zip(path, _chain(trie.labels[path[1:]]), strict=True))
    shared = first | last
    children = trie.children()
    below = np.bincount(parents[1:][~shared[1:]], minlength=size)  # children that are the part's own
    leaves, saved = _counts(parents, trie.levels, members, trie.words, shared, childless=children == 0)
    above = np.maximum(parents, 0)
    open_parent = shared[above]
    depth = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    part = rows.column("part")[0].as_py()
    for a in range(0, size, 65_536):
        b = min(size, a + 65_536)
        here = range(a, b)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(here), pa.int64()),
                pa.array([keys.get(i) for i in here], pa.binary()),
                pa.array([keys.get(int(above[i])) if i else None for i in here], pa.binary()),
                _ints(trie.words[a:b]),
                pa.array(first[a:b]),
                pa.array(last[a:b]),
                _ints(ids[a:b]),
                _ints(depth[a:b]),
                _ints(ids[above[a:b]], open_parent[a:b]),
                _ints(members[a:b]),
                _ints(np.where(shared, below, children)[a:b]),
                _ints(leaves[a:b]),
                _ints(saved[a:b]),
                pa.array(ends[a:b], pa.string()),
            ],
            schema=ARROW_OPEN,
        )


ARROW_OPEN = pa.schema(
    [("part", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("words", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())]
    + [(n, pa.string() if n == "ends" else pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")]
)


def _merge(is_last: bool):
    """Nodes that neighbouring parts share, summed; those on no outer path of the group are its own from now on."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        order = np.argsort(table.column("depth").to_numpy(), kind="stable")
        keys, parent_keys = table.column("key").to_pylist(), table.column("parent_key").to_pylist()
        number: dict[bytes, int] = {}
        for i in order:
            number.setdefault(keys[i], len(number))
        size = len(number)
        at = np.array([number[k] for k in keys])
        col = {n: table.column(n).to_numpy(zero_copy_only=False) for n in ("words", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "first", "last")}

        def total(name: str) -> np.ndarray:
            out = np.zeros(size, np.int64)
            np.add.at(out, at, col[name])
            return out

        depth, words, ids = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        depth[at], words[at] = col["depth"], col["words"]
        np.minimum.at(ids, at, col["conv_id"])
        parents, ends = np.full(size, -1), [None] * size
        for i, p, e in zip(at.tolist(), parent_keys, table.column("ends").to_pylist(), strict=True):
            if p is not None:
                parents[i] = number[p]
            if e is not None:
                ends[i] = e
        first, last = np.zeros(size, bool), np.zeros(size, bool)
        first[at[(parts == parts.min()) & col["first"].astype(bool)]] = True
        last[at[(parts == parts.max()) & col["last"].astype(bool)]] = True
        shared = np.zeros(size, bool) if is_last else first | last
        levels = np.concatenate([[0], np.cumsum(np.bincount(depth))])
        members, children = total("n_convs"), total("n_children")
        # A shared child is counted once it is one group's own; until then its parent is shared as well.
        mine = np.flatnonzero(~shared & (parents >= 0))
        np.add.at(children, parents[mine], 1)
        childless = children == 0
        leaves, saved = _counts(parents, levels, members, words, shared, total("n_leaves"), total("saved_tokens"), childless)
        above = np.maximum(parents, 0)
        names = list(number)
        return pa.table(
            [
                pa.array([int(parts.min())] * size, pa.int64()),
                pa.array(names, pa.binary()),
                pa.array([names[p] if p >= 0 else None for p in parents], pa.binary()),
                words, first & shared, last & shared, ids, depth,
                _ints(ids[above], shared[above] | (parents < 0)),
                members, children, leaves, saved, ends,
            ],
            schema=ARROW_OPEN,
        )

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path and id -> each path's ids as text, in pieces of at most 100,000."""
    path, ids = None, []
    done: list[tuple] = []
    for batch in batches:
        for p, i in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (p != path or len(ids) >= 100_000):
                done.append((path, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            path = p
            ids.append(i)
        if done:
            yield _batch(done, PIECE)
            done = []
    if ids:
        yield _batch([(path, ids[0], len(ids), ",".join(map(str, ids)))], PIECE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PIECE = pa.schema([("path", pa.binary()), ("first_id", pa.int64()), ("copies", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("path", pa.binary()), ("first_id", pa.int64()), ("copies", pa.int64()), ("ends", pa.string())])


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by path and first id -> the digest of each path's whole list of ids; a piece at a time is held."""
    path, first, copies, state = None, 0, 0, sha256()
    done: list[tuple] = []
    for batch in batches:
        for p, f, n, text in zip(*[batch.column(c).to_pylist() for c in PIECE.names], strict=True):
            if p == path:
                copies += n
                state.update(b"," + text.encode())
                continue
            if path is not None:
                done.append((path, first, copies, state.hexdigest()))
            path, first, copies, state = p, f, n, sha256(text.encode())
        if done:
            yield _batch(done, ENDS)
            done = []
    if path is not None:
        yield _batch([(path, first, copies, state.hexdigest())], ENDS)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        trie, _ = shard(rows)
        row = (rows.column("part")[0].as_py(), len(trie.words), np.packbits(trie.bits).tobytes(), trie.labels.astype(">u8").tobytes(), trie.words.astype("<i8").tobytes())
        yield _batch([row], TRIE)


TRIE = pa.schema([("part", pa.int64()), ("nodes", pa.int64()), ("louds", pa.binary()), ("labels", pa.binary()), ("words", pa.binary())])


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of (conv_id, turn, role, text): structs of turn, label and words, by turn, null first, then by label.

    A label is 16 bytes of the digest of role and text, the role's length before them;
    null role or text counts as empty.  Rows without a conv_id are of no conversation
    and left out; rows that repeat a turn are turns of their own; other columns are
    ignored.  A conversation's labels are one row: some 40 bytes a turn.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    one = F.struct(F.col("`turn`").alias("turn"), F.substring(label, 1, LABEL).alias("label"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    own = columns_of(rows, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, shared: Column, block: int = 20) -> DataFrame:
    """Each conversation with its first ``shared`` turns (three at most) taken from the first conversation of its block.

    That is the one with id ``conv_id - conv_id % block``: if it has fewer turns all
    of them are taken, if there is none, none; the own turns after the first ``shared`` follow.
    """
    heads = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    own = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), shared.cast("int").alias("h"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def ordered(convs: DataFrame, part_turns: int = 200_000) -> tuple[DataFrame, int]:
    """(distinct conversations with copies, first id and digest of ids, in order and in parts; number of parts)."""
    spark = convs.sparkSession
    python_ready(spark, batch_rows=4096)
    path = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["label"])), ""), 256))
    convs = written(convs.select("conv_id", F.col("turns.label").alias("labels"), F.col("turns.words").alias("words"), path.alias("path")), "conversations")
    n_turns, n_convs = convs.agg(F.coalesce(F.sum(F.size("labels") + 1), F.lit(0)), F.count(F.lit(1))).first()

    # Ids of copies as text in pieces, then one digest for each list.  The order deals a long list over many parts.
    ids = convs.select("path", "conv_id").repartitionByRange(parts_for(convs, n_convs, 500_000), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = ids.mapInArrow(_ends, "path binary, first_id long, copies long, ids string")
    ends = pieces.repartition("path").sortWithinPartitions("path", "first_id").mapInArrow(_ends_digest, "path binary, first_id long, copies long, ends string")
    distinct = convs.groupBy("path").agg(F.first("labels").alias("labels"), F.first("words").alias("words")).join(ends, "path").drop("path")

    parts = parts_for(convs, n_turns, part_turns)
    dealt = distinct.repartitionByRange(parts, F.slice("labels", 1, ORDER_TURNS)).sortWithinPartitions("labels")
    return dealt.withColumn("part", F.spark_partition_id().cast("long")), parts


def tries(convs: DataFrame, part_turns: int = 200_000) -> DataFrame:
    """The succinct trie of each part: its number of nodes, LOUDS bits, 16 bytes of label and 8 of words a node."""
    return ordered(convs, part_turns)[0].mapInArrow(_tries, "part long, nodes long, louds binary, labels binary, words binary")


def nodes(convs: DataFrame, part_turns: int = 200_000, fan_in: int = 32, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The trie of (conv_id, turns), a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends.

    ``turns`` is an array of structs with ``label`` (16 bytes) and ``words``; conv_ids are
    distinct and not null.  ``conv_id`` is the node's smallest member, which with ``depth`` tells it
    from others; ``ends`` is the SHA-256 of the decimal ids that end there, ascending, comma-joined, null
    without any.  Conversations without turns are members of the root alone; no
    conversations, no nodes.  Copies are one path with a weight, and a prefix that
    many share is dealt over as many parts as its conversations need.  A task holds
    ``part_turns`` turns, or one path for each of ``fan_in`` parts.
    """
    paths, parts = ordered(convs, part_turns)
    built = written(paths.mapInArrow(_part_nodes, OPEN), "trie-nodes")
    own, left = built.where("key IS NULL"), built.where("key IS NOT NULL")
    known = None
    for span in spans(parts, fan_in):
        up = merged(left, _merge(span >= parts), span, "shared-nodes")
        done = up.where("NOT first AND NOT last")
        known = done if known is None else known.unionByName(done)
        left = up.where("first OR last")
    whole = own.unionByName(known)

    # Parents that were still shared when their children were counted; the root is the most frequent of them and the same for all.
    root = known.where("depth = 0").select("conv_id").first()
    parent = known.where("depth > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    settled = F.col("parent_conv_id").isNotNull() | (F.col("depth") <= 1)
    at_once = whole.where(settled).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root and root[0]).cast("long")).otherwise(F.col("parent_conv_id")))
    if known.count() <= broadcast_rows:
        later = whole.where(~settled).join(F.broadcast(parent), "parent_key", "left")
    else:
        salt = 16
        salted = parent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        later = whole.where(~settled).withColumn("salt", F.pmod(F.hash("conv_id", "depth"), F.lit(salt))).join(salted, ["parent_key", "salt"], "left")
    later = later.withColumn("parent_conv_id", F.col("found"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    return at_once.select(*columns).unionByName(later.select(*columns))
