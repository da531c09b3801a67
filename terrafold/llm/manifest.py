"""A Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots, a proof for each row.

Each part of the ordered rows holds a fragment of the forest: nodes keyed by tree,
level and index whose run of siblings is not complete there.  Fragments are merged
by a tree of contiguous groups of parts; as the size of each tree is known, so is the
number of siblings of each run (the last may be shorter), and a run becomes its
parent as soon as a fragment holds all of it.  Merging is associative: nodes are
keyed, and it doesn't matter which merge completes a run.  A fragment of
contiguous rows keeps fewer than ``arity`` nodes on either side of each level of at
most two trees of groups and of the tree over them, however many rows it covers.

Proofs go the other way: each merge hands to its parts the nodes beside their
paths that the parts lack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, dropped, id_type, python_ready, written
from terrafold.llm.ranges import dealt, merged, parts_for, spans

#: The tree over the groups' roots.
TOP = -1
NODES = "part long, tree long, size long, level int, index long, digest string"
ARROW_NODES = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])

Node = tuple[int, int, int]


def row_digest(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else byte count, ``:``, value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest_of(children: list[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


def run_of(size: int, level: int, index: int, arity: int) -> range:
    """Indexes of a node and its siblings."""
    first = index - index % arity
    return range(first, min(first + arity, -(-size // arity**level)))


def settle(nodes: dict[Node, bytes], sizes: dict[int, int], arity: int) -> tuple[dict[Node, bytes], set[Node]]:
    """(all nodes that follow from ``nodes``, those of them whose run is not complete).

    The root of a group's tree is a leaf of the tree over the groups; the root of that
    one counts as not complete.
    """
    known, still_open = dict(nodes), set()
    waiting: dict[int, dict[int, set[int]]] = {}
    for tree, level, index in nodes:
        waiting.setdefault(tree, {}).setdefault(level, set()).add(index)
    for tree in sorted(set(waiting) | {TOP}, reverse=True):  # the tree over the groups comes last
        levels = waiting.get(tree, {})
        while levels:
            level = min(levels)
            here = levels.pop(level)
            if -(-sizes[tree] // arity**level) == 1:
                if tree == TOP:
                    still_open.add((TOP, level, 0))
                else:
                    known[TOP, 0, tree] = known[tree, level, 0]
                    waiting.setdefault(TOP, {}).setdefault(0, set()).add(tree)
                continue
            for parent in sorted({i // arity for i in here}):
                run = run_of(sizes[tree], level, parent * arity, arity)
                if here.issuperset(run):
                    known[tree, level + 1, parent] = digest_of([known[tree, level, i] for i in run])
                    levels.setdefault(level + 1, set()).add(parent)
                else:
                    still_open.update((tree, level, i) for i in run if i in here)
    return known, still_open


def path(node: Node, sizes: dict[int, int], arity: int) -> Iterator[Node]:
    """``node`` and what stands above it, a group's root followed by its leaf of the tree over the groups."""
    tree, level, index = node
    while True:
        yield tree, level, index
        if -(-sizes[tree] // arity**level) == 1:
            if tree == TOP:
                return
            tree, level, index = TOP, 0, tree
        else:
            level, index = level + 1, index // arity


def beside(nodes: set[Node], sizes: dict[int, int], arity: int) -> set[Node]:
    """What a fragment needs for the proofs of its open nodes: siblings on their paths, and the roots."""
    out: set[Node] = set()
    seen: set[Node] = set()
    for node in nodes:
        for tree, level, index in path(node, sizes, arity):
            if (tree, level, index) in seen:
                break
            seen.add((tree, level, index))
            out.update((tree, level, i) for i in run_of(sizes[tree], level, index, arity))
    return out


def fold(leaf: str, proof: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and its proof lead to; ``proof``: siblings before and after, level by level."""
    at = leaf.encode()
    for before, after in proof:
        at = sha256(before + at + after).hexdigest().encode()
    return at.decode()


def _nodes(table: pa.Table) -> tuple[dict[Node, bytes], dict[int, int]]:
    cols = [table.column(c).to_pylist() for c in ("tree", "level", "index", "digest", "size")]
    return {(t, lv, i): d.encode() for t, lv, i, d, _ in zip(*cols, strict=True)}, dict(zip(cols[0], cols[4], strict=True))


def _table(rows: list[tuple[int, Node, bytes]], sizes: dict[int, int]) -> pa.Table:
    return pa.table(
        [[p for p, _, _ in rows], [n[0] for _, n, _ in rows], [sizes[n[0]] for _, n, _ in rows], [n[1] for _, n, _ in rows], [n[2] for _, n, _ in rows], [d.decode() for _, _, d in rows]],
        schema=ARROW_NODES,
    )


def _leaf_nodes(rows: pa.Table, places: pa.Table, groups: int) -> tuple[pa.Table, list[Node], dict[int, int]]:
    """(rows in order, the leaf node of each, sizes of trees) of a part."""
    rows = rows.sort_by("pos")
    trees = places.sort_by("first_pos").to_pylist()
    nodes: list[Node] = []
    for t in trees:
        nodes += [(t["tree"], 0, t["offset"] + i) for i in range(t["n"])]
    return rows, nodes, {t["tree"]: t["size"] for t in trees} | {TOP: groups}


def _fragment(groups: int, arity: int) -> Callable:
    def run(key: tuple, rows: pa.Table, places: pa.Table) -> pa.Table:
        rows, nodes, sizes = _leaf_nodes(rows, places, groups)
        leaves = [d.hex().encode() for d in rows.column("leaf").to_pylist()]
        known, left = settle(dict(zip(nodes, leaves, strict=True)), sizes, arity)
        return _table([(key[0].as_py(), n, known[n]) for n in sorted(left)], sizes)

    return run


def _merge(groups: int, arity: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        nodes, sizes = _nodes(table)
        sizes[TOP] = groups
        known, left = settle(nodes, sizes, arity)
        first = min(table.column("part").to_pylist())
        return _table([(first, n, known[n]) for n in sorted(left)], sizes)

    return run


def _handed_down(groups: int, arity: int) -> Callable:
    """(fragments of a merge's parts, what the merge was handed) -> what each part lacks."""

    def run(_: tuple, fragments: pa.Table, handed: pa.Table) -> pa.Table:
        nodes, sizes = _nodes(fragments)
        sizes[TOP] = groups
        known = settle(nodes, sizes, arity)[0] | _nodes(handed)[0]
        mine: dict[int, set[Node]] = {}
        for part, tree, level, index in zip(*[fragments.column(c).to_pylist() for c in ("part", "tree", "level", "index")], strict=True):
            mine.setdefault(part, set()).add((tree, level, index))
        return _table([(part, n, known[n]) for part, own in mine.items() for n in sorted(beside(own, sizes, arity) - own)], sizes)

    return run


def _proofs(groups: int, arity: int, out: pa.Schema) -> Callable:
    def run(_: tuple, rows: pa.Table, more: pa.Table) -> pa.Table:
        handed = more.filter(pc.is_valid(more.column("digest")))
        places = more.filter(pc.is_null(more.column("digest")))
        rows, nodes, sizes = _leaf_nodes(rows, places, groups)
        leaves = [d.hex() for d in rows.column("leaf").to_pylist()]
        claims = [d and d.hex() for d in rows.column("claimed").to_pylist()]
        known = settle({n: d.encode() for n, d in zip(nodes, leaves, strict=True)}, sizes, arity)[0] | _nodes(handed)[0]
        around: dict[Node, tuple[bytes, bytes]] = {}
        subroots: dict[int, str] = {}
        proofs, folded, roots = [], [], []
        for node, leaf, claim in zip(nodes, leaves, claims, strict=True):
            proof = []
            for at in path(node, sizes, arity):
                tree, level, index = at
                if -(-sizes[tree] // arity**level) == 1:
                    if tree == TOP:
                        root = known[at].decode()
                    else:
                        subroots[tree] = known[at].decode()
                    continue
                pair = around.get(at)
                if pair is None:
                    run_ = run_of(sizes[tree], level, index, arity)
                    pair = around[at] = tuple(b"".join([known[tree, level, i] for i in run_ if (i < index if side else i > index)]) for side in (True, False))
                proof.append(pair)
            proofs.append(b"".join([x for pair in proof for x in pair]).decode())
            folded.append(fold(claim or leaf, proof))
            roots.append(root)
        return pa.table(
            [
                rows.column("id"), leaves, [n[2] for n in nodes], [sizes[n[0]] for n in nodes], [n[0] for n in nodes], [groups] * len(nodes),
                proofs, [subroots[n[0]] for n in nodes], roots, folded, [a == b for a, b in zip(folded, roots, strict=True)],
            ],
            schema=out,
        )

    return run


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    claimed: Callable[[dict[str, Column]], dict[str, Column]] | None = None,
    arity: int = 2,
    part_rows: int = 32_768,
    fan_in: int = 32,
) -> DataFrame:
    """One row per input row: id, leaf, place in its tree, proof, subroot, root, folded_root, verified.

    Leaves of a group ascend by id (null first), then by leaf; groups ascend bytewise,
    null first.  ``proof`` holds the siblings' digests in hex, level by level from
    the leaf to the root and from left to right; ``index``, ``group_size``,
    ``group_index`` and ``groups`` say how they lie.  ``claimed`` maps the fields to
    what somebody else says they are; ``folded_root`` is what the digest of that
    leads to with the original siblings (null or absent: the row itself), and
    ``verified`` whether it is the root.  Nulls are told from empty texts; repeated
    rows have a leaf each; an empty table gives an empty result; other columns are
    ignored.  A task holds a part of at most some ``part_rows`` rows without their
    texts, however the ids and groups are distributed.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = id_type(docs, id_col)
    own = {f: F.col(f"`{f}`") for f in fields}
    said = claimed(own) if claimed else None
    leaf = row_digest(own)
    other = row_digest({f: said[f] for f in fields}) if said else F.lit(None).cast("string")
    rows = columns_of(docs, *dict.fromkeys([id_col, group_col, *fields])).select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{group_col}`").alias("grp"),
        F.unhex(leaf).alias("leaf"),
        F.unhex(F.when(other != leaf, other)).alias("claimed"),
        F.monotonically_increasing_id().alias("copy"),  # deals rows that are alike over parts
    )
    parts = parts_for(docs, docs.count(), part_rows)
    leaves = dealt(rows, [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("copy")], parts, "leaves").drop("copy")

    # Where each group lies in each part: as many rows as parts and groups.
    by_group, by_part = Window.partitionBy("grp").orderBy("part"), Window.partitionBy("part").orderBy("first_pos")
    places = (
        leaves.groupBy("part", "grp")
        .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.sum("n").over(by_group) - F.col("n"))
        .withColumn("size", F.sum("n").over(Window.partitionBy("grp")))
        .withColumn("begun", F.sum((F.col("offset") == 0).cast("long")).over(by_part))
    )
    places = written(places, "places")
    begun = places.groupBy("part").agg(F.max("begun").alias("here")).withColumn("before", F.sum("here").over(Window.orderBy("part")) - F.col("here"))
    places = written(
        places.join(begun, "part").select("part", (F.col("before") + F.col("begun") - 1).alias("tree"), "size", "first_pos", "n", "offset"),
        "trees",
    )
    groups = places.agg(F.max("tree")).first()[0]
    groups = 0 if groups is None else groups + 1

    # Up: what each part and each merge leaves open.
    levels = [written(leaves.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_fragment(groups, arity), NODES), "fragments")]
    steps = list(spans(parts, fan_in))
    for span in steps:
        levels.append(merged(levels[-1], _merge(groups, arity), span, "fragments"))
    # Down: what each lacks.  The last merge holds the root, and lacks nothing.
    handed = levels.pop()
    for span in reversed(steps):
        below = levels.pop()
        up = F.floor(F.col("part") / span).cast("long")
        lacks = below.withColumn("up", up).groupBy("up").cogroup(handed.withColumn("up", up).groupBy("up")).applyInArrow(_handed_down(groups, arity), NODES)
        handed = written(lacks, "handed")
        dropped(below)
    more = handed.unionByName(places, allowMissingColumns=True)
    out = f"id {kind}, leaf string, index long, group_size long, group_index long, groups long, proof string, subroot string, root string, folded_root string, verified boolean"
    schema = spark.createDataFrame([], out).toArrow().schema
    proved = leaves.groupBy("part").cogroup(more.groupBy("part")).applyInArrow(_proofs(groups, arity, schema), out)
    return proved.withColumnRenamed("id", id_col)
