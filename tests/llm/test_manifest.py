"""Merkle manifests against a tree built on the driver."""

import binascii
import hashlib

import pytest
from pyspark.sql import functions as F

from terrafold.llm import manifest
from terrafold.llm.queries import tampered

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id string, tree int, part int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, n_chars):
    values = [row[0], row[1], row[2], n_chars, row[4]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(leaves, at, arity):
    """(siblings of leaf ``at`` level by level as (before, after), root)."""
    proof = []
    while len(leaves) > 1:
        first = at - at % arity
        run = leaves[first : first + arity]
        proof.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        leaves = [h(*leaves[i : i + arity]) for i in range(0, len(leaves), arity)]
        at //= arity
    return proof, leaves[0]


def brute(rows, arity=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[3]))) for g in langs]
    leaves = [[leaf_of(r, r[3]) for r in t] for t in trees]
    subroots = [climb(x, 0, arity)[1] for x in leaves]
    out = []
    for g, tree in enumerate(trees):
        for i, r in enumerate(tree):
            (low, sub), (high, root) = climb(leaves[g], i, arity), climb(subroots, g, arity)
            changed = r[3] + 1 if r[0] is not None and r[3] is not None and binascii.crc32(str(r[0]).encode()) % 7 == 0 else r[3]
            at = leaf_of(r, changed)
            for before, after in low + high:
                at = h(before, at, after)
            out.append((r[0], leaves[g][i], h(*[a + b for a, b in low + high]), sub, root, at, at == root))
    return sorted(out, key=str)


def proved(docs, **how):
    out = manifest.manifest(docs, claimed=tampered, **how)
    cols = out.select("doc_id", "leaf", F.sha2("proof", 256).alias("proof"), "subroot", "root", "folded_root", "verified")
    return sorted((tuple(r) for r in cols.collect()), key=str)


def rows_of(n, langs):
    return [(i * 3, f"s{i % 4}", langs[i % len(langs)], i, f"text {i}", "x", 1, 2) for i in range(n)]


AWKWARD = [
    (None, None, None, None, None, None, 1, 2), (None, None, None, None, None, None, 1, 2), (None, "s", "en", 1, "of no id", "x", 1, 2),
    (-7, "s", "en", None, "", "x", 1, 2), (5, None, "", 3, "ß" * 70_000, "x", 1, 2), (5, None, "", 3, "ß" * 70_000, "x", 1, 2), (6, "s", "", 3, None, "x", 1, 2),
    (8, "1:a", "zz", 0, "2:b", "x", 1, 2), (14, "s", "é", 9, "t", "x", 1, 2), (0, "s", "en", 4, "t", "x", 1, 2), (0, "s", "en", 4, "u", "x", 1, 2),
]


@pytest.mark.parametrize(("n", "langs", "arity", "part_rows", "fan_in"), [(1, ["en"], 2, 9, 2), (2, ["en", None], 2, 9, 2), (37, ["en"], 2, 4, 2), (64, ["en", "de", "en"], 2, 5, 2), (101, ["a", "b", "b", "b", None, "c", "d"], 3, 7, 3), (60, [f"l{i}" for i in range(23)], 2, 4, 2), (90, ["x"], 5, 8, 32)])
def test_proofs_are_those_of_the_tree(spark, n, langs, arity, part_rows, fan_in):
    rows = rows_of(n, langs)
    got = proved(spark.createDataFrame(rows[::-1], SCHEMA), arity=arity, part_rows=part_rows, fan_in=fan_in)
    assert got == brute(rows, arity)
    assert n < 30 or any(not r[-1] for r in got)


def test_awkward_and_empty_tables(spark):
    for how in ({}, {"part_rows": 2, "fan_in": 2}):
        assert proved(spark.createDataFrame(AWKWARD, SCHEMA), **how) == brute(AWKWARD)
    empty = manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.dtypes == manifest.manifest(spark.createDataFrame(AWKWARD, SCHEMA)).dtypes


def test_copies_of_a_row_are_dealt_over_parts(spark):
    rows = rows_of(40, ["en", "de"]) + [(9, "s", "en", 5, "copy", "x", 1, 2)] * 80
    assert proved(spark.createDataFrame(rows, SCHEMA), part_rows=10, fan_in=2) == brute(rows)


def test_fragments_merge_in_any_order():
    sizes = {0: 13, 1: 5, 2: 1, manifest.TOP: 3}
    leaves = {(t, 0, i): h(str(t), str(i)).encode() for t in range(3) for i in range(sizes[t])}
    whole, left = manifest.settle(leaves, sizes, 2)
    items = sorted(leaves)
    for cuts in ((4, 9), (1, 2, 3, 17), (13, 18)):
        parts = [dict((n, leaves[n]) for n in items[a:b]) for a, b in zip((0, *cuts), (*cuts, len(items)), strict=True)]
        for order in (parts, parts[::-1], parts[1:] + parts[:1]):
            held = {}
            for p in order:
                known, still = manifest.settle(held | p, sizes, 2)
                held = {n: known[n] for n in still}
            assert held == {n: whole[n] for n in left} and len(held) == 1
