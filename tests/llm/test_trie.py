"""Prefix tries of conversations against a trie of dictionaries."""

import binascii
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import trie
from terrafold.llm.queries import QUERIES, conversation_nodes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path int, turns string"
DATA = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        k = binascii.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:k] + own[c][k:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(members[p]) - 1) * (words(p[-1][1]) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p, m in members.items()), key=str)


def found(rows, spark, **how):
    df = conversation_nodes(spark.createDataFrame(rows, SCHEMA), **how)
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(seed, convs, starts, longest):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.randint(1, longest)):
            text = starts[rng.randrange(len(starts))] if t < 3 else rng.choice(["yes", "no  no", "why ?"])
            out.append((c, t, rng.choice(["user", "assistant", None]) if t else "system", text, "x", 1, "y"))
    rng.shuffle(out)
    return out


AWKWARD = [
    (None, 0, "user", "of none", "x", 1, "y"), (20, None, "user", "first", "x", 1, "y"), (20, 3, None, None, "x", 1, "y"), (20, 3, "user", "tie b", "x", 1, "y"),
    (21, 0, "user", "", "x", 1, "y"), (21, 0, "", "user", "x", 1, "y"), (22, 1, "user", "word " * 40_000, "x", 1, "y"), (45, 5, "a", "b", "x", 1, "y"), (46, 5, "a", "b", "x", 1, "y"), (47, 5, "ab", "", "x", 1, "y"),
    (60, 0, "user", "same", "x", 1, "y"), (60, 0, "user", "same", "x", 1, "y"),
]


@pytest.mark.parametrize(("seed", "convs", "starts", "longest"), [(1, 60, ["a", "b b"], 6), (2, 200, ["hello there"], 9), (3, 150, [f"s {i}" for i in range(40)], 4), (4, 300, ["x"], 2)])
def test_nodes_are_those_of_the_trie(spark, seed, convs, starts, longest):
    rows = talks(seed, convs, starts, longest)
    want = brute(rows)
    assert found(rows, spark) == want
    assert found(rows, spark, part_turns=15, fan_in=2) == want
    assert found(rows, spark, part_turns=40, fan_in=3, broadcast_rows=0) == want


def test_awkward_and_empty_tables(spark):
    # Ties of a turn lie in the order of their labels, so only what doesn't depend on it is compared with them.
    ties = [r for r in AWKWARD if r[3] not in ("tie b", "user")]
    assert found(ties, spark) == brute(ties) == found(ties, spark, part_turns=2, fan_in=2)
    got = found(AWKWARD, spark)
    assert sum(r[3] for r in got if r[1] == 0) == 7 and found(AWKWARD[::-1], spark) == got
    empty = conversation_nodes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and [c for c, _ in empty.dtypes] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "t", "x", 1, "y") for c in range(21, 40)]  # no conversation 20: whoever takes a turn of it has none
    got = found(rows, spark)
    assert got == brute(rows) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, DATA).collect()), key=str)
    assert got == brute(rows)


def test_louds_finds_paths():
    rng = random.Random(5)
    label = {x: hashlib.sha256(x.encode()).digest()[:16] for x in "abcde"}
    paths = sorted({tuple(label[rng.choice("abcde")] for _ in range(rng.randint(0, 7))) for _ in range(300)})
    flat = [x for p in paths for x in p]
    labels = np.frombuffer(b"".join(flat), ">u8").astype(np.uint64).reshape(-1, 2)
    built, ends = trie.build(np.array([len(p) for p in paths]), labels, np.ones(len(flat), np.int64))
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(built.words) == len(prefixes) and len(built.bits) == 2 * len(prefixes) - 1
    assert [built.find(list(p)) for p in paths] == ends.tolist()
    assert built.find([label["a"]] * 40) == -1
    parents, children = built.parents(), built.children()
    assert (np.bincount(parents[1:], minlength=len(prefixes)) == children).all() and parents[0] == -1
    for p in prefixes - {()}:
        assert parents[built.find(list(p))] == built.find(list(p[:-1]))


def test_tries_hold_every_node(spark):
    convs = trie.turns(spark.createDataFrame(talks(6, 80, ["a", "b"], 5), SCHEMA))
    parts = trie.tries(convs, part_turns=30).collect()
    assert len(parts) > 1
    for r in parts:
        bits = np.unpackbits(np.frombuffer(r.louds, np.uint8))[: 2 * r.nodes - 1]
        assert bits.sum() == r.nodes - 1 and len(r.labels) == 16 * r.nodes and len(r.words) == 8 * r.nodes
    assert trie.nodes(convs).agg(F.count("*")).first()[0] <= sum(r.nodes for r in parts)
