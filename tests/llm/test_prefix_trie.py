"""The prefix trie against a plain trie, with ties, gaps, copies, long and turnless conversations."""

import hashlib
import random
import zlib

import pytest

from saccade.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, head string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA)


def plain(rows):
    """The nodes of a dictionary trie."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    ends = {}
    for c in own:
        base = c - int(c - (c // 5) * 5 if c >= 0 else -((-c) % 5))
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -10**9, len(m), len(children.get(n, [])), leaves[n], saved[n], sha(ends.get(n, []))) for n, m in members.items())


def got(spark, rows, partitions=3):
    out = prefix_trie.prefix_trie(frame(spark, rows).repartition(partitions))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r.conv_id, r.depth, -10**9 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in out.collect())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [("user", "hi") if rng.random() < 0.7 else ("user", f"q{rng.randrange(4)}")]
        turns += [(("assistant", "user")[i % 2], f"t{rng.randrange(2)} é") for i in range(rng.randrange(0, 14))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    # copies, a conversation without its group's first one, negative ids
    rows += [(c, i, r, t) for c in range(1000, 1040) for i, (r, t) in enumerate([("user", "same"), ("assistant", "answer")])]
    rows += [(c, 0, "user", "alone") for c in range(5001, 5030, 5)] + [(-c, i, "user", f"neg{i % 2}") for c in range(1, 12) for i in range(9)]
    return rows


@pytest.mark.parametrize("chunk", [2, 1024])
def test_trie_against_a_plain_one(spark, monkeypatch, chunk):
    """Small pieces carry sums from chunk to chunk; small packs hash a node's ids over many texts."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PACK", 3)
    rows = conversations(3, 60)
    rows += [(70, None, "user", "null turn"), (70, 0, None, None), (70, 0, "", ""), (70, 0, "user", "tie b"), (70, 0, "user", "tie a"), (70, 5, "user", "z" * 5000), (70, 5, "user", "z" * 5001)]
    rows += [(None, 0, "user", "nobody"), (71, 0, "user", "hi"), (71, 0, "user", "hi")]
    assert got(spark, rows) == plain(rows)


def test_long_conversation_is_spread_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, i, "user", f"turn {i if i < 40 * c else i * c}") for c in (1, 2, 3) for i in range(150)] + [(4, 0, "user", "turn 0")]
    turns = prefix_trie.numbered_turns(frame(spark, rows).repartition(4))
    assert sorted((r.conv_id, r.pos) for r in turns.collect()) == sorted((c, i + 1) for c, i, *_ in rows)
    assert got(spark, rows) == plain(rows)


def test_numbers_go_on_across_partitions(spark):
    """One conversation that fills several range partitions, all its turns equal."""
    rows = [(8, 1, "user", "same")] * 3000 + [(9, 1, "user", "other")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.numbered_turns(frame(spark, rows).repartition(4))
        assert sorted((r.conv_id, r.pos) for r in turns.collect()) == [(8, i + 1) for i in range(3000)] + [(9, 1)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_and_empty(spark):
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(alone, 0, "user", "a"), (alone, 1, "user", "b")]
    assert got(spark, rows) == plain(rows) == [(alone, 0, -10**9, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert got(spark, []) == [] == got(spark, [(None, 1, "user", "x")])


def test_light_edges_are_few(spark):
    """A node has no more light edges above it than the logarithm of the number of conversations."""
    rows = conversations(5, 60)
    turns, _ = prefix_trie.rebuilt(prefix_trie.numbered_turns(frame(spark, rows)))
    rows_ = prefix_trie.materialize(prefix_trie.prefixes(turns), "rows")
    nodes, _ = prefix_trie.trie_nodes(rows_)
    paths = prefix_trie.on_paths(rows_, nodes).collect()
    assert max(r.level for r in paths) <= 7 and len({(r.u, r.v) for r in paths}) == len(paths) == nodes.count()
