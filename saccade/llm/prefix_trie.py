"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

Turns are numbered in range-sorted order, so a conversation of any length is spread over tasks. A node is a distinct sequence of
first turns; its name is the exclusive or of hashes of (depth, role, text) over them, 2 x 64 bits, which running windows over pieces
of ``CHUNK`` turns add up. Nodes are counted by a grouped aggregate, so neither a common first turn nor copies of a conversation meet
in one task.

Of each node's children the one with most conversations is heavy (ties: smallest conversation); a node and its heavy child are on one path.
Every light child has at most half of its parent's conversations, so a node has no more light edges above it than the logarithm of their
number. Paths are worked off by that number, the largest first: a path's total is that of its nodes and of the light paths attached to
them, and goes to the node that it hangs from. When all are known, one suffix sum along each path's array of nodes (in
pieces of CHUNK) gives every node's subtree.

The hash of the conversations that end in a node is taken over sorted ids: tasks pack runs of ids to one text of ``PACK``, and the texts
of a node are hashed as a stream. Hashing is sequential by nature; only those texts of a node pass one task, never the rows.

Edge cases: turns of equal number are ordered by role, then the first ``HEAD`` characters of the text, then its MD5; a null turn comes first, null
role or text is empty; rows without conv_id belong to no conversation and go; repeated rows are turns of their own; a rebuilt conversation
without turns ends in the root; no conversations, no nodes. Two different sequences get one name with a probability of about 2**-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import dispose, lookup, materialize

#: Turns, or nodes of a path, that one window adds up; conversation ids of one packed text.
CHUNK, PACK = 1024, 4096
#: Characters of a text that order turns of equal number.
HEAD = 64
#: A conversation takes the first turns of the one that opens its group of GROUP; at most HELD - 1 of them.
GROUP, HELD = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds pos, counting from 1 in each run of a conversation within the partition, and the partition's number."""
    part, last, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sizes = np.diff(np.append(starts, len(ids)))
        pos = np.arange(len(ids)) - np.repeat(starts, sizes) + 1
        if last == ids[0]:
            pos[: sizes[0]] += before
        last, before = ids[-1], int(pos[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos), pa.array(np.full(len(ids), part, np.int32))], names=[*batch.schema.names, "pos", "part"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn), a, b (hashes of role and text), bytes (of the text) of turns (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.md5(F.concat(F.char_length(role), F.lit(":"), role, text).cast("binary"))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.substring(text, 1, HEAD).alias("head"), F.md5(text.cast("binary")).alias("tie"), F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"), F.octet_length(text).alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("tie"), F.col("i")]
    ranged = rows.withColumn("i", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(ranged.select("conv_id", "a", "b", "bytes").mapInArrow(_numbers, "conv_id long, a long, b long, bytes int, pos long, part int"), "turns")
    # a conversation that goes on from one partition to the next: at most the last run of one and the first of another
    edges = local.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max_by("pos", F.struct(F.bitwise_not("conv_id"), F.col("pos"))).alias("lo_n"), F.max("conv_id").alias("hi"), F.max_by("pos", F.struct("conv_id", "pos")).alias("hi_n"))
    runs = edges.select(F.col("lo").alias("conv_id"), "part", F.col("lo_n").alias("n")).union(edges.where("lo <> hi").select("hi", "part", "hi_n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = runs.select("conv_id", "part", earlier.alias("earlier")).where("earlier > 0")  # a row for each partition at most
    return local.join(F.broadcast(shift), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("earlier", F.lit(0))).alias("pos"), "a", "b", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, a, b, bytes of the rebuilt conversations' turns; conv_id, depth of their ends), from numbered_turns()."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HELD
    convs = materialize(convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", held), "conversations")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialize(convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    opening = turns.where(F.col("pos") < HELD).withColumnRenamed("conv_id", "base")
    taken = opening.join(convs.where("h > 0").select("base", "conv_id", "h"), "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "a", "b", "bytes")
    own = lookup(turns, convs.where("n > h").select("conv_id", "n", "h", "k"), ["conv_id"]).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "bytes")
    ends = convs.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    return taken.unionByName(own), ends


def _name(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("u"), F.xxhash64(F.lit(1), *columns).alias("v")]


def _in_chunk() -> WindowSpec:
    return Window.partitionBy("conv_id", "chunk").orderBy("depth")


def _deep(rows: DataFrame, lasts: DataFrame) -> DataFrame:
    """rows with what lasts (conv_id, chunk, ...) has for their chunk; first chunks have nothing before them and are not shuffled."""
    names = [c for c in lasts.columns if c not in ("conv_id", "chunk")]
    first = rows.where("chunk = 0").select("*", *[F.lit(None).cast(lasts.schema[c].dataType).alias(c) for c in names])
    return first.unionByName(rows.where("chunk > 0").join(lasts, ["conv_id", "chunk"], "left"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, chunk, u, v (the node), pu, pv (its parent), bytes for each turn of rebuilt conversations."""
    steps = turns.select("conv_id", "depth", "bytes", F.expr(f"(depth - 1) div {CHUNK}").alias("chunk"), *_name(F.col("depth"), F.col("a"), F.col("b")))
    w = _in_chunk().rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(steps.withColumn("xu", F.bit_xor("u").over(w)).withColumn("xv", F.bit_xor("v").over(w)), "prefixes")
    # the last turn of a full chunk has the chunk's whole
    ends = local.where(F.col("depth") % CHUNK == 0).select("conv_id", (F.col("chunk") + 1).alias("chunk"), "xu", "xv")
    upto = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    lasts = ends.select("conv_id", "chunk", F.bit_xor("xu").over(upto).alias("cu"), F.bit_xor("xv").over(upto).alias("cv"))
    out = _deep(local, lasts)
    u, v = (F.col(f"x{c}").bitwiseXOR(F.coalesce(f"c{c}", F.lit(0))) for c in "uv")
    return out.select("conv_id", "depth", "chunk", "bytes", u.alias("nu"), v.alias("nv"), u.bitwiseXOR(F.col("u")).alias("pu"), v.bitwiseXOR(F.col("v")).alias("pv")).withColumnsRenamed({"nu": "u", "nv": "v"})


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))


def trie_nodes(rows: DataFrame) -> DataFrame:
    """u, v, first (smallest member), n (members), heavy, n_children of all nodes but the root, from prefixes()."""
    nodes = rows.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.min("pu").alias("pu"), F.min("pv").alias("pv"))
    nodes = materialize(nodes, "nodes")
    best = F.max(F.struct("n", F.bitwise_not("first").alias("order"), "u", "v"))
    children = materialize(nodes.groupBy("pu", "pv").agg(F.count("*").alias("n_children"), best.alias("best")), "children")
    heavy = children.select("best.u", "best.v", F.lit(True).alias("heavy"))
    counts = children.select(F.col("pu").alias("u"), F.col("pv").alias("v"), "n_children")
    out = nodes.join(heavy, ["u", "v"], "left").join(counts, ["u", "v"], "left")
    flagged = materialize(out.select("u", "v", "first", "n", F.coalesce("heavy", F.lit(False)).alias("heavy"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "nodes")
    at_root = children.where("pu = 0 and pv = 0").agg(F.max("n_children")).first()[0] or 0
    for table in (nodes, children):
        dispose(table)
    return flagged, at_root


def on_paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per node but the root: u, v, pu, pv, depth, bytes, first, n, n_children, parent_first, light, head, level, up_head.

    head is the node that the heavy path begins with, level the number of light edges above it (and in it), up_head the
    head of the path that a light node hangs from; null parent_first and head stand for the root.
    """
    flagged = lookup(rows, nodes, ["u", "v"]).withColumn("light", ~F.col("heavy"))
    here = F.struct("u", "v")
    upto = _in_chunk().rowsBetween(Window.unboundedPreceding, 0)
    local = flagged.withColumn("head", F.last(F.when(F.col("light"), here), ignorenulls=True).over(upto)).withColumn("level", F.sum(F.col("light").cast("long")).over(upto))
    local = local.withColumn("up_head", F.lag("head").over(_in_chunk())).withColumn("parent_first", F.lag("first").over(_in_chunk()))
    # a node is written by its smallest member; the last turns of chunks carry on to the next one
    local = materialize(local.where((F.col("conv_id") == F.col("first")) | (F.col("depth") % CHUNK == 0)), "paths")
    ends = local.where(F.col("depth") % CHUNK == 0).select("conv_id", (F.col("chunk") + 1).alias("chunk"), "head", "level", F.col("first").alias("c_first"))
    upto = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    lasts = ends.select("conv_id", "chunk", F.last("head", ignorenulls=True).over(upto).alias("c_head"), F.sum("level").over(upto).alias("c_level"), "c_first")
    out = _deep(local.where("conv_id = first"), lasts)
    opens = (F.col("depth") - 1) % CHUNK == 0
    return out.select(
        "u", "v", "pu", "pv", "depth", "bytes", "first", "n", "n_children", "light",
        F.when(opens, F.col("c_first")).otherwise(F.col("parent_first")).alias("parent_first"),
        F.coalesce("head", "c_head", _root()).alias("head"),
        (F.col("level") + F.coalesce("c_level", F.lit(0))).alias("level"),
        F.coalesce("up_head", "c_head", _root()).alias("up_head"),
    )


def attached_totals(nodes: DataFrame) -> DataFrame:
    """u, v, leaves, saved: what the light paths that hang from a node hold together, by rounds from the paths with most light edges above."""
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    top = F.max(F.when(F.col("light"), F.struct("up_head", "pu", "pv"))).alias("top")
    paths = materialize(nodes.groupBy("head").agg(*sums, F.max("level").alias("level"), top), "heavy-paths")
    level, done = paths.agg(F.max("level")).first()[0] or 0, []
    above = None
    while level > 0:
        own = paths.where(F.col("level") == level).select("head", "leaves", "saved", "top")
        if above is not None:
            own = own.unionByName(above.select(F.col("top.up_head").alias("head"), "leaves", "saved", F.lit(None).cast(paths.schema["top"].dataType).alias("top")))
        above = materialize(own.groupBy("head").agg(*sums, F.max("top").alias("top")), "totals")
        done.append(above)
        level -= 1
    if not done:
        return paths.where("1 = 0").select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), "leaves", "saved")
    all_ = done[0]
    for table in done[1:]:
        all_ = all_.unionByName(table)
    return all_.groupBy(F.col("top.pu").alias("u"), F.col("top.pv").alias("v")).agg(*sums)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes with leaves and saved summed over their subtrees: suffix sums along the arrays of the heavy paths."""
    attached = attached_totals(nodes).withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
    valued = nodes.join(attached, ["u", "v"], "left").withColumn("piece", F.expr(f"depth div {CHUNK}"))
    valued = materialize(valued.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved"), "valued")
    pieces = valued.groupBy("head", "piece").agg(*[F.sum(c).alias(f"below_{c}") for c in ("leaves", "saved")])
    deeper = Window.partitionBy("head").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    below = pieces.select("head", "piece", *[F.sum(c).over(deeper).alias(c) for c in ("below_leaves", "below_saved")]).where("below_leaves is not null")
    suffix = Window.partitionBy("head", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = valued.withColumns({c: F.sum(c).over(suffix) for c in ("leaves", "saved")}).join(below, ["head", "piece"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"below_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("below_leaves", "below_saved", "piece")


def _runs(ids: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    new = np.ones(len(ids[0]), bool)
    new[1:] = (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])
    return np.append(np.flatnonzero(new), len(new))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, conv_id) in order as (u, v, smallest conv_id, ids joined by commas), PACK ids at most."""
    for batch in batches:
        u, v, ids = (batch.column(i).to_numpy() for i in range(3))
        at = _runs((u, v))
        starts = np.unique(np.concatenate([at, *[np.arange(a, b, PACK) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > PACK]]))
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        first = starts[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(v[first]), pa.array(ids[first]), pa.array(texts, pa.string())], names=["u", "v", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, first, ids) in order as (u, v, SHA-256 of all ids of the node); one running hash is all that is kept."""
    node, state = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["u", "v", "sha"])

    for part in batches:
        done = []
        for u, v, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
            if node == (u, v):
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (u, v), hashlib.sha256(ids.encode())
        yield batch(done)
    if node is not None:
        yield batch([(*node, state.hexdigest())])


def end_hashes(ends: DataFrame) -> DataFrame:
    """u, v, sha of ends (u, v, conv_id): SHA-256 of the node's decimal conv_ids, ascending, joined by commas."""
    order = ["u", "v", "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed, "u long, v long, first long, ids string")
    return packed.repartition("u", "v").sortWithinPartitions("u", "v", "first").mapInArrow(_hashed, "u long, v long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node of the trie."""
    turns, lengths = rebuilt(numbered_turns(conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")))
    rows, lengths = materialize(prefixes(turns), "rows"), materialize(lengths, "ends")
    total, least = lengths.agg(F.count("*"), F.min("conv_id")).first()
    nodes, at_root = trie_nodes(rows)
    own = on_paths(rows, nodes)
    long = lambda value: F.lit(value).cast("long")
    zero = long(0)
    root = lengths.limit(1).select(
        zero.alias("u"), zero.alias("v"), zero.alias("pu"), zero.alias("pv"), zero.alias("depth"), F.lit(0).alias("bytes"), long(least).alias("first"), long(total).alias("n"), long(at_root).alias("n_children"),
        F.lit(False).alias("light"), F.lit(None).cast("long").alias("parent_first"), _root().alias("head"), zero.alias("level"), _root().alias("up_head"),
    )
    full = own.withColumn("parent_first", F.coalesce("parent_first", long(least))).unionByName(root)
    full = full.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes"))
    summed = subtree_sums(materialize(full, "full"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "u", "v")).alias("end")).select("conv_id", "end.u", "end.v")
    ends = last.unionByName(lengths.where("depth = 0").select("conv_id", zero.alias("u"), zero.alias("v")))
    out = summed.join(end_hashes(materialize(ends, "ends")), ["u", "v"], "left")
    return out.select(F.col("first").alias("conv_id"), F.col("depth"), F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))
