"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each of its documents the same fractional number of copies, target / source
size. The whole part is taken; the fractional parts are rounded in pairs: mass (copies times words) moves between two
documents in a random direction until one of them is integral, so the source's total stays as it is and each document's
expectation is kept. Buckets of at most about ``BUCKET`` documents are rounded independently; the one unresolved
document of each bucket goes to the next level of a reduction tree, until one per source is left, which is drawn. So a
source's taken words differ from its target by less than one document.

All random numbers come from hashes of document ids, so reruns agree whatever the partitioning.

Edge cases: rows that share doc_id and source are one document with their summed size; a null doc_id or source is a
value of its own, null sources come last; documents without words have size 0 and take nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialize, splitmix, word_count

WEIGHTS = (3, 1, 2)
BUCKET = 4096
#: Tells a document without an id from the one with id 0.
_NULL_KEY = np.uint64(0xD1342543DE82EF95)


def _known(source: str) -> Column:
    """The source as a value that equals itself also where it is null."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank 0, 1, ... by source in code-point order, null last; no task gets all rows."""
    ordered = sources.orderBy(F.col("source").isNull(), "source").withColumn("m", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("part", F.shiftright("m", 33)), "ranked")
    parts = ordered.groupBy("part").count()
    before = parts.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    return ordered.join(before.select("part", "before"), "part").withColumn("rank", F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).drop("m", "part", "before")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, documents) with rank and target.

    Together the targets are share times all sizes, in proportion to the weights; none is above most times its size.
    """
    ranked = materialize(_ranked(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # what is left for the sources below their limit, by weight
        over = F.col("weight") * level >= F.col("source_size") * most if capped >= 0 else F.lit(False)
        got = ranked.agg(F.sum(F.when(over, F.col("source_size") * most)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if got[2] == capped or not got[1]:
            break
        capped = got[2]
        level = (total * share - (got[0] or 0.0)) / got[1]
    target = F.least(F.col("weight") * level, F.col("source_size") * most)
    return ranked.withColumn("target", F.when(F.lit(not got[1]), F.col("source_size") * most).otherwise(target))


def _uniform(keys: np.ndarray, level: int) -> np.ndarray:
    mixed = splitmix(splitmix(keys) ^ np.uint64(level + 1))
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def round_pairs(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds parts (0 to 1) to 0 or 1 but for at most one, keeping the sum of sizes * parts. All sizes are above 0."""
    out, size, draw = parts.tolist(), sizes.tolist(), draws.tolist()
    open_ = -1
    for j, p in enumerate(out):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[j] = float(round(p))
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        q, si, sj = out[i], size[i], size[j]
        up, down = min((1 - q) * si, p * sj), min(q * si, (1 - p) * sj)
        if draw[j] * (up + down) < down:
            q, p = q + up / si, p - up / sj
        else:
            q, p = q - down / si, p + down / sj
        open_ = -1
        for k, v in ((i, q), (j, p)):
            if v <= 1e-9 or v >= 1 - 1e-9:
                out[k] = float(round(v))
            else:
                out[k], open_ = v, k
    return np.array(out)


_ROUNDED = "none boolean, id long, rank long, size long, part double"


def _level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Rounds each (rank, bucket) of rows (none: there is no doc_id, then id is 0); last: a single open part is drawn.

    Ids stay 64-bit integers all the way: a nullable column would come as floats, in which large ids collide.
    """

    def run(table: pa.Table) -> pa.Table:
        none, ids = table.column("none").to_numpy(), table.column("id").to_numpy()
        key = splitmix(ids.view(np.uint64)) ^ (none.astype(np.uint64) * _NULL_KEY)
        at = np.lexsort((ids, none, splitmix(key + np.uint64(level))))
        table, key = table.take(pa.array(at)), key[at]
        parts = round_pairs(table.column("size").to_numpy(), table.column("part").to_numpy(), _uniform(key, level))
        if last:
            parts = np.where((parts > 0) & (parts < 1), (_uniform(key, 1_000_003) < parts).astype(float), parts)
        return pa.table({**{c: table.column(c) for c in ("none", "id", "rank", "size")}, "part": pa.array(parts)})

    return rows.groupBy("rank", "bucket").applyInArrow(run, _ROUNDED)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document of docs (doc_id, source, text)."""
    units = docs.select("doc_id", "source", word_count().alias("size")).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    units = materialize(units, "units")
    sources = materialize(targets(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), weights, share, most), "targets")
    named = sources.select(_known("source").alias("its"), "rank", "source_size", "documents", "target")
    full = lookup(units.withColumn("its", _known("source")), materialize(named, "named"), ["its"], "documents").drop("its")
    full = full.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    full = full.withColumn("whole", F.floor(F.col("ratio") + 1e-9))
    keys = (F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"))
    open_ = full.where("size > 0").select(*keys, "rank", "size", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)).alias("part"), F.expr(f"pmod(xxhash64(doc_id is null, coalesce(doc_id, 0)), greatest(1, cast(ceil(documents / {BUCKET}) as bigint)))").alias("bucket"))
    done, level = None, 0
    most_open = sources.agg(F.max(F.ceil(F.col("documents") / BUCKET))).first()[0] or 1
    while True:
        last = most_open <= 1
        rounded = materialize(_level(open_, level, last), "rounded")
        settled = rounded.where("part = 0 or part = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        level += 1
        most_open = -(-most_open // BUCKET)
        open_ = rounded.where("part > 0 and part < 1").withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "none", "id"), F.lit(int(most_open))))
    done = done.select(F.when(~F.col("none"), F.col("id")).alias("d"), F.col("rank").alias("r"), "part")
    out = full.join(done, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rank") == F.col("r")), "left")
    out = out.withColumn("copies", (F.col("whole") + F.coalesce("part", F.lit(0.0))).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document of docs as many times as it is taken, with copy_no counting from 1.

    Documents that are not taken go; documents without words have nothing to take and go too. If docs have a column copy_no,
    it stays and the new one is copy_no_1, or the next name that is free.
    """
    taken = mix(docs).where("taken > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), "copies")
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"))
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    name = next(n for n in ("copy_no", *(f"copy_no_{i}" for i in range(1, len(docs.columns) + 2))) if n not in docs.columns)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("copy").alias(name))
