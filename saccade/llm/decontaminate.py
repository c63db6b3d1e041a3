"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document contains an item if it has at least ``percent`` of the item's distinct shingles (five words, A-Z folded). Under a
random order of shingles, the item's smallest one is in the document with a probability equal to the containment. So only the
``HASHES`` MinHash shingles of each item are indexed, and a document becomes a candidate for an item if it has enough of them. How
many depends on the document's size partition: long documents meet values by chance more often and must have more of
them. A contained item is missed with a probability below 3e-10, 2e-8 and 5e-7 in the three partitions. Items
of at most ``HASHES`` shingles are indexed by all of them.

Candidates are then verified by joins: the candidate documents' shingles with all shingles of the items they are candidates for.

The index is broadcast in blocks of at most ``BLOCK`` values (HASHES an item, whatever its length), each block one pass over the
documents, so what is sent to the executors is bounded whatever the number of items.

Edge cases: a text of fewer than five words is one shingle; null, empty or wordless items and documents contain
nothing; rows that share an id are compared one by one and give one result row, the best. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, mark, materialize, row_shingles, seeds, shingle_hashes, text_chunks, word_hashes, word_spans
from .near_dup import long_lists, shingle_batches

HASHES = 16
#: Index values of one broadcast: 16 bytes each.
BLOCK = 4_000_000
#: Size partitions of documents, by their number of words: (up to, MinHash values to be found).
PARTITIONS = ((1 << 10, 1), (1 << 13, 2), (1 << 62, 3))
#: Shingles of a candidate document in one row.
CHUNK = 1 << 16
_MULT, _XOR = seeds(4, HASHES) | np.uint64(1), seeds(5, HASHES)
_BITS = 22


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The MinHash shingles of a set, and by how many of the hash functions each is picked; of a small set all, counting fully."""
    if len(shingles) <= HASHES:
        return shingles, np.full(len(shingles), HASHES)
    with np.errstate(over="ignore"):
        low = [int(((shingles ^ _XOR[i]) * _MULT[i]).argmin()) for i in range(HASHES)]
    at, n = np.unique(low, return_counts=True)
    return shingles[at], n


def item_sets(items: DataFrame, k: int = 5) -> DataFrame:
    """item (key of id and set), item_id, shingles, size, picks, weights of items (item_id, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in shingle_batches(batches, k):
            signed = [signature(s) for s in sets]
            weights = pa.array([w.tolist() for _, w in signed], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, long_lists(sets), pa.array([len(s) for s in sets], pa.int64()), long_lists([p for p, _ in signed]), weights], names=["item_id", "shingles", "size", "picks", "weights"])

    sets = items.select("item_id", "text").mapInArrow(run, "item_id long, shingles array<long>, size long, picks array<long>, weights array<int>")
    return sets.where("size > 0").withColumn("item", F.xxhash64("item_id", "shingles")).dropDuplicates(["item"])


class Index:
    """MinHash values of a block of items with their items and weights, in the order of the values."""

    def __init__(self, rows: pa.Table):
        values = rows.column("value").to_numpy().view(np.uint64)
        order = np.argsort(values, kind="stable")
        self.items = rows.column("item").to_numpy()[order]
        self.weights = rows.column("weight").to_numpy()[order]
        self.values, self.first = np.unique(values[order], return_index=True)
        self.first = np.append(self.first, len(values))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are values of the index, which values)."""
        likely = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.values, hashes[likely])
        hit = at < len(self.values)
        hit[hit] = self.values[at[hit]] == hashes[likely[hit]]
        return likely[hit], at[hit]

    def candidates(self, column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, items that it may contain, its shingles)."""
        for lo, _, data, offsets in text_chunks(column):
            starts, ends, counts = word_spans(data, offsets)
            words = word_hashes(data, starts, ends, lower=True)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            which, at = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(words) >= k:
                likely, at = self.places(shingle_hashes(words, k))
                which = np.searchsorted(cuts, likely, "right") - 1
                inside = likely + k <= cuts[which + 1]
                which, at = which[inside], at[inside]
            for short in np.flatnonzero((counts > 0) & (counts < k)):
                found = self.places(row_shingles(words[cuts[short] : cuts[short + 1]], k))[1]
                which, at = np.append(which, np.full(len(found), short)), np.append(at, found)
            if not len(at):
                continue
            pairs = np.unique(np.stack([which, at]), axis=1)
            for row in np.unique(pairs[0]):
                items = self._enough(pairs[1][pairs[0] == row], int(counts[row]))
                if len(items):
                    yield lo + int(row), items, row_shingles(words[cuts[row] : cuts[row + 1]], k)

    def _enough(self, values: np.ndarray, words: int) -> np.ndarray:
        places = np.concatenate([np.arange(self.first[v], self.first[v + 1]) for v in values])
        items, own = np.unique(self.items[places], return_inverse=True)
        need = next(n for most, n in PARTITIONS if words <= most)
        return items[np.bincount(own, self.weights[places]) >= need]


def _blocks(sets: DataFrame) -> Iterator[Index]:
    total = sets.agg(F.sum(F.size("picks"))).first()[0] or 0
    n = -(-2 * total // BLOCK)
    for b in range(n):
        part = sets.where(F.pmod("item", F.lit(n)) == b) if n > 1 else sets
        rows = part.select("item", F.explode(F.arrays_zip("picks", "weights")).alias("v")).select("item", F.col("v.picks").alias("value"), F.col("v.weights").alias("weight")).toArrow()
        if rows.num_rows:
            yield Index(rows)


_FOUND = "doc_id long, mark long, item long, shingles array<long>"


def candidates(docs: DataFrame, sets: DataFrame, k: int = 5) -> DataFrame:
    """Of docs (doc_id, text): a row (doc_id, mark, item) per candidate, and the candidate documents' shingles (item null) in chunks."""
    spark: SparkSession = docs.sparkSession
    rows, out = docs.select("doc_id", mark().alias("mark"), "text"), spark.createDataFrame([], _FOUND)
    for block in _blocks(sets):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, items, parts = [], [], []
                for row, found, shingles in shared.value.candidates(batch.column(2), k):
                    chunks = [shingles[i : i + CHUNK] for i in range(0, len(shingles), CHUNK)]
                    at += [row] * (len(found) + len(chunks))
                    items += [*found.tolist(), *[None] * len(chunks)]
                    parts += [*[np.empty(0, np.uint64)] * len(found), *chunks]
                    if sum(map(len, parts)) > 4 * CHUNK:
                        yield pack(batch, at, items, parts)
                        at, items, parts = [], [], []
                if at:
                    yield pack(batch, at, items, parts)

        def pack(batch: pa.RecordBatch, at: list, items: list, parts: list) -> pa.RecordBatch:
            index = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(items, pa.int64()), long_lists(parts)], names=["doc_id", "mark", "item", "shingles"])

        out = out.unionByName(rows.mapInArrow(run, _FOUND))
    return out


def verified(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, mark, item_id, shared, item_shingles of the items that rows of docs contain, exactly."""
    sets = materialize(item_sets(items, k), "items")
    found = materialize(candidates(docs, sets, k), "candidates")
    pairs = found.where("item is not null").select("doc_id", "mark", "item").distinct()
    own = found.where("item is null").select("doc_id", "mark", F.explode("shingles").alias("g")).distinct()
    wanted = sets.join(pairs.groupBy("item").agg(F.count("*").alias("n")), "item").select("item", "item_id", "size", "shingles", "n")
    wanted = lookup(pairs, materialize(wanted, "wanted"), ["item"]).select("doc_id", "mark", "item", "item_id", "size", F.explode("shingles").alias("g"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "item", "item_id", "size", F.col("g").alias("s"))
    both = wanted.join(own, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")) & (F.col("s") == F.col("g")))
    counted = both.groupBy("doc_id", "mark", "item", "item_id", "size").agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") * 100 >= F.col("size") * percent).select("doc_id", "mark", "item_id", "shared", F.col("size").alias("item_shingles"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: the items (item_id, text) that docs (doc_id, text) contain."""
    out = verified(docs, items, k, percent).withColumn("containment", F.col("shared") / F.col("item_shingles"))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.shared", "b.item_shingles", "b.containment")


def keep_uncontaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    bad = verified(docs, items, k, percent).select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct()
    rows = docs.select("doc_id", mark().alias("mark"), F.struct("*").alias("row"))
    kept = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
