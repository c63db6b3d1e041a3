"""MinHash near-duplicate detection with tensored banding.

Two collections of ``m`` half keys are made from two MinHash values each; table (i, j) is keyed by half key i of
the first and half key j of the second collection. So m*m tables with keys of four MinHash values need only 4*m
MinHash values. A pair of similarity s misses all tables with probability below 2 * (1 - s*s)**m (1.9e-5 at 0.75 for
the default m = 14, 1.6e-10 at 0.9). Two sets are candidates if some table has them under one key.

Exact copies of a shingle set are collapsed first. Candidates are never expanded into all pairs of a bucket. First each
set is compared with the smallest set of each of its half keys, if the two share a table; links are contracted to components.
Then the tables are aggregated to the components they hold, and only sets in tables with several components go on.
Among those, pairs of different components are found by an exact positional prefix filter: with shingles in order of
frequency, two similar sets share an early one, at places that leave enough shingles to share. Sets that share a frequent
shingle meet only if their sizes allow the similarity with what is left after that shingle. Every link is confirmed on full sets
of 64-bit shingle hashes.

Edge cases: null, empty or wordless text has an empty set and no links; rows that share a doc_id are one document
whose set is the union over those rows; a null doc_id is a document without links (component null, kept).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lookup, materialize, row_shingles, seeds, text_chunks, word_hashes, word_spans

HALVES = 14
_MULT, _XOR = seeds(2, 4 * HALVES) | np.uint64(1), seeds(3, 4 * HALVES)


def half_keys(sets: np.ndarray, m: int = HALVES) -> np.ndarray:
    """The 2*m half keys of one non-empty set; the first m are the first collection."""
    low = np.empty(4 * m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(4 * m):
            low[i] = ((sets ^ _XOR[i]) * _MULT[i]).min()
        return low[0::2] * np.uint64(0x9E3779B97F4A7C15) ^ (low[1::2] >> np.uint64(7))


def shingle_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in text_chunks(batch.column(1)):
            starts, ends, counts = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends, lower=True)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            yield ids.slice(lo, hi - lo), [row_shingles(hashes[cuts[i] : cuts[i + 1]], k) for i in range(hi - lo)]


def long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, k: int = 5, m: int = HALVES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, digest of the set (null: empty), half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in shingle_batches(batches, k):
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = [half_keys(s, m) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), long_lists(keys)], names=["doc_id", "n_shingles", "digest", "halves"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, halves array<long>")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, shingles array<long>) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in shingle_batches(batches, k):
            yield pa.RecordBatch.from_arrays([ids, long_lists(sets)], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys occur in more than one row."""
    return df.join(df.groupBy(*keys).count().where("count > 1").select(*keys), keys)


def shared_halves(sets: DataFrame) -> DataFrame:
    """(i, half, rep) of half keys that several sets have; sets: (rep, halves). Others cannot make a common table key."""
    return _shared(sets.select("rep", F.posexplode("halves").alias("i", "half")), ["i", "half"])


def table_keys(halves: DataFrame, m: int = HALVES) -> DataFrame:
    """(rep, first struct<i, half>, second struct<i, half>): the tensored table keys of every set of shared_halves()."""
    mine = halves.groupBy("rep").agg(F.collect_list(F.struct("i", "half")).alias("h"))
    split = mine.select("rep", F.filter("h", lambda x: x.i < m).alias("a"), F.filter("h", lambda x: x.i >= m).alias("b"))
    return split.where((F.size("a") > 0) & (F.size("b") > 0)).select("rep", "b", F.explode("a").alias("first")).select("rep", "first", F.explode("b").alias("second"))


def _centers(halves: DataFrame, sets: DataFrame, m: int) -> DataFrame:
    """(a, b): each set with the smallest set of each of its half keys, where the two share a table."""
    lowest = halves.groupBy("i", "half").agg(F.min("rep").alias("a"))
    pairs = halves.join(lowest, ["i", "half"]).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    one, two = sets.select(F.col("rep").alias("a"), F.col("halves").alias("ha")), sets.select(F.col("rep").alias("b"), F.col("halves").alias("hb"))

    def meet(lo: int, hi: int):
        return F.expr(f"exists(sequence({lo}, {hi - 1}), i -> ha[i] = hb[i])")

    return pairs.join(two, "b").join(one, "a").where(meet(0, m) & meet(m, 2 * m)).select("a", "b")


def _mixed_members(halves: DataFrame, labels: DataFrame, m: int) -> DataFrame:
    """(rep): sets with a half key of a table in which sets of several components meet; all sets of such tables are among them."""
    keys = table_keys(halves, m).join(labels.select(F.col("node").alias("rep"), "label"), "rep")
    tables = keys.groupBy("first", "second").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    mixed = tables.select("first.i", "first.half").distinct()
    return halves.join(mixed, ["i", "half"], "left_semi").select("rep").distinct()


#: Size classes of the prefix filter: sizes within one class differ by at most this factor.
CLASS = 1.05


def _class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / math.log(CLASS))


def _prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b, la, lb): pairs of sets (doc_id, shingles) of different components that can reach the similarity.

    Sets of similarity t share at least (|a| + |b|) * t / (1 + t) shingles. If the first shared one, by frequency, is at places i and j,
    they share at most min(|a| - i, |b| - j). So with i, a's partners have at most (|a| - i) * (1 + t) / t - |a| shingles: the
    smaller set of a pair looks for partners from its own size up to that, in classes of sizes, so sets that share a frequent
    shingle but too little after it never meet. Of each shingle's holders, those of its most frequent component are not compared
    with each other.
    """
    tokens = sets.select(F.col("doc_id").alias("d"), F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    frequency = materialize(tokens.groupBy("g").agg(F.count("*").alias("f")).where("f > 1"), "frequency")
    # shingles of one set only come before all others; they need no place of their own
    own = Window.partitionBy("d")
    met = lookup(tokens, frequency, ["g"], "f").withColumn("i", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "g")) - 1)
    early = met.withColumn("most", F.expr(f"((n - i) * {100 + percent}) div {percent} - n")).where(f"most * 100 >= n * {percent}").select("d", "n", "g", "most")
    rows = materialize(early.join(labels.select(F.col("node").alias("d"), "label"), "d"), "prefixes")
    counted = rows.groupBy("g", "label").count().groupBy("g").agg(F.sum("count").alias("k"), F.max_by("label", F.struct("count", "label")).alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    marked = lookup(rows, materialize(counted.where("lo <> hi").select("g", "k", "top"), "holders"), ["g"], "k").withColumn("minor", F.col("label") != F.col("top"))
    small = marked.where("most >= n").select(F.col("g").alias("h"), F.col("d").alias("e"), F.col("n").alias("m"), F.col("most").alias("up"), F.col("label").alias("le"), F.col("minor").alias("few"), F.explode(F.sequence(_class(F.col("n")), _class(F.col("most")))).alias("c"))
    large = marked.select("g", "d", "n", "most", "label", "minor", _class(F.col("n")).alias("class"))
    both = (F.col("h") == F.col("g")) & (F.col("c") == F.col("class")) & (F.col("le") != F.col("label")) & F.col("n").between(F.col("m"), F.col("up")) & (F.col("most") >= F.col("m"))
    pairs = small.join(large.where("minor"), both).unionByName(small.where("few").join(large.where("not minor"), both))
    return pairs.select(F.least("d", "e").alias("a"), F.greatest("d", "e").alias("b"), F.least("label", "le").alias("la"), F.greatest("label", "le").alias("lb")).distinct()


def links_of(docs: DataFrame, k: int = 5, percent: int = 75, m: int = HALVES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, labels).

    documents: doc_id, n_shingles, rep (smallest doc_id of the same set; null for the empty set), one row per doc_id.
    links: a, b - confirmed links between representatives, enough of them to connect every component.
    labels: node, label - the component of every representative that shares a table with another one.
    """
    sig = signatures(docs, k, m)
    if percent < 75:
        raise ValueError("the tables are made for a similarity of at least 75 percent")
    sig = materialize(sig, "signatures")
    repeated = sig.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.limit(1).count():
        again = materialize(_united(docs, repeated, k, m), "united")
        sig = sig.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(again)
    firsts = sig.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"))
    copies = materialize(firsts.where("n > 1").select("digest", "rep"), "copies")
    rep = F.when(F.col("doc_id").isNotNull() & F.col("digest").isNotNull(), F.coalesce("rep", "doc_id"))
    documents = sig.join(copies, "digest", "left").select("doc_id", "n_shingles", rep.alias("rep"), "digest", "halves")
    sets = documents.where("doc_id = rep").select("rep", "halves")
    links, labels = _confirm_all(docs, materialize(sets, "reps"), k, percent, m)
    return documents.select("doc_id", "n_shingles", "rep"), links, labels


def _united(docs: DataFrame, repeated: DataFrame, k: int, m: int) -> DataFrame:
    """Signatures of documents that are spread over several rows, by the union of the rows' sets."""
    rows = shingle_sets(docs.select("doc_id", "text").join(repeated.select("doc_id"), "doc_id", "left_semi"), k)
    whole = rows.select("doc_id", F.explode_outer("shingles").alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(s or [], np.int64).view(np.uint64)) for s in batch.column(1).to_pylist()]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), long_lists([half_keys(s, m) if len(s) else s for s in sets])], names=["doc_id", "n_shingles", "digest", "halves"])

    return whole.mapInArrow(run, "doc_id long, n_shingles long, digest binary, halves array<long>")


def _confirm_all(docs: DataFrame, reps: DataFrame, k: int, percent: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(links, labels) of the representatives reps (rep, halves)."""
    halves = materialize(shared_halves(reps), "halves")
    alone = halves.select(F.col("rep").alias("node"), F.col("rep").alias("label")).distinct()
    members = materialize(_mixed_members(halves, alone, m), "members")
    centers = materialize(_centers(halves, reps, m), "centers")
    sets = _sets_of(docs, members, k)
    links = materialize(_confirm(centers, sets, percent), "links")
    labels = members.select(F.col("rep").alias("node"))
    labels = materialize(labels.join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    left = materialize(_mixed_members(halves, labels, m), "mixed")
    rest = sets.join(left.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    more = materialize(_confirm(_prefix_pairs(rest, labels, percent), sets, percent), "links")
    if more.limit(1).count():
        # links between components, by their labels
        moved = components(more.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("now"))
        labels = materialize(labels.join(moved, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "labels")
    return links.union(more.select("a", "b")), labels


def _sets_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Shingle sets (doc_id, shingles) of the documents members (rep), from their whole texts."""
    texts = docs.select("doc_id", "text").join(members.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = shingle_sets(texts, k)
    if _spread(docs):
        sets = sets.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    return materialize(sets, "sets")


def _spread(docs: DataFrame) -> bool:
    return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    return both.where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent).select(*pairs.columns)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document of docs (doc_id, text)."""
    documents, _, labels = links_of(docs, k, percent)
    out = documents.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    out = out.withColumn("component_id", F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
