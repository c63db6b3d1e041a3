"""Substring dedup: removes words of 50-word windows that also start in a document with a smaller doc_id.

Windows are routed first, so that the search is linear in the corpus. Every window selects its smallest ten-word hash as its
anchor (winnowing), so equal windows have equal anchors. Only anchors that occur in two documents go on; the windows that one
anchor occurrence answers for form a segment of text. Equal segments are pre-aggregated, with the smallest document that
has them; up to here they are places (row, start, size) and hashes. The words of each distinct segment are then cut, once, from the text of
the first row that has it. All distinct segments of an anchor meet in one shard, which builds a compressed FM-index over wavelet trees of them. The
segments are streamed through the index by backward search; matching statistics give each window's interval, the interval its
smallest document. Every removal comes from that: a place loses the windows whose smallest document is before its own.

An anchor with more than ``HOT`` distinct segments would make a shard too large. Its segments are cut into single windows, which are
then segments like others, each with its own hash as anchor, and go the same way; their results return to the segments they
were cut from.

Edge cases: null text has no words; rows that share a doc_id never repeat each other, and each row has its own positions; rows with a null
doc_id lose nothing. Words are compared by 64-bit hashes, anchors and segments by 64-bit hashes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dispose, lookup, mark, materialize, shingle_hashes, text_chunks, word_hashes, word_spans
from .fm_index import FMIndex

WINDOW = 50
GRAM = 10
#: Distinct segments of one anchor that may meet in a shard.
HOT = 4000
#: Words of a shard, on average.
SHARD_WORDS = 250_000


def anchors_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of a document: (gram hashes, position of the anchor of each window)."""
    hashes = shingle_hashes(words, gram)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window - gram + 1)
    return hashes, view.argmin(1) + np.arange(len(view))


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(row, word hashes, bytes, word starts, word ends) of each row."""
    for lo, hi, data, offsets in text_chunks(column):
        starts, ends, counts = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        raw = data.tobytes()
        for i in range(hi - lo):
            own = slice(cuts[i], cuts[i + 1])
            yield lo + i, hashes[own], raw, starts[own], ends[own]


def _join(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


_ANCHORS = "doc_id long, mark long, anchor long"


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, mark, anchor: the anchors of each row of docs."""

    def pack(batch: pa.RecordBatch, rows: list, found: list) -> pa.RecordBatch:
        index = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "mark", "anchor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, words, *_ in _words(batch.column(2)):
                if len(words) >= window:
                    hashes, at = anchors_of(words, window, gram)
                    own = np.unique(hashes[at])
                    rows.append(np.full(len(own), row, np.int64))
                    found.append(own)
                if len(rows) >= 512:
                    yield pack(batch, rows, found)
                    rows, found = [], []
            if rows:
                yield pack(batch, rows, found)

    return docs.where("doc_id is not null").select("doc_id", mark().alias("mark"), "text").mapInArrow(run, _ANCHORS)


_STAGED = "doc_id long, mark long, n_words long, kept string, text string, segments array<struct<start:int,size:int,anchor:long,hash:long>>"


def _staged(docs: DataFrame, shared: DataFrame, window: int, gram: int, digest: bool) -> DataFrame:
    """Rows of docs, each with a number (row): without shared anchors finished, the others with their text and segments.

    The numbers differ between runs, so the rows must be written before they are used.
    """
    own = shared.groupBy("doc_id", "mark").agg(F.collect_list("anchor").alias("anchors"))
    joined = docs.select("doc_id", mark().alias("mark"), "text").join(own, ["doc_id", "mark"], "left").select("doc_id", "mark", "text", "anchors")
    struct = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("anchor", pa.int64()), ("hash", pa.int64())])

    def segments(words: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, anchors: list[int]) -> list[dict]:
        hashes, at = anchors_of(words, window, gram)
        shared_here = np.isin(hashes[at].view(np.int64), np.array(anchors, np.int64))
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out = []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(at)).tolist(), strict=True):
            if shared_here[a]:
                end = b - 1 + window
                key = int.from_bytes(hashlib.blake2b(_join(raw, starts[a:end], ends[a:end]), digest_size=8).digest(), "little", signed=True)
                out.append({"start": a, "size": end - a, "anchor": int(hashes[at[a]].view(np.int64)), "hash": key})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                listed = batch.column(3).to_pylist()
                n, kept, texts, parts = [], [], [], []
                for row, words, raw, starts, ends in _words(batch.column(2)):
                    n.append(len(words))
                    if listed[row] is None:
                        kept.append(_finish(_join(raw, starts, ends), digest))
                        texts.append(None)
                        parts.append(None)
                    else:
                        kept.append(None)
                        texts.append(batch.column(2)[row].as_py())
                        parts.append(segments(words, raw, starts, ends, listed[row]) if len(words) >= window else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.string()), pa.array(parts, pa.list_(struct))], names=["doc_id", "mark", "n_words", "kept", "text", "segments"])

    return joined.mapInArrow(run, _STAGED).withColumn("row", F.monotonically_increasing_id())


_CUT = "anchor long, hash long, n long, first long, last long, words string"


def _cut(distinct: DataFrame, staged: DataFrame) -> DataFrame:
    """distinct segments (anchor, hash, n, first, last, at) with their words, cut from the staged text at their place."""
    parts = F.collect_list(F.struct("at.start", "size", "anchor", "hash", "n", "first", "last"))
    own = distinct.groupBy(F.col("at.row").alias("row")).agg(parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                lists = batch.column(1)
                cuts, flat = lists.offsets.to_numpy(), lists.values
                places, sizes = flat.field("start").to_numpy(), flat.field("size").to_numpy()
                for row, _, raw, starts, ends in _words(batch.column(0)):
                    for a in range(cuts[row], cuts[row + 1], 1024):
                        b = min(a + 1024, cuts[row + 1])
                        words = [_join(raw, starts[p : p + n], ends[p : p + n]).decode() for p, n in zip(places[a:b].tolist(), sizes[a:b].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([*[flat.field(c)[a:b] for c in ("anchor", "hash", "n", "first", "last")], pa.array(words, pa.string())], names=["anchor", "hash", "n", "first", "last", "words"])

    return staged.select("row", "text").join(own, "row").select("text", "parts").mapInArrow(run, _CUT)


def _finish(text: bytes, digest: bool) -> str:
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


_FOUND = "anchor long, hash long, n long, spans array<struct<start:int,end:int,least:long>>"


def _search(segments: DataFrame, shards: int, window: int) -> DataFrame:
    """anchor, hash, n, spans of distinct segments (anchor, hash, words, first, last, n).

    spans: runs of windows, from window start to before window end, with the smallest document that has them. Runs that no
    place of the segment can lose are left out; segments without any go.
    """

    def run(table: pa.Table) -> pa.Table:
        firsts, lasts = table.column("first").to_numpy(), table.column("last").to_numpy()
        parts = [w for _, w, *_ in _words(table.column("words").combine_chunks())]
        index = FMIndex(parts, firsts, window)
        take, spans = [], []
        for lo in range(0, len(parts), 2048):
            queries = parts[lo : lo + 2048]
            length, low, _ = index.matching_statistics(queries)
            row, at = np.nonzero(length >= window)
            least = index.value(low[row, at].astype(np.int64))
            lose = least < lasts[lo + row]
            row, least = row[lose], least[lose]
            at = (at[lose] - length.shape[1]) + np.array([len(q) for q in queries])[row]
            if not len(row):
                continue
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
            last = np.append(new[1:], True)
            own = np.flatnonzero(np.concatenate([[True], row[new][1:] != row[new][:-1]]))
            take.append(row[new][own] + lo)
            flat = pa.StructArray.from_arrays([pa.array(at[new].astype(np.int32)), pa.array((at[last] + 1).astype(np.int32)), pa.array(least[new])], names=["start", "end", "least"])
            spans.append(pa.ListArray.from_arrays(pa.array(np.append(own, new.sum()).astype(np.int32)), flat))
        out = table.select(["anchor", "hash", "n"]).take(pa.array(np.concatenate(take) if take else np.empty(0, np.int64)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("least", pa.int64())]))
        return out.append_column("spans", pa.chunked_array(spans, kind))

    sharded = segments.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "hash", "words", "first", "last", "n")
    return sharded.groupBy("shard").applyInArrow(run, _FOUND)


_WINDOWS = "anchor long, hash long, holders long, first long, last long, at int, key long, words string"


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """Single windows of distinct segments: the segment's anchor, hash, holders, first and last, and at, key, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                take, at, keys, texts = [], [], [], []
                for row, words, raw, starts, ends in _words(batch.column(5)):
                    hashes = shingle_hashes(words, window)
                    for i in range(len(hashes)):
                        texts.append(_join(raw, starts[i : i + window], ends[i : i + window]))
                    take.append(np.full(len(hashes), row))
                    at.append(np.arange(len(hashes)))
                    keys.append(hashes)
                index = pa.array(np.concatenate(take))
                cols = [batch.column(i).take(index) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)), pa.array([t.decode() for t in texts], pa.string())], names=["anchor", "hash", "holders", "first", "last", "at", "key", "words"])

    return segments.select("anchor", "hash", F.col("n").alias("holders"), "first", "last", "words").mapInArrow(run, _WINDOWS)


def _search_hot(hot: DataFrame, window: int) -> DataFrame:
    """As _search, for the segments of hot anchors, cut into single windows."""
    windows = materialize(_windows(hot, window), "windows")
    single = windows.groupBy(F.col("key").alias("anchor")).agg(F.any_value("words").alias("words"), F.sum("holders").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    distinct = materialize(single.where("first < last").withColumn("hash", F.lit(0).cast("long")), "single")
    shards = 1 + distinct.count() * window // SHARD_WORDS
    found = materialize(_search(distinct, shards, window).select(F.col("anchor").alias("key"), "n", "spans"), "found")
    back = lookup(windows.select("anchor", "hash", "holders", "at", "key"), found, ["key"])
    span = F.struct(F.col("at").alias("start"), (F.col("at") + 1).cast("int").alias("end"), F.get("spans", F.lit(0)).least.alias("least"))
    return back.groupBy("anchor", "hash").agg(F.any_value("holders").alias("n"), F.collect_list(span).alias("spans"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(staged rows, spans): spans (doc_id, mark, start, end) cover the words to remove; staged rows hold what remove_repeats() needs."""
    anchors = materialize(_anchor_rows(docs, window, gram), "anchors")
    both = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    twice = materialize(both.select("anchor", "n"), "shared")
    staged = materialize(_staged(docs, lookup(anchors, twice, ["anchor"]), window, gram, digest), "staged")
    for table in (anchors, twice):
        dispose(table)
    places = staged.where("segments is not null").select("doc_id", "mark", "row", F.explode("segments").alias("s")).select("doc_id", "mark", "row", "s.*")
    known = [F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.any_value("size").alias("size")]
    distinct = materialize(places.groupBy("anchor", "hash").agg(*known, F.min(F.struct("row", "start")).alias("at")), "segments")
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    hot = materialize(groups.where(F.col("n") > HOT).select("anchor", "n"), "hot")
    total = distinct.agg(F.sum("size")).first()[0] or 0
    if hot.limit(1).count():
        found = _search(_cut(distinct.join(hot.select("anchor"), "anchor", "left_anti"), staged), 1 + total // SHARD_WORDS, window)
        many = lookup(distinct.withColumnRenamed("n", "m"), hot, ["anchor"]).drop("n").withColumnRenamed("m", "n")
        found = found.unionByName(_search_hot(_cut(many, staged), window))
    else:
        found = _search(_cut(distinct, staged), 1 + total // SHARD_WORDS, window)
    found = materialize(found, "found")
    for table in (distinct, hot):
        dispose(table)
    met = lookup(places.select("doc_id", "mark", "anchor", "hash", F.col("start").alias("at")), found, ["anchor", "hash"])
    lost = met.select("doc_id", "mark", "at", F.explode(F.filter("spans", lambda s: s.least < F.col("doc_id"))).alias("s"))
    return staged, lost.select("doc_id", "mark", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end") + (window - 1)).alias("end"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs (doc_id, text): the kept words, or with digest their SHA-256."""
    staged, spans = repeated_spans(docs, window, gram, digest)
    listed = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    open_ = staged.where("text is not null").select("doc_id", "mark", "n_words", "text").join(listed, ["doc_id", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                spans = batch.column(3).to_pylist()
                removed, kept = [], []
                for row, words, raw, starts, ends in _words(batch.column(2)):
                    edge = np.zeros(len(words) + 1, np.int64)
                    if spans[row]:
                        np.add.at(edge, [min(s["start"], len(words)) for s in spans[row]], 1)
                        np.add.at(edge, [min(s["end"], len(words)) for s in spans[row]], -1)
                    stays = np.cumsum(edge)[:-1] <= 0
                    removed.append(int((~stays).sum()))
                    kept.append(_finish(_join(raw, starts[stays], ends[stays]), digest))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept string"
    done = staged.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return done.unionByName(open_.select("doc_id", "n_words", "text", "spans").mapInArrow(run, schema))
