"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (lower-cased, hashed to ``CELLS`` cells, by 1 + log of the count, of unit length together), statistics
of its structure (shares of letters, capitals, symbols, marked words and so on, each in one of fixed buckets) and its stated number
of characters. The score is the logistic of a bias, a weight per feature, and for each pair of features the product of their
values and of their vectors of ``RANK`` numbers. By the identity of the square of a sum and the sum of squares,

    sum over i < j of <v_i, v_j> x_i x_j = 1/2 sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

all pairs cost as much as one pass over the features.

Training: at most about ``SAMPLE`` labelled documents, chosen by a hash of doc_id over all labels (their broadcast is bounded by it), are
dealt to shards of about ``SHARD``. In each of ``ROUNDS`` rounds every shard starts from the same parameters, goes over its
documents by gradient steps, and hands on its changes by feature; they are averaged by how often a shard met the feature. The driver
holds the parameters only: (CELLS + statistics) x (RANK + 1) numbers. Scoring reads each text once and shuffles nothing.

Never inputs: labels, lang, source, doc_id. Documents are judged one by one, so repeated rows agree.

Edge cases: null text is empty; an empty text has a score by its statistics; a label is the mean of a doc_id's non-null ones; of rows that
share a doc_id one trains (smallest hash of its text); rows without doc_id are neither trained on nor held out; without any label
every score is 0.5. A missing column n_chars counts as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dispose, mark, materialize, text_chunks, word_hashes, word_spans
from .language import held_out

CELL_BITS = 14
CELLS = 1 << CELL_BITS
RANK = 8
#: Labelled documents that train, at most (about); documents of a shard.
SAMPLE, SHARD = 32_768, 4_096
ROUNDS, EPOCHS, STEP = 6, 3, 64
RATE, DECAY = 0.15, 1e-5
#: The value of a statistic that holds; the words of a text together have length 1.
STATISTIC = 0.6
THRESHOLD = 0.3

#: Upper bounds of the buckets of a share.
SHARES = np.array([0.0, 0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8])
STATISTICS = ("upper", "digit", "mark", "symbol", "wide", "blank", "line", "symbol_words", "upper_words", "short_words", "long_words", "distinct")
_BUCKETS = 32
#: The features: words, a bucket of each statistic, of the text's length and of the stated length.
FEATURES = CELLS + (len(STATISTICS) + 2) * _BUCKETS

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"()!?-"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[128:] = 5
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[10] = 7


def _share_bucket(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.searchsorted(SHARES, part / np.maximum(whole, 1), "left")


def _size_bucket(size: np.ndarray) -> np.ndarray:
    """0 for null (-1), 1 for 0, else 2 + the number of bits less 1."""
    return np.where(size < 0, 0, np.minimum(_BUCKETS - 1, 1 + np.ceil(np.log2(np.maximum(size, 0) + 1)))).astype(np.int64)


def features(column: pa.Array, stated: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds, cells, values) of pieces of a column of texts; stated: lengths by metadata, -1 for none."""
    for lo, hi, data, offsets in text_chunks(column):
        rows = hi - lo
        starts, ends, words = word_spans(data, offsets)
        cells = (word_hashes(data, starts, ends, lower=True) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        owner = np.repeat(np.arange(rows), words)
        pairs, counts = np.unique(owner * CELLS + cells, return_counts=True)
        own, cells = pairs // CELLS, pairs % CELLS
        values = 1 + np.log(counts)
        norm = np.sqrt(np.bincount(own, values * values, rows))
        values /= norm[own]
        size = np.diff(offsets)
        kind = _CLASS[data]

        def per_row(mask: np.ndarray, bounds: np.ndarray = offsets) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[bounds[1:]] - total[bounds[:-1]]

        spans = np.concatenate([[0], np.cumsum(words)])
        length = ends - starts

        def in_word(which: int) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(kind == which)])
            return total[ends] - total[starts]

        distinct = np.bincount(own, minlength=rows)
        columns = [_share_bucket(per_row(kind == k), size) for k in range(1, 8)]
        columns += [_share_bucket(per_row(m, spans), words) for m in (in_word(4) > 0, in_word(1) * 2 > length, length <= 2, length >= 12)]
        columns += [_share_bucket(distinct, words), _size_bucket(size), _size_bucket(stated[lo:hi])]
        width = len(columns)
        fixed = (CELLS + np.arange(width) * _BUCKETS + np.stack(columns, 1)).reshape(-1)
        # of each row its words, then its statistics
        row = np.concatenate([own, np.repeat(np.arange(rows), width)])
        order = np.argsort(row, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(distinct + width)])
        yield lo, bounds, np.concatenate([cells, fixed])[order], np.concatenate([values, np.full(rows * width, STATISTIC)])[order]


@dataclass
class Machine:
    """bias, weights (FEATURES), vectors (FEATURES x RANK)."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    @classmethod
    def new(cls) -> Machine:
        return cls(0.0, np.zeros(FEATURES, np.float32), (0.02 * np.random.default_rng(5).standard_normal((FEATURES, RANK))).astype(np.float32))

    def sums(self, bounds: np.ndarray, cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs before the logistic, sums of v x by document); every document has features."""
        mine = self.vectors[cells] * values[:, None]
        total = np.add.reduceat(mine, bounds[:-1], axis=0)
        squares = np.add.reduceat((mine * mine).sum(1), bounds[:-1])
        linear = np.add.reduceat(self.weights[cells] * values, bounds[:-1])
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares), total

    def scores(self, bounds: np.ndarray, cells: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(bounds, cells, values)[0], -40, 40)))


def train_shard(start: Machine, bounds: np.ndarray, cells: np.ndarray, values: np.ndarray, labels: np.ndarray, seed: int, epochs: int = EPOCHS) -> tuple[Machine, np.ndarray]:
    """(the machine after epochs over the documents, how often each feature was met); steps of AdaGrad on the log loss."""
    own = Machine(start.bias, start.weights.copy(), start.vectors.copy())
    past_w, past_v, past_b = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32), 1e-2
    rng, n = np.random.default_rng(seed), len(labels)
    sizes = np.diff(bounds)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, STEP):
            docs = order[lo : lo + STEP]
            size = sizes[docs]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(bounds[docs], size)
            c, x = cells[at], values[at]
            out, total = own.sums(np.concatenate([[0], ends]), c, x)
            error = 1 / (1 + np.exp(-np.clip(out, -40, 40))) - labels[docs]
            e = np.repeat(error, size)
            touched, place = np.unique(c, return_inverse=True)
            gw = np.bincount(place, e * x, len(touched)) / len(docs) + DECAY * own.weights[touched]
            grad = (e * x)[:, None] * (np.repeat(total, size, axis=0) - own.vectors[c] * x[:, None])
            gv = np.zeros((len(touched), RANK))
            np.add.at(gv, place, grad)
            gv = gv / len(docs) + DECAY * own.vectors[touched]
            gb = float(error.mean())
            past_w[touched] += gw * gw
            past_v[touched] += gv * gv
            past_b += gb * gb
            own.weights[touched] -= (RATE * gw / np.sqrt(past_w[touched])).astype(np.float32)
            own.vectors[touched] -= (RATE * gv / np.sqrt(past_v[touched])).astype(np.float32)
            own.bias -= RATE * gb / np.sqrt(past_b)
    return own, np.bincount(cells, minlength=FEATURES)


def _with_stated(docs: DataFrame) -> DataFrame:
    stated = F.coalesce(F.col("n_chars").cast("long"), F.lit(-1).cast("long")) if "n_chars" in docs.columns else F.lit(-1).cast("long")
    return docs.select("doc_id", "text", stated.alias("stated"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, y, cells, x of about sample documents with a label that are not held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    marks = materialize(marks, "marks")
    share = sample / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = _with_stated(docs).join(F.broadcast(marks), "doc_id").select("doc_id", "text", "stated", mark().alias("m"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stated = batch.column(2).to_numpy()
            for lo, bounds, cells, values in features(batch.column(1), stated):
                n = len(bounds) - 1
                part, at = batch.slice(lo, n), pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), pa.ListArray.from_arrays(at, pa.array(cells.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values.astype(np.float32)))], names=["doc_id", "m", "y", "cells", "x"])

    found = rows.mapInArrow(run, "doc_id long, m long, y double, cells array<int>, x array<float>")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("y", "cells", "x"), "m").alias("r"))
    return one.select("doc_id", "r.*")


def _changes(shared, turn: int):
    """What a shard adds to each feature's parameters in one turn, times how often it met the feature; the bias comes last."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        cells, x = table.column("cells").combine_chunks(), table.column("x").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())])
        start, number = shared.value, table.column("shard")[0].as_py()
        own, met = train_shard(start, bounds, cells.flatten().to_numpy(), x.flatten().to_numpy(), table.column("y").to_numpy(), 1000 * turn + number)
        at = np.flatnonzero(met)
        change = np.column_stack([own.weights[at] - start.weights[at], own.vectors[at] - start.vectors[at]]).astype(np.float64)
        change = np.concatenate([change, [[own.bias - start.bias] + [0.0] * RANK]])
        times = np.concatenate([met[at], [table.num_rows]]).astype(np.float64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 2, dtype=np.int32) * (RANK + 1)), pa.array((change * times[:, None]).reshape(-1)))
        return pa.table({"feature": pa.array(np.concatenate([at, [FEATURES]]).astype(np.int32)), "times": pa.array(times), "change": flat})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shard: int = SHARD, rounds: int = ROUNDS) -> Machine | None:
    """The machine of docs (doc_id, text, n_chars) and labels (doc_id, quality); None without a labelled document."""
    rows = materialize(labelled(docs, labels, sample), "labelled")
    n = rows.count()
    if not n:
        return None
    shards = -(-n // shard)
    dealt = materialize(rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(shards)).cast("int")).repartition(shards, "shard"), "dealt")
    machine, context = Machine.new(), docs.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(machine)

        parts = dealt.groupBy("shard").applyInArrow(_changes(shared, turn), "feature int, times double, change array<double>")
        added = parts.groupBy("feature").agg(F.sum("times").alias("times"), *[F.sum(F.get("change", F.lit(j))).alias(f"c{j}") for j in range(RANK + 1)]).toArrow()
        times, at = added.column("times").to_numpy(), added.column("feature").to_numpy()
        change = np.stack([added.column(f"c{j}").to_numpy() for j in range(RANK + 1)], 1) / times[:, None]
        weights, vectors, real = machine.weights.copy(), machine.vectors.copy(), at < FEATURES
        weights[at[real]] += change[real, 0].astype(np.float32)
        vectors[at[real]] += change[real, 1:].astype(np.float32)
        machine = Machine(machine.bias + float(change[~real, 0].sum()), weights, vectors)
        shared.unpersist()
    for table in (rows, dealt):
        dispose(table)
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text, n_chars)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, own = np.full(batch.num_rows, 0.5), shared.value
            if own is not None:
                for lo, bounds, cells, values in features(batch.column(1), batch.column(2).to_numpy()):
                    out[lo : lo + len(bounds) - 1] = own.scores(bounds, cells, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return _with_stated(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
