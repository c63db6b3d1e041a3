"""Language identification by multilingual mixture inference.

A model holds byte-trigram probabilities per language, counted over all training rows. A document is a mixture of
languages: expectation-maximisation estimates the proportions from the trigram likelihoods, and the set of
languages grows only while the likelihood gains more than a penalty per language. The prediction is the language with the largest
proportion, its score that proportion.

Texts are lower-cased (A-Z), ASCII bytes that are not letters become spaces, and the text is padded with a space at
both ends. Trigrams are hashed to 2**16 cells, so a model has at most 65,536 cells per language; more than
``MAX_LANGUAGES`` languages raise an error, which bounds what is sent to the executors (256 KB a language).

Edge cases: null text or text without any letter gives ``und`` with score 0, as does a model without training rows;
ties go to the language first in code-point order; rows are judged one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks

CELLS = 1 << 16
MAX_LANGUAGES = 256
SMOOTHING = 0.5
ROUNDS = 30
#: Log-likelihood that a further language must gain, times the logarithm of the number of trigrams.
PENALTY = 3.0
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    """names: languages in code-point order; logs: log probabilities, languages by cells."""

    names: tuple[str, ...]
    logs: np.ndarray


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams of all rows, and the bounds of each row's cells."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + 2 * rows, 32, np.uint8)
    shift = np.repeat(np.arange(rows, dtype=np.int64) * 2 + 1, np.diff(offsets))
    padded[np.arange(len(data)) + shift] = _FOLD[data]
    begins = offsets + 2 * np.arange(rows + 1)
    if len(padded) < 3:
        return np.empty(0, np.uint16), np.zeros(rows + 1, np.int64)
    x = padded.astype(np.uint32)
    gram = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    valid = gram != 0x202020
    last = begins[1:]
    for back in (1, 2):
        at = last - back
        at = at[(at >= 0) & (at < len(gram))]
        valid[at] = False
    cell = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    kept = np.flatnonzero(valid)
    return cell[kept], np.searchsorted(kept, begins)


def train(rows: DataFrame) -> Model:
    """Counts trigrams of all rows (text, lang) with a language; one row per language and cell reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                cells, bounds = _cells(data, offsets)
                names = np.array(langs[lo:hi], object)
                owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
                for name in set(langs[lo:hi]):
                    got = np.bincount(cells[(names == name)[owner]], minlength=CELLS)
                    total[name] = total[name] + got if name in total else got
                    if len(total) > 64:  # many languages: hand on what there is
                        yield from emit(total)
                        total = {}
        yield from emit(total)

    def emit(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in total.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(counts[full].astype(np.int64))], names=["lang", "cell", "n"])

    counted = rows.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, cell int, n long")
    counted = materialize(counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")), "trigrams")
    names = sorted(r.lang for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    logs = np.full((len(names), CELLS), SMOOTHING, np.float64)
    for i, name in enumerate(names):  # at most CELLS rows each, as packed columns
        rows = counted.where(F.col("lang") == name).select("cell", "n").toArrow()
        logs[i, rows.column("cell").to_numpy()] += rows.column("n").to_numpy()
    if names:
        logs = np.log(logs / logs.sum(1, keepdims=True))
    return Model(tuple(names), logs.astype(np.float32))


def mixture(cells: np.ndarray, counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Language proportions of one document; logs: languages by cells."""
    table = logs[:, cells].astype(np.float64)
    counts = counts.astype(np.float64)
    total = counts.sum()
    share = np.zeros(len(table))
    chosen = [int(np.argmax(table @ counts))]
    share[chosen[0]] = 1.0
    like = table[chosen[0]].copy()
    value = float(like @ counts)
    while len(chosen) < len(table):
        # the slope of the likelihood towards each further language; none upward: this set is the best
        with np.errstate(over="ignore"):
            slope = np.exp(np.minimum(table - like, 500.0)) @ counts - total
        slope[chosen] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 0:
            break
        names = [*chosen, best]
        peak = table[names].max(0)
        part = np.exp(table[names] - peak)
        weight = np.full(len(names), 0.1 / len(names))
        weight[:-1] += 0.9 * share[chosen]
        weight /= weight.sum()
        for _ in range(ROUNDS):
            mixed = weight @ part
            new = weight * (part @ (counts / mixed)) / total
            moved = np.abs(new - weight).max()
            weight = new
            if moved < 1e-3:
                break
        mixed = np.log(weight @ part) + peak
        gain = float(mixed @ counts) - value
        if gain <= PENALTY * np.log(total + 1.0):
            break
        chosen, like, value = names, mixed, value + gain
        share[:] = 0
        share[names] = weight
    return share


def _judge(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for lo, hi, data, offsets in text_chunks(column):
        cells, bounds = _cells(data, offsets)
        for i in range(hi - lo):
            own = cells[bounds[i] : bounds[i + 1]]
            raw = data[offsets[i] : offsets[i + 1]]
            if not len(own) or not len(model.names) or not _has_letter(raw):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            distinct, counts = np.unique(own, return_counts=True)
            share = mixture(distinct, counts, model.logs)
            best = int(np.argmax(share))
            names.append(model.names[best])
            scores.append(float(min(1.0, share[best])))
    return names, scores


def _has_letter(raw: np.ndarray) -> bool:
    folded = _FOLD[raw]
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    # letters are the characters of the Unicode categories L, numerals are none
    return bool((raw >= 128).any()) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _judge(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    """Whether a document is kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train_on_documents(docs: DataFrame) -> Model:
    """The model of docs (doc_id, text, lang) without its held-out fifth; rows without doc_id train."""
    return train(docs.where(~F.coalesce(held_out(), F.lit(False))))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang)."""
    out = predict(docs, train_on_documents(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def _lettered(column: pa.Array) -> list[bool]:
    return [_has_letter(data[offsets[i] : offsets[i + 1]]) for lo, hi, data, offsets in text_chunks(column) for i in range(hi - lo)]


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that have a language: rows judged ``und`` go, all columns stay as they are.

    Without a labelled row there is no language to choose from, and all rows with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_on_documents(docs))
    at = docs.columns.index("text")
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots or in two cases are no matter below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            kept = [x != UNDETERMINED for x in _judge(shared.value, column)[0]] if len(shared.value.names) else _lettered(column)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return named.mapInArrow(run, named.schema).toDF(*docs.columns)
