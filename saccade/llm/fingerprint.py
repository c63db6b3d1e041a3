"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraph pieces: at newlines, and inside long paragraphs after words whose hash ends in given bits (content
defined, about ``PIECE`` words), so an edit changes only the pieces it touches. The set of piece digests goes into a table
of cells, each piece into one cell of each of three parts: a count, a sum of digests, a sum of check hashes. Subtracting two tables leaves
the differing digests; peeling cells that hold a single one recovers them with their side. If peeling gets
stuck, both sketches are made again, large enough for all digests of both texts, and larger again until it succeeds.

The likeness of two fingerprints is shared / all distinct pieces. Edge cases: null text is empty; an empty text has no
pieces, two such texts have likeness 1; equal texts always have equal fingerprints.

For the edited texts the documents are range-partitioned by ascending doc_id (null last, ties by text), with the first
row of each range also sent to the end of the range before it, so one shuffle of the texts is enough. The cuts between ranges
come from a sample of ``SAMPLE`` keys a range (of about ``RANGE_BYTES``), ``MOST_SAMPLED`` in all; they only share out the work. A doc_id, or null, that
many rows have is cut by the first ``HEAD`` characters of the texts.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, splitmix, text_chunks, word_hashes, word_spans

PIECE = 8
#: Cells of each of the three parts of a fingerprint.
CELLS = 10
#: Bytes and rows of a range, keys sampled for each, characters of a text that tell rows of one doc_id apart.
RANGE_BYTES, RANGE_ROWS, SAMPLE, HEAD = 64 << 20, 20_000, 40, 100
#: Ranges, and sampled keys, at most: what the driver sees does not grow with the data. Beyond, ranges get longer and their sorts spill.
MOST_RANGES, MOST_SAMPLED = 100_000, 400_000
_CHECK = np.uint64(0x5851F42D4C957F2D)
_CUT = np.uint64(PIECE - 1)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct piece digests of each row, sorted by row: (digests, rows)."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts, ends, _ = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[:-1]] = True
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[ends[(hashes & _CUT) == 0]] = True
    begins = np.flatnonzero(cut[:-1])
    row = np.searchsorted(offsets, begins, "right") - 1
    # all bytes count here, white space too
    size = np.diff(np.append(begins, len(data)))
    with np.errstate(over="ignore"):
        at = np.arange(len(data)) - np.repeat(begins, size)
        power = np.full(int(at.max()) + 1, 0xD1342543DE82EF95, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[at], begins)
        digest = splitmix(splitmix(sums) ^ size.astype(np.uint64))
    order = np.lexsort((digest, row))
    digest, row = digest[order], row[order]
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    assert rows >= 1
    return digest[new], row[new]


class Sketches:
    """Tables of many documents side by side; document d has 3 * cells[d] cells."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.base = np.concatenate([[0], np.cumsum(3 * cells)])
        self.count = np.zeros(self.base[-1], np.int64)
        self.keys = np.zeros(self.base[-1], np.uint64)
        self.checks = np.zeros(self.base[-1], np.uint64)

    def places(self, digests: np.ndarray, docs: np.ndarray, part: int) -> np.ndarray:
        size = self.cells[docs]
        mixed = splitmix(digests + np.uint64(part)) >> np.uint64(32)
        return self.base[docs] + part * size + ((mixed * size.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)

    def add(self, digests: np.ndarray, docs: np.ndarray, sign: np.ndarray | int = 1) -> None:
        step = np.broadcast_to(np.asarray(sign, np.int64), digests.shape)
        wide = step.astype(np.uint64)
        with np.errstate(over="ignore"):
            checks = splitmix(digests ^ _CHECK) * wide
            keys = digests * wide
            for part in range(3):
                at = self.places(digests, docs, part)
                np.add.at(self.count, at, step)
                np.add.at(self.keys, at, keys)
                np.add.at(self.checks, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.cells)
        with np.errstate(over="ignore"):
            out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def take(self, docs: np.ndarray) -> Sketches:
        """The tables of the given documents; all tables here have one size."""
        out = Sketches(self.cells[docs])
        n = 3 * int(self.cells[0])
        for name in ("count", "keys", "checks"):
            setattr(out, name, getattr(self, name).reshape(-1, n)[docs].reshape(-1))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recovers what is in the tables: whether all of a document's was, digests added and subtracted by document."""
        n = len(self.cells)
        plus, less = np.zeros(n, np.int64), np.zeros(n, np.int64)
        owner = np.repeat(np.arange(n), 3 * self.cells)
        # a table without errors is empty before as many rounds as it has cells
        for _ in range(3 * int(self.cells.max(initial=0)) + 1):
            single = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[single]
            with np.errstate(over="ignore"):
                keys = self.keys[single] * sign.astype(np.uint64)
                right = splitmix(keys ^ _CHECK) == self.checks[single] * sign.astype(np.uint64)
            keys, docs, sign = keys[right], owner[single[right]], sign[right]
            if not len(keys):
                break
            order = np.lexsort((keys, docs))
            keys, docs, sign = keys[order], docs[order], sign[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs, sign = keys[new], docs[new], sign[new]
            plus += np.bincount(docs[sign > 0], minlength=n)
            less += np.bincount(docs[sign < 0], minlength=n)
            self.add(keys, docs, -sign)
        stuck = np.bincount(owner[(self.count != 0) | (self.keys != 0)], minlength=n)
        return stuck == 0, plus, less

    def text(self) -> list[str]:
        """Each table as base64 of its cells: count (2 bytes), sum of digests (8), sum of check hashes (4)."""
        n = 3 * int(self.cells[0]) if len(self.cells) else 0
        packed = np.zeros(len(self.count), np.dtype([("n", "<u2"), ("k", "<u8"), ("c", "<u4")]))
        packed["n"], packed["k"], packed["c"] = self.count & 0xFFFF, self.keys, self.checks & np.uint64(0xFFFFFFFF)
        return [base64.b64encode(packed[i : i + n].tobytes()).decode() for i in range(0, len(packed), n)] if n else []


class Texts:
    """Pieces and fingerprints of a list of texts."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        digests, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for lo, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
            d, r = pieces(data, offsets)
            digests.append(d)
            owners.append(r + lo)
        self.digests, self.owners = np.concatenate(digests), np.concatenate(owners)
        self.sizes = np.bincount(self.owners, minlength=self.n)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sketches = Sketches(np.full(self.n, CELLS))
        self.sketches.add(self.digests, self.owners)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[docs]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.digests[np.repeat(self.bounds[docs], sizes) + inner], np.repeat(np.arange(len(docs)), sizes)


def likeness(a: Texts, ia: np.ndarray, b: Texts, ib: np.ndarray) -> np.ndarray:
    """Likeness of texts ia of a to texts ib of b, pair by pair."""
    out = np.ones(len(ia))
    if not len(ia):
        return out
    done, plus, less = a.sketches.take(ia).minus(b.sketches.take(ib)).peel()
    left, factor = np.flatnonzero(~done | (plus > a.sizes[ia])), 1.5
    while len(left):
        cells = (np.ceil((a.sizes[ia[left]] + b.sizes[ib[left]]) * factor / 3) + 4).astype(np.int64)
        one, two = Sketches(cells), Sketches(cells)
        one.add(*a.of(ia[left]))
        two.add(*b.of(ib[left]))
        ok, p, m = one.minus(two).peel()
        plus[left[ok]], less[left[ok]] = p[ok], m[ok]
        left, factor = left[~ok], factor * 2
    union = a.sizes[ia] + less
    some = union > 0
    out[some] = (a.sizes[ia] - plus)[some] / union[some]
    return out


def edit(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


class Cuts:
    """Cuts between ranges of documents ordered by doc_id (null last) and text: the first key of each range but the first."""

    def __init__(self, keys: list[tuple]):
        """keys: sorted (null, doc_id, head), head the first HEAD characters of a text where doc_ids repeat."""
        self.keys = keys
        self.nulls = np.array([k[0] for k in keys], bool)
        self.ids = np.array([k[1] for k in keys], np.int64)

    def place(self, null: np.ndarray, ids: np.ndarray, heads: list[str]) -> np.ndarray:
        """The range of each document: how many cuts are at most its key."""
        known = int((~self.nulls).sum())
        low = np.where(null, known, np.searchsorted(self.ids[:known], ids, "left"))
        high = np.where(null, len(self.keys), np.searchsorted(self.ids[:known], ids, "right"))
        for i in np.flatnonzero(low < high):  # the doc_id of a cut
            low[i] += bisect.bisect_right([k[2] for k in self.keys[low[i] : high[i]]], heads[i])
        return low


def _cuts(rows: DataFrame, n: int, share: float) -> Cuts:
    """Cuts for n ranges of about equal bytes, from a sample of MOST_SAMPLED documents' keys at most, in columns."""
    sample = rows.sample(min(1.0, share), 1) if share < 1 else rows
    found = sample.select("none", "id", F.substring("text", 1, HEAD).alias("head"), "bytes").toArrow()
    found = found.sort_by([("none", "ascending"), ("id", "ascending"), ("head", "ascending")])
    done = np.cumsum(found.column("bytes").to_numpy() + 64)
    at = np.unique(np.searchsorted(done, done[-1] * np.arange(1, n) / n)) if len(done) else np.empty(0, np.int64)
    picked = [(none, id_, head.encode()) for none, id_, head in zip(*(found.column(c).take(pa.array(at)).to_pylist() for c in ("none", "id", "head")), strict=True)]
    ids = Counter(k[:2] for k in picked)
    # a doc_id that is cut once is not split by text
    return Cuts(sorted({(none, id_, head if ids[none, id_] > 1 else b"") for none, id_, head in picked}))


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as ranges of ascending doc_id, one a partition: range, tail, doc_id, text, in order.

    The last row of each range (tail = 1) is the first row of the next one.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bytes", F.octet_length("text"))
    count, size = rows.agg(F.count("*"), F.sum("bytes")).first()
    n = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // RANGE_ROWS, (size or 0) // RANGE_BYTES))
    cuts = spark.sparkContext.broadcast(_cuts(rows, n, min(SAMPLE * n, MOST_SAMPLED) / max(count, 1)))
    split = len(Counter(k[:2] for k in cuts.value.keys)) < len(cuts.value.keys)

    @F.pandas_udf("int")
    def place(none: pd.Series, ids: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series(cuts.value.place(none.to_numpy(), ids.to_numpy(), [h.encode() for h in heads]))

    head = F.substring("text", 1, HEAD) if split else F.lit("")
    ranged = rows.withColumn("range", place("none", "id", head))
    # of each range the first text, with the range before it: one row a range
    order = F.struct("none", "id", "text")
    firsts = materialize(ranged.groupBy("range").agg(F.min(order).alias("first")), "firsts")
    full = sorted(r.range for r in firsts.select("range").collect())
    before = spark.createDataFrame([(r, full[i - 1]) for i, r in enumerate(full)], "range int, before int")
    ahead = firsts.join(before, "range").select(F.col("before").alias("range"), F.lit(1).alias("tail"), F.when(~F.col("first.none"), F.col("first.id")).alias("doc_id"), F.col("first.text").alias("text"))
    both = ranged.select("range", F.lit(0).alias("tail"), "doc_id", "text").unionByName(ahead)
    return both.repartitionById(n, F.col("range")).sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_last(), "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, following text)."""
    texts = Texts([r[1] for r in rows] + [rows[-1][2]])
    edited = [edit(r[1], r[2]) for r in rows]
    changed = Texts(edited)
    n = np.arange(len(rows))
    following = n + 1
    extra = [i for i in range(len(rows) - 1) if rows[i][2] is not rows[i + 1][1]]
    near = likeness(texts, n, texts, following)
    if extra:  # the last rows of their ranges
        others = Texts([rows[i][2] for i in extra])
        near[extra] = likeness(texts, np.array(extra), others, np.arange(len(extra)))
    shas = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    prints = texts.sketches.text()[: len(rows)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(shas), pa.array(prints), pa.array(changed.sketches.text()), pa.array(likeness(texts, n, changed, n)), pa.array(near)],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): its fingerprint, its edited text's, and their likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready, size = None, [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256).to_pydict()
                for place, tail, doc, text in zip(part["range"], part["tail"], part["doc_id"], part["text"], strict=True):
                    text = text or ""
                    if last is not None and last[0] == place:
                        ready.append((last[1], last[2], text))
                        size += len(text)
                    last = None if tail else (place, doc, text)
                    if size > 1 << 19 or len(ready) >= 512:
                        yield _compare(ready)
                        ready, size = [], 0
        if ready:
            yield _compare(ready)

    return in_order(docs.select("doc_id", "text")).mapInArrow(run, _OUT)
