"""Shared pieces of the text operators: word hashing on Arrow buffers, scratch tables, input guards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are handled in pieces of about this many text bytes, so that NumPy temporaries stay small.
CHUNK_BYTES = 1 << 20

#: Word separators of every operator here: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(label: int, n: int) -> np.ndarray:
    """n fixed 64-bit values that depend on label only."""
    return splitmix(np.arange(n, dtype=np.uint64) + np.uint64(label) * np.uint64(1 << 32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = seeds(1, 256) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_RADIX = np.uint64(0x9FB21C651E98DF25)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, bytes, offsets into bytes) of a string or binary Arrow array. Nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and how many words each row has (words never cross rows)."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(rows, np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, np.flatnonzero(ends) + 1, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower folds A-Z first."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    mark = np.zeros(len(data) + 1, np.int32)
    mark[starts] = 1
    which = np.cumsum(mark[:-1], dtype=np.int32) - 1
    which[: starts[0]] = 0
    at = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[which]
    np.clip(at, 0, None, out=at)
    table = (_BYTE_LOWER if lower else _BYTE).copy()
    table[_SPACE] = 0
    with np.errstate(over="ignore"):
        values = table[data]
        values *= powers(_RADIX, int(at.max()) + 1)[at]
        return splitmix(np.add.reduceat(values, starts) + sizes.astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one sequence (k <= len(words))."""
    n = len(words) - k + 1
    out = words[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out *= _RADIX
            out += words[j : j + n]
    return splitmix(out)


def row_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The set of a row: sorted distinct k-word shingles; a shorter row is one shingle; none without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(words, min(k, len(words))))


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir; unset, a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="saccade-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dispose(df: DataFrame) -> None:
    """Removes the files of a table made by materialize()."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mark(text: str = "text") -> Column:
    """With doc_id the key of a row: rows that share a doc_id but not the text are told apart."""
    return F.xxhash64(text)


#: Keys with more than 1 / HEAVY of the counted rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 500


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str = "n", total: int | None = None) -> DataFrame:
    """rows joined to a table that has one row per key and, as weight, how many rows hold it; total: all weights, or more.

    Heavy keys are sent to the rows wherever those are; only the others are shuffled, so no task gets more than 1 / HEAVY of
    all rows for one key. The broadcast has fewer than HEAVY rows, whatever the size of the table.
    """
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY > total
    many = F.broadcast(table.where(heavy))
    rest = rows.join(F.broadcast(table.where(heavy).select(*keys)), keys, "left_anti")
    return rows.join(many, keys).unionByName(rest.join(table.where(~heavy), keys))


def word_count(text: str = "text"):
    """Number of words of a text column, null as 0, without Python."""
    parts = F.split(F.col(text), GAP)
    blanks = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.size(parts) - blanks, F.lit(0)).cast("long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def _to_lowest(pairs: DataFrame, moved: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(rows of moved (u, v) as v with the smallest of u and u's partners in pairs; that smallest, m, of each u).

    A node of many links is joined where its links are, see lookup(); total is the number of pairs, or more.
    """
    lowest = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return lookup(moved, lowest, ["u"], total=total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), lowest


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long, a <> b) as (node, label), label the smallest node.

    Alternates large-star and small-star steps; each step is written to shared storage, nothing reaches
    the driver but a count, and the links of a node stay spread however many they are. Every node of links appears once. No links: no rows.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = materialize(_to_lowest(edges.union(turned), turned, 2 * state[0])[0], "large")
        small, low = _to_lowest(large, large, state[0])
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dispose(edges)
        dispose(large)
        edges, old = new, state
        state = _state(edges)
        if state == old:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
