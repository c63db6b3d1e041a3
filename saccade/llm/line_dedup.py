"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Of every window of ``run`` consecutive lines the smallest line hash (the last of equal ones) is selected; a line that several windows
select is one fingerprint. A repeated run of at least ``run`` lines has the same windows in both places, so it shares at least
one fingerprint with its earlier copy. Positions of fingerprints that occur once go. The others are joined on the fingerprint and
extended both ways: the neighbours to the left and right, as far as the windows that selected the line reach, must agree
with those of an earlier position, the first one of its kind (common lines are not paired with all their places). Matches with one earlier
document at one distance grow together, line by line in both directions, to the maximal repeated run. The lines of later places (by
doc_id, then row, then line) are deleted.

With ``words`` a shorter run that holds at least that many words counts too: the same selection and extension over windows of 1
to run - 1 lines. The pipeline and op5_line_dedup_passages use WORDS; op5_line_dedup, whose SQL knows whole windows only, does not.

Only fingerprints move, one row per selected line, with the hashes of its neighbours. Equal ones are pre-aggregated to their
first position, and the few fingerprints that hold a large share of the rows are joined by broadcast (common.lookup), so a line
that is in every document is not gathered in one task.

Edge cases: null text stays null and takes no part; text is split at newlines, so empty lines are lines; rows with a null
doc_id stay unchanged; rows that share a doc_id are judged row by row, in the order of a hash of their text; rows that
repeat both are one document, and keep the same lines. Columns of other names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, lookup, mark, materialize

RUN = 3
WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, GAP), lambda x: x != ""))


def fingerprints(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id, mark, at, fingerprint, spans: the selected lines of docs (doc_id, text).

    spans are the windows that selected the line: start, length, and the line hashes left and right of it in the window.
    """
    least = run if words is None else 1
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", mark().alias("mark"), _lines(F.col("text")).alias("lines"))
    hashed = lines.where(F.size("lines") >= least).select("doc_id", "mark", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))
    hashed = hashed.withColumn("n", F.transform("lines", _words) if least < run else F.lit(None)).drop("lines")

    def selected(start: Column, length: int) -> Column:
        """The line that the window at start selects."""
        best = F.lit(length - 1)
        low = F.get("h", start + (length - 1))
        for j in range(length - 2, -1, -1):
            own = F.get("h", start + j)
            best, low = F.when(own < low, F.lit(j)).otherwise(best), F.least(own, low)
        return start + best

    def counts(start: Column, length: int) -> Column:
        """Whether the window at start is there, and long enough."""
        there = (start >= 0) & (start + length <= F.size("h"))
        if length == run:
            return there
        return there & (sum((F.get("n", start + j) for j in range(length)), F.lit(0)) >= words)

    def picks(length: int) -> Column:
        starts = F.when(F.size("h") >= length, F.sequence(F.lit(0), F.size("h") - length)).otherwise(F.array().cast("array<int>"))
        if length < run:
            starts = F.filter(starts, lambda i: counts(i, length))
        return F.transform(starts, lambda i: selected(i, length))

    def spans(at: Column) -> Column:
        own = []
        for length in range(least, run + 1):
            for offset in range(length):
                start = at - offset
                left, right = F.slice("h", start + 1, F.lit(offset)), F.slice("h", at + 2, F.lit(length - 1 - offset))
                span = F.struct(start.alias("start"), F.lit(length).alias("length"), left.alias("left"), right.alias("right"))
                own.append(F.when(counts(start, length) & (selected(start, length) == at), span))
        return F.filter(F.array(*own), lambda x: x.isNotNull())

    chosen = hashed.withColumn("at", F.array_distinct(F.concat(*[picks(length) for length in range(least, run + 1)])))
    rows = F.transform("at", lambda at: F.struct(at.alias("at"), F.get("h", at).alias("fingerprint"), spans(at).alias("spans")))
    return chosen.select("doc_id", "mark", F.explode(rows).alias("f")).select("doc_id", "mark", "f.*")


def repeated_runs(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id, mark, start, length, first_doc, first_mark, first_start: maximal runs of lines of docs that also stand in an earlier place.

    A run is as long as its lines agree with the same earlier document at the same distance; lines whose first place is another one begin a
    run of their own, so runs of a document may overlap.
    """
    found = materialize(fingerprints(docs, run, words), "fingerprints")
    place = F.struct("doc_id", "mark", "at")
    # counts are enough here: rows that repeat one place have no later one, so they go at the end
    shared = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    met = lookup(found, materialize(shared, "shared"), ["fingerprint"])
    key = ["fingerprint", "left", "right"]
    extended = met.select("doc_id", "mark", "at", "fingerprint", F.explode("spans").alias("s")).select("doc_id", "mark", "at", "fingerprint", "s.*")
    extended = materialize(extended, "extended")
    firsts = extended.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    later = lookup(extended, materialize(firsts, "firsts"), key).where(place > F.col("first"))
    return _grown(later.select("doc_id", "mark", "start", "length", F.col("first.doc_id").alias("first_doc"), F.col("first.mark").alias("first_mark"), (F.col("at") - F.col("first.at")).alias("apart")))


def _grown(pairs: DataFrame) -> DataFrame:
    """Pairs of a later and an earlier place, grown line by line both ways: those on one diagonal (a pair of documents at one distance) that
    overlap or touch are one run."""
    diagonal = ["doc_id", "mark", "first_doc", "first_mark", "apart"]
    along = Window.partitionBy(*diagonal).orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("start") > reach)).cast("int")
    runs = pairs.withColumn("opens", opens).withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*diagonal, "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))
    return whole.select("doc_id", "mark", "start", (F.col("end") - F.col("start")).alias("length"), "first_doc", "first_mark", (F.col("start") - F.col("apart")).alias("first_start"))


def _without_repeats(docs: DataFrame, run: int, words: int | None) -> DataFrame:
    """row (docs' columns), lines, kept (arrays; null for null text): all lines and those that stay."""
    runs = repeated_runs(docs, run, words).select("doc_id", "mark", "start", "length").distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    rows = docs.select("doc_id", mark().alias("mark"), F.struct("*").alias("row"))
    joined = rows.join(runs, ["doc_id", "mark"], "left").select("row", "runs", _lines(F.col("row.text")).alias("lines"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    kept = F.when(F.col("runs").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    return joined.select("row", "lines", F.when(F.col("row.text").isNotNull(), kept).alias("kept"))


def deduplicated_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text for every row of docs (doc_id, text)."""
    out = _without_repeats(docs.select("doc_id", "text"), run, words)
    n = lambda value: F.when(F.col("row.text").isNull(), 0).otherwise(value).cast("long")
    return out.select("row.doc_id", n(F.size("lines")).alias("n_lines"), n(F.size("lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))


def dedup_documents(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """docs with repeated lines deleted, text and n_chars following; a document left without any line goes."""
    out = _without_repeats(docs, run, words).where(F.col("row.text").isNull() | (F.size("kept") > 0))
    changed = F.size("kept") < F.size("lines")
    out = out.select("row", changed.alias("changed"), F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("row.text")).alias("text"))

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == "text":
            own = F.col("text")
        elif c == "n_chars":
            own = F.when(F.col("changed"), F.char_length("text").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return out.select(*[column(c) for c in docs.columns])
