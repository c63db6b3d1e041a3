"""The factorisation machine: its identity, its gradients, held-out accuracy, and tables with gaps."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from saccade.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, y string, cells int"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "y", 1) for d, t in rows], DOCS)


def made(n, seed=1):
    """(doc_id, text, quality): prose, or prose that turns into marked words, capitals or a table."""
    rng = random.Random(seed)
    names = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("", "na", "sol", "ter", "wing", "dra")]
    rows = []
    for i in range(n):
        words = rng.choices(names, k=rng.randrange(5, 120))
        kind = rng.choice(["good"] * 5 + ["marks", "caps", "table"])
        at = rng.randrange(len(words) // 2)
        if kind == "marks":
            words[at:] = [w + "$$$" for w in words[at:]]
        elif kind == "caps":
            words[at:] = [w.upper() + "!!" for w in words[at:]]
        elif kind == "table":
            words[at:] = [x for w in words[at:] for x in (w, "|")]
        rows.append((i, " ".join(words), int(kind == "good")))
    return rows


def test_identity_against_all_pairs():
    rng = np.random.default_rng(2)
    machine = quality.Machine(0.3, rng.standard_normal(quality.FEATURES).astype(np.float32), rng.standard_normal((quality.FEATURES, quality.RANK)).astype(np.float32))
    column = pa.array(["one two two three", None, "", "ONE four\nfive $$$ 12 é"])
    (_, bounds, cells, values), = quality.features(column, np.array([17, -1, 0, 22]))
    got = machine.sums(bounds, cells, values)[0]
    for i in range(4):
        c, x = cells[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]]
        want = 0.3 + sum(machine.weights[a] * v for a, v in zip(c, x, strict=True))
        want += sum(float(machine.vectors[c[i]] @ machine.vectors[c[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(len(c)), 2))
        assert got[i] == pytest.approx(want, rel=1e-4)
    words = [values[bounds[i] : bounds[i + 1]][cells[bounds[i] : bounds[i + 1]] < quality.CELLS] for i in range(4)]
    assert [round(float((w * w).sum()), 9) for w in words] == [1, 0, 0, 1] and [len(w) for w in words] == [3, 0, 0, 6]


def test_features_do_not_depend_on_pieces():
    texts = ["a b c " * 50, "D! $$ | " * 40, "", "ü ö 12\n"] * 30
    whole = list(quality.features(pa.array(texts), np.full(120, 5)))
    parts = [x for i in range(0, 120, 7) for x in quality.features(pa.array(texts).slice(i, 7), np.full(len(texts[i : i + 7]), 5))]
    join = lambda found, k: np.concatenate([x[k] for x in found])
    assert (join(whole, 2) == join(parts, 2)).all() and np.allclose(join(whole, 3), join(parts, 3))


def test_step_lowers_the_loss():
    rows = made(300)
    column = pa.array([t for _, t, _ in rows])
    (_, bounds, cells, values), = quality.features(column, np.array([len(t) for _, t, _ in rows]))
    y = np.array([q for *_, q in rows], float)
    machine, met = quality.train_shard(quality.Machine.new(), bounds, cells, values, y, 1)
    loss = lambda m: -np.mean(y * np.log(m.scores(bounds, cells, values)) + (1 - y) * np.log(1 - m.scores(bounds, cells, values)))
    assert loss(machine) < 0.2 * loss(quality.Machine.new()) and met.sum() == len(cells)


def test_held_out_accuracy_and_shards(spark, monkeypatch):
    rows = made(900)
    docs = docs_of(spark, [(d, t) for d, t, _ in rows] + [(None, rows[0][1]), (5000, None), (5001, ""), (0, rows[0][1]), (5002, "x " * 200_000)])
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows] + [(d, q, 0) for d, _, q in rows[:50]] + [(None, 1, 0), (1, None, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "SHARD", 200)
    got = quality.classify(docs.repartition(6), labels).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {d: q for d, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 120 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert not [r for r in got if r.doc_id is None][0].held_out
    twice = [r.score for r in got if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1]
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(3), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-6) for r in got)


def test_labels_are_bounded_and_never_held_out(spark):
    rows = made(400)
    docs, labels = docs_of(spark, [(d, t) for d, t, _ in rows]), spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    import zlib

    kept = [r.doc_id for r in quality.labelled(docs, labels).collect()]
    assert sorted(kept) == [d for d, *_ in rows if zlib.crc32(str(d).encode()) % 5]
    assert 20 < quality.labelled(docs, labels, sample=60).count() < 110


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs_of(spark, [(1, "a"), (2, None)]), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 2
    assert quality.classify(docs_of(spark, []), none).count() == 0
    one = quality.classify(docs_of(spark, [(1, "a"), (2, "b")]).drop("n_chars"), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")).collect()
    assert all(r.predicted == 1 for r in one)
