"""Each text operator against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import io
import itertools
import random
import re

import numpy as np
import pytest

from saccade.llm import chat, common, decontaminate, fingerprint, fm_index, language, line_dedup, mixing, near_dup, substring, tokens, warc


def words(text):
    return (text or "").encode().split()


def shingles(text, k=5):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ÑU", "Aa"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 30, 120]))) for _ in range(n)]
    rows = []
    for i, text in enumerate(base):
        rows.append((i * 3, text))
        if i % 4 == 0:
            rows.append((i * 3 + 1, text))
        if i % 5 == 0:
            w = text.split()
            w[len(w) // 2] = "edited"
            rows.append((i * 3 + 2, " \n".join(w)))
    rows += [(9001, None), (9002, ""), (9003, " \t\n\x0b\x0c\r "), (9004, " ".join(rng.choices(vocabulary, k=20000))), (None, base[0]), (None, None)]
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, label string"


def frame(spark, rows, extra=lambda i: (None, None)):
    return spark.createDataFrame([(d, t, *extra(i), None if t is None else len(t), "x", 1, "y") for i, (d, t) in enumerate(rows)], DOCS)


def brute_components(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets[d] = sets.get(d, frozenset()) | shingles(t)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a] | sets[b])):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    rows += [rows[0]]  # a repeated row
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    component, size = brute_components(rows)
    assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in got if r.doc_id is not None} == {(d, c, size[d], c == d) for d, c in component.items()}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_near_duplicates_chain_and_large_group(spark):
    """A group of which most members are only linked through others, in buckets of many members."""
    rng = random.Random(3)
    text = [f"v{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(90):
        text = list(text)
        text[rng.randrange(80)] = f"x{i}"
        rows.append((1000 - i, " ".join(text)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)[0]


def test_near_duplicates_of_a_template(spark):
    """Documents that share a template but not enough of it meet no other one: rows of pairs do not grow with the square."""
    rng = random.Random(13)
    template = " ".join(f"t{i}" for i in range(12))
    rows = [(i, f"{template} a{rng.random()} b{rng.random()}") for i in range(400)] + [(1000 + i, f"{template} c") for i in range(3)]
    docs = frame(spark, rows)
    sets = common.materialize(near_dup.shingle_sets(docs.select("doc_id", "text")), "sets")
    labels = sets.select(sets["doc_id"].alias("node"), sets["doc_id"].alias("label"))
    assert near_dup._prefix_pairs(sets, labels, 75).count() <= 3 * 403
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)[0]


def test_near_duplicates_empty(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 6), (6, 5), (10, 3), (5, 9), (20, 21)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 5: 5, 6: 5, 7: 5, 9: 5, 20: 20, 21: 20}


def test_components_of_stars_and_chains(spark, monkeypatch):
    rng = random.Random(9)
    links = [(500, v) for v in range(501, 560)] + [(v, v + 1) for v in range(30, 55)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    links = [(a, b) for a, b in links if a != b] + [(540, 30)]
    label = {n: n for pair in links for n in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    for heavy in (3, 500):
        monkeypatch.setattr(common, "HEAVY", heavy)
        got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted((r.node, r.label) for r in got) == sorted(label.items())


def test_word_hashes_split_like_python():
    import pyarrow as pa

    rows = ["", " a bb\x0bccc  ", None, "d", "é ü\t\tÉ", "x\x1fy"]
    for _, _, data, offsets in common.text_chunks(pa.array(rows)):
        starts, ends, counts = common.word_spans(data, offsets)
        raw = data.tobytes()
        assert [raw[a:b] for a, b in zip(starts, ends)] == [w for r in rows for w in words(r)]
        assert counts.tolist() == [len(words(r)) for r in rows]
        hashes = common.word_hashes(data, starts, ends)
        assert len(set(hashes.tolist())) == len({w for r in rows for w in words(r)})


def test_word_count(spark):
    rows = corpus() + [(1, "a  b"), (2, " a"), (3, "a "), (4, " x y")]
    got = frame(spark, rows).select("text", common.word_count().alias("n")).collect()
    assert all(r.n == len(words(r.text)) for r in got)


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"q{i}" for i in range(1000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 40, 60])))) for i in range(30)] + [(90, None), (91, ""), (92, "one two"), (0, "zz yy xx ww vv uu")]
    rows = []
    for i, (_, text) in enumerate(items):
        w = (text or "").split()
        filler = rng.choices(vocabulary, k=rng.choice([0, 20, 3000]))
        rows.append((i, " ".join([*filler, *w, *filler])))
        rows.append((100 + i, " ".join([*filler, *w[: int(len(w) * 0.8)], "other", *filler]).upper()))
        rows.append((200 + i, " ".join([*w[::2], *filler])))
    rows += [(300, None), (301, ""), (302, "One TWO"), (None, items[3][1])]
    expected = {}
    for d, t in rows:
        for item, it in items:
            s = shingles(it)
            shared = len(s & shingles(t))
            if s and shared and 100 * shared >= 75 * len(s):
                expected[d, item] = max(expected.get((d, item), 0), shared / len(s))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(docs, table).collect()}
    assert got == pytest.approx(expected)
    kept = decontaminate.keep_uncontaminated(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {d for d, _ in expected})
    assert decontaminate.contained_items(docs, table.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), table).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    table = spark.createDataFrame([(i, f"a{i} b{i} c d e{i} f g{i}") for i in range(20)], "item_id long, text string")
    docs = frame(spark, [(i, f"x y a{i} b{i} c d e{i} f g{i} z") for i in range(0, 40, 2)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, table).collect()}
    assert got == {(i, i) for i in range(0, 20, 2)}
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(docs, table).collect()} == set(range(20, 40, 2))


def test_decontamination_candidates(spark):
    """Only MinHash values are indexed: few false candidates, and no contained item is missed."""
    rng = random.Random(15)
    vocabulary = [f"q{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([25, 60, 400])))) for i in range(60)]
    rows = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        for j, part in enumerate((len(w), len(w) * 9 // 10, len(w) // 5)):
            filler = rng.choices(vocabulary, k=rng.choice([0, 300, 9000]))
            rows.append((10 * i + j, " ".join([*filler, *w[:part], *filler])))
    docs, table = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    sets = common.materialize(decontaminate.item_sets(table), "items")
    assert all(len(r.picks) <= decontaminate.HASHES for r in sets.collect())
    ids = {r["item"]: r.item_id for r in sets.collect()}
    found = {(r.doc_id, ids[r["item"]]) for r in decontaminate.candidates(docs, sets).where("item is not null").collect()}
    expected = {(d, i) for d, t in rows for i, it in items if 100 * len(shingles(it) & shingles(t)) >= 75 * len(shingles(it))}
    assert expected <= found and len(expected) >= 120 and len(found) <= 1.6 * len(expected)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, table).collect()} == expected


def clashing(spark, rows):
    """A frame whose extra columns have names that operators might use inside."""
    names = ["_doc", "_starts", "_lines", "_kept", "_text", "__d", "__n", "__s", "copy_no", "row", "mark", "lines", "kept", "n", "at", "item", "runs", "changed", "d", "m", "size", "rank", "part", "bucket"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(d, t, "aa", "s", None if t is None else len(t), *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(rows)], schema)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"first line {i}\nthe and of {i}\nw x y z {i}") for i in range(12)] + [(20, "first line 3\nthe and of 3\nw x y z 3\nmore"), (21, None)]
    docs = clashing(spark, rows)
    items = spark.createDataFrame([(1, "w x y z 5")], "item_id long, text string")
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    for out in (language.keep_identified(docs), line_dedup.dedup_documents(docs), decontaminate.keep_uncontaminated(docs, items)):
        assert out.columns == docs.columns
        got = {r.doc_id: r.asDict() for r in out.collect()}
        assert got and all(v == before[d][c] for d, r in got.items() for c, v in r.items() if c not in ("text", "n_chars"))
    assert decontaminate.keep_uncontaminated(docs, items).count() == len(rows) - 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns and len(mixed.columns) == len(docs.columns) + 1
    assert all(r[c] == before[r.doc_id][c] for r in mixed.collect() for c in docs.columns)


def brute_lines(rows, run):
    seen, gone = set(), set()
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for i in range(len(lines) - run + 1):
            key = tuple(lines[i : i + run])
            if key in seen:
                gone |= {(d, i + j) for j in range(run)}
            seen.add(key)
    return gone


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = [f"line {i}" for i in range(12)] + [""]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 30)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, rows[0][1]), (73, "same\n" * 40), (74, "z\n" * 5000), (None, rows[0][1])]
    gone = brute_lines(rows, 3)
    docs = frame(spark, rows)
    got = {str(r.doc_id): (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.deduplicated_lines(docs).collect()}
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(lines) if (d, i) not in gone]
        assert got[str(d)] == (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))
    out = line_dedup.dedup_documents(docs)
    assert out.columns == docs.columns
    left = {str(r.doc_id): (r.text, r.n_chars) for r in out.collect()}
    assert "72" not in left and left["70"] == (None, None) and left["71"] == ("", 0)
    assert all(n == len(t) for t, n in left.values() if t is not None)
    assert line_dedup.deduplicated_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_short_passages(spark):
    rng = random.Random(8)
    pool = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 50), ("c", 49), ("d", 30), ("e", 30), ("f", 5), ("g", 1))] + [""]
    rows = [(i, "\n".join([*rng.choices(pool, k=rng.randrange(1, 4)), *[f"own {i} {j}" for j in range(i % 3)]])) for i in range(60)]
    rows += [(100, pool[0]), (101, "new\n" + pool[1] + "\nother"), (102, pool[2]), (103, pool[3] + "\n" + pool[4] + "\nlast"), (104, None), (105, ""), (106, "x\n" + " \t".join("h" * 60) + "\n" + " \t".join("h" * 60)), (None, pool[0])]
    gone = brute_lines(rows, 3)
    for size in (1, 2):
        seen = set()
        for d, t in rows:
            lines = t.split("\n") if d is not None and t is not None else []
            for i in range(len(lines) - size + 1):
                key = tuple(lines[i : i + size])
                if sum(len(words(x)) for x in key) >= 50:
                    gone |= {(d, i + j) for j in range(size)} if key in seen else set()
                    seen.add(key)
    assert {(100, 0), (101, 1), (103, 0), (103, 1), (106, 2)} <= gone and not {(102, 0), (101, 0), (103, 2), (106, 1)} & gone
    want = {str(d): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}
    docs = frame(spark, rows)
    assert {str(r.doc_id): r.kept_text for r in line_dedup.deduplicated_lines(docs, words=50).collect()} == want
    empty = {str(d) for d, t in rows if t is not None and all((d, i) in gone for i in range(len(t.split("\n"))))}
    assert "100" in empty and {str(r.doc_id): r.text for r in line_dedup.dedup_documents(docs).collect()} == {d: t for d, t in want.items() if d not in empty}


def test_line_dedup_of_rows_that_share_a_doc_id(spark):
    rows = [(1, "a\nb\nc"), (5, "a\nb\nc\nown"), (5, "x\ny\nz"), (5, "x\ny\nz"), (9, "x\ny\nz\nend")]
    got = sorted((r.doc_id, r.kept_text) for r in line_dedup.deduplicated_lines(frame(spark, rows)).collect())
    assert got == [(1, "a\nb\nc"), (5, "own"), (5, "x\ny\nz"), (5, "x\ny\nz"), (9, "end")]


def test_line_fingerprints_are_fewer_than_windows(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(f"l{rng.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    n = line_dedup.fingerprints(frame(spark, rows)).count()
    assert 40 * 48 * 0.4 < n < 40 * 48 * 0.6


def test_lookup_of_heavy_keys(spark, monkeypatch):
    rng = random.Random(5)
    keys = [rng.choice([0] * 30 + [1] * 5 + list(range(2, 60))) for _ in range(900)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    table = common.materialize(rows.where("k % 7 <> 3").groupBy("k").count().withColumnRenamed("count", "n"), "keys")
    for heavy in (1, 10, 500):
        monkeypatch.setattr(common, "HEAVY", heavy)
        got = common.lookup(rows, table, ["k"]).select("k", "i", "n").collect()
        assert sorted(map(tuple, got)) == sorted((k, i, keys.count(k)) for i, k in enumerate(keys) if k % 7 != 3)


def test_mixing(spark):
    rng = random.Random(11)
    rows = [(i, None if i % 50 == 7 else " ".join(["w"] * rng.choice([0, 1, 5, 50, 400]))) for i in range(3000)]
    names = ["b", "a", None, "é", "a" * 3, "c"]
    docs = frame(spark, rows, lambda i: (None, names[0] if i % 3 == 0 else names[i % 6]))
    got = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in got} == again and len(got) == 3000
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        free = sum(weight[s] for s in size if s not in capped)
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / free for s in size}
        over = {s for s in size if target[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in size:
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 400
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "copy_no"]
    assert out.count() == sum(r.copies for r in got if r.size)


def test_mixing_tree_of_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    docs = frame(spark, [(i, "w " * (1 + i % 5)) for i in range(1500)], lambda i: (None, f"s{i % 2}"))
    got = mixing.mix(docs).collect()
    for s in ("s0", "s1"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5


def test_round_pairs_keeps_mass():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes, parts = rng.integers(1, 100, 40), rng.random(40)
        out = mixing.round_pairs(sizes, parts, rng.random(40))
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and (out * sizes).sum() == pytest.approx((parts * sizes).sum())


def test_language(spark):
    rng = random.Random(2)
    sound = {"aa": "the and of with ing".split(), "bb": "der und ist ein sch".split(), "cc": "los que una ción de".split()}
    rows, langs = [], []
    for i in range(300):
        lang = list(sound)[i % 3]
        rows.append((i, " ".join(rng.choices(sound[lang], k=30))))
        langs.append(lang)
    rows += [(900, None), (901, ""), (902, "12 34 ..."), (906, "²½ 12 ¾ ① Ⅻ ٣ _"), (903, "И"), (904, "the and of with " * 5000), (905, "the of and with " * 30 + "que una los de " * 30)]
    langs += [None] * 7
    docs = frame(spark, rows, lambda i: (langs[i], None))
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert held and all(got[i].lang_pred == langs[i] for i in range(300))
    assert [got[i].lang_pred for i in (900, 901, 902, 906)] == ["und"] * 4 and got[903].lang_pred in sound and got[904].lang_pred == "aa"
    assert 0.3 < got[905].score < 0.7
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {900, 901, 902, 906}
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.where("lang is null")).collect()} == {"und"}


def brute_mixture(counts, tables, penalty=language.PENALTY):
    """Proportions of the best language set, over all sets that greedy growth can reach; plain loops, many rounds."""
    total = sum(counts.values())

    def fit(names):
        share = {n: 1 / len(names) for n in names}
        for _ in range(400):
            new = dict.fromkeys(names, 0.0)
            for cell, k in counts.items():
                mixed = sum(share[n] * tables[n][cell] for n in names)
                for n in names:
                    new[n] += k * share[n] * tables[n][cell] / mixed / total
            share = new
        return share, sum(k * np.log(sum(share[n] * tables[n][cell] for n in names)) for cell, k in counts.items())

    chosen = [max(tables, key=lambda n: fit([n])[1])]
    share, value = fit(chosen)
    while len(chosen) < len(tables):
        best, (new, gain) = max(((n, fit([*chosen, n])) for n in tables if n not in chosen), key=lambda x: x[1][1])
        if gain - value <= penalty * np.log(total + 1):
            return share
        chosen, share, value = [*chosen, best], new, gain
    return share


def test_mixture_against_brute_force():
    rng = np.random.default_rng(7)
    names = ["aa", "bb", "cc", "dd"]
    probs = rng.dirichlet(np.full(60, 0.3), 4) * 0.98 + 0.02 / 60
    for own in ([1, 0, 0, 0], [0.7, 0.3, 0, 0], [0.4, 0.3, 0.3, 0], [0.25] * 4, [0, 0.95, 0, 0.05]):
        drawn = rng.choice(60, 600, p=np.array(own) @ probs)
        cells, n = np.unique(drawn, return_counts=True)
        got = language.mixture(cells, n, np.log(probs))
        want = brute_mixture(dict(zip(cells.tolist(), n.tolist(), strict=True)), dict(zip(names, probs, strict=True)))
        assert got == pytest.approx([want.get(x, 0.0) for x in names], abs=0.02) and (got > 0).sum() == len(want)


def test_language_without_labels(spark):
    rows = [(1, "the and of"), (2, "И"), (3, "12 34 ..."), (4, ""), (5, None), (6, "1\n2 é"), (None, "a")]
    for lang in (None, "aa"):
        docs = frame(spark, rows, lambda i, lang=lang: (lang, None))
        assert {r.doc_id for r in language.keep_identified(docs).collect()} == {1, 2, 6, None}


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chat(spark):
    odd = ["", "</turn>", "<\\/turn>", "\\", "\\\\n", "### Role: user\n", "#####", "a</turn>\n### Role: x", "é\U0001f600#", "\\### Assistant: </turn> ok", None, "x\\"]
    roles = ["user", "assistant", "assistant", "system", None, "", "ro\nle", "r\\n#### </turn>"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(roles), rng.choice(odd), "z") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant", "x" * 1000, "z") for t in range(300)] + [(51, 1, "user", "b", "z"), (51, 1, "user", "a", "z"), (51, 1, "user", "a", "z"), (None, None, "assistant", "q", "z")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    read = {r.conv_id: [(x.role, x.text) for x in r.t] for r in out.select("conv_id", chat.read_back(out["formatted"]).alias("t")).collect()}
    parts = {r.conv_id: r for r in out.collect()}
    key = lambda r: ((r[1] is not None, r[1]), (r[2] is not None, r[2] or ""), r[3] or "")
    digest = {r.conv_id: r for r in chat.digests(out).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        assert read[c] == [(r[2], r[3] or "") for r in own]
        ends = parts[c].formatted.split("</turn>\n")
        marked = [ends[s.turn][s.start : s.start + s.length] for s in parts[c].loss]
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in marked] == [r[3] or "" for r in own if r[2] == "assistant"]
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        d = digest[c]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(own), len(loss), len(parts[c].formatted))
        assert (d.loss_sha256, d.turns_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (loss, said))
    assert parts[51].formatted == "### Role: user\na</turn>\na</turn>\nb</turn>\n"
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def brute_repeats(rows, window):
    first, gone = {}, set()
    for d, t in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    for d, t in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= {(d, i + j) for j in range(window)}
    return gone


def repeats_corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ñ"]
    passages = [rng.choices(vocabulary, k=k) for k in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(60):
        parts = [rng.choices(vocabulary, k=rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), rng.choices(vocabulary, k=rng.randrange(0, 30))]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", " \t"]).join(itertools.chain(*parts))))
    rows += [(100, rows[0][1]), (101, rows[1][1] + " tail"), (102, None), (103, ""), (104, "a " * 200), (105, "a " * 120), (106, " ".join(passages[3] * 3)), (107, " ".join(rng.choices(vocabulary, k=20000))), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("hot", [4000, 2])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 3000)
    rows = repeats_corpus()
    gone = brute_repeats(rows, 50)
    got = {str(r.doc_id): r for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w = words(t)
        kept = [x for i, x in enumerate(w) if (d, i) not in gone]
        r = got[str(d)]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(w) - len(kept), b" ".join(kept).decode()), d
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_substring_dedup_of_rows_that_share_a_doc_id(spark):
    w, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60))
    rows = [(1, w), (5, w), (5, other), (5, w), (7, other)]
    got = sorted((r.doc_id, r.n_removed, r.kept) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 0, w), (5, 0, other), (5, 60, ""), (5, 60, ""), (7, 60, "")]


def test_matching_statistics():
    rng = np.random.default_rng(2)
    segments = [rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint64) for _ in range(12)]
    values = rng.permutation(12)
    index = fm_index.FMIndex(segments, values, 6)
    queries = [rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64) for _ in range(20)] + segments[:3]
    length, low, high = index.matching_statistics(queries)
    for q, query in enumerate(queries):
        pad = length.shape[1] - len(query)
        for i in range(len(query)):
            best = 0
            while best < min(6, len(query) - i) and any(s[j : j + best + 1].tolist() == query[i : i + best + 1].tolist() for s in segments for j in range(len(s) - best)):
                best += 1
            assert length[q, pad + i] == best
            holders = [k for k, s in enumerate(segments) for j in range(len(s) - best + 1) if s[j : j + best].tolist() == query[i : i + best].tolist()]
            if best:
                assert high[q, pad + i] - low[q, pad + i] == len(holders)
            if best == 6:
                assert index.value(low[q, pad + i : pad + i + 1])[0] == min(values[k] for k in holders)


def test_token_counts(spark):
    from tokenizers import models

    vocabulary = tokens.Vocabulary.load(tokens.DEFAULT_MODEL)
    rng = random.Random(1)
    drawn = ["".join(rng.choices("aeioutnshrdlé", k=rng.randrange(1, 14))) for _ in range(500)] + ["日本", "x" * 3000, "the", "then", "thence"]
    got = tokens.count_words(drawn, vocabulary)
    for word in drawn:
        text = tokens.MARK + word
        best = [(0.0, 0)] + [None] * len(text)
        for i in range(1, len(text) + 1):
            options = [(best[j][0] + vocabulary.pieces[text[j:i]], -best[j][1] - 1) for j in range(max(0, i - vocabulary.longest), i) if text[j:i] in vocabulary.pieces]
            if text[i - 1] not in vocabulary.pieces:
                k = len(text[i - 1].encode())
                options.append((best[i - 1][0] + k * tokens.BYTE_SCORE, -best[i - 1][1] - k))
            value, n = max(options)
            best[i] = (value, -n)
        assert got[word] == best[-1][1], word
    known = [w for w in drawn if all(c in vocabulary.pieces for c in w)]
    model = models.Unigram([("<unk>", -1000.0), *vocabulary.pieces.items()], 0, False)
    same = sum(len(model.tokenize(tokens.MARK + w)) == got[w] for w in known if len(w) < 100)
    assert same >= 0.98 * len([w for w in known if len(w) < 100])  # equally good segmentations may differ
    giant = "".join(rng.choices("aeé日x", k=200_000))
    few = tokens.count_words([giant, giant[:70], giant[:63], giant[:64]], vocabulary)
    assert tokens.long_count(tokens.MARK + giant[:63], vocabulary) == few[giant[:63]] and few[giant] > 50_000
    rows = corpus() + [(9100, giant + " a")]
    out = tokens.token_counts(frame(spark, rows)).collect()
    every = tokens.count_words({w.decode() for _, t in rows for w in words(t)}, vocabulary)
    want = sorted((str(d), len(words(t)), sum(every[w.decode()] for w in words(t))) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in out) == want
    assert tokens.token_counts(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    rows = [(d, t) for d, t in corpus() if d is not None] + [(9005, "a"), (9006, "ab\ncd"), (9007, "ab\ncd"), (9008, "\n\n"), (9009, "é" * 9), (9010, "p q r. " * 3000)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    ordered = sorted((d, t or "") for d, t in rows)
    assert len(got) == len(rows)
    prints = {}
    for (d, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        one, two, three = (piece_set(x) for x in (t, edited, following))
        assert r.near_edited == pytest.approx(jaccard(one, two)) and r.near_next == pytest.approx(jaccard(one, three))
    assert len(set(prints.values())) == len(prints)
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    alone = fingerprint.fingerprints(frame(spark, [(5, "abcd efgh")])).collect()[0]
    assert alone.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and alone.near_next == 1.0


def piece_set(text):
    data = np.frombuffer(text.encode(), np.uint8)
    digests, _ = fingerprint.pieces(data, np.array([0, len(data)])) if len(data) else (np.empty(0), None)
    return set(digests.tolist())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_ties_and_nulls(spark):
    rows = [(1, "b b b b"), (1, "a a a a"), (None, "z z z z"), (2, None), (None, "y")]
    got = fingerprint.fingerprints(frame(spark, rows)).collect()
    assert len(got) == 5
    assert {r.edited_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(x).hexdigest() for x in (b"a a a b", b"b b b ")}


def brute_pieces(text):
    """Pieces by a plain walk: cut after newlines and after words whose hash ends in given bits."""
    import pyarrow as pa

    raw, out, begin, i = text.encode(), set(), 0, 0
    word = b""
    for i, byte in enumerate(raw):
        space = bytes([byte]).isspace() and byte < 33 and byte not in (28, 29, 30, 31)
        if not space:
            word += bytes([byte])
        ended = not space and (i + 1 == len(raw) or raw[i + 1] in b" \t\n\v\f\r")
        cut = byte == 10
        if ended:
            _, _, data, offsets = next(common.text_chunks(pa.array([word.decode()])))
            cut, word = int(common.word_hashes(data, *common.word_spans(data, offsets)[:2])[0]) & 7 == 0, b""
        if cut:
            out.add(raw[begin : i + 1])
            begin = i + 1
    if begin < len(raw):
        out.add(raw[begin:])
    return out


def test_fingerprint_pieces_by_a_plain_walk():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)] + ["a\n\nb", " x \n y ", "é ü\tß" * 30, "one", "\n"]
    for a, b in zip(texts, texts[1:], strict=False):
        one, two = brute_pieces(a), brute_pieces(b)
        assert len(piece_set(a)) == len(one) and len(piece_set(a) & piece_set(b)) == len(one & two)
        assert len(piece_set(a + b)) == len(brute_pieces(a + b))


def test_fingerprints_split_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    rng = random.Random(4)
    rows = [(rng.choice([3, None, 5, 6]), f"{rng.randrange(10**6)} text {i}") for i in range(300)] + [(3, "same")] * 5
    docs = frame(spark, rows)
    ranges = fingerprint.in_order(docs).where("tail = 0").groupBy("range").count().collect()
    assert len(ranges) >= 20 and max(r["count"] for r in ranges) < 60
    ordered = sorted(((d is None, d or 0, t) for d, t in rows))
    want = []
    for (_, _, t), (_, _, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(t) // 4
        want.append(hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in fingerprint.fingerprints(docs).collect()) == sorted(want)


PAGES = "page_id long, url string, html string, record_type string"


def test_warc_round_trip(spark, monkeypatch):
    rng = random.Random(6)
    bodies = ["", "<p>é</p>\r\n\r\nx", "\x1f\x8b\x08 WARC/1.1\r\n", None] + ["".join(chr(rng.randrange(32, 0x250)) for _ in range(rng.randrange(5000))) for _ in range(30)]
    rows = [(i, None if i % 9 == 0 else f"http://x/{i} ü\n", rng.choice(bodies), "r") for i in range(300)] + [(300, "u", "long " * 400000, "r"), (7, "again", "", "r"), (None, "u", bodies[5], "r")]
    pages = spark.createDataFrame(rows, PAGES)
    for least, split in ((0, 1 << 20), (0, 700), (6, 5000)):
        folder = f"{common.scratch(spark)}/t{least}-{split}"
        got = warc.read_archives(warc.write_archives(warc.with_referents(pages, least), folder), folder, split).collect()
        first = {}
        for page, _, html, _ in rows:
            if page is not None:
                first[html or ""] = min(first.get(html or "", page), page)
        want = []
        for page, _, html, _ in rows:
            raw = (html or "").encode()
            again = page is not None and len(raw) >= least and first[html or ""] < page
            want.append((str(page), len(raw), warc.payload_digest(raw), "revisit" if again else "response", first[html or ""] if again else None))
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)
        assert all(r.payload == (html or "").encode() for r in got for page, _, html, _ in rows if r.record_type == "response" and page == r.page_id and page not in (None, 7))
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def nested_archive():
    """Three records of which the second holds members itself, stored: they must not be taken for records."""
    import zlib

    member = warc.record(1, "u", b"text", None)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n" + member * 3 + b"\x1f\x8b\x08" * 50 + member
    return member + packer.compress(raw) + packer.flush() + member


def test_warc_ranges_find_records_between_false_magic():
    archive = nested_archive()
    for split in (1, 7, 50, 200, 333, len(archive)):
        found = [c for a in range(0, len(archive), split) for c in warc.candidates(io.BytesIO(archive), len(archive), a, min(a + split, len(archive)))]
        assert len(found) == 7
        starts, ends = np.array(found).T
        own = warc.chain(starts, ends)
        assert own.sum() == 3 and starts[own][0] == 0 and ends[own][-1] == len(archive)
        assert [warc.parse_record(r)["record_type"] for r in warc.records_at(io.BytesIO(archive), len(archive), starts[own].tolist())] == ["response"] * 3


def test_warc_nested_members_in_archives(spark, tmp_path):
    from pyspark.sql import functions as F

    archive = nested_archive()
    junk = b"\x1f\x8b\x08 junk between records"
    for name, data in (("a.warc.gz", archive), ("b.warc.gz", archive[: len(archive) // 8] + junk + archive), ("c.warc.gz", b"none")):
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(p.name, p.stat().st_size, 0) for p in tmp_path.iterdir()], "path string, bytes long, records long")
    for split in (50, 200, 1 << 20):
        got = warc.read_archives(manifest, f"file://{tmp_path}", split).where("error is null").groupBy(F.col("page_id").isNull().alias("middle")).count().collect()
        assert {r.middle: r["count"] for r in got} == {True: 2, False: 4}


def test_warc_writer_ends_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 20, None) for i in range(50)], "page_id long, url string, html string, refers_to long").coalesce(1)
    manifest = warc.write_archives(pages, f"file://{tmp_path}")
    assert manifest.count() > 3 and {r.page_id for r in warc.read_archives(manifest, f"file://{tmp_path}").collect()} == set(range(50))


def test_mixing_of_large_ids_and_a_null_one(spark):
    """Ids that a double cannot hold, a null one, -1 and 0: each document once, and the words stay near the target."""
    ids = [2**60 + i for i in range(150)] + [None, -1, 0]
    rows = [(d, "w " * (16 + i % 3), "en", "s", 0) for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, ids))
    assert abs(sum(r.taken for r in got) - got[0].target) <= 18
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {r.doc_id: r.copies for r in got if r.copies}


def test_fingerprint_ranges_and_samples_are_bounded(spark, monkeypatch):
    """With fewer ranges and sampled keys than the table asks for, the rows stay the same."""
    rng = random.Random(17)
    rows = [(i // 3, " ".join(f"w{rng.randrange(90)}" for _ in range(30))) for i in range(600)]
    docs = frame(spark, rows)
    want = sorted(map(tuple, fingerprint.fingerprints(docs).collect()), key=str)
    for name, value in (("RANGE_ROWS", 10), ("MOST_RANGES", 7), ("MOST_SAMPLED", 25)):
        monkeypatch.setattr(fingerprint, name, value)
    ranged = fingerprint.in_order(docs.select("doc_id", "text"))
    assert ranged.select("range").distinct().count() <= 7
    assert sorted(map(tuple, fingerprint.fingerprints(docs).collect()), key=str) == want


def test_repeated_runs_are_maximal(spark):
    """A passage of 40 lines that stands in three documents, at other places, is one run of each later one."""
    passage = [f"line {i}" for i in range(40)]
    rows = [(1, "\n".join(["a", *passage, "b"])), (2, "\n".join(["c", "d", *passage])), (3, "\n".join([*passage[5:30], "e"])), (4, "x\ny\nz\nx\ny\nz\nx\ny"), (5, None)]
    got = sorted((r.doc_id, r.start, r.length, r.first_doc, r.first_start) for r in line_dedup.repeated_runs(frame(spark, rows)).collect())
    assert got == [(2, 2, 40, 1, 1), (3, 0, 25, 1, 6), (4, 3, 5, 4, 0)]
