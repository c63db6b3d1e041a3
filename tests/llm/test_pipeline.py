"""The pipeline against a brute-force version of its deciding stages, and all opN queries on a small folder of tables."""

import random

from pyspark.sql import functions as F
from test_operators import brute_components, brute_lines, shingles

import corpus_pipeline
from saccade.llm import queries


def tables(spark, folder):
    rng = random.Random(21)
    vocabulary = {"aa": ["the", "and", "with", "ing"], "bb": ["der", "und", "ist", "sch"]}
    names = [f"n{i}" for i in range(500)]
    line = lambda lang: " ".join(rng.choices(vocabulary[lang], k=3) + rng.choices(names, k=9))
    common = [line("aa") for _ in range(4)]
    items = [(i, " ".join(rng.choices(names, k=20))) for i in range(5)] + [(9, None)]
    rows = []
    for i in range(80):
        lang = "ab"[i % 2] * 2
        lines = [line(lang) for _ in range(rng.randrange(2, 6))]
        if i % 10 == 0:
            lines += common
        if i % 16 == 3:
            lines.append("x " + items[i % 5][1] + " y")
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}", 0))
    rows += [(100, rows[0][1], "aa", "s0", 0), (101, rows[5][1].replace("n", "n", 1) + " z", "bb", "s1", 0), (102, None, None, None, None), (103, "12 !", "aa", "s0", 4), (104, "", "aa", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 4}</p>") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return rows, items


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    kept = [(d, t) for d, t, *_ in rows if t is not None and any(c.isalpha() for c in t)]
    gone = brute_lines(kept, 3)
    lines = [(d, [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]) for d, t in kept]
    kept = [(d, "\n".join(x)) for d, x in lines if x]
    component, _ = brute_components(kept)
    kept = [(d, t) for d, t in kept if component[d] == d]
    bad = {d for d, t in kept for _, it in items if shingles(it) and 100 * len(shingles(it) & shingles(t)) >= 75 * len(shingles(it))}
    kept = {d: t for d, t in kept if d not in bad}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bad and len(kept) < len(rows) - 4
    assert all(kept[r.doc_id] == r.text and r.n_chars in (0, len(r.text)) for r in got)
    sizes = {d: len(t.split()) for d, t in kept.items()}
    taken = sum(sizes[r.doc_id] for r in got)
    assert abs(taken - 1.5 * sum(sizes.values())) <= 3 * max(sizes.values())
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, []).append(r.copy_no)
    assert all(sorted(n) == list(range(1, len(n) + 1)) and len(n) <= 2 for n in copies.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_queries_return_a_row_per_document(spark, tmp_path):
    rows, _ = tables(spark, str(tmp_path))
    for name in ("op4_substring_dedup", "op5_line_dedup", "op6_mix_sources", "op7_language", "op8_token_counts", "op9_near_duplicates", "op10_fingerprints"):
        got = queries.QUERIES[name](spark, str(tmp_path)).select("doc_id").collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows), name
    assert queries.QUERIES["op1_warc_round_trip"](spark, str(tmp_path)).where("record_type = 'response'").count() == 4
    assert queries.QUERIES["op3_chat_format"](spark, str(tmp_path)).count() == 2


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns with dots, quotes, in another case's letters and with names that the operators use themselves."""
    rows, _ = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("a.b", "with space", "mark", "row", "lines", "size", "rank", "_gone", "d"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = out.select(*[F.col(f"`{c}`") for c in docs.columns]).collect()
        assert got and all(r["a.b"] == "a.b" and r["_gone"] == "_gone" and r["size"] == "size" for r in got), name
