"""The pipeline's stages keep the columns and the clean documents, and drop what they should."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_components, brute_language, brute_leaks, plain_ip, sets, text_of

import __spark_entry__
import corpus_pipeline
from sitequarry.llm.common import load
from sitequarry.llm.queries import OP4_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SMALL, "documents").cache()
    extra = spark.createDataFrame([(900001, "%%% 123", "en", "src1", 7), (900002, None, None, None, None)], docs.schema)
    item = load(spark, SMALL, "benchmark").head().text
    leak = spark.createDataFrame([(900003, "unterwegs " + item + " danach", "en", "src1", 1), (900004, docs.where("doc_id = 0").head().text, "en", "src1", 1)], docs.schema)
    at = docs.union(extra).union(leak)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = stage(spark, at, SMALL).cache()
        assert at.columns == docs.columns, name
        seen.append({r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in at.select("doc_id").collect()})
    assert seen[0] == {900001, 900002}
    assert 900004 in seen[1]
    assert 900003 in seen[2]
    assert seen[3] == set()
    out = corpus_pipeline.STAGES[-1][1](spark, at, SMALL)
    assert set(docs.columns) < set(out.columns)
    assert out.where(F.col("text").contains("@mail")).where(F.col("text").rlike(r"[a-z]+\.\d\d@mail")).count() == 0


def test_texts_of_no_learned_language_go_with_any_number_of_languages(spark):
    docs = load(spark, SMALL, "documents")
    schema = docs.schema
    other = spark.createDataFrame([(900001, "Это совсем другой язык", None, "src1", 1), (900002, "hyvää huomenta ystävä kiitos", None, "src1", 1), (900003, "完全に別の言語です", None, "src1", 1)], schema)
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())
    for n in (2, 3, 4):
        own = docs.where(F.col("lang").isin(langs[:n]))
        kept = {r.doc_id for r in corpus_pipeline.language(spark, own.union(other), SMALL).select("doc_id").collect()}
        assert kept == {r.doc_id for r in own.select("doc_id").collect()}, n


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows, items): copies, near copies, leaks, addresses, texts of no language, null and repeated ids."""
    rng = random.Random(11)
    rows = []
    for i in range(40):
        text = text_of(rng, rng.choice([5, 30, 80]))
        rows.append([i, text if i % 2 else text.replace("a", "ä").replace("e", "é"), "xx" if i % 2 else "yy", f"s{i % 3}"])
    items = [(0, text_of(rng, 30)), (1, text_of(rng, 12)), (2, None)]
    near = rows[2][1].split()
    near[len(near) // 2] = "changed"
    rows += [[50, rows[1][1], "xx", "s0"], [51, rows[1][1].upper(), "xx", "s0"], [52, " ".join(near), "yy", "s1"], [53, "so " + items[0][1] + " it is", "xx", "s2"], [54, text_of(rng, 9) + " " + items[1][1], None, None]]
    rows += [[55, "call 10.1.2.3 now or " + text_of(rng, 20), "xx", "s1"], [56, "½ 123", "xx", "s0"], [57, "жщюъ фыва", None, "s1"], [58, None, "xx", "s0"], [59, "", "xx", "s0"]]
    rows += [[60, rows[3][1], "xx", "s1"], [60, rows[3][1], "xx", "s1"], [None, text_of(rng, 25), "xx", "s2"], [None, items[0][1], "xx", "s2"]]
    rows = [(*r, len(r[1] or "")) for r in rows]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "component": F.lit(2), "leak": F.lit(3)})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_the_whole_run_gives_what_a_plain_version_gives(spark, corpus):
    folder, rows, items = corpus
    got = corpus_pipeline.run(spark, folder)
    assert {"key", "component", "leak"} <= set(got.columns)

    def well(text):
        lang, score, known = brute_language([(r[1], r[2]) for r in rows], text)
        return lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE and known >= corpus_pipeline.LEAST_KNOWN

    kept = [r for r in rows if well(r[1])]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {56, 57, 58, 59}
    group = brute_components([(r[0], r[1]) for r in kept if r[0] is not None], 5)
    one = {r[0]: r for r in kept if r[0] is not None}  # a repeated id has one text here
    kept = [r for i, r in one.items() if group[i] == i] + [r for r in kept if r[0] is None]
    assert {50, 51, 60} & {r[0] for r in kept} == set() and len(sets(rows[2][1], 5)) > 0
    leaks = brute_leaks([(i, r[1]) for i, r in enumerate(kept)], items)
    kept = [r for i, r in enumerate(kept) if not any(k[0] == i for k in leaks)]
    assert {53, 54} & {r[0] for r in kept} == set() and sum(r[0] is None for r in kept) == 1
    new = [(r[0], r[1].replace("10.1.2.3", plain_ip(corpus_pipeline.KEY, "10.1.2.3")), *r[2:4]) for r in kept]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", new)
    want = con.execute(f"select doc_id, text, lang, source, n_chars, n_tokens, pass, block from (select m.*, d.text, d.lang, length(d.text) as n_chars from ({OP4_SQL}) m join documents d on m.doc_id is not distinct from d.doc_id)").fetchall()
    have = [tuple(r) for r in got.select("doc_id", "text", "lang", "source", "n_chars", "n_tokens", "pass", "block").collect()]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names, and no rows at all."""
    benchmark = SMALL
    clash = {"sig": F.lit(1), "band": F.lit(2), "text_key": F.lit("x"), "words": F.lit("y"), "start": F.lit(3), "s": F.lit(4), "weight": F.lit(5)}
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns(clash)
    want = {"language": [4, 5, 5, 7, None], "near_duplicates": [1, 2, 3, 4, 7, 8, None], "decontamination": [1, 2, 3, 4, 5, 5, 7, 8, None], "personal_data": [1, 2, 3, 4, 5, 5, 7, 8, None]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, benchmark)
        assert stage(spark, odd.limit(0), benchmark).count() == 0, name
        if name == "mixture":
            assert set(odd.columns) < set(out.columns) and {r.doc_id for r in out.collect()} <= {r[0] for r in ODD}
            continue
        assert out.columns == odd.columns, name
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(want[name], key=str), name


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
