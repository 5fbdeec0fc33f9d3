"""Registered queries against their SQL, and the pipeline against what must come of a small corpus."""

from pathlib import Path

import corpus_pipeline
import pytest
from conftest_llm import words
from oracle_check import compare, database
from test_models_text import toxic_rows

from expogrid.llm import queries
from expogrid.llm.common import alnum_words

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert compare(spark, database(FOLDER), name, queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op11_spelling_variants", "op13_cover_tree_negatives"}))
def test_one_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def corpus(spark, folder):
    rows, labels = toxic_rows(240)
    passage, exam = words(900, 70), words(901, 40)
    extra = {
        1000: words(1000, 150), 1001: words(1001, 90) + passage, 1002: passage + words(1002, 90), 1003: words(1003, 60) + exam + words(1004, 60),
        1004: words(1005, 3000) + exam[:13], 1005: words(1006, 8),
    }
    near = list(extra[1000])
    near[70] = "changed"
    rows += [(i, " ".join(w)) for i, w in extra.items()] + [(1010, " ".join(extra[1000])), (1011, " ".join(near)), (1012, None), (1013, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(exam)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, passage


def test_pipeline(spark, tmp_path):
    docs, passage = corpus(spark, str(tmp_path))
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in range(240) if i % 3 == 0}
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        path = str(tmp_path / name)
        at.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "sentencepiece":
            assert at.columns == docs.columns
    gone = set(texts) - set(seen["toxicity"])
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) <= 3
    gone = set(seen["toxicity"]) - set(seen["simhash_near_dedup"])
    assert gone < {1000, 1010, 1011, 1012, 1013} and len(gone) == 3 and len({1012, 1013} & gone) == 1
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["simhash_near_dedup"])
    line = " ".join(passage)
    assert sum(line in (cut[i].text or "") for i in (1001, 1002)) == 1
    for i, row in cut.items():
        assert row.text == texts[i] or i in (1001, 1002)
        assert row.n_chars == (None if row.text is None else len(row.text))
    assert all(len(alnum_words(cut[i].text)) >= 85 for i in (1001, 1002))
    assert set(cut) - set(seen["benchmark_decontamination"]) == {1003}
    last = seen["sentencepiece"]
    assert set(last) == set(seen["benchmark_decontamination"]) and all(r.parity and r.restored for r in last.values())
    ran = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {i: r.n_tokens for i, r in last.items()}


def test_pipeline_of_nothing(spark, tmp_path):
    corpus(spark, str(tmp_path / "full"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / "full" / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
