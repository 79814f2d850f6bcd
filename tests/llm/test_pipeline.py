"""The pipeline's stages on the small tables: each works on what its predecessor kept, and its decisions take effect."""

from collections import Counter

import corpus_pipeline
import pytest
from quillspark.llm import line_dedup, quality
from quillspark.llm import queries as Q
from quillspark.llm.common import written

from tests.llm.test_operators import check_pieces

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, tables = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DATA), name)
        tables.append((name, before, docs))
    for name, before, after in tables[:-1]:
        assert after.columns == before.columns, name
    first = {r["doc_id"] for r in tables[0][2].collect()}
    verdicts = quality.quality_verdicts(tables[0][1], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert first == {r["doc_id"] for r in verdicts.where("kept").collect()}
    lines = Counter(n for r in tables[1][2].collect() for x in (r["text"] or "").split("\n") if len((n := line_dedup.normal(x)).split()) > 1)
    assert max(lines.values()) == 1 and tables[1][2].count() == len(first)
    assert all(r["n_chars"] == len(r["text"]) for r in tables[1][2].collect())
    assert {r["doc_id"] for r in tables[2][2].collect()} <= first
    packed, last = tables[-1][2].collect(), {r["doc_id"]: r["text"] for r in tables[-1][1].collect()}
    if tables[-1][1].count() == len(last):
        check_pieces(packed, last)
    assert {r["doc_id"] for r in packed} == set(last)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - {"op7_language_id"}))
def test_queries_have_the_contract_columns(spark, name):
    wanted = {
        "op1": "query_id rank vec_id score", "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4": "doc_id start n_tokens ids_crc32", "op5": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op10": "doc_id fingerprint component_id",
    }
    df = Q.queries()[name](spark, DATA)
    assert set(wanted.get(name.split("_")[0], "").split()) <= set(df.columns)
    assert df.count() > 0


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, f in Q.queries().items():
        assert f(spark, str(tmp_path)).count() == (1 if name.startswith("op5") else 0), name
