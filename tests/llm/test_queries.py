"""The registered queries: SQL where there is one, contracts and the pipeline."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from tabsight.llm import queries as Q

SF = "/root/testdata/sf0.001"
CONTRACT = {"op1": "doc_id n_bytes n_tokens over_limit", "op2": "doc_id held_out score predicted",
            "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
            "op4": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
            "op5": "doc_id held_out lang_pred score", "op6": "conv_id turn call_id name level linked valid errors json",
            "op7": "doc_id n_shingles component_id", "op8": "doc_id keep_id group_size kept text_sha256",
            "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
            "op10": "page_id host path rule verdict",
            "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
            "op12": "doc_id n_words n_hit n_items items_sha256 contaminated",
            "op13": "doc_id leaf subroot root proof_sha256 folded_root verified"}


def test_all_registered():
    names = set(E.queries())
    assert set(Q.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in Q.QUERIES} == set(CONTRACT)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_columns_and_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert set(CONTRACT[name.split("_")[0]].split()) <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    cur = con.execute(Q.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).collect())) == sorted(
        f"Row({', '.join(f'{c}={v!r}' for c, v in zip(names, r))})" for r in cur.fetchall())


def test_pipeline_runs_and_keeps_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out.count()
        stage(spark, out, SF).write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert out.columns == docs.columns and 0.6 * before <= out.count() <= before
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == out.count()
