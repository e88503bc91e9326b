"""The pipeline's stages on nulls, empties, long texts, ties and repeats."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsight.llm import wordbpe
from tests.llm.conftest import sentence

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TOK = wordbpe.load(wordbpe.read_json(public_tokenizers.path("word_bpe_49k.json")))


@pytest.fixture(scope="module")
def rows(odd_rows):
    out = [(i, t, None if i is None else "en", None, None if t is None else len(t)) for i, t in odd_rows]
    return out + [(200 + i, "\n".join(sentence(200 + i + j) + "." for j in range(4)), "en", "s", 1) for i in range(30)] + [
        (300 + i, "\n".join([f"BUY!! {i} " * 9] * 4), "en", "s", 1) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    labels = [(200 + i, 1, 0) for i in range(30)] + [(300 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_quality_stage_keeps_good_rows_whole(spark, docs, rows, sf_dir):
    out = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    kept = rows_of(out)
    assert set(kept) <= {str(r) for r in rows}
    ids = {r["doc_id"] for r in out.collect()}
    assert set(range(200, 230)) <= ids and not ids & set(range(300, 330)) and not ids & {100, 101, 102}
    assert corpus_pipeline.quality_stage(spark, docs.where("false"), sf_dir).count() == 0


def test_exact_stage_keeps_one_of_equal_texts(spark, docs, rows, sf_dir):
    out = corpus_pipeline.exact_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    groups = {}
    for r in rows:
        norm = " ".join((r[1] or "").replace("\t", " ").replace("\n", " ").split(" ")) if r[1] else ""
        while "  " in norm:
            norm = norm.replace("  ", " ")
        groups.setdefault(norm, []).append(r)
    got = out.collect()
    assert len(got) == len(groups)
    for r in got:
        own = next(g for g in groups.values() if tuple(r) in g)
        least = min((x[0] for x in own if x[0] is not None), default=None)
        assert r["doc_id"] == least
    assert corpus_pipeline.exact_stage(spark, docs.where("false"), sf_dir).count() == 0


def test_packing_stage_packs_every_row(spark, docs, rows, sf_dir):
    out = corpus_pipeline.packing_stage(spark, docs, sf_dir)
    want = sum(len(TOK.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    total = out.agg(F.sum("length"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens")))).first()
    assert tuple(total) == (want, want)
    assert corpus_pipeline.packing_stage(spark, docs.where("false"), sf_dir).count() == 0


def test_all_stages_in_a_row(spark, docs, sf_dir, tmp_path):
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = at.count()
        stage(spark, at, sf_dir).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        assert at.columns == docs.columns and at.count() <= before
    assert at.count() > 20
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
