"""The registered corpus queries against SQL or their contracts, and the pipeline."""

import zlib

import pytest

import corpus_pipeline
import oracle
from lexiloom.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    table, key = ("pages", "page_id") if name.startswith("op5") else ("documents", "doc_id")
    given = spark.read.parquet(f"{SF}/{table}.parquet").toPandas()
    if name.startswith("op7"):
        assert set(got[key]) <= set(given[key])
    else:
        assert set(got[key]) == set(given[key])
    if not name.startswith(("op1_", "op7", "op11")):
        assert len(got) == len(given)
    if "held_out" in got:
        assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got[key], got["held_out"]))


def test_languages_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas())
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    assert 0 < len({r.doc_id for r in got}) <= docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_takes_no_rows(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
