"""The registered queries on the small tables, and the pipeline against plain Python."""

from __future__ import annotations

import os

import pytest

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

import corpus_pipeline  # noqa: E402
from driftwood.llm import common, queries, simhash  # noqa: E402


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_chat_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op5_chat_formatting"]).df()
    got = queries.QUERIES["op5_chat_formatting"](spark, SF).toPandas()[want.columns.tolist()]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_language_is_right_on_held_out(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "lang")
    found = queries.QUERIES["op9_language_id"](spark, SF).where("held_out").join(docs, "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = common.materialise(stage(spark, docs, SF))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept <= before, name
    fps = [simhash.fingerprint(r.text.encode()) for r in docs.collect()]
    assert all((x ^ y).bit_count() > 2 for i, x in enumerate(fps) for y in fps[i + 1 :])
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == kept and packed.groupby("sequence_id").length.sum().max() <= 4096
    assert len(packed) == corpus_pipeline.run(spark, SF).count()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp string, stratum string, bin int, held string"


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, kind):
    """Each stage on an empty table, and on one with null ids and texts, repeated rows and columns of the operators' own names."""
    prose = " ".join(f"word{k} and some more of the text" for k in range(30))
    rows = [(None, None, None, None, None, *["x"] * 3, 1, "x"), (None, prose, "en", "s", 1, *["x"] * 3, 1, "x"), *[(1, prose, "en", "s", 1, *["x"] * 3, 1, "x")] * 2, (2, "", "en", "s", 0, *["x"] * 3, 1, "x"), (3, prose + " end", None, None, 9, *["x"] * 3, 1, "x")]
    docs = spark.createDataFrame(rows if kind == "odd" else [], SCHEMA)
    spark.createDataFrame([(1, 1, 0), (None, 0, None)] if kind == "odd" else [], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = common.materialise(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert (packed.count() > 0) == (docs.count() > 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
