"""Every query over tables with odd rows and over tables without rows."""
import pytest

from .conftest import ODD_ROWS

DOCS = [1, 2, 3, 6, 8, 9, 10, 12, 13]


@pytest.mark.parametrize("n", [*DOCS, 4, 5, 7, 11])
def test_empty_tables(spark, tables, query, n):
    assert query(n)(spark, tables["empty"]).count() == 0


def test_empty_pipeline(spark, tables):
    import corpus_pipeline
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0


@pytest.mark.parametrize("n", DOCS)
def test_a_row_per_document(spark, tables, query, n):
    rows = query(n)(spark, tables["odd"]).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD_ROWS)


def test_vectors(spark, tables, query):
    rows = query(4)(spark, tables["odd"]).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == 15
    linked = {1, 2, 9, 10}  # the repeated row 10 counts twice
    for v in linked:
        assert got[v] == (4, 1, v == 1)
    for v in set(range(1, 14)) - linked:
        assert got[v] == (0, v, True)


def test_pages(spark, tables, query):
    rows = query(5)(spark, tables["odd"]).collect()
    assert len(rows) == 10
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows}
    assert (3, "response", None) in got and (1, "revisit", 3) in got and (2, "revisit", 3) in got
    assert (None, "revisit", 3) in got
    assert all(k == "response" for p, k, _ in got if p in (4, 5, 6, 7, 8))


def test_packed(spark, tables, query):
    rows = query(7)(spark, tables["odd"]).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD_ROWS}
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1  # the end id alone


def test_near_classes(spark, tables, query):
    got = {(r["doc_id"], r["class_id"]) for r in query(9)(spark, tables["odd"]).collect()}
    assert {(5, 5), (6, 5), (1, 1), (13, 13), (2, 2), (3, 2), (None, None)} <= got


def test_languages_and_quality(spark, tables, query):
    got = {r["doc_id"]: r for r in query(6)(spark, tables["odd"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 13)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    got = {r["doc_id"]: r for r in query(2)(spark, tables["odd"]).collect()}
    assert not got[1]["kept"] and not got[2]["kept"] and got[1]["score"] == 0


def test_pipeline_keeps_columns(spark, tables):
    import corpus_pipeline
    docs = spark.read.parquet(tables["odd"] + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables["odd"]).columns == docs.columns
