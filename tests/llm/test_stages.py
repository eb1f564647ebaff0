"""The pipeline's stages on odd rows, repeated rows, clashing columns and an empty table."""

import pytest
from paragraphs import PARAGRAPHS
from test_edges import SCHEMA, odd_rows

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    clean = [(100 + i, PARAGRAPHS[lang], lang, "s", None, "k", None, 1, "w", 2, "dot") for i, lang in enumerate(("en", "fr", "de", "es"))]
    return spark.createDataFrame([*odd_rows(), *clean, clean[0]], SCHEMA)


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "near_dedup"])
def test_a_stage_keeps_columns_and_whole_rows(spark, docs, name):
    out = STAGES[name](spark, docs, "")
    assert out.dtypes == docs.dtypes
    rows, given = [tuple(r) for r in out.collect()], [tuple(r) for r in docs.collect()]
    other = lambda r: (r[0], *r[2:4], *r[5:])  # noqa: E731  all but text and n_chars
    assert rows and all(other(r) in set(map(other, given)) for r in rows) and len(rows) <= len(given)
    if name != "line_dedup":
        assert set(rows) <= set(given)
    clean = [r for r in rows if r[0] is not None and r[0] >= 100]
    assert {r[0] for r in clean} == {100, 101, 102, 103} and len(clean) == (4 if name == "near_dedup" else 5)


def test_packing_places_each_row(spark, docs):
    got = STAGES["packing"](spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in got if r["piece"] == 0) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert all(r["length"] <= 2048 for r in got)


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table_gives_none(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), "").count() == 0
