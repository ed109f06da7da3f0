"""What Python workers hold at once, and how often a query calls on them."""

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from sievewright.operators import archives, images, style, text
from sievewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def mapped(monkeypatch):
    """The functions that a query would hand to its workers."""
    held, own = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, fn, schema, *more: (held.append(fn), own(df, fn, schema, *more))[1])
    return held


def test_texts_are_walked_few_rows_at_a_time(spark, mapped):
    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    text.decisions(docs), text.hits(docs), text.clean(docs)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([f"a​{i}" for i in range(1000)])], names=["id", "text"])
    for fn in mapped:
        out = list(fn(iter([batch])))
        assert max(b.num_rows for b in out) <= 256 and [i for b in out for i in b.column(0).to_pylist()] == list(range(1000))


def test_ratios_are_taken_few_rows_at_a_time(spark, mapped):
    style.moving_ratio(spark.createDataFrame([(0, "a")], "doc_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([["a", str(i % 2)] for i in range(1000)])], names=["id", "words"])
    out = list(mapped[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 1000


def test_files_are_read_few_rows_at_a_time(spark, mapped):
    files = spark.createDataFrame([("a", b"")], "name string, content binary")
    images.inspect_images(files, "name"), images.strip_images(files, "name"), archives.inspect_documents(files, "name"), archives.clean_documents(files, "name")
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)]), pa.array([b"x"] * 1000, pa.binary())], names=["name", "content"])
    for fn in mapped:
        out = list(fn(iter([batch])))
        assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 1000


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test tables")
def test_office_clean_cleans_each_file_once(spark, mapped):
    assert catalog.QUERIES["office_clean"](spark, SF).count() == 200 and len(mapped) == 2


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["audit_summary", "audit_rollup", "audit_items", "audit_rank", "audit_vs_labels", "audit_by_format"])
def test_audits_walk_each_text_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
