"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from sievewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    show = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(show, r)) for r in frame[cols].astype(object).itertuples(index=False))


QUICK = ["text_inspect_hits", "text_clean", "text_confusables", "words", "sentences", "burstiness", "mattr", "phrase_markers", "marker_hits", "privacy_scan", "audit_items", "html_inspect", "html_clean", "md_inspect", "md_clean", "svg_inspect", "svg_clean", "classify_ext", "filename_for_url", "private_address", "url_policy", "sitemap_parse", "lexical_divergence", "select_candidate", "assess_rewrite", "prompt_build", "hourly_rollup"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "doc_id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_audit_rank_is_whole(spark, duck):
    got = catalog.QUERIES["audit_rank"](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(x for (x,) in duck.execute("select doc_id from documents").fetchall())
    assert list(zip(-got.weight, got.doc_id)) == sorted(zip(-got.weight, got.doc_id))
    assert rows(got) == rows(duck.execute(catalog.SQL["audit_rank"]).df())


def test_stylometry_score_equals_sql_where_a_step_begins(spark, tmp_path):
    """Sentences of 18, 11, 21, 13, 17 words vary by a quarter of their mean exactly; letters that fold, other white space, no text."""
    import duckdb

    said = lambda sizes: " ".join(" ".join(f"w{i}x{k}" for k in range(n)) + "." for i, n in enumerate(sizes))
    pad = said([40])
    texts = [said([18, 11, 21, 13, 17]), said([6, 8, 10]), None, "", f"delveſ into it. {pad}", f"It underscoreſ the need. {pad}", f"plays a Key role. {pad}", f"moreover\x0b{pad} a.\x0bb c", f"not only ſo but also highlights {pad}", f"Delve\x0binto {pad}"]
    rows_in = [(7 * i + r, t) for i, t in enumerate(texts) for r in (0, 5, 6)]
    spark.createDataFrame(rows_in, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(catalog.QUERIES["stylometry_score"](spark, str(tmp_path)).toPandas()) == rows(con.execute(catalog.SQL["stylometry_score"]).df())
