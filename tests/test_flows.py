import os

from leafmill.operators.hygiene import page_findings, scan_metadata
from leafmill.operators.redact import redact_find
from leafmill.plans.flows import clean_metadata_dataset, redact_dataset, repair_dataset, sanitize_dataset
from leafmill.sources import tables


def test_pages_flows(spark, small, tmp_path):
    src = f"{small}/pages.parquet"
    before = spark.read.parquet(src)
    for flow, rescan in ((sanitize_dataset, page_findings), (clean_metadata_dataset, scan_metadata)):
        out = str(tmp_path / flow.__name__)
        assert flow(spark, src, out).count() > 0
        after = spark.read.parquet(out)
        assert after.columns == before.columns and after.count() == before.count()
        assert rescan(after).isEmpty()
        again = str(tmp_path / f"{flow.__name__}-again")
        assert flow(spark, out, again).count() == 0 and not os.path.exists(again)


def test_redact_flow(spark, small, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    tables.doc_pages(spark, small).write.parquet(src)
    assert redact_dataset(spark, src, out, "the, from").count() > 0
    assert redact_find(spark.read.parquet(out), "the, from").isEmpty()
    nothing = str(tmp_path / "nothing")
    assert redact_dataset(spark, src, nothing, "no such term").count() == 0
    assert not os.path.exists(nothing)


def test_repair_flow(spark, small, tmp_path):
    out = str(tmp_path / "out")
    codes = {r["code"]: r["pages"] for r in repair_dataset(spark, f"{small}/pages.parquet", out).collect()}
    assert 2 not in codes and sum(codes.values()) == spark.read.parquet(out).count()
    clean, again = str(tmp_path / "clean"), str(tmp_path / "again")
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id bigint, url string, html string").write.parquet(clean)
    assert [tuple(r) for r in repair_dataset(spark, clean, again).collect()] == [(0, 1)]
    assert not os.path.exists(again)


def test_flows_keep_every_column(spark, tmp_path):
    """Also columns that are called like what the operators add."""
    src = str(tmp_path / "pages")
    rows = [(1, "u", "<html><p onclick='x()'>a</p><title>t</title>", "kept", 5, "c"), (2, None, "<p>b</p>", None, None, "d")]
    spark.createDataFrame(rows, "page_id long, url string, html string, changed string, code_before int, _clean string").write.parquet(src)
    before = spark.read.parquet(src)
    for flow in (sanitize_dataset, clean_metadata_dataset, repair_dataset):
        out = str(tmp_path / f"{flow.__name__}-wide")
        flow(spark, src, out)
        after = spark.read.parquet(out)
        assert after.columns == before.columns
        assert sorted(map(str, after.drop("html").collect())) == sorted(map(str, before.drop("html").collect()))
    docs, out = str(tmp_path / "docs"), str(tmp_path / "redacted")
    spark.createDataFrame([(1, 1, "see the end", 9, True), (2, 1, "none", 8, None)], "doc_id long, page_no int, text string, n int, redacted boolean").write.parquet(docs)
    redact_dataset(spark, docs, out, "the")
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, 1, "see ███ end", 9, True), (2, 1, "none", 8, None)}
