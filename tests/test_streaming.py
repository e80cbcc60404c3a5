from leafmill.operators import convert, hygiene, redact
from leafmill.sources import tables
from leafmill.streaming import run_incrementally


def run(spark, folder, schema, operator, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run_incrementally(spark, folder, schema, operator, out, progress, 1).awaitTermination(120)
    return spark.read.parquet(out)


def test_new_files_only_once(spark, small, tmp_path):
    docs = tables.documents(spark, small)
    inbox = str(tmp_path / "in")
    docs.repartition(3).write.parquet(inbox)
    operator = lambda d: redact.redact_apply(tables.paginate(d), "the, from")
    first = run(spark, inbox, docs.schema, operator, tmp_path)
    want = operator(docs)
    assert first.exceptAll(want).count() == 0 and first.count() == want.count()

    again = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")
    again.write.mode("append").parquet(inbox)
    both = run(spark, inbox, docs.schema, operator, tmp_path)
    assert both.count() == 2 * want.count()


def test_pages(spark, small, tmp_path):
    pages = tables.pages(spark, small)
    inbox = str(tmp_path / "in")
    pages.write.parquet(inbox)
    for i, operator in enumerate((convert.html_to_text, hygiene.strip_active_content)):
        got = run(spark, inbox, pages.schema, operator, tmp_path / str(i))
        assert got.exceptAll(operator(pages)).count() == 0 and got.count() == pages.count()
