import csv
import glob
import os

import pytest

from leafmill.operators.extract import extract_links, table_rows
from leafmill.sinks import compact_dataset, export_links_txt, export_tables_csv, files, write_derived
from leafmill.sources import documents, file_inventory, pages


def lines_of(folder):
    out = []
    for path in sorted(glob.glob(f"{folder}/part-*")):
        with open(path, encoding="utf-8", newline="") as f:
            out += f.read().split("\n")[:-1]
    return out


def tables_df(spark):
    text = 'a | "b"\nc,d | e | f\ntext\n1 | 2'
    return spark.createDataFrame([(7, text), (8, "x | y")], "doc_id bigint, text string")


def test_csv_folders(spark, tmp_path):
    out = str(tmp_path / "t")
    export_tables_csv(table_rows(tables_df(spark)), out, "folders")
    found = {}
    for path in glob.glob(f"{out}/doc_id=*/name=*/part-*"):
        with open(path, encoding="utf-8", newline="") as f:
            found[path.split("/")[-3] + "/" + path.split("/")[-2]] = list(csv.reader(f))
    assert found == {
        "doc_id=7/name=table_01_page_01.csv": [["a", '"b"', ""], ["c,d", "e", "f"]],
        "doc_id=7/name=table_02_page_01.csv": [["1", "2"]],
        "doc_id=8/name=table_01_page_01.csv": [["x", "y"]],
    }


def test_csv_sorted(spark, tmp_path, many_partitions):
    out = str(tmp_path / "t")
    export_tables_csv(table_rows(tables_df(spark)), out)
    assert list(csv.reader(lines_of(out))) == [
        ["7", "1", "1", "1", "a", '"b"', ""],
        ["7", "1", "1", "2", "c,d", "e", "f"],
        ["7", "2", "1", "1", "1", "2"],
        ["8", "1", "1", "1", "x", "y"],
    ]


def test_link_report(spark, tmp_path, many_partitions):
    rows = [(i, f"http://{h}.example.com/", f'<a href="/l{i}">x</a>' * n) for i, (h, n) in enumerate([("a", 2), ("b", 1), ("a", 1), ("c", 0)])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = str(tmp_path / "l")
    export_links_txt(extract_links(df, ("internal",)), out)
    assert lines_of(out) == [
        "Source Document : a.example.com", "Total URLs Found: 3", "=" * 50, "",
        "Page 1    : http://a.example.com/l0", "Page 1    : http://a.example.com/l0",
        "Page 2    : http://a.example.com/l2",
        "Source Document : b.example.com", "Total URLs Found: 1", "=" * 50, "",
        "Page 1    : http://b.example.com/l1",
    ]
    folders = str(tmp_path / "f")
    export_links_txt(extract_links(df, ("internal",)), folders, "folders")
    assert sorted(os.path.basename(p) for p in glob.glob(f"{folders}/host=*")) == [
        "host=a.example.com", "host=b.example.com",
    ]


def test_write_derived_never_in_place(spark, small, tmp_path):
    df = documents(spark, small)
    out = str(tmp_path / "d")
    write_derived(df, f"{small}/documents.parquet", out)
    assert spark.read.parquet(out).exceptAll(df).count() == 0 == df.exceptAll(spark.read.parquet(out)).count()
    for src, target in ((out, out), (out, out + "/"), ("file:" + out, out + "/x"), (out + "/x", out)):
        with pytest.raises(ValueError):
            write_derived(df, src, target)


def test_every_spelling_of_the_input_is_refused(spark, tmp_path):
    src = tmp_path / "x"
    df = spark.range(3)
    df.write.parquet(str(src))
    (tmp_path / "link").symlink_to(src)
    spellings = [f"{tmp_path}/./x", f"file://{src}", f"{tmp_path}/y/../x", f"{tmp_path}//x/", f"{tmp_path}/link", f"{src}/inner", str(tmp_path), f"{tmp_path}/link/inner/more"]
    for out in spellings:
        with pytest.raises(ValueError):
            write_derived(df, str(src), out)
        with pytest.raises(ValueError):
            compact_dataset(spark, str(src), out)
    with pytest.raises(ValueError):
        write_derived(df, f"{tmp_path}/link", str(src))
    assert spark.read.parquet(str(src)).count() == 3


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    out, src = str(tmp_path / "out"), str(tmp_path / "src")
    spark.range(5).write.parquet(src)
    write_derived(spark.range(3), src, out)
    broken = spark.range(9).selectExpr("CASE WHEN id = 7 THEN raise_error('no') ELSE id END AS id")
    with pytest.raises(Exception, match="no"):
        write_derived(broken, src, out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    write_derived(spark.range(4), src, out)
    assert spark.read.parquet(out).count() == 4
    assert sorted(os.listdir(tmp_path)) == ["out", "src"]


def test_clustering_lets_row_groups_be_skipped(spark, tmp_path):
    """Rows scattered over the input; a filter on either column then reads a part of the row groups."""
    import pyarrow.parquet as pq

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    scattered = spark.range(40_000).selectExpr("id", "xxhash64(id) % 1000 a", "xxhash64(id, 5) % 1000 b", "CASE WHEN id % 50 > 0 THEN repeat('x', 20) END t", "'p' _other")
    scattered.repartition(8).write.parquet(src)
    spark.conf.set("parquet.block.size", str(64 * 1024))
    try:
        compact_dataset(spark, src, out, "medium", ["a", "b"])
    finally:
        spark.conf.unset("parquet.block.size")
    assert spark.read.parquet(out).exceptAll(spark.read.parquet(src)).count() == 0 and spark.read.parquet(out).count() == 40_000

    def touched(folder, column, value):
        groups = [pq.ParquetFile(f).metadata.row_group(g) for f in glob.glob(f"{folder}/part-*") for g in range(pq.ParquetFile(f).num_row_groups)]
        stats = [next(g.column(i).statistics for i in range(g.num_columns) if g.column(i).path_in_schema == column) for g in groups]
        return sum(s.min <= value <= s.max for s in stats) / len(stats)

    for column in ("a", "b"):
        assert touched(src, column, 400) == 1 and touched(out, column, 400) < 0.5


@pytest.mark.parametrize("by", [["kind"], ["kind", "size"]])
def test_clustered_files_are_of_like_size(spark, tmp_path, monkeypatch, by):
    """One value with half the rows, and one row in a hundred with nine tenths of the bytes."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    text = "array_join(transform(sequence(1, IF(id % 100 = 0, 900, 1)), i -> md5(concat(id, ' ', i))), '')"
    rows = spark.range(20_000).selectExpr("id", "IF(id % 2 = 0, 'same', concat('k', id % 40)) kind", f"{text} text").selectExpr("*", "length(text) size")
    rows.repartition(6).write.parquet(src)
    whole = sum(os.path.getsize(p) for p in glob.glob(f"{src}/part-*"))
    monkeypatch.setattr(files, "TARGET_FILE_BYTES", whole / 8)
    compact_dataset(spark, src, out, "medium", by)
    written = spark.read.parquet(out)
    assert written.exceptAll(spark.read.parquet(src)).count() == 0 and written.count() == 20_000
    sizes = sorted(r[0] for r in written.groupBy("_metadata.file_path").agg({"size": "sum"}).select("sum(size)").collect())
    assert 7 <= len(sizes) <= 8 and sizes[-1] < 1.6 * sum(sizes) / 8


def test_clustering_of_no_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(0).selectExpr("id", "'x' `a.b`", "array(id) c", "id `d``e`").write.parquet(src)
    compact_dataset(spark, src, out, "low", ["id", "c"])
    assert spark.read.parquet(out).columns == ["id", "a.b", "c", "d`e"] and spark.read.parquet(out).count() == 0


def test_clustering_by_columns_without_values(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(9).selectExpr("id", "CAST(NULL AS INT) a", "CASE WHEN id > 4 THEN 'z' END b").write.parquet(src)
    compact_dataset(spark, src, out, "low", ["a", "b"])
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, spark.read.parquet(src).collect()))


@pytest.mark.parametrize("level", ["low", "medium", "high"])
@pytest.mark.parametrize("cluster", [None, ["source"], ["source", "n_chars"]])
def test_compact(spark, small, tmp_path, level, cluster):
    src, out = f"{small}/documents.parquet", str(tmp_path / "c")
    report = compact_dataset(spark, src, out, level, cluster).first()
    written = spark.read.parquet(out)
    assert written.exceptAll(spark.read.parquet(src)).count() == 0
    assert written.count() == spark.read.parquet(src).count()
    size = sum(os.path.getsize(p) for p in glob.glob(f"{out}/part-*"))
    assert report["level"] == level and report["after_kb"] == size / 1024
    assert report["before_kb"] == os.path.getsize(src) / 1024
    assert report["saved_pct"] == (report["before_kb"] - report["after_kb"]) / report["before_kb"] * 100


def test_inventory(spark, tmp_path):
    for name, size in (("a.PDF", 3), ("b.pdf", 2048), ("c.txt", 1), ("d", 1), ("sub/e.Docx", 5)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * size)
    rows = file_inventory(spark, str(tmp_path), [".pdf", ".DOCX"]).collect()
    assert {(os.path.basename(r["path"]), r["ext"], r["length"], r["size_kb"]) for r in rows} == {
        ("a.PDF", ".pdf", 3, 3 / 1024), ("b.pdf", ".pdf", 2048, 2.0), ("e.Docx", ".docx", 5, 5 / 1024),
    }


def test_pages_reader(spark, small):
    assert pages(spark, small).columns == ["page_id", "url", "html"]
