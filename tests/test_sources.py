"""Sheets of many workbooks, and saved files read one by one."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from earshot.sources import cells as CE, files as FS


def test_rows_of_many_sheets_and_workbooks_keep_apart(spark):
    sheets = [("a.xlsx", i) for i in range(1100)] + [("b.xlsx", i) for i in range(3)]
    rows = [(b, f"s{i}", i, r, 1, v) for b, i in sheets for r, v in ((1, "ASIN"), (2, f"B{i}"))]
    grid = spark.createDataFrame(rows, CE.GRID)
    found = CE.project_rows(grid, CE.review_profile(grid), ["asin"]).select("workbook", "asin", "ord").collect()
    assert len({r.ord for r in found}) == len(found) == len(sheets)
    order = [(r.workbook, r.asin) for r in sorted(found, key=lambda r: r.ord)]
    assert order == [(b, f"B{i}") for b, i in sheets]


def test_a_number_beyond_its_bits_is_an_error(spark):
    one = spark.range(1)
    with pytest.raises(PySparkException):
        one.select(CE.ordinal(F.lit(0).cast("bigint"), F.lit(0), F.lit(1 << 30))).collect()


def test_candidates_read_the_whole_column(spark):
    rows = [("a.xlsx", "s", 0, 1, 1, "Product Title"), ("a.xlsx", "s", 0, 1, 2, "评论内容")]
    rows += [("a.xlsx", "s", 0, r, 1, "late" if r > 150 else "early") for r in range(2, 500)]
    found = CE.focus_candidates(spark.createDataFrame(rows, CE.GRID)).collect()
    assert [(r.name, r.n, r.position) for r in found] == [("late", 349, 1), ("early", 149, 2), ("s", 1, 3)]
    assert [(r.name, r.n) for r in CE.focus_candidates(spark.createDataFrame(rows, CE.GRID), rows=120).collect()] == [("early", 120), ("s", 1)]


def test_threads_are_read_by_file_name(spark, tmp_path):
    for n, text in (("01_7_x.md", "Title: One\nbody"), ("02_8_y.md", "")):
        (tmp_path / n).write_text(text)
    index = spark.createDataFrame([("raw/01_7_x.md", "u7"), ("raw/02_8_y.md", "u8")], "file string, url string")
    found = {r.url: (r.thread_id, r.markdown) for r in FS.read_threads(spark, str(tmp_path), index).collect()}
    assert found["u7"] == ("7", "Title: One\nbody")


def test_a_payload_of_one_file_is_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"asin": "B1",\n "reviews": [{"reviewId": "R1", "rating": 4}, {"reviewId": "R2"}]}')
    (tmp_path / "b.json").write_text('{"asin": "B2", "reviews": []}')
    found = FS.payload_reviews(FS.read_payloads(spark, str(tmp_path))).collect()
    assert [(r.asin, r.reviewId, r.rating) for r in found] == [("B1", "R1", 4.0), ("B1", "R2", None)]


def test_csv_rows_are_numbered_over_all_blocks_of_a_file(spark, tmp_path):
    lines = [f'{i},"a ""b"", {i}",,{"x" * (i % 50)}' for i in range(3000)]
    (tmp_path / "first book.csv").write_text("Title only\n\nid,text,none,last\n" + "\n".join(lines))
    (tmp_path / "b.csv").write_text("one\ntwo,2\n,,3\n")
    (tmp_path / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = CE.read_csv_grid(spark, str(tmp_path), columns=4)
        cells = [(r.sheet, r.row, r.col, r.value) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("b", 1, 1, "one"), ("b", 2, 1, "two"), ("b", 2, 2, "2"), ("b", 3, 3, "3"), ("first book", 1, 1, "Title only")]
    want += [("first book", 2, k, v) for k, v in enumerate(("id", "text", "none", "last"), 1)]
    for i in range(3000):
        want += [("first book", i + 3, k, v) for k, v in ((1, str(i)), (2, f'a "b", {i}'), (4, "x" * (i % 50))) if v]
    assert sorted(cells) == sorted(want)
    assert got.schema.simpleString() == spark.createDataFrame([], CE.GRID).schema.simpleString()


def test_csv_cells_with_line_breaks_and_too_wide_records(spark, tmp_path):
    (tmp_path / "m.csv").write_text('1,"two\nlines"\n2,x\n')
    assert sorted(tuple(r)[3:] for r in CE.read_csv_grid(spark, str(tmp_path), multiline=True).collect()) == [(1, 1, "1"), (1, 2, "two\nlines"), (2, 1, "2"), (2, 2, "x")]
    for multiline in (False, True):
        with pytest.raises((PySparkException, Py4JJavaError), match="out of bounds"):
            CE.read_csv_grid(spark, str(tmp_path), columns=1, multiline=multiline).collect()


def test_older_headings_become_todays(spark):
    old = spark.createDataFrame([("a", 1, "b")], ["功能/主题", "x", "主要功能/主题"])
    got = CE.current_headings(old)
    assert (got.columns, tuple(got.first())) == (["一级功能", "x"], ("b", 1))
    assert CE.current_headings(got).columns == got.columns


def test_a_table_of_one_row_group_is_spread(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from earshot.showcase import base as B

    rows = 40_000
    pq.write_table(pa.table({"doc_id": list(range(rows)), "text": [f"{i * 2654435761:x}" * 60 for i in range(rows)]}), tmp_path / "documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # splits, of which one holds all rows
    try:
        plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert plain.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in B.read(spark, str(tmp_path), "documents").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == rows and len(sizes) >= 4 and max(sizes) < rows / 2
