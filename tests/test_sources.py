import json
from datetime import datetime

import pytest

from tablewright import (
    OperationError,
    filter_rows,
    inspect,
    inspect_tables,
    limit,
    preview,
    profile,
    read_folder,
    read_table,
    read_tables,
    result_path,
    sort,
    visible,
    write_table,
    write_tables,
)


@pytest.fixture
def csv(tmp_path):
    def write(text, name="t.csv"):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def test_types(spark, csv, rows):
    df = read_table(spark, csv("n,when,i,b,t,z\n1.5,2021-01-01,007,True,1,9\n2,2021-01-02,2,false,two,99999999999999999999\nNA,,,,3,1\n"))
    assert dict(visible(df).dtypes) == {"n": "double", "when": "string", "i": "bigint", "b": "boolean", "t": "string", "z": "string"}
    assert rows(df)[0] == (1.5, "2021-01-01", 7, True, "1", "9")
    assert rows(df)[2] == (None, None, None, None, "3", "1")
    found = {r["column"]: r["type"] for r in profile(df).collect()}
    assert found == {"n": "number", "when": "date", "i": "integer", "b": "boolean", "t": "text", "z": "number"}


def test_missing_tokens(spark, csv, rows):
    df = read_table(spark, csv('v,w\nNA,a\nN/A,b\n"",c\nnull,d\n<NA>,e\nnone,f\n  ,g\n'))
    assert rows(df, "v") == [None, None, None, None, None, "none", "  "]


def test_headers(spark, csv, rows):
    assert visible(read_table(spark, csv("Amount,Amount,Amount\n1,2,3\n"))).columns == ["Amount", "Amount.1", "Amount.2"]
    assert visible(read_table(spark, csv(" Name ,,Qty\nx,y,1\n"))).columns == ["Name", "Column B", "Qty"]
    hindi = read_table(spark, csv("﻿नाम,मूल्य\nराम,5\n"))
    assert visible(hindi).columns == ["नाम", "मूल्य"] and rows(hindi) == [("राम", 5)]
    phantom = read_table(spark, csv(",,product,Quantity\n,,x,1\n,,y,2\n"))
    assert visible(phantom).columns == ["product", "Quantity"]
    empty = read_table(spark, csv("A,B\n"))
    assert visible(empty).columns == ["A", "B"] and rows(empty) == []


def test_title_row(spark, csv, rows):
    text = "Competition,,\nName,Subject,Grade\nA,Maths,1\nB,Art,2\nName,Subject,Grade\n"
    df = read_table(spark, csv(text))
    assert visible(df).columns == ["Name", "Subject", "Grade"]
    assert rows(df) == [("A", "Maths", "1"), ("B", "Art", "2"), ("Name", "Subject", "Grade")]
    typed = read_table(spark, csv("Title,,\nName,Qty,\nA,1,x\nB,2,y\n", "u.csv"))
    assert dict(visible(typed).dtypes) == {"Name": "string", "Qty": "bigint", "Column C": "string"}
    kept = read_table(spark, csv("Title,,\nName,Subject,Grade\nA,Maths,1\n", "v.csv"), promote=False)
    assert visible(kept).columns == ["Title", "Column B", "Column C"]


def test_quotes_and_line_breaks(spark, csv, rows):
    assert rows(read_table(spark, csv('a,b\n"x, ""y""",1\n'))) == [('x, "y"', 1)]
    assert rows(read_table(spark, csv('a,b\n"x\ny",1\n'), multiline=True)) == [("x\ny", 1)]
    assert rows(read_table(spark, csv("a\tb\n1\t2\n", "t.tsv"))) == [(1, 2)]
    assert rows(read_table(spark, csv("a;b\n1;2\n"), separator=";")) == [(1, 2)]


def test_declared_types_and_no_inference(spark, csv):
    path = csv("a,b\n1,2\n")
    assert dict(visible(read_table(spark, path, infer=False)).dtypes) == {"a": "string", "b": "string"}
    assert dict(visible(read_table(spark, path, types={"a": "double"})).dtypes) == {"a": "double", "b": "bigint"}


def test_file_order_is_row_order(spark, csv, rows):
    path = csv("id,v\n" + "".join(f"{i},{i % 7}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = read_table(spark, path)
        assert df.rdd.getNumPartitions() > 3
        assert rows(df, "id") == list(range(20000))
        assert rows(limit(df, 2, from_end=True), "id") == [19998, 19999]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unreadable(spark, csv):
    for path, word in [("/nowhere/x.csv", "read"), ("/nowhere/x.parquet", "read"), (csv("", "e.csv"), "header"),
                       ("a.xlsx", "Workbook"), ("a.pdf", "Unsupported"), ("noending", "Unsupported")]:
        with pytest.raises(OperationError, match=word):
            read_table(spark, path)


def test_several_files(spark, csv, tmp_path):
    (tmp_path / "x").mkdir()
    first, second = csv("a\n1\n", "jan.csv"), csv("b\n1\n", "x/jan.csv")
    found = read_tables(spark, [first, second])
    assert list(found.tables) == ["jan", "jan (2)"] and found.primary == "jan"
    with pytest.raises(OperationError):
        read_tables(spark, [])
    (tmp_path / "book").mkdir()
    csv("a\n1\n", "book/one.csv"), csv("b\n1\n", "book/two.csv")
    assert list(read_folder(spark, str(tmp_path / "book")).tables) == ["book - one", "book - two"]


def test_inspect_and_preview(spark, csv, table):
    df = read_table(spark, csv("id,val\n" + "".join(f"{i},x\n" for i in range(60000)), "big.csv"))
    found = inspect(df)
    assert found.row_count == 60000 and "60,000" in found.note and found.truncated
    assert found.columns == [{"name": "id", "type": "integer"}, {"name": "val", "type": "text"}]
    assert [r["id"] for r in found.sample.collect()] == [0, 1, 2, 3, 4]
    assert [r["id"] for r in preview(df).collect()] == list(range(8))
    both = inspect_tables({"e": table("a string, b double", []), "m": table("v string", ["1", "two", "3"])})
    assert both["e"].note and both["e"].columns == [{"name": "a", "type": "text"}, {"name": "b", "type": "number"}]
    odd = inspect(table("x double, d timestamp_ntz, n long", [(float("inf"), datetime(2025, 1, 2), 1), (float("nan"), None, None)]))
    assert json.loads(json.dumps(odd.sample_rows())) == [
        {"x": None, "d": "2025-01-02 00:00:00", "n": 1}, {"x": None, "d": None, "n": None}]
    assert both["m"].columns == [{"name": "v", "type": "text"}] and both["m"].note is None


def test_preview_opens_only_the_first_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    df = read_table(spark, path, "parquet")
    for n in (3, 60, 700, 5000):
        assert [r["id"] for r in preview(df, n).collect()] == list(range(min(n, 1000)))
    assert len(preview(df, 3).inputFiles()) == 1
    assert [r["id"] for r in preview(df.where("id > 990"), 3).collect()] == [991, 992, 993]


def test_profile_counts(table):
    df = table("t string, n long, d string", [("1", 1, "Jan 3 2025"), (" ", None, "2025-01-01"), (None, 2, None)])
    assert sorted(map(tuple, profile(df).collect())) == [(0, "t", "text", 3, 2, 2), (1, "n", "integer", 3, 2, 1), (2, "d", "date", 3, 2, 1)]


def test_sinks(spark, table, tmp_path, rows):
    df = sort(table("n long, t string", [(2, ' a "q", b '), (1, None), (3, "c")]), ["n"])
    for kind in ("csv", "parquet", "orc", "json"):
        path = str(tmp_path / f"out.{kind}")
        write_table(df, path)
        back = read_table(spark, path) if kind != "csv" else read_table(spark, path, "csv")
        assert rows(back, "n", "t") == [(1, None), (2, ' a "q", b '), (3, "c")]
        assert not [c for c in spark.read.format(kind).load(path).columns if c.startswith("__tw")]
        with pytest.raises(OperationError):
            write_table(df, path)
    with pytest.raises(OperationError, match="format"):
        write_table(df, str(tmp_path / "out.doc"))
    assert result_path("/data/sales.csv") == "/data/sales_result.csv"
    assert result_path("sales", fmt="orc") == "sales_result.orc"


def test_several_tables_in_one_result(spark, table, tmp_path):
    paths = write_tables({"a/b": table("x long", [1]), "a:b": table("y long", [2])}, str(tmp_path / "all"))
    assert list(paths) == ["a b", "a b 2"]
    assert spark.read.parquet(paths["a b 2"]).collect()[0]["y"] == 2


def test_columns_are_pruned_and_filters_pushed(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(10).selectExpr("id", "id * 2 as n", "'x' as t").write.parquet(path)
    df = filter_rows(read_table(spark, path), [{"column": "n", "operator": "greater_than", "value": "4"}])
    plan = visible(df).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "t:string" not in plan and "GreaterThan(n,4)" in plan
    bare = read_table(spark, path, order=False).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in bare


def test_line_breaks_inside_quotes_are_read_by_default(spark, rows, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('k,t\n1,"one\ntwo"\n2,"say ""hi"""\n')
    (folder / "b.csv").write_text("k,t\n3,plain\n")
    found = rows(read_table(spark, str(folder)))
    assert sorted(found) == [(1, "one\ntwo"), (2, 'say "hi"'), (3, "plain")]


def test_rows_with_more_cells_than_the_header_are_refused(spark, csv):
    with pytest.raises(OperationError, match="1 rows"):
        read_table(spark, csv("a,b\n1,2\n3,4,5\n"))
    with pytest.raises(Exception, match="more cells"):
        read_table(spark, csv("a,b\n1,2\n3,4,5\n"), infer=False).collect()
    assert read_table(spark, csv("a,b\n1,2\n3\n")).count() == 2


def test_several_tables_get_their_place_together(spark, table, tmp_path):
    from tablewright import OperationError, visible, written_tables

    base = str(tmp_path / "result")
    good = {"first sheet": table("x long", [1, 2]), "second": table("y string", ["a"])}
    paths = write_tables(good, base, "csv")
    found = written_tables(spark, base)
    assert list(found) == list(paths) == ["first sheet", "second"]
    assert sorted(r[0] for r in visible(found["first sheet"]).collect()) == [1, 2]
    with pytest.raises(OperationError, match="already"):
        write_tables(good, base)
    bad = {**good, "third": table("x long", [1]).selectExpr("struct(x) as nested")}
    with pytest.raises(Exception):  # noqa: B017
        write_tables(bad, str(tmp_path / "other"), "csv")
    assert [p.name for p in tmp_path.iterdir()] == ["result"]  # no half result
    with pytest.raises(OperationError, match="no result"):
        written_tables(spark, str(tmp_path / "other"))


@pytest.mark.parametrize("split_bytes", [40, 200, 10**6])
def test_rows_over_line_ends_are_read_in_parallel(spark, rows, tmp_path, split_bytes):
    """Splits of a few bytes: rows begin and end anywhere, some run over several splits."""
    import csv
    import io
    import random

    r = random.Random(split_bytes)
    cells = ["plain", 'in "the" middle', '5" pipe', "two\nlines", 'a "quoted"\nline, with comma', "\n\n", "", "x" * 90, "a\r\nb", 'end"\n"', "é\nü", " lead", ",", '"']
    table = [[str(i), r.choice(cells), r.choice(cells)] for i in range(120)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["n", "one\nname", "other"], *table])
    text = out.getvalue()
    # Inch marks as people write them, which open nothing.
    text += '200,5" pipe,7"\n201,a"b"c,"it""s"\n'
    want = [(int(a), b or None, c or None) for a, b, c in table] + [(200, '5" pipe', '7"'), (201, 'a"b"c', 'it"s')]
    (tmp_path / "t.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = rows(read_table(spark, str(tmp_path / "t.csv"), infer=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_inch_marks_open_no_quotes(spark, tmp_path):
    from tablewright.sources.records import files_with_open_lines

    (tmp_path / "t.csv").write_text('n,size\n1,5" pipe\n2,"7"" pipe"\n')
    assert files_with_open_lines(spark, str(tmp_path / "t.csv"), ",") == set()


def test_cells_that_a_declared_type_does_not_fit_are_not_lost(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\nz,y\n,w\n")
    path = str(tmp_path / "t.csv")
    with pytest.raises(Exception, match="Column 'a' was declared int and holds z"):
        rows(read_table(spark, path, types={"a": "int"}))
    assert rows(read_table(spark, path, types={"a": "int"}, misfits="null")) == [(1, "x"), (None, "y"), (None, "w")]
    assert rows(read_table(spark, path, types={"b": "string"})) == [("1", "x"), ("z", "y"), (None, "w")]


def test_only_parts_of_rows_over_a_split_s_end_leave_their_task():
    import pyarrow as pa

    from tablewright.sources.records import _joined

    # a row of one line, a row of two, and one that goes on in the next split; before them the end of a row of an earlier split
    names = ["file", "split", "value", "opens", "stays", "start", "from_split", "from_seq"]
    lines = [('end"', 1, 0), ("1,x", 0, 1), ('2,"a', 1, 0), ('b"', 1, 0), ('3,"c', 1, 0)]
    batch = pa.table([pa.array([v] * 5 if not isinstance(v, list) else v) for v in ("f", 64, *map(list, zip(*lines, strict=True)), 1, 0, 7)], names).to_batches()[0]
    batch = batch.set_column(3, "opens", batch.column("opens").cast("int32"))
    batch = batch.set_column(4, "stays", batch.column("stays").cast("int32"))
    got = [(r["split"], r["seq"], r["whole"], r["value"]) for b in _joined(iter([batch])) for r in b.to_pylist()]
    assert got == [(0, 7, False, 'end"'), (64, 1, True, "1,x"), (64, 2, True, '2,"a\nb"'), (64, 4, False, '3,"c')]
