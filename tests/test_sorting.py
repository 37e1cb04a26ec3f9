import pytest

from tablewright import OperationError, limit, ordered, rename_columns, sort, with_positions, with_row_order
from tablewright.operators import sorting
from tablewright.operators.roworder import rows_at


def test_by_meaning(table, rows):
    assert rows(sort(table("n string", ["40", "7", "5"]), ["n"])) == ["5", "7", "40"]
    assert rows(sort(table("t string", ["pine", "Alder", "yew"]), ["t"])) == ["Alder", "pine", "yew"]
    dates = ["13-Jul-2031", "2031-07-11", "2031/07/14", "07/09/2031", "Jul 12 2031"]
    expected = ["07/09/2031", "2031-07-11", "Jul 12 2031", "13-Jul-2031", "2031/07/14"]
    assert rows(sort(table("d string", dates), ["d"])) == expected


def test_one_bad_cell_makes_a_column_text(table, rows):
    assert rows(sort(table("n string", ["40", "7", " "]), ["n"])) == [" ", "40", "7"]


def test_several_keys(table, rows):
    df = table("Deck string, Seat long", [("T", 4), ("B", 9), ("B", 31), ("T", 16)])
    assert rows(sort(df, ["Deck", "Seat"], ["asc", "desc"])) == [("B", 31), ("B", 9), ("T", 16), ("T", 4)]
    assert rows(sort(df, ["Deck", "Seat"], ["desc"])) == [("T", 4), ("T", 16), ("B", 9), ("B", 31)]


def test_missing_last_both_ways(table, rows):
    df = table("n long", [None, 8, 5, None, 6])
    assert rows(sort(df, ["n"])) == [5, 6, 8, None, None]
    assert rows(sort(df, ["n"], ["desc"])) == [8, 6, 5, None, None]
    assert rows(sort(table("t string", [None, "v", "w"]), ["t"], ["desc"])) == ["w", "v", None]
    assert rows(sort(table("x double", [float("nan"), 1.0, 2.0]), ["x"], ["desc"]))[:2] == [2.0, 1.0]


def test_stable_and_consecutive(table, rows):
    df = table("k long, id string", [(1, "c"), (1, "a"), (0, "b")])
    assert rows(sort(df, ["k"]), "id") == ["b", "c", "a"]
    twice = sort(sort(df, ["id"], ["desc"]), ["k"])
    assert rows(twice, "id") == ["b", "c", "a"]
    again = sort(sort(twice, ["id"]), ["k"], ["desc"])
    assert rows(again, "id") == ["a", "c", "b"]


def test_sort_survives_renaming(table, rows):
    df = sort(table("n long", [2, 1, 3]), ["n"], ["desc"])
    assert rows(rename_columns(df, ["n"], ["m"]), "m") == [3, 2, 1]


def test_limit(table, rows, monkeypatch):
    df = table("n long", [5, 3, 9, 1, 7])
    for direct, top_k in ((100, 1000), (0, 1000), (0, 0)):  # plain top-k, top-k by groups, and row positions
        monkeypatch.setattr(sorting, "TOP_K_DIRECT", direct)
        monkeypatch.setattr(sorting, "TOP_K_ROWS", top_k)
        assert rows(limit(df, 2)) == [5, 3]
        assert rows(limit(df, "2", from_end=True)) == [1, 7]
        assert rows(limit(sort(df, ["n"], ["desc"]), 2)) == [9, 7]
        assert rows(limit(sort(df, ["n"]), 2, from_end=True)) == [7, 9]
        assert rows(limit(df, 50)) == [5, 3, 9, 1, 7]
        assert rows(limit(limit(df, 4), 2, from_end=True)) == [9, 1]


@pytest.mark.parametrize("count", [0, -3, None, "many"])
def test_limit_needs_a_positive_number(table, count):
    with pytest.raises(OperationError, match="number"):
        limit(table("n long", [1]), count)


def test_sort_refusals(table):
    df = table("n long", [1])
    with pytest.raises(OperationError, match="at least one"):
        sort(df, [])
    with pytest.raises(OperationError, match="Nope"):
        sort(df, ["Nope"])


def test_order_by_columns(spark, rows):
    df = with_row_order(spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "id long, t string"), ["id"])
    assert rows(limit(df, 2), "t") == ["a", "b"]


def test_stored_order_over_many_files(spark, rows, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    df = with_row_order(spark.read.parquet(path))
    assert rows(df) == list(range(1000))
    assert rows(limit(df, 3, from_end=True)) == [997, 998, 999]
    kept = df.where("id % 3 = 0")
    placed = with_positions(kept, bits=4).orderBy("id").select("__tw_position").collect()
    assert [r[0] for r in placed] == list(range(334))


def test_rows_by_position_over_many_blocks(spark, rows, tmp_path):
    path = str(tmp_path / "blocks")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    df = with_row_order(spark.read.parquet(path)).where("id % 2 = 0")
    for count in (1, 7, 64, 333, 499, 500, 2000):
        assert rows(rows_at(df, count, bits=4)) == list(range(0, 1000, 2))[:count]
        assert rows(rows_at(df, count, from_end=True, bits=4)) == list(range(0, 1000, 2))[-count:]


def test_top_k_groups_limit_before_the_shuffle(spark):
    plan = limit(with_row_order(spark.range(10_000)), 500)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_positions_follow_a_sort(table):
    df = with_positions(sort(table("n long", [30, 10, 20]), ["n"]))
    assert sorted((r["n"], r["__tw_position"]) for r in df.collect()) == [(10, 0), (20, 1), (30, 2)]


def test_top_n_is_a_top_k(table):
    plan = limit(sort(table("n long", [1, 2]), ["n"]), 1)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_equal_values_are_spread_by_the_address(spark, tmp_path):
    path = str(tmp_path / "same")
    spark.range(4000).selectExpr("id", "1 as k").write.parquet(path)
    sizes = ordered(sort(spark.read.parquet(path), ["k"])).selectExpr("spark_partition_id() p").groupBy("p").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        counts = [r["count"] for r in sizes.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(counts) == 4 and max(counts) < 2000


def _messy_file(spark, folder, n=3000):
    from pyspark.sql import functions as F

    df = spark.range(n).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 7 != 0, F.floor(F.col("id") * 7919 % 13)).cast("int").alias("few"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("Å"), (F.col("id") * 31 % 400).cast("string"))).alias("text"),
        F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.col("id") * 7777 % 100_000 + 1_700_000_000)).alias("moment"),
        F.when(F.col("id") % 3 != 0, (F.col("id") * 17 % 1000) / 8).alias("x"),
        F.lit(1).alias("same"),
    )
    df.repartition(5, "n").write.parquet(folder)


@pytest.mark.parametrize(("columns", "orders"), [(["few", "text"], ["desc", "asc"]), (["moment"], ["asc"]), (["x", "few"], ["asc", "desc"]), (["text"], ["desc"]), (["same"], ["asc"]), ([], [])])
@pytest.mark.parametrize("from_end", [False, True])
def test_the_first_rows_are_a_filter(spark, rows, tmp_path, monkeypatch, columns, orders, from_end):
    from tablewright import read_table
    from tablewright.operators import cutting, roworder, sorting

    monkeypatch.setattr(cutting.first_rows, "__defaults__", (False, 40, 5))  # many rounds on a small table
    monkeypatch.setattr(sorting, "TOP_K_ROWS", 10)
    monkeypatch.setattr(roworder, "scratch_path", lambda spark: pytest.fail("nothing is to be written"))
    _messy_file(spark, str(tmp_path / "t.parquet"))
    df = read_table(spark, str(tmp_path / "t.parquet"))
    df = sort(df, columns, orders) if columns else df
    everything = rows(df, "n")
    for count in (11, 700, 5000):
        out = limit(df, count, from_end)
        assert out.columns == df.columns  # the order's keys stay
        assert rows(out, "n") == (everything[-count:] if from_end else everything[:count])


def test_the_first_rows_of_one_key_repeated(spark):
    from tablewright.operators.cutting import first_rows

    df = with_row_order(spark.createDataFrame([(i // 500,) for i in range(2000)], "n long"), ["n"])
    for count in (1, 499, 500, 501, 1700):
        out = first_rows(df, count, sample=30, bounds=4)
        assert sorted(r[0] for r in out.select("n").collect()) == [i // 500 for i in range(count)]
    assert first_rows(with_row_order(spark.range(5)), 2) is None


def test_the_first_rows_of_a_text_file(spark, rows, tmp_path):
    from tablewright import read_table

    path = tmp_path / "t.csv"
    path.write_text("n,t\n" + "".join(f"{i * 7 % 3001},w{i % 9}\n" for i in range(3000)))
    df = read_table(spark, str(path))
    assert rows(limit(df, 2000), "n") == [i * 7 % 3001 for i in range(2000)]
    assert rows(limit(sort(df, ["t"], ["desc"]), 1500), "n") == rows(sort(df, ["t"], ["desc"]), "n")[:1500]
