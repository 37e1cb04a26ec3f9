from datetime import datetime

import pytest

from tablewright import OperationError, apply_edits, combine_sheets, lookup, merge, set_cells, sort, visible
from tablewright.operators.merging import side_by_side


@pytest.fixture
def orders(table):
    return table("Depot long, Crates long", [(2, 14), (88, 25), (1, 36), (None, 47)])


@pytest.fixture
def people(table):
    return table("ID long, Name string", [(1, "Quay"), (2, "Mill"), (3, None)])


def test_lookup(orders, people, rows):
    out = lookup(orders, people, "Depot", "ID", "Name")
    assert rows(out) == [(2, 14, "Mill"), (88, 25, "Not found"), (1, 36, "Quay"), (None, 47, "Not found")]
    assert rows(lookup(orders, people, "Depot", "ID", "Name", "Who", not_found=None), "Who") == ["Mill", None, "Quay", None]
    assert visible(lookup(orders, people, "Depot", "ID", "Name", "Crates")).columns == ["Depot", "Crates"]


def test_lookup_takes_the_first_match(table, rows):
    source = table("ID long, Name string", [(1, "alpha"), (1, "beta"), (2, "gamma")])
    df = table("k long", [1, 2])
    assert rows(lookup(df, source, "k", "ID", "Name"), "Name") == ["alpha", "gamma"]
    assert rows(lookup(df, sort(source, ["Name"], ["desc"]), "k", "ID", "Name"), "Name") == ["beta", "gamma"]
    cased = table("ID string, Name string", [("A", "one"), ("a", "two")])
    assert rows(lookup(table("k string", ["a ", "A"]), cased, "k", "ID", "Name"), "Name") == ["one", "one"]


def test_lookup_keys_match_by_meaning(table, rows):
    numbers = table("ID long, v string", [(731, "x"), (904, "y")])
    assert rows(lookup(table("k string", ["731", " 904 ", "7"]), numbers, "k", "ID", "v"), "v") == ["x", "y", "Not found"]
    assert rows(lookup(table("k double", [731.0, 1.5]), numbers, "k", "ID", "v"), "v") == ["x", "Not found"]
    mails = table("ID string, v long", [("Pier 4", 1), ("dock b", None)])
    assert rows(lookup(table("k string", ["PIER 4", " Dock B "]), mails, "k", "ID", "v"), "v") == ["1", "Not found"]


def test_fractional_keys_match_their_plain_digits(table, rows):
    source = table("ID string, v string", [("12345678.5", "a"), ("0.0001", "b"), ("100000000000000000000", "c")])
    assert rows(lookup(table("k double", [12345678.5, 0.0001, 1e20, 7.0]), source, "k", "ID", "v"), "v") == ["a", "b", "c", "Not found"]


def test_blank_keys_never_match(table, rows):
    source = table("ID string, v string", [(None, "null"), ("  ", "blank"), ("", "empty")])
    assert rows(lookup(table("k string", [None, " ", ""]), source, "k", "ID", "v"), "v") == ["Not found"] * 3
    empty = table("ID string, v string", [])
    assert rows(lookup(table("k string", ["a"]), empty, "k", "ID", "v"), "v") == ["Not found"]


def test_lookup_by_salted_shuffle(spark, rows, tmp_path):
    """One key has a third of the rows, another third has no key; the join must agree with the broadcast."""
    path = str(tmp_path / "left")
    key = "case when id % 3 = 0 then ' HOT ' when id % 3 = 1 then null else concat('k', id % 40) end"
    spark.range(3000).selectExpr("id", f"{key} as k").write.parquet(path)
    df = spark.read.parquet(path)
    source = spark.range(60).selectExpr("if(id < 20, 'hot', concat('K', id % 35)) as ID", "id as v")
    small = lookup(df, source, "k", "ID", "v")
    large = lookup(df, source, "k", "ID", "v", broadcast_bytes=0, hot_rows=20)
    assert "__tw_salt" in large._jdf.queryExecution().toString()
    assert sorted(rows(small)) == sorted(rows(large))
    assert len(rows(large)) == 3000


def test_small_sources_are_broadcast_and_the_table_stays_put(orders, people):
    plan = lookup(orders, people, "Depot", "ID", "Name")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lookup_refusals(orders, people):
    for args, word in [(("Nope", "ID", "Name"), "Nope"), (("Depot", "Nope", "Name"), "Nope"), (("Depot", "ID", None), "lookup")]:
        with pytest.raises(OperationError, match=word):
            lookup(orders, people, *args)


def test_stack(table, rows):
    north, south = table("Depot long, Crates long", [(1, 6), (2, 9)]), table("Depot long, Crates long", [(2, 3), (3, 8)])
    out = merge({"north": north, "south": south, "other": table("x long", [1])}, ["north", "south"])
    assert rows(out) == [(1, 6), (2, 9), (2, 3), (3, 8)]
    assert rows(merge({"south": sort(south, ["Depot"], ["desc"]), "north": north})) == [(3, 8), (2, 3), (1, 6), (2, 9)]


def test_synonyms(table, rows):
    tables = {"a": table("Depot_ID long, Crates long", [(4, 61)]), "b": table("site_id long, Crates long", [(5, 72)]),
              "c": table("place_no long, Crates long", [(6, 83)])}
    groups = [{"name": "Depot_ID", "aliases": ["site_id", "place_no"]}]
    out = merge(tables, column_groups=groups)
    assert visible(out).columns == ["Depot_ID", "Crates"] and rows(out) == [(4, 61), (5, 72), (6, 83)]
    spelled = {"a": table("site_id long, n long", [(1, 1)]), "b": table("`depot id` long, n long", [(2, 2)])}
    assert visible(merge(spelled, column_groups=groups)).columns == ["Depot_ID", "n"]


def test_spelling_variants(table, rows):
    tables = {"p": table("`Depot ID` long, Crates long", [(4, 61)]), "q": table("depot_id long, crates long", [(5, 72)])}
    out = merge(tables)
    assert visible(out).columns == ["Depot ID", "Crates"] and rows(out) == [(4, 61), (5, 72)]
    with pytest.raises(OperationError, match="several columns"):
        merge({"p": table("`a b` long, a_b long", [(1, 2)]), "q": table("ab long", [1])})


def test_columns_of_one_table_and_type_conflicts(table, rows):
    x = table("Name string, Amount long, n int, d timestamp_ntz", [("Quay", 10, 1, datetime(2025, 1, 1))])
    y = table("City string, Amount string, n double, d date", [("Lund", "ten", 2.5, datetime(2025, 2, 1).date())])
    out = merge({"x": x, "y": y})
    assert visible(out).columns == ["Name", "Amount", "n", "d", "City"]
    assert rows(out) == [("Quay", "10", 1.0, datetime(2025, 1, 1), None), (None, "ten", 2.5, datetime(2025, 2, 1), "Lund")]


def test_side_by_side(table, rows):
    names = table("Name string, `Seat No.` long", [("A", 5), ("B", 6), ("C", 9)])
    items = table("crate long, Tins long", [(310, 4), (311, 7)])
    out = merge({"n": names, "i": items})
    assert rows(out) == [("A", 5, 310, 4), ("B", 6, 311, 7), ("C", 9, None, None)]
    third = merge({"n": names, "i": items, "z": table("z long", [7, 8, 9, 10])})
    assert rows(third, "Name", "Tins", "z") == [("A", 4, 7), ("B", 7, 8), ("C", None, 9), (None, None, 10)]


def test_side_by_side_over_many_blocks(spark, rows, tmp_path):
    paths = []
    for name, count in (("a", 300), ("b", 200)):
        paths.append(str(tmp_path / name))
        spark.range(count).repartitionByRange(5, "id").sortWithinPartitions("id").selectExpr(f"id as {name}").write.parquet(paths[-1])
    out = side_by_side([spark.read.parquet(p) for p in paths], bits=4)
    assert rows(out) == [(i, i if i < 200 else None) for i in range(300)]


def test_merge_refusals(table):
    tables = {"a": table("x long", [1])}
    for names, word in [(["a", "nope"], "nope"), (["a"], "two")]:
        with pytest.raises(OperationError, match=word):
            merge(tables, names)
        with pytest.raises(OperationError, match=word):
            combine_sheets(tables, names)


def test_combined_sheets(table):
    a = table("x long", [1])
    assert list(combine_sheets({"pier/dock": a, "pier:dock": a, "x" * 40: a})) == ["pier dock", "pier dock 2", "x" * 28]
    many = combine_sheets({"y" * 40 + str(i): a for i in range(120)})
    assert len(many) == 120 and all(len(label) <= 31 for label in many)


@pytest.fixture
def grid(table):
    return table(
        "Name string, Qty long, Price double, Date timestamp_ntz, ok boolean",
        [("Quay", 4, 12.25, datetime(2031, 5, 3), True), ("Mill", 6, 80.0, datetime(2031, 6, 7), False), ("Yard", 9, 31.0, datetime(2031, 7, 9), True)],
    )


def test_set_cells(grid, rows):
    def edited(*edits, **options):
        return rows(set_cells(grid, [dict(zip(("row", "column", "value"), e)) for e in edits], **options))

    assert edited(
        (0, "Name", "Quay W"), (1, "Qty", "7"), (2, "Price", 75.25), (0, "Date", "15 Aug 2031"), (1, "ok", "TRUE"),
        (1, "Name", "one"), (1, "Name", "two"), (2, "Name", " "), (2, "Qty", None), (2, "Date", "1/1/2025"), (2, "Date", ""),
    ) == [
        ("Quay W", 4, 12.25, datetime(2031, 8, 15), True),
        ("two", 7, 80.0, datetime(2031, 6, 7), True),
        (None, None, 75.25, None, True),
    ]
    assert [r[1] for r in edited((1, "Qty", "7.5"))] == [4.0, 7.5, 9.0]
    assert [r[1] for r in edited((1, "Qty", "many"))] == ["4", "many", "9"]
    assert edited((99, "Name", "Z"), (-1, "Name", "Z"), (True, "Name", "Z"), ("1", "Name", "Z")) == rows(grid)
    for edits, word in [([], "no cell edits"), ("x", "no cell edits"), ([{"row": 0, "column": "Nope", "value": 1}], "Nope")]:
        with pytest.raises(OperationError, match=word):
            set_cells(grid, edits)


def test_edits_follow_the_order(table, rows):
    df = sort(table("n long, t string", [(1, "a"), (3, "c"), (2, "b")]), ["n"], ["desc"])
    assert rows(set_cells(df, [{"row": 0, "column": "t", "value": "X"}])) == [(3, "X"), (2, "b"), (1, "a")]


def test_edits_over_many_blocks(spark, rows, tmp_path):
    path = str(tmp_path / "e")
    spark.range(500).repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(path)
    df = spark.read.parquet(path).where("id % 2 = 1")
    edits = [{"row": r, "column": "id", "value": str(-r)} for r in (0, 1, 77, 200, 249, 250)]
    found = rows(set_cells(df, edits, bits=3))
    assert found == [-i if i in (0, 1, 77, 200, 249) else 2 * i + 1 for i in range(250)]


def test_edits_by_key(table, spark, rows):
    df = table("id long, t string, n string", [(1, "a", "1"), (2, "b", "2")])
    edits = spark.createDataFrame(
        [(1, "t", "x", 0), (1, "t", "y", 1), (2, "n", "7.0", 2), (9, "t", "z", 3)], "id long, column string, value string, seq long")
    assert rows(apply_edits(df, edits, ["id"])) == [(1, "y", "1"), (2, "b", "7")]


def test_sorted_tables_are_stacked_without_a_write(spark, rows, tmp_path, monkeypatch):
    from tablewright import aggregate_by, read_table
    from tablewright.operators import roworder

    spark.range(50).selectExpr("id as n", "id % 7 as k").write.parquet(str(tmp_path / "a.parquet"))
    monkeypatch.setattr(roworder, "scratch_path", lambda spark: pytest.fail("nothing is to be written"))
    a = read_table(spark, str(tmp_path / "a.parquet"))
    groups = aggregate_by(a, "count", None, group_by=["k"])
    stacked = merge({"down": sort(a, ["k", "n"], ["desc", "asc"]), "plain": a, "up": sort(a, ["k"])})
    plain = [(n, n % 7) for n in range(50)]
    want = sorted(plain, key=lambda r: (-r[1], r[0])) + plain + sorted(plain, key=lambda r: (r[1], r[0]))
    assert rows(stacked, "n", "k") == want
    from tablewright import limit

    assert rows(limit(sort(stacked, ["k"]), 5), "n", "k") == sorted(want, key=lambda r: r[1])[:5]
    both = merge({"groups": groups, "down": sort(a, ["n"], ["desc"])})
    assert rows(both, "k") == [*range(7), *[n % 7 for n in reversed(range(50))]]


def test_no_filter_spells_the_keys_of_a_large_lookup(spark):
    left = spark.createDataFrame([(1.5,), (2.0,), (None,), (float("nan"),), (3.0,)], "x double")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    found = lookup(left, right, "x", "k", "v", broadcast_bytes=0)
    assert sorted((str(r["x"]), r["v"]) for r in found.collect()) == [("1.5", "Not found"), ("2.0", "b"), ("3.0", "Not found"), ("None", "Not found"), ("nan", "Not found")]
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    # Only the two counts of hot keys do, not the rows that are joined and not those without a key.
    assert sum("transform(" in line for line in filters) <= 2
