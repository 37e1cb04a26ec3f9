import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402



@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # The default case-insensitive session: operators must not depend on the settings of build_session.
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a small table in creation order: ``table("a string, b long", [("x", 1)])``."""
    from tablewright import with_row_order

    def build(schema, rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        return with_row_order(spark.createDataFrame(rows, schema).coalesce(1))

    return build


@pytest.fixture(scope="session")
def rows():
    """The visible rows of a table, in its order, as plain tuples (or values, for one column)."""
    from tablewright import ordered, visible

    def read(df, *columns):
        out = visible(ordered(df))
        if columns:
            out = out.select(*[f"`{c}`" for c in columns])
        found = [tuple(r) for r in out.collect()]
        return [r[0] for r in found] if len(out.columns) == 1 else found

    return read
