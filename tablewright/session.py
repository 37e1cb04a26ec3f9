"""A Spark session with the settings this package is made for. Any other session works as well."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession

from tablewright.errors import OperationError

# Case-sensitive names keep `Amount` and `amount` apart in files too; the others are Spark's own tools for
# plans whose partitions turn out small, large or skewed at run time.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """Build or get a session; ``settings`` are further Spark settings, with ``__`` for dots."""
    builder = SparkSession.builder.appName("tablewright")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where that is unset, a session whose executors are threads of the driver (as in tests) gets a new folder, the same for the whole
    process; on a cluster a folder of one machine would be no use.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise OperationError("Set spark.checkpoint.dir to a folder that all executors share; this step stores rows there.")
        folder = _own_folder()
    return folder.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tablewright-")
