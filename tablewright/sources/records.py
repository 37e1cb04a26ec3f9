"""Rows of delimited text that run over line ends, read in parallel.

Whether a line begins inside quotes depends on all lines before it. But what a line does is simple: from outside it may end inside, from
inside it may end outside, so it leaves the state as it is, turns it, or sets it. Such steps combine: lines are combined within each
split of a file, in parallel, and only one combined step for each split is carried through the file. With the state at its start
known, every line is a row of its own or a part of one, also where a row goes on in the next split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.operators.roworder import FILE, SEQ

#: Text inside quotes, in which a doubled quote stands for one.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def _patterns(separator: str) -> dict[str, str]:
    sep = re.escape(separator)
    any_text = rf"[^{sep}]*+"
    cells = rf'(?:(?:"{_QUOTED}"{any_text}|[^"{sep}]{any_text}|){sep})*+'
    return {
        "opens": rf'^{cells}"{_QUOTED}$',  # from outside, ends inside
        "goes_on": rf"^{_QUOTED}$",  # from inside, without an end of the quotes
        "reopens": rf'^{_QUOTED}"{any_text}{sep}{cells}"{_QUOTED}$',  # from inside, ends inside again
    }


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _ends_inside(value: Column, separator: str) -> Column:
    return value.contains('"') & value.rlike(_patterns(separator)["opens"])


def files_with_open_lines(spark: SparkSession, path: str, separator: str) -> set[str]:
    """Files with a line that, read for itself, ends inside quotes; one pass in parallel. A quote in the middle of a cell is none."""
    lines = _lines(spark, path).where(_ends_inside(F.rtrim("value", F.lit("\r")), separator))
    return {r[0] for r in lines.select("file").distinct().collect()}


def _carried(sets: Column, turns: Column, over: Window) -> Column:
    """The state before each item: what the last item that sets it left, turned by those since; NULL if that depends on the start."""
    turned = F.coalesce(F.sum(turns).over(over), F.lit(0))
    at_set = F.last(F.when(sets.isNotNull(), F.col("turned_upto")), ignorenulls=True).over(over)
    last = F.last(sets, ignorenulls=True).over(over)
    return F.struct(last.alias("set"), ((turned - F.coalesce(at_set, F.lit(0))) % 2).alias("turns"))


def _resolved(state: Column, start: Column) -> Column:
    """Inside (1) or outside (0)."""
    return (F.coalesce(state["set"], start) + state["turns"]) % 2


def _states(opens: np.ndarray, stays: np.ndarray, start: int) -> np.ndarray:
    """The state after each of consecutive lines: 1 inside quotes."""
    at = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))
    turned = np.cumsum((opens == 1) & (stays == 0))
    return np.where(at >= 0, opens[at] + turned - turned[at], start + turned) % 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The lines of a task, by split; a split's lines may come in several batches, one after the other."""
    for batch in batches:
        file, split = batch.column("file").dictionary_encode(), batch.column("split").to_numpy()
        number = file.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(split) != 0)) + 1
        for at, end in pairwise([0, *cuts.tolist(), len(batch)] if len(batch) else []):
            yield (file.dictionary[int(number[at])].as_py(), int(split[at])), batch.slice(at, end - at)


_STEP = pa.schema([("file", pa.string()), ("split", pa.int64()), ("ends0", pa.int32()), ("ends1", pa.int32()), ("top0", pa.int64()), ("top1", pa.int64())])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split and each state at its start: the state at its end, and the last line that begins a row."""
    for place, runs in groupby(_runs(batches), itemgetter(0)):
        ends, tops, n = [0, 1], [None, None], 0
        for _, run in runs:
            opens, stays = (run.column(c).to_numpy() for c in ("opens", "stays"))
            for start in (0, 1):
                after = _states(opens, stays, ends[start])
                begins = np.flatnonzero(np.concatenate([[ends[start]], after[:-1]]) == 0)
                ends[start] = int(after[-1])
                tops[start] = n + int(begins[-1]) if len(begins) else tops[start]
            n += len(opens)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*place, *ends, *tops], _STEP, strict=True)], schema=_STEP)


_ROW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("seq", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("head", pa.bool_()), ("value", pa.string())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that lie within a split, and the parts of others, each with the place of its first line."""
    for (file, split), runs in groupby(_runs(batches), itemgetter(0)):
        state, n, header = None, 0, None
        own, kept = None, []  # the row that is not yet complete, and its lines so far

        def told(owns: list[tuple[int, int]], whole: list[bool], values: pa.Array, file=file, split=split) -> pa.RecordBatch:
            size = len(values)
            heads = [header is not None and p == (0, header) for p in owns]  # noqa: B023
            columns = [[file] * size, [p[0] for p in owns], [p[1] for p in owns], [split] * size, whole, heads]
            return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=False)], values], schema=_ROW)

        for _, run in runs:
            opens, stays = (run.column(c).to_numpy() for c in ("opens", "stays"))
            values = run.column("value")
            if state is None:
                state = run.column("start")[0].as_py()
                own = (run.column("from_split")[0].as_py(), run.column("from_seq")[0].as_py())
            after = _states(opens, stays, state)
            begins = np.flatnonzero(np.concatenate([[state], after[:-1]]) == 0)
            state = int(after[-1])
            first = int(begins[0]) if len(begins) else len(values)
            kept += values[:first].to_pylist()
            if len(begins):
                if split == 0 and header is None:
                    filled = (int(b) for b in begins if values[int(b)].as_py().rstrip("\r").strip(" "))
                    header = next((n + b for b in filled), None)
                if kept:
                    yield told([own], [own[0] == split], pa.array(["\n".join(kept)], pa.string()))
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), values)
                if len(lists):
                    yield told([(split, n + b) for b in begins[:-1].tolist()], [True] * len(lists), pc.binary_join(lists, "\n"))
                own, kept = (split, n + int(begins[-1])), values[int(begins[-1]) :].to_pylist()
            n += len(values)
        if kept:
            yield told([own], [own[0] == split and state == 0], pa.array(["\n".join(kept)], pa.string()))


def records(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    """(file, split, seq, head, value): the rows of the files, each with the place of its first line; blank ones are left out. `head` marks
    each file's first row.

    Lines stay in the task that reads them; only one step for each split, and the parts of rows that run over a split's end, are shuffled.
    """
    patterns = _patterns(separator)
    bare = F.rtrim(F.col("value"), F.lit("\r"))
    stays = F.when(F.col("value").contains('"'), bare.rlike(patterns["goes_on"]) | bare.rlike(patterns["reopens"])).otherwise(True)
    lines = _lines(spark, paths).select("file", "split", "value", _ends_inside(bare, separator).cast("int").alias("opens"), stays.cast("int").alias("stays"))

    # One step for each split, and with them the state at each split's start and the row that its first line may belong to.
    steps = "file string, split long, ends0 int, ends1 int, top0 long, top1 long"
    splits = lines.select("file", "split", "opens", "stays").mapInArrow(_steps, steps)
    sets, turns = F.when(F.expr("ends0 = ends1"), F.col("ends0")), F.when(F.expr("ends0 = 1 and ends1 = 0"), 1).otherwise(0)
    of_file = Window.partitionBy("file").orderBy("split")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"sets": sets, "turns": turns})
    splits = splits.withColumn("turned_upto", F.sum("turns").over(of_file.rowsBetween(Window.unboundedPreceding, 0)))
    splits = splits.withColumn("start", _resolved(_carried(F.col("sets"), F.col("turns"), before), F.lit(0)).cast("int"))
    splits = splits.withColumn("top", F.when(F.col("start") == 0, F.col("top0")).otherwise(F.col("top1")))
    above = F.last(F.when(F.col("top").isNotNull(), F.struct("split", "top")), ignorenulls=True).over(before)
    splits = splits.withColumn("above", above).select("file", "split", "start", F.col("above.split").alias("from_split"), F.col("above.top").alias("from_seq"))

    found = lines.join(F.broadcast(splits), ["file", "split"])
    found = found.mapInArrow(_joined, "file string, split long, seq long, part long, whole boolean, head boolean, value string")
    whole = found.where("whole").select("file", "split", "seq", "head", "value")
    parts = found.where("not whole").groupBy("file", "split", "seq").agg(F.bool_or("head").alias("head"), F.sort_array(F.collect_list(F.struct("part", "value"))).alias("parts"))
    rows = whole.union(parts.select("file", "split", "seq", "head", F.array_join("parts.value", "\n").alias("value")))
    return rows.withColumn("value", F.rtrim("value", F.lit("\r"))).where(F.trim("value") != "")


def read_records(spark: SparkSession, paths: list[str], root: str, names: list[str], separator: str) -> DataFrame:
    """The files' rows as text columns under the given names, without each file's first row, and with row order."""
    rows = records(spark, paths, separator).where("not head")
    options = {"sep": separator, "quote": '"', "escape": '"'}
    cells = F.from_csv("value", F.lit(", ".join(f"{n} string" for n in names)), options)
    short = F.substring_index("file", root.rstrip("/"), -1)
    place = F.concat(short, F.lit("\x01"), F.lpad(F.col("split").cast("string"), 20, "0"))
    return rows.select(cells.alias("cells"), place.alias(FILE), F.col("seq").alias(SEQ)).select("cells.*", FILE, SEQ)
