"""Quality by compression: a text is like the texts whose dictionary compresses it better.

One zstandard dictionary is trained on pieces of good texts, one on pieces of bad texts. A text's score comes from the difference of
its two compressed sizes, divided by its length, set against its size without a dictionary; labels calibrate it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import encoded
from tablewright.llm.labelled import MOST_ROWS, Logistic, labelled_sample, labelled_texts, logistic


@dataclass(frozen=True)
class QualitySettings:
    """most_rows bounds the labelled rows learned from, most_pieces the pieces of text behind each dictionary."""

    most_rows: int = MOST_ROWS
    most_pieces: int = 3000
    piece_bytes: int = 2000
    dictionary_bytes: int = 32 << 10
    level: int = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    level: int
    calibration: Logistic


def _features(texts: list[bytes], good: bytes, bad: bytes, level: int) -> np.ndarray:
    plain = zstandard.ZstdCompressor(level=level, write_content_size=False)

    def with_dictionary(data: bytes) -> zstandard.ZstdCompressor:
        if not data:
            return plain
        found = zstandard.ZstdCompressionDict(data)
        return zstandard.ZstdCompressor(level=level, dict_data=found, write_content_size=False, write_dict_id=False, write_checksum=False)

    by_good, by_bad = with_dictionary(good), with_dictionary(bad)
    sizes = np.array([(len(t) + 1, len(by_good.compress(t)), len(by_bad.compress(t)), len(plain.compress(t))) for t in texts], np.float64).reshape(-1, 4)
    length, g, b, p = sizes.T
    rate, size = np.log(p / length), np.log(length)
    return np.column_stack(((g - b) / length, (g - b) / np.maximum(g, b), rate, size, rate**2, rate * size))


def _dictionary(pieces: list[bytes], settings: QualitySettings) -> bytes:
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-settings.dictionary_bytes :]


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    settings: QualitySettings = QualitySettings(),
    label: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> QualityModel:
    """Learn from labelled documents whose label row fulfils `train`.

    Without labels, or with labels of one kind, every text gets the same score (0.5, or the share of that kind).
    """
    sample = labelled_texts(docs, labelled_sample(labels, label, train, settings.most_rows, id_column), id_column, text_column)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, kind in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                data = encoded(text)
                rows += [(doc, i, kind, data[at : at + settings.piece_bytes]) for i, at in enumerate(range(0, len(data), settings.piece_bytes))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "label", "data"])

    pieces = sample.mapInPandas(cut, "doc_id long, piece int, label int, data binary").withColumn("place", F.xxhash64("doc_id", "piece"))
    numbers = {r["label"]: r["count"] for r in pieces.groupBy("label").count().collect()}

    def chosen(kind: int) -> list[bytes]:
        # A little more than the pieces wanted, by their hashes, so that no task sends many that are not needed.
        share = int(1.2 * settings.most_pieces / max(1, numbers.get(kind, 0)) * 1_000_000) + 1000
        near = pieces.where((F.col("label") == kind) & (F.pmod("place", F.lit(1_000_000)) < share))
        return [bytes(r["data"]) for r in near.orderBy(F.pmod("place", F.lit(1_000_000)), "doc_id", "piece").limit(settings.most_pieces).collect()]

    found = {kind: chosen(kind) for kind in (0, 1)}
    good, bad = _dictionary(found[1], settings), _dictionary(found[0], settings)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _features([encoded(t) for t in batch["text"]], good, bad, settings.level)
            yield pd.DataFrame({"x": list(x), "label": batch["label"].to_numpy()})

    rows = sample.mapInPandas(measure, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), 6)
    order = np.lexsort(x.T)  # the sum of a sample must not depend on the order of its rows
    return QualityModel(good, bad, settings.level, logistic(x[order], np.array([r["label"] for r in rows], np.float64)[order]))


def score_quality(docs: DataFrame, model: QualityModel, text_column: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of docs and the column `name`, 0 to 1, which takes the place of a column of that name.

    A NULL text counts as empty; empty texts get the score of a text of no bytes. Equal texts get equal scores.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 1000):
            part = [encoded(t) for t in texts.iloc[at : at + 1000]]
            out[at : at + 1000] = model.calibration(_features(part, model.good, model.bad, model.level))
        return pd.Series(out)

    return docs.withColumn(name, score(F.col(f"`{text_column}`").cast("string")))
