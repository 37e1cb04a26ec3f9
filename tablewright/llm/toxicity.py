"""Toxicity by a weighted lexicon.

Texts are folded (letters that look alike, accents, digits and signs that stand for letters), the lexicon's entries are found by one
Aho-Corasick automaton, hits inside exception phrases do not count, and the weight found is set against the text's length.
The entries are beginnings of words; entries, weights, exceptions and calibration are learned from labelled texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.labelled import MOST_ROWS, Logistic, labelled_sample, labelled_texts, logistic

# Letters of other scripts that look like Latin ones, and what stands for letters inside words.
_ALIKE = dict(zip("аеорсухіјѕԁһӏԛԝɡɑοαρνικυτеɩ", "aeopcyxijsdhlqwgaoapvikuteı", strict=False)) | {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_STANDS_IN = re.compile(r"[0134578@$!|](?=[^\W\d_])")
_SIGNS = "[0134578@$!|]"
_INSIDE = re.compile(rf"(?<=[^\W\d_]){_SIGNS}+(?=[^\W\d_])|(?<![\w@$!|])[0134578@$](?=[^\W\d_]{_SIGNS}*[^\W\d_])")
_GAPS = re.compile(r"[\W_]+")


def _folding() -> dict[int, str]:
    table = {ord(k): v for k, v in _ALIKE.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain and plain != chr(code):
            table.setdefault(code, plain)
    for code in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF]:
        table[code] = ""
    return table


_FOLD = _folding()


def folded(text: str) -> str:
    """Words in folded letters, with one space before each and one at the end."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _STANDS_IN.search(text):
        text = _INSIDE.sub(lambda m: "".join(_DIGITS[c] for c in m.group()), text)
    return _GAPS.sub(" ", f" {text} ")


@dataclass(frozen=True)
class ToxicitySettings:
    """most_rows bounds the labelled rows learned from, most_entries the lexicon and the exceptions."""

    most_rows: int = MOST_ROWS
    shortest: int = 3
    longest: int = 10
    most_entries: int = 5000
    evidence: float = 14.0  # least log-likelihood ratio of an entry against chance
    odds: float = 2.0  # least weight


@dataclass
class ToxicityModel:
    entries: dict[str, float]
    exceptions: list[str]
    calibration: Logistic
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "calibration": self.calibration, "automaton": None}

    def found(self) -> object:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                self.automaton.add_word(f" {entry}", (0, len(entry), weight))
            for phrase in self.exceptions:
                if phrase.strip() not in self.entries:
                    self.automaton.add_word(phrase, (1, len(phrase), 0.0))
            self.automaton.make_automaton()
        return self.automaton

    def hits(self, text: str) -> list[tuple[int, float]]:
        """(place, weight) of each word of a folded text that an entry begins, once a word, outside exception phrases."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if not len(self.found()):
            return []
        for end, (kind, length, weight) in self.found().iter(text):
            if kind:
                spared.append((end + 1 - length, end))
            else:
                start = end + 1 - length
                best[start] = max(weight, best.get(start, 0.0))
        return [(s, w) for s, w in best.items() if not any(a < s <= b for a, b in spared)]

    def features(self, text: str) -> tuple[float, float]:
        text = folded(text)
        total = sum(w for _, w in self.hits(text))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, text.count(" ") - 1)))


def _ratio(bad: int, good: int, share: float) -> float:
    """Log-likelihood ratio of `bad` among all against the share expected."""
    n = bad + good
    return (bad * np.log(bad / (n * share)) if bad else 0.0) + (good * np.log(good / (n * (1 - share))) if good else 0.0)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    settings: ToxicitySettings = ToxicitySettings(),
    label: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> ToxicityModel:
    """Learn entries, exceptions and calibration from labelled documents whose label row fulfils `train`.

    Without labels, or with labels of one kind, the lexicon is empty and every text gets the same score.
    """
    sample = labelled_texts(docs, labelled_sample(labels, label, train, settings.most_rows, id_column), id_column, text_column)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            kinds = [0, 0]
            for text, kind in zip(batch["text"], batch["label"], strict=True):
                kinds[kind] += 1
                for word in set(folded(text).split()):
                    counts.setdefault(word, [0, 0])[kind] += 1
            counts[""] = kinds  # the empty word counts documents
            yield pd.DataFrame({"word": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})

    counted = sample.mapInPandas(words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lengths = F.sequence(F.lit(settings.shortest), F.lit(settings.longest))
    entry = F.explode(F.when(F.col("word") == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(lengths, lambda n: F.substring("word", F.lit(1), n)))))
    entries = counted.select("clean", "toxic", entry.alias("entry")).where(F.length("entry") >= settings.shortest)
    entries = entries.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = sample.groupBy().agg(F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("clean"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not total["clean"] or not total["toxic"]:
        return ToxicityModel({}, [], logistic(np.zeros((total["clean"] + total["toxic"] and 1, 2)), np.array([1.0 if total["toxic"] else 0.0] * (1 if total["clean"] + total["toxic"] else 0))))
    # Shares of a document's words, as entries are counted by document and word.
    pairs = counted.where("word <> ''").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    share = (pairs["toxic"] or 0) / max(1, (pairs["toxic"] or 0) + (pairs["clean"] or 0))
    if not 0 < share < 1:
        return ToxicityModel({}, [], logistic(np.zeros((2, 2)), np.array([0.0, 1.0])))
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    odds = F.log((toxic + 0.5) / (pairs["toxic"] + 1)) - F.log((clean + 0.5) / (pairs["clean"] + 1))
    both = toxic + clean
    evidence = toxic * F.log(toxic / (both * share)) + F.when(clean > 0, clean * F.log(clean / (both * (1 - share)))).otherwise(0.0)
    chosen = entries.where("toxic > 0").select("entry", odds.alias("odds"), evidence.alias("evidence"))
    chosen = chosen.where((F.col("odds") >= settings.odds) & (F.col("evidence") >= settings.evidence))
    rows = chosen.orderBy(F.desc("evidence"), F.length("entry"), "entry").limit(settings.most_entries).collect()
    lexicon: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["entry"]), r["entry"])):
        if not any(r["entry"][:n] in lexicon and lexicon[r["entry"][:n]] >= r["odds"] for n in range(settings.shortest, len(r["entry"]))):
            lexicon[r["entry"]] = float(r["odds"])
    model = ToxicityModel(lexicon, [], logistic(np.empty((0, 2)), np.empty(0)))

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, kind in zip(batch["text"], batch["label"], strict=True):
                text = folded(text)
                for start, _ in model.hits(text):
                    stop = text.index(" ", start + 1)
                    before, after = text.rfind(" ", 0, start), text.find(" ", stop + 1)
                    counts[kind].update({text[max(before, 0) : stop + 1]} | ({text[start : after + 1]} if after > 0 else set()))
            found = sorted({*counts[0], *counts[1]})
            yield pd.DataFrame({"phrase": found, "clean": [counts[0][p] for p in found], "toxic": [counts[1][p] for p in found]}).astype({"phrase": object, "clean": np.int64, "toxic": np.int64})

    around = sample.mapInPandas(phrases, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    around = around.where("toxic = 0 and clean >= 3").orderBy(F.desc("clean"), "phrase").limit(settings.most_entries).collect()
    overall = (total["toxic"]) / (total["toxic"] + total["clean"])
    model.exceptions = [r["phrase"] for r in around if _ratio(0, r["clean"], max(overall, 0.5)) >= 2]
    model.automaton = None

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [list(model.features(t)) for t in batch["text"]], "label": batch["label"].to_numpy()})

    rows = sample.mapInPandas(measure, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, 2)
    order = np.lexsort(x.T)
    model.calibration = logistic(x[order], np.array([r["label"] for r in rows], np.float64)[order])
    model.automaton = None
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of docs and the column `name`, 0 to 1, which takes the place of a column of that name.

    A NULL text counts as empty; a text without a hit gets the calibrated score of no hit. Equal texts get equal scores.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([model.features(t if t is not None else "") for t in texts]).reshape(-1, 2)
        return pd.Series(model.calibration(x))

    return docs.withColumn(name, score(F.col(f"`{text_column}`").cast("string")))
