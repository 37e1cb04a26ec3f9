"""Quality rules with robust outliers, in DataFrame and SQL functions only.

Counts of a text are made to a vector of four transformed statistics. Per language and source a minimum-covariance-determinant estimate
(the centre and spread of the three quarters of documents that lie closest together) is found by concentration steps, and a
document whose Mahalanobis distance from it is too large is rejected. Groups of few documents are measured against all documents.

The statistics are whole numbers (thousandths), so all sums are exact and do not depend on the order of rows; the quantile
that chooses the closest documents is read from counts of distance classes, which are bounded in number. A group of
any size is only ever summed and counted, with partial sums before each shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch
from tablewright.llm.native import SPACES, grams, hashes, let, text_of, upto, words

#: Characters counted as symbols. Fixed value.
SYMBOLS = "#*$%&|<>"
#: Thousandths that the spread of each statistic has at least, so that groups without any spread reject no small deviation.
FLOORS = (40, 250, 250, 250)
_N = len(FLOORS)


@dataclass(frozen=True)
class QualityRules:
    least_words: int = 10
    most_repeated: int = 20  # hundredths of the words
    least_group: int = 200  # documents that a group needs for estimates of its own
    steps: int = 3  # concentration steps
    cut: float = 36.0  # squared Mahalanobis distance; in a four-dimensional normal distribution one in a few million is beyond


def counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long)."""
    text = F.col("__text")
    bare = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    out = docs.withColumn("__text", text_of(f"`{text_column}`"))
    out = out.withColumns({"__hashed": hashes(words(text, SPACES)), "__lines": dup_lines, "word_chars": bare.cast("long"), "n_symbols": symbols.cast("long")})
    out = out.drop("__text").withColumn("__runs", grams(F.col("__hashed"), [0, 1, 2, 3, 4]))
    return out.select(
        *[c for c in out.columns if not c.startswith("__")],
        F.size("__hashed").cast("long").alias("n_words"),
        F.col("__lines.n").cast("long").alias("n_lines"),
        F.col("__lines.dup").cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__runs")) == F.size("__runs"), 0).otherwise(_repeated("__runs")).cast("long").alias("n_repeat_words"),
    )


def _repeated(runs: str) -> Column:
    """Words in runs of five words that occur more than once."""
    pairs = F.sort_array(F.transform(F.col(runs), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p):
        last = F.size(p) - 1
        twice = F.filter(
            upto(last),
            lambda j: ((j > 0) & (F.get(p, j - 1)["h"] == F.get(p, j)["h"])) | ((j < last) & (F.get(p, j + 1)["h"] == F.get(p, j)["h"])),
        )
        return F.sort_array(F.transform(twice, lambda j: F.get(p, j)["i"]))

    def covered(at):
        return F.aggregate(upto(F.size(at) - 1), F.lit(0), lambda n, k: n + F.when(k == 0, 5).otherwise(F.least(F.lit(5), F.get(at, k) - F.get(at, k - 1))))

    return let(let(pairs, places), covered)


# The statistics and the estimate as SQL text, which Spark runs step by step.

def statistics_sql() -> list[str]:
    return [
        "cast(round(1000 * ln((word_chars + 100) / cast(n_words + 20 as double))) as bigint) as x0",
        "cast(round(1000 * ln(1 + 100 * n_symbols / cast(word_chars + 100 as double))) as bigint) as x1",
        "cast(round(1000 * ln(1 + 10 * n_dup_lines / cast(n_lines + 10 as double))) as bigint) as x2",
        "cast(round(1000 * ln(1 + 10 * n_repeat_words / cast(n_words + 20 as double))) as bigint) as x3",
    ]


def classes_sql(stats: str) -> str:
    """Counts of each statistic's values, in classes of ten thousandths."""
    parts = [f"select g, {i} as k, cast(floor(x{i} / 10.0) as bigint) as c, count(*) as n from {stats} group by g, cast(floor(x{i} / 10.0) as bigint)" for i in range(_N)]
    return " union all ".join(parts)


def start_sql(classes: str) -> str:
    """Per group the medians, with the least spreads as a first estimate."""
    medians = f"select g, k, min(c) as c from (select g, k, c, sum(n) over (partition by g, k order by c) as below, sum(n) over (partition by g, k) as total from {classes}) t where 2 * below >= total group by g, k"
    centre = ", ".join(f"cast(max(case when k = {i} then 10 * c + 5 end) as double) as m{i}" for i in range(_N))
    factor = ", ".join(f"cast({FLOORS[i] if i == j else 0} as double) as l{i}{j}" for i in range(_N) for j in range(i + 1))
    return f"select g, {centre}, {factor} from ({medians}) t group by g"


def distance_sql(stats: str, estimate: str) -> str:
    """All rows with their squared distance d from their group's estimate; l is the lower factor of the covariance."""
    inner = f"select s.*, {', '.join(f'e.m{i}' for i in range(_N))}, {', '.join(f'e.l{i}{j}' for i in range(_N) for j in range(i + 1))} from {stats} s join {estimate} e on s.g = e.g"
    for i in range(_N):
        known = " ".join(f"- l{i}{j} * z{j}" for j in range(i))
        inner = f"select *, (x{i} - m{i} {known}) / l{i}{i} as z{i} from ({inner}) t{i}"
    return f"select *, {' + '.join(f'z{i} * z{i}' for i in range(_N))} as d from ({inner}) t"


def nearest_sql(distances: str) -> str:
    """Per group the distance class within which three quarters of its rows lie."""
    counted = f"select g, cast(floor(100 * ln(1 + d)) as bigint) as c, count(*) as n from ({distances}) q group by g, cast(floor(100 * ln(1 + d)) as bigint)"
    return f"select g, min(c) as c from (select g, c, sum(n) over (partition by g order by c) as below, sum(n) over (partition by g) as total from ({counted}) t) t where 4 * below >= 3 * total group by g"


def estimate_sql(distances: str, nearest: str) -> str:
    """Per group centre and lower factor of the covariance of the rows within that class; one Cholesky step for each statistic."""
    sums = ", ".join([f"sum(x{i}) as s{i}" for i in range(_N)] + [f"sum(x{i} * x{j}) as p{i}{j}" for i in range(_N) for j in range(i + 1)])
    inner = f"select q.g, cast(count(*) as double) as n, {sums} from ({distances}) q join {nearest} h on q.g = h.g and floor(100 * ln(1 + d)) <= h.c group by q.g"
    centre = ", ".join(f"cast(s{i} as double) / n as m{i}" for i in range(_N))
    inner = f"select t.*, {centre} from ({inner}) t"
    # 1.6 makes up for the tails that three quarters leave out.
    spread = ", ".join(f"1.6 * (cast(p{i}{j} as double) / n - m{i} * m{j}) + {FLOORS[i] ** 2 if i == j else 0} as v{i}{j}" for i in range(_N) for j in range(i + 1))
    inner = f"select t.*, {spread} from ({inner}) t"
    for j in range(_N):
        square = " ".join(f"- l{j}{k} * l{j}{k}" for k in range(j))
        inner = f"select t.*, sqrt(greatest(v{j}{j} {square}, {FLOORS[j] ** 2})) as l{j}{j} from ({inner}) t"
        below = [f"(v{i}{j} {' '.join(f'- l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} as l{i}{j}" for i in range(j + 1, _N)]
        if below:
            inner = f"select t.*, {', '.join(below)} from ({inner}) t"
    return f"select g, {', '.join(f'm{i}' for i in range(_N))}, {', '.join(f'l{i}{j}' for i in range(_N) for j in range(i + 1))} from ({inner}) t"


def quality_rules(
    docs: DataFrame, rules: QualityRules = QualityRules(), text_column: str = "text", group_columns: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row for each row of docs: the columns `keep`, the counts, base_failed, distance (squared) and kept.

    A NULL text has no word and fails. NULL groups are groups of their own; a missing group column is one group.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules", docs)
    groups = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) if c in docs.columns else F.lit("") for c in group_columns]
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.concat_ws("\x01", *groups).alias("own"), F.col(f"`{text_column}`").alias("text"))
    rows = counts(chosen, "text")
    rows = rows.drop("text") if "text" in rows.columns else rows
    rows = rows.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")))
    rows = scratch.save(rows.selectExpr("*", *statistics_sql()))
    # Every row counts for all documents, and rows of groups that are large enough for their own group as well.
    sizes = scratch.save(rows.groupBy("own").agg(F.count("*").alias("size")), few=True)
    rows = scratch.save(rows.join(sizes, "own").withColumn("g", F.when(F.col("size") >= rules.least_group, F.col("own")).otherwise(F.lit("\x02"))).drop("size", "own"))
    views = [f"tw_{scratch.folder[-12:]}_{i}" for i in range(4)]
    learn = rows.select("g", "x0", "x1", "x2", "x3", "base_failed").where("not base_failed")
    pooled = learn.withColumn("g", F.lit("\x02"))
    learn.where("g <> '\x02'").union(pooled).createOrReplaceTempView(views[0])
    spark.sql(classes_sql(views[0])).createOrReplaceTempView(views[1])
    estimate = scratch.save(spark.sql(start_sql(views[1])), few=True)
    for _ in range(rules.steps):
        estimate.createOrReplaceTempView(views[2])
        near = scratch.save(spark.sql(nearest_sql(distance_sql(views[0], views[2]))), few=True)
        near.createOrReplaceTempView(views[3])
        estimate = scratch.save(spark.sql(estimate_sql(distance_sql(views[0], views[2]), views[3])), few=True)
    rows.createOrReplaceTempView(views[0])
    estimate.createOrReplaceTempView(views[2])
    # A group without any row to learn from takes no estimate; its rows have all failed already.
    measured = spark.sql(distance_sql(views[0], views[2]).replace(f" join {views[2]}", f" left join {views[2]}"))
    for view in views:
        spark.catalog.dropTempView(view)
    verdict = ~F.col("base_failed") & (F.coalesce("d", F.lit(0.0)) <= rules.cut)
    return measured.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), F.col("d").alias("distance"),
    )
