"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. For every language and source the minimum
covariance determinant estimate of mean and covariance is found, and texts whose squared
Mahalanobis distance exceeds a chi-square quantile are rejected.

The estimate runs over all rows. Three deterministic starts per group (coordinatewise medians
and deviations; correlations of tanh scores; spatial signs) are refined by concentration
steps, each of which takes the `ALPHA` share of nearest rows as found by an approximate
quantile with relative rank error 1e-4; the start with the least determinant wins and is
reweighted once. All sums are grouped aggregates with partial aggregation, so a source that
holds a third of all rows costs no single task; only tables with a row per group are joined
back, which Spark broadcasts if they are small and otherwise shuffles.

`RESOLUTION` squared is added to every covariance: a statistic that is constant in most of a
group (say, no symbols at all) has no variance of its own there, and a difference below its
resolution should not count.

Defined results: a NULL or wordless text has zero statistics and fails the base rules. A NULL
language or source is a group of its own. Sources with fewer than `MIN_ROWS` texts that pass
the base rules share an estimate with the other small sources of their language, small
languages with each other; below that nothing is rejected. Equal texts of a group get equal
verdicts. The row is carried whole, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.batches import bounded
from lendlens.llm.scratch import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_ROWS = 120
ALPHA = 0.75
STEPS = 5
#: Share of a normal group that is rejected.
REJECTED_TAIL = 1e-9
REWEIGHT = 0.975
#: Least differences that count: log words, log word length, then angles of shares of
#: symbols, repeated lines, repeated words and capitals.
RESOLUTION = (0.3, 0.04, 0.04, 0.15, 0.12, 0.05)
SIZE = len(RESOLUTION)
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
)
STATISTICS_TYPE = ", ".join(f"{name} long" for name in STATISTICS)


def measured(text: str) -> tuple[int, ...]:
    """The statistics of a text, in the order of `STATISTICS`."""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    lines, seen = 0, set()
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            seen.add(line)
    first: dict[tuple, int] = {}
    repeated = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        j = first.setdefault(window, i)
        if j != i:
            repeated[i : i + 3] = repeated[j : j + 3] = b"\1\1\1"
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        lines - len(seen),
        sum(repeated),
        lines,
        len(data) - len(data.translate(None, CAPITALS)),
    )


def _measured_all(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measured(text or "") for text in texts], columns=list(STATISTICS))


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text."""
    return F.pandas_udf(_measured_all, STATISTICS_TYPE)(text)


def base_failed(stats: Column) -> Column:
    repeats = stats["n_repeat_words"] * 100 > stats["n_words"] * MAX_REPEAT_PERCENT
    return (stats["n_words"] < MIN_WORDS) | repeats


def vector(stats: Column) -> list[Column]:
    """The transformed statistics; defined for texts that have a word."""
    words, chars = stats["n_words"], stats["word_chars"]

    def angle(part: Column, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))))

    return [
        F.log(F.greatest(words, F.lit(1)).cast("double")),
        F.log(F.greatest(chars, F.lit(1)) / F.greatest(words, F.lit(1))),
        angle(stats["n_symbols"], chars),
        angle(stats["n_dup_lines"], stats["n_lines"]),
        angle(stats["n_repeat_words"], words),
        angle(stats["n_capitals"], chars),
    ]


def chi_square_tail(x: float, degrees: int) -> float:
    """P(X > x) of a chi-square variable with an even number of degrees."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= half / (k + 1)
    return math.exp(-half) * total


def chi_square_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, degrees) > tail else (low, middle)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest `share` of normal rows right."""
    bound = chi_square_quantile(1 - share, SIZE)
    return share / (1 - chi_square_tail(bound, SIZE + 2))


def _group_keys(rows: DataFrame) -> DataFrame:
    """(of_lang, of_source, fit_key): the estimate that each language and source uses.

    A group whose pool stays small has no row.
    """
    counts = rows.groupBy("of_lang", "of_source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < MIN_ROWS, F.col("n")).otherwise(0)
    counts = counts.withColumn("small", F.sum(small).over(Window.partitionBy("of_lang")))
    level = (
        F.when(F.col("n") >= MIN_ROWS, "source")
        .when(F.col("small") >= MIN_ROWS, "lang")
        .otherwise("all")
    )
    counts = written(counts.withColumn("level", level), "counts")
    rest = counts.filter(F.col("level") == "all").agg(F.sum("n")).scalar()
    key = (
        F.when(F.col("level") == "source", F.to_json(F.struct("of_lang", "of_source")))
        .when(F.col("level") == "lang", F.to_json(F.struct("of_lang")))
        .when(rest >= MIN_ROWS, "a")
    )
    keyed = counts.select("of_lang", "of_source", key.alias("fit_key"))
    return keyed.filter(F.col("fit_key").isNotNull())


def _named(name: str) -> Column:
    """A language or source as a key: NULL is unlike every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("NULL"))


def _distance(mean: list[Column], inverse: Column, x: list[Column]) -> Column:
    """Squared Mahalanobis distance, by the inverse of the covariance's Cholesky factor."""
    total = F.lit(0.0)
    for i in range(SIZE):
        score = F.lit(0.0)
        for j in range(i + 1):
            score = score + F.get(inverse, F.lit(i * SIZE + j)) * (x[j] - mean[j])
        total = total + score * score
    return total


def _x() -> list[Column]:
    return [F.col(f"x{i}") for i in range(SIZE)]


def _mean() -> list[Column]:
    return [F.get(F.col("mean"), F.lit(i)) for i in range(SIZE)]


MODEL = "fit_key string, start int, mean array<double>, inverse array<double>, log_det double"


def _moments(rows: DataFrame, x: list[Column], *keys: str) -> DataFrame:
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(SIZE)]
    products = [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(SIZE) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _covariance(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([row[f"s{i}"] for i in range(SIZE)]) / row["n"]
    cov = np.zeros((SIZE, SIZE))
    for i in range(SIZE):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = row[f"q{i}_{j}"] / row["n"] - mean[i] * mean[j]
    return mean, cov


def _model(row: pd.Series, start: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    factor = np.linalg.cholesky(cov + np.diag(np.square(RESOLUTION)))
    inverse = np.linalg.inv(factor)
    log_det = float(2 * np.log(np.diag(factor)).sum())
    return row["fit_key"], start, mean.tolist(), inverse.ravel().tolist(), log_det


def _frame(models: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(models, columns=["fit_key", "start", "mean", "inverse", "log_det"])


def _estimated(moments: DataFrame, factor: float) -> DataFrame:
    """Models of the moments of concentrated rows; one row each, whatever the group."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _frame(
                [
                    _model(row, int(row["start"]), mean, cov * factor)
                    for _, row in part.iterrows()
                    for mean, cov in [_covariance(row)]
                ]
            )

    return moments.mapInPandas(solve, MODEL)


def _started(vectors: DataFrame) -> DataFrame:
    """The three deterministic starts of every group."""
    median = F.percentile_approx
    centre = written(
        vectors.groupBy("fit_key").agg(
            *(median(f"x{i}", F.lit(0.5), F.lit(10000)).alias(f"m{i}") for i in range(SIZE))
        ),
        "centres",
    )
    spread = written(
        vectors.join(centre, "fit_key")
        .groupBy("fit_key", *(f"m{i}" for i in range(SIZE)))
        .agg(
            *(
                median(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5), F.lit(10000)).alias(f"d{i}")
                for i in range(SIZE)
            )
        ),
        "spreads",
    )
    scale = [
        F.greatest(F.col(f"d{i}") * 1.4826, F.lit(RESOLUTION[i])) for i in range(SIZE)
    ]
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / scale[i] for i in range(SIZE)]
    length = F.sqrt(sum((c * c for c in z), F.lit(1e-12)))
    scored = vectors.join(spread, "fit_key")
    scored = scored.select(
        "fit_key",
        *(f"m{i}" for i in range(SIZE)),
        *(scale[i].alias(f"c{i}") for i in range(SIZE)),
        F.array(*map(F.tanh, z)).alias("tanh"),
        F.array(*(c / length for c in z)).alias("sign"),
    )
    kinds = F.explode(
        F.array(
            F.struct(F.lit(1).alias("kind"), F.col("tanh").alias("v")),
            F.struct(F.lit(2).alias("kind"), F.col("sign").alias("v")),
        )
    )
    keys = ["fit_key", *(f"m{i}" for i in range(SIZE)), *(f"c{i}" for i in range(SIZE))]
    scored = scored.select(*keys, kinds.alias("one")).select(*keys, "one.kind", "one.v")
    v = [F.get(F.col("v"), F.lit(i)) for i in range(SIZE)]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            models = []
            for _, row in part.iterrows():
                mean = np.array([row[f"m{i}"] for i in range(SIZE)])
                scales = np.array([row[f"c{i}"] for i in range(SIZE)])
                if row["kind"] == 1:
                    models.append(_model(row, 0, mean, np.diag(scales**2)))
                _, cov = _covariance(row)
                deviation = np.sqrt(np.maximum(np.diag(cov), 1e-6))
                correlation = cov / np.outer(deviation, deviation)
                correlation = 0.95 * correlation + 0.05 * np.eye(SIZE)
                models.append(_model(row, int(row["kind"]), mean, correlation * np.outer(scales, scales)))
            yield _frame(models)

    return written(_moments(scored, v, *keys, "kind").mapInPandas(solve, MODEL), "starts")


def fitted(vectors: DataFrame, alpha: float = ALPHA, steps: int = STEPS) -> DataFrame:
    """(fit_key, mean, inverse) of every group of `vectors` (fit_key, x0, x1, ...)."""
    models = _started(vectors)
    for _ in range(steps):
        near = vectors.join(models, "fit_key").withColumn(
            "d", _distance(_mean(), F.col("inverse"), _x())
        )
        bounds = near.groupBy("fit_key", "start").agg(
            F.percentile_approx("d", F.lit(alpha), F.lit(10000)).alias("bound")
        )
        bounds = written(bounds.join(models, ["fit_key", "start"]), "bounds")
        near = vectors.join(bounds, "fit_key").filter(
            _distance(_mean(), F.col("inverse"), _x()) <= F.col("bound")
        )
        moments = _moments(near, _x(), "fit_key", "start")
        models = written(_estimated(moments, consistency(alpha)), "models")
    best = models.groupBy("fit_key").agg(
        F.min_by(F.struct("mean", "inverse"), F.struct("log_det", "start")).alias("best")
    )
    best = written(best.select("fit_key", "best.mean", "best.inverse"), "best")
    bound = chi_square_quantile(1 - REWEIGHT, SIZE)
    near = vectors.join(best, "fit_key").filter(
        _distance(_mean(), F.col("inverse"), _x()) <= bound
    )
    moments = _moments(near, _x(), "fit_key").withColumn("start", F.lit(0))
    final = _estimated(moments, consistency(REWEIGHT)).select("fit_key", "mean", "inverse")
    return written(final, "final")


def estimates(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(of_lang, of_source, mean, inverse) from rows with a column `_stats` of statistics."""
    rows = stats.filter(~base_failed(F.col("_stats"))).select(
        _named(lang).alias("of_lang"),
        _named(source).alias("of_source"),
        *(x.alias(f"x{i}") for i, x in enumerate(vector(F.col("_stats")))),
    )
    rows = written(rows, "rows")
    keys = written(_group_keys(rows), "keys")
    vectors = rows.join(keys, ["of_lang", "of_source"]).drop("of_lang", "of_source")
    models = fitted(written(vectors, "vectors"))
    return written(keys.join(models, "fit_key"), "estimates")


def judged(
    stats: DataFrame,
    models: DataFrame,
    lang: str = "lang",
    source: str = "source",
    tail: float = REJECTED_TAIL,
) -> DataFrame:
    """`stats` with `_base_failed`, `_distance` (NULL without an estimate) and `_kept`."""
    models = models.select("of_lang", "of_source", "mean", "inverse")
    distance = _distance(_mean(), F.col("inverse"), vector(F.col("_stats")))
    bound = chi_square_quantile(tail, SIZE)
    failed = base_failed(F.col("_stats"))
    return (
        stats.withColumns({"of_lang": _named(lang), "of_source": _named(source)})
        .join(models, ["of_lang", "of_source"], "left")
        .withColumn("_base_failed", failed)
        .withColumn("_distance", distance)
        .withColumn("_kept", ~failed & (F.coalesce("_distance", F.lit(0.0)) <= bound))
        .drop("of_lang", "of_source", "mean", "inverse")
    )


def verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the statistics, `base_failed`, `distance` and `kept` of every text."""
    stats = bounded(docs).select("doc_id", "lang", "source", statistics(F.col(text)).alias("_stats"))
    stats = written(stats, "stats")
    return judged(stats, estimates(stats)).select(
        "doc_id",
        "_stats.*",
        F.col("_base_failed").alias("base_failed"),
        F.col("_distance").alias("distance"),
        F.col("_kept").alias("kept"),
    )


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.

    The texts are measured twice rather than stored between the two passes.
    """
    whole = bounded(docs).select(
        F.struct("*").alias("_row"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        statistics(F.col(text)).alias("_stats"),
    )
    models = estimates(whole.select("lang", "source", "_stats"))
    return judged(whole, models).filter("_kept").select("_row.*")
