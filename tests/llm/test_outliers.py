"""Robust outlier rules against plain Python and a brute-force estimate."""

import re

import numpy as np
import pytest

from lendlens.llm import outliers, queries
from tests.conftest import TESTDATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


@pytest.mark.parametrize(
    "text",
    [
        "",
        " \n \t",
        "a a a a a",
        "a b c d a b c\na b c d a b c\n\n\nx",
        "one\x0btwo\x0cthree four five \x1csix é中\U0001f600 |#<>",
        "line\nline \nline\n line\nline",
    ],
)
def test_statistics(text):
    assert outliers.measured(text)[:5] == plain_statistics(text)


def test_chi_square():
    assert outliers.chi_square_tail(12.592, 6) == pytest.approx(0.05, abs=1e-4)
    assert outliers.chi_square_quantile(0.01, 6) == pytest.approx(16.812, abs=1e-3)


def brute_estimate(x, starts=60):
    """The least determinant over concentrations from random subsets, reweighted."""
    rng = np.random.default_rng(0)
    floor = np.diag(np.square(outliers.RESOLUTION))

    def distances(mean, cov):
        centred = x - mean
        return np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov + floor), centred)

    best = None
    for _ in range(starts):
        rows = x[rng.choice(len(x), 10, replace=False)]
        for _ in range(30):
            d = distances(rows.mean(0), np.cov(rows.T, bias=True) * outliers.consistency(0.75))
            rows = x[d <= np.sort(d)[int(np.ceil(0.75 * len(x))) - 1]]
        cov = np.cov(rows.T, bias=True) * outliers.consistency(0.75)
        size = np.linalg.slogdet(cov + floor)[1]
        if best is None or size < best[0]:
            best = size, rows.mean(0), cov
    near = x[distances(*best[1:]) <= outliers.chi_square_quantile(0.025, outliers.SIZE)]
    return distances(near.mean(0), np.cov(near.T, bias=True) * outliers.consistency(0.975))


def test_query_against_brute_force(spark):
    made = queries.op1_mcd_outliers(spark, f"{TESTDATA}/sf0.01").toPandas()
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").toPandas()
    made = made.merge(docs[["doc_id", "text", "lang", "source"]], on="doc_id")
    for row in made.itertuples():
        plain = plain_statistics(row.text) if len(row.text) < 3000 else None
        assert plain in (None, (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words))
    failed = (made.n_words < 50) | (100 * made.n_repeat_words > 50 * made.n_words)
    assert (made.base_failed == failed).all() and not made.kept[failed].any()
    passed = made[~made.base_failed]
    # No source of this scale has enough rows of its own: languages share.
    bound = outliers.chi_square_quantile(outliers.REJECTED_TAIL, outliers.SIZE)
    compared = differ = 0
    for _, rows in passed.groupby("lang"):
        if len(rows) < outliers.MIN_ROWS:
            continue
        share = lambda part, whole: np.arcsin(np.sqrt(np.minimum(1, part / np.maximum(whole, 1))))
        x = np.column_stack(
            [
                np.log(rows.n_words),
                np.log(rows.word_chars / rows.n_words),
                share(rows.n_symbols, rows.word_chars),
                share(rows.n_dup_lines, rows.n_lines),
                share(rows.n_repeat_words, rows.n_words),
                share(rows.n_capitals, rows.word_chars),
            ]
        )
        compared += len(rows)
        differ += int(((brute_estimate(x) <= bound) != rows.kept.to_numpy()).sum())
    assert compared > 500 and differ <= compared * 0.003


def test_labels(spark):
    """Labelled bad texts are rejected and good ones kept."""
    made = queries.op1_mcd_outliers(spark, f"{TESTDATA}/sf0.01")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet")
    rows = made.filter("NOT base_failed").join(labels, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.1


def test_edges(edge_docs, no_docs):
    rows = outliers.verdicts(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {row["doc_id"]: row for row in rows}
    for empty in (1, 2, 3, 6):
        assert by_id[empty]["base_failed"] and not by_id[empty]["kept"]
    assert by_id[1]["n_words"] == 0 and by_id[4]["n_words"] == 40_000
    assert all(by_id[10 + i]["kept"] for i in range(8))
    kept = outliers.kept_rows(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(row["kept"] for row in rows)
    assert outliers.verdicts(no_docs).count() == 0 == outliers.kept_rows(no_docs).count()


def test_names_with_marks_keep_groups_apart(spark):
    """Language `=en|=x` of source `=y` is another group than `=en` of `=x|=y`."""
    from lendlens.llm.outliers import MIN_ROWS, _group_keys

    groups = [("=en|=x", "=y"), ("=en", "=x|=y"), ('=a","of_source":"=b', "=c")]
    rows = [group for group in groups for _ in range(MIN_ROWS)]
    keys = _group_keys(spark.createDataFrame(rows, "of_lang string, of_source string")).collect()
    assert len({row["fit_key"] for row in keys}) == len(groups)
