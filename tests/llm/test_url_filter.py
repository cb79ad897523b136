"""URL rules and the Bloom filter in front of the exact join."""

import duckdb
from pyspark.sql import functions as F

from lendlens.llm import queries, url_filter
from tests.conftest import TESTDATA, sorted_rows


def test_query_against_sql(spark):
    for scale in ("sf0.001", "sf0.1"):
        made = queries.op6_blocked_bloom(spark, f"{TESTDATA}/{scale}")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{TESTDATA}/{scale}/pages.parquet'")
        cursor = con.execute(queries.ORACLE_SQL["op6_blocked_bloom"])
        columns = [column[0] for column in cursor.description]
        assert sorted(made.columns) == sorted(columns)
        rows = sorted_rows(made.columns, made.collect())
        assert rows == sorted_rows(columns, cursor.fetchall())
        assert any("block" in row for row in rows)


def test_bloom_has_every_listed_url_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h/"), F.col("id")).alias("url_key"))
    blocks = 5000 * url_filter.BITS_PER_URL // url_filter.WORD_BITS
    filters = url_filter.bloom(listed, blocks)
    assert url_filter.possible(listed, filters, blocks).count() == 5000
    others = spark.range(50_000).select(F.concat(F.lit("o/"), F.col("id")).alias("url_key"))
    assert url_filter.possible(others, filters, blocks).count() < 50_000 * 0.02


URLS = [
    ("http://A.Example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://a.org", "a.org", "", None, "allow"),
    ("http://a.com:80/de/#x", "a.com:80", "/de/", None, "allow"),
    ("http://a.com/de/?q", "a.com", "/de/", "com/de/", "block"),
    ("http://a.com?x=http://b.org/", "a.com", "", None, "allow"),
    ("a.com/de/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://www.Listed.net/p/?utm_source=a&b=1&ref=x#f", "www.listed.net", "/p/", None, "block"),
    ("https://listed.net/p?b=1", "listed.net", "/p", None, "block"),
    ("https://listed.net/p?b=2", "listed.net", "/p", None, "allow"),
    ("http://listed.net/" + "x" * 100_000, "listed.net", "/" + "x" * 100_000, None, "allow"),
]


def test_edges(spark):
    rows = [(i, url, "x") for i, (url, *_) in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([("listed.net/p?b=1",)] * 2, "url_key string")
    made = url_filter.judged(pages, listed).collect()
    assert len(made) == 2 * len(URLS)
    for row in made:
        _, *expected = URLS[row["page_id"]]
        assert [row["host"], row["path"], row["rule"], row["verdict"]] == expected
    none = listed.limit(0)
    assert {r["verdict"] for r in url_filter.judged(pages, none).collect()} == {"allow", "block"}
    assert url_filter.judged(pages.limit(0), none).count() == 0
