"""One query per operator, over whole tables with production parameters, and SQL where it can.

Extra columns of the tables, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm import (
    alignment,
    collocations,
    decontamination,
    density,
    language_id,
    mixing,
    near_dedup,
    outliers,
    secrets,
    simhash_dedup,
    slots,
    surrogates,
    url_filter,
)

#: Hosts whose canonical URLs make the list of the URL filter.
LISTED_HOSTS = r"(^|\.)(casino|free-bets|ads-track|spam-farm|cheap-pills|adult)[a-z-]*\."


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return slots.sharded(docs)[0]


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.anonymised(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.uses(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op6_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    listed = pages.filter(url_filter.host(F.col("url")).rlike(LISTED_HOSTS)).select(
        url_filter.canonical(F.col("url")).alias("url_key")
    )
    return url_filter.judged(pages, listed)


def op7_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontamination.leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.clustered(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_debruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "text", "lang"))


QUERIES = {
    made.__name__: made
    for made in (
        op1_mcd_outliers,
        op2_virtual_slots,
        op3_markov_secrets,
        op4_keyed_surrogates,
        op5_temperature_mixing,
        op6_blocked_bloom,
        op7_bitmask_language,
        op8_simhash_windows,
        op9_text_density,
        op10_minhash_bayes,
        op11_token_alignment,
        op12_deletion_variants,
        op13_debruijn_phrases,
    )
}

ORACLE_SQL = {
    "op6_blocked_bloom": r"""
WITH cut AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
        regexp_replace(
            regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1, 's'),
            '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g') AS asked
    FROM pages
), clean AS (
    SELECT page_id, host, path,
        regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN trim(asked, '&') <> ''
                THEN '?' || trim(regexp_replace(asked, '&+', '&', 'g'), '&') ELSE '' END
            AS canonical
    FROM cut
), listed AS (
    SELECT DISTINCT canonical FROM clean
    WHERE regexp_matches(
        host, '(^|\.)(casino|free-bets|ads-track|spam-farm|cheap-pills|adult)[a-z-]*\.')
), ruled AS (
    SELECT page_id, host, path, canonical,
        CASE
            WHEN (host = 'example.org' OR host LIKE '%.example.org')
                AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR host LIKE '%.example.org')
                AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
        END AS rule
    FROM clean
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
        WHEN rule IS NOT NULL OR listed.canonical IS NOT NULL THEN 'block'
        ELSE 'allow' END AS verdict,
    ruled.canonical AS canonical,
    listed.canonical IS NOT NULL AS listed
FROM ruled LEFT JOIN listed ON ruled.canonical = listed.canonical
""",
    "op13_debruijn_phrases": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(
            translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), cut AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
    FROM pieces
), sizes AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang
), places AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM (SELECT lang, w, unnest(range(1, 6)) AS k FROM cut) WHERE len(w) >= k
), counts AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM places GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2
), cuts AS (
    SELECT *, unnest(range(1, k)) AS j FROM candidates
), scores AS (
    SELECT c.lang, c.k, c.phrase, c.a, c.j, l.f AS l, r.f AS r, n,
        ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM cuts c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')
    JOIN sizes s ON s.lang = c.lang
), best AS (
    SELECT * FROM scores
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
    SELECT * FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM candidates o
        WHERE o.lang = b.lang AND o.k > b.k AND 100 * o.a >= 100 * b.a
            AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score
FROM kept
QUALIFY rank <= 2000
""",
}
