"""Surrogates: nothing real is left, entities stay apart and themselves."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lendlens.llm import queries, surrogates
from tests.conftest import TESTDATA

PLAIN = re.compile(
    r"[\w.]+@[\w.]+\.com|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)"
)


def test_query(spark, documents):
    _, texts = documents("sf0.1")
    rows = queries.op4_keyed_surrogates(spark, f"{TESTDATA}/sf0.1").collect()
    assert len(rows) == len(texts)
    made, real = defaultdict(set), set()
    for row in rows:
        before, after = texts[row["doc_id"]], row["text"]
        old, new = PLAIN.findall(before), PLAIN.findall(after)
        assert len(old) == len(new) == row["n_replaced"]
        assert PLAIN.sub("", before) == PLAIN.sub("", after)
        real.update(old)
        for a, b in zip(old, new, strict=True):
            made[a].add(b)
            assert a not in after and len(a) == len(b)
    assert len(real) > 400 and all(len(s) == 1 for s in made.values())
    shown = [next(iter(s)) for s in made.values()]
    assert len(set(shown)) == len(shown) and not real & set(shown)


@pytest.mark.parametrize(
    ("text", "kind", "shape"),
    [
        ("an Ann.Lee7@Acme-Corp.co.uk!", "email", r"an [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}-[A-Z][a-z]{3}\.[a-z]{2}\.uk!"),
        ("ip 10.200.3.44.", "ipv4", r"ip \d\d\.\d{3}\.\d\.\d\d\."),
        ("4111 1111 1111 1111", "card", r"\d{4} \d{4} \d{4} \d{4}"),
        ("call +44 20 7946 0958 now", "phone", r"call \+44 \d\d \d{4} \d{4} now"),
        ("ssn 123-45-6789", "ssn", r"ssn \d{3}-\d\d-\d{4}"),
        ("DE89 3704 0044 0532 0130 00", "iban", r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d"),
        ("Frau Müller kommt", "name", r"Frau [A-Z][a-z]+ kommt"),
        ("Господин Иванов", "name", r"Господин [А-Я][а-я]+"),
        ("2001:db8:0:0:0:0:0:1", "ipv6", r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]"),
    ],
)
def test_formats(spark, text, kind, shape):
    assert [m[2] for m in surrogates.mentions(text)] == [kind]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = surrogates.anonymised(docs).collect()
    assert re.fullmatch(shape, row["text"]) and row["text"] != text


def test_gender_and_check_digit():
    value = surrogates.canonical("name", "Anna Weber", "flatin")
    given = surrogates.surrogate("name", value).partition(":")[2].split()[0]
    assert given in surrogates.GIVEN["f", "latin"]
    assert surrogates.gender("Mr. ") == "m" and surrogates.gender("Señora ") == "f"
    card = surrogates.surrogate("card", "4111111111111111")
    assert surrogates._luhn(card) % 10 == 0


def test_writings_of_one_entity(spark):
    text = "+1 (212) 555-7713 or (212) 555-7713 or 212.555.7713; A@b.com a@B.com"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = surrogates.anonymised(docs).collect()
    digits = [re.sub(r"\D", "", p)[-10:] for p in re.findall(r"\(?\d{3}\)?[ .]\d{3}[-.]\d{4}", row["text"])]
    assert len(digits) == 3 and len(set(digits)) == 1 and "555" not in row["text"]
    one, other = re.findall(r"\S+@\S+", row["text"])
    assert one != other and one.lower() == other.lower()


def test_collisions_are_drawn_anew(spark, monkeypatch):
    """All 729 values of a narrow shape occur, so every draw collides with a real one."""
    values = [f"1.{a}.{b}.{c}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10)]
    found = spark.createDataFrame([("ipv4", v) for v in values], "kind string, value string")
    rows = surrogates.mapping(found).collect()
    made = [row["made"] for row in rows]
    assert len(rows) == 729 == len(set(made)) and not set(made) & set(values)
    assert max(row["draw"] for row in rows) > 0
    docs = spark.createDataFrame([(1, " ".join(values))], "doc_id long, text string")
    (row,) = surrogates.anonymised(docs).collect()
    shown = row["text"].split()
    assert len(set(shown)) == 729 and not set(shown) & set(values)


def test_edges(edge_docs, no_docs, spark):
    rows = surrogates.anonymised(edge_docs)
    before = edge_docs.select("doc_id", "text").exceptAll(rows.select("doc_id", "text"))
    assert before.count() == 0 and rows.agg(F.sum("n_replaced")).first()[0] == 0
    assert surrogates.anonymised(no_docs).count() == 0


@pytest.mark.parametrize(
    "name",
    [
        "Mr. Jean-Pierre Dupont", "Mrs. O'Brien", "Mr McDonald", "Dr. Kovačić", "Mr. John Paul Smith",
        "Mr. J. Smith", "Prof. Łukasz Nowak", "Prof. Dr. Łukasz Nowak", "Dr. Γιάννης Παπαδόπουλος",
        "Herr Ludwig van Beethoven", "Mr. J.R.R. Tolkien", "Господин Иван Петров-Водкин",
    ],
)
def test_whole_names(name):
    text = f"So {name}'s dog came."
    made, _ = surrogates.replaced(text, {})
    title = re.match(r"(?:\w+\.? (?=Dr))?\w+\.? ", name)[0]
    assert made.startswith(f"So {title}") and made.endswith("'s dog came.")
    words = set(re.findall(r"[^\W\d_]{2,}", name[len(title) :])) - {"van"}
    assert not words & set(re.findall(r"[^\W\d_]+", made)) and words


def test_mentions_of_a_person_agree():
    text = "Mr. John Smith and Dr. Smith met. Smith left; John Smith stayed, Mr. Smith's hat too."
    made, n_replaced = surrogates.replaced(text, {})
    shown = re.fullmatch(
        r"Mr. (\w+) (\w+) and Dr. (\w+) met. (\w+) left; (\w+) (\w+) stayed, Mr. (\w+)'s hat too.", made
    ).groups()
    assert len({shown[i] for i in (1, 2, 3, 5, 6)}) == 1 and shown[0] == shown[4] != "John"
    assert "Smith" not in made and n_replaced == 5


def test_names_of_several_titles_stay_apart(spark):
    """Names are compared as they are written, given and family names of all titles together."""
    details = ("nlatin", "gmlatin", "gflatin", "gnlatin")
    values = [f"{d}:{n}{i}" for i, n in enumerate(("Smith", "Badobo", "Karl", "Anna") * 75) for d in details]
    values += [f"{d}:{n}" for d in details for n in surrogates.GIVEN["m", "latin"]]
    found = spark.createDataFrame([("name", v) for v in values], "kind string, value string")
    rows = surrogates.mapping(found).collect()
    shown = [row["made"].partition(":")[2] for row in rows]
    assert len(rows) == len(values) == len(set(shown))
    assert not set(shown) & {v.partition(":")[2] for v in values}
