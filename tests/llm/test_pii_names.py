"""Mentions that were once missed, mangled, or taken for names."""

import re

import pytest
from pyspark.sql import functions as F

from matchloom.llm import pii

LEAKS = [
    ("Mr. O'Brien called.", ["O'Brien", "Brien"]), ("Mr. McDonald called.", ["McDonald", "Donald"]), ("My name is Jean-Paul Sartre.", ["Jean", "Paul", "Sartre"]), ("Frau Müller-Lüdenscheidt kommt.", ["Müller", "Lüdenscheidt"]),
    ("Dr. Jane Miller writes.", ["Jane", "Miller"]), ("MR. SMITH WAS HERE", ["SMITH"]), ("my name is JOHN SMITH", ["JOHN", "SMITH"]), ("My  name is  Peter Brown", ["Peter", "Brown"]), ("Mr. van der Berg came.", ["Berg"]),
    ("Herr von Goethe schrieb.", ["Goethe"]), ("Call 555 123 4567 now", ["555 123", "4567"]), ("Call 555.123.4567 now", ["4567"]), ("Tel. 030 1234567 bitte", ["1234567"]), ("Tel. 0049 30 1234567 bitte", ["1234567"]),
    ("from 2001:db8:85a3:0:0:8a2e:370:7334 in", ["85a3", "7334"]), ("from fe80::1ff:fe23:4567:890a in", ["fe23"]), ("My name is Peter Brown. Peter Brown is here.", ["Peter", "Brown"]), ("Mrs. Anna Lee and Anna Lee", ["Lee"]),
    ("Frau Dr. Schmidt sagt", ["Schmidt"]), ("Mr. John F. Kennedy spoke", ["John", "Kennedy"]), ("Mr. Smith's car", ["Smith"]), ("El Sr. García dijo", ["García"]),
]
KEPT = [
    "Sr. Engineer wanted", "Sr. Project Manager", "The Sr. Data Scientist role", "at 12:30:45 or 1:2", "std::vector and a::b", "Version 1.2.3 of 2024.01.02", "values 100 200 3000 4000", "12 345 678 9012 more", "Drama in the Profile",
    "Tables 0 12345 and 07 1", "The MS DOS days", "Drive and Mister nobody",
]


@pytest.fixture(scope="module")
def done(spark):
    texts = [t for t, _ in LEAKS] + KEPT
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_entities int")
    return {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}


@pytest.mark.parametrize("k", range(len(LEAKS)))
def test_no_part_of_a_mention_survives(done, k):
    text, parts = LEAKS[k]
    got = done[k].text
    assert not [p for p in parts if re.search(rf"(?<![\w]){re.escape(p)}|{re.escape(p)}(?![\w])", got)], got
    assert done[k].n_entities >= 1


@pytest.mark.parametrize("k", range(len(KEPT)))
def test_what_is_no_personal_data_stays(done, k):
    assert done[len(LEAKS) + k].text == KEPT[k]


def test_second_mentions_get_the_same_surrogate(spark):
    texts = ["Mrs. Anna Lee and Anna Lee met MRS. ANNA LEE. Anna Leeds did not.", "My name is Peter Brown. Peter  Brown is here; Mr. Peter Brown too."]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    one = re.fullmatch(r"Mrs\. (\w+ \w+) and (\w+ \w+) met MRS\. (\w+ \w+)\. Anna Leeds did not\.", got[0])
    assert one[1] == one[2] and one[3] == one[1].upper() and one[1].split()[0] in pii.GIVEN["she", "latin"]
    two = re.fullmatch(r"My name is (\w+ \w+)\. (\w+ \w+) is here; Mr\. (\w+ \w+) too\.", got[1])
    assert two[1] == two[2] == two[3] and two[1].split()[0] in pii.GIVEN["he", "latin"]


def test_names_do_not_run_out(spark, monkeypatch):
    """With few syllables the first attempts collide; later ones are longer."""
    monkeypatch.setattr(pii, "SYLLABLES", {"latin": ["ba", "do"], "cyrillic": ["ба", "до"]})
    people = spark.range(300).select(F.lit("name").alias("kind"), F.concat(F.lit("he:Smith"), F.col("id").cast("string")).alias("entity"))
    got = pii.assign(people, "k")
    assert got.count() == 300 and got.select("surrogate").distinct().count() == 300
