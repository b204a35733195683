import os

import pytest

from quellwerk.llm import language as L
from quellwerk.llm import mixing as M
from quellwerk.llm.encode import TOKENIZER
from quellwerk.session import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_labels(spark):
    forms = {"de": "de", "DE": "de", "pt-BR": "pt", "Spanisch": "es", "jpn": "ja", "und": None, "": None, None: None, "zh": "zh", "af": "af"}
    df = spark.createDataFrame([(x,) for x in forms], "s string").select("s", L.label_language(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == forms


def test_held_out_sentences(spark):
    rows = [(r.sprache, r.satz) for r in table(spark, SF, "sprachproben").orderBy("probe_id").collect() if r.sprache in L.LANGUAGES]
    taught = [x for i, x in enumerate(rows) if i % 4]
    asked = [x for i, x in enumerate(rows) if not i % 4]
    p = L.Profiles(taught)
    language, _ = L.nearest(p.compare([t for _, t in asked])[0])
    assert sum(p.languages[i] == s for i, (s, _) in zip(language, asked)) >= 0.85 * len(asked)


def test_planted_segments_and_labels(spark):
    samples = table(spark, SF, "sprachproben")
    by = {}
    for r in samples.orderBy("probe_id").collect():
        by.setdefault(r.sprache, []).append(r.satz)
    rows = [(i, [" ".join(by[s][:4]), " ".join(by[s][4:8])], s) for i, s in enumerate(L.LANGUAGES)]
    rows += [(100, [" ".join(by["de"][:6]), " ".join(by["ru"][:4])], "de"), (101, [" ".join(by["fr"][:6])], "en"), (102, [" ".join(by["pl"][:6])], None), (103, None, "de"), (104, [], None)]
    df = spark.createDataFrame(rows, "zeilen_nr bigint, absaetze array<string>, sprache string")
    got = {(r.zeilen_nr, r.absatz_nr, r.sprache) for r in L.language_cases(df, samples, spark.createDataFrame([], "zeilen_nr bigint")).collect()}
    assert got == {(100, 1, "ru"), (101, -1, "fr"), (102, -1, "pl")}


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
def test_mix_holds_shares_and_caps(spark):
    text = "Der Bau ruht seit gestern und niemand weiß warum. "
    docs = [(i, text * (1 + i % 3), "a", 0) for i in range(300)] + [(1000 + i, "Another text about prices. " * 3, "b", 0) for i in range(30)] + [(2000, None, "a", 0), (2001, "", "b", 0), (2002, "x", None, 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, q int")
    goal = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2), ("leer", 0.0, 3)], "source string, ziel_anteil double, max_wiederholung int")
    uses, report = M.mix(df, goal)
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].ist_anteil - 0.6) < 0.02 and abs(got["b"].ist_anteil - 0.4) < 0.02 and got["leer"].tokens == 0
    assert all(r.verwendungen <= (1 if r.source == "a" else 2) for r in uses.collect())
    assert uses.agg(F.sum(F.col("n_tokens") * F.col("verwendungen"))).collect()[0][0] == sum(r.tokens for r in got.values())


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a", 1.0, 1)], "source string, ziel_anteil double, max_wiederholung int")
    uses, report = M.mix(df, goal)
    assert uses.count() == 0 and report.collect()[0].tokens == 0
    assert M.mix(df, goal.limit(0))[0].count() == 0
