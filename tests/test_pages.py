"""Characters of whole pages handed to Python many at a time, against the statement."""

import random

from formloom.functions.dialect import SPARK
from formloom.operators import geometry
from formloom.plans import queries
from formloom.plans.registry import Folder, run

SF = "/root/testdata/sf0.001"


def test_characters_are_split_at_once(spark):
    sql = Folder(spark, SF, queries.OPERATORS).derived["chars"][0]
    assert "substr(" not in sql  # a look-up by place walks the line once a character
    texts = ["", "a", "a𝒳b é́  z", "ends\\", "tab\there", "日本 語"]
    got = run(spark, sql, {"paragraphs": spark.createDataFrame([(k, 61, t) for k, t in enumerate(texts)], "form_id long, seq long, text string")})
    found = sorted((r["form_id"], r["page"], r["i"], r["ch"], r["x0"], r["y0"]) for r in got.collect())
    assert found == [(k, 2, 100000 + i, c, 5.0 * i, 12.0) for k, t in enumerate(texts) for i, c in enumerate(t + "\t")]


def test_characters_of_many_pages(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for page in range(40):
        places = sorted(rng.choices(range(30), k=rng.randint(0, 25)))
        rows += [(page // 3, page % 3, i, rng.choice(["a", "𝒳", "é́", " ", "\x85", "　", "", None, "b"]), *(rng.choice([None, 1.0, 2.5]) for _ in range(4))) for i in dict.fromkeys(places)]
    rows += [(90, 0, 1, " ", 0.0, 0.0, 0.0, 0.0), (91, 0, 1, None, 0.0, 0.0, 0.0, 0.0), (92, 0, 5, "x", 1.0, 1.0, 2.0, 2.0), (92, 0, 6, " ", 1.0, 1.0, 2.0, 2.0), (92, 0, 6, "y", 1.0, 1.0, 2.0, 2.0)]  # the last two share a place
    chars = spark.createDataFrame(rows, "form_id long, page long, i long, ch string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    want = run(spark, geometry.chars_to_words(SPARK), {"chars": chars})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = geometry.words_of_pages(spark, chars)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        one, other = (sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in (got, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one and one == other
