"""Paragraphs and pages handed to Python many at a time: what the statements and plain loops give, however the batches fall."""

import random

import duckdb
import pandas as pd
import pytest

from formloom.functions.dialect import DUCK
from formloom.operators import stream_text
from formloom.operators.geometry import LINE_TOLERANCE
from formloom.plans import queries

SF = "/root/testdata/sf0.001"
RUNS = "form_id long, seq long, run_no long, fld_char string, instr string, name string, checked boolean, text string"


@pytest.fixture(params=["7", "10000"])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _plan(spark, name):
    return queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_fields_need_one_window(spark):
    plan = _plan(spark, "field_machine")
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_fields_of_odd_runs(spark, batches):
    random.seed(23)
    rows = []
    for seq in range(80):
        for k in range(random.randrange(1, 30)):
            mark = random.choice(["begin", "separate", "end", "", "", "", "other", None])
            text = random.choice(["a ", "b:", "\tç ", " ", "𝒳 :", "", None])
            rows.append((random.choice([1, 1, 2]) if seq else None, seq, 3 * k, mark, random.choice([" FORMTEXT ", "formCheckBox", "FORM", "TEXT", None]), random.choice([None, "", "Text1", "city"]), random.choice([True, False, None]), text))
    got = queries.OPERATORS["field_machine"].apply(spark, runs=spark.createDataFrame(rows[::-1], RUNS).repartition(3)).collect()
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")]).astype({"form_id": "Int64", "checked": "boolean"}))
    con.execute("create view runs as select form_id::bigint as form_id, * exclude (form_id) from given")
    want = con.execute(stream_text.field_machine(DUCK)).fetchall()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pages_need_no_call_each(spark):
    plan = _plan(spark, "line_cluster")
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and plan.count("Sort [") == 2 and "ENSURE_REQUIREMENTS" not in plan


def _lines(words):
    """Line of each word of one page, word by word; without a number it is behind all others."""
    nan = float("nan")
    words = [(w[3], *(nan if x is None else x for x in (w[5], w[6], w[8]))) for w in words]
    last = lambda x: (x != x, 0 if x != x else x)
    anchors, tops, found = [], [], {}
    for k, _, y0, y1 in sorted(words, key=lambda w: (last((w[2] + w[3]) / 2), last(w[1]), w[0])):
        c, h = (y0 + y1) / 2, y1 - y0
        near = [n for n, (a, b) in enumerate(anchors) if c - a <= LINE_TOLERANCE * min(b, h)]
        if not near:
            anchors.append((c, h))
            tops.append(y0)
        found[k] = n = near[-1] if near else len(tops) - 1
        tops[n] = min(tops[n], y0)
    place = {n: k for k, n in enumerate(sorted(range(len(tops)), key=lambda n: (last(tops[n]), n)))}
    return {k: place[n] for k, n in found.items()}


def test_lines_of_odd_pages(spark, batches):
    random.seed(15)
    pages, inf = [], float("inf")
    for form in range(30):
        tops = [random.choice([0.0, 10.0, 20.0, 100.0]) + random.choice([0.0, 0.0, 1.0, 3.7, 5.0]) for _ in range(6)]
        ys = [(y, y + random.choice([0.0, 8.0, 10.0, 10.0, 12.0])) for y in tops]
        odd = [(None, 3.0), (5.0, None), (9.0, 4.0), (-inf, inf), (inf, inf), (5.0, inf)] if form % 3 == 0 else []
        boxes = [random.choice(ys + odd) for _ in range(random.choice([1, 3, 40]))]
        pages.append([(form // 2, form % 2, 0, k, random.choice(["a", None, ""]), random.choice([0.0, 5.0, None]), y0, 9.0, y1) for k, (y0, y1) in enumerate(boxes)])
    schema = "form_id long, page long, line_no long, word_no long, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [w for p in pages for w in p]
    got = queries.OPERATORS["line_cluster"].apply(spark, words=spark.createDataFrame(rows[::-1], schema).repartition(3)).collect()
    want = [(w[0], w[1], w[3], w[4], n) for p in pages for lines in [_lines(p)] for w in p for n in [lines[w[3]]]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
