"""Words, lines and characters stay in the task that makes them; the folds over lists give what the statements give."""

import duckdb
import pytest

from formloom.functions.dialect import SPARK
from formloom.operators import geometry, labels
from formloom.plans import queries, registry
from formloom.plans.registry import Folder, run

SF = "/root/testdata/sf0.001"
BOX = ["form_id", "page", "blank_id"]


@pytest.mark.parametrize("name", ["chars_to_words", "line_cluster", "line_boxes", "label_left", "run_around", "label_above", "rule_left", "rule_runs", "rule_above", "rule_blanks", "printed_signature_lines"])
def test_nothing_is_dealt_again(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 16)
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def _same(one, other):
    one, other = (sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in (one, other))
    assert one and one == other


def test_lists_give_what_the_statements_give(spark):
    get = Folder(spark, SF, queries.OPERATORS).get
    short = {n: get(n).where("form_id < 60") for n in ("boxes", "line_boxes", "words", "same_line")}
    around = run(spark, labels.run_around(SPARK), {n: short[n] for n in ("boxes", "line_boxes", "words")})
    _same(labels.runs_by_line(spark, short["boxes"], short["line_boxes"], short["words"]), around)
    _same(labels.fold_above(spark, around, short["same_line"]), run(spark, labels.label_above(SPARK), {"run_around": around, "same_line": short["same_line"]}))


def test_characters_of_odd_pages(spark):
    rows = [(1, 1, k, c, 5.0 * k, 1.0, 5.0 * k + 5, 9.0) for k, c in enumerate(["a", "𝒳", " ", " ", "é́", None, "", "b", "\x85", "c", "　"])]
    rows += [(1, 2, 0, " ", 0.0, 0.0, 1.0, 1.0), (2, 1, 7, "z", None, 0.0, 1.0, 1.0), (2, 1, 3, "y", 4.0, 0.0, 1.0, 1.0)]
    chars = spark.createDataFrame(rows[::-1], "form_id long, page long, i long, ch string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    _same(geometry.words_of_pages(spark, chars), run(spark, geometry.chars_to_words(SPARK), {"chars": chars}))


def test_memory_by_steps(spark):
    get, op = Folder(spark, SF, queries.OPERATORS).get, queries.OPERATORS["apply_memory"]
    tables = {x: get(x) for x in op.inputs}
    found = op.apply(spark, **tables)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join ") < 10
    _same(found, run(spark, op.sql(SPARK), tables))


@pytest.mark.parametrize("name", ["coverage_report", "inspect_rows", "entry_notes"])
def test_forms_are_dealt_once(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "FORM_ROWS", 1 << 11)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")  # the dictionary, none of the forms' tables
    try:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "").replace("SinglePartition, ENSURE_REQUIREMENTS", "")


def test_what_is_remembered_needs_saved_forms_only(spark):
    whole, saved = Folder(spark, SF, queries.OPERATORS), Folder(spark, SF, queries.OPERATORS).of_saves()
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "nation", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select fingerprint, part, slug, blank_id, key, seq from ({queries.oracles()['remember_form']})").fetchall()
    got = saved.get("remember_form").select("fingerprint", "part", "slug", "blank_id", "key", "seq").collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert 0 < saved.form_rows("lineitem").count() < whole.form_rows("lineitem").count()



def test_own_values_give_what_the_identities_give(spark, monkeypatch):
    monkeypatch.setattr(registry, "FORM_ROWS", 1 << 11)
    folder = Folder(spark, SF, queries.OPERATORS)
    for name in registry.LOOK_UP:
        op = queries.OPERATORS[name]
        _same(op.apply(spark, **folder.given(op)), op.apply(spark, **{x: folder.get(x) for x in op.inputs}))
