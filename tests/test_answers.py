"""A model's reading laid over the plan: what an answer needs is looked up for answers, and the plan's entries stay where they are."""

import re

from formloom.functions.dialect import SPARK
from formloom.plans import queries, registry
from formloom.plans.registry import Folder, run

SF = "/root/testdata/sf0.001"


def _above(plan, needle):
    """Names of the operators over each scan of a table, down to it."""
    held, out = [], []
    for line in plan.splitlines():
        if found := re.match(r"^([ :|+-]*)(?:\*\(\d+\) )?(\w+)", line):
            depth = len(found[1])
            held = [(d, n) for d, n in held if d < depth] + [(depth, found[2])]
            if needle in line and found[2] in ("FileScan", "Scan"):
                out.append([n for _, n in held])
    return out


def test_entries_are_not_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(registry, "FORM_ROWS", 1 << 11)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        plan = queries.QUERIES["apply_reading"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    over = _above(plan, "formloom_plan_entries")
    assert over and not any("Exchange" in n for names in over for n in names)
    assert "parse_json" not in plan and "from_json" not in plan  # a reply is read once, not once for each filter


def test_answers_give_what_the_statements_give(spark):
    folder = Folder(spark, SF, queries.OPERATORS)
    for name in ("parse_replies", "apply_reading"):
        op = queries.OPERATORS[name]
        tables = {x: folder.get(x) for x in op.inputs}
        one, other = (sorted(map(repr, df.collect())) for df in (op.apply(spark, **tables), run(spark, op.sql(SPARK), tables)))
        assert one and one == other


def test_labels_of_boxes_are_read_once(spark):
    op, get = queries.OPERATORS["tick_choices"], Folder(spark, SF, queries.OPERATORS).get
    tables = {x: get(x) for x in op.inputs}
    found = op.apply(spark, **tables)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    last = max(k for k, x in enumerate(lines) if "regexp_replace(label" in x)
    assert re.search(r"Relation \[label#\d+\]", lines[last + 1])  # tokens are made of the written labels alone
    one, other = (sorted(map(repr, df.collect())) for df in (found, run(spark, op.sql(SPARK), tables)))
    assert one and one == other
