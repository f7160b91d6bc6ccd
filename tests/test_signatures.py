"""Printed signature lines over the few lines that are looked at, against the statement over all of them."""

import random

from formloom.functions.dialect import SPARK
from formloom.operators import rules
from formloom.plans import queries
from formloom.plans.registry import run

SF = "/root/testdata/sf0.001"


def test_the_statement_makes_no_words_again(spark):
    plan = queries.QUERIES["printed_signature_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "REPARTITION_BY_NUM" in plan


def test_few_lines_give_what_all_lines_give(spark):
    rng, words, lines = random.Random(6), [], []
    for form in range(60):
        for page in (1, 2):
            for n in sorted(rng.sample(range(9), rng.randint(0, 7))):
                x, top = 30.0 + rng.choice([0, 40, 90]), 14.0 * n + rng.choice([0.0, 0.0, 5.0])
                first = x
                for k in range(rng.randint(1, 6)):
                    text = rng.choice(["Signature", "signature(s)", "of", "Employee's", "Date", "dated", "(if", "any)", "x", "Unsigned", None])
                    width = 5.0 * len(text or "")
                    words.append((form, page, n, k, text, x, top, x + width, top + 10))
                    x += width + rng.choice([3.0, 5.0, 30.0, 130.0])
                if rng.random() < 0.95:
                    lines.append((form, page, n, first, top, x, top + 10, "t"))
    tables = {
        "words": spark.createDataFrame(words, "form_id long, page long, line_no long, word_no long, text string, x0 double, y0 double, x1 double, y1 double"),
        "line_boxes": spark.createDataFrame(lines, "form_id long, page long, line_no long, x0 double, y0 double, x1 double, y1 double, text string"),
        "word_pages": spark.createDataFrame([(f, p, 612.0, 792.0) for f in range(60) for p in (1, 2) if f != 7], "form_id long, page long, width double, height double"),
        "real_signatures": spark.createDataFrame([(f, 1) for f in range(0, 60, 6)], "form_id long, page long"),
    }
    one, other = (sorted(map(repr, df.collect())) for df in (rules.signatures_near(spark, **tables), run(spark, rules.printed_signature_lines(SPARK), tables)))
    assert len(one) > 10 and one == other
