"""Labels, rules and signature lines on pages drawn by hand."""

import pytest

from formloom.plans.queries import OPERATORS

WORDS = "form_id long, page long, line_no long, word_no long, text string, x0 double, y0 double, x1 double, y1 double"
BOXES = "form_id long, page long, blank_id string, x0 double, y0 double, x1 double, y1 double"
STROKES = "form_id long, page long, x0 double, x1 double, y double, src string"


def line(n, top, *runs):
    """A line of words 6 points a letter, 3 apart; runs: (x, text)."""
    out, k = [], 0
    for x, text in runs:
        for w in text.split():
            out.append((1, 1, n, k, w, float(x), float(top), x + 6.0 * len(w), top + 10.0))
            x, k = x + 6 * len(w) + 3, k + 1
    return out


class Page:
    """Results over hand-made words and boxes, each operator over those it needs."""

    def __init__(self, spark, words, boxes, **more):
        self.spark = spark
        self.made = {"words": spark.createDataFrame(words, WORDS), "boxes": spark.createDataFrame([(1, 1, *b) for b in boxes], BOXES), "word_pages": spark.createDataFrame([(1, 1, 612.0, 792.0)], "form_id long, page long, width double, height double")}
        for name, (schema, rows) in more.items():
            self.made[name] = spark.createDataFrame(rows, schema)

    def frame(self, name):
        if name not in self.made:
            op = OPERATORS[name]
            self.made[name] = op.apply(self.spark, **{x: self.frame(x) for x in op.inputs})
            if name in ("rule_boxes", "run_around", "rule_runs"):
                self.made[name] = self.spark.createDataFrame(self.made[name].collect(), self.made[name].schema)
        return self.made[name]

    def get(self, name, key="blank_id", value=-1):
        return {r[key]: r[value] for r in self.frame(name).collect()}


def test_wrapped_labels_are_whole(spark):
    words = line(0, 0, (100, "Prose that ends here.")) + line(1, 12, (100, "City or town,")) + line(2, 24, (100, "state, and ZIP code"))
    words += line(3, 100, (100, "6 Name")) + line(4, 112, (100, "of the filer")) + line(5, 124, (100, "(a) first name"))
    page = Page(spark, words, [("city", 100.0, 36.0, 300.0, 48.0), ("marked", 100.0, 136.0, 300.0, 148.0), ("far", 100.0, 60.0, 300.0, 70.0), ("beside", 400.0, 36.0, 500.0, 48.0)])
    assert page.get("label_above") == {"city": "City or town, state, and ZIP code", "marked": "(a) first name"}
    assert page.get("label_row") == {"city": "state, and ZIP code", "marked": "(a) first name"}


def test_a_label_of_four_lines_at_most_and_cut(spark):
    words = [w for k, start in enumerate(["Zero", "Top", "then", "and", "last"]) for w in line(k, 12 * k, (50, f"{start} line"))]
    assert Page(spark, words, [("b", 50.0, 60.0, 300.0, 70.0)]).get("label_above") == {"b": "Top line then line and line last line"}
    long = [w for k, start in enumerate(["Top", "then", "and", "last"]) for w in line(k, 12 * k, (0, start + " abcdefghi" * 9))]
    assert Page(spark, long, [("b", 0.0, 48.0, 900.0, 58.0)]).get("label_above") == {"b": "Top" + " abcdefghi" * 9}
    assert len(Page(spark, line(0, 0, (0, "Label" + " abcdefghi" * 40)), [("b", 0.0, 12.0, 9000.0, 22.0)]).get("label_above")["b"]) == 320


def test_columns_and_overlap(spark):
    words = line(0, 0, (0, "left column"), (200, "Employer identification number"), (520, "next")) + line(1, 14, (0, "Own line"), (196, "over"))
    page = Page(spark, words, [("tin", 200.0, 12.0, 229.0, 24.0), ("next", 480.0, 12.0, 519.0, 24.0)])
    # a narrow box's label goes on to the right; a word that begins past the box is no label; the blank's own line is none
    assert page.get("label_above") == {"tin": "Employer identification number"}
    assert page.get("label_left") == {}


def test_left_and_right(spark):
    words = line(0, 0, (10, "8 Total"), (72, ". . . ."), (150, "ignored")) + line(1, 20, (10, "Near"), (60, "word"))
    words += line(2, 40, (60, "Single filer"), (160, "other")) + line(3, 60, (60, "Text after"))
    page = Page(spark, words, [("leader", 112.0, 0.0, 140.0, 10.0), ("gap", 90.0, 20.0, 140.0, 30.0), ("far", 400.0, 20.0, 440.0, 30.0), ("tick", 44.0, 41.0, 54.0, 51.0), ("wide", 20.0, 60.0, 55.0, 70.0)])
    assert page.get("label_left") == {"leader": "8 Total", "gap": "word"}
    assert page.get("label_right") == {"tick": "Single filer"}


def test_sections(spark):
    words = line(0, 0, (200, "Supplement A, USCIS")) + line(1, 12, (190, "Preparer and/or Translator Certification")) + line(2, 40, (500, "Supplement A"))
    words += line(3, 200, (10, "Part II. Certification")) + line(4, 240, (10, "The quick fox")) + line(5, 260, (10, "only the brave")) + line(6, 300, (10, "For Office Use Only."))
    boxes = [("first", 10.0, 60.0, 50.0, 70.0), ("prose", 10.0, 280.0, 50.0, 290.0), ("office", 10.0, 320.0, 50.0, 330.0), ("above", 10.0, 5.0, 50.0, 8.0)]
    got = Page(spark, words, boxes).get("label_section")
    assert got == {"first": "Supplement A, USCIS Preparer and/or Translator Certification", "prose": "Part II. Certification", "office": "For Office Use Only."}


def test_underscores(spark):
    words = line(0, 0, (0, "Name:________ ____"), (130, "________"), (210, "________")) + line(1, 20, (0, "__ ___")) + line(2, 40, (0, "____ word ________"))
    got = sorted((r.line_no, r.x0, r.x1, r.y) for r in Page(spark, words, []).frame("underscore_rules").collect())
    assert got == [(0, 0.0, 105.0, 783.5), (0, 130.0, 178.0, 783.5), (0, 210.0, 258.0, 783.5), (2, 54.0, 102.0, 743.5)]


def rules(spark, real=(), taken=()):
    words = line(0, 88, (20, "Name")) + line(1, 188, (20, "City")) + line(2, 600, (20, "alone"))
    strokes = [(60.0, 200.0, 692.0), (60.2, 200.1, 692.1), (60.0, 200.0, 592.0), (0.0, 600.0, 500.0), (300.0, 400.0, 300.0)]
    return Page(spark, words, [], classify_rules=(STROKES, [(1, 1, a, b, y, "segment") for a, b, y in strokes]), underscore_rules=("form_id long, page long, x0 double, x1 double, y double", []),
                real_fields=("form_id long", real), taken_boxes=("form_id long, page long, x0 double, y0 double, x1 double, y1 double", taken))


def test_rules_with_labels_become_blanks(spark):
    found = lambda p: {(r.x0, r.y): (r.left_, r.above) for r in p.frame("rule_blanks").collect()}
    assert found(rules(spark)) == {(60.2, 692.1): ("Name", ""), (60.0, 592.0): ("City", "")}  # one of two at a place, not too wide, labelled
    assert found(rules(spark, taken=[(1, 1, 190.0, 600.0, 250.0, 640.0)])) == {(60.2, 692.1): ("Name", "")}
    assert found(rules(spark, taken=[(1, 1, 200.0, 592.0, 250.0, 604.0)])).keys() == {(60.2, 692.1), (60.0, 592.0)}  # touching is not overlapping
    assert found(rules(spark, real=[(1,)])) == {}


SIGNED = [
    (line(0, 500, (36, "Signature of"), (400, "Date")) + line(1, 512, (36, "U.S. person")), [("signature", "Signature U.S. person of", 113.0, 390.0), ("date", "Date", 432.0, 576.0)]),
    (line(0, 500, (36, "Employee's signature (This form is not valid unless you sign it.)")), [("signature", "Employee's signature (This form is not valid unless you sign it.)", None, None)]),
    (line(0, 500, (36, "Signature requirements. The form must be signed by the filer")), []),
    (line(0, 500, (36, "Sign here")), []),
]


@pytest.mark.parametrize("words,want", SIGNED)
def test_printed_signature_lines(spark, words, want):
    page = Page(spark, words, [], real_signatures=("form_id long, page long", []))
    got = [(r.kind, r.left_, r.x0, r.x1) for r in page.frame("printed_signature_lines").orderBy("x0").collect()]
    assert [(k, t) for k, t, _, _ in got] == [(k, t) for k, t, _, _ in want]
    assert all(a == (x0 or a) and b == (x1 or b) for (_, _, a, b), (_, _, x0, x1) in zip(got, want))


def test_a_real_signature_field_is_enough(spark):
    page = Page(spark, SIGNED[0][0], [], real_signatures=("form_id long, page long", [(1, 1)]))
    assert page.frame("printed_signature_lines").count() == 0
    elsewhere = Page(spark, SIGNED[0][0] + line(9, 700, (36, "Signature")), [], real_signatures=("form_id long, page long", [(1, 2)]))
    assert elsewhere.frame("printed_signature_lines").count() == 2  # one block a page
