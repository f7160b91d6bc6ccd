"""Boxes side by side: groups, the keys that they take, and values dealt over them."""

import pytest

from formloom.functions import dictionary
from formloom.plans.queries import OPERATORS

RAW = "form_id long, page long, blank_id string, blank_no long, kind string, x0 double, y0 double, x1 double, y1 double, inside string, right_ string, left_ string, above string, section string, native_name string"


def box(no, x, y, w=50.0, h=14.0, label="", kind="text", page=1, slot="left_"):
    slots = {"inside": "", "right_": "", "left_": "", "above": "", "section": "", "native_name": "", slot: label}
    return (1, page, f"b{no}", no, kind, float(x), float(y), x + w, y + h, *slots.values())


def groups(spark, rows):
    got = OPERATORS["split_groups"].apply(spark, raw_blanks=spark.createDataFrame(rows, RAW)).collect()
    return {r.blank_id: (r.grp, r.grp_index, r.n, r.shared) for r in got}


def test_groups(spark):
    rows = [box(1, 0, 0, label="SSN"), box(2, 60, 1, label="-"), box(3, 140, 2)]  # gaps of 10 and 30
    rows += [box(4, 0, 100, label="EIN"), box(5, 81, 100)]  # too far apart
    rows += [box(6, 0, 200, label="City"), box(7, 60, 200, label="State")]  # two labels
    rows += [box(8, 0, 300), box(9, 60, 300, label="."), box(10, 60, 303)]  # no label; another band
    rows += [box(11, 0, 400, label="TIN"), box(12, 60, 400, kind="checkbox"), box(13, 60, 401, label="TIN")]  # only boxes for text count
    rows += [box(14, 0, 0, label="A", page=2), box(15, 60, 0, h=17.0, label="A", page=2), box(16, 0, 190, label="Up"), box(17, 10, 0, label="Up", page=3)]
    rows += [box(18, 0, 500, label="Sec", slot="section"), box(19, 55, 500, label="Sec", slot="native_name")]
    rows += [box(20, 0, 600, label="A"), box(21, 40, 600, label="A")]  # one over the other
    assert groups(spark, rows) == {
        "b1": ("g1", 0, 3, "SSN"), "b2": ("g1", 1, 3, "SSN"), "b3": ("g1", 2, 3, "SSN"), "b11": ("g2", 0, 2, "TIN"), "b13": ("g2", 1, 2, "TIN"), "b18": ("g3", 0, 2, "Sec"), "b19": ("g3", 1, 2, "Sec"),
    }


def test_strokes_at_different_heights_are_no_group(spark):
    assert groups(spark, [box(1, 0, 0, label="A"), box(2, 55, 190, label="A")]) == {}


BLANKS = "form_id long, blank_id string, blank_no long, kind string, readonly boolean, scanned boolean, grp string, grp_index long, inside string, right_ string, left_ string, above string, section string, native_name string, width_pt double, height_pt double, max_chars long"


def member(form, grp, k, label="SSN", locked=False, scanned=False, width=50.0, cap=None):
    return (form, f"{grp}{k}", k, "text", locked, scanned, grp, k, "", "", label if k == 0 else "", "", "", "", width, 12.0, cap)


def test_accepted_groups_and_their_keys(spark):
    rows = [member(1, "a", k) for k in range(3)] + [member(1, "b", k) for k in range(2)]  # as many boxes as the number has parts, and not
    rows += [member(2, "a", k, locked=k == 1) for k in range(3)] + [member(3, "a", k, scanned=True) for k in range(3)] + [member(4, "a", k) for k in range(3)]
    rows += [member(5, "a", k) for k in range(2)] + [member(6, "a", 0, label=""), (6, "a1", 1, "text", False, False, "a", 1, "", "", "SSN", "", "", "", 9.0, 9.0, None), member(6, "a", 2)]
    rows += [(7, "x", 1, "text", False, False, None, None, "", "", "City", "", "", "", 9.0, 9.0, None), (7, "y", 2, "checkbox", False, False, None, None, "", "", "City", "", "", "", 9.0, 9.0, None)]
    match = [(f, b, k, e) for f, b, k, e in [(1, "a0", "ssn", True), (1, "a1", "ssn", True), (1, "b0", "ssn", True), (2, "a0", "ssn", True), (3, "a0", "ssn", True), (4, "a0", "ssn", False), (5, "a0", "ein", True), (6, "a1", "ssn", True), (7, "x", "city", True), (7, "y", "city", True)]]
    made = {"blanks": spark.createDataFrame(rows, BLANKS), "match_blank": spark.createDataFrame(match, "form_id long, blank_id string, key string, exact boolean"), "fields": spark.sql(dictionary.values_sql("fields"))}
    accepted = OPERATORS["accept_groups"].apply(spark, **made)
    assert sorted(map(tuple, accepted.collect())) == [(1, "a", "ssn", 3), (5, "a", "ein", 2), (6, "a", "ssn", 3)]
    keys = OPERATORS["blank_keys"].apply(spark, blanks=made["blanks"], accept_groups=accepted, match_blank=made["match_blank"])
    got = {(r.form_id, r.blank_id): (r.key, r.exact, r.grp_index) for r in keys.collect()}
    assert {k: v for k, v in got.items() if k[0] in (1, 6, 7)} == {
        (1, "a0"): ("ssn", True, 0), (1, "a1"): ("ssn", True, 1), (1, "a2"): ("ssn", True, 2), (1, "b0"): ("ssn", True, None),
        (6, "a0"): ("ssn", True, 0), (6, "a1"): ("ssn", True, 1), (6, "a2"): ("ssn", True, 2), (7, "x"): ("city", True, None),
    }
    assert got[2, "a0"] == ("ssn", True, None) and (2, "a1") not in got and got[4, "a0"] == ("ssn", False, None)


@pytest.mark.parametrize(
    "value, key, boxes, want",
    [
        ("123-45-6789", "ssn", [(43, None), (29, None), (58, None)], ["123", "45", "6789"]),
        ("12-3456789", "ein", [(29, None), (99, None)], ["12", "3456789"]),
        ("123456", "ssn", [(50, None), (50, None)], ["123", "456"]),  # not the number's own grouping
        ("12345", "ein", [(0, 1), (0, 1), (0, 2)], ["1", "2", "34"]),  # halves go to the even number; what is left is left
        ("12", "ssn", [(50, None)] * 4, ["1", "2", "", ""]),
        ("abcd", "city", [(50, None), (50, None)], ["ab", "cd"]),
    ],
)
def test_values_over_boxes(spark, value, key, boxes, want):
    rows = [member(1, "a", k, width=float(w), cap=c) for k, (w, c) in enumerate(boxes)]
    got = OPERATORS["distribute"].apply(
        spark, blanks=spark.createDataFrame(rows, BLANKS), match_blank=spark.createDataFrame([(1, "a0", key)], "form_id long, blank_id string, key string"), forms=spark.createDataFrame([(1, "me")], "form_id long, slug string"),
        resolve_value=spark.createDataFrame([("me", key, value)], "slug string, key string, value string"), splits=spark.sql(dictionary.values_sql("splits")),
    )
    assert [r.part for r in got.orderBy("blank_id").collect()] == want


def test_a_groups_value_is_planned_in_parts(spark):
    keys = "form_id long, blank_id string, key string, exact boolean, scanned boolean, grp string, grp_index long, grp_n long"
    made = {
        "blank_keys": (keys, [(1, f"a{k}", "ssn", True, False, "a", k, 3) for k in range(3)] + [(1, "c", "city", True, False, None, None, None), (1, "n", "zip", False, False, None, None, None)]),
        "forms": ("form_id long, slug string", [(1, "me")]), "either_or": ("form_id long, key string", []), "wanted_keys": ("form_id long, key string", []),
        "resolve_value": ("slug string, key string, value string", [("me", "ssn", "123-45-6789"), ("me", "city", "Rome"), ("me", "zip", "1")]), "street_line": ("slug string, street_line string", []),
    }
    frames = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in made.items()} | {n: spark.sql(dictionary.values_sql(n)) for n in ("fields", "splits")}
    assert {r.blank_id: r.value for r in OPERATORS["plan_values"].apply(spark, **frames).collect()} == {"a0": "123", "a1": "45", "a2": "6789", "c": "Rome"}
