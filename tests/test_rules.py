"""Operators on small frames made by hand, with the results that the rules ask for."""

import random

import pytest

from formloom.operators import trees
from formloom.plans.checks import CHECKS
from formloom.plans.queries import OPERATORS


def apply(spark, name, **tables):
    frames = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in tables.items()}
    return sorted((tuple(r) for r in OPERATORS[name].apply(spark, **frames).collect()), key=repr)


def test_one_value_for_a_key_in_order_of_the_tiers(spark):
    schema = "slug string, key string, value string"
    got = apply(
        spark, "resolve_value",
        stored_value=(schema, [("a", "city_state_zip", "stored"), ("a", "city", "Rome"), ("b", "date_today", "by hand")]),
        derived_values=(schema, [("a", "date_today", "03/09/2024"), ("b", "date_today", "03/09/2024")]),
        composite_value=(schema, [("a", "city_state_zip", "put together"), ("b", "city_state_zip", "put together")]),
    )
    assert got == [("a", "city", "Rome"), ("a", "city_state_zip", "stored"), ("a", "date_today", "03/09/2024"), ("b", "city_state_zip", "put together"), ("b", "date_today", "by hand")]


def test_stored_tiers(spark):
    rows = [("a", "city", "x", "vault"), ("a", "city", "y", "values"), ("a", "city", "z", "once"), ("a", "zip", "v", "vault"), ("a", "state", "", "once"), ("a", "state", "s", "values")]
    values = ("slug string, key string, value string, tier string", rows)
    assert apply(spark, "stored_value", identity_values=values) == [("a", "city", "z"), ("a", "state", "s"), ("a", "zip", "v")]
    assert apply(spark, "peek_value", identity_values=values) == [("a", "city", "z"), ("a", "state", "s")]


def test_overlays(spark):
    key, value = "form_id long, blank_id string", ", value string"
    got = apply(
        spark, "overlay_precedence",
        plan_entries=(key + ", key string" + value, [(1, "agrees", "k", "p"), (1, "cleared", "k", "p"), (1, "filled", None, None), (1, "hand", "k", "p"), (1, "wiped", "k", "p"), (1, "memory", "k", "p"), (1, "both", "k", "p"), (1, "none", None, None)]),
        apply_reading=(key + ", key string" + value, [(1, "agrees", "k", "p"), (1, "cleared", None, None), (1, "filled", "j", "r"), (1, "hand", "j", "r"), (1, "both", "j", "r"), (1, "memory", "k", "p")]),
        apply_memory=(key + value, [(1, "memory", "m"), (1, "both", "m"), (1, "cleared", "m")]),
        apply_edits=(key + ", action string" + value, [(1, "hand", "set", "h"), (1, "wiped", "clear", "")]),
    )
    assert {b: (v, s) for _, b, v, s in got} == {
        "agrees": ("p", "plan"), "cleared": (None, "model"), "filled": ("r", "model"), "hand": ("h", "hand"), "wiped": (None, "hand"),
        "memory": ("m", "memory"), "both": ("r", "model"), "none": (None, "plan"),
    }


def forest():
    """A chain of 80 nodes, a tree, a self-parent with a child, a cycle of three, a parent that is not there."""
    rows = [(1, k, k - 1 if k else None) for k in range(80)]
    rows += [(2, 1, None), (2, 2, 1), (2, 3, 1), (2, 4, 3), (3, 5, 5), (3, 6, 5), (4, 1, 2), (4, 2, 3), (4, 3, 1), (4, 9, 1), (5, 7, 99), (5, 8, 7)]
    return rows


def test_field_roots_to_any_depth(spark):
    got = {(f, n): (root, depth) for f, n, root, depth in apply(spark, "field_roots", field_nodes=("form_id long, node long, parent long", forest()))}
    for k in range(80):
        assert got[1, k] == ((0, k) if k <= trees.MAX_DEPTH else (None, None))
    assert (got[2, 1], got[2, 2], got[2, 4]) == ((1, 0), (1, 1), (1, 2))
    assert {got[3, 5], got[3, 6], got[4, 1], got[4, 2], got[4, 3], got[4, 9]} == {(None, None)}
    assert got[5, 7] == (7, 0) and got[5, 8] == (7, 1)


def test_field_types_come_from_eight_levels_up(spark):
    rows = [(1, k, k - 1 if k else None, "Tx" if k == 0 else None) for k in range(12)] + [(2, 1, None, "Btn"), (2, 2, 1, "Tx"), (2, 3, 2, None), (3, 1, 1, None)]
    got = {(f, n): ft for f, n, ft in apply(spark, "field_inherit", field_nodes=("form_id long, node long, parent long, ft string", rows))}
    assert [got[1, k] for k in range(12)] == ["Tx"] * 9 + [None] * 3
    assert (got[2, 1], got[2, 2], got[2, 3], got[3, 1]) == ("Btn", "Tx", "Tx", None)


def test_pruned_trees_keep_all_ancestors(spark):
    got = apply(spark, "prune_fields", field_nodes=("form_id long, node long, parent long", forest()), kept_widgets=("form_id long, node long", [(1, 70), (2, 4), (3, 6), (4, 9), (5, 8)]))
    assert got == sorted([(1, k) for k in range(71)] + [(2, 1), (2, 3), (2, 4), (3, 5), (3, 6), (4, 1), (4, 2), (4, 3), (4, 9), (5, 7), (5, 8)], key=repr)


WORD = "form_id long, page long, line_no long, word_no long, text string, x0 double, y0 double, x1 double, y1 double"


def page(lines, form=1, number=1):
    return [(form, number, n, k, w, 10.0 * k, 12.0 * n, 10.0 * k + 8, 12.0 * n + 10) for n, line in enumerate(lines) for k, w in enumerate(line.split())]


def test_needles_of_any_length(spark):
    rows = page(["say 123 45 6789 to us", "Call Anna-Maria Lindqvist von", "der Heide (today), please", "12345", "6789 and 123-45-6789", "aa aa aa"])
    needles = [(1, "123-45-6789"), (2, "anna maria lindqvist von der heide"), (3, "... "), (4, None), (5, "12345 6789"), (6, "a-a a.a"), (7, "us"), (8, "today please 1234")]
    got = [(i, line, x0, x1) for _, _, line, i, x0, x1 in apply(spark, "find_text", words=(WORD, rows), benchmark=("item_id long, text string", needles))]
    same = [(0, 10.0, 38.0), (3, 0.0, 8.0), (4, 20.0, 28.0)]  # three ways to write one number
    want = [(i, *x) for i in (1, 5) for x in same] + [(2, 1, 0.0, 38.0), (6, 5, 0.0, 18.0), (6, 5, 10.0, 28.0), (7, 0, 50.0, 58.0)]
    assert sorted(got) == sorted(want)


def test_words_near_one_height_are_one_line(spark):
    random.seed(13)
    words = [(1, 1, 0, k, f"w{k}", float(x), y, x + 9.0, y + h) for k, (x, y, h) in enumerate([(0, 20.0, 10), (10, 20.3, 10), (20, 24.4, 10), (30, 26.0, 10), (40, 60.0, 10), (50, 59.0, 12), (60, 200.0, 10)])]
    words += [(2, 1, 0, k, f"v{k}", random.uniform(0, 500), random.uniform(0, 120), 0.0, 0.0) for k in range(150)]
    words = [(f, p, n, k, t, x0, y0, x1, y1 if f == 1 else y0 + random.uniform(6, 14)) for f, p, n, k, t, x0, y0, x1, y1 in words]
    want = {}
    for form in (1, 2):
        anchors, members = [], []
        for w in sorted((w for w in words if w[0] == form), key=lambda w: ((w[6] + w[8]) / 2, w[5])):
            for n in reversed(range(len(anchors))):
                a = anchors[n]
                if abs((w[6] + w[8]) / 2 - (a[6] + a[8]) / 2) <= 0.45 * min(w[8] - w[6], a[8] - a[6]):
                    members[n].append(w)
                    break
            else:
                anchors.append(w)
                members.append([w])
        for line, ws in enumerate(sorted(members, key=lambda ws: min(w[6] for w in ws))):
            want |= {(form, w[3]): line for w in ws}
    got = {(f, k): line for f, _, k, _, line in apply(spark, "line_cluster", words=(WORD, words))}
    assert got == want and got[1, 0] == got[1, 1] != got[1, 3]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_checks_are_not_the_operators_own_statements(name):
    from formloom.functions.dialect import DUCK

    op = OPERATORS[name]
    assert op.frame or op.sql(DUCK).split() != CHECKS[name].split()


def test_json_carries_all_keys_and_any_text(spark):
    values = [("a", "city", 'St. "Q" \\ {x}'), ("a", "zip", "1"), ("b", "phone", "é\n"), ("b", "zip", ""), ("b", "ssn", None)]
    assert apply(spark, "identity_json", stored_value=("slug string, key string, value string", values)) == sorted(values[:3], key=repr)
    keys = [(1, f"b{k}", f"k{k}") for k in range(9)] + [(2, "b1", None)]
    assert apply(spark, "memory_json", remember_form=("form_id long, blank_id string, key string", keys)) == keys[:9]


def test_redaction_keeps_pages_without_a_region_and_refuses_the_rest(spark):
    forms = ("form_id long, page_count long", [(1, 2), (2, 1), (3, 1), (4, 3)])
    regions = ("form_id long, region_no long, page long", [(1, 1, 2), (1, 2, 2), (2, 5, 7), (2, 4, 0), (2, 1, 1), (4, 1, None), (9, 1, 1)])
    runs = ("form_id long, reason string, rebuilt long", [(1, None, 1), (2, "no page 0", 0), (3, "nothing to black out", 0), (4, "no page ?", 0)])
    assert apply(spark, "redaction_runs", forms=forms, regions=regions) == runs[1]
    blanks = ("form_id long, blank_id string, page long", [(1, "a", 1), (1, "b", 2), (2, "c", 1), (3, "d", 1), (9, "e", 2)])
    words = ("form_id long, page long, line_no long, word_no long, text string", [(1, 1, 0, 0, "x"), (1, 1, 0, 1, ""), (1, 2, 0, 0, "y"), (2, 2, 0, 0, "z"), (1, 1, 0, 0, "x")])
    assert apply(spark, "redact_pages", blanks=blanks, regions=regions, redaction_runs=runs) == [(1, "a", 1)]
    assert apply(spark, "redact_words", words=words, regions=regions, redaction_runs=runs) == [(1, 1, 0, 0, "x"), (1, 1, 0, 0, "x"), (1, 1, 0, 1, "")]
    got = apply(spark, "redaction_counts", blanks=blanks, words=words, regions=regions, redaction_runs=runs)
    assert got == [(1, None, 1, 1, 1, 3, 1), (2, "no page 0", 0, 0, 0, 0, 0), (3, "nothing to black out", 0, 0, 0, 0, 0), (4, "no page ?", 0, 0, 0, 0, 0)]


def test_calculation_order_loses_what_is_gone(spark):
    order = ("form_id long, pos long, node long", [(1, 3, 7), (1, 1, 8), (1, 2, 9), (1, 2, 5), (2, 1, 7), (None, 1, 7)])
    assert apply(spark, "calculation_order", calc_order=order, prune_fields=("form_id long, node long", [(1, 7), (1, 5), (1, 9), (2, 8)])) == [(1, 1, 5), (1, 2, 9), (1, 3, 7)]


def test_changes_refused_and_names_out_of_step(spark):
    fields = ("key string, sensitive boolean", [("ssn", True), ("city", False), ("status", False)])
    choices = ("choice string, answer string", [("status", "single"), ("status", "joint")])
    asked = ("slug string, key string, value string", [("a", "ssn", "1"), ("a", "city", "x"), ("a", "nope", "x"), ("a", "status", "single"), ("a", "status", "Single"), ("a", None, "x"), ("a", "status", None)])
    got = {(k, v): r for _, k, v, r in apply(spark, "route_sensitive", asked_changes=asked, fields=fields, choices=choices)}
    assert got == {("ssn", "1"): "sensitive", ("city", "x"): None, ("nope", "x"): "unknown key", ("status", "single"): None, ("status", "Single"): "not an answer", (None, "x"): "unknown key", ("status", None): "not an answer"}
    got = apply(spark, "manifest_check", sensitive_manifest=("slug string, name string", [("a", "a/x"), ("a", "a/y"), ("a", "a/y"), ("a", None)]), manifest=("name string", [("a/x",), ("b/z",), ("b/z",), (None,)]))
    assert got == [("a/y", False, True), ("b/z", True, False)]
