"""What saved forms leave behind, and what comes of it on the next form of their structure; what a model's reading may change."""

import pytest

from formloom.functions import dictionary
from formloom.plans.queries import OPERATORS

BLANK = "form_id long, blank_id string, blank_no long, kind string, readonly boolean, page long, x0 double, y0 double, grp string, grp_index long, inside string, right_ string, left_ string, above string, section string, row_ string, native_name string"


def blank(form, no, kind="text", readonly=False, grp=None, index=None, **slots):
    return (form, f"b{no}", no, kind, readonly, 1, 10.0 * no, 5.0, grp, index, *[slots.get(c, "") for c in ("inside", "right_", "left_", "above", "section", "row_", "native_name")])


def frames(spark, given):
    made = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in given.items()}
    return made | {n: spark.sql(dictionary.values_sql(n)) for n in ("fields", "choices", "splits", "vetoes", "aliases") if n not in made}


def run(spark, name, made):
    """An operator over the frames at hand; inputs that are not there are worked out."""

    def get(x):
        if x not in made:
            made[x] = OPERATORS[x].apply(spark, **{y: get(y) for y in OPERATORS[x].inputs})
        return made[x]

    return OPERATORS[name].apply(spark, **{x: get(x) for x in OPERATORS[name].inputs}).collect()


EDIT = "form_id long, blank_id string, slug string, action string, value string, seq long"
PRINT = "form_id long, fingerprint string"


def test_saves_and_forgetting(spark):
    edits = [(1, "b1", "ann", "save", "", 1), (2, "b1", "ann", "forget", "", 2), (1, "b1", "ann", "save", "", 3), (2, "b1", "bob", "save", "", 4), (3, "b1", "cy", "save", "", 5), (3, "b1", "cy", "forget", "", 6)]
    made = frames(spark, {"edits": (EDIT, edits), "fingerprints": (PRINT, [(1, "f"), (2, "f"), (3, "g")])})
    assert sorted(map(tuple, run(spark, "forget_form", made))) == [("f", 1, "ann", 3), ("f", 2, "bob", 4)]  # forgotten by structure


def remembered(spark):
    blanks = [blank(1, k, "checkbox" if k in (4, 5) else "text") for k in range(1, 9)] + [blank(2, k, "checkbox" if k in (4, 5) else "text") for k in range(1, 9)]
    entries = [(f, f"b{k}", key, value) for f in (1, 2) for k, key, value in [(1, "zip", "1"), (2, "city", "Rome"), (3, "tax_classification", "c_corp"), (4, None, "checked"), (5, None, None), (6, None, None), (7, "state", "OR"), (8, "phone", None)]]
    hand = [(1, "b5", "set", "checked"), (1, "b6", "set", "typed"), (1, "b7", "clear", ""), (1, "b2", "set", "typed")]
    return frames(spark, {
        "forget_form": ("fingerprint string, form_id long, slug string, seq long", [("f", 2, "bob", 1), ("f", 1, "ann", 2)]),
        "apply_reading": ("form_id long, blank_id string, key string, value string", entries), "blanks": (BLANK, blanks), "apply_edits": ("form_id long, blank_id string, action string, value string", hand),
        "offsets": ("form_id long, blank_id string, dx double, dy double", [(1, "b1", 2.0, 0.0), (1, "b2", 0.0, 0.0), (2, "b3", 9.0, 9.0)]),
        "annotations": ("form_id long, region_no long, page long, kind string, x0 double, y0 double", [(1, 1, 2, "date", 10.4, 20.0), (1, 2, 2, "text", 0.0, 0.0), (2, 3, 1, "signature", 0.0, 0.0)]),
    })


def test_what_a_save_leaves(spark):
    got = {(r.part, r.slug, r.blank_id, r.key, r.kind, r.x, r.y) for r in run(spark, "remember_form", remembered(spark))}
    assert got == {
        ("keys", "", "b1", "zip", None, None, None), ("checked", "ann", "b5", None, None, None, None), ("cleared", "ann", "b7", None, None, None, None),
        ("moved", "", "b1", None, None, 2.0, 0.0), ("placed", "", "~hand1", None, "date", 10.4, 20.0),
    }  # fmt: skip  no typed text, no answer's tick, nothing of the earlier save but what is its identity's own


MEMORY = "fingerprint string, part string, slug string, blank_id string, key string, page long, kind string, x double, y double, seq long"


def keyed(blank_id, key):
    return ("f", "keys", "", blank_id, key, None, None, None, None, 1)


def test_last_time_over_a_fresh_plan(spark):
    blanks = [blank(1, 1), blank(1, 2), blank(1, 3, readonly=True), blank(1, 4, "checkbox"), blank(1, 5, "checkbox"), blank(1, 6), blank(1, 7, left_="Preparer or Translator"), blank(1, 8, section="Employers Only")]
    blanks += [blank(1, 10 + k, grp="g1", index=k) for k in range(3)] + [blank(1, 20 + k, grp="g2", index=k) for k in range(3)] + [blank(1, 30, grp="g3", index=0), blank(1, 31, grp="g3", index=1), blank(1, 40), blank(1, 41), blank(1, 42), blank(1, 43, row_="Employers name")]
    plan = [(1, b[1], None, "there" if b[1] in ("b2", "b6", "b21") else None) for b in blanks]
    memory = [keyed("b1", "zip"), keyed("b2", "city"), keyed("b3", "city"), keyed("b7", "city"), keyed("b8", "city"), keyed("b10", "ssn"), keyed("b20", "ssn"), keyed("b30", "zip"), keyed("b40", "ein"), keyed("b41", "signature"), keyed("b42", "phone"), keyed("b43", "city"), keyed("b6", "city")]
    memory += [("f", part, slug, b, None, None, None, None, None, 1) for part, slug, b in [("cleared", "me", "b6"), ("cleared", "other", "b1"), ("checked", "me", "b4"), ("checked", "me", "b5"), ("checked", "other", "b4")]]
    made = frames(spark, {
        "forms": ("form_id long, slug string", [(1, "me")]), "fingerprints": (PRINT, [(1, "f"), (2, "g")]), "remember_form": (MEMORY, memory), "plan_entries": ("form_id long, blank_id string, key string, value string", plan), "blanks": (BLANK, blanks),
        "either_or": ("form_id long, key string", [(1, "ein")]), "resolve_value": ("slug string, key string, value string", [("me", k, v) for k, v in [("zip", "97"), ("city", "Rome"), ("ssn", "123-45-6789"), ("ein", "12"), ("signature", "png")]]),
        "tick_choices": ("form_id long, blank_id string, choice string, decision string", [(1, "b5", "filing_status", "not this one")]),
    })
    got = {r.blank_id: (r.key, r.value) for r in run(spark, "apply_memory", made)}
    assert got == {"b1": ("zip", "97"), "b6": (None, None), "b4": (None, "checked"), "b10": ("ssn", "123"), "b11": ("ssn", "45"), "b12": ("ssn", "6789")}


def test_placed_blanks_come_back(spark):
    memory = [("f", "placed", "", "~1", None, 1, "signature", 10.4, 5.0, 1), ("f", "placed", "", "~2", None, 1, "date", 10.4, 5.0, 1), ("f", "keys", "", "b1", "zip", None, None, None, None, 1)]
    made = frames(spark, {"remember_form": (MEMORY, memory), "fingerprints": (PRINT, [(1, "f"), (2, "f"), (3, "g")]), "blanks": (BLANK, [blank(1, 1, "signature"), blank(2, 9, "signature")])})
    assert sorted((r.form_id, r.kind) for r in run(spark, "restore_placed", made)) == [(1, "date"), (2, "date"), (2, "signature")]


READ = [
    # kind, grp, the plan's key and value, cleared by hand, the reading's key, what comes of it
    ("agrees", {}, "zip", "97", False, "zip", ("zip", "97", None)),
    ("other", {}, "zip", "97", False, "city", ("city", "Rome", None)),
    ("clears", {}, "zip", "97", False, None, (None, None, None)),
    ("nothing to clear", {}, "phone", None, False, None, ("phone", None, None)),
    ("fills", {}, None, None, False, "city", ("city", "Rome", None)),
    ("locked", {"readonly": True}, None, None, False, "city", (None, None, None)),
    ("box", {"kind": "checkbox"}, None, "checked", False, None, (None, "checked", None)),
    ("group", {"grp": "g1", "index": 0}, None, None, False, "ssn", (None, None, None)),
    ("picture", {}, None, None, False, "signature", (None, None, None)),
    ("choice", {}, None, None, False, "filing_status", (None, None, None)),
    ("ruled out", {}, None, None, False, "ein", (None, None, None)),
    ("emptied", {}, "zip", None, True, "city", ("zip", None, None)),
    ("not stored", {}, None, None, False, "email", (None, None, "email")),
    ("locked away", {}, None, None, False, "dob", (None, None, None)),
]


def test_what_a_reading_may_change(spark):
    form = "form_id long, blank_id string"
    made = frames(spark, {
        "plan_entries": (f"{form}, key string, value string", [(1, f"b{k}", r[2], r[3]) for k, r in enumerate(READ)]), "blanks": (BLANK, [blank(1, k, **r[1]) for k, r in enumerate(READ)]), "forms": ("form_id long, slug string", [(1, "me")]),
        "parse_replies": (f"{form}, key string, reason string", [(1, f"b{k}", r[5], "says so" if k % 2 else "") for k, r in enumerate(READ)]), "apply_edits": (f"{form}, action string, value string", [(1, f"b{k}", "clear", "") for k, r in enumerate(READ) if r[4]]),
        "either_or": ("form_id long, key string", [(1, "ein")]), "resolve_value": ("slug string, key string, value string", [("me", "zip", "97"), ("me", "city", "Rome"), ("me", "ein", "1")]),
        "has_key": ("slug string, key string", [("me", "zip"), ("me", "city"), ("me", "ein"), ("me", "dob")]),
    })
    got = {r.blank_id: ((r.key, r.value, r.missing_key), r.note) for r in run(spark, "apply_reading", made)}
    assert {READ[int(b[1:])][0]: x for b, (x, _) in got.items()} == {r[0]: r[6] for r in READ}
    notes = {READ[int(b[1:])][0]: note for b, (_, note) in got.items() if note}
    assert notes == {"other": "corrected by the model from zip: says so", "clears": "left empty by the model", "fills": "filled by the model", "not stored": "the model wants Email here, which is not stored"}


REPLIES = [
    ('Well. {"blanks": [{"id": "q1", "key": "city", "why": "call 555-0100"}, {"id": "q2", "key": null}, {"id": "q9", "key": "city"}, {"id": "q3", "key": "nope"}], "questions": ["Born 1/2/1990?"]} Bye}', None),
    ('{"blanks": [{"id": "q1", "key": "zip"}, {"id": "q1", "key": "null", "why": "' + "x" * 300 + '"}], "questions": [' + ", ".join(f'"{"q" * 300}{k}"' for k in range(20)) + "]}", None),
    ("no braces", "the reply holds no JSON"),
    ('{"blanks": [', "the reply holds no JSON"),
    ('{"other": 1}', None),
    (None, "the reply holds no JSON"),
]


def test_replies(spark):
    made = frames(spark, {"replies": ("form_id long, text string", [(k, t.replace("Bye}", "Bye") if t else t) for k, (t, _) in enumerate(REPLIES)]), "question_ids": ("form_id long, blank_id string, qid string", [(k, f"b{q}", f"q{q}") for k in range(6) for q in (1, 2, 3)])})
    got = {(r.form_id, r.blank_id): (r.key, r.reason) for r in run(spark, "parse_replies", made)}
    assert got == {(0, "b1"): ("city", "call [answer]"), (0, "b2"): (None, ""), (1, "b1"): (None, "x" * 160)}
    asked = run(spark, "reply_questions", made)
    assert sorted((r.form_id, r.ord, r.question) for r in asked if r.refused is None) == [(0, 1, "Born [answer]?")] + [(1, k, "q" * 200) for k in range(1, 13)]
    assert {r.form_id: r.refused for r in asked if r.refused} == {k: why for k, (_, why) in enumerate(REPLIES) if why}


@pytest.mark.parametrize(
    "spec, want",
    [
        ("f#1-3@90", [(1, 90), (2, 90), (3, 90)]), ("f", [(1, 0), (2, 0), (3, 0)]), ("f#2-", [(2, 0), (3, 0)]), ("f#3,1, 1 - 2", [(3, 0), (1, 0), (1, 0), (2, 0)]), ("f#2@-90", [(2, -90)]), ("f#,", []),
        ("f#1-99", "the file has no such pages"), ("f#0", "the file has no such pages"), ("f#2-1", "the file has no such pages"), ("f#1,x", "the pages are no numbers"), ("f#-2", "the pages are no numbers"),
        ("f#1@45", "the turn is no quarter"), ("f#1@half", "the turn is no number"), ("#1", "no file"), ("", "no file"),
    ],
)
def test_page_specs(spark, spec, want):
    made = frames(spark, {"page_specs": ("form_id long, spec string", [(1, spec)]), "forms": ("form_id long, page_count long", [(1, 3)])})
    rows = sorted(run(spark, "page_spec", made), key=lambda r: r.ord or 0)
    assert [r.reason for r in rows] == [want] if isinstance(want, str) else [(r.page, r.turn) for r in rows] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("12 34 56", "[answer]"), ("(555) 010-0100 or 12", "([answer] or 12"), ("é.ü@x-y.org.", "[answer]."), ("a@b", "a@b"), ("1/2/34 1/2", "[answer] 1/2"), ("1-2", "1-2"), ("OMB No. 1615-0047", "OMB No. [answer]"), ("x 1, 2, 3", "x 1, 2, 3"),
    ],
)
def test_answer_shapes(spark, text, want):
    assert run(spark, "scrub_shapes", frames(spark, {"documents": ("doc_id long, text string", [(1, text)])}))[0].text == want


@pytest.mark.parametrize(
    "text, want",
    [("Email: a b", "Email: [answer]"), ("A: x  B: y\tC", "A: [answer]  B: [answer]\tC"), ("A: b: c", "A: b: [answer]"), ("A: ____", "A: ____"), ("A:", "A:"), ("A:b\n", "A: [answer]\n"), ("no colon", "no colon")],
)
def test_answers_after_colons(spark, text, want):
    assert run(spark, "scrub_stream", frames(spark, {"gap_lines": ("form_id long, seq long, text string", [(1, 1, text)])}))[0].text == want
