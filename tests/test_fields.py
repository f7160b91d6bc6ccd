"""Fields and controls of word documents: golden rows, and random runs against a machine with a stack."""

import random

from formloom.plans.queries import OPERATORS

RUNS = "form_id long, seq long, run_no long, fld_char string, instr string, name string, checked boolean, text string"
CONTROLS = "form_id long, seq long, control_no long, alias string, tag string, type_ string, placeholder boolean, own string, para string"


def text(t):
    return ("", None, None, None, t)


def field(instr, result, name=None, checked=False):
    return [("begin", None, name, checked, ""), ("", instr, None, None, ""), ("separate", None, None, None, ""), *[x if isinstance(x, tuple) else text(x) for x in result], ("end", None, None, None, "")]


def numbered(paragraphs):
    return [(1, seq, k, *r) for seq, runs in enumerate(paragraphs) for k, r in enumerate(runs)]


def fields(spark, rows):
    df = OPERATORS["field_machine"].apply(spark, runs=spark.createDataFrame(rows, RUNS))
    return {(r.seq, r.field_no): (r.kind, r.left_, r.right_, r.inside, r.authoritative, r.value) for r in df.collect()}


def test_fields(spark):
    paragraphs = [
        [text("City: "), *field(" FORMTEXT ", ["   "], "Text1")],
        [*field(" FORMCHECKBOX ", [], "Check1", True), text(" I agree"), text(" to the terms")],
        [text("Zip"), *field("FORM", ["old ", "value"], "zip_code")[:2], ("", "TEXT", None, None, ""), *field("", ["old ", "value"])[2:], text(" State:\t"), *field("formtext", ["OR"], "Dropdown12")],
        [text("On page "), *field("PAGE", ["3"]), text(" of the form")],
        [text("a "), *field(" IF ", ["outer ", *field(" FORMTEXT ", ["inner"], "first"), " rest"]), text("b"), *field(" FORMTEXT ", [], "Box1")],
        [("end", None, None, None, ""), text("Name"), ("begin", None, None, None, ""), ("", "FORMTEXT", None, None, ""), ("separate", None, None, None, ""), text("open")],
    ]
    assert fields(spark, numbered(paragraphs)) == {
        (0, 1): ("text", "City", "", "", False, ""), (1, 1): ("checkbox", "", "I agree to the terms", "", False, "checked"),
        (2, 1): ("text", "Zip", "", "zip_code", True, "old value"), (2, 2): ("text", "Zip State", "", "", False, "OR"),
        (4, 1): ("text", "a", "", "first", True, "inner"), (4, 2): ("text", "a b", "", "Box1", True, ""), (5, 1): ("text", "Name", "", "", False, "open"),
    }


def by_stack(runs):
    """The text and checkbox fields of one paragraph: kind, label and value, in order of their begins."""
    found, stack, outside, whole = [], [], "", ""
    for k, (mark, instr, name, checked, t) in enumerate(runs):
        whole += t or ""
        if mark == "begin":
            stack.append({"k": k, "instr": "", "result": "", "past": False, "before": outside, "end": None, "checked": checked})
            found.append(stack[-1])
        elif mark == "end" and stack:
            stack.pop()["end"] = len(whole)
        elif mark == "separate" and stack:
            stack[-1]["past"] = True
        elif mark == "" and stack:
            stack[-1]["result" if stack[-1]["past"] else "instr"] += (t if stack[-1]["past"] else instr) or ""
        elif mark == "":
            outside += t or ""
    out = []
    for f in sorted(found, key=lambda f: f["k"]):
        kind = "checkbox" if "FORMCHECKBOX" in f["instr"].upper() else "text" if "FORMTEXT" in f["instr"].upper() else None
        after = whole[f["end"] :] if f["end"] is not None else ""
        if kind:
            out.append((kind, f["before"].strip(" :\t") if kind == "text" else "", after.strip(" :\t") if kind == "checkbox" else "", f["result"].strip() if kind == "text" else "checked" if f["checked"] else ""))
    return out


def test_random_runs(spark):
    random.seed(8)
    paragraphs = []
    for _ in range(60):
        marks = random.choices(["begin", "separate", "end", "", ""], k=random.randrange(1, 25))
        paragraphs.append([(m, random.choice([" FORMTEXT ", "FORMCHECKBOX", "PAGE", None]) if m == "" else None, None, random.random() < 0.5, random.choice(["a ", "b:", " c", None]) if m == "" else "") for m in marks])
    got = fields(spark, numbered(paragraphs))
    for seq, runs in enumerate(paragraphs):
        want = by_stack(runs)
        assert [(k, a, b, v) for (_, _), (k, a, b, _, _, v) in sorted((x for x in got.items() if x[0][0] == seq))] == want


def test_controls(spark):
    rows = [
        (1, 0, 1, "Phone", "", "text", True, "Click here", "Phone: Click here"),
        (1, 1, 1, "", "", "text", False, "Rome ", "City: Rome and more"),
        (1, 2, 1, "I am a U.S. citizen", "tick", "checkbox", False, "☒", "☒ I am a U.S. citizen"),
        (1, 3, 1, None, None, "checkbox", False, "☐", "☐"),
        (1, 4, 1, None, "when", "date", False, "01/02/2024", "01/02/2024"),
        (1, 5, 1, None, None, "picture", None, None, "Sign: "),
    ]
    df = OPERATORS["content_controls"].apply(spark, controls=spark.createDataFrame(rows, CONTROLS))
    got = {r.seq: (r.kind, r.left_, r.right_, r.inside, r.native_name, r.authoritative, r.value) for r in df.collect()}
    assert got == {
        0: ("text", "", "", "Phone", "", True, ""), 1: ("text", "City", "", "", "", False, "Rome"), 2: ("checkbox", "", "I am a U.S. citizen", "", "tick", True, "checked"),
        3: ("checkbox", "", "", "", "", False, ""), 4: ("date", "", "", "when", "when", True, "01/02/2024"), 5: ("signature", "Sign", "", "", "", False, ""),
    }
