"""Decisions for known labels, restated by hand."""

import pytest

from formloom.functions import text as T
from formloom.functions.dialect import SPARK
from formloom.plans.queries import OPERATORS
from formloom.functions import dictionary


def frame(spark, rows):
    cols = "form_id long, blank_id string, kind string, readonly boolean, inside string, right_ string, left_ string, above string, native_name string, section string, width_pt double, height_pt double, row_ string, authoritative boolean, max_chars long, grp string"
    full = [(1, f"b{k}", r.get("kind", "text"), False, r.get("inside", ""), "", r.get("left_", ""), r.get("above", ""), r.get("native_name", ""), r.get("section", ""), r.get("width", 300.0), 12.0, r.get("row_", ""), r.get("authoritative", False), r.get("max_chars"), r.get("grp")) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, cols)


def match(spark, rows, values=(), exact=False):
    from formloom.plans.registry import run

    blanks = frame(spark, rows)
    made = {"blanks": blanks, "forms": spark.createDataFrame([(1, "me")], "form_id long, slug string"), "peek_value": spark.createDataFrame(list(values), "slug string, key string, value string")}
    for n in ("aliases", "vetoes"):
        made[n] = spark.sql(dictionary.values_sql(n))

    def get(name):
        if name not in made:
            op = OPERATORS[name]
            made[name] = op.apply(spark, **{x: get(x) for x in op.inputs})
        return made[name]

    return {r.blank_id: (r.key, r.exact) if exact else r.key for r in get("match_blank").collect()}


CASES = [
    ({"left_": "1 Name of entity/individual. An entry is required."}, "full_name"),
    ({"left_": "2 Business name/disregarded entity name, if different from above"}, "business_name"),
    ({"left_": "6 City, state, and ZIP code"}, "city_state_zip"),
    ({"left_": "Social security number"}, "ssn"),
    ({"left_": "Employer identification number"}, "ein"),
    ({"left_": "Last name"}, "last_name"),
    ({"left_": "Home address"}, "address1"),
    ({"left_": "Daytime phone number"}, "phone"),
    ({"left_": "Date of Birth"}, "dob"),
    ({"left_": "(a) First name and middle initial"}, "first_middle"),
    ({"left_": "Requester's name and address (optional)"}, None),
    ({"left_": "Preparer or Translator ZIP Code"}, None),
    ({"left_": "Employer's Telephone Number"}, None),
    ({"left_": "Spouse's Social Security Number"}, None),
    ({"left_": "Enter the amount from line 7"}, None),
    ({"left_": "Expiration Date"}, None),
    ({"left_": "Date", "section": "Section 2. Employer Review and Verification"}, None),
    ({"left_": "City", "section": "Employers Only"}, None),
    ({"inside": "Last name", "left_": "City"}, "last_name"),
    ({"kind": "signature"}, "signature"),
]


def test_cases(spark):
    got = match(spark, [c for c, _ in CASES])
    assert {k: got.get(f"b{k}") for k in range(len(CASES))} == {k: key for k, (_, key) in enumerate(CASES)}


MORE = [
    ({"left_": "Social securty number"}, ("ssn", False)),  # near enough to offer
    ({"left_": "Total stated on line 7"}, None),
    ({"left_": "E-mail adress"}, ("email", True)),  # a shorter alias is there word for word
    ({"inside": "Enter Last Name. This is the last name of the employer"}, ("last_name", True)),
    ({"inside": "Enter Last Name. This is the last name of the employer", "authoritative": True}, ("last_name", True)),  # the first sentence holds the alias
    ({"inside": "If this page was completed by somebody else the name of the witness", "authoritative": True}, None),
    ({"inside": "If this page was completed by somebody else the name of the witness"}, None),  # too near before or in the alias
    ({"inside": "Name to be written in full as in the passport by each new employer", "authoritative": True}, None),
    ({"inside": "Name to be written in full as in the passport by each new employer"}, ("full_name", True)),
    ({"left_": "City", "row_": "Employers name and address"}, None),
    ({"left_": "City", "row_": "The name and address of employers"}, ("city", True)),
    ({"left_": "Employer identification number", "row_": "Employers only"}, None),
    ({"left_": "Employer identification number", "row_": "Employer identification number"}, ("ein", True)),
    ({"native_name": "City"}, ("city", True)),
    ({"left_": "Section 1., Enter City or Town.", "section": "Section 1. Employee Information and Attestation: Employees must complete and sign"}, ("city", True)),
    ({"left_": "Signature Date mm/dd/yyyy"}, ("date_today", True)),
    ({"left_": "Enter your EIN"}, ("ein", True)),
    ({"left_": "Enter Other Last Names Used (if any)"}, None),
]


def test_near_matches_sentences_and_rows(spark):
    got = match(spark, [c for c, _ in MORE], exact=True)
    assert {k: got.get(f"b{k}") for k in range(len(MORE))} == {k: key for k, (_, key) in enumerate(MORE)}


def test_what_fits_decides(spark):
    held = [("me", "address1", "1200 Maple Avenue, Springfield"), ("me", "state", "OR")]
    rows = [{"left_": "Address or state", "width": 300.0}, {"left_": "Address or state", "width": 12.0}, {"left_": "Address or state", "width": 12.0, "grp": "g1"}, {"left_": "Address or state", "width": 300.0, "max_chars": 2}]
    got = match(spark, rows, held)
    assert got["b1"] == got["b3"] == "state" and got["b0"] == got["b2"]  # a box of a group holds a part only


@pytest.mark.parametrize(
    "text, tokens",
    [("5Address (number, street)", ["address", "number", "street"]), ("OnlyEmployer's use", ["only", "employer", "s", "use"]), ("Tel. no.", ["telephone", "number"]), ("José", ["jos"]), ("", []), ("12b Apt", ["b", "apartment"])],
)
def test_normalize(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "label string")
    assert df.selectExpr(f"{T.normalize(SPARK, 'label')} AS t").first().t == tokens


@pytest.mark.parametrize("value, shown", [("", ""), ("1234", "****"), ("123456789", "*****6789")])
def test_mask(spark, value, shown):
    assert spark.createDataFrame([(value,)], "v string").selectExpr(f"{T.mask('v')} AS m").first().m == shown


def test_scrub(spark):
    df = spark.createDataFrame([("mail a.b@c.org on 3/4/2024 about 123456",)], "v string")
    assert df.selectExpr(f"{T.scrub_shapes(SPARK, 'v')} AS m").first().m == "mail [answer] on [answer] about [answer]"
