"""The dictionary of fields: what each is called, the words that rule it out, and the answers of its choices."""

from __future__ import annotations

import re

# Fixed values. Words that name another party's block.
NOT_YOURS = (
    "employer", "employers", "employer s", "preparer", "translator", "requester", "witness", "notary", "spouse", "officer",
    "co applicant", "co signer", "landlord", "guarantor", "beneficiary", "physician", "provider", "rehire", "reverification",
    "re verification", "office use",
)
# Fixed values. Blocks that nobody fills.
HARD_PHRASES = ("office use", "official use", "do not write", "for employer use", "employer use")
# Fixed values. Short forms in labels.
ABBREVIATIONS = {"no": "number", "num": "number", "nbr": "number", "addr": "address", "tel": "telephone", "ph": "phone", "st": "street", "apt": "apartment"}

# Fixed values. key | title | aliases | own vetoes, in the order of the schema.
FIELD_ROWS = """
full_name | Full name | name; full name; your name; print name; printed name; name of entity individual; name of entity/individual; name as shown on your income tax return; legal name; applicant name; employee name; individual name; name of individual; print or type name; name of taxpayer | business name; requester; entity name; employer name; spouse; preparer; trade name; dba; witness; officer
first_name | First name | first name; given name; first | last name only; other; former; maiden; previous
middle_initial | Middle initial | middle initial; mi; middle |
last_name | Last name | last name; surname; family name; last | other; former; maiden; previous
first_middle | First name and middle initial | first name and middle initial |
business_name | Business name | business name; business name disregarded entity name; disregarded entity name; trade name; dba; doing business as; company; company name; firm name | requester
address1 | Street address | address; street address; mailing address; home address; address number street and apt or suite no; street; address street number and name; number street and apt or suite no; address line 1; present address | requester; email; e mail; employer address; city
address2 | Apartment or suite | apt; apartment; suite; unit; apt or suite no; address line 2 |
city | City | city; town; city or town | state; zip
state | State | state; province | city; zip; statement
zip | ZIP code | zip; zip code; postal code; postcode |
city_state_zip | City, state and ZIP | city state and zip code; city town state and zip code; city state zip; city or town state and zip code |
country | Country | country |
phone | Phone | phone; telephone; phone number; telephone number; daytime phone; mobile; cell; contact number |
email | Email | email; e mail; email address; e mail address |
website | Website | website; web site; url; homepage |
job_title | Job title | title; job title; position; occupation; role |
ssn | Social Security number | social security number; ssn; social security no; social security; ss number; taxpayer identification number; tin; your social security number |
ein | Employer Identification number | employer identification number; ein; employer identification no; federal tax id; fein; taxpayer identification number; tin; tax id number |
dob | Date of birth | date of birth; dob; birth date; birthdate |
drivers_license | Driver's licence | driver s license; drivers license; license number; driver s license number; dl number; state id number |
bank_account | Bank account number | account number; bank account number; checking account number; deposit account number | list account number; requester
bank_routing | Bank routing number | routing number; aba number; aba routing number; bank routing number |
tax_classification | Tax classification | federal tax classification; tax classification |
filing_status | Filing status | filing status; federal filing status |
citizenship | Citizenship status | citizenship status; immigration status; citizenship |
llc_tax_code | LLC tax classification code | enter the tax classification; llc enter the tax classification; tax classification c c corporation s s corporation p partnership |
date_today | Today's date | date; date signed; today s date; dated; date of signature | expiration; expires; exp; hire; rehire; termination; reverification; birth; issue; issued; effective; employment; start; end; number; ein; identification
signature | Signature | signature; sign here; signature of; authorized signature; applicant s signature; employee s signature; your signature | date; dated; printed name; print name; title
"""
# Fixed values. Vetoes of all fields that a field is exempt from.
ALLOWED = {"ein": ("employer", "employer s")}
# Fixed values. Keys of the sensitive tier, keys that are images, box groups of split numbers, keys that stand for each other.
SENSITIVE = ("ssn", "ein", "dob", "drivers_license", "bank_account", "bank_routing", "citizenship", "signature")
IMAGES = ("signature",)
SPLITS = {"ssn": (3, 2, 4), "ein": (2, 7)}
ALTERNATIVES = (("ein", "ssn"),)
# Fixed values. choice | answer | title | words that open its box | code.
CHOICE_ROWS = """
tax_classification | individual | Individual / sole proprietor | individual sole proprietor; individual; sole proprietor |
tax_classification | c_corp | C corporation | c corporation; c corp |
tax_classification | s_corp | S corporation | s corporation; s corp |
tax_classification | partnership | Partnership | partnership |
tax_classification | trust_estate | Trust / estate | trust estate; trust; estate |
tax_classification | llc_c | LLC, taxed as a C corporation | llc; limited liability company | C
tax_classification | llc_s | LLC, taxed as an S corporation | llc; limited liability company | S
tax_classification | llc_p | LLC, taxed as a partnership | llc; limited liability company | P
filing_status | single | Single | single |
filing_status | married_separately | Married filing separately | single or married filing separately; married filing separately |
filing_status | married_jointly | Married filing jointly | married filing jointly |
filing_status | qualifying_surviving_spouse | Qualifying surviving spouse | married filing jointly or qualifying surviving spouse; qualifying surviving spouse; qualifying widow |
filing_status | head_of_household | Head of household | head of household |
citizenship | citizen | U.S. citizen | a citizen of the united states; citizen of the united states; u s citizen |
citizenship | noncitizen_national | Noncitizen national of the U.S. | a noncitizen national; noncitizen national |
citizenship | permanent_resident | Lawful permanent resident | a lawful permanent resident; lawful permanent resident; permanent resident |
citizenship | authorized_alien | Noncitizen authorized to work | an alien authorized to work; a noncitizen authorized to work; alien authorized to work; noncitizen other than |
"""


def tokens(phrase: str) -> list[str]:
    """Tokens of a dictionary phrase, as normalize_label() makes them of a label."""
    words = re.sub(r"[^a-z0-9]+", " ", phrase.lower()).split()
    return [ABBREVIATIONS.get(w, w) for w in words]


def _rows(text: str, columns: int) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")][:columns] for line in text.strip().split("\n")]


def _parts(cell: str) -> list[str]:
    return [p.strip() for p in cell.split(";") if p.strip()]


FIELDS = [(key, title, _parts(aliases), _parts(vetoes) + [p for p in NOT_YOURS if p not in ALLOWED.get(key, ())]) for key, title, aliases, vetoes in _rows(FIELD_ROWS, 4)]
CHOICES = [(choice, answer, title, _parts(words), code) for choice, answer, title, words, code in _rows(CHOICE_ROWS, 5)]
PARTY_WORDS = sorted({tokens(p)[0] for p in NOT_YOURS})


def values_sql(name: str) -> str:
    """A dimension as SQL that any engine runs; token arrays are blank-separated strings."""
    q = lambda s: '"' if s is None else "'" + s.replace("'", "''") + "'"
    if name == "aliases":
        rows = [(k, f, key, a, " ".join(tokens(a)), len(tokens(a))) for k, (f, key, a) in enumerate((f, key, a) for f, (key, _, al, _) in enumerate(FIELDS) for a in al)]
        cells = [f"({k}, {f}, {q(key)}, {q(a)}, {q(t)}, {n})" for k, f, key, a, t, n in rows]
        head = "alias_ord, field_ord, key, alias, alias_text, alias_n"
    elif name == "vetoes":
        rows = sorted({(key, " ".join(tokens(v)), len(tokens(v))) for key, _, _, vs in FIELDS for v in vs})
        cells = [f"({q(key)}, {q(t)}, {n})" for key, t, n in rows]
        head = "key, veto_text, veto_n"
    elif name == "fields":
        cells = [f"({k}, {q(key)}, {q(title)}, {str(key in SENSITIVE).lower()}, {str(key in IMAGES).lower()}, {len(SPLITS.get(key, ()))})" for k, (key, title, _, _) in enumerate(FIELDS)]
        head = "field_ord, key, title, sensitive, image, n_split"
    elif name == "choices":
        flat = [(g, c, a, t, " ".join(tokens(w)), len(tokens(w)), code) for g, (c, a, t, ws, code) in enumerate(CHOICES) for w in ws]
        cells = [f"({g}, {q(c)}, {q(a)}, {q(t)}, {q(w)}, {n}, {q(code)})" for g, c, a, t, w, n, code in flat]
        head = "choice_ord, choice, answer, answer_title, words_text, words_n, code"
    elif name == "splits":
        cells = [f"({q(key)}, {len(ns)}, {k}, {1 + sum(ns[:k])}, {n})" for key, ns in SPLITS.items() for k, n in enumerate(ns)]
        head = "key, n_parts, part_no, at_, n_chars"
    else:
        raise KeyError(name)
    return f"SELECT * FROM (VALUES {', '.join(cells)}) AS t({head})"
