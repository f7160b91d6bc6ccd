"""Scalar text expressions of the form model, as SQL in either spelling."""

from __future__ import annotations

from formloom.functions.dialect import Spark
from formloom.functions.dictionary import ABBREVIATIONS, HARD_PHRASES, NOT_YOURS, PARTY_WORDS, tokens


def words(d: Spark, s: str) -> str:
    """Blank-separated parts of a string without empty ones."""
    return d.filter(d.split(s, " "), "w_", "w_ <> ''")


def normalize(d: Spark, s: str) -> str:  # fixed values: the patterns, in this order, say what a token is
    """Tokens of a label: split at case changes, lower case, without line number and punctuation, short forms spelt out."""
    t = f"trim(lower({d.rx(s, '([a-z])([A-Z])', chr(92) + '1 ' + chr(92) + '2')}))"
    t = d.rx(t, "([0-9])([a-z])", r"\1 \2")
    t = d.rx(t, r"^[0-9]{1,2}[a-z]?\b", " ")
    t = d.rx(t, "[^a-z0-9]+", " ")
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ABBREVIATIONS.items())
    return d.map(words(d, t), "x_", f"CASE x_ {cases} ELSE x_ END")


def label_clean(d: Spark, ws: str) -> str:  # fixed values: the patterns
    """The text of label words: dot leaders dropped, a glued line number set apart, trailing colon and leaders off."""
    return label_trim(d, d.join(d.filter(ws, "w_", f"NOT {d.like('w_', r'^[.…·\s]+$')}"), " "))


def label_trim(d: Spark, t: str) -> str:  # fixed values: the patterns
    """label_clean() from the words that are no leaders, joined."""
    t = d.rx(t, "^([0-9]{1,2})([A-Z(])", r"\1 \2")
    return f"trim({d.rx(d.rx(t, r'[\s.:…]+$', ''), r'\s+', ' ')})"


def has_phrase(d: Spark, toks: str, phrases: list[str]) -> str:
    """Whether a token array holds any of the phrases as a run."""
    text = f"concat(' ', {d.join(toks, ' ')}, ' ')"
    return "(" + " OR ".join(f"{text} LIKE '% {p} %'" for p in phrases) + ")"


def own_section(d: Spark, s: str) -> str:
    """Whether a heading opens with another party's name."""
    return has_phrase(d, d.slice(normalize(d, s), "1", "8"), [" ".join(tokens(p)) for p in NOT_YOURS])


def own_block(d: Spark, slots: list[str]) -> str:
    """Whether any slot opens with a phrase that puts the blank out of bounds, or says 'only' beside a party's name."""
    tests = []
    for s in slots:
        opening = d.slice(normalize(d, s), "1", "6")
        party = f"({d.has(opening, chr(39) + 'only' + chr(39))} AND {has_phrase(d, opening, PARTY_WORDS)})"
        tests += [has_phrase(d, opening, [" ".join(tokens(p)) for p in HARD_PHRASES]), party]
    return "(" + " OR ".join(tests) + ")"


def capacity(max_chars: str, width: str, height: str, kind: str) -> str:
    """Characters that a blank takes."""
    one = f"greatest(1, CAST(floor({width} / 5) AS BIGINT))"
    rows = f"CASE WHEN {kind} = 'multiline' THEN greatest(1, CAST(floor({height} / 12) AS BIGINT)) ELSE 1 END"
    return f"CASE WHEN coalesce({max_chars}, 0) <> 0 THEN {max_chars} WHEN {width} <= 0 THEN 0 ELSE {one} * ({rows}) END"


def mask(s: str) -> str:
    """All but the last four characters as stars; four or fewer all."""
    return f"CASE WHEN length({s}) <= 4 THEN repeat('*', CAST(length({s}) AS INT)) ELSE concat(repeat('*', CAST(length({s}) - 4 AS INT)), right({s}, 4)) END"


#: White space of any script.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# What an answer looks like: an e-mail address, a date, three digits or more with blanks, brackets, dots or
# dashes between; and in a text stream what follows a colon, up to two blanks, a tab or the end.
ANSWERS = (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+", r"\b\p{Nd}{1,2}[/.-]\p{Nd}{1,2}[/.-]\p{Nd}{2,4}\b", rf"\p{{Nd}}(?:[{SPACE}().-]*\p{{Nd}}){{2,}}")
AFTER_COLON = rf":[ \t]*[^:_{SPACE}][^:]*?([{SPACE}]{{2,}}|\t|\n?\z)"
ANSWER = "[answer]"


def scrub_shapes(d: Spark, s: str) -> str:
    """What looks like an answer replaced."""
    for shape in ANSWERS:
        s = d.rx(s, shape, ANSWER)
    return s


def scrub_stream(d: Spark, s: str) -> str:
    """What follows a colon replaced, as far as it can be one answer."""
    return d.rx(s, AFTER_COLON, f": {ANSWER}\\1")
