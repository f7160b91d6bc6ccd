"""Masking, scrubbing, finding and removing private text, and the field trees of redacted forms."""

from __future__ import annotations

from formloom.functions import text as T
from formloom.functions.dialect import Spark
from formloom.operators import trees
from formloom.plans.checks import CHECKS
from formloom.plans.registry import Operator

_PLAIN = "[^0-9a-z]"
#: Characters by which the start of a run is found.
OPENING = 12


def mask_value(d: Spark) -> str:
    return f"SELECT slug, key, {T.mask('value')} AS masked FROM identity_values"


def scrub_shapes(d: Spark) -> str:
    return f"SELECT doc_id, {T.scrub_shapes(d, 'text')} AS text FROM documents"


def find_text(d: Spark) -> str:
    """Runs of a page's words whose letters and digits, put together in lower case, are those of a whole needle.

    Words without letters and digits are passed over, and runs go on over line ends. Start words are found by their next
    OPENING characters, which are a key that a needle has too; needles that are shorter by a first word that is a prefix
    of theirs. The words of each candidate run are then put together whole.
    """
    plain = d.rx("lower(text)", _PLAIN, "")
    page = "OVER (PARTITION BY form_id, page ORDER BY line_no, word_no"
    if d.name == "spark":
        ahead = f"left(array_join(collect_list(plain) {page} ROWS BETWEEN CURRENT ROW AND {OPENING - 1} FOLLOWING), ''), {OPENING})"
    else:
        ahead = f"left(array_to_string(list(plain) {page} ROWS BETWEEN CURRENT ROW AND {OPENING - 1} FOLLOWING), ''), {OPENING})"
    run = f"(SELECT form_id, page, line_no, word_no, x0, x1, plain, CAST(SUM(length(plain)) {page}) AS BIGINT) AS e, {ahead} AS ahead FROM (SELECT *, {plain} AS plain FROM words) w0 WHERE plain <> '')"
    needle = f"(SELECT item_id, {plain} AS needle FROM benchmark)"
    short = d.each(f"(SELECT item_id, needle, {d.seq('1', 'length(needle)')} AS seq_ FROM {needle} n0 WHERE needle <> '' AND length(needle) < {OPENING})", "seq_", "i", "j")
    return f"""
SELECT form_id, page, line_no, item_id, x0, x1 FROM (
  SELECT c.form_id, c.page, c.line_no, c.item_id, c.s, MIN(c.needle) AS needle, MIN(w.x0) AS x0, MAX(w.x1) AS x1, {d.listagg('w.plain', '', 'w.e')} AS found
  FROM (SELECT r.form_id, r.page, r.line_no, r.e - length(r.plain) AS s, n.item_id, n.needle FROM {run} r
        JOIN (SELECT item_id, needle, left(needle, {OPENING}) AS head FROM {needle} n1 WHERE length(needle) >= {OPENING}) n ON n.head = r.ahead
        UNION ALL SELECT r.form_id, r.page, r.line_no, r.e - length(r.plain), n.item_id, n.needle FROM {run} r
        JOIN (SELECT item_id, needle, substr(needle, 1, CAST(i + 1 AS INT)) AS prefix FROM {short} s0) n ON n.prefix = r.plain) c
  JOIN {run} w ON w.form_id = c.form_id AND w.page = c.page AND w.e > c.s AND w.e <= c.s + length(c.needle)
  GROUP BY c.form_id, c.page, c.line_no, c.item_id, c.s) f WHERE found = needle"""


def parse_region(d: Spark) -> str:
    """Specs PAGE:x0,y0,x1,y1 to regions with ordered corners; every twelfth spec is bad and is marked."""
    num = "([0-9.]+)"
    pattern = f"^([0-9]+):{num},{num},{num},{num}$"
    spec = "concat(CASE WHEN region_no % 12 = 0 THEN 'x' ELSE CAST(page AS STRING) END, ':', CAST(CAST(x0 AS BIGINT) AS STRING), ',', CAST(CAST(y0 AS BIGINT) AS STRING), ',', CAST(CAST(x1 AS BIGINT) AS STRING), ',', CAST(CAST(y1 AS BIGINT) AS STRING))"
    n = lambda k: f"TRY_CAST({d.extract('spec', pattern, k)} AS DOUBLE)"
    return f"""
SELECT form_id, region_no, TRY_CAST({d.extract('spec', pattern, 1)} AS BIGINT) AS page, least({n(2)}, {n(4)}) AS x0, least({n(3)}, {n(5)}) AS y0, greatest({n(2)}, {n(4)}) AS x1, greatest({n(3)}, {n(5)}) AS y1,
       NOT {d.like('spec', pattern)} AS rejected FROM (SELECT form_id, region_no, {spec} AS spec FROM regions) s"""


def redaction_runs(d: Spark) -> str:
    """Every form with the number of pages that are rebuilt, or with the reason for which nothing is written.

    A form without regions is refused, and so is one with a region on a page that it has not; the page of its first such
    region by number is named.
    """
    known = "r.page BETWEEN 1 AND g.page_count"
    return f"""
SELECT f.form_id, CASE WHEN r.form_id IS NULL THEN 'nothing to black out' WHEN r.bad > 0 THEN concat('no page ', r.first_bad) END AS reason, CASE WHEN r.bad = 0 THEN r.rebuilt ELSE 0 END AS rebuilt
FROM forms f LEFT JOIN (
  SELECT r.form_id, COUNT(DISTINCT r.page) AS rebuilt, SUM(CASE WHEN {known} THEN 0 ELSE 1 END) AS bad,
         min_by(coalesce(CAST(r.page AS STRING), '?'), CASE WHEN {known} THEN NULL ELSE r.region_no END) AS first_bad
  FROM regions r JOIN forms g ON g.form_id = r.form_id GROUP BY r.form_id) r ON r.form_id = f.form_id"""


_BLACKED = "(SELECT DISTINCT form_id AS f2, page AS p2 FROM regions)"


def _stays(columns: str, table: str) -> str:
    return f"""
SELECT {columns} FROM {table} b JOIN (SELECT form_id FROM redaction_runs WHERE reason IS NULL) u ON u.form_id = b.form_id
LEFT JOIN {_BLACKED} r ON r.f2 = b.form_id AND r.p2 = b.page WHERE r.f2 IS NULL"""


def redact_pages(d: Spark) -> str:
    """Blanks that stay: those on pages without a region, of forms that are not refused."""
    return _stays("b.form_id, b.blank_id, b.page", "blanks")


def redact_words(d: Spark) -> str:
    """Words that stay, as blanks do."""
    return _stays("b.form_id, b.page, b.line_no, b.word_no, b.text", "words")


def redaction_counts(d: Spark) -> str:
    """What a run keeps and removes; nothing where it is refused."""

    def counts(table: str) -> str:
        n = lambda test, name: f"COUNT(CASE WHEN {test} THEN 1 END) AS {name}"
        return f"(SELECT b.form_id, {n('r.f2 IS NULL', 'kept')}, {n('r.f2 IS NOT NULL', 'removed')} FROM {table} b LEFT JOIN {_BLACKED} r ON r.f2 = b.form_id AND r.p2 = b.page GROUP BY b.form_id)"

    return f"""
SELECT u.form_id, u.reason, u.rebuilt, coalesce(b.kept, 0) AS blanks_kept, coalesce(b.removed, 0) AS blanks_removed, coalesce(w.kept, 0) AS words_kept, coalesce(w.removed, 0) AS words_removed
FROM redaction_runs u LEFT JOIN {counts("blanks")} b ON b.form_id = u.form_id AND u.reason IS NULL LEFT JOIN {counts("words")} w ON w.form_id = u.form_id AND u.reason IS NULL"""


def calculation_order(d: Spark) -> str:
    """The order in which a form's fields are worked out, without the fields that are gone, numbered anew from 1."""
    return """
SELECT c.form_id, CAST(row_number() OVER (PARTITION BY c.form_id ORDER BY c.pos, c.node) AS BIGINT) AS pos, c.node
FROM calc_order c JOIN prune_fields p ON p.form_id = c.form_id AND p.node = c.node"""


def redact_boxes(d: Spark) -> str:
    return "SELECT form_id, region_no, page, least(x0, x1) - 1.5 AS x0, y0 - 1.5 AS y0, greatest(x0, x1) + 1.5 AS x1, y1 + 1.5 AS y1 FROM regions"


def kind_from_flags(d: Spark) -> str:
    bit = (lambda k: f"(shiftright(flags, {k}) & 1) = 1") if d.name == "spark" else (lambda k: f"((flags >> {k}) & 1) = 1")
    return f"SELECT form_id, node, CASE WHEN ft = 'Btn' THEN CASE WHEN {bit(15)} THEN 'radio' ELSE 'checkbox' END WHEN ft = 'Tx' THEN CASE WHEN {bit(12)} THEN 'multiline' ELSE 'text' END ELSE 'other' END AS kind, {bit(0)} AS readonly FROM field_nodes"


def scrub_stream(d: Spark) -> str:
    """Labels of a text stream without what follows their colons."""
    return f"SELECT form_id, seq, {T.scrub_stream(d, 'text')} AS text FROM gap_lines"


OPERATORS = [
    Operator("scrub_stream", ("gap_lines",), scrub_stream),
    Operator("mask_value", ("identity_values",), mask_value),
    Operator("scrub_shapes", ("documents",), scrub_shapes),
    Operator("find_text", ("benchmark", "words"), find_text),
    Operator("parse_region", ("regions",), parse_region),
    Operator("redaction_runs", ("forms", "regions"), redaction_runs),
    Operator("redact_pages", ("blanks", "regions", "redaction_runs"), redact_pages),
    Operator("redact_words", ("words", "regions", "redaction_runs"), redact_words),
    Operator("redaction_counts", ("blanks", "words", "regions", "redaction_runs"), redaction_counts),
    Operator("calculation_order", ("calc_order", "prune_fields"), calculation_order),
    Operator("redact_boxes", ("regions",), redact_boxes),
    Operator("field_roots", ("field_nodes",), lambda d: CHECKS["field_roots"], trees.field_roots),
    Operator("field_inherit", ("field_nodes",), lambda d: CHECKS["field_inherit"], trees.field_inherit),
    Operator("prune_fields", ("field_nodes", "kept_widgets"), lambda d: CHECKS["prune_fields"], trees.prune_fields),
    Operator("kind_from_flags", ("field_nodes",), kind_from_flags),
]
