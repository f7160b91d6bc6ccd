"""Page sequences, files and arrivals."""

from __future__ import annotations

from formloom.functions.dialect import Spark
from formloom.plans.registry import Operator


def page_info(d: Spark) -> str:
    return "SELECT form_id, page, width, height, ((rotation % 360) + 360) % 360 AS rotation FROM form_pages"


def page_spec(d: Spark) -> str:
    """Specs file#ranges@turn to single pages in order, or to one row with the reason for refusing them.

    Ranges are numbers, a-b, or a- up to the end; no ranges are all pages. A spec is refused as a whole.
    """
    number = "^-?[0-9]+$"
    range_ = "^[0-9]+( *- *[0-9]*)?$"
    bound = lambda x, k: f"CAST(nullif({d.extract(x, '^([0-9]+) *(-?) *([0-9]*)$', k)}, '') AS BIGINT)"
    low = lambda x: bound(x, 1)
    high = lambda x: f"CASE WHEN {x} LIKE '%-%' THEN coalesce({bound(x, 3)}, page_count) ELSE {low(x)} END"
    listed = d.filter(d.map(d.split("CASE WHEN rest = '' THEN '1-' ELSE rest END", ","), "p_", "trim(p_)"), "p_", "p_ <> ''")
    return f"""
WITH cut AS (
  SELECT s.form_id, s.spec, f.page_count, {d.extract('s.spec', '^([^#]*)', 1)} AS file_, {d.extract('s.spec', '^[^#]*#([^@]*)', 1)} AS rest, {d.extract('s.spec', '^[^#]*#[^@]*@(.*)$', 1)} AS turn_text
  FROM page_specs s JOIN forms f ON f.form_id = s.form_id),
parts_ AS (SELECT *, CASE WHEN turn_text = '' THEN 0 ELSE TRY_CAST(turn_text AS BIGINT) END AS turn, {listed} AS parts FROM cut),
tried AS (
  SELECT *, CASE WHEN file_ = '' THEN 'no file' WHEN turn_text <> '' AND NOT {d.like('turn_text', number)} THEN 'the turn is no number' WHEN turn % 90 <> 0 THEN 'the turn is no quarter'
    WHEN {d.exists('parts', 'p_', f'NOT {d.like("p_", range_)}')} THEN 'the pages are no numbers'
    WHEN {d.exists('parts', 'p_', f'NOT coalesce({low("p_")} BETWEEN 1 AND page_count AND {high("p_")} BETWEEN {low("p_")} AND page_count, false)')} THEN 'the file has no such pages' END AS reason
  FROM parts_),
ranges_ AS (SELECT form_id, turn, i, {d.seq(low('part'), high('part'))} AS pages_ FROM {d.each('(SELECT form_id, turn, page_count, parts FROM tried WHERE reason IS NULL)', 'parts', 'i', 'part')} r)
SELECT form_id, CAST(row_number() OVER (PARTITION BY form_id ORDER BY i, k) AS BIGINT) AS ord, CAST(page AS BIGINT) AS page, turn, CAST(NULL AS STRING) AS reason FROM {d.each('ranges_', 'pages_', 'k', 'page')} p
UNION ALL SELECT form_id, NULL, NULL, NULL, reason FROM tried WHERE reason IS NOT NULL"""


def assemble_pages(d: Spark) -> str:
    return "SELECT s.form_id AS out_, s.ord, s.page, (((p.rotation + s.turn) % 360) + 360) % 360 AS rotation FROM page_spec s JOIN form_pages p ON p.form_id = s.form_id AND p.page = s.page"


def rebuild_form(d: Spark) -> str:
    """Roots of the fields whose widgets stand on the copied pages, in order of first use."""
    return "SELECT s.form_id, r.root, MIN(s.ord) AS first_ord FROM page_spec s JOIN widget_pages w ON w.form_id = s.form_id AND w.page = s.page JOIN field_roots r ON r.form_id = w.form_id AND r.node = w.node WHERE r.root IS NOT NULL GROUP BY s.form_id, r.root"


def form_manifest(d: Spark) -> str:
    """Files by their suffix; others are refused."""
    suffix = f"lower({d.extract('path', r'[.]([A-Za-z0-9]+)$', 1)})"
    return f"SELECT path, length, CASE WHEN {suffix} IN ('pdf', 'docx') THEN {suffix} END AS fmt FROM files"


# Bytes of a body at most, and the declarations that it must not hold.
BODY_BYTES, DECLARATIONS = 64 * 1024 * 1024, ("<!DOCTYPE", "<!ENTITY")


def paragraph_admission(d: Spark) -> str:
    """Bodies refused for their size, for declarations that could expand, in either byte order of UTF-16 too, or for having no body.

    A body with zero bytes or a byte order mark near its beginning is UTF-16; its text is that without the zero bytes.
    """
    size = "octet_length(body)" if d.name == "duck" else "length(body)"
    text = "upper(coalesce({}, ''))".format("try(decode(unhex(plain)))" if d.name == "duck" else "try_validate_utf8(decode(unhex(plain), 'UTF-8'))")
    wide = f"({d.like('left(h, 4)', '^(FFFE|FEFF)')} OR {d.like('left(h, 400)', '^(..)*00')})"
    declared = " OR ".join(f"contains(t, '{x}')" for x in DECLARATIONS)
    return f"""
SELECT path, CASE WHEN n IS NULL THEN 'no document part' WHEN n > {BODY_BYTES} THEN 'too large' WHEN {declared} THEN 'declares entities' WHEN NOT contains(t, '<W:BODY') THEN 'no body' ELSE 'ok' END AS reason
FROM (SELECT path, n, {text} AS t FROM (SELECT path, n, CASE WHEN {wide} THEN {d.rx(d.rx('h', '^(FFFE|FEFF)', ''), '(..)00|00(..)', chr(92) + '1' + chr(92) + '2')} ELSE h END AS plain FROM (SELECT path, {size} AS n, hex(body) AS h FROM parts) x) y) z"""


def recent_forms(d: Spark, most: int = 100) -> str:
    """The newest files without filled copies; those that are no forms (fewer than three blanks) drop after the limit."""
    return f"""
SELECT t.path, t.modified, b.blanks FROM (SELECT path, modified FROM files WHERE {d.like('lower(path)', '[.](pdf|docx)$')} AND NOT contains(path, '-filled') ORDER BY modified DESC, path LIMIT {most}) t
JOIN blank_counts b ON b.path = t.path WHERE b.blanks >= 3"""


def arrivals_source(d: Spark) -> str:
    return "SELECT path, size, ts FROM arrivals WHERE path LIKE '%.pdf' OR path LIKE '%.docx'"


def settled_files(d: Spark) -> str:
    """The last size of each burst of changes that is followed by six quiet hours."""
    gap = "INTERVAL 6 HOURS"
    return f"""
SELECT path, size, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, size) AS next_ts FROM arrivals_source) a
WHERE (next_ts IS NULL OR next_ts > ts + {gap}) AND size > 0"""


def one_notice(d: Spark) -> str:
    return "SELECT path, MIN(ts) AS ts FROM settled_files GROUP BY path"


def is_form(d: Spark) -> str:
    """Whether an announced file has three blanks or more; one that could not be read has none."""
    return "SELECT n.path, n.ts, coalesce(b.blanks, 0) AS blanks, coalesce(b.blanks, 0) >= 3 AS is_form FROM one_notice n LEFT JOIN blank_counts b ON b.path = n.path"


OPERATORS = [
    Operator("page_info", ("form_pages",), page_info),
    Operator("page_spec", ("page_specs", "forms"), page_spec),
    Operator("assemble_pages", ("page_spec", "form_pages"), assemble_pages),
    Operator("rebuild_form", ("page_spec", "widget_pages", "field_roots"), rebuild_form),
    Operator("form_manifest", ("files",), form_manifest),
    Operator("paragraph_admission", ("parts",), paragraph_admission),
    Operator("recent_forms", ("files", "blank_counts"), recent_forms),
    Operator("arrivals_source", ("arrivals",), arrivals_source),
    Operator("settled_files", ("arrivals_source",), settled_files),
    Operator("one_notice", ("settled_files",), one_notice),
    Operator("is_form", ("one_notice", "blank_counts"), is_form),
]
