"""Printed rules, underscores and signature lines as blanks, for pages without fields of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formloom.functions.dialect import SPARK, Spark
from formloom.operators import labels as L
from formloom.plans.registry import Operator, run
from formloom.plans.store import written

# Fixed values, in points: the shortest rule, the height of a blank on it, the widest rule as a share of the page.
SHORTEST, BLANK_HEIGHT, WIDEST = 36, 12, 0.85
# Signature lines and their dates, as wide at most and as high; the margin of a page; the least room.
SIGN_WIDTH, DATE_WIDTH, SIGN_HEIGHT, DATE_HEIGHT, MARGIN, ROOM = 260, 150, 22, 12, 36, 60
# How far a signature's label goes on after the word, how far its bracket may close.
FOLLOWS, BRACKET = 40, 240

_LINE = "form_id, page, line_no"
_PAGE = "form_id, page"


def classify_rules(d: Spark) -> str:
    return f"SELECT form_id, page, x0, x1, y0 AS y, src FROM strokes WHERE x1 - x0 >= {SHORTEST} AND ((src = 'segment' AND abs(y1 - y0) <= 1) OR (src = 'rect' AND y1 - y0 <= 2.5))"


def underscore_rules(d: Spark) -> str:
    """Underscores of a line as rules in PDF space, 36 points long or more.

    Words of four underscores or more, and words that are mostly underscores glued to a label, go into one rule until
    another word comes; before a word of underscores alone also a gap of more than 12 ends it.
    """
    bare = d.rx("text", "^_+|_+$", "")
    return f"""
WITH kinds AS (
  SELECT *, CASE WHEN {d.like('text', '^_{4,}$')} THEN 'pure' WHEN contains(text, '_') AND length({bare}) < floor(length(text) / 2) THEN 'glued' ELSE 'other' END AS kind FROM words),
breaks AS (
  SELECT *, CASE WHEN kind = 'other' OR (lag(kind) OVER w) IS NULL OR (lag(kind) OVER w) = 'other' OR kind = 'pure' AND x0 - (lag(x1) OVER w) > {L.COLUMN_GAP} THEN 1 ELSE 0 END AS breaks
  FROM kinds WINDOW w AS (PARTITION BY {_LINE} ORDER BY x0, word_no)),
islands AS (SELECT *, SUM(breaks) OVER (PARTITION BY {_LINE} ORDER BY x0, word_no) AS island FROM breaks)
SELECT r.form_id, r.page, r.line_no, r.x0, r.x1, p.height - r.base + 1.5 AS y FROM (
  SELECT {_LINE}, MIN(x0) AS x0, MAX(x1) AS x1, MAX(y1) AS base FROM islands WHERE kind <> 'other' GROUP BY {_LINE}, island) r
JOIN word_pages p ON p.form_id = r.form_id AND p.page = r.page WHERE r.x1 - r.x0 >= {SHORTEST}"""


def rule_boxes(d: Spark) -> str:
    """Boxes of rules and underscores: not too wide, the first of those at one place, clear of boxes that are taken.

    A form with a real field anywhere has none.
    """
    at = ", ".join(d.half_even(c) for c in ("x0", "x1", "y"))
    name = "concat('~line-', CAST(CAST({} AS BIGINT) AS STRING), '-', CAST(CAST({} AS BIGINT) AS STRING), '-', CAST(CAST({} AS BIGINT) AS STRING))".format(*(d.half_even(c) for c in ("x0", "x1", "y")))
    return f"""
WITH rules_ AS (SELECT form_id, page, x0, x1, y FROM classify_rules UNION ALL SELECT form_id, page, x0, x1, y FROM underscore_rules),
fitting AS (
  SELECT r.*, p.height FROM rules_ r JOIN word_pages p ON p.form_id = r.form_id AND p.page = r.page LEFT JOIN (SELECT DISTINCT form_id AS f FROM real_fields) n ON n.f = r.form_id
  WHERE n.f IS NULL AND r.x1 - r.x0 <= {WIDEST} * p.width),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_PAGE}, {at} ORDER BY y DESC, x0, x1) AS k FROM fitting) k WHERE k = 1)
SELECT form_id, page, {name} AS blank_id, x0, height - y - {BLANK_HEIGHT} AS y0, x1, height - y AS y1, y
FROM first_ r WHERE NOT EXISTS (SELECT 1 FROM taken_boxes t WHERE t.form_id = r.form_id AND t.page = r.page AND r.x0 < t.x1 AND r.x1 > t.x0 AND r.y < t.y1 AND r.y + {BLANK_HEIGHT} > t.y0)"""


def rule_blanks(d: Spark) -> str:
    """The boxes of rules that have a label to the left or above."""
    return f"""
SELECT b.form_id, b.page, b.blank_id, b.x0, b.x1, b.y, coalesce(l.left_, '') AS left_, coalesce(a.above, '') AS above FROM rule_boxes b
LEFT JOIN rule_left l ON {L._on('l', 'b')} LEFT JOIN rule_above a ON {L._on('a', 'b')} WHERE coalesce(l.left_, '') <> '' OR coalesce(a.above, '') <> ''"""


def printed_signature_lines(d: Spark) -> str:
    """Signature and date blanks on the first printed signature line of a page that has no real signature field.

    The label goes from the word "signature", or a possessive just before it, over the words that follow closely, on the
    next line too where the label wraps, and to the end of a bracket that hugs it. After it at least 60 points of paper
    are empty. The blank ends before the date's label, whose own blank follows that.
    """
    begins = lambda c, w: f"lower({c}) LIKE '{w}%'"
    return f"""
WITH lines_ AS (SELECT *, row_number() OVER (PARTITION BY {_PAGE} ORDER BY line_no) AS n FROM line_boxes),
signs AS (
  SELECT * FROM (SELECT w.form_id, w.page, w.line_no, w.x0 AS sx0, w.x1 AS sx1, w.y0 AS sy0, row_number() OVER (PARTITION BY w.form_id, w.page, w.line_no ORDER BY w.x0, w.word_no) AS k FROM words w WHERE {begins('w.text', 'signature')}) s WHERE k = 1),
heads AS (
  SELECT s.form_id, s.page, s.line_no, s.sx0, s.sx1, s.sy0, CASE WHEN n.y0 - l.y1 BETWEEN -4 AND 6 AND abs(n.x0 - l.x0) < 60 THEN n.line_no END AS under, CASE WHEN n.y0 - l.y1 BETWEEN -4 AND 6 AND abs(n.x0 - l.x0) < 60 THEN n.y1 ELSE l.y1 END AS bottom
  FROM signs s JOIN lines_ l ON {L._on('l', 's', 'form_id page line_no')} LEFT JOIN lines_ n ON n.form_id = l.form_id AND n.page = l.page AND n.n = l.n + 1),
band AS (
  SELECT h.*, w.text, w.x0, w.x1, w.y0, w.word_no, CASE WHEN w.line_no = h.line_no THEN 0 ELSE 1 END AS lower_
  FROM heads h JOIN words w ON w.form_id = h.form_id AND w.page = h.page AND (w.line_no = h.line_no OR w.line_no = h.under)),
dated AS (
  SELECT *, MIN(CASE WHEN {begins('text', 'date')} THEN lower_ * 1000000 + rank_ END) OVER (PARTITION BY {_LINE}) AS date_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {_LINE}, lower_ ORDER BY x0, word_no) AS rank_ FROM band) b),
dates AS (SELECT form_id, page, line_no, x0 AS dx0, x1 AS dx1 FROM dated WHERE lower_ * 1000000 + rank_ = date_rank),
others AS (SELECT *, row_number() OVER (PARTITION BY {_LINE} ORDER BY x0, lower_, word_no) AS k FROM dated WHERE date_rank IS NULL OR lower_ * 1000000 + rank_ <> date_rank),
started AS (
  SELECT *, coalesce(max_by(CASE WHEN before_ THEN x0 END, CASE WHEN before_ THEN k END) OVER (PARTITION BY {_LINE}), sx0) AS start_
  FROM (SELECT *, x1 <= sx0 + 1 AND sx0 - x1 <= {L.COLUMN_GAP} AND abs(y0 - sy0) < 4 AS before_ FROM others) o),
labelled AS (SELECT *, MAX(CASE WHEN x0 BETWEEN start_ - 1 AND sx1 + {FOLLOWS} THEN x1 END) OVER (PARTITION BY {_LINE}) AS edge FROM started),
rest AS (
  SELECT *, bool_or(x0 BETWEEN start_ - 1 AND sx1 + {FOLLOWS} AND text LIKE '(%') OVER (PARTITION BY {_LINE}) AND NOT bool_or(x0 BETWEEN start_ - 1 AND sx1 + {FOLLOWS} AND text LIKE '%)') OVER (PARTITION BY {_LINE}) AS opened,
         MIN(CASE WHEN x0 > edge + 1 THEN k END) OVER (PARTITION BY {_LINE}) AS first_rest, MIN(CASE WHEN x0 > edge + 1 AND text LIKE '%)' THEN k END) OVER (PARTITION BY {_LINE}) AS closing FROM labelled),
hugging AS (
  SELECT *, CASE WHEN bool_or(k = closing AND x0 - edge < {BRACKET}) OVER (PARTITION BY {_LINE}) AND (opened OR bool_or(k = first_rest AND text LIKE '(%') OVER (PARTITION BY {_LINE})) THEN closing ELSE 0 END AS to_ FROM rest),
whole AS (
  SELECT *, x0 BETWEEN start_ - 1 AND sx1 + {FOLLOWS} OR k >= first_rest AND k <= to_ AS label_ FROM hugging),
ended AS (SELECT *, MAX(CASE WHEN label_ THEN x1 END) OVER (PARTITION BY {_LINE}) AS right_ FROM whole),
free AS (
  SELECT {_LINE}, bottom, right_, MIN(CASE WHEN x0 > edge + 1 AND k > to_ THEN x0 END) AS next_, {d.listagg("CASE WHEN label_ THEN text END", ' ', 'CASE WHEN x0 > edge + 1 THEN 1 ELSE 0 END, k')} AS label
  FROM ended GROUP BY {_LINE}, bottom, right_),
lines_found AS (
  SELECT f.form_id, f.page, f.line_no, f.label, p.height - f.bottom AS base, f.right_ + 8 AS x0, CASE WHEN t.dx0 IS NOT NULL THEN t.dx0 - 10 ELSE least(f.right_ + 8 + {SIGN_WIDTH}, p.width - {MARGIN}) END AS x1, t.dx1, p.width,
         row_number() OVER (PARTITION BY f.form_id, f.page ORDER BY f.line_no) AS n
  FROM free f JOIN word_pages p ON p.form_id = f.form_id AND p.page = f.page LEFT JOIN dates t ON {L._on('t', 'f', 'form_id page line_no')}
  LEFT JOIN (SELECT DISTINCT form_id, page FROM real_signatures) g ON g.form_id = f.form_id AND g.page = f.page
  WHERE g.page IS NULL AND (f.next_ IS NULL OR f.next_ - f.right_ >= {ROOM}) AND CASE WHEN t.dx0 IS NOT NULL THEN t.dx0 - 10 ELSE least(f.right_ + 8 + {SIGN_WIDTH}, p.width - {MARGIN}) END - (f.right_ + 8) >= {ROOM})
SELECT form_id, page, 'signature' AS kind, label AS left_, x0, base AS y0, x1, base + {SIGN_HEIGHT} AS y1 FROM lines_found WHERE n = 1
UNION ALL SELECT form_id, page, 'date', 'Date', dx1 + 8, base, least(dx1 + 8 + {DATE_WIDTH}, width - {MARGIN}), base + {DATE_HEIGHT} FROM lines_found WHERE n = 1 AND dx1 IS NOT NULL"""


def signatures_near(spark: SparkSession, words: DataFrame, line_boxes: DataFrame, word_pages: DataFrame, real_signatures: DataFrame) -> DataFrame:
    """printed_signature_lines() over the lines that it looks at alone: those with a word that begins a signature, and the line below each.

    A line below is the page's next one among these lines as it is among all, so the statement finds the same. What it
    needs of these lines is written, each table once; a join with them goes down to whole lines, before words are made.
    """
    near = """
SELECT DISTINCT form_id, page, line_no FROM (
  SELECT l.form_id, l.page, explode(array(l.line_no, l.next_)) AS line_no FROM (SELECT form_id, page, line_no, lead(line_no) OVER (PARTITION BY form_id, page ORDER BY line_no) AS next_ FROM line_boxes) l
  LEFT SEMI JOIN (SELECT form_id, page, line_no FROM words WHERE lower(text) LIKE 'signature%') s ON s.form_id = l.form_id AND s.page = l.page AND s.line_no = l.line_no) n WHERE line_no IS NOT NULL"""
    lines = written(run(spark, near, {"line_boxes": line_boxes, "words": words}), "signature_lines")
    line, page, tasks = ["form_id", "page", "line_no"], ["form_id", "page"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {"words": (words, line), "line_boxes": (line_boxes, line), "word_pages": (word_pages, page), "real_signatures": (real_signatures, page)}
    few = {name: written(df.join(lines, key, "left_semi"), f"signature_{name}").repartition(tasks, "form_id") for name, (df, key) in tables.items()}
    return run(spark, printed_signature_lines(SPARK), few)



OPERATORS = [
    Operator("classify_rules", ("strokes",), classify_rules),
    Operator("underscore_rules", ("words", "word_pages"), underscore_rules),
    Operator("rule_boxes", ("classify_rules", "underscore_rules", "word_pages", "real_fields", "taken_boxes"), rule_boxes),
    Operator("rule_lines", ("rule_boxes", "line_boxes"), lambda d: L.same_line(d, "rule_boxes")),
    Operator("rule_runs", ("rule_boxes", "line_boxes", "words"), lambda d: L.run_around(d, "rule_boxes"), lambda spark, rule_boxes, line_boxes, words: L.runs_by_line(spark, rule_boxes, line_boxes, words)),
    Operator("rule_left", ("rule_boxes", "rule_lines", "words"), lambda d: L.label_left(d, "rule_boxes", "rule_lines")),
    Operator("rule_above", ("rule_runs", "rule_lines"), lambda d: L.label_above(d, "rule_runs", "rule_lines"), lambda spark, rule_runs, rule_lines: L.fold_above(spark, rule_runs, rule_lines)),
    Operator("rule_blanks", ("rule_boxes", "rule_left", "rule_above"), rule_blanks),
    Operator("printed_signature_lines", ("words", "line_boxes", "word_pages", "real_signatures"), printed_signature_lines, signatures_near),
]
