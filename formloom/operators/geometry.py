"""Words, lines, rules and the labels around a blank, by range and nearest-match joins within a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions import text as T
from formloom.functions.dialect import Spark
from formloom.operators.batches import map_whole
from formloom.plans.checks import CHECKS
from formloom.plans.registry import Operator

_BEST = "coalesce(nullif(inside, ''), nullif(right_, ''), CASE WHEN left_ <> '' AND (above = '' OR {nl} <= {na}) THEN left_ WHEN above <> '' THEN above END, nullif(section, ''), native_name)"


def flip_rect(d: Spark) -> str:
    """Boxes from the bottom left to boxes from the top left of their page, corners in order."""
    return "SELECT s.form_id, s.page, s.src, least(s.x0, s.x1) AS x0, p.height - greatest(s.y0, s.y1) AS y0, greatest(s.x0, s.x1) AS x1, p.height - least(s.y0, s.y1) AS y1 FROM strokes s JOIN word_pages p ON p.form_id = s.form_id AND p.page = s.page"


#: Fixed value: how far a word's centre may lie from its line's first word, as a share of the smaller height.
LINE_TOLERANCE = 0.45


def line_cluster(spark: SparkSession, words: DataFrame) -> DataFrame:
    """Words to lines by vertical centre, page by page.

    Words go by centre, then x0, to the latest line whose first word's centre is near enough; else they begin a line.
    Lines are numbered from the top. A page is held by one task. A word with the box's top and bottom of the one before it
    goes where that one went, so only the first of such a run is tried against the lines.
    """

    def lines(words: pa.Table) -> Iterator[pa.RecordBatch]:
        y0, y1, centre = (words[c].to_numpy() for c in ("y0", "y1", "centre"))
        height, begins = y1 - y0, words["k"].to_numpy() == 1
        same = (height >= 0) & np.isfinite(centre) & ~begins
        same[1:] &= (y0[1:] == y0[:-1]) & (y1[1:] == y1[:-1])
        heads = np.flatnonzero(~same)
        found, page, tops, anchors, first = [], [], [], [], 0
        for begin, c, h, top in zip(begins[heads].tolist(), centre[heads].tolist(), height[heads].tolist(), y0[heads].tolist()):
            if begin:
                first, anchors = len(tops), []
            line = -1
            for n in range(len(anchors) - 1, -1, -1) if c == c else ():
                off = c - anchors[n][0]
                if off <= LINE_TOLERANCE * min(anchors[n][1], h):
                    line = first + n
                    break
                if off > LINE_TOLERANCE * h:  # lines before this one lie further up still
                    break
            if line < 0:
                line = len(tops)
                anchors.append((c, h))
                page.append(first)
                tops.append(top)
            found.append(line)
            tops[line] = min(tops[line], top)
        place = np.empty(len(tops), np.int64)
        place[np.lexsort((tops, page))] = np.arange(len(tops))  # a page's lines are numbered from its first
        place -= np.array(page, np.int64)
        yield from words.select(["form_id", "page", "word_no", "text"]).append_column("line", pa.array(place[found][np.cumsum(~same) - 1])).to_batches()

    box = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("x0", "y0", "y1")]
    given = words.select(*(F.col(c).cast("long").alias(c) for c in ("form_id", "page", "word_no")), "text", *box)
    given = given.withColumn("centre", (F.col("y0") + F.col("y1")) / 2)
    order = [F.col("centre").asc(), F.col("x0").asc(), F.col("word_no").asc_nulls_last()]
    columns = ["form_id", "page", "word_no", "text", "y0", "y1", "centre"]
    return map_whole(given, ["form_id", "page"], order, columns, lines, "form_id long, page long, word_no long, text string, line long")


def line_boxes(d: Spark) -> str:
    return f"SELECT form_id, page, line_no, MIN(x0) AS x0, MIN(y0) AS y0, MAX(x1) AS x1, MAX(y1) AS y1, {d.listagg('text', ' ', 'word_no')} AS text FROM words GROUP BY form_id, page, line_no"


def label_clean(d: Spark) -> str:
    return f"SELECT form_id, blank_id, {T.label_clean(d, d.split('label', ' '))} AS label FROM blanks"


def label_inside(d: Spark) -> str:
    """Words wholly inside a box, by rounded height and then from left to right."""
    return f"""
SELECT b.form_id, b.page, b.blank_id, {d.listagg('w.text', ' ', d.half_even('w.y0') + ', w.x0, w.word_no')} AS inside
FROM boxes b JOIN words w ON w.form_id = b.form_id AND w.page = b.page AND w.x0 >= b.x0 - 1 AND w.x1 <= b.x1 + 1 AND w.y0 >= b.y0 - 1 AND w.y1 <= b.y1 + 1 GROUP BY b.form_id, b.page, b.blank_id"""


def label_best(d: Spark) -> str:
    best = _BEST.format(nl=d.size(d.split("left_", " ")), na=d.size(d.split("above", " ")))
    return f"SELECT form_id, blank_id, {best} AS best FROM blanks"


def label_all_text(d: Spark) -> str:
    return "SELECT form_id, blank_id, concat_ws(' | ', nullif(left_, ''), nullif(above, ''), nullif(section, '')) AS all_text FROM blanks"


def tooltip_override(d: Spark) -> str:
    """A tooltip is the form's own word for a blank: it takes the place of the label found on the page."""
    return "SELECT form_id, blank_id, CASE WHEN tooltip <> '' THEN tooltip ELSE left_ END AS left_, CASE WHEN tooltip <> '' THEN '' ELSE above END AS above, CASE WHEN tooltip <> '' THEN '' ELSE inside END AS inside, authoritative OR tooltip <> '' AS authoritative FROM raw_blanks"


# Fixed value: a form's own line number before a label, which a pointer may lead in.
OWN_NUMBER = r"^([Ss]ee\s+)?[0-9]{1,2}([a-z]\s+|\s*)([A-Z(])"


def label_display(d: Spark) -> str:
    """A blank's label on one line: the words that its match came from, else its best; without the form's line number, cut at 52."""
    best = _BEST.format(nl=d.size(d.split("left_", " ")), na=d.size(d.split("above", " ")))
    matched = "CASE m.source WHEN 'inside' THEN b.inside WHEN 'right' THEN b.right_ WHEN 'left' THEN b.left_ WHEN 'above' THEN b.above END"
    return f"""
SELECT form_id, blank_id, CASE WHEN t = '' THEN 'unlabelled' WHEN length(t) > 52 THEN concat(rtrim(left(t, 51)), '…') ELSE t END AS display FROM (
  SELECT form_id, blank_id, {d.rx('label', OWN_NUMBER, chr(92) + '3')} AS t FROM (
    SELECT b.form_id, b.blank_id, trim(coalesce(nullif({matched}, ''), b.best, '')) AS label FROM (SELECT *, {best} AS best FROM blanks) b LEFT JOIN match_blank m ON m.form_id = b.form_id AND m.blank_id = b.blank_id) l) d"""


def capacity(d: Spark) -> str:
    return f"SELECT form_id, blank_id, CAST({T.capacity('max_chars', 'width_pt', 'height_pt', 'kind')} AS BIGINT) AS capacity FROM blanks"


# Fixed values, in points: how far the heights of boxes in one band differ, and the gap between neighbours.
BAND, GAP = 2, 30
# Fixed value: what stands between the boxes of a number and is no label.
PUNCTUATION = r"^[-–—.,/:;|()\[\] ]*$"


def split_groups(d: Spark) -> str:
    """Runs of text boxes side by side that share one label: each member's place in its group, and the label.

    A box goes on a run if it is in the band of the one before and 0 to 30 points to its right. Members without a label,
    or with punctuation for one, go along; a run with two labels or none is no group.
    """
    page = "form_id, page"
    best = _BEST.format(nl=d.size(d.split("left_", " ")), na=d.size(d.split("above", " ")))
    slots = "inside, right_, left_, above, section, native_name"
    return f"""
WITH steps AS (
  SELECT form_id, page, blank_id, x0, y0, blank_no, {slots}, CASE WHEN abs(y0 - (lag(y0) OVER w)) <= {BAND} AND abs(y1 - (lag(y1) OVER w)) <= {BAND} AND x0 - (lag(x1) OVER w) BETWEEN 0 AND {GAP} THEN 0 ELSE 1 END AS begins
  FROM raw_blanks WHERE kind IN ('text', 'multiline') WINDOW w AS (PARTITION BY {page} ORDER BY y0, x0, blank_no)),
runs_ AS (
  SELECT *, coalesce(lead(begins) OVER (PARTITION BY {page} ORDER BY y0, x0, blank_no), 1) = 1 AND begins = 1 AS alone, SUM(begins) OVER (PARTITION BY {page} ORDER BY y0, x0, blank_no) AS run FROM steps),
texts AS (SELECT form_id, page, blank_id, x0, blank_no, run, coalesce({best}, '') AS best FROM runs_ WHERE NOT alone),
named AS (SELECT *, CASE WHEN {d.like('best', PUNCTUATION)} THEN NULL ELSE best END AS real_ FROM texts),
members AS (SELECT *, MIN(real_) OVER w AS shared, MAX(real_) OVER w AS other, COUNT(*) OVER w AS n FROM named WINDOW w AS (PARTITION BY {page}, run))
SELECT form_id, page, blank_id, concat('g', CAST(dense_rank() OVER (PARTITION BY form_id ORDER BY page, run) AS STRING)) AS grp, CAST(row_number() OVER (PARTITION BY {page}, run ORDER BY x0, blank_no) - 1 AS BIGINT) AS grp_index, n, shared
FROM members WHERE n >= 2 AND shared = other"""


def scanned_pages(d: Spark) -> str:
    return "SELECT p.form_id, p.page FROM form_pages p LEFT JOIN (SELECT form_id AS f2, page AS p2, COUNT(*) AS n FROM words GROUP BY form_id, page) w ON w.f2 = p.form_id AND w.p2 = p.page WHERE coalesce(w.n, 0) < 5"


# Width and height of blanks that are put on a page by hand, by kind.
HAND_SIZES = (("date", 150, 12), ("text", 200, 12), ("tick", 10, 10), ("signature", 200, 22))


def hand_blanks(d: Spark) -> str:
    sizes = ", ".join(f"('{k}', {w}, {h})" for k, w, h in HAND_SIZES)
    return f"SELECT a.form_id, a.region_no, a.page, a.kind, a.x0, a.y0, a.x0 + k.w AS x1, a.y0 + k.h AS y1 FROM annotations a JOIN (SELECT * FROM (VALUES {sizes}) AS t(kind, w, h)) k ON k.kind = a.kind"


def shift_blank(d: Spark) -> str:
    """Boxes moved by how far they were dragged; only signatures, and blanks that were drawn on the page, can be."""
    return """
SELECT b.form_id, b.blank_id, b.x0 + coalesce(o.dx, 0) AS x0, b.y0 + coalesce(o.dy, 0) AS y0, b.x1 + coalesce(o.dx, 0) AS x1, b.y1 + coalesce(o.dy, 0) AS y1, b.kind = 'signature' OR b.drawn AS movable
FROM (SELECT form_id, blank_id, kind, x0, y0, x1, y1, false AS drawn FROM blanks UNION ALL SELECT form_id, concat('~hand', CAST(region_no AS STRING)), kind, x0, y0, x1, y1, true FROM hand_blanks) b
LEFT JOIN offsets o ON o.form_id = b.form_id AND o.blank_id = b.blank_id"""


def reading_order(d: Spark) -> str:
    """Blanks to type in by page, from the top in steps of six points, from left to right."""
    return f"SELECT form_id, blank_id, CAST(row_number() OVER (PARTITION BY form_id ORDER BY page, {d.half_even('y1 / 6')}, x0, blank_no) AS BIGINT) AS ord FROM blanks WHERE kind IN ('text', 'multiline') AND NOT readonly"


def chars_to_words(d: Spark) -> str:
    """A page's characters with boxes to words: white space breaks a run, a word's box holds its characters' boxes."""
    blank = d.like("ch", f"^[{T.SPACE}]*$")
    return f"""
SELECT form_id, page, word_no, {d.listagg('ch', '', 'i')} AS text, MIN(x0) AS x0, MIN(y0) AS y0, MAX(x1) AS x1, MAX(y1) AS y1
FROM (SELECT *, CAST(SUM(CASE WHEN {blank} THEN 1 ELSE 0 END) OVER (PARTITION BY form_id, page ORDER BY i) AS BIGINT) AS word_no FROM chars) r WHERE NOT {blank} GROUP BY form_id, page, word_no"""


def words_of_pages(spark: SparkSession, chars: DataFrame) -> DataFrame:
    """chars_to_words() over whole pages of characters, many at a time. A page is held by one task."""

    def words(chars: pa.Table) -> Iterator[pa.RecordBatch]:
        ch, i, begins = chars["ch"].chunk(0), chars["i"].to_numpy(), chars["k"].to_numpy() == 1
        seen = pc.dictionary_encode(ch)
        at = pc.fill_null(seen.indices, -1).to_numpy()
        blank = np.array([not c or c.isspace() for c in seen.dictionary.to_pylist()] + [False])[at]  # str.isspace() is T.SPACE
        page, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
        steps = begins.copy()
        steps[1:] |= i[1:] != i[:-1]
        ends = np.append(np.flatnonzero(steps)[1:], len(i)) - 1  # rows of one i share a number
        blanks = np.cumsum(blank)
        word = blanks[ends[np.cumsum(steps) - 1]] - (blanks - blank)[starts][page]
        kept = np.flatnonzero(~blank & (at >= 0))
        if not len(kept):
            return
        first = np.ones(len(kept), bool)
        first[1:] = (page[kept][1:] != page[kept][:-1]) | (word[kept][1:] != word[kept][:-1])
        first = np.flatnonzero(first)
        letters = pc.take(ch, pa.array(kept)).cast(pa.large_string())
        offsets = np.frombuffer(letters.buffers()[1], np.int64, len(kept) + 1, letters.offset * 8)[np.append(first, len(kept))]
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), letters.buffers()[2]).cast(pa.string())
        of_page = chars.select(["form_id", "page"]).take(pa.array(kept[first]))
        least = lambda c, f: pa.array(f.reduceat(chars[c].to_numpy()[kept], first), pa.float64(), from_pandas=True)
        found = {"word_no": pa.array(word[kept][first], pa.int64()), "text": text, "x0": least("x0", np.fmin), "y0": least("y0", np.fmin), "x1": least("x1", np.fmax), "y1": least("y1", np.fmax)}
        yield from pa.table({"form_id": of_page["form_id"], "page": of_page["page"], **found}).to_batches()

    given = chars.select(*(F.col(c).cast("long").alias(c) for c in ("form_id", "page", "i")), "ch", "x0", "y0", "x1", "y1")
    columns, schema = ["form_id", "page", "i", "ch", "x0", "y0", "x1", "y1"], "form_id long, page long, word_no long, text string, x0 double, y0 double, x1 double, y1 double"
    return map_whole(given, ["form_id", "page"], [F.col("i").asc_nulls_last()], columns, words, schema)


# The resolution that pages are read at, and the least confidence of a word.
DPI, CONFIDENCE = 150, 40


def ocr_words(d: Spark) -> str:
    """Tab-separated recognition rows to words: 12 columns, text, confidence of 40 or more, pixels to points."""
    cell = lambda k: d.at("c", str(k))
    points = lambda k: f"TRY_CAST({cell(k)} AS DOUBLE) * 72 / {DPI}"
    return f"""
SELECT form_id, page, {cell(12)} AS text, {points(7)} AS x0, {points(8)} AS y0, {points(7)} + {points(9)} AS x1, {points(8)} + {points(10)} AS y1
FROM (SELECT form_id, page, {d.split('row_', chr(9))} AS c FROM ocr_tsv) r WHERE {d.size('c')} >= 12 AND trim({cell(12)}) <> '' AND TRY_CAST({cell(11)} AS DOUBLE) >= {CONFIDENCE}"""


OPERATORS = [
    Operator("flip_rect", ("strokes", "word_pages"), flip_rect),
    Operator("line_cluster", ("words",), lambda d: CHECKS["line_cluster"], line_cluster),
    Operator("line_boxes", ("words",), line_boxes),
    Operator("label_clean", ("blanks",), label_clean),
    Operator("label_inside", ("boxes", "words"), label_inside),
    Operator("label_best", ("blanks",), label_best),
    Operator("label_all_text", ("blanks",), label_all_text),
    Operator("tooltip_override", ("raw_blanks",), tooltip_override),
    Operator("label_display", ("blanks", "match_blank"), label_display),
    Operator("capacity", ("blanks",), capacity),
    Operator("split_groups", ("raw_blanks",), split_groups),
    Operator("scanned_pages", ("form_pages", "words"), scanned_pages),
    Operator("hand_blanks", ("annotations",), hand_blanks),
    Operator("shift_blank", ("blanks", "hand_blanks", "offsets"), shift_blank),
    Operator("reading_order", ("blanks",), reading_order),
    Operator("chars_to_words", ("chars",), chars_to_words, words_of_pages),
    Operator("ocr_words", ("ocr_tsv",), ocr_words),
]
