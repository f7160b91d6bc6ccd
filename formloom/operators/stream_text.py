"""Word-style documents: headings, carried context, blanks in text and tables, and values put back."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.dialect import SPARK, Spark
from formloom.operators.batches import map_whole
from formloom.plans.registry import Operator, run


def _heading(d: Spark) -> str:
    return f"({d.like('lower(style)', '^(heading|title)')} OR (length(text) < 60 AND text = upper(text) AND {d.like('text', '[A-Za-z]')}))"


def para_headings(d: Spark) -> str:
    return f"SELECT form_id, seq, {_heading(d)} AS is_heading FROM paragraphs"


def section_carry(d: Spark) -> str:
    """The last heading before each paragraph."""
    last = "last_value(h) IGNORE NULLS OVER" if d.name == "spark" else "last_value(h IGNORE NULLS) OVER"
    return f"SELECT form_id, seq, coalesce({last} (PARTITION BY form_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section FROM (SELECT form_id, seq, CASE WHEN {_heading(d)} THEN text END AS h FROM paragraphs) p"


def above_carry(d: Spark) -> str:
    """The last paragraph with text before each."""
    last = "last_value(h) IGNORE NULLS OVER" if d.name == "spark" else "last_value(h IGNORE NULLS) OVER"
    return f"SELECT form_id, seq, coalesce({last} (PARTITION BY form_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above FROM (SELECT form_id, seq, CASE WHEN trim(text) <> '' THEN text END AS h FROM paragraphs) p"


# Points and characters of one underscore.
UNDERSCORE_POINTS, UNDERSCORE_CHARS = 5.5, 1.6


def underscore_blanks(d: Spark) -> str:
    """Runs of three underscores or more: the label is the text since the run before, else the paragraph above; the run's length says how much it takes."""
    parts = d.parts("text", "_{3,}")
    n = f"length({d.at('runs_', 'i + 1')})"
    return f"""
SELECT p.form_id, p.seq, CAST(p.i AS BIGINT) AS blank_no, p.label, CASE WHEN p.label = '' THEN coalesce(a.above, '') ELSE '' END AS above, CAST(p.n * {UNDERSCORE_POINTS} AS DOUBLE) AS width_pt, CAST(floor(p.n * {UNDERSCORE_CHARS}) AS BIGINT) AS max_chars
FROM (SELECT form_id, seq, i, {d.rx('part', '^[ :\\t]+|[ :\\t]+$', '')} AS label, {n} AS n
      FROM {d.each('(SELECT form_id, seq, ' + parts + ' AS parts, ' + d.all('text', '_{3,}') + ' AS runs_ FROM gap_lines)', 'parts', 'i', 'part')} q WHERE i < {d.size('runs_')}) p
LEFT JOIN above_carry a ON a.form_id = p.form_id AND a.seq = p.seq"""


def table_cell_blanks(d: Spark) -> str:
    """Empty cells with text to the left or above."""
    return """
SELECT form_id, tbl, row_, col, coalesce(left_, '') AS left_, coalesce(above, '') AS above FROM (
  SELECT *, lag(text) OVER (PARTITION BY form_id, tbl, row_ ORDER BY col) AS left_, lag(text) OVER (PARTITION BY form_id, tbl, col ORDER BY row_) AS above FROM cells) c
WHERE text = '' AND (coalesce(left_, '') <> '' OR coalesce(above, '') <> '') AND NOT contains(coalesce(left_, ''), '__')"""


def splice_values(d: Spark) -> str:
    """Each run of underscores replaced by its value, whatever the runs before it became."""
    parts = d.split(d.rx("text", "_{3,}", "~"), "~") if d.name == "duck" else "split(text, '_{3,}')"
    return f"""
SELECT form_id, seq, {d.listagg("concat(part, CASE WHEN i < n - 1 THEN concat('<', CAST(i AS STRING), '>') ELSE '' END)", '', 'i')} AS text
FROM (SELECT form_id, seq, i, part, n FROM {d.each('(SELECT form_id, seq, ' + d.size('parts') + ' AS n, parts FROM (SELECT form_id, seq, ' + parts + ' AS parts FROM gap_lines) g0)', 'parts', 'i', 'part')} p0) p GROUP BY form_id, seq"""


#: Fixed value: names that a word processor gives fields by itself, which say nothing.
GENERIC_NAME = "^(Text|Check|Dropdown)[0-9]*$"


def field_machine(d: Spark) -> str:
    """Runs with begin, separate and end markers to the fields of a paragraph.

    The depth of a run is a running sum of markers, so a run belongs to the last field begun at its depth and what is
    nested in a field is another one. Of its runs before the separator the instruction is made, of those after it the
    result. Only text and checkbox fields are blanks. A text field is labelled by what stands outside all fields before
    it, a checkbox by what follows its end; a name that somebody chose is authoritative. A stray end is no marker, a
    field without an end ends with the paragraph.
    """
    strip = lambda s: d.rx(s, "^[ :\\t]+|[ :\\t]+$", "")
    value = d.rx("coalesce(result, '')", "^[\\s\u2002\u00a0]+|[\\s\u2002\u00a0]+$", "")
    line = "PARTITION BY form_id, seq"
    return f"""
WITH sums AS (SELECT *, SUM(CASE fld_char WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER ({line} ORDER BY run_no) AS s FROM runs),
depths AS (
  SELECT form_id, seq, run_no, fld_char, instr, name, checked, coalesce(text, '') AS text, s - least(0, low) AS after_, s < least(0, coalesce(lag(low) OVER ({line} ORDER BY run_no), 0)) AS stray
  FROM (SELECT *, MIN(s) OVER ({line} ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM sums) m),
levels AS (SELECT *, CASE WHEN fld_char = 'end' AND NOT stray THEN after_ + 1 ELSE after_ END AS depth FROM depths),
owned AS (
  SELECT *, MAX(CASE WHEN fld_char = 'begin' THEN run_no END) OVER (PARTITION BY form_id, seq, depth ORDER BY run_no) AS field,
         SUM(CASE WHEN depth = 0 THEN length(text) ELSE 0 END) OVER ({line} ORDER BY run_no) AS outside, SUM(length(text)) OVER ({line} ORDER BY run_no) AS upto FROM levels),
phased AS (SELECT *, SUM(CASE WHEN fld_char = 'separate' THEN 1 ELSE 0 END) OVER (PARTITION BY form_id, seq, field ORDER BY run_no) AS past FROM owned WHERE depth > 0),
fields_ AS (
  SELECT form_id, seq, field, upper(coalesce({d.listagg("CASE WHEN past = 0 AND fld_char = '' THEN instr END", '', 'run_no')}, '')) AS instr, {d.listagg("CASE WHEN past > 0 AND fld_char = '' THEN text END", '', 'run_no')} AS result,
         coalesce(MAX(CASE WHEN fld_char = 'begin' THEN name END), '') AS name, bool_or(fld_char = 'begin' AND coalesce(checked, false)) AS checked,
         MAX(CASE WHEN fld_char = 'begin' THEN outside END) AS before_, MAX(CASE WHEN fld_char = 'end' THEN upto END) AS behind
  FROM phased GROUP BY form_id, seq, field),
whole AS (SELECT form_id, seq, coalesce({d.listagg("CASE WHEN depth = 0 THEN text END", '', 'run_no')}, '') AS outside_text, {d.listagg('text', '', 'run_no')} AS all_text FROM owned GROUP BY form_id, seq)
SELECT form_id, seq, CAST(row_number() OVER ({line} ORDER BY field) AS BIGINT) AS field_no, kind, CASE WHEN kind = 'text' THEN {strip("substr(outside_text, 1, CAST(before_ AS INT))")} ELSE '' END AS left_,
       CASE WHEN kind = 'checkbox' AND behind IS NOT NULL THEN {strip("substr(all_text, CAST(behind + 1 AS INT))")} ELSE '' END AS right_,
       CASE WHEN named THEN name ELSE '' END AS inside, name AS native_name, named AS authoritative, CASE WHEN kind = 'text' THEN {value} WHEN checked THEN 'checked' ELSE '' END AS value
FROM (SELECT f.*, w.outside_text, w.all_text, CASE WHEN f.instr LIKE '%FORMCHECKBOX%' THEN 'checkbox' WHEN f.instr LIKE '%FORMTEXT%' THEN 'text' END AS kind, f.name <> '' AND NOT {d.like('f.name', GENERIC_NAME)} AS named
      FROM fields_ f JOIN whole w ON w.form_id = f.form_id AND w.seq = f.seq) k WHERE kind IS NOT NULL"""


#: Fixed value: bytes of labels and values that go out in one batch.
BATCH_BYTES = 1 << 24


def fields_of_runs(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """field_machine() with a stack of the fields that are open, over the runs of whole paragraphs. A paragraph is held by one task."""

    def strings(column: pa.ChunkedArray) -> tuple[memoryview, list[int]]:
        """The column's texts one after the other, and where each begins."""
        whole = pa.concat_arrays(column.cast(pa.large_string()).fill_null("").chunks)
        at = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
        return memoryview(whole.buffers()[2] or b""), at.tolist()

    def fields(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        marks = pc.index_in(rows["fld_char"], value_set=pa.array(["", "begin", "separate", "end"])).fill_null(4).to_numpy()
        begins, checked = rows["k"].to_numpy() == 1, rows["checked"].fill_null(False).to_numpy()
        (text, t), (instr, i) = strings(rows["text"]), strings(rows["instr"])
        out, size = [], 0

        def send() -> pa.RecordBatch:
            at, no, *rest = zip(*out)
            given = [pa.concat_arrays(rows[c].take(pa.array(at)).chunks) for c in ("form_id", "seq", "name")]
            return pa.RecordBatch.from_arrays([*given[:2], pa.array(no, pa.int64()), given[2].fill_null(""), *(pa.array(c, pa.string()) for c in rest)], ["form_id", "seq", "field_no", "name", "kind", "left_", "right_", "value"])

        def paragraph(end: int) -> Iterator[pa.RecordBatch]:
            """The text and checkbox fields found in a paragraph, which ends before the row `end`."""
            nonlocal out, size
            before, no = b"".join(outside), 0
            for f in found:
                words, row = str(b"".join(f.instr), "utf-8").upper(), None
                if "FORMCHECKBOX" in words:
                    row = "checkbox", b"", b"" if f.end is None else bytes(text[t[f.end + 1]:t[end]]).strip(b" :\t"), "checked" if checked[f.begin] else ""
                elif "FORMTEXT" in words:
                    row = "text", before[:f.outside].strip(b" :\t"), b"", str(b"".join(f.result), "utf-8").strip("\t\n\f\r \u2002\u00a0")
                if row:
                    no += 1
                    out.append((f.begin, no, *row))
                    size += len(row[1]) + len(row[2]) + len(row[3])
                    if size > BATCH_BYTES:
                        yield send()
                        out, size = [], 0

        found, stack, outside, n, done = [], [], [], 0, 0
        at = np.flatnonzero((marks > 0) | begins)
        for k, mark, begin in zip(at.tolist(), marks[at].tolist(), begins[at].tolist()):
            if done < k:  # the plain runs since the last mark
                if not stack:
                    outside.append(text[t[done]:t[k]])
                    n += t[k] - t[done]
                elif stack[-1].past:
                    stack[-1].result.append(text[t[done]:t[k]])
                else:
                    stack[-1].instr.append(instr[i[done]:i[k]])
            if begin:
                yield from paragraph(k)
                found, stack, outside, n = [], [], [], 0
            done = k + 1 if mark else k
            if mark == 1:
                stack.append(SimpleNamespace(begin=k, end=None, outside=n, instr=[], result=[], past=False))
                found.append(stack[-1])
            elif mark == 3 and stack:
                stack.pop().end = k
            elif mark and not stack:
                outside.append(text[t[k]:t[k + 1]])
                n += t[k + 1] - t[k]
            elif mark == 2:
                stack[-1].past = True
        end = len(rows)
        if done < end:
            if not stack:
                outside.append(text[t[done]:t[end]])
            elif stack[-1].past:
                stack[-1].result.append(text[t[done]:t[end]])
            else:
                stack[-1].instr.append(instr[i[done]:i[end]])
        yield from paragraph(end)
        if out:
            yield send()

    columns = ["form_id", "seq", "fld_char", "instr", "name", "checked", "text"]
    given = runs.where("form_id IS NOT NULL AND seq IS NOT NULL").select("run_no", *(F.col(c).cast("long").alias(c) for c in columns[:2]), *columns[2:])
    found = map_whole(given, ["form_id", "seq"], [F.col("run_no").asc()], columns, fields, "form_id long, seq long, field_no long, name string, kind string, left_ string, right_ string, value string")
    named = f"SELECT *, name <> '' AND NOT {SPARK.like('name', GENERIC_NAME)} AS named FROM found"
    return run(spark, f"SELECT form_id, seq, field_no, kind, left_, right_, CASE WHEN named THEN name ELSE '' END AS inside, name AS native_name, named AS authoritative, value FROM ({named}) n", {"found": found})


#: Fixed value: the sign of a ticked control.
TICKED = "☒"


def content_controls(d: Spark) -> str:
    """Controls of a paragraph to blanks: kind by type, label by alias, else tag, else the words around, value unless it is a placeholder.

    A name is authoritative. A box's words follow it in its paragraph; other controls without a name are labelled by
    what stands before them.
    """
    strip = lambda s: d.rx(s, "^[ :\\t]+|[ :\\t]+$", "")
    found = "CASE WHEN own = '' THEN 0 ELSE strpos(para, own) END" if d.name == "duck" else "CASE WHEN own = '' THEN 0 ELSE instr(para, own) END"
    return f"""
SELECT form_id, seq, control_no, kind, CASE WHEN kind <> 'checkbox' AND name = '' THEN before_ ELSE '' END AS left_,
       CASE WHEN kind = 'checkbox' THEN CASE WHEN behind = '' THEN name ELSE behind END ELSE '' END AS right_,
       CASE WHEN kind = 'checkbox' AND contains(lower(behind), lower(name)) THEN '' ELSE name END AS inside, tag AS native_name, name <> '' AS authoritative,
       CASE WHEN placeholder THEN '' WHEN kind = 'checkbox' THEN CASE WHEN trim(own) = '{TICKED}' THEN 'checked' ELSE '' END ELSE trim(own) END AS value
FROM (SELECT form_id, seq, control_no, own, tag, placeholder, coalesce(nullif(alias, ''), tag) AS name, CASE type_ WHEN 'checkbox' THEN 'checkbox' WHEN 'date' THEN 'date' WHEN 'picture' THEN 'signature' ELSE 'text' END AS kind,
             {strip("CASE WHEN at_ > 0 THEN substr(para, 1, CAST(at_ - 1 AS INT)) ELSE para END")} AS before_, {strip("CASE WHEN at_ > 0 THEN substr(para, CAST(at_ + length(own) AS INT)) ELSE '' END")} AS behind
      FROM (SELECT form_id, seq, control_no, coalesce(alias, '') AS alias, coalesce(tag, '') AS tag, type_, coalesce(placeholder, false) AS placeholder, own, para, {found} AS at_
            FROM (SELECT form_id, seq, control_no, alias, tag, type_, placeholder, coalesce(own, '') AS own, coalesce(para, '') AS para FROM controls) c0) c1) c"""


OPERATORS = [
    Operator("para_headings", ("paragraphs",), para_headings),
    Operator("section_carry", ("paragraphs",), section_carry),
    Operator("above_carry", ("paragraphs",), above_carry),
    Operator("underscore_blanks", ("gap_lines", "above_carry"), underscore_blanks),
    Operator("table_cell_blanks", ("cells",), table_cell_blanks),
    Operator("splice_values", ("gap_lines",), splice_values),
    Operator("field_machine", ("runs",), field_machine, fields_of_runs),
    Operator("content_controls", ("controls",), content_controls),
]
