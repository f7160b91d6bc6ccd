"""What goes where on a form: accepted groups, either/or, values, ticks, notes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formloom.functions import text as T
from formloom.functions.dialect import SPARK, Spark
from formloom.plans.registry import Operator, run
from formloom.plans.store import written


def accept_groups(d: Spark) -> str:
    """Groups whose first labelled box matches, word for word, a key with a grouping of as many boxes; none locked, none from a scan."""
    best = "coalesce(nullif(inside, ''), nullif(right_, ''), nullif(left_, ''), nullif(above, ''), nullif(section, ''), nullif(native_name, ''))"
    return f"""
SELECT g.form_id, g.grp, m.key, g.n FROM (
  SELECT form_id, grp, COUNT(*) AS n, coalesce(min_by(CASE WHEN {best} IS NOT NULL THEN blank_id END, CASE WHEN {best} IS NOT NULL THEN blank_no END), min_by(blank_id, blank_no)) AS anchor, bool_or(readonly) AS locked, bool_or(scanned) AS scanned
  FROM blanks WHERE grp IS NOT NULL GROUP BY form_id, grp) g
JOIN match_blank m ON m.form_id = g.form_id AND m.blank_id = g.anchor JOIN fields f ON f.key = m.key
WHERE f.n_split = g.n AND f.n_split > 0 AND m.exact AND NOT g.locked AND NOT g.scanned"""


def blank_keys(d: Spark) -> str:
    """The key of every blank that takes text: an accepted group's for all its members, else the blank's own match."""
    return """
SELECT b.form_id, b.blank_id, b.blank_no, b.scanned, CASE WHEN g.grp IS NULL THEN m.key ELSE g.key END AS key, CASE WHEN g.grp IS NULL THEN m.exact ELSE true END AS exact, g.grp, CASE WHEN g.grp IS NOT NULL THEN b.grp_index END AS grp_index, g.n AS grp_n
FROM blanks b LEFT JOIN accept_groups g ON g.form_id = b.form_id AND g.grp = b.grp LEFT JOIN match_blank m ON m.form_id = b.form_id AND m.blank_id = b.blank_id
WHERE b.kind <> 'checkbox' AND NOT b.readonly AND (g.grp IS NOT NULL OR m.key IS NOT NULL)"""


def wanted_keys(d: Spark) -> str:
    """The keys that a form asks for; those only suggested count."""
    return "SELECT DISTINCT m.form_id, f.slug, m.key FROM blank_keys m JOIN forms f ON f.form_id = m.form_id"


def either_or(d: Spark) -> str:
    """Keys ruled out where a form wants both sides of an either/or.

    A preferred side stays and the other goes, stored or not; of two that are preferred the first by name. Without a
    preference both go if both could be answered, which is a conflict.
    """
    return f"""
SELECT form_id, key, conflict FROM (
  SELECT w.form_id, w.key, w.stated IS NULL AS conflict, CASE WHEN w.stated IS NOT NULL THEN w.key <> w.stated ELSE w.both_had = 2 AND w.had END AS out_
  FROM (SELECT w.form_id, w.key, h.key IS NOT NULL AS had, COUNT(*) OVER (PARTITION BY w.form_id, w.slug) AS both_wanted, SUM(CASE WHEN h.key IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.form_id, w.slug) AS both_had,
               MIN(CASE WHEN coalesce({d.has('p.prefers', 'w.key')}, false) THEN w.key END) OVER (PARTITION BY w.form_id, w.slug) AS stated
        FROM wanted_keys w LEFT JOIN has_key h ON h.slug = w.slug AND h.key = w.key LEFT JOIN preference_union p ON p.slug = w.slug WHERE w.key IN ('ssn', 'ein')) w
  WHERE w.both_wanted = 2) r WHERE out_"""


def plan_values(d: Spark) -> str:
    """Values for exact matches that are no scans; the apartment folds into the street where the form has no box for it.

    A group's value is dealt over its boxes by the key's grouping.
    """
    digits = d.rx("value", "[^0-9]", "")
    return f"""
SELECT form_id, blank_id, key, CASE WHEN grp IS NULL THEN value ELSE part END AS value FROM (
  SELECT x.*, nullif(substr(CASE WHEN {digits} = '' THEN value ELSE {digits} END, CAST(s.at_ AS INT), CAST(s.n_chars AS INT)), '') AS part FROM (
    SELECT m.form_id, m.blank_id, m.key, m.grp, m.grp_index, m.grp_n, CASE WHEN m.key = 'address1' AND a.form_id IS NULL THEN s.street_line ELSE v.value END AS value
    FROM blank_keys m
    JOIN forms f ON f.form_id = m.form_id
    JOIN fields k ON k.key = m.key
    LEFT JOIN either_or e ON e.form_id = m.form_id AND e.key = m.key
    LEFT JOIN (SELECT form_id FROM wanted_keys WHERE key = 'address2') a ON a.form_id = m.form_id
    LEFT JOIN resolve_value v ON v.slug = f.slug AND v.key = m.key
    LEFT JOIN street_line s ON s.slug = f.slug
    WHERE e.key IS NULL AND m.exact AND NOT m.scanned AND NOT k.image
      AND m.key NOT IN ('tax_classification', 'filing_status', 'citizenship') AND v.value IS NOT NULL) x
  LEFT JOIN splits s ON s.key = x.key AND s.n_parts = x.grp_n AND s.part_no = x.grp_index) y WHERE grp IS NULL OR part IS NOT NULL"""


def suggestions(d: Spark) -> str:
    """Keys that are offered, not written: near matches, and all that was read from a scan."""
    return """
SELECT m.form_id, m.blank_id, m.key AS suggested_key, concat('probably ', f.title, CASE WHEN m.scanned THEN ', read from a scan' ELSE ', but not a sure match' END) AS note
FROM blank_keys m JOIN fields f ON f.key = m.key WHERE m.scanned OR NOT m.exact"""


def tick_choices(d: Spark, labels: str = "") -> str:
    """Checkboxes whose label opens with the words of an answer: ticked, not this one, or missing."""
    toks = T.normalize(d, "label")
    slots = ("section", "row_", "inside", "left_", "above", "right_")
    joins = " ".join(f"LEFT JOIN text_verdicts v{k} ON v{k}.text = b.{c}" for k, c in enumerate(slots))
    blocked = " OR ".join(["coalesce(v0.own_section, false)", *(f"coalesce(v{k}.own_block, false)" for k in range(len(slots)))])
    return f"""
SELECT t.form_id, t.blank_id, t.choice, CASE WHEN v.value IS NULL THEN 'missing' WHEN {d.has('t.stands', 'v.value')} THEN 'checked' ELSE 'not this one' END AS decision
FROM (SELECT b.form_id, b.blank_id, c.choice, c.stands FROM (SELECT b.* FROM blanks b {joins} WHERE b.kind = 'checkbox' AND NOT b.readonly AND NOT ({blocked})) b JOIN (
        SELECT label, choice, stands FROM (
          SELECT l.label, c.choice, {d.collect('c.answer')} AS stands, row_number() OVER (PARTITION BY l.label ORDER BY MIN(c.choice_ord)) AS k
          FROM (SELECT label, concat({d.join('tokens', ' ')}, ' ') AS opening, {d.at('tokens', '1')} AS first_token FROM (SELECT DISTINCT label, {toks} AS tokens FROM {labels or "blanks WHERE kind = 'checkbox'"}) t0) l
          JOIN (SELECT *, {d.at(d.split('words_text', ' '), '1')} AS first_word FROM choices) c ON c.first_word = l.first_token
          WHERE l.opening LIKE concat(c.words_text, ' %') GROUP BY l.label, c.choice) g WHERE k = 1) c ON c.label = b.label) t
JOIN forms f ON f.form_id = t.form_id
LEFT JOIN stored_value v ON v.slug = f.slug AND v.key = t.choice"""


def ticks_by_label(spark: SparkSession, **tables: DataFrame) -> DataFrame:
    """tick_choices() with the distinct labels written, so that a label's tokens are made once a label, not once a box."""
    tables["box_labels"] = written(run(spark, "SELECT DISTINCT label FROM blanks WHERE kind = 'checkbox'", tables), "box_labels")
    return run(spark, tick_choices(SPARK, "box_labels"), tables)


def plan_entries(d: Spark) -> str:
    """One entry per blank in document order."""
    return """
SELECT b.form_id, b.blank_id, b.blank_no, m.key, coalesce(v.value, CASE WHEN t.decision = 'checked' THEN 'checked' END) AS value, s.suggested_key,
       CASE WHEN m.key IS NOT NULL AND s.suggested_key IS NULL AND e.key IS NULL AND h.key IS NULL THEN m.key
            WHEN t.decision = 'missing' THEN t.choice END AS missing_key
FROM blanks b JOIN forms f ON f.form_id = b.form_id
LEFT JOIN blank_keys m ON m.form_id = b.form_id AND m.blank_id = b.blank_id
LEFT JOIN plan_values v ON v.form_id = b.form_id AND v.blank_id = b.blank_id
LEFT JOIN tick_choices t ON t.form_id = b.form_id AND t.blank_id = b.blank_id
LEFT JOIN suggestions s ON s.form_id = b.form_id AND s.blank_id = b.blank_id
LEFT JOIN either_or e ON e.form_id = b.form_id AND e.key = m.key
LEFT JOIN has_key h ON h.slug = f.slug AND h.key = m.key"""


def missing_keys(d: Spark) -> str:
    return "SELECT form_id, missing_key AS key, MIN(blank_no) AS ord FROM plan_entries WHERE missing_key IS NOT NULL GROUP BY form_id, missing_key"


def entry_notes(d: Spark) -> str:
    """Why an entry is as it is: what it was filled from, or what keeps it empty."""
    return """
SELECT p.form_id, p.blank_id, CASE WHEN b.readonly THEN 'read only' WHEN p.suggested_key IS NOT NULL THEN s.note
  WHEN b.kind = 'checkbox' AND t.decision IS NULL THEN 'decided by its label' WHEN t.decision = 'not this one' THEN 'not this one'
  WHEN t.decision = 'missing' THEN concat(g.title, ' is not set', CASE WHEN g.sensitive THEN ' (sensitive)' ELSE '' END)
  WHEN p.key IS NULL AND p.value IS NULL THEN 'no confident match'
  WHEN p.value IS NOT NULL AND m.grp IS NOT NULL THEN concat(f.title, ' part ', CAST(m.grp_index + 1 AS STRING), ' of ', CAST(m.grp_n AS STRING)) WHEN p.value IS NOT NULL THEN ''
  WHEN p.key IN (SELECT choice FROM choices) THEN CASE WHEN h.key IS NOT NULL THEN concat(f.title, ' is decided by the box beside it') ELSE concat(f.title, ' is not set') END
  WHEN f.image THEN CASE WHEN h.key IS NOT NULL THEN concat('stored ', lower(f.title), ' could not be read') ELSE concat(f.title, ' is not drawn yet') END
  WHEN e.key IS NOT NULL THEN CASE WHEN e.conflict THEN 'this form wants ein or ssn; choose one' ELSE 'not used; another of ein or ssn was preferred' END
  ELSE concat(f.title, ' is not set', CASE WHEN f.sensitive THEN ' (sensitive)' ELSE '' END) END AS note
FROM plan_entries p JOIN blanks b ON b.form_id = p.form_id AND b.blank_id = p.blank_id JOIN forms o ON o.form_id = p.form_id
LEFT JOIN blank_keys m ON m.form_id = p.form_id AND m.blank_id = p.blank_id
LEFT JOIN suggestions s ON s.form_id = p.form_id AND s.blank_id = p.blank_id
LEFT JOIN tick_choices t ON t.form_id = p.form_id AND t.blank_id = p.blank_id LEFT JOIN fields g ON g.key = p.missing_key LEFT JOIN fields f ON f.key = p.key
LEFT JOIN either_or e ON e.form_id = p.form_id AND e.key = p.key LEFT JOIN has_key h ON h.slug = o.slug AND h.key = p.key"""


def sensitive_used(d: Spark) -> str:
    return f"SELECT p.form_id, {d.collect('p.key')} AS used FROM plan_entries p JOIN fields f ON f.key = p.key WHERE f.sensitive AND p.value IS NOT NULL GROUP BY p.form_id"


def coverage_report(d: Spark) -> str:
    return """
SELECT p.form_id, COUNT(*) AS blanks, CAST(SUM(CASE WHEN p.value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled,
       CAST(SUM(CASE WHEN p.key IS NOT NULL OR p.missing_key IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fillable, MAX(CASE WHEN e.conflict THEN 1 ELSE 0 END) AS conflicts
FROM plan_entries p LEFT JOIN (SELECT form_id, bool_or(conflict) AS conflict FROM either_or GROUP BY form_id) e ON e.form_id = p.form_id GROUP BY p.form_id"""


def inspect_rows(d: Spark) -> str:
    return f"SELECT p.form_id, p.blank_id, concat(p.blank_id, ' ', coalesce(p.key, '-'), ' ', CASE WHEN p.value IS NULL THEN '-' WHEN p.key IS NULL OR f.sensitive THEN {T.mask('p.value')} ELSE p.value END) AS line FROM plan_entries p LEFT JOIN fields f ON f.key = p.key"


def lazy_unlock_keys(d: Spark) -> str:
    """The stored secrets that a form wants and has not ruled out; only these are ever decrypted."""
    return "SELECT w.form_id, w.slug, w.key FROM wanted_keys w JOIN (SELECT DISTINCT slug, key FROM identity_values WHERE tier = 'vault') s ON s.slug = w.slug AND s.key = w.key LEFT JOIN either_or e ON e.form_id = w.form_id AND e.key = w.key WHERE e.key IS NULL"


OPERATORS = [
    Operator("accept_groups", ("blanks", "match_blank", "fields"), accept_groups),
    Operator("blank_keys", ("blanks", "accept_groups", "match_blank"), blank_keys),
    Operator("wanted_keys", ("blank_keys", "forms"), wanted_keys),
    Operator("either_or", ("wanted_keys", "has_key", "preference_union"), either_or),
    Operator("plan_values", ("blank_keys", "splits", "forms", "fields", "either_or", "wanted_keys", "resolve_value", "street_line"), plan_values),
    Operator("suggestions", ("blank_keys", "fields"), suggestions),
    Operator("tick_choices", ("blanks", "text_verdicts", "choices", "forms", "stored_value"), tick_choices, ticks_by_label),
    Operator("plan_entries", ("blanks", "forms", "blank_keys", "plan_values", "tick_choices", "suggestions", "either_or", "has_key"), plan_entries),
    Operator("missing_keys", ("plan_entries",), missing_keys),
    Operator("entry_notes", ("plan_entries", "blanks", "forms", "blank_keys", "suggestions", "tick_choices", "fields", "choices", "either_or", "has_key"), entry_notes),
    Operator("sensitive_used", ("plan_entries", "fields"), sensitive_used),
    Operator("coverage_report", ("plan_entries", "either_or"), coverage_report),
    Operator("inspect_rows", ("plan_entries", "fields"), inspect_rows),
    Operator("lazy_unlock_keys", ("wanted_keys", "identity_values", "either_or"), lazy_unlock_keys),
]
