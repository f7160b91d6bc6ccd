"""Labels to dictionary keys: tokens, aliases, vetoes, scores and the best match of a blank.

Labels repeat across a corpus, so candidates are computed once per distinct text and joined back to the blanks. Aliases
are found through their first token, never by pairing every label with every alias.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formloom.functions import text as T
from formloom.functions.dialect import Spark
from formloom.functions.dictionary import PARTY_WORDS
from formloom.operators import text_udfs
from formloom.plans.checks import CHECKS
from formloom.plans.registry import Operator

#: The slots of a label, in the order in which they are asked.
SLOTS = ("inside", "right_", "left_", "above", "native_name")
# What a match has to reach, word for word and nearly so; how much less a near alias counts.
SURE, NEAR, NEAR_SHARE = 0.55, 0.75, 0.9
# Tokens of a label's opening and of a row's that say whose it is; where a sentence ends.
OPENING, ROW_OPENING, SENTENCE = 6, 4, r"[.;:]\s+"


def normalize_label(d: Spark) -> str:
    return f"SELECT form_id, blank_id, {T.normalize(d, 'label')} AS tokens FROM blanks"


def slot_weights(d: Spark) -> str:
    plain = [("inside", 1.0, 0), ("right_", 1.0, 1), ("left_", 1.0, 2), ("above", 1.0, 3), ("native_name", 0.7, 4)]
    parts = [
        f"SELECT form_id, blank_id, {k} AS slot_ord, '{c.rstrip('_')}' AS source, {c} AS text, CAST({w} AS DOUBLE) AS weight FROM blanks WHERE {c} <> ''" + (" AND inside = ''" if c in ("left_", "above") else "")
        for c, w, k in plain
    ]
    return " UNION ALL ".join([*parts, "SELECT form_id, blank_id, 5, 'kind', 'signature', CAST(0.95 AS DOUBLE) FROM blanks WHERE kind = 'signature'"])


def label_texts(d: Spark) -> str:
    """The distinct texts of all slots with their tokens."""
    return f"SELECT text, {T.normalize(d, 'text')} AS tokens FROM (SELECT DISTINCT text FROM slot_weights WHERE source <> 'kind') t"


def alias_exact(d: Spark) -> str:
    first = d.at(d.split("alias_text", " "), "1")
    here = d.join(d.slice("tokens", "pos + 1", "alias_n"), " ")
    return f"""
SELECT text, alias_ord, field_ord, key, alias, CAST(alias_n AS BIGINT) AS alias_n, MIN(CAST(pos AS BIGINT)) AS pos, MAX(n_tokens) AS n_tokens
FROM (SELECT text, tokens, pos, token, {d.size('tokens')} AS n_tokens FROM {d.each('label_texts', 'tokens', 'pos', 'token')} l0) l
JOIN (SELECT *, {first} AS first_token FROM aliases) a ON l.token = a.first_token
WHERE {here} = alias_text GROUP BY text, alias_ord, field_ord, key, alias, alias_n"""


def alias_fuzzy(spark: SparkSession, label_texts: DataFrame, alias_exact: DataFrame) -> DataFrame:
    """Aliases that a label holds nearly: the closest window of as many tokens, and how close it is."""
    return text_udfs.alias_fuzzy(label_texts, alias_exact)


def alias_hits(d: Spark) -> str:
    """Exact and near aliases of the distinct texts, with what each counts before its place and length do."""
    return f"""
SELECT text, alias_ord, field_ord, key, alias, alias_n, pos, n_tokens, CAST(1 AS DOUBLE) AS base, true AS exact FROM alias_exact
UNION ALL
SELECT f.text, a.alias_ord, a.field_ord, a.key, a.alias, CAST(a.alias_n AS BIGINT), f.pos, {d.size('l.tokens')}, CAST({NEAR_SHARE} AS DOUBLE) * f.ratio, false
FROM alias_fuzzy f JOIN aliases a ON a.key = f.key AND a.alias = f.alias JOIN label_texts l ON l.text = f.text"""


def alias_veto(d: Spark) -> str:
    """Hits without a disqualifying phrase near: one whose first place lies from four tokens before the alias to its last."""
    first = d.at(d.split("veto_text", " "), "1")
    here = d.join(d.slice("tokens", "vpos + 1", "veto_n"), " ")
    return f"""
SELECT h.* FROM alias_hits h LEFT JOIN (
  SELECT DISTINCT e.text AS vtext, e.alias_ord AS valias FROM alias_hits e JOIN (
    SELECT text AS ptext, key AS pkey, veto_text, MIN(CAST(vpos AS BIGINT)) AS found
    FROM (SELECT text, tokens, vpos, vtoken FROM {d.each('label_texts', 'tokens', 'vpos', 'vtoken')} l0) l
    JOIN (SELECT *, {first} AS first_token FROM vetoes) v ON l.vtoken = v.first_token
    WHERE {here} = veto_text GROUP BY text, key, veto_text) p
  ON e.text = p.ptext AND e.key = p.pkey WHERE p.found BETWEEN e.pos - 4 AND e.pos + e.alias_n - 1) x
ON h.text = x.vtext AND h.alias_ord = x.valias WHERE x.valias IS NULL"""


def score_key(d: Spark) -> str:
    """The best alias of each key in a text."""
    score = "base * (1.0 - 0.18 * CAST(pos AS DOUBLE) / greatest(1, n_tokens)) * least(1.0, 0.82 + 0.06 * alias_n) * least(1.0, pow(CAST(alias_n AS DOUBLE) / least(n_tokens, 10), 0.15))"
    return f"""
SELECT text, field_ord, key, alias, alias_n, CAST(round(raw, 9) AS DOUBLE) AS score, exact FROM (
  SELECT *, row_number() OVER (PARTITION BY text, key ORDER BY round(raw, 12) DESC, alias_ord) AS k
  FROM (SELECT *, CAST({score} AS DOUBLE) AS raw FROM alias_veto) s) r WHERE k = 1"""


def rank_keys(d: Spark) -> str:
    return "SELECT text, key, score, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, field_ord) AS BIGINT) AS rank_ FROM score_key"


def text_verdicts(d: Spark) -> str:
    """Each distinct text once: whether it is another party's heading, and whether it puts a blank out of bounds."""
    texts = " UNION ALL ".join(f"SELECT {c} AS text FROM blanks" for c in ("section", "row_", "inside", "left_", "above", "right_"))
    return f"SELECT text, {T.own_section(d, 'text')} AS own_section, {T.own_block(d, ['text'])} AS own_block FROM (SELECT DISTINCT text FROM ({texts}) a WHERE text <> '') t"


def own_section(d: Spark) -> str:
    """Whether a blank's heading opens with another party's name."""
    return "SELECT b.form_id, b.blank_id, coalesce(v.own_section, false) AS own_section FROM blanks b LEFT JOIN text_verdicts v ON v.text = b.section"


def _blocked(slots: tuple[str, ...]) -> tuple[str, str]:
    """Joins of each slot's verdict, and whether one of them puts the blank out of bounds."""
    joins = " ".join(f"LEFT JOIN text_verdicts v{k} ON v{k}.text = b.{c}" for k, c in enumerate(slots))
    return joins, " OR ".join(f"coalesce(v{k}.own_block, false)" for k in range(len(slots)))


BLOCK_SLOTS = ("row_", "section", "inside", "left_", "above")


def own_block(d: Spark) -> str:
    """Whether the row, the heading or a label of a blank opens with a phrase that puts it out of bounds."""
    joins, blocked = _blocked(BLOCK_SLOTS)
    return f"SELECT b.form_id, b.blank_id, {blocked} AS own_block FROM blanks b {joins}"


def leading_qualifier(d: Spark) -> str:
    """What a text says against keys: (text, key) by its opening, (text, key, alias) by a sentence, (text, key) by a row's opening.

    An opening speaks by its first six tokens, in any slot. A sentence speaks where the label is the form's own word for
    the blank: the first one that holds the alias, by all of its tokens. A row speaks by its first four tokens and
    phrases that begin with a party's name. Phrases are found through their first token.
    """
    first = d.at(d.split("veto_text", " "), "1")
    vetoes = f"(SELECT key, veto_text, veto_n, {first} AS first_token FROM vetoes)"
    here = lambda array, n: d.join(d.slice(array, "pos + 1", n), " ")
    party = ", ".join(f"'{w}'" for w in PARTY_WORDS)
    each = lambda table, array: d.each(table, array, "pos", "token")
    return f"""
WITH texts AS (SELECT text, {d.slice('tokens', '1', str(OPENING))} AS opening FROM label_texts),
sentences AS (SELECT text, CAST(n AS BIGINT) AS n, {T.normalize(d, 'sentence')} AS tokens FROM {d.each('(SELECT text, ' + d.parts('text', SENTENCE) + ' AS parts FROM label_texts)', 'parts', 'n', 'sentence')} s),
holding AS (
  SELECT t.text, a.key, a.alias, MIN(t.n) AS n FROM {each('sentences', 'tokens')} t
  JOIN (SELECT key, alias, alias_text, alias_n, {d.at(d.split('alias_text', ' '), '1')} AS first_token FROM aliases) a ON a.first_token = t.token WHERE {here('t.tokens', 'a.alias_n')} = a.alias_text GROUP BY t.text, a.key, a.alias),
rows_ AS (SELECT row_ AS text, {d.slice(T.normalize(d, 'row_'), '1', str(ROW_OPENING))} AS opening FROM (SELECT DISTINCT row_ FROM blanks WHERE row_ <> '') r)
SELECT DISTINCT o.text, v.key, '' AS alias, 'opening' AS rule FROM {each('texts', 'opening')} o JOIN {vetoes} v ON v.first_token = o.token WHERE {here('o.opening', 'v.veto_n')} = v.veto_text
UNION ALL
SELECT DISTINCT h.text, h.key, h.alias, 'sentence' FROM holding h JOIN {each('sentences', 'tokens')} s ON s.text = h.text AND s.n = h.n JOIN {vetoes} v ON v.first_token = s.token AND v.key = h.key WHERE {here('s.tokens', 'v.veto_n')} = v.veto_text
UNION ALL
SELECT DISTINCT r.text, v.key, '', 'row' FROM {each('rows_', 'opening')} r JOIN {vetoes} v ON v.first_token = r.token AND v.first_token IN ({party}) WHERE {here('r.opening', 'v.veto_n')} = v.veto_text"""


def qualifier_lists(d: Spark) -> str:
    """The keys that each text rules out, by rule, as lists."""
    keys = lambda rule, e="key": f"coalesce({d.collect('CASE WHEN rule = ' + chr(39) + rule + chr(39) + ' THEN ' + e + ' END')}, {d.array()})"
    listed = lambda rule, e="key": d.filter(keys(rule, e), "k_", "k_ IS NOT NULL")
    return f"SELECT text, {listed('opening')} AS opening, {listed('sentence', 'concat(key, chr(47), alias)')} AS sentence, {listed('row')} AS rows_ FROM leading_qualifier GROUP BY text"


def match_candidates(d: Spark) -> str:
    """Candidates of every blank that survive the tests of whose blank it is, with what the blank takes.

    Verdicts and scores are those of distinct texts, so the blanks themselves are not shuffled.
    """
    joins, blocked = _blocked(BLOCK_SLOTS)
    lists = " ".join(f"LEFT JOIN qualifier_lists q{k} ON q{k}.text = b.{c}" for k, c in enumerate(SLOTS))
    slots = d.array("inside", "right_", "CASE WHEN inside = '' THEN left_ ELSE '' END", "CASE WHEN inside = '' THEN above ELSE '' END", "native_name", "CASE WHEN kind = 'signature' THEN 'signature' ELSE '' END")
    against = " OR ".join(f"coalesce({d.has(f'opening{k}', 'c.key')}, false)" for k in range(len(SLOTS)))
    told = " OR ".join(f"coalesce({d.has(f'sentence{k}', 'concat(c.key, chr(47), c.alias)')}, false)" for k in range(len(SLOTS)))
    open_ = f"""(
  SELECT b.form_id, b.blank_id, b.authoritative, b.grp, CAST({T.capacity('b.max_chars', 'b.width_pt', 'b.height_pt', 'b.kind')} AS BIGINT) AS cap, qr.rows_ AS ruled_by_row, {', '.join(f'q{k}.opening AS opening{k}, q{k}.sentence AS sentence{k}' for k in range(len(SLOTS)))}, {slots} AS slots
  FROM (SELECT * FROM blanks WHERE NOT readonly) b LEFT JOIN text_verdicts s ON s.text = b.section {joins} {lists} LEFT JOIN qualifier_lists qr ON qr.text = b.row_
  WHERE NOT coalesce(s.own_section, false) AND NOT ({blocked}))"""
    return f"""
SELECT w.form_id, w.blank_id, CAST(w.slot_ord AS INT) AS slot_ord, CASE w.slot_ord {' '.join(f"WHEN {k} THEN '{c.rstrip('_')}'" for k, c in enumerate(SLOTS))} ELSE 'kind' END AS source, w.text, c.key, c.field_ord, c.alias, c.alias_n, c.exact,
       c.score * CASE WHEN w.slot_ord = 4 THEN CAST(0.7 AS DOUBLE) WHEN w.slot_ord = 5 THEN CAST(0.95 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS raw, w.cap, w.grp
FROM {d.each(open_, 'slots', 'slot_ord', 'text')} w
JOIN (SELECT text, key, field_ord, alias, alias_n, score, exact FROM score_key
      UNION ALL SELECT 'signature', 'signature', 28, 'kind', 1, CAST(1 AS DOUBLE), true) c ON c.text = w.text AND (w.slot_ord = 5) = (c.alias = 'kind')
WHERE NOT ({against}) AND NOT (w.authoritative AND ({told})) AND NOT coalesce({d.has('w.ruled_by_row', 'c.key')}, false)"""


_PENALTY = "CASE WHEN c.key = 'signature' OR c.grp IS NOT NULL OR c.cap <= 0 OR v.value IS NULL OR length(v.value) <= c.cap THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0.25 AS DOUBLE), round(CAST(c.cap AS DOUBLE) / length(v.value), 9)) END"


def capacity_penalty(d: Spark) -> str:
    """How much less a blank's candidates count whose value at hand is longer than the blank takes; a box of a group holds a part only."""
    return f"""
SELECT c.form_id, c.blank_id, c.key, {_PENALTY} AS penalty FROM (SELECT DISTINCT form_id, blank_id, key, cap, grp FROM match_candidates) c
JOIN forms f ON f.form_id = c.form_id JOIN peek_value v ON v.slug = f.slug AND v.key = c.key"""


def match_blank(d: Spark) -> str:
    """The best candidate of every blank, if it reaches the threshold: 0.55 word for word, 0.75 nearly so."""
    return f"""
SELECT form_id, blank_id, key, source, alias, round(score, 6) AS score, exact FROM (
  SELECT *, row_number() OVER (PARTITION BY form_id, blank_id ORDER BY round(score, 9) DESC, alias_n DESC, slot_ord, round(raw, 9) DESC, field_ord) AS k
  FROM (SELECT c.*, c.raw * {_PENALTY} AS score FROM match_candidates c JOIN forms f ON f.form_id = c.form_id LEFT JOIN peek_value v ON v.slug = f.slug AND v.key = c.key) s) r
WHERE k = 1 AND score >= CASE WHEN exact THEN {SURE} ELSE {NEAR} END"""


def distribute(d: Spark) -> str:
    """A value over the boxes of a group: by its canonical grouping if the boxes are as many, else by what each box takes.

    Digits are dealt, or the value itself where it has none. Each box gets one character at least, in order.
    """
    digits = d.rx("v.value", "[^0-9]", "")
    take = f"greatest(1, CAST({d.half_even('CAST(length(digits) AS DOUBLE) * greatest(1, cap) / total')} AS BIGINT))"
    return f"""
WITH anchors AS (
  SELECT b.form_id, b.grp, min_by(m.key, b.grp_index) AS key FROM blanks b JOIN match_blank m ON m.form_id = b.form_id AND m.blank_id = b.blank_id WHERE b.grp IS NOT NULL GROUP BY b.form_id, b.grp),
boxes_ AS (
  SELECT b.form_id, b.grp, b.blank_id, b.grp_index, a.key, COUNT(*) OVER (PARTITION BY b.form_id, b.grp) AS n, CASE WHEN {digits} = '' THEN v.value ELSE {digits} END AS digits, CAST({T.capacity('b.max_chars', 'b.width_pt', 'b.height_pt', 'b.kind')} AS BIGINT) AS cap
  FROM blanks b JOIN anchors a ON a.form_id = b.form_id AND a.grp = b.grp JOIN forms f ON f.form_id = b.form_id JOIN resolve_value v ON v.slug = f.slug AND v.key = a.key),
dealt AS (SELECT *, {take} AS take FROM (SELECT *, SUM(greatest(1, cap)) OVER (PARTITION BY form_id, grp) AS total FROM boxes_) t),
placed AS (SELECT *, 1 + SUM(take) OVER (PARTITION BY form_id, grp ORDER BY grp_index) - take AS at_ FROM dealt)
SELECT p.form_id, p.grp, p.blank_id, p.key, substr(p.digits, CAST(coalesce(s.at_, p.at_) AS INT), CAST(coalesce(s.n_chars, p.take) AS INT)) AS part
FROM placed p LEFT JOIN splits s ON s.key = p.key AND s.n_parts = p.n AND s.part_no = p.grp_index"""


OPERATORS = [
    Operator("normalize_label", ("blanks",), normalize_label),
    Operator("slot_weights", ("blanks",), slot_weights),
    Operator("label_texts", ("slot_weights",), label_texts),
    Operator("alias_exact", ("label_texts", "aliases"), alias_exact),
    Operator("alias_fuzzy", ("label_texts", "alias_exact"), lambda d: CHECKS["alias_fuzzy"], alias_fuzzy),
    Operator("alias_hits", ("alias_exact", "alias_fuzzy", "aliases", "label_texts"), alias_hits),
    Operator("alias_veto", ("alias_hits", "label_texts", "vetoes"), alias_veto),
    Operator("score_key", ("alias_veto",), score_key),
    Operator("rank_keys", ("score_key",), rank_keys),
    Operator("text_verdicts", ("blanks",), text_verdicts),
    Operator("own_section", ("blanks", "text_verdicts"), own_section),
    Operator("own_block", ("blanks", "text_verdicts"), own_block),
    Operator("leading_qualifier", ("label_texts", "vetoes", "aliases", "blanks"), leading_qualifier),
    Operator("qualifier_lists", ("leading_qualifier",), qualifier_lists),
    Operator("match_candidates", ("blanks", "score_key", "text_verdicts", "qualifier_lists"), match_candidates),
    Operator("capacity_penalty", ("match_candidates", "forms", "peek_value"), capacity_penalty),
    Operator("match_blank", ("match_candidates", "forms", "peek_value"), match_blank),
    Operator("distribute", ("blanks", "match_blank", "forms", "resolve_value", "splits"), distribute),
]
