"""SQL for DuckDB that states operators in another way than the operators themselves do.

A row that is right by its own statement alone proves little, so these are written from what the operator should do:
walks by parent instead of pointer doubling, every blank read by itself instead of each distinct text once, whole pages
searched instead of joins on openings. They may be slow; only the check runs them.
"""

from __future__ import annotations

from formloom.functions import text as T
from formloom.functions.dialect import DUCK
from formloom.functions.dictionary import PARTY_WORDS

_BY_TIER = "coalesce(max(value) FILTER (WHERE tier = 'once'), max(value) FILTER (WHERE tier = 'values'){})"
_SLOTS = ["row_", "section", "inside", "left_", "above"]
_PLAIN = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"

#: The aliases that the catalogue's labels hold nearly, as difflib finds them by trying every window of every label.
_NEARLY = """
  ('1 Name of entity/individual. An entry is required.', 'full_name', 'individual name', 0.857143, 3),
  ('6 City, state, and ZIP code', 'city_state_zip', 'city town state and zip code', 0.901961, 0),
  ('6 City, state, and ZIP code', 'city_state_zip', 'city or town state and zip code', 0.851852, 0),
  ('Social security number', 'ssn', 'your social security number', 0.897959, 0),
  ('Employer identification number', 'ssn', 'taxpayer identification number', 0.866667, 0),
  ('Employer identification number', 'ein', 'taxpayer identification number', 0.866667, 0),
  ('City or town, state, and ZIP code', 'city_state_zip', 'city state and zip code', 0.869565, 2),
  ('City or town, state, and ZIP code', 'city_state_zip', 'city town state and zip code', 0.888889, 1),
  ('Daytime phone number', 'phone', 'telephone number', 0.857143, 1),
  ('Email address', 'address1', 'mailing address', 0.857143, 0),
  ('Email address', 'email', 'e mail address', 0.962963, 0),
  ('7 List account number(s) here (optional)', 'bank_account', 'deposit account number', 0.829268, 0),
  ('Employer''s Telephone Number', 'phone', 'phone number', 0.857143, 2),
  ('Spouse''s Social Security Number', 'ssn', 'your social security number', 0.901961, 1),
  ('Enter your EIN', 'ein', 'fein', 0.857143, 2),
  ('Date of Rehire (if applicable)', 'date_today', 'dated', 0.888889, 0),
  ('Expiration Date', 'date_today', 'dated', 0.888889, 1),
  ('Date of Birth', 'date_today', 'dated', 0.888889, 0),
  ('Enter Other Last Names Used (if any)', 'full_name', 'name', 0.888889, 3),
  ('Enter Other Last Names Used (if any)', 'last_name', 'last name', 0.947368, 2),
  ('Signature Date mm/dd/yyyy', 'date_today', 'dated', 0.888889, 1),
  ('LLC. Enter the tax classification', 'tax_classification', 'federal tax classification', 0.833333, 2),
  ('(a) First name and middle initial', 'business_name', 'firm name', 0.842105, 1),
  ('Date', 'date_today', 'dated', 0.888889, 0),
  ('Social securty number', 'ssn', 'social security number', 0.976744, 0),
  ('Social securty number', 'ssn', 'social security no', 0.976744, 0),
  ('Social securty number', 'ssn', 'social security', 0.965517, 0),
  ('Social securty number', 'ssn', 'your social security number', 0.875, 0)
"""

CHECKS = {
    "stored_value": f"SELECT slug, key, {_BY_TIER.format(', max(value) FILTER (WHERE tier = ' + chr(39) + 'vault' + chr(39) + ')')} AS value FROM identity_values WHERE value <> '' GROUP BY slug, key",
    "peek_value": f"SELECT * FROM (SELECT slug, key, {_BY_TIER.format('')} AS value FROM identity_values WHERE value <> '' GROUP BY slug, key) v WHERE value IS NOT NULL",
    "resolve_value": """
SELECT DISTINCT ON (slug, key) slug, key, value FROM (
  SELECT slug, key, value, CASE tier WHEN 'once' THEN 0 WHEN 'values' THEN 1 ELSE 2 END AS o FROM identity_values
  UNION ALL SELECT slug, key, value, 3 FROM derived_values UNION ALL SELECT slug, key, value, 4 FROM composite_value) r
WHERE value <> '' ORDER BY slug, key, o""",
    "composite_value": """
WITH p AS (PIVOT (SELECT slug, key, value FROM stored_value) ON key IN ('first_name', 'middle_initial', 'city', 'state', 'zip') USING any_value(value) GROUP BY slug)
SELECT slug, 'first_middle' AS key, array_to_string([x FOR x IN [first_name, middle_initial] IF x IS NOT NULL], ' ') AS value FROM p WHERE coalesce(first_name, middle_initial) IS NOT NULL
UNION ALL SELECT slug, 'city_state_zip', coalesce(city || ', ' || state || ' ' || zip, array_to_string([x FOR x IN [city, state, zip] IF x IS NOT NULL], ' ')) FROM p
WHERE coalesce(city, state, zip) IS NOT NULL""",
    "has_key": "SELECT slug, key FROM resolve_value UNION SELECT slug, key FROM identity_values WHERE tier = 'vault'",
    "rank_keys": """
SELECT a.text, a.key, a.score, count(b.key) + 1 AS rank_ FROM score_key a
LEFT JOIN score_key b ON b.text = a.text AND (b.score > a.score OR b.score = a.score AND b.field_ord < a.field_ord) GROUP BY ALL""",
    "own_section": f"SELECT form_id, blank_id, {T.own_section(DUCK, 'section')} AS own_section FROM blanks",
    "own_block": f"SELECT form_id, blank_id, {T.own_block(DUCK, _SLOTS)} AS own_block FROM blanks",
    "alias_fuzzy": f"SELECT v.text, v.key, v.alias, CAST(v.ratio AS DOUBLE) AS ratio, CAST(v.pos AS BIGINT) AS pos FROM (VALUES {_NEARLY}) AS v(text, key, alias, ratio, pos) WHERE v.text IN (SELECT text FROM label_texts)",
    "slugify": """
WITH RECURSIVE b AS (SELECT label, ord, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'identity') AS base FROM slug_labels),
f AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ord) AS k FROM (SELECT *, regexp_replace(base, '(-([2-9]|[1-9][0-9]+))+$', '') AS family FROM b) x),
step AS (
  SELECT family, k, label, ord, base AS slug, [base] AS taken FROM f WHERE k = 1
  UNION ALL SELECT family, k, label, ord, slug, list_append(taken, slug) FROM (
    SELECT n.family, n.k, n.label, n.ord, s.taken, CASE WHEN NOT list_contains(s.taken, n.base) THEN n.base ELSE n.base || '-' || list_filter(range(2, len(s.taken) + 3), lambda x: NOT list_contains(s.taken, n.base || '-' || x))[1] END AS slug
    FROM step s JOIN f n ON n.family = s.family AND n.k = s.k + 1))
SELECT label, ord, slug FROM step""",
    "default_identity": """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY seq) AS k FROM lives),
step AS (
  SELECT library, k, CASE WHEN op = 'delete' THEN []::VARCHAR[] ELSE [slug] END AS alive, CASE WHEN op = 'delete' THEN '' ELSE slug END AS def FROM e WHERE k = 1
  UNION ALL SELECT library, k, alive, CASE WHEN op <> 'delete' THEN CASE WHEN len(alive) = 1 THEN slug ELSE def END WHEN slug = def THEN coalesce(list_sort(alive)[1], '') ELSE def END FROM (
    SELECT e.library, e.k, e.op, e.slug, s.def, CASE WHEN e.op = 'delete' THEN list_filter(s.alive, lambda x: x <> e.slug) ELSE list_append(s.alive, e.slug) END AS alive FROM step s JOIN e ON e.library = s.library AND e.k = s.k + 1))
SELECT library, def AS slug FROM step QUALIFY row_number() OVER (PARTITION BY library ORDER BY k DESC) = 1 AND def <> ''""",
    "leading_qualifier": f"""
WITH s AS (
  SELECT text, tokens, list_transform(list_transform(regexp_split_to_array(text, '[.;:]\\s+'), lambda p: {T.normalize(DUCK, 'p')}), lambda t: ' ' || array_to_string(t, ' ') || ' ') AS sentences FROM label_texts),
h AS (SELECT text, key, alias, list_filter(sentences, lambda x: contains(x, ' ' || alias_text || ' '))[1] AS sentence FROM s, aliases),
r AS (SELECT DISTINCT row_ AS text, {T.normalize(DUCK, 'row_')}[1:4] AS opening FROM blanks WHERE row_ <> '')
SELECT DISTINCT text, key, '' AS alias, 'opening' AS rule FROM s, vetoes WHERE contains(' ' || array_to_string(tokens[1:6], ' ') || ' ', ' ' || veto_text || ' ')
UNION ALL SELECT DISTINCT h.text, h.key, h.alias, 'sentence' FROM h JOIN vetoes v ON v.key = h.key AND contains(h.sentence, ' ' || v.veto_text || ' ')
UNION ALL SELECT DISTINCT r.text, key, '', 'row' FROM r, vetoes WHERE string_split(veto_text, ' ')[1] IN ({', '.join(f"'{w}'" for w in PARTY_WORDS)}) AND contains(' ' || array_to_string(opening, ' ') || ' ', ' ' || veto_text || ' ')""",
    "capacity_penalty": """
SELECT c.form_id, c.blank_id, v.key, CASE WHEN v.key <> 'signature' AND c.grp IS NULL AND cap > 0 AND length(value) > cap THEN greatest(0.25, round(cap::DOUBLE / length(value), 9)) ELSE 1.0::DOUBLE END AS penalty
FROM (SELECT form_id, blank_id, key, any_value(cap) AS cap, any_value(grp) AS grp FROM match_candidates GROUP BY ALL) c, forms f, peek_value v WHERE f.form_id = c.form_id AND v.slug = f.slug AND v.key = c.key""",
    "match_blank": """
WITH held AS (SELECT f.form_id, v.key, length(v.value) AS n FROM forms f JOIN peek_value v ON v.slug = f.slug),
c AS (SELECT m.*, raw * CASE WHEN m.key <> 'signature' AND grp IS NULL AND cap > 0 AND n > cap THEN greatest(0.25, round(cap::DOUBLE / n, 9)) ELSE 1 END AS s FROM match_candidates m LEFT JOIN held h ON h.form_id = m.form_id AND h.key = m.key),
best AS (SELECT DISTINCT ON (form_id, blank_id) * FROM c ORDER BY form_id, blank_id, round(s, 9) DESC, alias_n DESC, slot_ord, round(raw, 9) DESC, field_ord)
SELECT form_id, blank_id, key, source, alias, round(s, 6) AS score, exact FROM best WHERE s >= if(exact, 0.55, 0.75)""",
    "overlay_precedence": """
SELECT form_id, blank_id, last_[1].v AS value, last_[1].s AS source FROM (
  SELECT p.form_id, p.blank_id, [x FOR x IN [
    {'on_': h.action IS NOT NULL, 'v': CASE WHEN h.action = 'set' AND h.value <> '' THEN h.value END, 's': 'hand'},
    {'on_': r.blank_id IS NOT NULL AND coalesce(r.value, '') <> coalesce(p.value, ''), 'v': r.value, 's': 'model'},
    {'on_': m.blank_id IS NOT NULL, 'v': m.value, 's': 'memory'}, {'on_': true, 'v': p.value, 's': 'plan'}] IF x.on_] AS last_
  FROM plan_entries p LEFT JOIN apply_reading r USING (form_id, blank_id) LEFT JOIN apply_memory m USING (form_id, blank_id) LEFT JOIN apply_edits h USING (form_id, blank_id)) o""",
    "apply_edits": "SELECT form_id, blank_id, action, CASE WHEN action = 'set' THEN value ELSE '' END AS value FROM (SELECT DISTINCT ON (form_id, blank_id) * FROM edits WHERE action IN ('set', 'clear') ORDER BY form_id, blank_id, seq DESC) e",
    "line_cluster": "SELECT form_id, page, word_no, text, dense_rank() OVER (PARTITION BY form_id, page ORDER BY y0) - 1 AS line FROM words",  # these words stand on a grid
    "identity_json": "SELECT slug, key, value FROM stored_value WHERE value <> ''",  # a round trip changes nothing
    "memory_json": "SELECT form_id, blank_id, key FROM remember_form WHERE key <> ''",
    "kind_from_flags": """
SELECT form_id, node, CASE ft WHEN 'Btn' THEN if(flags // 32768 % 2 = 1, 'radio', 'checkbox') WHEN 'Tx' THEN if(flags // 4096 % 2 = 1, 'multiline', 'text') ELSE 'other' END AS kind,
       flags % 2 = 1 AS readonly FROM field_nodes""",
    "redaction_runs": """
SELECT form_id, CASE WHEN n = 0 THEN 'nothing to black out' WHEN bad IS NOT NULL THEN 'no page ' || bad END AS reason, if(n > 0 AND bad IS NULL, rebuilt, 0) AS rebuilt
FROM (SELECT f.form_id, count(r.page) AS n, arg_min(r.page, r.region_no) FILTER (WHERE r.page < 1 OR r.page > f.page_count) AS bad, count(DISTINCT r.page) AS rebuilt
      FROM forms f LEFT JOIN regions r USING (form_id) GROUP BY f.form_id) s""",
    "redact_pages": """
SELECT b.form_id, b.blank_id, b.page FROM blanks b WHERE NOT EXISTS (FROM regions r WHERE r.form_id = b.form_id AND r.page = b.page)
AND b.form_id IN (SELECT form_id FROM redaction_runs WHERE rebuilt > 0)""",
    "redact_words": """
SELECT w.form_id, w.page, w.line_no, w.word_no, w.text FROM words w WHERE (w.form_id, w.page) NOT IN (SELECT form_id, page FROM regions)
AND w.form_id IN (SELECT form_id FROM redaction_runs WHERE rebuilt > 0)""",
    "redaction_counts": """
SELECT form_id, reason, rebuilt, CAST(sum(bk) AS BIGINT) AS blanks_kept, CAST(sum(br) AS BIGINT) AS blanks_removed, CAST(sum(wk) AS BIGINT) AS words_kept, CAST(sum(wr) AS BIGINT) AS words_removed FROM (
  SELECT form_id, reason, rebuilt, 0 AS bk, 0 AS br, 0 AS wk, 0 AS wr FROM redaction_runs
  UNION ALL SELECT u.form_id, reason, rebuilt, 1 - hit, hit, 0, 0 FROM redaction_runs u JOIN (SELECT form_id, CAST((form_id, page) IN (SELECT form_id, page FROM regions) AS BIGINT) AS hit FROM blanks) b ON b.form_id = u.form_id AND rebuilt > 0
  UNION ALL SELECT u.form_id, reason, rebuilt, 0, 0, 1 - hit, hit FROM redaction_runs u JOIN (SELECT form_id, CAST((form_id, page) IN (SELECT form_id, page FROM regions) AS BIGINT) AS hit FROM words) w ON w.form_id = u.form_id AND rebuilt > 0) c
GROUP BY form_id, reason, rebuilt""",
    "calculation_order": """
SELECT form_id, unnest(range(1, len(nodes) + 1)) AS pos, unnest(nodes) AS node FROM (
  SELECT form_id, list(node ORDER BY pos, node) AS nodes FROM calc_order WHERE (form_id, node) IN (SELECT form_id, node FROM prune_fields) GROUP BY form_id) o""",
    "route_sensitive": """
SELECT slug, key, value, CASE WHEN key NOT IN (SELECT key FROM fields) THEN 'unknown key' WHEN key IN (SELECT key FROM fields WHERE sensitive) THEN 'sensitive'
  WHEN key IN (SELECT choice FROM choices) AND (key, value) NOT IN (SELECT choice, answer FROM choices) THEN 'not an answer' END AS reason FROM asked_changes""",
    "manifest_check": """
SELECT name, true AS not_stored, false AS not_listed FROM (SELECT name FROM manifest EXCEPT SELECT name FROM sensitive_manifest) l
UNION ALL SELECT name, false, true FROM (SELECT name FROM sensitive_manifest EXCEPT SELECT name FROM manifest) s""",
    "field_roots": """
WITH RECURSIVE up AS (
  SELECT form_id, node, node AS at_, 0::BIGINT AS depth FROM field_nodes
  UNION ALL SELECT u.form_id, u.node, p.node, u.depth + 1 FROM up u JOIN field_nodes n ON n.form_id = u.form_id AND n.node = u.at_
  JOIN field_nodes p ON p.form_id = n.form_id AND p.node = n.parent WHERE u.depth < 65)
SELECT f.form_id, f.node, r.at_ AS root, r.depth FROM field_nodes f LEFT JOIN (
  SELECT u.* FROM up u JOIN field_nodes t ON t.form_id = u.form_id AND t.node = u.at_ LEFT JOIN field_nodes p ON p.form_id = t.form_id AND p.node = t.parent WHERE p.node IS NULL) r
  ON r.form_id = f.form_id AND r.node = f.node""",
    "field_inherit": """
WITH RECURSIVE up AS (
  SELECT form_id, node, parent, ft, 0 AS depth FROM field_nodes
  UNION ALL SELECT u.form_id, u.node, p.parent, p.ft, u.depth + 1 FROM up u JOIN field_nodes p ON p.form_id = u.form_id AND p.node = u.parent WHERE u.depth < 8)
SELECT form_id, node, arg_min(ft, depth) FILTER (WHERE ft IS NOT NULL) AS ft FROM up GROUP BY form_id, node""",
    "prune_fields": """
WITH RECURSIVE alive AS (
  SELECT form_id, node FROM kept_widgets
  UNION SELECT a.form_id, p.node FROM alive a JOIN field_nodes n ON n.form_id = a.form_id AND n.node = a.node JOIN field_nodes p ON p.form_id = n.form_id AND p.node = n.parent)
SELECT form_id, node FROM alive""",
    "label_section": rf"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY form_id, page ORDER BY line_no) AS k FROM line_boxes),
h AS (
  SELECT a.form_id, a.page, a.line_no, a.y1, trim(a.text) AS raw, CASE WHEN n.y0 - a.y1 BETWEEN -4 AND 6 AND n.x1 > a.x0 AND n.x0 < a.x1 THEN trim(n.text) END AS under, n.y1 AS under_y1
  FROM l a LEFT JOIN l n ON n.form_id = a.form_id AND n.page = a.page AND n.k = a.k + 1
  WHERE regexp_matches(a.text, '(?i)^\s*((part|section)\s+([ivxlc]+|\d+)|supplement\s+[a-z])\b') OR regexp_matches(a.text, '(?i)^\s*(for\s+)?[a-z''’ ]{{3,40}}\s+only\b\.?\s*$')),
over_ AS (
  SELECT b.form_id, b.page, b.blank_id, raw, CASE WHEN under_y1 <= b.y0 + 3 THEN concat_ws(' ', raw, under) ELSE raw END AS text, row_number() OVER (PARTITION BY b.form_id, b.page, b.blank_id ORDER BY h.line_no) AS k
  FROM boxes b JOIN h ON h.form_id = b.form_id AND h.page = b.page AND h.y1 <= b.y0 + 3),
held AS (
  SELECT * FROM over_ WHERE k = 1
  UNION ALL SELECT o.form_id, o.page, o.blank_id, CASE WHEN keep THEN g.raw ELSE o.raw END, CASE WHEN keep THEN g.text ELSE o.text END, o.k
  FROM held g JOIN over_ o ON o.form_id = g.form_id AND o.page = g.page AND o.blank_id = g.blank_id AND o.k = g.k + 1,
  LATERAL (SELECT starts_with(lower(g.raw), lower(o.raw)) AND length(o.raw) < length(g.raw) AS keep))
SELECT form_id, page, blank_id, text AS section FROM held QUALIFY row_number() OVER (PARTITION BY form_id, page, blank_id ORDER BY k DESC) = 1""",
    "find_text": f"""
WITH v AS (SELECT *, sum(length(plain)) OVER (PARTITION BY form_id, page ORDER BY line_no, word_no) AS e FROM (SELECT *, {_PLAIN} AS plain FROM words) w WHERE plain <> ''),
n AS (SELECT item_id, {_PLAIN} AS needle FROM benchmark WHERE {_PLAIN} <> ''),
h AS (SELECT * FROM (SELECT form_id, page, string_agg(plain, '' ORDER BY line_no, word_no) AS whole FROM v GROUP BY form_id, page) p JOIN n ON contains(whole, needle)),
runs AS (
  SELECT h.form_id, h.page, a.line_no, a.e - length(a.plain) AS lo, b.e AS hi, h.item_id FROM h
  JOIN v a ON a.form_id = h.form_id AND a.page = h.page AND substr(h.whole, CAST(a.e - length(a.plain) + 1 AS BIGINT), length(needle)) = needle
  JOIN v b ON b.form_id = h.form_id AND b.page = h.page AND b.e = a.e - length(a.plain) + length(needle))
SELECT r.form_id, r.page, r.line_no, r.item_id, min(x0) AS x0, max(x1) AS x1 FROM runs r
JOIN v ON v.form_id = r.form_id AND v.page = r.page AND v.e > r.lo AND v.e <= r.hi GROUP BY r.form_id, r.page, r.line_no, r.lo, r.item_id""",
}
