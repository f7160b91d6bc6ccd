"""Tables of the form model, derived from the star-schema tables by SQL that both engines run."""

from __future__ import annotations

from formloom.functions import dictionary
from formloom.functions.dialect import Spark

# Fixed values. Labels and section headings that the derived blanks carry, by number.
LABELS = """
1 Name of entity/individual. An entry is required.
2 Business name/disregarded entity name, if different from above
6 City, state, and ZIP code
Social security number
Employer identification number
See 5Address (number, street, and apt. or suite no.). See instructions.
City or town, state, and ZIP code
Last name
Home address
Daytime phone number
Email address
7 List account number(s) here (optional)
Requester's name and address (optional)
4 Exemptions (codes apply only to certain entities)
Enter the amount from line 7
Preparer or Translator ZIP Code
Employer's Telephone Number
Spouse's Social Security Number
Witness Name
Enter your EIN
Date of Rehire (if applicable)
Expiration Date
Date of Birth
Enter Other Last Names Used (if any)
Section 1., Enter City or Town.
Signature Date mm/dd/yyyy
Single or Married filing separately
Married filing jointly or Qualifying surviving spouse
Head of household
C corporation
S corporation
LLC. Enter the tax classification
(a) First name and middle initial
Apt. or suite no.
State
ZIP code
TIN
Date
Social securty number
OnlyEmployer's use
""".strip().split("\n")
#: Lines that forms have and prose lacks; they stand for some of the documents' lines.
FORM_LINES = ["Part II. Certification", "Section 2. Employer Review", "Section 2", "Supplement A, USCIS", "Supplement A", "For Office Use Only", "Employers Only",
              "Signature of", "Employee's signature (This form is not valid unless you sign it.)", "Name: ____________ ____", "________________ City_______", "and the address of the taxpayer . . . ."]
SECTIONS = ["", "", "", "", "", "", "", "Section 2. Employer Review and Verification", "Supplement A. Preparer and/or Translator Certification",
            "Section 1. Employee Information and Attestation: Employees must complete and sign", "Employers Only", "Part II."]


def _values(items: list[str], head: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{x.replace(chr(39), chr(39) * 2)}{chr(39)})' for k, x in enumerate(items))}) AS t({head})"


def _c(x: str) -> str:
    return f"concat('c', CAST({x} AS STRING))"


def tables(d: Spark) -> dict[str, tuple[str, tuple[str, ...]]]:
    """SQL and inputs of every derived table."""
    out = {
        "label_catalogue": (_values(LABELS, "label_id, label"), ()),
        "section_catalogue": (_values(SECTIONS, "section_id, section"), ()),
        **{n: (dictionary.values_sql(n), ()) for n in ("aliases", "vetoes", "fields", "choices", "splits")},
        "forms": (f"SELECT o_orderkey AS form_id, {_c('o_custkey')} AS slug, CASE WHEN o_orderkey % 5 = 0 THEN 'docx' ELSE 'pdf' END AS fmt, CAST(1 + o_orderkey % 4 AS BIGINT) AS page_count FROM orders", ("orders",)),
        # single blanks of a form, and on some forms a number's boxes side by side: three or two, some locked, some too many
        "blanks0": (f"""
SELECT l_orderkey AS form_id, CAST(l_linenumber AS BIGINT) AS blank_no, concat('b', CAST(l_linenumber AS STRING)) AS blank_id,
       MIN(l_partkey) % 40 AS label_id, MIN(l_suppkey) % 12 AS section_id,
       CASE WHEN MIN(l_partkey) % 7 = 0 THEN 'checkbox' WHEN MIN(l_partkey) % 11 = 0 THEN 'signature'
            WHEN MIN(l_partkey) % 5 = 0 THEN 'multiline' ELSE 'text' END AS kind,
       CAST(14 + (MIN(l_partkey) * 7) % 300 AS DOUBLE) AS width_pt, CAST(10 + MIN(l_suppkey) % 30 AS DOUBLE) AS height_pt,
       CAST(1 + l_linenumber % 3 AS BIGINT) AS page, MIN(l_partkey) % 29 = 0 AS readonly, MIN(l_suppkey) % 17 = 0 AS scanned,
       CAST(40 + l_linenumber * 97 % 200 AS DOUBLE) AS x0, CAST(60 + l_linenumber * 40 AS DOUBLE) AS y0, CAST(0 AS BIGINT) AS member
FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL
SELECT form_id, 101 + i, concat('b', CAST(101 + i AS STRING)), CASE form_id % 8 WHEN 3 THEN CASE WHEN form_id % 5 = 0 THEN 36 ELSE 3 END WHEN 5 THEN 19 ELSE 4 END, 0, 'text', CAST(50 + 5 * i AS DOUBLE), CAST(14 AS DOUBLE), 1, form_id % 96 = 3 AND i = 1, form_id % 72 = 5,
       CAST(40 + 70 * i AS DOUBLE), CAST(700 AS DOUBLE), 1 + i
FROM {d.each("(SELECT o_orderkey AS form_id, " + d.seq("1", "CASE WHEN o_orderkey % 8 = 5 THEN 2 ELSE 3 END") + " AS seq_ FROM orders WHERE o_orderkey % 8 IN (3, 5, 7))", "seq_", "i", "j")} g""", ("lineitem", "orders")),
        "raw_blanks": ("""
SELECT form_id, blank_no, blank_id, label_id, kind, page, x0, y0, x0 + width_pt AS x1, y0 + height_pt AS y1, width_pt, height_pt, CASE WHEN label_id % 5 = 0 THEN 20 + label_id END AS max_chars, readonly, scanned,
       CASE WHEN label_id % 8 = 7 THEN label ELSE '' END AS inside, CASE WHEN kind = 'checkbox' THEN label ELSE '' END AS right_,
       CASE WHEN label_id % 8 NOT IN (6, 7) AND kind <> 'checkbox' THEN label ELSE '' END AS left_,
       CASE WHEN label_id % 8 = 6 THEN label ELSE '' END AS above, section, CASE WHEN blank_no % 13 = 5 AND label_id % 3 = 0 THEN 'Employers name and address' ELSE '' END AS row_,
       CASE WHEN blank_no % 2 = 0 AND member = 0 THEN concat('f1_', CAST(blank_no AS STRING)) ELSE '' END AS native_name, CASE WHEN blank_no % 5 = 2 THEN concat('Enter ', label) ELSE '' END AS tooltip, label_id % 10 = 9 AS authoritative, label
FROM (SELECT b.*, CASE member WHEN 2 THEN '-' WHEN 3 THEN '' ELSE c.label END AS label, s.section FROM blanks0 b JOIN label_catalogue c ON c.label_id = b.label_id JOIN section_catalogue s ON s.section_id = b.section_id) b""", ("blanks0", "label_catalogue", "section_catalogue")),
        "blanks": ("""
SELECT r.form_id, r.blank_no, r.blank_id, r.label_id, r.kind, r.page, r.x0, r.y0, r.x1, r.y1, r.width_pt, r.height_pt, r.max_chars, r.readonly, r.scanned, r.inside, r.right_, r.left_,
       CASE WHEN g.grp IS NOT NULL AND r.left_ = '' AND r.above = '' THEN g.shared ELSE r.above END AS above, r.section, r.row_, r.native_name, r.authoritative, r.label, g.grp, g.grp_index
FROM raw_blanks r LEFT JOIN split_groups g ON g.form_id = r.form_id AND g.blank_id = r.blank_id""", ("raw_blanks", "split_groups")),
        "identities": (f"SELECT {_c('c_custkey')} AS slug, c_name AS label, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'person' END AS kind, c_custkey AS ord, CASE WHEN c_custkey % 9 = 5 THEN 'ein' ELSE '' END AS prefers FROM customer UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), s_name, 'business', 1000000000 + s_suppkey, '' FROM supplier", ("customer", "supplier")),
        "run_prefers": ("SELECT slug, 'ein' AS key FROM identities WHERE ord % 7 = 0", ("identities",)),
        "default_slug": ("SELECT min_by(slug, ord) AS slug FROM identities", ("identities",)),
        "asked_names": ("SELECT form_id, CASE WHEN form_id % 3 = 0 THEN upper(concat('customer#', lpad(substr(slug, 2), 9, '0'))) WHEN form_id % 7 = 0 THEN 'nobody' ELSE slug END AS name FROM forms", ("forms",)),
        "files": ("SELECT concat('/in/p', CAST(page_id AS STRING), CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '-filled.pdf' WHEN 3 THEN '.docx' WHEN 4 THEN '.pdf' ELSE '.html' END) AS path, CAST(length(html) AS BIGINT) AS length, page_id * 7919 % 10007 AS modified FROM pages", ("pages",)),
        # how many blanks a file was found to have; some could not be read
        "blank_counts": ("SELECT path, length % 9 AS blanks FROM files WHERE length % 5 <> 0 UNION ALL SELECT path, MAX(size) % 9 FROM arrivals WHERE size % 5 <> 0 GROUP BY path", ("files", "arrivals")),
        # bodies of documents, some declared, some in UTF-16 of either byte order, some missing
        "parts": (f"""
SELECT path, CASE WHEN page_id % 11 = 10 THEN NULL ELSE unhex(CASE page_id % 3 WHEN 1 THEN concat('FFFE', {d.rx('h', '(..)', chr(92) + '100')}) WHEN 2 THEN {d.rx('h', '(..)', '00' + chr(92) + '1')} ELSE h END) END AS body
FROM (SELECT page_id, concat('/in/p', CAST(page_id AS STRING)) AS path, hex(encode_(concat(CASE WHEN page_id % 5 = 0 THEN '<!doctype x>' WHEN page_id % 7 = 0 THEN '<!Entity a>' ELSE '<?xml?>' END, CASE WHEN page_id % 4 = 0 THEN '' ELSE '<w:body/>' END, {d.rx('left(html, 200)', '[^ -;=-~]', '?')}))) AS h FROM pages) p""".replace("encode_(", "encode(" if d.name == "duck" else "("), ("pages",)),
        # labels of which many make one slug, some with a number that another's slug may have taken
        "slug_labels": ("SELECT ord, concat('Shop ', CAST(ord % 61 AS STRING), CASE ord % 7 WHEN 0 THEN ' & Co.' WHEN 1 THEN concat(' & co ', CAST(2 + ord % 9 AS STRING)) WHEN 2 THEN ' Co' WHEN 3 THEN concat('-co-', CAST(ord % 4 AS STRING), '-2') WHEN 4 THEN ' CO!' ELSE concat(' Co ', CAST(ord % 5 AS STRING)) END) AS label FROM identities", ("identities",)),
        # changes to identities: fifty libraries of a few identities each
        "changes": ("""
SELECT event_id % 50 AS library, event_id AS seq, CASE event_id % 10 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' WHEN 2 THEN 'set_kind' WHEN 3 THEN 'set_preference' WHEN 4 THEN 'rename' ELSE 'set' END AS op,
       concat('p', CAST((event_id // 7 + user_id) % 6 AS STRING)) AS slug,
       CASE WHEN event_id % 10 = 3 THEN CASE user_id % 3 WHEN 0 THEN 'ssn' WHEN 1 THEN 'ein' ELSE 'phone' END WHEN event_id % 10 > 4 THEN CASE user_id % 6 WHEN 0 THEN 'city' WHEN 1 THEN 'zip' WHEN 2 THEN 'ssn' WHEN 3 THEN 'no_such_key' WHEN 4 THEN 'filing_status' ELSE 'tax_classification' END END AS key,
       CASE event_id % 10 WHEN 0 THEN CASE user_id % 3 WHEN 0 THEN 'business' WHEN 1 THEN 'person' ELSE 'ghost' END WHEN 2 THEN CASE user_id % 4 WHEN 0 THEN 'ghost' WHEN 1 THEN 'person' ELSE 'business' END WHEN 4 THEN CASE user_id % 5 WHEN 0 THEN '  ' ELSE concat(' Label ', CAST(event_id % 13 AS STRING), ' ') END
            ELSE CASE user_id % 6 WHEN 4 THEN CASE event_id % 3 WHEN 0 THEN 'single' ELSE 'nonsense' END WHEN 5 THEN CASE event_id % 3 WHEN 0 THEN 'c_corp' ELSE '' END ELSE CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('v', CAST(event_id AS STRING)) END END END AS value,
       CASE WHEN event_id % 10 = 0 THEN CASE WHEN user_id % 4 = 0 THEN ' ' ELSE concat('New ', CAST(user_id AS STRING)) END END AS label FROM events""".replace("//", "//" if d.name == "duck" else "DIV"), ("events",)),
        "identity_values": (f"""
SELECT {_c('c_custkey')} AS slug, 'full_name' AS key, c_name AS value, 'values' AS tier FROM customer
UNION ALL SELECT {_c('c_custkey')}, 'state', n_name, 'values' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0
UNION ALL SELECT {_c('c_custkey')}, 'city', concat('City ', CAST(c_custkey % 97 AS STRING)), CASE WHEN c_custkey % 2 = 0 THEN 'once' ELSE 'values' END FROM customer WHERE c_custkey % 3 <> 1
UNION ALL SELECT {_c('c_custkey')}, 'city', 'Old town', 'vault' FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT {_c('c_custkey')}, 'zip', lpad(CAST(c_custkey % 99999 AS STRING), 5, '0'), 'values' FROM customer WHERE c_custkey % 5 <> 2
UNION ALL SELECT {_c('c_custkey')}, 'address1', concat(CAST(c_custkey % 500 AS STRING), ' Main St'), 'values' FROM customer
UNION ALL SELECT {_c('c_custkey')}, 'address2', CASE WHEN c_custkey % 4 = 0 THEN '12' WHEN c_custkey % 4 = 1 THEN 'Suite 9' ELSE '' END, 'values' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT {_c('c_custkey')}, 'first_name', concat('First', CAST(c_custkey % 31 AS STRING)), 'values' FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT {_c('c_custkey')}, 'middle_initial', 'Q', 'values' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT {_c('c_custkey')}, 'last_name', concat('Last', CAST(c_custkey % 53 AS STRING)), 'values' FROM customer
UNION ALL SELECT {_c('c_custkey')}, 'tax_classification', CASE WHEN c_custkey % 3 = 0 THEN 'c_corp' WHEN c_custkey % 3 = 1 THEN 'llc_s' ELSE 'individual' END, 'values' FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT {_c('c_custkey')}, 'filing_status', CASE WHEN c_custkey % 2 = 0 THEN 'single' ELSE 'head_of_household' END, 'values' FROM customer WHERE c_custkey % 5 < 3
UNION ALL SELECT {_c('c_custkey')}, 'ssn', lpad(CAST((100000000 + c_custkey * 7919) % 1000000000 AS STRING), 9, '0'), 'vault' FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT {_c('c_custkey')}, 'ein', lpad(CAST((200000000 + c_custkey * 104729) % 1000000000 AS STRING), 9, '0'), 'vault' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'business_name', s_name, 'values' FROM supplier
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'ein', lpad(CAST((300000000 + s_suppkey * 7919) % 1000000000 AS STRING), 9, '0'), 'vault' FROM supplier""", ("customer", "supplier", "nation")),
        # changes asked of the plain tier, a manifest out of step with what is stored, and secrets set again or emptied
        "asked_changes": ("SELECT slug, CASE WHEN length(value) % 13 = 0 THEN concat(key, '_x') ELSE key END AS key, CASE WHEN slug LIKE '%7' THEN upper(value) ELSE value END AS value FROM identity_values", ("identity_values",)),
        "manifest": ("SELECT name FROM sensitive_manifest WHERE NOT name LIKE '%17/%' UNION ALL SELECT concat(slug, '/dob') FROM identities WHERE ord % 50 = 0", ("sensitive_manifest", "identities")),
        "sensitive_changes": ("SELECT slug, key, value, 1 AS seq FROM identity_values WHERE tier = 'vault' UNION ALL SELECT slug, key, CASE WHEN slug LIKE '%3' THEN '' ELSE concat(value, '0') END, 2 FROM identity_values WHERE tier = 'vault' AND (value LIKE '%7' OR slug LIKE '%3') UNION ALL SELECT slug, key, 'again', 3 FROM identity_values WHERE tier = 'vault' AND value LIKE '%77'", ("identity_values",)),
        "paragraphs": (f"SELECT doc_id AS form_id, CAST(seq AS BIGINT) AS seq, text_ AS text, CASE WHEN seq = 0 THEN 'Heading1' WHEN (doc_id + seq) % 11 = 0 THEN 'title' ELSE 'Normal' END AS style FROM {d.each('(SELECT doc_id, text FROM documents)', d.split('text', chr(92) + 'n'), 'seq', 'text_')}", ("documents",)),
        "form_lines": (_values(FORM_LINES, "line_id, line"), ()),
        "page_lines": ("SELECT p.form_id, p.seq, coalesce(f.line, p.text) AS text FROM paragraphs p LEFT JOIN form_lines f ON f.line_id = (p.form_id * 5 + p.seq) % 97", ("paragraphs", "form_lines")),
        "page_words": (f"SELECT form_id, seq, CAST(k AS BIGINT) AS k, word FROM {d.each('(SELECT form_id, seq, ' + d.split('text', ' ') + ' AS arr FROM page_lines)', 'arr', 'k', 'word')}", ("page_lines",)),
        "words0": (f"SELECT form_id, seq, CAST(k AS BIGINT) AS k, word FROM {d.each('(SELECT form_id, seq, ' + d.split('text', ' ') + ' AS arr FROM paragraphs)', 'arr', 'k', 'word')}", ("paragraphs",)),
        "words": (f"""
SELECT form_id, CAST(1 + seq // 60 AS BIGINT) AS page, seq % 60 AS line_no, k AS word_no, word AS text, CAST(5 * pre AS DOUBLE) AS x0, CAST(12 * (seq % 60) AS DOUBLE) AS y0,
       CAST(5 * (pre + length(word)) AS DOUBLE) AS x1, CAST(12 * (seq % 60) + 10 AS DOUBLE) AS y1
FROM (SELECT form_id, seq, k, word, SUM(length(word) + 1) OVER (PARTITION BY form_id, seq ORDER BY k) - length(word) - 1 AS pre FROM page_words) w WHERE word <> ''""".replace("//", "//" if d.name == "duck" else "DIV"), ("page_words",)),
        "boxes": ("""
SELECT form_id, page, line_no, concat('x', CAST(page AS STRING), '_', CAST(line_no AS STRING)) AS blank_id, x1 + 6 AS x0, y0 AS y0, x1 + CASE WHEN form_id % 3 = 0 THEN 20 ELSE 66 END AS x1, y1 AS y1
FROM words WHERE word_no = 2""", ("words",)),
        "word_pages": ("SELECT DISTINCT form_id, page, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height FROM words", ("words",)),
        # a rule or a thin rectangle after the third word of a line, some of them twice
        "strokes": ("""
SELECT form_id, page, x1 + 6 AS x0, x1 + 6 + CAST(form_id * 7 % 90 + line_no * 11 % 400 AS DOUBLE) AS x1, 792 - y1 AS y0, 792 - y1 + CAST(line_no % 4 AS DOUBLE) AS y1, CASE WHEN (form_id + line_no) % 2 = 0 THEN 'segment' ELSE 'rect' END AS src
FROM words WHERE word_no = 2 OR (word_no = 3 AND line_no % 7 = 0) UNION ALL
SELECT form_id, page, x1 + 6, x1 + 6 + CAST(form_id * 7 % 90 + line_no * 11 % 400 AS DOUBLE), 792 - y1 + 0.25, 792 - y1 + 0.25, 'segment' FROM words WHERE word_no = 2 AND line_no % 3 = 0""", ("words",)),
        "taken_boxes": ("SELECT form_id, page, x1 AS x0, 792 - y1 AS y0, x1 + 30 AS x1, 792 - y0 AS y1 FROM words WHERE word_no = 2 AND line_no % 5 = 4", ("words",)),
        "real_fields": ("SELECT DISTINCT form_id FROM words WHERE form_id % 11 = 3", ("words",)),
        "real_signatures": ("SELECT DISTINCT form_id, page FROM words WHERE form_id % 13 = 5", ("words",)),
        "field_nodes": ("""
SELECT l_orderkey AS form_id, CAST(l_linenumber AS BIGINT) AS node,
       CASE WHEN l_linenumber = 1 THEN NULL WHEN l_orderkey % 97 = 0 AND l_linenumber = 2 THEN CAST(2 AS BIGINT) ELSE CAST(floor(l_linenumber / 2) AS BIGINT) END AS parent,
       CASE WHEN MIN(l_partkey) % 3 = 0 THEN 'Tx' WHEN MIN(l_partkey) % 3 = 1 THEN 'Btn' END AS ft, MIN(l_suppkey) % 65536 * (CASE WHEN MIN(l_partkey) % 2 = 0 THEN 1 ELSE 4097 END) AS flags
FROM lineitem GROUP BY l_orderkey, l_linenumber""", ("lineitem",)),
        "calc_order": ("SELECT form_id, node * 5 % 7 AS pos, node FROM field_nodes WHERE ft IS NOT NULL OR node % 3 = 0", ("field_nodes",)),
        "kept_widgets": ("SELECT form_id, node FROM field_nodes WHERE node % 2 = 1", ("field_nodes",)),
        "arrivals": ("""
SELECT concat('/in/f', CAST(user_id AS STRING), CASE WHEN user_id % 10 = 0 THEN '.txt' WHEN user_id % 4 = 0 THEN '-filled.pdf' WHEN user_id % 3 = 0 THEN '.docx' ELSE '.pdf' END) AS path,
       CAST(floor(value * 100) AS BIGINT) AS size, CAST(ts AS TIMESTAMP) AS ts FROM events""", ("events",)),
        "edits": ("""
SELECT e.event_id % 1500 AS form_id, concat('b', CAST(1 + e.event_id % 7 AS STRING)) AS blank_id, CASE WHEN e.event_id % 3 = 0 OR f.slug IS NULL THEN concat('c', CAST(e.user_id AS STRING)) ELSE f.slug END AS slug,
       CASE e.event_type WHEN 'click' THEN 'set' WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'forget' WHEN 'purchase' THEN 'save' ELSE 'none' END AS action,
       concat('v', CAST(e.event_id AS STRING)) AS value, e.event_id AS seq FROM events e LEFT JOIN forms f ON f.form_id = e.event_id % 1500""", ("events", "forms")),
        "form_pages": (f"SELECT form_id, CAST(i + 1 AS BIGINT) AS page, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height, (form_id * 90 * (i + 1)) % 720 - 360 AS rotation FROM {d.each('(SELECT form_id, ' + d.seq('1', 'page_count') + ' AS seq_ FROM forms)', 'seq_', 'i', 'j')}", ("forms",)),
        "page_specs": ("SELECT form_id, concat(CASE WHEN form_id % 41 = 0 THEN '' ELSE concat('f', CAST(form_id AS STRING)) END, CASE form_id % 13 WHEN 0 THEN '#1-3@90' WHEN 1 THEN '#2-' WHEN 2 THEN '#1,1@180' WHEN 3 THEN '#x' WHEN 4 THEN '#2@45' WHEN 5 THEN '#1-99' WHEN 6 THEN '#2-1' WHEN 7 THEN '#@-90' WHEN 8 THEN '#1,, 2 ' WHEN 9 THEN '#0' WHEN 10 THEN '#,' WHEN 11 THEN '#1@half' ELSE '' END) AS spec FROM forms", ("forms",)),
        "regions": ("SELECT form_id, blank_no AS region_no, page, CASE WHEN blank_no % 2 = 0 THEN width_pt ELSE width_pt + 90 END AS x0, height_pt AS y0, width_pt + 40 AS x1, height_pt * 2 AS y1 FROM blanks0 WHERE label_id % 9 = 0", ("blanks0",)),
        # what was put on a page by hand, how far blanks were dragged, and results of requests that overtook each other
        "annotations": ("SELECT form_id, region_no, page, CASE region_no % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'text' WHEN 2 THEN 'tick' ELSE 'signature' END AS kind, x0, y0 FROM regions", ("regions",)),
        "offsets": ("SELECT form_id, blank_id, CASE WHEN blank_no % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(blank_no AS DOUBLE) END AS dx, CASE WHEN blank_no % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(-2 AS DOUBLE) END AS dy FROM blanks0 WHERE kind = 'signature' OR blank_no % 4 = 1", ("blanks0",)),
        "results": ("SELECT form_id, seq % 5 AS generation, seq, value FROM edits", ("edits",)),
        "ocr_tsv": ("SELECT form_id, page, concat_ws('\t', '5', '1', CAST(line_no AS STRING), '0', '0', CAST(word_no AS STRING), CAST(CAST(x0 * 2 AS BIGINT) AS STRING), CAST(CAST(y0 * 2 AS BIGINT) AS STRING), CASE WHEN word_no % 17 = 3 THEN '' ELSE CAST(length(text) * 10 AS STRING) END, '20', CASE WHEN word_no % 19 = 4 THEN 'n/a' ELSE CAST(length(text) * 17 % 100 AS STRING) END, CASE WHEN word_no % 23 = 5 THEN ' ' ELSE text END) AS row_ FROM words", ("words",)),
        # Spark splits a line into its characters at once; to look each up by its place would walk the line once a character
        "chars": (f"SELECT form_id, CAST(1 + seq // 60 AS BIGINT) AS page, CAST(seq % 60 * 100000 + i AS BIGINT) AS i, {"substr(text, CAST(i + 1 AS INT), 1)" if d.name == "duck" else "j"} AS ch, CAST(5 * i AS DOUBLE) AS x0, CAST(12 * (seq % 60) AS DOUBLE) AS y0, CAST(5 * i + 5 AS DOUBLE) AS x1, CAST(12 * (seq % 60) + 10 AS DOUBLE) AS y1 FROM {d.each(f"(SELECT form_id, seq, line_ AS text, {d.seq('1', 'length(line_)') if d.name == 'duck' else d.split('line_', '')} AS seq_ FROM (SELECT form_id, seq, concat(text, chr(9)) AS line_ FROM paragraphs) l0)", 'seq_', 'i', 'j')} c0".replace("//", "//" if d.name == "duck" else "DIV"), ("paragraphs",)),
        "widget_pages": ("SELECT form_id, node, 1 + node % 3 AS page FROM field_nodes", ("field_nodes",)),
        "gap_lines": (f"SELECT form_id, seq, {d.rx(d.rx('text', ' (the|la|de|und|of) ', ' _____ '), '^([A-Za-z]+) ', chr(92) + '1: ')} AS text FROM paragraphs", ("paragraphs",)),
        # every fourteenth word of a paragraph begins a field, with another one inside on forms of even number
        "runs": ("""
SELECT form_id, seq, run_no, fld_char, CASE WHEN fld_char = '' AND at_ = 1 THEN CASE (form_id + seq + run_no) % 4 WHEN 0 THEN ' FORMTEXT ' WHEN 1 THEN ' FORMCHECKBOX ' WHEN 2 THEN ' FORM' ELSE 'PAGE' END WHEN fld_char = '' AND at_ = 2 THEN CASE WHEN (form_id + seq + run_no - 1) % 4 = 2 THEN 'TEXT' ELSE '' END WHEN at_ = 5 AND nested THEN 'formtext' END AS instr,
       CASE WHEN fld_char = 'begin' THEN CASE WHEN at_ = 4 THEN 'Dropdown3' ELSE CASE (form_id + seq + run_no) % 5 WHEN 0 THEN 'Text1' WHEN 1 THEN 'Check2' WHEN 2 THEN 'city' WHEN 3 THEN 'Agree' END END END AS name,
       fld_char = 'begin' AND seq % 2 = 0 AS checked, CASE WHEN fld_char = '' AND at_ <> 1 AND at_ <> 2 AND NOT (at_ = 5 AND nested) THEN concat(word, CASE WHEN at_ = 13 THEN ': ' ELSE ' ' END) ELSE '' END AS text
FROM (SELECT form_id, seq, k AS run_no, word, at_, nested, CASE WHEN at_ = 0 OR at_ = 4 AND nested THEN 'begin' WHEN at_ = 3 OR at_ = 6 AND nested THEN 'separate' WHEN at_ = 10 OR at_ = 8 AND nested THEN 'end' ELSE '' END AS fld_char
      FROM (SELECT form_id, seq, k, word, k % 14 AS at_, form_id % 2 = 0 AS nested FROM words0) w) r""", ("words0",)),
        # the longest word of a paragraph's second, third or fourth is a control's content
        "controls": (f"""
SELECT form_id, seq, CAST(k AS BIGINT) AS control_no, CASE WHEN (form_id + seq) % 3 = 0 THEN word WHEN (form_id + seq) % 3 = 1 THEN 'City' END AS alias, CASE WHEN seq % 4 = 0 THEN concat('tag', CAST(k AS STRING)) ELSE '' END AS tag,
       CASE (form_id + k) % 5 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'date' WHEN 2 THEN 'picture' WHEN 3 THEN 'text' END AS type_, seq % 6 = 5 AS placeholder, CASE WHEN (form_id + k) % 5 = 0 AND seq % 2 = 0 THEN '☒' ELSE word END AS own,
       CASE WHEN (form_id + k) % 5 = 0 AND seq % 2 = 0 THEN concat('☒ ', text) ELSE text END AS para
FROM (SELECT w.form_id, w.seq, w.k, w.word, p.text FROM words0 w JOIN paragraphs p ON p.form_id = w.form_id AND p.seq = w.seq WHERE w.k BETWEEN 1 AND 3) c""", ("words0", "paragraphs")),
        # a model's reply for every third form, with chatter around the JSON; some are cut off
        "replies": ("""
SELECT form_id, CASE WHEN form_id % 33 = 0 THEN 'I cannot answer.' WHEN form_id % 39 = 0 THEN '{"blanks": [' ELSE concat('Sure. {"blanks":[{"id":"q1","key":', CASE WHEN form_id % 2 = 0 THEN 'null' ELSE '"full_name"' END, ',"why":"call 555-010-0100 {now}"},{"id":"q2","key":"', CASE WHEN form_id % 5 = 0 THEN 'no_such_key' ELSE 'zip' END,
       '"},{"id":"q3","key":"', CASE form_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'ssn' WHEN 2 THEN 'signature' ELSE 'city' END, '","why":"says so"},{"id":"q99","key":"city"},{"id":"q4","key":"state"},{"id":"q4","key":"', CASE WHEN form_id % 7 < 3 THEN 'null' ELSE 'country' END, '"}],"questions":["Are you married?","Born on 01/02/1990?"]} Done.') END AS text
FROM forms WHERE form_id % 3 = 0""", ("forms",)),
        "cells": (f"SELECT form_id, CAST(0 AS BIGINT) AS tbl, CAST(seq AS BIGINT) AS row_, CAST(k AS BIGINT) AS col, CASE WHEN (length(word) + k) % 4 = 0 THEN '' ELSE word END AS text FROM words0 WHERE word <> ''", ("words0",)),
    }
    return out
