"""Identities: resolving values over tiers, derived and composite values, and changes to what is stored."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions import text as T
from formloom.functions.dialect import SPARK, Spark
from formloom.functions.dictionary import ALTERNATIVES
from formloom.plans.checks import CHECKS
from formloom.plans.registry import Operator
from formloom.sources import files

_RANK = "CASE tier WHEN 'once' THEN 0 WHEN 'values' THEN 1 WHEN 'vault' THEN 2 ELSE 3 END"


def stored_value(d: Spark) -> str:
    return f"SELECT slug, key, min_by(value, {_RANK}) AS value FROM identity_values WHERE value <> '' GROUP BY slug, key"


def _parts(d: Spark) -> str:
    keys = ("first_name", "middle_initial", "city", "state", "zip", "address1", "address2")
    return ", ".join(f"MAX(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in keys)


def composite_value(d: Spark) -> str:
    first = "CASE WHEN first_name IS NOT NULL AND middle_initial IS NOT NULL THEN concat(first_name, ' ', middle_initial) ELSE coalesce(first_name, middle_initial) END"
    rest = "nullif(concat_ws(' ', city, state, zip), '')"
    full = f"CASE WHEN city IS NOT NULL AND state IS NOT NULL AND zip IS NOT NULL THEN concat(city, ', ', state, ' ', zip) ELSE {rest} END"
    return f"""
SELECT * FROM (
  SELECT slug, 'first_middle' AS key, {first} AS value FROM (SELECT slug, {_parts(d)} FROM stored_value GROUP BY slug) p
  UNION ALL SELECT slug, 'city_state_zip', {full} FROM (SELECT slug, {_parts(d)} FROM stored_value GROUP BY slug) p) c WHERE value IS NOT NULL"""


def resolve_value(d: Spark) -> str:
    """One value for each key of an identity: what is stored goes before what is derived, and that before what is put together."""
    return """
SELECT slug, key, min_by(value, ord) AS value FROM (
  SELECT slug, key, value, 0 AS ord FROM stored_value UNION ALL SELECT slug, key, value, 1 FROM derived_values UNION ALL SELECT slug, key, value, 2 FROM composite_value) r
WHERE value <> '' GROUP BY slug, key"""


def street_line(d: Spark) -> str:
    named = d.like("lower(address2)", r"(\b(apt|suite|ste|unit|floor)\b|#|\bfl )")
    return f"""
SELECT slug, CASE WHEN address2 IS NULL THEN address1 WHEN {named} THEN concat(address1, ', ', address2) ELSE concat(address1, ', Apt ', address2) END AS street_line
FROM (SELECT slug, {_parts(d)} FROM stored_value GROUP BY slug) p WHERE address1 IS NOT NULL"""


#: The day that stands for today where no other is given, so that runs can be compared.
AS_OF = "2024-03-09"


def derived_values(d: Spark, as_of: str = AS_OF) -> str:
    """Today's date, as a form writes it, and the letter of an LLC's tax classification."""
    month, day, year = as_of[5:7], as_of[8:10], as_of[:4]
    return f"""
SELECT slug, 'date_today' AS key, '{month}/{day}/{year}' AS value FROM identities
UNION ALL SELECT v.slug, 'llc_tax_code', c.code FROM stored_value v JOIN (SELECT DISTINCT answer, code FROM choices WHERE choice = 'tax_classification' AND code <> '') c
  ON v.value = c.answer WHERE v.key = 'tax_classification'"""


def has_key(d: Spark) -> str:
    return "SELECT DISTINCT slug, key FROM (SELECT slug, key FROM resolve_value UNION ALL SELECT slug, key FROM identity_values WHERE tier = 'vault') h"


def peek_value(d: Spark) -> str:
    return f"SELECT slug, key, min_by(value, {_RANK}) AS value FROM identity_values WHERE tier <> 'vault' AND value <> '' GROUP BY slug, key"


def values_in_hand(d: Spark) -> str:
    """Every value that can be read without unlocking, of whatever tier; pictures are none."""
    return f"SELECT v.slug, {d.collect('v.value')} AS in_hand FROM identity_values v LEFT JOIN fields f ON f.key = v.key WHERE v.tier <> 'vault' AND v.value <> '' AND NOT coalesce(f.image, false) GROUP BY v.slug"


# The tax number that a kind of identity goes by.
KIND_PREFERS = (("person", "ssn"), ("business", "ein"))


def identity_preference(d: Spark) -> str:
    """The keys that an identity prefers: those it says, else its kind's; other kinds prefer none."""
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_PREFERS)
    return f"SELECT slug, prefer FROM (SELECT slug, CASE WHEN prefers <> '' THEN prefers ELSE CASE kind {kinds} END END AS prefer FROM identities) p WHERE prefer IS NOT NULL"


def preference_union(d: Spark) -> str:
    """What an identity prefers, and what a run does."""
    return f"SELECT slug, {d.collect('k')} AS prefers FROM (SELECT slug, prefer AS k FROM identity_preference UNION ALL SELECT slug, key FROM run_prefers) u GROUP BY slug"


def identity_summary(d: Spark) -> str:
    pick = ", ".join(f"MAX(CASE WHEN key = '{k}' AND value <> label THEN value END)" for k in ("business_name", "full_name", "email", "city"))
    return f"SELECT i.slug, coalesce({pick}) AS summary FROM identities i LEFT JOIN stored_value v ON v.slug = i.slug GROUP BY i.slug"



# The slug of a label without letters and digits, and a slug's number, which begins with 2.
NAMELESS, NUMBER = "identity", "-([2-9]|[1-9][0-9]+)$"


def slug_base(d: Spark, label: str) -> str:
    return f"coalesce(nullif({d.rx(d.rx(f'lower({label})', '[^a-z0-9]+', '-'), '^-+|-+$', '')}, ''), '{NAMELESS}')"


class _Slugs:
    """The slugs of one family that are taken: for each slug before a number, the least free number and those taken above it.

    So a name that comes again and again takes no more memory than once.
    """

    def __init__(self) -> None:
        self.plain: set[str] = set()
        self.free: dict[str, int] = {}
        self.above: dict[str, set[int]] = {}

    def taken(self, slug: str) -> bool:
        if slug in self.plain:
            return True
        base, _, n = slug.rpartition("-")
        return base in self.free and n.isdecimal() and str(int(n)) == n and int(n) >= 2 and (int(n) < self.free[base] or int(n) in self.above[base])

    def _number(self, base: str, n: int) -> None:
        above = self.above.setdefault(base, set())
        above.add(n)
        at = self.free.setdefault(base, 2)
        while at in above:
            above.remove(at)
            at += 1
        self.free[base] = at

    def take(self, base: str) -> str:
        """The slug itself if it is free, else with the least number that is."""
        slug = base
        if self.taken(slug):
            n = self.free.get(base, 2)
            slug = f"{base}-{n}"  # plain slugs with a number are kept by it, so this one is free
        m = re.search(NUMBER, slug)
        if m:
            self._number(slug[: m.start()], int(m[1]))
        else:
            self.plain.add(slug)
        return slug


def slugify(spark: SparkSession, slug_labels: DataFrame) -> DataFrame:
    """Slugs of labels in order of their creation; a taken slug gets the next free number.

    A label that ends in a number may hold a slug that another label would get, so labels whose slugs differ in such
    numbers only are one family. A family is a stream in order through one task, which keeps what is taken by ranges.
    """
    base = F.expr(slug_base(SPARK, "label"))
    family = F.regexp_replace(base, "(-([2-9]|[1-9][0-9]+))+$", "")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slugs = None, _Slugs()
        for b in batches:
            out = []
            for f, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if f != now:
                    now, slugs = f, _Slugs()
                out.append(slugs.take(x))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(out, pa.string())], ["label", "ord", "slug"])

    dealt = slug_labels.select(family.alias("family"), F.col("ord").cast("long"), "label", base.alias("base")).where("label is not null")
    return dealt.repartition("family").sortWithinPartitions("family", "ord", "label").mapInArrow(named, "label string, ord long, slug string")


def identity_lookup(d: Spark) -> str:
    """Names to identities: by slug, else by label in any case, else the default."""
    return """
SELECT n.form_id, n.name, coalesce(a.slug, b.slug, z.slug) AS slug
FROM asked_names n
LEFT JOIN identities a ON a.slug = n.name
LEFT JOIN (SELECT lower(label) AS low, min_by(slug, ord) AS slug FROM identities GROUP BY lower(label)) b ON b.low = lower(n.name)
CROSS JOIN (SELECT MIN(slug) AS slug FROM default_slug) z"""


#: Kinds of identities, and what a person is taxed as unless they say otherwise.
KINDS, PERSON_TAX = ("person", "business"), "individual"


def lives(d: Spark) -> str:
    """Births and deaths of identities: a creation, or a set value, of one that is not there; a deletion of one that is.

    Sets that are refused (an unknown or sensitive key, a choice without that answer) change nothing.
    """
    return """
SELECT library, slug, seq, op, value, label FROM (
  SELECT *, lag(op) OVER (PARTITION BY library, slug ORDER BY seq) AS before_ FROM (
    SELECT c.* FROM changes c LEFT JOIN fields f ON f.key = c.key LEFT JOIN (SELECT DISTINCT choice FROM choices) h ON h.choice = c.key LEFT JOIN (SELECT DISTINCT choice, answer FROM choices) o ON o.choice = c.key AND o.answer = c.value
    WHERE c.op IN ('create', 'delete') OR c.op = 'set' AND f.key IS NOT NULL AND NOT f.sensitive AND (h.choice IS NULL OR c.value = '' OR o.answer IS NOT NULL)) e) l
WHERE CASE WHEN op = 'delete' THEN before_ IS NOT NULL AND before_ <> 'delete' ELSE before_ IS NULL OR before_ = 'delete' END"""


def default_identity(spark: SparkSession, lives: DataFrame) -> DataFrame:
    """The default of each library: the one born alone; when it dies, the first by slug of those left, if there is one.

    A library's births and deaths are a stream in order through one task.
    """

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, default, alive, heap, out = None, "", set(), [], []
        for b in batches:
            for library, slug, op in zip(*[b.column(k).to_pylist() for k in range(3)]):
                if library != now:
                    if now is not None:
                        out.append((now, default))
                    now, default, alive, heap = library, "", set(), []
                if op != "delete":
                    alive.add(slug)
                    heapq.heappush(heap, slug)
                    if len(alive) == 1:
                        default = slug
                else:
                    alive.discard(slug)
                    while heap and heap[0] not in alive:
                        heapq.heappop(heap)
                    if slug == default:
                        default = heap[0] if heap else ""
        if now is not None:
            out.append((now, default))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["library", "slug"])

    dealt = lives.select(F.col("library").cast("long"), "slug", "op", "seq").repartition("library").sortWithinPartitions("library", "seq")
    return dealt.select("library", "slug", "op").mapInArrow(followed, "library long, slug string").where("slug <> ''")


def identity_changelog(d: Spark) -> str:
    """What a log of changes leaves: items label, kind, prefers, default and value:key of every identity that is there.

    A deletion cuts off all that was before; what comes before the next birth finds no identity. A new kind clears the
    preferences, a preference replaces the one of its group, an empty value takes a value away, an empty name none.
    """
    alternatives = " ".join(f"WHEN '{k}' THEN '{'/'.join(g)}'" for g in ALTERNATIVES for k in g)
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
WITH births AS (
  SELECT library, slug, seq AS born, CASE WHEN op = 'create' AND value IN ({kinds}) THEN value ELSE 'person' END AS kind, CASE WHEN op = 'create' THEN coalesce(nullif(trim(label), ''), initcap_(slug)) ELSE initcap_(slug) END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY library, slug ORDER BY seq DESC) AS k FROM lives) l WHERE k = 1 AND op <> 'delete'),
since AS (
  SELECT c.library, c.slug, c.seq, c.op, c.key, c.value, f.key IS NOT NULL AND NOT f.sensitive AND (h.choice IS NULL OR c.value = '' OR o.answer IS NOT NULL) AS allowed
  FROM changes c JOIN births b ON b.library = c.library AND b.slug = c.slug AND c.seq >= b.born
  LEFT JOIN fields f ON f.key = c.key LEFT JOIN (SELECT DISTINCT choice FROM choices) h ON h.choice = c.key LEFT JOIN (SELECT DISTINCT choice, answer FROM choices) o ON o.choice = c.key AND o.answer = c.value),
kinds AS (SELECT library, slug, max_by(value, seq) AS kind, MAX(seq) AS seq FROM since WHERE op = 'set_kind' AND value IN ({kinds}) GROUP BY library, slug),
names AS (SELECT library, slug, max_by(trim(value), seq) AS label FROM since WHERE op = 'rename' AND trim(value) <> '' GROUP BY library, slug),
prefers AS (
  SELECT library, slug, {d.listagg('key', ',', 'seq')} AS prefers FROM (
    SELECT s.library, s.slug, max_by(s.key, s.seq) AS key, MAX(s.seq) AS seq FROM since s LEFT JOIN kinds k ON k.library = s.library AND k.slug = s.slug
    WHERE s.op = 'set_preference' AND s.seq > coalesce(k.seq, -1) GROUP BY s.library, s.slug, CASE s.key {alternatives} ELSE s.key END) g GROUP BY library, slug),
held AS (
  SELECT library, slug, key, max_by(value, seq) AS value FROM (
    SELECT library, slug, key, value, seq FROM since WHERE op = 'set' AND allowed
    UNION ALL SELECT library, slug, 'tax_classification', '{PERSON_TAX}', born - 0.5 FROM births WHERE kind = 'person') v GROUP BY library, slug, key)
SELECT b.library, b.slug, 'label' AS item, coalesce(n.label, b.label) AS value FROM births b LEFT JOIN names n ON n.library = b.library AND n.slug = b.slug
UNION ALL SELECT b.library, b.slug, 'kind', coalesce(k.kind, b.kind) FROM births b LEFT JOIN kinds k ON k.library = b.library AND k.slug = b.slug
UNION ALL SELECT library, slug, 'prefers', prefers FROM prefers
UNION ALL SELECT library, slug, 'default', 'yes' FROM default_identity
UNION ALL SELECT library, slug, concat('value:', key), value FROM held WHERE value <> ''""".replace("initcap_(slug)", "concat(upper(left(slug, 1)), lower(substr(slug, 2)))")


def route_sensitive(d: Spark) -> str:
    """Changes asked of the plain tier, with the reason for refusing them."""
    return """
SELECT c.slug, c.key, c.value, CASE WHEN f.key IS NULL THEN 'unknown key' WHEN f.sensitive THEN 'sensitive' WHEN h.choice IS NOT NULL AND o.answer IS NULL THEN 'not an answer' END AS reason
FROM asked_changes c
LEFT JOIN fields f ON f.key = c.key LEFT JOIN (SELECT DISTINCT choice FROM choices) h ON h.choice = c.key
LEFT JOIN (SELECT DISTINCT choice, answer FROM choices) o ON o.choice = c.key AND o.answer = c.value"""


def sensitive_manifest(d: Spark) -> str:
    return "SELECT DISTINCT CASE WHEN slug = '' THEN 'me' ELSE slug END AS slug, concat(slug, '/', key) AS name FROM identity_values WHERE tier = 'vault'"


def manifest_check(d: Spark) -> str:
    """Names that are stored and not listed, or listed and not stored; how often a side has a name does not count."""
    return """
SELECT coalesce(a.name, b.name) AS name, a.name IS NULL AS not_stored, b.name IS NULL AS not_listed
FROM (SELECT DISTINCT name FROM sensitive_manifest WHERE name IS NOT NULL) a FULL OUTER JOIN (SELECT DISTINCT name FROM manifest WHERE name IS NOT NULL) b ON a.name = b.name
WHERE a.name IS NULL OR b.name IS NULL"""


def identity_json(spark: SparkSession, stored_value: DataFrame) -> DataFrame:
    """All stored values of an identity written as one JSON object and read back; blank ones drop."""
    return files.through_json(stored_value, "slug", "key", "value")


OPERATORS = [
    Operator("stored_value", ("identity_values",), stored_value),
    Operator("composite_value", ("stored_value",), composite_value),
    Operator("derived_values", ("identities", "stored_value", "choices"), derived_values),
    Operator("resolve_value", ("stored_value", "derived_values", "composite_value"), resolve_value),
    Operator("street_line", ("stored_value",), street_line),
    Operator("has_key", ("resolve_value", "identity_values"), has_key),
    Operator("peek_value", ("identity_values",), peek_value),
    Operator("values_in_hand", ("identity_values", "fields"), values_in_hand),
    Operator("identity_preference", ("identities",), identity_preference),
    Operator("preference_union", ("identity_preference", "run_prefers"), preference_union),
    Operator("identity_summary", ("identities", "stored_value"), identity_summary),
    Operator("slugify", ("slug_labels",), lambda d: CHECKS["slugify"], slugify),
    Operator("identity_lookup", ("asked_names", "identities", "default_slug"), identity_lookup),
    Operator("lives", ("changes", "fields", "choices"), lives),
    Operator("default_identity", ("lives",), lambda d: CHECKS["default_identity"], default_identity),
    Operator("identity_changelog", ("changes", "lives", "default_identity", "fields", "choices"), identity_changelog),
    Operator("route_sensitive", ("asked_changes", "fields", "choices"), route_sensitive),
    Operator("sensitive_manifest", ("identity_values",), sensitive_manifest),
    Operator("manifest_check", ("sensitive_manifest", "manifest"), manifest_check),
    Operator("identity_json", ("stored_value",), lambda d: CHECKS["identity_json"], identity_json),
]
