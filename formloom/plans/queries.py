"""All relational operators by name, their queries and their SQL."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import functions as F

from formloom.operators import geometry, identity, labels, matching, overlay, pages, planning, privacy, rules, stream_text
from formloom.operators import text_udfs
from formloom.plans.registry import Folder, Operator, oracle, query
from formloom.plans.store import dealt, shared_dir
from formloom.sources import files
from formloom.streaming import arrivals

MODULES = (matching, identity, planning, overlay, privacy, stream_text, geometry, labels, rules, pages)
OPERATORS: dict[str, Operator] = {o.name: o for m in MODULES for o in m.OPERATORS}
QUERIES = {n: query(o, OPERATORS) for n, o in OPERATORS.items()}


def _tables(spark, sf_dir: str):
    """What gives derived tables and operators' results over a folder by name, each made once."""
    return Folder(spark, sf_dir, OPERATORS).get


def sensitive_store(spark, sf_dir: str):
    """Secrets set, set again and emptied: lengths of the sealed values, and the values opened again; the ciphertext differs with every run."""
    key = secrets.token_hex(8)
    store = text_udfs.sensitive_store(_tables(spark, sf_dir)("sensitive_changes"), key)
    return text_udfs.opened(store, key).selectExpr("slug", "key", "CAST(length(ciphertext) AS BIGINT) AS n", "value AS opened")


def lazy_unlock(spark, sf_dir: str):
    get = _tables(spark, sf_dir)
    values = get("identity_values").where("tier = 'vault'").selectExpr("slug", "key", "value", "1 AS seq")
    ruled_out, key = get("either_or").select("form_id", "key"), secrets.token_hex(8)
    return text_udfs.lazy_unlock(get("wanted_keys"), ruled_out, text_udfs.sensitive_store(values, key), key).select("form_id", "slug", "key", "value")


def prompt_batch(spark, sf_dir: str):
    """What a model is asked about every form; values at hand serve to take them out of labels only."""
    folder = Folder(spark, sf_dir, OPERATORS)
    get = folder.get
    forms = get("forms").select("form_id", "slug", "fmt").join(get("identities").selectExpr("slug", "kind AS identity_kind"), "slug", "left")
    forms = forms.join(get("values_in_hand").withColumnRenamed("in_hand", "known"), "slug", "left").withColumns({"known": F.coalesce("known", F.array().cast("array<string>")), "identity_kind": F.coalesce("identity_kind", F.lit("person"))})
    forms = dealt(forms, "askers", folder.form_buckets(), "form_id")  # so that values at hand are dealt once a form, not once a label
    put = get("plan_entries").where("value IS NOT NULL AND key IS NOT NULL").selectExpr("form_id", "blank_id", "key AS put")
    return text_udfs.prompts(get("blanks").join(get("question_ids"), ["form_id", "blank_id"]).join(forms, "form_id").join(put, ["form_id", "blank_id"], "left"))


def scrub_known(spark, sf_dir: str):
    """Street lines with their identity's values scrubbed."""
    get = _tables(spark, sf_dir)
    lines, known = get("street_line"), get("values_in_hand")
    return text_udfs.scrub_known(lines.join(known, "slug").selectExpr("slug", "street_line AS text", "in_hand AS known")).select("slug", "text")


def memory_tables(spark, sf_dir: str):
    """Memory files of forms, written as JSON from what was remembered, read as the rows of their five tables."""
    folder = Folder(spark, sf_dir, OPERATORS).of_saves()
    return files.memory_json(files.memory_files(folder.get("remember_form")))


def filled_values_sink(spark, sf_dir: str):
    """Decisions written by format to a new folder, read back and counted."""
    get = _tables(spark, sf_dir)
    out = f"{shared_dir(spark)}/formloom/filled-{uuid.uuid4().hex}"
    entries = get("plan_values").join(get("forms").select("form_id", "fmt"), "form_id")
    files.write_filled(entries, sf_dir, out)
    return spark.read.parquet(out).groupBy("fmt").agg(F.count("*").alias("n"), F.countDistinct("form_id").alias("forms"))


def memory_upsert_stream(spark, sf_dir: str):
    """Saves applied in batches, some of them twice; what is remembered are each form's last save's keys."""
    get = _tables(spark, sf_dir)
    saves = get("edits").where("action = 'save'").selectExpr("CAST(form_id AS STRING) AS fingerprint", "blank_id", "slug AS key", "seq")
    path = f"{shared_dir(spark)}/formloom/memory-{uuid.uuid4().hex}"
    put = arrivals.memory_upsert(path, width=3)
    for number in (0, 1, 1, 2, 3, 1, 4, 4):
        put(saves.where(f"seq % 5 = {number}"), number)
    return arrivals.memory_now(spark, path).select("fingerprint", "blank_id", "key", "seq")


QUERIES |= {f.__name__: f for f in (filled_values_sink, memory_upsert_stream, sensitive_store, lazy_unlock, prompt_batch, scrub_known, memory_tables)}
LAZY_UNLOCK = Operator("lazy_unlock", ("lazy_unlock_keys", "identity_values"), lambda d: "SELECT k.form_id, k.slug, k.key, v.value FROM lazy_unlock_keys k JOIN identity_values v ON v.slug = k.slug AND v.key = k.key AND v.tier = 'vault'")
SINK = Operator("filled_values_sink", ("plan_values", "forms"), lambda d: "SELECT f.fmt, COUNT(*) AS n, COUNT(DISTINCT f.form_id) AS forms FROM plan_values p JOIN forms f ON f.form_id = p.form_id GROUP BY f.fmt")
UPSERT = Operator("memory_upsert_stream", ("edits",), lambda d: "SELECT CAST(form_id AS VARCHAR) AS fingerprint, max_by(blank_id, seq) AS blank_id, max_by(slug, seq) AS key, MAX(seq) AS seq FROM edits WHERE action = 'save' GROUP BY form_id")
TABLES = Operator("memory_tables", ("remember_form",), lambda d: "SELECT fingerprint, part, CASE WHEN part IN ('checked', 'cleared') THEN slug ELSE '' END AS slug, CASE WHEN part <> 'placed' THEN blank_id END AS blank_id, key, page, kind, x, y FROM remember_form")
STORE = Operator("sensitive_store", ("sensitive_changes",), lambda d: "SELECT slug, key, length(value) + 28 AS n, value AS opened FROM sensitive_changes c WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM sensitive_changes l WHERE l.slug = c.slug AND l.key = c.key AND l.seq > c.seq)")


def oracles() -> dict[str, str]:
    return {n: oracle(o, OPERATORS) for n, o in OPERATORS.items()} | {o.name: oracle(o, OPERATORS) for o in (LAZY_UNLOCK, STORE, SINK, UPSERT, TABLES)}
