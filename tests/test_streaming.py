"""Streams against their batch twins, sources and the operators with Python or encryption."""

import json

import pytest
from pyspark.sql import functions as F

from formloom.operators import text_udfs
from formloom.sources import files
from formloom.streaming import arrivals
from formloom.streaming.ledger import Ledger

SF = "/root/testdata/sf0.001"


def events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    path = F.concat(F.lit("/in/f"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 10 == 0, ".txt").otherwise(".pdf"))
    return e.select(path.alias("path"), F.floor(F.col("value") * 100).cast("long").alias("size"), F.col("ts").cast("timestamp").alias("ts"))


def test_settled_once(spark, tmp_path):
    batch = events(spark)
    flush = spark.createDataFrame([("/in/flush.pdf", 1)], "path string, size long").withColumn("ts", F.lit("2999-01-01").cast("timestamp"))
    for k, part in enumerate([batch, flush, flush]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    settled = arrivals.settled_files(arrivals.arrivals_source(stream))
    for _ in range(2):  # the second run adds nothing
        q = settled.writeStream.foreachBatch(arrivals.one_notice(f"{tmp_path}/notices")).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/notices/batch=*").collect()
    paths = [r.path for r in got if "flush" not in r.path]
    assert len(paths) == len(set(paths))
    twin = arrivals.settled_files(batch.where("path LIKE '%.pdf'"))
    assert set(paths) == {r.path for r in twin.select("path").distinct().collect()}
    counts = spark.createDataFrame([(paths[0], 5), (paths[1], 2)], "path string, blanks int")
    forms = {r.path: r.is_form for r in arrivals.is_form(spark.read.parquet(f"{tmp_path}/notices/batch=*"), counts).collect()}
    assert forms[paths[0]] and not forms[paths[1]] and not forms[paths[2]]


def test_memory_upsert(spark, tmp_path):
    put = arrivals.memory_upsert(str(tmp_path / "m"))
    put(spark.createDataFrame([("f", "b1", "zip", 1), ("g", "b1", "city", 1)], "fingerprint string, blank_id string, key string, seq long"), 0)
    late = spark.createDataFrame([("f", "b2", "state", 2)], "fingerprint string, blank_id string, key string, seq long")
    put(late, 1)
    put(late, 1)
    assert {(r.fingerprint, r.blank_id, r.key) for r in arrivals.memory_now(spark, str(tmp_path / "m")).collect()} == {("f", "b2", "state"), ("g", "b1", "city")}


def test_a_ledger_merges_and_knows_its_batches(spark, tmp_path):
    schema = "fingerprint string, blank_id string, key string, seq long"
    put, path = arrivals.memory_upsert(str(tmp_path / "l"), width=3), str(tmp_path / "l")
    ledger = Ledger(spark, path, ("fingerprint",), "seq", width=3)
    want = {}
    for number in range(14):
        rows = [(f"f{k}", f"b{number}", "zip", number) for k in range(number % 4, 5)]
        want |= {r[0]: r for r in rows}
        for _ in range(1 + number % 2):  # some batches come twice
            put(spark.createDataFrame(rows, schema), number)
        assert len(ledger.runs()) <= 6 and sum(hi - lo + 1 for lo, hi in ledger.runs()) == number + 1
    put(spark.createDataFrame([("f0", "again", "x", 99)], schema), 3)  # within a merged run: known
    assert ledger.runs() == [(0, 8), (9, 11), (12, 12), (13, 13)]
    assert {r.fingerprint: tuple(r) for r in arrivals.memory_now(spark, path).collect()} == want
    near = ledger.near(spark.createDataFrame([("f3",)], "fingerprint string"), spark.createDataFrame([], schema).schema)
    assert ("f3", "b13", "zip", 13) in [tuple(r) for r in near.collect()]
    (tmp_path / "l" / "batch=0000000000-0000000001").mkdir()  # what a lost merge leaves is passed over
    assert ledger.runs()[0] == (0, 8)


def test_all_of_a_save_is_kept(spark, tmp_path):
    put, path = arrivals.memory_tables_upsert(str(tmp_path / "t")), str(tmp_path / "t")
    schema = "fingerprint string, part string, slug string, blank_id string, key string, page long, kind string, x double, y double, seq long"
    row = lambda part, seq, blank, slug=None, key=None, **at: ("f", part, slug, blank, key, at.get("page"), at.get("kind"), at.get("x"), at.get("y"), seq)
    put(spark.createDataFrame([row("keys", 1, "b1", key="zip"), row("keys", 1, "b2", key="city"), row("checked", 1, "b3", "ann"), row("cleared", 1, "b4", "bob"), row("placed", 1, "~1", page=2, kind="date", x=1.5, y=2.0), row("moved", 1, "b5", x=3.0, y=0.0)], schema), 0)
    put(spark.createDataFrame([row("keys", 2, "b1", key="state"), row("checked", 2, "b9", "bob"), row("cleared", 2, None, "bob"), row("placed", 2, None)], schema), 1)
    got = {(r.part, r.slug, r.blank_id, r.key) for r in arrivals.memory_tables_now(spark, path).collect()}
    assert got == {("keys", "", "b1", "state"), ("checked", "ann", "b3", None), ("checked", "bob", "b9", None), ("moved", "", "b5", None)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert {r.fmt for r in files.form_manifest(spark, str(tmp_path)).collect()} == {"pdf", None}
    rows = ["5\t1\t1\t1\t1\t1\t150\t300\t75\t15\t91\tName", "5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t12\tdim", "short\trow", "5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t95\t "]
    (tmp_path / "o.tsv").write_text("\n".join(rows))
    assert [tuple(r) for r in files.ocr_words(spark, str(tmp_path / "o.tsv")).collect()] == [("Name", 72.0, 144.0, 108.0, 151.2)]
    js = [("a", '{"kind":"business","values":{"ein":"1","city":" "}}'), ("b", '{"city":"Rome"}')]
    got = {tuple(r) for r in files.identity_json(spark.createDataFrame(js, "slug string, json string")).collect()}
    assert got == {("a", "business", "ein", "1"), ("b", "person", "city", "Rome")}
    entries = spark.createDataFrame([(1, "pdf")], "form_id long, fmt string")
    with pytest.raises(ValueError):
        files.write_filled(entries, str(tmp_path), f"{tmp_path}/")
    files.write_filled(entries, str(tmp_path), str(tmp_path / "out"))
    with pytest.raises(Exception):
        files.write_filled(entries, str(tmp_path), str(tmp_path / "out"))


def test_fuzzy(spark):
    texts = spark.createDataFrame([("Social securty number", ["social", "securty", "number"]), ("nothing", ["nothing"])], "text string, tokens array<string>")
    exact = spark.createDataFrame([], "text string, alias string")
    got = {(r.key, r.alias): (r.ratio, r.pos) for r in text_udfs.alias_fuzzy(texts, exact).collect()}
    assert got["ssn", "social security number"] == (0.976744, 0)


def test_secrets(spark):
    values = spark.createDataFrame([("a", "ssn", "123456789", 1), ("a", "ssn", "987654321", 2), ("a", "ein", "1", 1), ("a", "ein", "", 2), ("b", "ssn", "5", 1)], "slug string, key string, value string, seq long")
    store = text_udfs.sensitive_store(values, "0123456789abcdef")
    assert store.count() == 2 and b"987654321" not in bytes(store.where("slug = 'a'").first().ciphertext)
    wanted = spark.createDataFrame([(1, "a", "ssn"), (2, "b", "ssn")], "form_id long, slug string, key string")
    out = text_udfs.lazy_unlock(wanted, wanted.where("form_id = 2").select("form_id", "key"), store, "0123456789abcdef").collect()
    assert [(r.form_id, r.value) for r in out] == [(1, "987654321")]


def test_scrubbing(spark):
    rows = spark.createDataFrame([("Ann Lee at 5 Main St, ann", ["Ann", "Ann Lee", "5 Main St", "x"])], "text string, known array<string>")
    assert text_udfs.scrub_known(rows).first().text == "[answer] at [answer], [answer]"
    assert spark.createDataFrame([("Name: Ann",)], "t string").select(text_udfs.scrub_stream(F.col("t"))).first()[0] == "Name:"
    blanks = spark.createDataFrame([(1, 2, "q2", "call 5551234", "text"), (1, 1, "q1", "Name", "text")], "form_id long, blank_no long, qid string, label string, kind string")
    assert text_udfs.prompt_batch(blanks).first().prompt == '[{"id":"q1","label":"Name","kind":"text"},{"id":"q2","label":"call [answer]","kind":"text"}]'


def test_known_values_of_one_character_and_form(spark):
    rows = [("Middle initial: Q and Q", ["Q"]), ("Initial: Quest", ["Q"]), ("Jose\u0301 at RUE É", ["Jos\u00e9", "rue \u00e9", " ", ""]), ("a.c abc", ["a.c"]), ("x", []), (None, ["Ann"])]
    df = spark.createDataFrame(rows, "text string, known array<string>")
    assert [r.text for r in text_udfs.scrub_known(df).collect()] == ["Middle initial: [answer] and Q", "Initial: Quest", "[answer] at [answer]", "[answer] abc", "x", None]


def test_a_prompt_names_keys_and_holds_no_value(spark):
    cols = "form_id long, blank_no long, qid string, kind string, page long, width_pt double, right_ string, left_ string, above string, section string, native_name string, fmt string, identity_kind string, put string, known array<string>"
    known = ["Alex Rivera", "97403", "Q"]
    rows = [
        (1, 2, "q2", "text", 1, 150.5, "", "Name: ALEX RIVERA", "Zip 97403 of Oak", "", "", "docx", "person", "full_name", known),
        (1, 1, "q1", "checkbox", 2, 9.0, "Single", "left", "", "Part II", "f1", "docx", "person", None, known),
        (2, 1, "q1", "text", 1, 10.0, "", "Born: 01/02/1990 " + "x" * 300, "", "", "", "pdf", "business", None, []),
    ]
    got = {r.form_id: r.prompt for r in text_udfs.prompts(spark.createDataFrame(rows, cols)).collect()}
    assert not any(v.lower() in p.lower() for p in got.values() for v in known if len(v) > 1) and "1990" not in got[2]
    asked = json.loads(got[1].partition("Blanks: ")[2])
    assert asked == [
        {"id": "q1", "kind": "checkbox", "page": 2, "width_pt": 9, "beside": "Single", "section": "Part II", "field_name": "f1"},
        {"id": "q2", "kind": "text", "page": 1, "width_pt": 150, "beside": "Name: [answer]", "above": "Zip [answer] of Oak", "matcher_put": "full_name"},
    ]
    (other,) = json.loads(got[2].partition("Blanks: ")[2])
    assert other["beside"].startswith("Born: [answer] xxx") and len(other["beside"]) == 220 and "for the business" in got[2]
    keys = {x["key"] for x in json.loads(got[1].partition("Keys: ")[2].partition(" Blanks: ")[0])}
    assert "ssn" in keys and "date_today" not in keys


def test_memory_files(spark):
    js = [
        ("f", '{"keys": {"b1": "zip"}, "checked": {"ann": ["b2", "b3"]}, "cleared": {"bob": ["b4"]}, "placed": [{"page": 1, "kind": "date", "x": 1.5, "y": 2}, 7], "moved": {"b5": [1, -2.5], "b6": [1], "b7": "no"}}'),
        ("g", '{"checked": ["b1"], "saved_by": "cy"}'), ("h", "not json"), ("i", "{}"),
    ]
    got = {(r.fingerprint, r.part, r.slug, r.blank_id, r.key, r.page, r.kind, r.x, r.y) for r in files.memory_json(spark.createDataFrame(js, "fingerprint string, json string")).collect()}
    assert got == {
        ("f", "keys", "", "b1", "zip", None, None, None, None), ("f", "checked", "ann", "b2", None, None, None, None, None), ("f", "checked", "ann", "b3", None, None, None, None, None), ("f", "cleared", "bob", "b4", None, None, None, None, None),
        ("f", "placed", "", None, None, 1, "date", 1.5, 2.0), ("f", "moved", "", "b5", None, None, None, 1.0, -2.5), ("g", "checked", "cy", "b1", None, None, None, None, None),
    }
