"""Whole operators on small fixtures with nulls, empty and repeated rows, ties and clashing columns, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formloom.llm import chat, components, decontaminate, jaccard, lines, maxent, packing, quality, queries, revisits, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    random.seed(5)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(random.randrange(20, 200)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[2].replace(" ", "\n", 3), texts[3] + " tail end", "x " + texts[3]]
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(4)]
    texts += [None, "", "  \n", "one", "one two three", "aa " * 80, prose(5000), texts[4].upper()]
    texts += ["\n".join([prose(5), "same line one here", "same line two here", prose(6)]) for _ in range(3)]
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[6], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(packing.pieces(docs, path, capacity=512), capacity=512, group=16).collect()
    want = collections.Counter()
    for doc, text, *_ in corpus():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[doc, k // 512, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 512) + 2
    assert packing.pack(packing.pieces(empty, path)).count() == 0
    large = spark.createDataFrame([(9007199254740993, "a"), (None, "b"), (-1, None), (-1, None), (None, "")], "doc_id long, text string")
    assert collections.Counter(r.doc_id for r in packing.pack(packing.pieces(large, path)).collect()) == {9007199254740993: 1, None: 2, -1: 2}


def test_jaccard(spark, docs, empty):
    sets = {}
    for doc, text, *_ in corpus():
        w = WORD.findall((text or "").translate(LOW))
        sets[doc] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)]) if w else frozenset()
    ids = sorted(k for k in sets if k is not None)
    up = {k: k for k in ids}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    for _ in range(2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs, 4, 85).collect()}
        assert {k: got[k] for k in ids} == {k: (len(sets[k]), root(k)) for k in ids}
        jaccard_block, jaccard.BLOCK = jaccard.BLOCK, 2  # many small blocks: links must be found between them
    jaccard.BLOCK = jaccard_block if jaccard_block > 2 else 1024
    assert got[None][1] == root(6)
    assert jaccard.groups(empty, 4, 85).count() == 0
    twins = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (0, "a b c d e"), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.groups(twins, 4, 85).collect()) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 3)]
    kept = jaccard.one_of_each(docs.withColumn("comp", F.lit(1)), 4, 85)
    assert kept.columns == [*docs.columns, "comp"]
    assert {r.doc_id for r in kept.collect()} == {k for k in ids if root(k) == k} | {None}


def test_substrings(spark, docs, empty):
    rows = [(d, WORD.findall(t or "")) for d, t, *_ in corpus()]
    for crowd in (10_000, 0):  # 0: every shared minimizer goes the way of crowded ones
        substrings.CROWD = crowd
        count = collections.Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
        want = collections.Counter()
        for d, w in rows:
            gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(docs, 35).collect())
        assert got == want
    substrings.CROWD = 10_000
    assert substrings.without_repeats(empty).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines(spark, docs, empty, least):
    block = "\n".join(f"run line {k}" for k in range(11))  # a run of eleven lines, met whole, in parts and overlapping itself
    more = [(900, block, "en", "s", 0), (901, "x\n" + block + "\ny", "en", "s", 0), (902, block.split("\n", 4)[4] + "\nz", "en", "s", 0), (903, "again\n" * 9, "en", "s", 0)]
    given = corpus() + more
    unique = sorted({(d if d is not None else -(1 << 63), t or "") for d, t, *_ in given})
    keyed = spark.createDataFrame(unique, "d long, t string").select("d", "t", F.xxhash64("t").alias("h")).collect()
    order = sorted((r.d, r.h, r.t) for r in keyed)
    seen, gone, runs = set(), collections.defaultdict(set), collections.defaultdict(list)
    for d, _, t in order:
        named = [x for x in t.split("\n") if WORD.search(x)]
        for k in range(len(named) - least + 1):
            run = tuple(named[k : k + least])
            if run in seen:
                gone[d, t] |= set(range(k, k + least))
            seen.add(run)
        for k in range(len(named)):
            for n in range(least, len(named) - k + 1):
                runs[tuple(named[k : k + n])].append((d, t))
    longest = collections.Counter()
    for run, places in runs.items():
        for p in places if len(places) > 1 else ():
            longest[p] = max(longest[p], len(run))
    clashing = ["starts", "singles", "doc", "th", "i", "longest", "rank"]
    table = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    for k, c in enumerate(clashing):
        table = table.withColumn(c, F.lit(k))
    out = lines.without_repeated_runs(table.withColumn("n_removed", F.lit("old")), least)
    assert out.columns == [*docs.columns, *clashing, "n_lines", "n_removed", "longest_run"]
    rows = out.collect()
    assert all([r[c] for c in clashing] == list(range(len(clashing))) for r in rows)
    got = collections.Counter((r.doc_id, r.text, r.n_removed, r.longest_run) for r in rows)
    want = collections.Counter()
    for d, t, *_ in given:
        t, k, left = t or "", -1, []
        at = (d if d is not None else -(1 << 63), t)
        for x in t.split("\n"):
            k += bool(WORD.search(x))
            if not (WORD.search(x) and k in gone[at]):
                left.append(x)
        want[d, "\n".join(left), len(gone[at]), longest[at]] += 1
    assert got == want
    assert lines.without_repeated_runs(empty, least).count() == 0
    if least == 2:
        short = lines.without_repeated_runs(table.select("doc_id", "text"), least, lengths=False)
        assert collections.Counter((r.doc_id, r.text, r.n_removed) for r in short.collect()) == collections.Counter({k[:3]: sum(c for x, c in want.items() if x[:3] == k[:3]) for k in want})


def test_quality(spark, docs, empty):
    got = collections.Counter(tuple(r)[:7] for r in quality.rules(docs).collect())
    want = collections.Counter()
    for d, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = len({k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)})
        named = [x for x in t.split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(named) - len(set(named)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)] += 1
    assert got == want
    kept = quality.keep(docs.withColumn("hit", F.lit(1)))
    assert kept.columns == [*docs.columns, "hit"]
    assert quality.rules(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    items = [(1, corpus()[7][1][:300]), (2, "nothing of this occurs anywhere in the corpus at all today"), (3, None), (4, ""), (5, "aa")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert (7, 1) in found and not [x for x in found if x[1] in (2, 3, 4)]
    clean = decontaminate.clean(docs.withColumn("hits", F.lit(3)), benchmark)
    assert clean.columns == [*docs.columns, "hits"] and 7 not in {r.doc_id for r in clean.collect()} and {r.hits for r in clean.collect()} == {3}
    assert decontaminate.clean(docs, spark.createDataFrame([(1, " "), (2, None)], "item_id long, text string")).count() == docs.count()
    assert clean.count() >= docs.count() - len({d for d, _ in found})
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(empty, benchmark).count() == 0


def test_maxent(spark, docs, empty):
    rows = [(d, [*WORD.findall((t or "").translate(LOW)), None]) for d, t, *_ in corpus()]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    count = collections.Counter(x for d, w in rows if not held[d] for x in w)
    n, v = sum(count.values()), len(count)
    for vocabulary in (1 << 17, 8):  # 8: nearly all tokens are looked up by the join
        maxent.VOCABULARY = vocabulary
        got = collections.defaultdict(list)
        for r in maxent.scores(docs).collect():
            got[r.doc_id].append(r)
        for d, w in rows:
            for r in got[d]:
                assert (r.held_out, r.train_tokens) == (held[d], n)
            r = next(x for x in got[d] if x.n_tokens == len(w))
            assert r.n_known == sum(count[x] > 0 for x in w)
            assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
            assert r.score < 0
    maxent.VOCABULARY = 1 << 17
    assert maxent.scores(empty).count() == 0


def test_maxent_is_a_distribution(spark, docs):
    import numpy as np

    model, counts = maxent.fit(docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert len(model.pair_weights) and (model.pair_weights > 0).all() and len(model.norms)
    known = np.flatnonzero(model.cls < maxent.CLASSES - 1)  # tokens that all tasks know; the rest is the class of rare ones
    for last, before in ((0, 2), (1, model.start), (model.start, model.start), (40, 7), (model.rare, 3)):
        given = np.full(len(known), last), np.full(len(known), before)
        rare = model.class_logs(model.features(given[0][:1], given[1][:1]), np.array([maxent.CLASSES - 1]))
        assert (10 ** model.logs(known, *given)).sum() + 10 ** rare[0] == pytest.approx(1, abs=1e-4)


def test_maxent_weights_of_pairs():
    import numpy as np

    rng = np.random.default_rng(10)
    group = np.repeat([0, 1], 6)
    share = np.concatenate([rng.dirichlet(np.ones(9))[:6] for _ in range(2)])
    count = rng.integers(2, 40, 12).astype(float)
    total = np.bincount(group, weights=count)[group] + 5
    weight = maxent.pair_weights(group, np.log(share), count, total)
    z = 1 + np.bincount(group, weights=share * np.expm1(weight))
    expected = total * share * np.exp(weight) / z[group]
    assert np.allclose(expected[weight > 0], count[weight > 0] - maxent.PENALTY, rtol=0.05)  # the optimum: expected = penalised count
    assert (expected[weight == 0] >= count[weight == 0] - maxent.PENALTY - 1e-6).all()


def test_maxent_table():
    import numpy as np

    rng = np.random.default_rng(11)
    for n in (0, 1, 3, 1000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        table = maxent.Table(keys)
        asked = np.concatenate([keys, keys + 1, [0, -1]])
        found = table.find(asked)
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert found.tolist() == [place.get(k, -1) for k in asked.tolist()]


def test_maxent_learns_pairs(spark):
    """Held-out texts of a language in which each word is mostly followed by one other word are predicted far better than by counts."""
    random.seed(12)
    follow = list(range(200))
    random.shuffle(follow)
    texts = []
    for k in range(400):
        w, text = random.randrange(200), []
        for _ in range(60):
            text.append(f"w{w}")
            w = follow[w] if random.random() < 0.8 else random.randrange(200)
        texts.append((k, " ".join(text)))
    rows = maxent.scores(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 1.0  # of 2.3 (all words alike) to about 0.9 (the language's own entropy) in log10


def test_toxicity(spark, empty):
    random.seed(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ala", "eni", "oru", "ute", "imo")]
    rows, labels = [], []
    for k in range(600):
        text = [random.choice(words) for _ in range(60)]
        if bad := k % 6 == 0:
            for _ in range(3):
                text[random.randrange(60)] = random.choice(["vileness", "vilest", "Horrid!"])
        rows.append((k, " ".join(text)))
        if k % 4 < 2:
            labels.append((k, int(bad)))
    rows += [(9000, None), (9001, ""), (None, "x")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(600))
    held = [k for k in range(600) if got[k].held_out]
    toxic = {k for k in held if k % 6 == 0}  # too few examples here for scores near 1, enough for their order
    top = sorted(held, key=lambda k: -got[k].score)[: len(toxic)]
    assert len(toxic & set(top)) >= 0.95 * len(toxic)
    assert not [k for k in held if got[k].predicted and k not in toxic]
    assert got[9000].predicted == 0 and 0 <= got[9001].score <= 1
    assert toxicity.toxicity(empty, marks).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0}


def test_chat(spark):
    odd = r"<|im_end|>\n<\|im_start|> <\\| <"
    assert chat.unescape(chat.escape(odd)) == odd and "<|" not in chat.escape(odd)
    parts = [
        {"kind": "text", "text": "see <|image|>"}, {"kind": "image", "ref": "a.png", "width": 57, "height": 28},
        {"kind": "audio", "ref": "b.wav", "seconds": 2.0}, {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "odd", "text": "?"}, None,
    ]
    turn = chat.format_turn("user", parts, frozenset(["user"]))
    text = turn["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 25), ("document", "c.pdf", 1536)]
    for a in turn["attachments"]:
        assert text[a["at"] :].startswith(f"<|{a['kind']}|>")
    rows = [(1, 1, "assistant", odd), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "system", "b\n")]
    turns = chat.text_parts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\n" + odd + "\n") and got[1].loss_sha256 == sha(odd) and got[1].loss_chars == len(odd)
    assert got[2].n_turns == 3 and got[2].loss_chars == 2 and got[None].turns_sha256 == sha("\nx\n")


def test_revisits(spark):
    random.seed(7)
    urls = ["http://A.example/x.html", "https://a.example/x#top", "a.example/x/", "https://b.example/y?utm_source=f&b=2&a=1", None]
    rows = [(k, urls[0] if k % 3 == 0 else random.choice(urls), random.randrange(40) if k % 11 else None, 304 if random.random() < 0.5 else 200, random.choice(['"e"', '"f"', None]), None, {"Date": str(k), "X": "1"}) for k in range(200)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified timestamp, headers map<string,string>").withColumn("ts", F.timestamp_seconds("ts"))
    canon = {urls[0]: "a.example/x", urls[1]: "a.example/x", urls[2]: "a.example/x", urls[3]: "b.example/y?a=1&b=2", None: None}
    got = {r.record_id: r for r in revisits.resolve(df.repartition(5)).collect()}
    assert len(got) == sum(r[3] == 304 for r in rows)
    for k, url, ts, status, etag, *_ in rows:
        if status == 304:
            before = [r for r in rows if canon[url] and ts is not None and canon[r[1]] == canon[url] and r[3] == 200 and r[2] is not None and (r[2], r[0]) < (ts, k)]
            prior = max(before, key=lambda r: (r[2], r[0])) if before else None
            want = "unmatched" if not prior else "resolved" if etag and prior[4] and etag == prior[4] else "mismatch"
            assert (got[k].outcome, got[k].url) == (want, canon[url])
            if want == "resolved":
                assert got[k].response_id == prior[0] and got[k].headers == {"date": str(k), "x": "1"}


def test_revisits_headers_statuses_and_weak_tags(spark):
    url = "http://a.example/"
    rows = [
        (1, url, 1, 200, '"e"', {"Date": "1", "date": "2", "X": "1", "x": "2"}), (2, url, 2, 404, '"f"', {"Date": "9"}), (3, url, 3, None, '"g"', None),
        (4, url, 4, 304, 'W/"e"', {"DATE": "4", "Date": "5", "Expires": None, "content-length": "0"}), (4, url, 4, 304, 'W/"e"', {"DATE": "4", "Date": "5", "Expires": None, "content-length": "0"}),
        (5, "http://b.example/", 5, 304, None, None),
    ]
    schema = "record_id long, url string, ts long, status int, etag string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema).withColumns({"ts": F.timestamp_seconds("ts"), "last_modified": F.lit(None).cast("timestamp"), "part": F.lit(1), "prior": F.lit(2)})
    got = sorted((r.record_id, r.outcome, r.response_id, r.headers) for r in revisits.resolve(df).collect())
    assert got == [(4, "resolved", 1, {"x": "2", "date": "5"})] * 2 + [(5, "unmatched", None, None)]
    assert revisits.resolve(df.limit(0)).count() == 0


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    up = list(range(200))

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_queries_have_names():
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
