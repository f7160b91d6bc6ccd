"""Piece encoding against the library that made the model."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from formloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return pieces.Encoder(f.read())


def texts():
    random.seed(3)
    alphabets = ["ab", "eithousr ", "▁ ", "  \n\t", "éü中文字日本", "<s>/0x41", "the and ing ion", "01239.,!?'\"-", "😀\x00​ﬁ"]
    mixed = ["".join(random.choice(random.choice(alphabets)) for _ in range(random.randrange(1, 60))) for _ in range(1500)]
    codes = ["".join(random.choice("abcdefghijklmnopqrstuvwxyzABCDE0123456789+/=_") for _ in range(random.randrange(1, 300))) for _ in range(300)]
    spaces = [" " * k + "if" + " " * (50 - k) + "(x)" for k in range(50)]
    return mixed + codes + spaces + ["", " ", "<s>", "<0x41>", "a" * 20_000, " " * 5000 + "ab" * 30_000, ("word, " * 30_000).strip()]


def test_ids(encoder):
    given = texts()
    assert [encoder.encode(t) for t in given] == encoder.library.encode(given)


def test_pieces_of_single_pieces(encoder):
    random.seed(4)
    some = random.sample(sorted(encoder.ids), 400)
    joined = ["".join(random.sample(some, 3)) for _ in range(2000)]
    assert [encoder.encode(t) for t in joined] == encoder.library.encode(joined)


def test_memories_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    given = [f"word{k} and-more{k}" for k in range(300)]
    assert [encoder.encode(t) for t in given] == encoder.library.encode(given)
    assert len(encoder.pairs) <= 50 and len(encoder.segments) <= 50


def test_cuts_leave_whole_texts_where_pieces_cross_spaces():
    assert pieces._cuts({("a", "▁"), ("▁", "b")}).findall("▁a▁b\n") == ["▁a▁b\n"]
    assert "".join(pieces._cuts({("a", "b"), ("'", "s"), ("▁", "a")}).findall("▁▁ab's x\n")) == "▁▁ab's x\n"


def test_table(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "no id"), (7, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = sorted(map(tuple, pieces.encode_decode(df.repartition(3), PATH).collect()), key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [(k, ids := library.encode(t or ""), library.decode(ids)) for k, t in rows]
    assert got == sorted(want, key=repr)
    assert pieces.encode_decode(df.limit(0), PATH).count() == 0


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_pieces(spark, "/root/testdata/sf0.001").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "")
        assert got.pop(doc) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert not got
