import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trade_insights.llm import bpe

from brute import sha

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "Hello world, don't stop", "a" * 20_000, "ab " * 5000, "<|endoftext|> x <|endoftext|><|endoftext", "日本語 ünḯ 🙂  　 12345 ١٢٣\r\n\t", "\x00\x01", "x\n\n\n  y", "Hello world, don't stop"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_segment_tree_merges_lowest_rank_leftmost(reference):
    coder = bpe.Bpe(PATH)
    for piece in ["a" * 999, "banana" * 50, "tthhee" * 33, " the", "zq" * 7, "é" * 40]:
        assert coder.merge(piece.encode()) == coder.merge(piece.encode())
        assert coder.decode(coder.encode(piece)) == piece
        want = reference.encode(piece, add_special_tokens=False).ids
        assert list(memoryview(coder.encode(piece)).cast("I")) == want


def test_digests_equal_the_library(spark, reference):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(raw))
        assert got[i].decoded_sha256 == sha(reference.decode(ids, skip_special_tokens=False).encode())


def test_encode_decode_keep_columns_and_round_trip(spark):
    docs = spark.createDataFrame([(None, t, 1) for t in TEXTS], "doc_id long, text string, ids int")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(coded.withColumnRenamed("text", "old"), PATH).collect()
    assert len(back) == len(TEXTS)
    assert all(r.text == (r.old or "") for r in back)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, PATH).collect() == [] and bpe.encode(docs, PATH).collect() == []


def test_cache_generations_do_not_change_ids(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    coder = bpe.Bpe(PATH)
    text = "one two three four five six one two seven one eight nine two ten"
    for _ in range(3):
        assert list(memoryview(coder.encode(text)).cast("I")) == reference.encode(text, add_special_tokens=False).ids
