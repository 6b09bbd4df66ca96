import base64
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trade_insights.llm import alignment
from trade_insights.llm.common import table
from trade_insights.llm.queries import BPE_FILE, PIECE_FILE, op11_alignment

from brute import sha

TEXTS = [None, "", " ", "Hello world, don't stop", "<|endoftext|> <s> x</s> <0x41>", "▁x is no blank", "日本語 ünḯ 🙂  　 12345 ١٢٣\r\n\t", "\x00\x01", "a" * 5000, "ab " * 2000, "x\n\n\n  y", "Hello world, don't stop"]


@pytest.fixture(scope="module")
def plain():
    """Tokens as bytes from other files and calls than the operator's."""
    a, b = Tokenizer.from_file(BPE_FILE), SentencePieceProcessor(model_file=PIECE_FILE)
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        of_a = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        x = [(i, of_a[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, of_b(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == b"".join(t for _, t in y) == want else ([], [])

    return tokens


def placed(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(docs, tokens):
    """Rows of the result, every token against every other."""
    found = [(i, placed(x), placed(y)) for i, t in docs for x, y in [tokens(t)]]
    links = [[(a, b) for a, s, e in x for b, p, q in y if s < q and p < e] for _, x, y in found]
    count = Counter(p for ls in links for p in ls)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (i, x, y), ls in zip(found, links):
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        inside = lambda ts, lo, hi: ",".join(str(k) for k, _, e in ts if lo < e <= hi)
        text = ";".join(f"{inside(x, lo, hi)}|{inside(y, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        out.append((repr(i), len(x), len(y), len(cuts), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), sha(text.encode()) if x else ""))
    return sorted(out)


def got(df):
    return sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("chunk", [1, 2000, 8 << 20])
def test_equal_to_brute_force(spark, plain, chunk, monkeypatch):
    rng = random.Random(chunk)
    some = lambda: "".join(rng.choice(["the ", "nation", " of", "ée", "\n", "🙂", "12", "Zq", "ing "]) for _ in range(rng.randrange(40)))
    docs = [(i, t) for i, t in enumerate(TEXTS) if len(t or "") < 3000] + [(100 + i, some()) for i in range(60)] + [(3, TEXTS[3]), (None, TEXTS[3]), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, chunk string, pairs int").repartition(3)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "PIECE", max(1, chunk // 4))
    assert got(alignment.aligned(df, BPE_FILE, PIECE_FILE)) == brute(docs, plain)


def test_long_texts_and_groups(spark, plain):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r.groups for r in alignment.groups(df, BPE_FILE, PIECE_FILE).collect()}
    for i, t in enumerate(TEXTS):
        x, y = plain(t)
        assert [a for g in rows[i] for a in g.a] == [k for k, _ in x] and [b for g in rows[i] for b in g.b] == [k for k, _ in y]
        ends = [{e for _, _, e in placed(s)} for s in (x, y)]
        assert len(rows[i]) == len(ends[0] & ends[1])
    assert not rows[5]  # U+2581 in a text is read as a blank
    assert len(rows[4]) > 3  # names of special tokens are text


def test_pair_counts(spark, plain):
    docs = [(i, t) for i, t in enumerate(TEXTS) if len(t or "") < 3000]
    found = [tuple(map(placed, plain(t))) for _, t in docs]
    count = Counter((a, b) for x, y in found for a, s, e in x for b, p, q in y if s < q and p < e)
    rows = alignment.linked(spark.createDataFrame(docs, "doc_id long, text string"), BPE_FILE, PIECE_FILE).collect()
    assert {(r.a_id, r.b_id): r["count"] for r in rows} == dict(count)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    assert all(r.is_best == (r["count"] == best[r.b_id]) for r in rows)


def test_either_encoder_gives_the_ids_of_the_library(tmp_path):
    import json

    library = Tokenizer.from_file(BPE_FILE)
    library.encode_special_tokens = True
    rng = random.Random(8)
    parts = ["a", "the ", " ", "\n", "é", "日", "🙂", "'s", "'S", "12", "٣", "\u3000", "\x00", "\r\n", "\x85", "\xa0", "<|endoftext|>", "\ufeff", "ǅ", "_", "!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500)] + [x * 20_000 for x in ("a", " ", "\n", "日")]
    with open(BPE_FILE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = True  # not what a rank encoder does; the library is used
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    plain = Tokenizer.from_file(str(other))
    plain.encode_special_tokens = True
    for path, want in ((BPE_FILE, library), (str(other), plain)):
        both = alignment.Tokenizers(path, PIECE_FILE)
        assert all(both.a(" " + t) == want.encode(" " + t, add_special_tokens=False).ids for t in texts)


def test_galloping_finds_the_first_end_that_is_no_less():
    rng = np.random.default_rng(5)
    for n in (1, 2, 17, 300, 9000):
        values = np.sort(rng.choice(10 * n, n, replace=False))
        wanted = np.sort(rng.integers(0, values[-1] + 1, 200))
        start = np.maximum(np.searchsorted(values, wanted) - rng.integers(0, 50, 200), 0)
        assert (alignment.gallop(values, start, wanted) == np.searchsorted(values, wanted)).all()
    # ends of several texts, ever larger than the strides
    sizes = [1, 3, 5000, 0, 20]
    long, short, base = [], [], 0
    for n in sizes:
        ends = base + 1 + np.sort(rng.choice(4 * n, 2 * n, replace=False)) if n else np.zeros(0, int)
        long.append(ends)
        short.append(np.unique(np.append(rng.choice(ends, n), ends[-1]))[-n:] if n else ends)
        base = ends[-1] if n else base
    n_short, n_long = (np.array([len(x) for x in s]) for s in (short, long))
    short, long = np.concatenate(short), np.concatenate(long)
    assert (alignment.ranks(short, n_short, long, n_long) == np.searchsorted(long, short)).all()


def test_places_survive_packing():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 1000):
        places = np.sort(rng.choice(100_000, n, replace=False))
        counts = rng.integers(1, 70_000, n)
        back = alignment.unpacked(alignment.packed(places, counts))
        assert (back[0] == places).all() and (back[1] == counts).all()


def test_query_on_whole_documents(spark, plain):
    small = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op11_alignment(spark, small).collect()}
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        x, y = plain(t)
        assert (rows[i].n_a, rows[i].n_b) == (len(x), len(y))
    short = [(i, t) for i, t in docs.items() if len(t or "") < 2500][:60]
    assert got(alignment.aligned(spark.createDataFrame(short, "doc_id long, text string"), BPE_FILE, PIECE_FILE)) == brute(short, plain)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs, BPE_FILE, PIECE_FILE).collect() == [] and alignment.groups(docs, BPE_FILE, PIECE_FILE).collect() == [] and alignment.linked(docs, BPE_FILE, PIECE_FILE).collect() == []
