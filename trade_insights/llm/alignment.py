"""Operator 11: cross-tokenizer alignment by galloping intersection.

Each text is encoded by two tokenizers, a byte-level BPE (A) and a piece model
(B), and each token covers a range of the same bytes. The lists of the byte
offsets at which tokens end are intersected by galloping: the shorter list
drives, and from the place that its predecessor has found each of its ends
steps through the longer list in doubling strides, then halves the last
stride. The ends of a whole batch gallop together, in levels: every 4096th end
starts at its text's first token, every 256th where its 4096th has landed, and
so on. Offsets that both lists hold cut the tokens into groups, and the
differences of the ranks found are the ranges of tokens that overlap: token k
of the shorter list meets the tokens from the rank of its start to the rank of
its end. Nothing is compared byte by byte or token by token.

Links are all pairs of overlapping tokens. A pair of ids is counted over the
whole corpus, and a link is a best one if no pair of its B id has a higher
count. Pairs are counted in chunks of about ``CHUNK`` bytes of text, within
the pass that encodes them, so what is shuffled are the distinct pairs of each
chunk: the most frequent pair of all has one row for each chunk. The counts
return to the chunks by the same rows, and to the documents of a chunk in one
cogroup of bounded size. Chunks are cut by text size only, so no key, source or
group of copies can gather in one. A longer text is a chunk of its own.

Texts that are null or empty, or whose tokens do not spell a blank and the text
under both tokenizers, have no tokens, groups and links. Strings of special
tokens within a text are plain text. Best pairs that tie are all best. Repeated
rows, also of one doc_id, are documents of their own; a null doc_id is a value
like any other. An empty table gives an empty result; other columns are
ignored, also such with names of the result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, byte_letters
from .common import arrow_pass, held, ship, small_pieces, stored

#: Bytes of text that are encoded at once, and whose pairs are counted together.
PIECE, CHUNK = 1 << 20, 8 << 20
#: Bits of an id of B in a pair, and of a document's place in its chunk.
ID_BITS, PLACE_BITS = 20, 22
STRIDES = (4096, 256, 16, 1)


def gallop(values: np.ndarray, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted value the first place from its start on where the sorted
    ``values``, whose last is no less, are no less."""
    low, high, step = start.copy(), start.copy(), 1
    left = np.flatnonzero(values[start] < wanted)
    while len(left):
        low[left] = high[left] + 1
        high[left] = np.minimum(high[left] + step, len(values) - 1)
        step *= 2
        left = left[values[high[left]] < wanted[left]]
    left = np.flatnonzero(low < high)
    while len(left):
        middle = (low[left] + high[left]) >> 1
        less = values[middle] < wanted[left]
        low[left[less]] = middle[less] + 1
        high[left[~less]] = middle[~less]
        left = left[low[left] < high[left]]
    return low


def ranks(short: np.ndarray, n_short: np.ndarray, long: np.ndarray, n_long: np.ndarray) -> np.ndarray:
    """For each end of ``short`` the first place in ``long`` whose end is no
    less. Both hold the ends of several texts, one after the other, with so
    many of each text."""
    first = np.cumsum(n_short) - n_short
    own = np.repeat(first, n_short)
    place = np.arange(len(short)) - own
    out = np.repeat(np.cumsum(n_long) - n_long, n_short)
    for above, stride in zip((None, *STRIDES), STRIDES):
        here = np.flatnonzero(place % stride == 0)
        if above:
            out[here] = out[own[here] + place[here] // above * above]
        out[here] = gallop(long, out[here], short[here])
    return out


class Aligned:
    """Texts with their tokens: ids of both sides, laid end to end, how many of
    them each text has, which of them end a group, and the links as places in
    the two lists, with the links of each text together."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]):
        self.ids, self.sizes = ids, sizes
        self.cuts = np.zeros(len(ids[0]), bool), np.zeros(len(ids[1]), bool)
        self.groups, self.n_links = np.zeros(len(sizes[0]), np.int64), np.zeros(len(sizes[0]), np.int64)
        links = []
        drives = sizes[1] < sizes[0]  # per text, the side with the shorter list
        for side in (0, 1):
            of = np.flatnonzero((drives == side) & (sizes[0] > 0))
            if not len(of):
                continue
            (short_at, short), (long_at, long) = ((x, ends[s][x]) for s in (side, 1 - side) for x in [np.flatnonzero(np.repeat((drives == side) & (sizes[0] > 0), sizes[s]))])
            n_short, n_long = sizes[side][of], sizes[1 - side][of]
            last = ranks(short, n_short, long, n_long)
            common = long[last] == short
            first = np.append(0, last[:-1] + common[:-1])
            self.cuts[side][short_at[common]] = True
            self.cuts[1 - side][long_at[last[common]]] = True
            text = np.repeat(of, n_short)
            self.groups += np.bincount(text[common], minlength=len(self.groups))
            met = last - first + 1
            self.n_links += np.bincount(text, met, minlength=len(self.groups)).astype(np.int64)
            a = np.repeat(np.arange(len(short)), met)
            b = np.arange(len(a)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first, met)
            links.append((np.repeat(text, met), *((short_at[a], long_at[b]) if side == 0 else (long_at[b], short_at[a]))))
        none = np.zeros(0, np.int64)
        self.links = tuple(np.concatenate(x) for x in zip(*links)) if links else (none, none, none)


def _encoder(path: str, spec: dict, entries: dict[int, bytes]):
    """The ids of a text by a byte-level BPE file. Where merges rank as their
    results' ids do, which a rank encoder takes for granted, tiktoken finds the
    ids of the file's own library, in a fifth of the time."""
    model, added = spec["model"], {x["id"] for x in spec.get("added_tokens", ())}
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    ranked = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    cut = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if ranked and plain and made == sorted(set(made)) and len(made) + 256 == len(entries.keys() - added):
        from tiktoken import Encoding

        return Encoding(path, pat_str=PIECES, mergeable_ranks={t: i for i, t in entries.items() if i not in added}, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    return lambda text: library.encode(text, add_special_tokens=False).ids


class Tokenizers:
    """The two tokenizers, and what their ids stand for."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        self.b = SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: i for i, c in enumerate(byte_letters())}
        entries = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        entries |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", ())}
        self.a = _encoder(a_path, spec, entries)
        a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if byte_piece else p.replace("▁", " ").encode() for p, byte_piece in pieces]
        self.bytes = a_bytes, b_bytes
        self.lengths = np.array([len(x) for x in a_bytes]), np.array([len(x) for x in b_bytes])
        if max(len(a_bytes), len(b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} entries")
        # an id and what follows it in the list of groups
        self.written = [f"{i}{x}".encode() for size, ends in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for x in ends for i in range(size)]

    def __call__(self, texts: list[str | None]) -> Aligned:
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        found = []
        for side, encode in enumerate((lambda t: self.a(" " + t), lambda t: self.b.encode(t, num_threads=1))):
            spelt = self.bytes[side].__getitem__
            ids = [encode(t) if w else [] for t, w in zip(texts, wanted)]
            found.append(([np.array(x, np.int64) for x in ids], [b"".join(map(spelt, x)) == w for x, w in zip(ids, wanted)]))
        whole = [x and y for x, y in zip(found[0][1], found[1][1])]
        sides = [[x if w else x[:0] for x, w in zip(ids, whole)] for ids, _ in found]
        none = np.zeros(0, np.int64)
        ids = tuple(np.concatenate([none, *x]) for x in sides)
        # the texts of a batch lie end to end, so their ends rise throughout
        return Aligned(ids, tuple(np.cumsum(self.lengths[s][ids[s]]) for s in (0, 1)), tuple(np.array([len(x) for x in sides[s]], np.int64) for s in (0, 1)))

    def groups(self, x: Aligned) -> list[bytes]:
        """For each text `a1,a2|b1;a3|b2,b3`: ids of A and of B, by group."""
        places, codes, base = [], [], 0
        for side in (0, 1):
            ends = np.append(0, np.flatnonzero(x.cuts[1 - side]) + 1)  # of the other side, before each group
            group = np.cumsum(x.cuts[side]) - x.cuts[side] + side  # those of B follow A's of their own group
            places.append(np.arange(len(group)) + ends[group])
            size = len(self.bytes[side])
            codes.append(base + x.ids[side] + size * x.cuts[side])
            base += 2 * size
        order = np.empty(sum(map(len, places)), np.int64)
        for at, code in zip(places, codes):
            order[at] = code
        written, order = self.written.__getitem__, order.tolist()
        ends = np.cumsum(x.sizes[0] + x.sizes[1]).tolist()
        return [b"".join(map(written, order[a:z]))[:-1] for a, z in zip([0, *ends], ends)]


@lru_cache(maxsize=1)
def _loaded(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def loaded(a_path: str, b_path: str) -> Tokenizers:
    """The tokenizers that this worker keeps while its tasks align."""
    held[__name__] = _free
    return _loaded(a_path, b_path)


def _free() -> None:
    _loaded.cache_clear()
    gc.collect()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups, the ids of A and of B in each group of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(a_path, b_path)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in small_pieces(batches, PIECE):
            written = both.groups(both(batch.column("text").to_pylist()))
            split = [[dict(zip("ab", ([int(i) for i in side.split(b",")] for side in g.split(b"|")))) for g in t.split(b";")] if t else [] for t in written]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(split, kind)], ["doc_id", "groups"])

    return arrow_pass(_rows(docs), run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


OF_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: A chunk's documents, with their distinct pairs as places in the chunk's list
#: of pairs; its last row has that list and the number of links of each.
CHUNKED = f"chunk long, {OF_DOC}, links binary, pairs array<long>, counts array<long>"


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising places and counts in few bytes: like bytes of the numbers lie
    together, and most upper ones are 0."""
    both = np.concatenate([np.diff(places, prepend=0), counts]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


class Chunk:
    """Documents whose pairs are counted together."""

    def __init__(self):
        self.size, self.docs, self.keys = 0, [], []

    def add(self, ids: list, size: int, x: Aligned, written: list[bytes]) -> None:
        text, a, b = x.links
        pair = x.ids[0][a] << ID_BITS | x.ids[1][b]
        # each piece's links, equal ones of a document counted
        key, count = np.unique(pair << PLACE_BITS | (text + len(self.docs)), return_counts=True)
        self.keys.append((key, count))
        self.size += size
        self.docs += zip(ids, *(n.tolist() for n in (*x.sizes, x.groups, x.n_links)), (hashlib.sha256(w).hexdigest() if w else "" for w in written))

    def full(self, more: int) -> bool:
        return bool(self.docs) and (self.size >= CHUNK or len(self.docs) + more > 1 << PLACE_BITS)

    def batch(self, number: int) -> pa.RecordBatch:
        key, count = (np.concatenate(x) for x in zip(*self.keys))
        order = np.argsort(key)  # pieces hold different documents, so keys are distinct
        key, count = key[order], count[order]
        pair, doc = key >> PLACE_BITS, key & ((1 << PLACE_BITS) - 1)
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        place = np.cumsum(new) - 1
        order = np.argsort(doc, kind="stable")
        ends = np.cumsum(np.bincount(doc, minlength=len(self.docs)))
        links = [packed(place[o], count[o]) for o in np.split(order, ends[:-1])] if len(self.docs) else []
        totals = np.add.reduceat(count, np.flatnonzero(new)) if len(count) else count
        n, schema = len(self.docs), [pa.int64()] * 5 + [pa.string()]
        columns = [pa.array([*c, None], t) for c, t in zip(zip(*self.docs), schema)]
        one = lambda x: pa.array([None] * n + [x], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([number] * (n + 1), pa.int64()), *columns, pa.array([*links, None], pa.binary()), one(pair[new]), one(totals)],
                                          ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "counts"])


def chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of ``CHUNKED``: texts are encoded, aligned and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk = loaded(a_path, b_path), Chunk()
        number = TaskContext.get().partitionId() << 32
        for batch in small_pieces(batches, PIECE):
            if chunk.full(batch.num_rows):
                yield chunk.batch(number)
                chunk, number = Chunk(), number + 1
            x = both(batch.column("text").to_pylist())
            chunk.add(batch.column("doc_id").to_pylist(), batch.nbytes, x, both.groups(x))
        if chunk.docs:
            yield chunk.batch(number)

    return arrow_pass(_rows(docs), run, CHUNKED)


def _counted(found: DataFrame) -> DataFrame:
    """a_id, b_id, pair, count and is_best of every pair, from chunks."""
    rows = found.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    total = stored(total.select("pair", F.shiftright("pair", ID_BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b_id"), "count"), "align-pairs")
    best = total.groupBy("b_id").agg(F.max("count").alias("highest"))
    return total.join(best, "b_id").select("a_id", "b_id", "pair", "count", (F.col("count") == F.col("highest")).alias("is_best"))


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, count and is_best of each pair of ids that overlap."""
    return _counted(stored(chunks(docs, a_path, b_path), "align-chunks")).drop("pair")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum
    of every text."""
    found = stored(chunks(docs, a_path, b_path), "align-chunks")
    marked = _counted(found).select("pair", "count", "is_best")
    listed = found.where("pairs is not null").select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    returned = listed.join(marked, "pair").select("of", "place", "count", "is_best")
    schema = pa.schema([pa.field(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")])

    def summed(rows: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place] = counts.column("count").to_numpy()
        best[place] = counts.column("is_best").to_numpy(zero_copy_only=False)
        sums = []
        for data in rows.column("links").to_pylist():
            at, n = unpacked(data)
            sums.append((int(n[best[at]].sum()), int((n * count[at]).sum())))
        columns = [rows.column(n) for n in schema.names[:6]] + [pa.array(c, pa.int64()) for c in (zip(*sums) if sums else ((), ()))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    ship(docs.sparkSession)
    rows = found.where("pairs is null").select("chunk", *schema.names[:6], "links")
    return rows.groupBy("chunk").cogroup(returned.groupBy("of")).applyInArrow(summed, f"{OF_DOC}, n_best long, count_sum long")
