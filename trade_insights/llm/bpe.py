"""Operator 9: byte-level BPE encoding and decoding.

The vocabulary and merge ranks come from a public tokenizer file whose path is
a parameter. Each piece of a text is merged with a segment tree over the ranks
of its adjacent pairs: the root holds the lowest rank, the descent to it takes
the leftmost one, and a merge changes three leaves, so a piece of m bytes takes
O(m log m) however long it is. Pieces recur, so each task keeps the ids of the
pieces that it met last, in a table of bounded size.

Null and empty texts give no ids and an empty decoded text. Repeated rows are
encoded like any other; other columns are passed through untouched unless they
have the name of an output column, which replaces them.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, held, small_pieces

#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_MERGE = 1 << 60
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
#: Pieces in each of the two generations whose ids a worker keeps.
KEPT_PIECES = 250_000
#: Longer pieces are not kept.
KEPT_LENGTH = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files:
    printable Latin-1 bytes stand for themselves, the rest take the code
    points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, nxt = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(nxt))
            nxt += 1
    return out


class Bpe(dict):
    """Encoder and decoder of one vocabulary; itself the table of pieces."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.byte_ids = [vocab[c] for c in letters]
        #: rank << ID_BITS | id of the merged token, by pair of ids
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << ID_BITS | vocab[b]] = rank << ID_BITS | vocab[a + b]
        of_letter = {c: b for b, c in enumerate(letters)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_letter[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.cut = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.merge(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. A leaf holds rank and result of the pair that
        starts there, a node the lower of its children."""
        ids = [self.byte_ids[b] for b in piece]
        m, found = len(ids), self.merges.get
        if m < 2:
            return ids
        leaves = 1 << (m - 2).bit_length()
        tree = [NO_MERGE] * leaves + [found(a << ID_BITS | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        tree += [NO_MERGE] * (2 * leaves - len(tree))
        for node in range(leaves - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, m + 1)), list(range(-1, m - 1))
        while (low := tree[1]) != NO_MERGE:
            node = 1
            while node < leaves:
                node *= 2
                if tree[node] != low:
                    node += 1
            i = node - leaves
            new = low & ID_MASK
            j, h = after[i], before[i]
            k = after[i] = after[j]
            ids[i], ids[j] = new, -1
            put = [(j + leaves, NO_MERGE)] if j < m - 1 else []
            if k < m:
                before[k] = i
                put.append((i + leaves, found(new << ID_BITS | ids[k], NO_MERGE)))
            else:
                put.append((i + leaves, NO_MERGE))
            if h >= 0:
                put.append((h + leaves, found(ids[h] << ID_BITS | new, NO_MERGE)))
            for node, value in put:
                if tree[node] != value:
                    tree[node] = value
                    node >>= 1
                    while node:
                        a, b = tree[2 * node], tree[2 * node + 1]
                        if b < a:
                            a = b
                        if tree[node] == a:
                            break
                        tree[node] = a
                        node >>= 1
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.specials is None:
            return b"".join([self[p] for p in self.cut.findall(text)])
        out = []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                out.append(np.uint32(self.added[part]).astype("<u4").tobytes())
            elif part:
                out += [self[p] for p in self.cut.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def loaded(path: str) -> Bpe:
    """The coder that this worker keeps while its tasks encode or decode."""
    held[__name__] = _free
    return _loaded(path)


def _free() -> None:
    _loaded.cache_clear()
    gc.collect()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` (array of int) of the ids of ``text``."""
    kept = [c for c in docs.columns if c != ids]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in small_pieces(batches):
            found = [np.frombuffer(bpe.encode(x or ""), "<i4") for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.list_(pa.int32()))], [*kept, ids])

    return arrow_pass(docs.select(*kept), run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the column ``text`` decoded from the array ``ids`` (null: empty)."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in small_pieces(batches):
            found = [bpe.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.string())], [*kept, text])

    return arrow_pass(docs.select(*kept), run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, and the ids
    if wanted: encoded, then decoded from the ids, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in small_pieces(batches):
            found = [bpe.encode(x or "") for x in b.column("text").to_pylist()]
            out = {"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                   "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                   "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in found], pa.string())}
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, DIGESTS + ", ids array<int>" * with_ids)
