"""Operator 5: n-gram Jaccard join with a MinHash LSH forest.

Each text becomes its set of five-word shingles and ``TREES`` signatures of
``DEPTH`` minimum hashes. Every tree is a prefix trie of the signatures:
matches start at the full depth and prefixes are shortened, one hash at a time,
until the modelled recall of pairs at the threshold reaches the target; at each
depth the texts that share a prefix are joined to one of them, which alone goes
on to the shorter prefix. The texts so connected are candidates of each other,
and their exact similarities are then computed from the whole texts, in blocks.

Texts with equal sets are one class and stand in the forest once. Nothing
lists all pairs of a group: buckets give a link from each member to one, and
exact similarities are counted where they are computed, with links reduced to
spanning ones. Joins whose sides both grow with the corpus are sort-merge joins
at every size.

A connected group of up to ``BLOCK`` classes is compared in one place. A larger
one gets a pivot, the majority of the sets of some members, and each member its
exact Jaccard distance from it and its residual, what it has more or less than
the pivot. Members are dealt into ``BLOCKS`` blocks by rising distance (more
only above ``BLOCKS * MOST`` members). Jaccard distance is a metric, so two
blocks are similar throughout if their largest distances add up to at most
1 - threshold, and apart throughout if the gap between them is larger than
that; neither is shipped anywhere. Only pairs of blocks in between are compared,
from the residuals: |x ^ y| is the sum of both sizes less twice what they share.

Null, empty and blank texts have no shingles, no links and a class of their
own. A text of fewer than five words has one shingle, the whole of it. Rows
that agree in doc_id and set count once; a null doc_id is a document like any
other, and the smallest. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anchors import NO_ID
from .common import arrow_pass, as_bytes, mixed, small_pieces, sorted_groups, stored
from .graph import components
from .text_arrays import shingles

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
BLOCK = 512
#: Blocks of a larger group, classes in a block at most, members that make its pivot.
BLOCKS, MOST, PIVOT = 8, 1024, 64
#: Steps of distance that blocks are cut by.
STEPS = 1024
_FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) + np.uint64(1 << 40))
#: Cells of a 0/1 matrix that a block's intersection is summed up over at once.
CELLS = 4 << 20


def prefix_depth(similarity: float, recall: float) -> int:
    """The longest prefix with which the forest finds a pair of the similarity
    with the recall."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < recall:
        depth -= 1
    return depth


def signature(found: np.ndarray) -> np.ndarray:
    """The upper halves of the minimum hashes of a set."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[None, at : at + 2048] * _FACTORS[:, None]
        part += _SHIFTS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, digest (of the text), node (of the set; null without shingles)
    and signature of rows doc_id (long), digest and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches):
            nodes, signs = [], []
            for text in as_bytes(b.column("text")):
                found = shingles(text, words)
                nodes.append(node_of(found) if len(found) else None)
                signs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "digest", "node", "sign"])

    return arrow_pass(docs.select("doc_id", "digest", "text"), run, "doc_id long, digest long, node long, sign binary")


def candidates(classes: DataFrame, depth: int) -> DataFrame:
    """Links a, b that connect the classes sharing a prefix of ``depth``."""
    cut = lambda k: F.xxhash64("tree", F.substring("sign", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * k)))
    trees = classes.select("node", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.select("node", "tree", *(cut(k).alias(f"p{k}") for k in range(depth, DEPTH + 1)))
    shared = stored(trees.groupBy(f"p{depth}").agg(F.count("*").alias("n")).where("n > 1").select(f"p{depth}"), "near-shared")
    rows, links = stored(trees.join(shared.hint("merge"), f"p{depth}", "left_semi"), "near-rows"), None
    for k in range(DEPTH, depth - 1, -1):
        # one of those that share the longer prefix goes on to the shorter one
        heads = stored(rows.groupBy(f"p{k}").agg(F.min("node").alias("head"), *(F.first(f"p{j}").alias(f"q{j}") for j in range(depth, k))), f"near-heads{k}")
        found = rows.join(heads.select(f"p{k}", "head").hint("merge"), f"p{k}").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        links = found if links is None else links.unionByName(found)
        rows = heads.select(F.col("head").alias("node"), *(F.col(f"q{j}").alias(f"p{j}") for j in range(depth, k)))
    return _star(links.distinct())


def _star(links: DataFrame) -> DataFrame:
    """Links that connect what ``links`` (each node's heads, at most one for
    each tree and depth) connect, but go from a node to its smallest head only,
    and from there to its other heads. The members of a large group share their
    heads, so a member has one link, not one for each tree."""
    own = stored(links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("heads")), "near-stars")
    least = F.col("heads")[0]
    return own.select("a", least.alias("b")).unionByName(own.select(F.explode(F.slice("heads", 2, 1 << 16)).alias("a"), least.alias("b"))).distinct()


def _common(found: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, as a square."""
    sizes = np.array([len(x) for x in found])
    owner = np.repeat(np.arange(len(found)), sizes)
    values, column, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, step = int(often.sum()), max(1, CELLS // len(found))
    common = np.zeros((len(found), len(found)), np.float32)
    for at in range(0, total, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(found), min(step, total - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    return common


def _labels(alike: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each row reaches through ``alike``."""
    label = nodes.copy()
    while len(nodes):
        near = np.where(alike, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            break
        label = new
    return label


FOUND = "node long, classes long, documents long, label long"


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "classes", "documents", "label"])


def verified(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """From rows root, node, copies, text of whole groups: for each node its
    links and the smallest node that it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "root"):
            rows: dict[int, tuple] = {}
            for node, copies, text in zip(*(group.column(c).to_pylist() for c in ("node", "copies")), as_bytes(group.column("text").combine_chunks())):
                found = shingles(text, words)
                if node not in rows and node_of(found) == node:  # another text may have the same doc_id
                    rows[node] = copies, found
            nodes, (copies, found) = np.array(list(rows), np.int64), zip(*rows.values())
            sizes, common = np.array([len(x) for x in found], np.float64), _common(list(found))
            alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(alike, False)
            yield _batch(nodes, alike.sum(axis=1), alike @ np.array(copies, np.int64), _labels(alike, nodes))

    return arrow_pass(members.select("root", "node", "copies", "text"), run, FOUND)


def _whole_sets(members: DataFrame, words: int) -> DataFrame:
    """root, n, node, copies and the set of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches):
            found = [shingles(t, words) for t in as_bytes(b.column("text"))]
            own = pa.array([len(x) > 0 and node_of(x) == node for x, node in zip(found, b.column("node").to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "n", "node", "copies")), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], ["root", "n", "node", "copies", "found"])
            yield out.filter(own)

    return arrow_pass(members.select("root", "n", "node", "copies", "text"), run, "root long, n long, node long, copies long, found binary").dropDuplicates(["node"])


def _as_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _pivots(sets_: DataFrame) -> DataFrame:
    """For each group the values that most of about ``PIVOT`` members hold."""

    def majority(rows: pa.Table) -> pa.Table:
        found = [_as_set(x) for x in rows.column("found").to_pylist()]
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"root": rows.column("root")[:1].cast(pa.int64()), "n": rows.column("n")[:1].cast(pa.int64()), "pivot": pa.array([values[2 * counts > len(found)].astype("<u8").tobytes()], pa.binary())})

    some = sets_.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("n")) < PIVOT)
    return some.groupBy("root").applyInArrow(majority, "root long, n long, pivot binary")


def _residuals(sets_: DataFrame) -> DataFrame:
    """root, n, node, copies, size, distance from the pivot, and the values that
    the set and the pivot do not share. A group without a pivot has an empty
    one: its residuals are the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches):
            sizes, far, rest = [], [], []
            for data, other in zip(b.column("found").to_pylist(), b.column("pivot").to_pylist()):
                x, p = _as_set(data), _as_set(other or b"")
                r = np.setxor1d(x, p, assume_unique=True)
                sizes.append(len(x))
                far.append(2 * len(r) / (len(x) + len(p) + len(r)))
                rest.append(r.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "n", "node", "copies")), pa.array(sizes, pa.int64()), pa.array(far, pa.float64()), pa.array(rest, pa.binary())],
                                             ["root", "n", "node", "copies", "size", "far", "rest"])

    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = _pivots(sets_).select("root", "pivot", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = sets_.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).join(dealt, ["root", "salt"], "left")
    return arrow_pass(rows.select("root", "n", "node", "copies", "found", "pivot"), run, "root long, n long, node long, copies long, size long, far double, rest binary")


def _blocks(rows: DataFrame) -> DataFrame:
    """root, block, bounds of the distances, n, copies, smallest node and the
    members of each block, dealt by rising distance."""
    rows = rows.withColumn("step", F.floor(F.col("far") * STEPS).cast("int"))
    steps = rows.groupBy("root", "step").agg(F.count("*").alias("here"))
    before = F.sum("here").over(W.partitionBy("root").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("here")
    n_blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("n") / MOST))
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(1 << 30)
    dealt = rows.join(steps.select("root", "step", "here", before.alias("before")), ["root", "step"])
    dealt = dealt.withColumn("block", F.floor((F.col("before") + share * F.col("here")) * n_blocks / F.col("n")).cast("int"))
    return dealt.groupBy("root", "block").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("own"), F.sum("copies").alias("texts"), F.min("node").alias("head"),
                                              F.collect_list(F.struct("node", "copies", "size", "rest")).alias("members"))


def _compared(cells: DataFrame, threshold: float) -> DataFrame:
    """From pairs of blocks, or a block with itself (no ``others``): links of
    each member there, and links that connect what the blocks connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, others = (batch.column(c)[row].as_py() or [] for c in ("members", "others"))
                both, k = [*own, *others], len(own)
                nodes, copies, sizes = (np.array([m[c] for m in both], np.int64) for c in ("node", "copies", "size"))
                rest = [_as_set(m["rest"]) for m in both]
                more = np.array([len(r) for r in rest])
                apart = more[:, None] + more[None, :] - 2 * _common(rest)
                total = sizes[:, None] + sizes[None, :]
                alike = total - apart >= threshold * (total + apart) - 1e-9
                np.fill_diagonal(alike, False)
                if not others:
                    yield _batch(nodes, alike.sum(axis=1), alike @ copies, _labels(alike, nodes))
                    continue
                across = alike.copy()
                across[:k, :k] = across[k:, k:] = False
                label = np.concatenate([_labels(alike[:k, :k], nodes[:k]), _labels(alike[k:, k:], nodes[k:])])
                a, b = np.nonzero(across[:k, k:])
                pairs = np.unique(np.stack([label[:k][a], label[k:][b]], axis=1), axis=0)
                # of the links between parts, those that connect them
                heads = np.unique(pairs)
                joint = np.zeros((len(heads), len(heads)), bool)
                at = np.searchsorted(heads, pairs)
                joint[at[:, 0], at[:, 1]] = joint[at[:, 1], at[:, 0]] = True
                least = _labels(joint, heads)
                none = np.zeros(len(heads), np.int64)
                yield _batch(np.concatenate([nodes, heads]), np.concatenate([across.sum(axis=1), none]), np.concatenate([across @ copies, none]), np.concatenate([nodes, least]))

    return arrow_pass(cells, run, FOUND)


def _large(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """What ``verified`` gives, for groups of any size."""
    rows = stored(_residuals(stored(_whole_sets(members, words), "near-whole")), "near-residuals")
    blocks = stored(_blocks(rows), "near-blocks")
    facts = blocks.drop("members")
    pair = facts.alias("a").join(facts.alias("b"), (F.col("a.root") == F.col("b.root")) & (F.col("a.block") <= F.col("b.block")))
    most, slack = 1 - threshold, 1e-9
    sure = F.col("a.high") + F.col("b.high") <= most - slack
    never = F.col("b.low") - F.col("a.high") > most + slack
    pair = pair.select(F.col("a.root").alias("root"), F.col("a.block").alias("block"), F.col("b.block").alias("other"), F.col("a.own").alias("a_own"), F.col("a.texts").alias("a_texts"),
                       F.col("b.own").alias("b_own"), F.col("b.texts").alias("b_texts"), F.col("a.head").alias("a_head"), F.col("b.head").alias("b_head"), F.when(sure, "sure").when(never, "never").otherwise("open").alias("kind"))
    pair = stored(pair, "near-pairs")
    # blocks that are similar throughout: counted from their sums, and connected by their smallest nodes
    known = pair.where("kind = 'sure'")
    column = lambda other: [F.col(f"{other}_own").alias("own"), F.col(f"{other}_texts").alias("texts"), F.col(f"{other}_head").alias("head"), (F.col("block") == F.col("other")).alias("itself")]
    sides = known.select("root", "block", *column("b")).unionByName(known.where("block <> other").select("root", F.col("other").alias("block"), *column("a")[:3], F.lit(False).alias("itself")))
    sides = sides.groupBy("root", "block").agg(F.sum("own").alias("own"), F.sum("texts").alias("texts"), F.max("itself").alias("itself"), F.min("head").alias("head"))
    sides = sides.join(blocks.select("root", "block", F.inline(F.transform("members", lambda m: F.struct(m["node"].alias("node"), m["copies"].alias("copies"))))), ["root", "block"])
    itself = F.when(F.col("itself"), 1).otherwise(0)
    similar = sides.select("node", (F.col("own") - itself).alias("classes"), (F.col("texts") - itself * F.col("copies")).alias("documents"), F.col("head").alias("label"))
    none = F.lit(0).cast("long")
    similar = similar.unionByName(known.select(F.col("a_head").alias("node"), none.alias("classes"), none.alias("documents"), F.col("b_head").alias("label")))
    cells = pair.where("kind = 'open'").select("root", "block", "other").join(blocks.select("root", "block", "members"), ["root", "block"])
    cells = cells.join(blocks.select("root", F.col("block").alias("other"), F.col("members").alias("others")), ["root", "other"])
    # few rows of much work: as many tasks as there are, whatever their bytes
    cells = cells.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "block", "other")
    return similar.unionByName(_compared(cells.select("members", F.when(F.col("block") != F.col("other"), F.col("others")).alias("others")), threshold))


def joined(docs: DataFrame, words: int = WORDS, threshold: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, node (the class of equal sets; null without shingles), class_id
    (smallest doc_id of the connected group), n_links (documents with at least
    the similarity) and n_linked_classes (of them, classes of other sets)."""
    texts = _texts(docs)
    return _joined(texts, stored(sets(texts, words), "near-sets"), words, threshold, recall).drop("root")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text"))


def _joined(texts: DataFrame, own: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    # rows that agree in doc_id and set count once
    ids = own.where("node is not null").select("node", "doc_id").distinct().groupBy("node").agg(F.min("doc_id").alias("head_id"), F.count("*").alias("copies"))
    signs = own.where("node is not null").groupBy("node").agg(F.first("sign").alias("sign"))
    classes = stored(signs.join(ids.hint("merge"), "node"), "near-classes")
    groups = components(candidates(classes, prefix_depth(threshold, recall)), "near-candidates")
    size = stored(groups.groupBy("root").agg(F.count("*").alias("n")), "near-sizes")
    placed = groups.join(size, "root").join(classes.select("node", "head_id", "copies"), "node")
    wanted = placed.groupBy("head_id").agg(F.collect_list(F.struct("root", "n", "node", "copies")).alias("places"))
    members = stored(texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("head_id")).select("text", F.inline("places")), "near-members")
    found = verified(members.where(F.col("n") <= BLOCK).repartition("root").sortWithinPartitions("root"), words, threshold)
    if not size.where(F.col("n") > BLOCK).isEmpty():
        found = found.unionByName(_large(members.where(F.col("n") > BLOCK), words, threshold))
    found = stored(found, "near-verified")
    links = found.groupBy("node").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"))
    roots = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), "near-links")
    head = classes.join(roots, "node", "left").select("node", "head_id", "copies", F.coalesce("root", "node").alias("root"))
    smallest = stored(head.groupBy("root").agg(F.min("head_id").alias("class_id")), "near-smallest")
    facts = stored(head.join(smallest, "root").join(links, "node", "left").select("node", "root", "class_id", (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"), F.coalesce("classes", F.lit(0)).cast("long").alias("n_linked_classes")), "near-facts")
    out = own.select("doc_id", "node").distinct().join(facts.hint("merge"), "node", "left")
    named = lambda c: F.when(c != NO_ID, c)
    return out.select(named(F.col("doc_id")).alias("doc_id"), "node", "root", named(F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_classes", F.lit(0)).alias("n_linked_classes"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` for each group: a row of its smallest doc_id. Of
    rows that agree in this id and in their set, one stays; another text of
    the id goes with its own group."""
    texts = _texts(docs)
    own = stored(sets(texts, words), "near-sets")
    found = _joined(texts, own, words, threshold, recall)
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("head_id"), F.col("node").alias("head_node"), "root").distinct()
    kept = own.join(heads.hint("merge"), (F.col("doc_id") == F.col("head_id")) & F.col("node").eqNullSafe(F.col("head_node")))
    kept = stored(kept.groupBy("head_id", "root").agg(F.min("digest").alias("head_digest")).drop("root").distinct(), "near-heads")
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    at = {c: F.col(n) for c, n in zip(docs.columns, names)}
    wide = wide.select("*", F.coalesce(at["doc_id"].cast("long"), F.lit(NO_ID)).alias("head_id"), F.xxhash64(F.coalesce(at["text"].cast("string"), F.lit(""))).alias("head_digest"))
    out = wide.join(kept.hint("merge"), ["head_id", "head_digest"]).dropDuplicates(["head_id", "head_digest"])
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
