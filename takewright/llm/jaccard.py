"""N-gram Jaccard join through a MinHash LSH forest, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

BITS, HALF = 16, 4  # of a level of a signature, and levels in each of its two numbers
SIGNED = "doc_id long, text_key long, node binary, n int, upper array<long>, lower array<long>"


def depth_for(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """Shorten the matched prefix from ``deepest`` until a pair at ``threshold`` shares one in some tree with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_index(n: int, threshold: float) -> float | None:
    """The smallest Jaccard index from ``threshold`` on that a set of ``n`` can have with a different set; None: it can have none.

    With i elements in common and m in the other set it is i / (n + m - i), where i is n, and m larger, or i is smaller, and m at least i.
    """
    found = [i / (n + m - i) for i in range(1, n + 1) for m in range(i + (i == n), int(n / threshold) + 2) if i / (n + m - i) >= threshold - 1e-9]
    return min(found) if found else None


def depths(threshold: float, trees: int, deepest: int, recall: float, sizes: int = 64) -> tuple[list[int], int]:
    """How far the prefixes of a set are shortened, for sets of 1 to ``sizes`` and for larger ones; deeper than ``deepest``: the set can have no partner.

    Small sets have few possible indices, so that theirs may stay longer: a set of 3 is at least 0.8 alike to itself alone, one of 7 at least 0.857.
    """
    least = [least_index(n, threshold) for n in range(1, sizes + 1)]
    return [deepest + 1 if t is None else depth_for(t, trees, deepest, recall) for t in least], depth_for(threshold, trees, deepest, recall)


def shingles(texts: list[str | None], width: int, hashes: common.WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words; of a shorter text, its words as one run; without words, none."""
    hashes.forget()
    factors = common.mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    found = []
    for text in texts:
        words = common.split_words(text or "")
        h = hashes.of(words)
        n = max(1, len(words) - width + 1) if words else 0
        with np.errstate(over="ignore"):
            sums = sum((h[i : i + n] * f for i, f in enumerate(factors[: len(words)])), np.zeros(n, np.uint64))
        if 0 < len(words) < width:
            sums = sums + np.uint64(len(words))
        found.append(np.unique(common.mix64(sums)))
    return found


def node_of(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def sign(docs: DataFrame, width: int, trees: int, seed: int = 1) -> DataFrame:
    """Each document's shingle set as a 128-bit digest, its size, and for each tree a signature: BITS bits of each of 2 HALF minima, first levels first."""
    keys = common.mix64(np.arange(4 * trees * HALF, dtype=np.uint64) + np.uint64(seed << 32)).reshape(2, trees, 2 * HALF)
    masks, factors = keys[0], keys[1] | np.uint64(1)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in common.slices(batches):
            sets = shingles(batch.column("text").to_pylist(), width, hashes)
            some = [i for i, x in enumerate(sets) if len(x)]
            halves: tuple[list, list] = ([None] * len(sets), [None] * len(sets))
            if some:
                flat = np.concatenate([sets[i] for i in some])
                starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
                out = np.zeros((2, len(some), trees), np.uint64)
                with np.errstate(over="ignore"):
                    for t in range(trees):
                        for k in range(2 * HALF):
                            least = np.minimum.reduceat((flat ^ masks[t, k]) * factors[t, k], starts)
                            out[k // HALF, :, t] = (out[k // HALF, :, t] << np.uint64(BITS)) | (common.mix64(least) >> np.uint64(64 - BITS))
                for half, rows in zip(halves, out.view(np.int64).tolist(), strict=True):
                    for i, row in zip(some, rows, strict=True):
                        half[i] = row
            longs = pa.list_(pa.int64())
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array([node_of(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(halves[0], longs), pa.array(halves[1], longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n", "upper", "lower"])

    return docs.mapInArrow(signed, SIGNED)


def prefix(level: int) -> list[Column]:
    """The first ``level`` minima of a signature, as its two numbers with all else 0."""
    bits = [BITS * min(level, HALF), BITS * max(level - HALF, 0)]
    masks = [-(1 << (64 - b)) if b else 0 for b in bits]
    return [F.col(c).bitwiseAND(F.lit(m).cast("long")).alias(c) for c, m in zip(("upper", "lower"), masks, strict=True)]


def candidates(nodes: DataFrame, threshold: float, trees: int, recall: float) -> DataFrame:
    """(a, b): links that join all nodes which share a prefix at the depth where their own descent ends.

    A tree is a trie of signatures, its nodes the groups of equal prefixes.  From the deepest level on, rows of a group are linked to its smallest node, which
    alone goes on with the prefix shortened by one, until its set's size allows to stop (``depths``): so the rows that reach
    the shallow levels are few, however many share a prefix there.  What shares no prefix at the last level is left out before the first.
    """
    deepest = 2 * HALF
    by_size, last = depths(threshold, trees, deepest, recall)
    stop = F.coalesce(F.get(F.array(*map(F.lit, by_size)), F.col("n") - 1), F.lit(last)).alias("stop")
    rows = nodes.select("node", stop, F.explode(F.arrays_zip("upper", "lower")).alias("x")).where(F.col("stop") <= deepest)
    rows = rows.select("node", "stop", "x.upper", "x.lower")
    start = prefix(min(last, HALF))[0].alias("start")
    shared = rows.select(start).groupBy("start").agg(F.count("*").alias("c")).where("c > 1")
    rows = common.stash(rows.withColumn("start", start).join(shared, "start").select("node", "stop", "upper", "lower"), "matched")
    links = None
    for level in range(deepest, last - 1, -1):
        here = rows.where(F.col("stop") <= level).select("node", "stop", *prefix(level))
        groups = here.groupBy("upper", "lower").agg(F.min("node").alias("least"), F.min("stop").alias("stop"), F.count("*").alias("c"))
        groups = common.stash(groups, f"level-{level}")
        found = here.join(groups.where("c > 1").select("upper", "lower", "least"), ["upper", "lower"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        links = found if links is None else links.unionByName(found)
        rows = groups.select(F.col("least").alias("node"), "stop", "upper", "lower")
    return links


def verify(sets: list[np.ndarray], block: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j, of two blocks where ``across``) whose Jaccard index is ``threshold`` or more."""
    sizes = np.array([len(x) for x in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *sizes[:-1]])
    flag = np.zeros(int(inverse.max()) + 1, np.int32)
    left, right = [], []
    for i in range(len(sets) - 1):
        others = np.arange(len(sets)) > i
        if across:
            others &= block != block[i]
        others &= (np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i]) - 1e-9)
        if not others.any():
            continue
        mine = inverse[starts[i] : starts[i] + sizes[i]]
        flag[mine] = 1
        shared = np.add.reduceat(flag[inverse], starts)
        flag[mine] = 0
        good = np.flatnonzero(others & (shared >= threshold * (sizes + sizes[i] - shared) - 1e-9))
        left.append(np.full(len(good), i))
        right.append(good)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 16, recall: float = 0.9995, block_rows: int = 256, block_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node) of every document, and (node, label, first, links, copies) of every shingle set: ``label`` is the same for sets that are linked,
    ``first`` the first document of the set, as (doc_id, text_key), and ``links`` the number of documents of other sets linked with it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = common.stash(sign(docs, width, trees), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("upper").alias("upper"), F.first("lower").alias("lower")
    )
    nodes = common.stash(nodes, "nodes")
    groups = common.stash(components(candidates(nodes, threshold, trees, recall)), "groups")
    linked = verified(docs, nodes, groups, width, threshold, block_rows, block_bytes)
    labels = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first", "copies").join(sums, "node", "left").join(labels, "node", "left")
    known = common.stash(known.select("node", F.coalesce("label", "node").alias("label"), "first", F.coalesce("links", F.lit(0)).alias("links"), "copies"), "known")
    return signed.select("doc_id", "text_key", "node"), known


def link(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 16, recall: float = 0.9995, block_rows: int = 256, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the smallest doc_id linked with it, over any number of links) and ``n_links``
    (other documents whose sets of ``width``-word shingles have a Jaccard index of ``threshold`` or more with its own).

    Documents of one shingle set are one node.  Each node has a signature of 8 MinHash minima for each of ``trees`` trees; of nodes that share a
    prefix, which is shortened level by level until the trees together find a pair at the least index that the node's size allows
    with probability ``recall``, candidate groups are made by links to the smallest node, never by pairs (``candidates``).  Each group is then verified on exact
    shingle sets in pairs of blocks of bounded size, which return counts and a spanning link for each node, so that a group of any
    size neither meets in one task nor is written out as pairs.

    A text without words, a null one too, links to nothing.  Repeated rows are copies of each other; a null doc_id is no smallest one unless there is no other.
    An empty table gives an empty result; other columns are ignored.
    """
    rows, known = classes(docs, threshold, width, trees, recall, block_rows, block_bytes)
    least = common.stash(known.groupBy("label").agg(F.min("first.doc_id").alias("class_id")), "least")
    known = common.stash(known.join(least, "label").select("node", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "classes")
    found = rows.select("doc_id", "node").join(known, "node", "left")
    return found.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 16, recall: float = 0.9995) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group (smallest doc_id, null first; of one doc_id the smallest hash of the
    text); of rows that repeat a doc_id and its text, one.  Texts without words are groups by themselves.

    Which rows these are is found on keys alone; the texts meet the keys once.
    """
    rows, known = classes(docs, threshold, width, trees, recall)
    first = known.groupBy("label").agg(F.min("first").alias("x")).select("x.doc_id", "x.text_key")
    first = first.unionByName(rows.where("node is null").select("doc_id", "text_key").distinct())
    # a null doc_id as a value, with a mark; equal keys on both sides, so that rows are dealt out once for the join and for what repeats
    keys = [common.fresh(docs, f"first_{x}") for x in ("doc", "none", "text")]

    def values(text_key: Column) -> list[Column]:
        doc = F.col("doc_id").cast("long")
        return [F.coalesce(doc, F.lit(0)).alias(keys[0]), doc.isNull().alias(keys[1]), text_key.alias(keys[2])]

    first = common.stash(first.select(*values(F.col("text_key"))), "first")
    own = docs.select(*map(common.named, docs.columns), *values(F.xxhash64(F.col("text").cast("string"))))
    return own.join(first, keys).dropDuplicates(keys).select(*map(common.named, docs.columns))


def verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, width: int, threshold: float, block_rows: int, block_bytes: int) -> DataFrame:
    """(node, links, root) for each node and block pair in which it has links; root: the smallest node reached there."""
    inside = nodes.select("node", "first", "copies", "n").join(groups, "node")
    sizes = inside.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") * 8 / block_bytes)).alias("blocks"))
    # written, so that both sides of the join are dealt out for it and a large group's partition can be split
    sizes = common.stash(sizes, "sizes")
    inside = common.stash(inside.join(sizes, "label").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "copies", "label", "blocks"), "inside")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in common.slices(batches):
            sets = shingles(batch.column("text").to_pylist(), width, hashes)
            keep = pa.array([node_of(x) == node for x, node in zip(sets, batch.column("node").to_pylist(), strict=True)])
            grams = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], grams], names=[*batch.schema.names[1:], "grams"]).filter(keep)

    texts = docs.join(inside.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))).select("text", "node", "copies", "label", "blocks")
    sets = texts.mapInArrow(expand, "node binary, copies long, label binary, blocks long, grams binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("label", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "copies", "grams")
    keys = ["label", "p", "q"]
    pairs = pairs.repartition(*keys).sortWithinPartitions(*keys, "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, list, list] = [], [], []
        for group in common.sorted_groups(batches, keys):
            node, own = group["node"].to_pylist(), group["own"].to_numpy()
            fresh = [i for i in range(len(node)) if not i or node[i] != node[i - 1]]  # rows that repeat a doc_id and its text
            node, own, copies = [node[i] for i in fresh], own[fresh], group["copies"].to_numpy()[fresh]
            sets = [np.frombuffer(group["grams"][i].as_py(), np.uint64) for i in fresh]
            left, right = verify(sets, own, group["p"][0] != group["q"][0], threshold)
            if not len(left):
                continue
            links = np.bincount(left, copies[right], len(node)) + np.bincount(right, copies[left], len(node))
            root = list(range(len(node)))

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            for i in np.flatnonzero(links).tolist():
                rows[0].append(node[i])
                rows[1].append(int(links[i]))
                rows[2].append(node[find(i)])
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["node", "links", "root"])

    return common.stash(pairs.mapInArrow(check, "node binary, links long, root binary"), "linked")
