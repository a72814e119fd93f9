"""A manifest of a dataset as Merkle trees: a digest of every row, a tree of each group's rows, a tree of the groups' roots, and each row's proof.

Rows are sorted into indexed partitions.  Each walks its rows with a stack, whose carries in base ``fanout`` complete peaks; what the ends of
a partition leave unpaired stays as nodes of lower levels.  Peaks end at ``height`` levels, so that a *block* of fanout ** height leaves
bounds what a worker holds.  The nodes of a block meet in one task whatever partitions they come from; the blocks' roots are leaves of the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PATH = "array<struct<left:string,right:string>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
Pair = tuple[str, str]


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field is ``-`` where null, else its length in bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that ``digest`` leads to with the siblings of ``path``."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def peaks(digests: Iterable[str], start: int, fanout: int, height: int) -> Iterator[tuple[int, int, str]]:
    """Nodes (level, index, digest) that complete what leaves ``start``, ``start + 1``, ... hold: each last child takes its siblings off the stack and is carried
    up as their parent; at ``height`` levels a peak is done.  Siblings before ``start`` or after the end are missing: their fellows stay as they are."""
    stack: list[tuple[int, int, str]] = []
    for index, digest in enumerate(digests, start):
        level = 0
        while level < height and index % fanout == fanout - 1 and len(stack) >= fanout - 1 and stack[1 - fanout][:2] == (level, index - fanout + 1):
            run = stack[len(stack) - fanout + 1 :]
            del stack[len(stack) - fanout + 1 :]
            digest = joined([*(d for _, _, d in run), digest])
            level, index = level + 1, index // fanout
        if level == height:
            yield level, index, digest
        else:
            stack.append((level, index, digest))
    yield from stack


def merged(nodes: Iterable[tuple[int, int, str]], end: int, top: int, fanout: int) -> tuple[str, dict[tuple[int, int], list[Pair]]]:
    """The root of nodes that tile a block up to leaf ``end``, ``top`` levels above the leaves, and of each the siblings on its way up.

    The last run of a level has what is there, without padding; a lone node is hashed too.
    """
    nodes = list(nodes)
    have: list[dict[int, str]] = [{} for _ in range(top + 1)]
    for level, index, digest in nodes:
        have[level][index] = digest
    beside: list[dict[int, Pair]] = [{} for _ in range(top)]
    for level in range(top):
        for parent in sorted({i // fanout for i in have[level]}):
            children = range(parent * fanout, min((parent + 1) * fanout, -(-end // fanout**level)))
            run = [have[level][i] for i in children]
            have[level + 1][parent] = joined(run)
            for k, i in enumerate(children):
                beside[level][i] = "".join(run[:k]), "".join(run[k + 1 :])
    (root,) = have[top].values()
    return root, {(level, index): [beside[at][index // fanout ** (at - level)] for at in range(level, top)] for level, index, _ in nodes}


def levels(count: int, fanout: int) -> int:
    """Levels from ``count`` leaves to their root."""
    n = 0
    while count > 1:
        count, n = -(-count // fanout), n + 1
    return n


def path_array(paths: list[list[Pair]]) -> pa.Array:
    offsets, lefts, rights = [0], [], []
    for path in paths:
        for left, right in path:
            lefts.append(left)
            rights.append(right)
        offsets.append(len(lefts))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"]))


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows by key, from batches sorted by it, a batch at a time; a run that is not read to its end is passed over."""
    waiting: list[tuple] = []

    def rows() -> Iterator[tuple[tuple, tuple]]:
        for batch in batches:
            key = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            yield from zip(key, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True)

    stream = rows()

    def run(key: tuple) -> Iterator[tuple]:
        while waiting:
            k, row = waiting.pop()
            if k != key:
                waiting.append((k, row))
                return
            yield row
            if (new := next(stream, None)) is not None:
                waiting.append(new)

    if (new := next(stream, None)) is not None:
        waiting.append(new)
    while waiting:
        key = waiting[0][0]
        mine = run(key)
        yield key, mine
        for _ in mine:
            pass


class Forest:
    """The trees of groups of leaves.

    ``leaves`` has ``k`` (the group, a string that is never null), ``o`` (the order in a group, nulls first), ``leaf`` and ``other`` (anything of a row's
    own, a string).  ``nodes`` are the partitions' peaks and edges with their paths to the group's root, ``roots`` has (k, root).
    """

    def __init__(self, leaves: DataFrame, fanout: int, height: int, rows: int):
        if fanout < 2 or height < 1:
            raise ValueError("a fanout of 2 and a height of 1 at least")
        self.fanout, self.height, self.order = fanout, height, ["k", F.asc_nulls_first("o"), "leaf"]
        leaves = leaves.select("k", "o", "leaf", "other")
        self.parts = -(-leaves.count() // rows) or 1
        self.leaves = common.stash(leaves.repartitionByRange(self.parts, *self.order).withColumn("part", F.spark_partition_id()), "leaves")
        of_group = Window.partitionBy("k")
        counts = self.leaves.groupBy("k", "part").agg(F.count("*").alias("n"))
        starts = counts.withColumn("start", F.sum("n").over(of_group.orderBy("part")) - F.col("n")).withColumn("size", F.sum("n").over(of_group)).drop("n")
        self.starts = common.stash(starts, "starts")
        self.nodes, self.roots = self.climbed()

    def with_heads(self, heads: DataFrame) -> DataFrame:
        """The sorted partitions' leaves, before those of a group ``heads`` of that group and partition."""
        both = self.leaves.withColumn("kind", F.lit(1)).unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        return both.repartition(self.parts, "part").sortWithinPartitions("part", "k", "kind", F.asc_nulls_first("o"), "leaf")

    def climbed(self) -> tuple[DataFrame, DataFrame]:
        fanout, height = self.fanout, self.height
        block = fanout**height

        def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (part, k), rows in runs_of(batches, ["part", "k"], ["start", "size", "leaf"]):
                start, size, _ = next(rows)
                found = [(k, part, index * fanout**level // block, level, index, digest, size) for level, index, digest in peaks((r[2] for r in rows), start, fanout, height)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["k", "part", "block", "level", "index", "digest", "size"])

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (k, b), rows in runs_of(batches, ["k", "block"], ["part", "level", "index", "digest", "size"]):
                nodes = list(rows)
                size = nodes[0][4]
                root, paths = merged([n[1:4] for n in nodes], min(size, (b + 1) * block), levels(size, fanout) if size <= block else height, fanout)
                rows_ = [(k, part, b, level, index, None, size) for part, level, index, _, _ in nodes] + [(k, None, b, None, b, root, -(-size // block))]
                path = [paths[level, index] for _, level, index, _, _ in nodes] + [[]]
                columns = zip(("k", "part", "block", "level", "index", "digest", "size"), zip(*rows_, strict=True), strict=True)
                types = {"k": pa.string(), "digest": pa.string(), "part": pa.int32(), "level": pa.int32()}
                arrays = [pa.array(c, types.get(n, pa.int64())) for n, c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, path_array(path)], names=["k", "part", "block", "level", "index", "digest", "size", "path"])

        node = "k string, part int, block long, level int, index long, digest string, size long"
        heads = self.starts.select("k", "part", "start", "size")
        nodes = common.stash(self.with_heads(heads).mapInArrow(stacked, node.replace("part int", "part long").replace("level int", "level long")), "peaks")
        largest = self.starts.agg(F.max("size")).first()[0] or 0
        rounds: list[DataFrame] = []
        while True:
            met_ = common.stash(nodes.repartition("k", "block").sortWithinPartitions("k", "block", "level", "index").mapInArrow(met, f"{node}, path {PATH}"), "blocks")
            rounds.append(met_)
            if largest <= block:
                break
            largest = -(-largest // block)
            tops = met_.where("part is null and size > 1")
            nodes = tops.select("k", F.lit(0).alias("part"), F.expr(f"index div {block}").alias("block"), F.lit(0).alias("level"), "index", "digest", "size")
        roots = rounds[0].where("part is null and size = 1")
        for later in rounds[1:]:
            roots = roots.unionByName(later.where("part is null and size = 1"))
        own = rounds[0].where("part is not null").select("k", "part", "block", "level", "index", "path")
        for later in rounds[1:]:
            above = later.where("part is not null").select("k", F.col("index").alias("block"), F.col("block").alias("above"), F.col("path").alias("more"))
            own = own.join(above, ["k", "block"], "left").withColumn("path", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")))
            own = own.withColumn("block", F.col("above")).drop("more", "above")
        return own.drop("block"), roots.select("k", F.col("digest").alias("root"))

    def spread(self, nodes: DataFrame) -> DataFrame:
        """Every leaf (k, o, leaf, other) with its path: the siblings below its partition's node and those of ``nodes`` above, and with the node's ``subroot`` and ``root``."""
        fanout = self.fanout
        kept = self.leaves.select("k", "o", "leaf", "other")

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, k), rows in runs_of(batches, ["part", "k"], ["kind", "o", "leaf", "other", "level", "index", "path", "subroot", "root"]):
                tops, waiting = [], next(rows)
                while waiting and not waiting[0]:
                    tops.append((waiting[5] * fanout ** waiting[4], waiting[4], waiting[5], [(s["left"], s["right"]) for s in waiting[6]], *waiting[7:]))
                    waiting = next(rows, None)
                for start, level, index, path, subroot, root in sorted(tops):
                    size = fanout**level
                    mine = [waiting, *(next(rows) for _ in range(size - 1))]
                    waiting = next(rows, None)
                    _, paths = merged([(0, start + i, r[2]) for i, r in enumerate(mine)], start + size, level, fanout) if level else (None, {(0, index): []})
                    arrays = [pa.array([k] * size, pa.string()), *(pa.array([r[c] for r in mine], t) for c, t in ((1, types[0]), (2, pa.string()), (3, pa.string())))]
                    whole = path_array([paths[0, start + i] + path for i in range(size)])
                    yield pa.RecordBatch.from_arrays([*arrays, whole, pa.array([subroot] * size, pa.string()), pa.array([root] * size, pa.string())], names=["k", "o", "leaf", "other", "path", "subroot", "root"])

        order = self.leaves.schema["o"].dataType.simpleString()
        types = [{"bigint": pa.int64(), "string": pa.string()}[order]]
        heads = nodes.select("k", "part", "level", "index", "path", "subroot", "root")
        return self.with_heads(heads).mapInArrow(below, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, path {PATH}, subroot string, root string")


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", changed: Column | None = None, fanout: int = 2, height: int = 12, rows: int = 1 << 14) -> DataFrame:
    """Each row's leaf (``leaf`` of ``fields``), its group's root, the root of all and its proof.

    Leaves of a group ascend by ``order`` (a whole number, nulls first; equal ones by digest); every ``fanout`` consecutive nodes become the digest of their
    digests, the last run as it is, until one is left; the groups' roots, by group (null first, by bytes), likewise become ``root``.
    Returns ``order`` as it is named, ``leaf``, ``changed`` (the digest of a row as ``changed`` has it, null without it), ``subroot``, ``root`` and ``path``: the siblings (left, right) of
    every level up to ``root``; ``fold`` and ``proof`` read it.

    Digests alone are sorted and sent, in partitions of about ``rows``; a worker holds fanout ** height of them at most.  Nulls in any field count as null,
    which is no empty text; null groups are a group; repeated rows are leaves of their own; an empty table gives an empty result.  Other columns are ignored.
    """
    o = F.col(order).cast("long")
    k = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null before all others
    leaves = docs.select(k.alias("k"), o.alias("o"), leaf(*(F.col(f) for f in fields)).alias("leaf"), (F.lit(None) if changed is None else changed).cast("string").alias("other"))
    trees = Forest(leaves, fanout, height, rows)
    above = Forest(trees.roots.select(F.lit("").alias("k"), F.col("k").alias("o"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("other")), fanout, height, rows)
    tops = above.nodes.withColumn("subroot", F.lit(None).cast("string")).join(above.roots, "k")
    tops = common.stash(above.spread(tops), "subroots").select(F.col("o").alias("k"), F.col("leaf").alias("subroot"), F.col("path").alias("more"), "root")
    nodes = common.stash(trees.nodes.join(tops, "k").withColumn("path", F.concat("path", "more")).drop("more"), "paths")
    return trees.spread(nodes).select(F.col("o").alias(order), "leaf", F.col("other").alias("changed"), "subroot", "root", "path")
