"""Sum-of-squares packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder

MOST_EMPTIED = 4096  # bins that are packed again at once: fewer than these
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("turn", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: whole where its ids fit, else cut so that all but the first have ``capacity`` ids.

    A row of ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null or empty text is one piece, of the end id alone; a
    null doc_id stays null; a repeated row makes its pieces again; an empty table has none.  ``turn`` numbers the pieces of a task one by one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = Encoder(tokenizer), None
        for batch in common.slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = array.array("I", encoder.ids(text or ""))
                ids.append(end_id)
                raw, n = memoryview(ids.tobytes()), len(ids)
                ends = range(n % capacity or capacity, n + 1, capacity)
                for piece, to in enumerate(ends):
                    at = ends[piece - 1] if piece else 0
                    crc = zlib.crc32(raw[4 * at : 4 * to])
                    turn = crc if turn is None else turn + 1
                    rows.append((doc, piece, at, to - at, crc, turn))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE_SCHEMA, strict=True)], schema=PIECE_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing of ``sizes`` in their order: the bin of each, and the places left in each bin.

    Of the bins, open[g] have g > 0 places left.  An item goes where the sum of the squares of open becomes smallest,
    ties to the fullest bin.
    """
    never = np.iinfo(np.int64).max
    open_ = np.zeros(capacity + 1, np.int64)
    of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, left = np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # from gap g to g - s the sum changes by (open[g]-1)^2 - open[g]^2 + (open[g-s]+1)^2 - open[g-s]^2, here less 2;
        # gap 0, a full bin, counts for nothing, and a new bin leaves no other gap
        change = 2 * (open_[: capacity - s + 1] - open_[s:])
        change[0] -= 1
        change[open_[s:] == 0] = never
        change[capacity - s] = 2 * open_[capacity - s] - 1
        gap = int(change.argmin()) + s
        if gap == capacity:
            b = len(left)
            left.append(capacity)
        else:
            b = of_gap[gap].pop()
            open_[gap] -= 1
        bins[i] = b
        left[b] = gap - s
        if gap > s:
            of_gap[gap - s].append(b)
            open_[gap - s] += 1
    return bins, np.array(left, np.int64)


def orders(sizes: np.ndarray, capacity: int, shuffles: int = 4) -> Iterator[np.ndarray]:
    """Orders in which items meet the rule: largest first; and the large ones (more than a quarter, an eighth or a sixteenth of a bin) largest first, the rest in a
    seeded shuffle, which keeps gaps of many sizes open for longer."""
    largest = np.argsort(-sizes, kind="stable")
    yield largest
    for share in (4, 8, 16):
        large = sizes[largest] > capacity // share
        for seed in range(shuffles):
            yield np.r_[largest[large], np.random.default_rng(seed).permutation(largest[~large])]


def best_order(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which the rule takes the fewest bins, the first of several, with the bins (in that order) and the places left."""
    best, least = None, -(-int(sizes.sum()) // capacity)
    for order in orders(sizes, capacity):
        bins, left = fill(sizes[order], capacity)
        if best is None or len(left) < len(best[2]):
            best = order, bins, left
        if len(left) == least:
            break
    return best


def passes(sizes: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passes of the sum-of-squares rule: the items of each in the order in which it placed them, the bins, and the bins' places left (of these items alone).

    The first pass places all items.  After it the emptiest bins, eight at first, are emptied, and the rule places their items anew in its best order; while that
    saves no bin, twice as many are, fewer than MOST_EMPTIED and as long as others stay.  A pass is given only if it saves a bin, and the last pass of an item is where it lies.  It ends where no fewer
    bins could hold the items.
    """
    order, bins, left = best_order(sizes, capacity)
    yield order, bins, left
    of = np.empty(len(sizes), np.int64)
    of[order] = bins
    least, some = -(-int(sizes.sum()) // capacity), 8
    while len(left) > least and some < min(len(left), MOST_EMPTIED):
        pool = np.zeros(len(left), bool)
        pool[np.argsort(-left, kind="stable")[:some]] = True
        items = np.flatnonzero(pool[of])
        order, bins, rest = best_order(sizes[items], capacity)
        if len(rest) >= some:
            some *= 2
            continue
        yield items[order], bins, rest
        of = (np.cumsum(~pool) - 1)[of]
        of[items[order]] = len(left) - some + bins
        left = np.r_[left[~pool], rest]


def fewest(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item after all ``passes``; in a bin, items lie in the order of their numbers."""
    bins, base = np.empty(len(sizes), np.int64), 0
    for items, new, _ in passes(sizes, capacity):
        bins[items] = base + new
        base += len(items)
    bins = np.unique(bins, return_inverse=True)[1]
    order, used = np.argsort(bins, kind="stable"), np.bincount(bins, sizes).astype(np.int64)
    offsets = np.empty(len(sizes), np.int64)
    offsets[order] = np.cumsum(sizes[order]) - sizes[order] - (np.cumsum(used) - used)[bins[order]]
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group_rows: int = 1 << 16) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens by the sum-of-squares rule (``fewest``).

    Returns ``pieces`` with ``sequence_id`` and ``offset``.  Pieces are dealt in turn to groups of about ``group_rows``; each group is packed
    by itself in one task, every piece of it by the rule alone, in the best of 13 orders, so that work and memory of a task have a bound and nothing comes to the
    driver.  A group wastes less than one sequence more than its tokens need.  An empty table gives an empty result; of nulls and repeated rows see ``pieces``.
    """
    cut = common.stash(pieces(docs, tokenizer, capacity, end_id), "pieces")
    groups = -(-cut.count() // group_rows) or 1
    dealt = cut.withColumn("group", F.pmod("turn", F.lit(groups))).drop("turn").repartition(groups, "group").sortWithinPartitions("group")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, ["group"]):
            group = group.combine_chunks()
            sequence, offset = fewest(group["length"].to_numpy(), capacity)
            sequence += group["group"][0].as_py() << 32
            for batch in pa.table([*(group[k] for k in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]).to_batches(1 << 14):
                yield batch

    return dealt.mapInArrow(place, PIECES.replace("turn long", "sequence_id long, offset long"))
