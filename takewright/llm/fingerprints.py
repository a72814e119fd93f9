"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CELLS = 24
PARTS = 3  # each digest lies in one cell of each third
FACTORS = common.mix64(np.arange(4096, dtype=np.uint64) + np.uint64(0xF1)) | np.uint64(1)


def digests(texts: list[str], hashes: common.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all texts' paragraphs, with the text's number.

    A paragraph is a line; long ones are cut where a word's own hash says so, after four words on average, so that a change moves no
    cut beyond it.  The k-th of equal paragraphs has a digest of its own.  The low 16 bits of a digest check the others.
    """
    hashes.forget()
    words = [t.replace("\n", " \n ").split(" ") if t else [] for t in texts]
    sizes = np.array([len(w) for w in words])
    text = np.repeat(np.arange(len(texts)), sizes)
    if not len(text):
        return np.zeros(0, np.uint64), text
    h = hashes.of([w for x in words for w in x])
    cut = ((h >> np.uint64(20)) & np.uint64(3)) == 0
    cut |= h == np.uint64(hashes["\n"])
    begin = np.r_[True, cut[:-1] | (text[1:] != text[:-1])]
    starts = np.flatnonzero(begin)
    place = np.arange(len(h)) - starts[np.cumsum(begin) - 1]
    with np.errstate(over="ignore"):
        key = common.mix64(np.add.reduceat(h * FACTORS[place % len(FACTORS)] + place.astype(np.uint64), starts))
        owner = text[starts]
        order = np.lexsort((key, owner))
        same = np.r_[False, (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])]
        runs = np.flatnonzero(~same)
        nth = np.empty(len(key), np.uint64)
        nth[order] = np.arange(len(key)) - runs[np.cumsum(~same) - 1]
        key = common.mix64(key + nth * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
        return (key << np.uint64(16)) | check_of(key), owner


def check_of(key: np.ndarray) -> np.ndarray:
    return common.mix64(key + np.uint64(0xABCD)) & np.uint64(0xFFFF)


def cells_of(digest: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each part (PARTS, n).  Parts have a power of two of cells, so that a cell's place in a smaller sketch is the rest of that in a larger one."""
    part, h = cells // PARTS, common.mix64(digest ^ np.uint64(0x5EED))
    bits = [(h >> np.uint64(21 * j)) & np.uint64(0x1FFFFF) for j in range(PARTS)]
    if part > 1 << 21:
        bits = [x | (common.mix64(h ^ np.uint64(j + 1)) << np.uint64(21)) for j, x in enumerate(bits)]
    return np.stack([(x & np.uint64(part - 1)).astype(np.int64) + j * part for j, x in enumerate(bits)])


def sketch(digest: np.ndarray, text: np.ndarray, count: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and exclusive-or sums (text, cell)."""
    n, key = np.zeros(count * cells, np.int64), np.zeros(count * cells, np.uint64)
    at = (cells_of(digest, cells) + text * cells).reshape(-1)
    n += np.bincount(at, minlength=len(n))
    np.bitwise_xor.at(key, at, np.tile(digest, PARTS))
    return n.reshape(count, cells), key.reshape(count, cells)


def folded(n: np.ndarray, key: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The smaller sketches that larger ones hold."""
    shape = (len(n), PARTS, n.shape[1] // cells, cells // PARTS)
    return n.reshape(shape).sum(axis=2).reshape(-1, cells), np.bitwise_xor.reduce(key.reshape(shape), axis=2).reshape(-1, cells)


def peel(n: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From differences of sketches: the recovered digests with their rows and signs (1: in the first alone, -1: in the second alone), and of
    each row whether all were recovered.

    A cell that passes its check by chance would put in what it takes out, again and again; so a sketch from which more
    digests come than it has cells has failed.
    """
    n, key = n.copy(), key.copy()
    rows, cells = n.shape
    count = np.zeros(rows, np.int64)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    while True:
        sound = count <= cells
        row, cell = np.nonzero((np.abs(n) == 1) & sound[:, None])
        k = key[row, cell]
        good = check_of(k >> np.uint64(16)) == k & np.uint64(0xFFFF)
        good &= (cells_of(k, cells)[cell // (cells // PARTS), np.arange(len(k))] == cell) if len(k) else good
        row, cell, k = row[good], cell[good], k[good]
        if not len(row):
            whole = sound & (n == 0).all(axis=1) & (key == 0).all(axis=1)
            return *(np.concatenate(x) for x in zip(*found, strict=True)), whole
        sign = n[row, cell]
        order = np.lexsort((k, row))
        fresh = order[np.r_[True, (k[order][1:] != k[order][:-1]) | (row[order][1:] != row[order][:-1])]]
        row, k, sign = row[fresh], k[fresh], sign[fresh]
        found.append((row, k, sign))
        count += np.bincount(row, minlength=rows)
        for at in cells_of(k, cells):
            np.subtract.at(n, (row, at), sign)
            np.bitwise_xor.at(key, (row, at), k)


#: Sketches of texts by their cells: the numbers of the texts, counts and sums.
Sketches = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def sketches(digest: np.ndarray, text: np.ndarray, count: int) -> Sketches:
    """A sketch of each text of the least size (CELLS, doubled again and again) that has one and a half as many cells as digests and gives all of them back when
    it is peeled: where peeling fails, the next size is tried."""
    total = np.bincount(text, minlength=count)
    size = CELLS << np.ceil(np.log2(np.maximum(1.5 * total / CELLS, 1))).astype(np.int64)
    made: Sketches = {}
    cells, pending = CELLS, np.ones(count, bool)
    while pending.any():
        ids = np.flatnonzero(pending & (size <= cells))
        if len(ids):
            number = np.full(count, -1)
            number[ids] = np.arange(len(ids))
            mine = number[text] >= 0
            n, key = sketch(digest[mine], number[text[mine]], len(ids), cells)
            good = peel(n, key)[3]
            made[cells] = ids[good], n[good], key[good]
            pending[ids[good]] = False
        cells *= 2
    return made


def renumbered(some: Sketches, number: np.ndarray) -> Sketches:
    """Those texts' sketches that ``number`` gives a new number (-1: none)."""
    return {cells: (number[ids][kept], n[kept], key[kept]) for cells, (ids, n, key) in some.items() if (kept := number[ids] >= 0).any()}


def sizes_of(some: Sketches, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and digests of each text's sketch."""
    cells, total = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for c, (ids, n, _) in some.items():
        cells[ids], total[ids] = c, n.sum(axis=1) // PARTS
    return cells, total


def of_size(some: Sketches, wanted: np.ndarray, cells: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of ``wanted`` texts, folded to ``cells``."""
    number = np.full(count, -1)
    number[wanted] = np.arange(len(wanted))
    out = np.zeros((len(wanted), cells), np.int64), np.zeros((len(wanted), cells), np.uint64)
    for ids, n, key in renumbered({c: x for c, x in some.items() if c >= cells}, number).values():
        out[0][ids], out[1][ids] = folded(n, key, cells)
    return out


def compared(a: Sketches, b: Sketches, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For text i of ``a`` and text i of ``b``: the digests that one alone has, as (text, digest, sign; 1: in the first alone, -1: in the second alone).

    The larger sketch is folded to the smaller's size, one is subtracted from the other and peeled; where more differs than that size tells, both are peeled
    by themselves at their own sizes, which give back all they hold.
    """
    mine, theirs = sizes_of(a, count)[0], sizes_of(b, count)[0]
    common_size, found, failed = np.minimum(mine, theirs), [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], []
    for cells in np.unique(common_size).tolist():
        rows = np.flatnonzero(common_size == cells)
        (n, key), (m, other) = (of_size(x, rows, cells, count) for x in (a, b))
        row, digest, sign, good = peel(n - m, key ^ other)
        kept = good[row]
        found.append((rows[row[kept]], digest[kept], sign[kept]))
        failed.append(rows[~good])
    rest = np.concatenate(failed) if failed else np.zeros(0, np.int64)
    if len(rest):
        alone = []
        for some, sign in ((a, 1), (b, -1)):
            number = np.full(count, -1)
            number[rest] = rest
            for ids, n, key in renumbered(some, number).values():
                row, digest, _, good = peel(n, key)
                if not good.all():
                    raise ValueError("no fingerprint: a sketch does not give back what it holds")
                alone.append((ids[row], digest, np.full(len(row), sign)))
        row, digest, sign = (np.concatenate(x) for x in zip(*alone, strict=True))
        order = np.lexsort((digest, row))
        row, digest, sign = row[order], digest[order], sign[order]
        twin = np.r_[(row[1:] == row[:-1]) & (digest[1:] == digest[:-1]), False]
        single = ~(twin | np.r_[False, twin[:-1]])
        found.append((row[single], digest[single], sign[single]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def likeness(a: Sketches, b: Sketches, count: int) -> np.ndarray:
    """Jaccard indices of the paragraphs of text i of ``a`` and text i of ``b``, from their sketches alone (``compared``); 1 where both have none."""
    row, _, sign = compared(a, b, count)
    only_a, only_b = (np.bincount(row[sign == s], minlength=count) for s in (1, -1))
    shared = sizes_of(a, count)[1] - only_a
    return np.where(shared + only_a + only_b > 0, shared / np.maximum(shared + only_a + only_b, 1), 1.0)


def strings(some: Sketches, count: int) -> list[str]:
    """Each text's sketch (16-bit counts, 64-bit sums) as base64."""
    out = [""] * count
    for ids, n, key in some.values():
        raw = np.concatenate([n.astype("<u2").view(np.uint8), key.astype("<u8").view(np.uint8)], axis=1)
        for i, r in zip(ids.tolist(), raw, strict=True):
            out[i] = base64.b64encode(r.tobytes()).decode()
    return out


def read(some: list[str]) -> Sketches:
    """Sketches from what ``strings`` made: ``likeness(read(x), read(y), len(x))`` compares texts of which only the fingerprints are there."""
    rows: dict[int, list[tuple[int, bytes]]] = {}
    for i, x in enumerate(some):
        raw = base64.b64decode(x)
        rows.setdefault(len(raw) // 10, []).append((i, raw))
    made: Sketches = {}
    for cells, held in rows.items():
        raw = np.frombuffer(b"".join(r for _, r in held), np.uint8).reshape(len(held), 10 * cells)
        made[cells] = np.array([i for i, _ in held]), raw[:, : 2 * cells].copy().view("<u2").astype(np.int64), raw[:, 2 * cells :].copy().view("<u8").astype(np.uint64)
    return made


def recovered(a: list[str], b: list[str]) -> list[tuple[set[int], set[int]]]:
    """For versions of texts by their fingerprints: the digests of paragraphs in the first alone and in the second alone."""
    row, digest, sign = compared(read(a), read(b), len(a))
    out: list[tuple[set[int], set[int]]] = [(set(), set()) for _ in a]
    for r, d, s in zip(row.tolist(), digest.tolist(), sign.tolist(), strict=True):
        out[r][s < 0].add(d)
    return out


def with_next(docs: DataFrame, rows: int = 1500, most: int = 20_000) -> DataFrame:
    """Documents cut into ranges of doc_id of about ``rows`` rows, each with a copy of the first document after it.

    Columns pid, ghost (1: the copy), doc_id, text; each partition is sorted by (pid, ghost, doc_id descending).  After the last
    document comes the first.  Only bounds and the ranges' largest doc_ids (at most ``most`` numbers) come to the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    parts = min(most, -(-docs.count() // rows)) or 1
    bounds = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bucketizer = Bucketizer(splits=[float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")], inputCol="place", outputCol="pid")
    docs = bucketizer.transform(docs.withColumn("place", place)).drop("place")
    tops = docs.groupBy("pid").agg(F.max("doc_id").alias("doc_id")).orderBy("pid").collect()
    heads = [(float(above["pid"]), top["doc_id"]) for top, above in zip(tops, [*tops[1:], *tops[:1]], strict=True)]
    heads = F.broadcast(spark.createDataFrame(heads, "above double, head long"))
    first = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("above").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"), F.first("doc_id").alias("doc_id"))
    ghosts = first.select("doc_id", F.col("x.text").alias("text"), F.col("above").alias("pid"), F.lit(1).alias("ghost"))
    both = docs.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    return both.repartition(parts, "pid").sortWithinPartitions("pid", "ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text")).select("pid", "ghost", "doc_id", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses.

    The edited text has the last half (floor) of the code points replaced by the first as many, or all, of the next document in
    descending order of doc_id; after the last comes the first.  Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next`` (to the next document's fingerprint).

    Likenesses are those of the returned fingerprints and of nothing else: ``likeness(read([x]), read([y]), 1)`` gives them again.  A fingerprint grows with the
    paragraphs of its text (about 15 base64 digits a cell, one and a half to three cells a paragraph), so that it can give back all of them.
    Null text counts as empty; two texts without paragraphs have likeness 1.  A null doc_id comes last, rows of one doc_id in the
    order of a hash of their texts.  An empty table gives an empty result; other columns are ignored.
    """

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        last: tuple | None = None
        for batch in common.slices(batches, most=2 << 20):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("pid", "ghost", "doc_id", "text")), strict=True))
            rows = [last, *rows] if last else rows
            last = rows[-1]
            here = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not here:
                continue
            texts = [r[3] for r in rows]
            edited = []
            for i in here:
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            n = len(here)
            own = sketches(*digests(texts, hashes), len(texts))
            of_edited = sketches(*digests(edited, hashes), n)
            number = np.full(len(rows) + 1, -1)
            number[here] = np.arange(n)
            a, b = renumbered(own, number), renumbered(own, np.r_[-1, number[:-1]])
            out = [
                pa.array([rows[i][2] for i in here], pa.int64()),
                pa.array([len(texts[i]) for i in here], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array(strings(a, n)),
                pa.array(strings(of_edited, n)),
                pa.array(likeness(a, of_edited, n)),
                pa.array(likeness(a, b, n)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(printed, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
