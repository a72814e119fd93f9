"""Byte-level BPE of whole texts by a file of ranks, and back: padded matrices in which every row merges one pair a round."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NEVER = np.int64(1 << 40)  # the rank of a pair that never merges
FACTOR = np.uint64(0x9E3779B97F4A7C15)
WIDEST = 256  # bytes of the widest matrix; what is longer goes through a heap, whose time grows with n log n
MOST_CELLS = 1 << 22


class Pairs:
    """Ranks of pairs of ids in a hash table of open addressing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, ids: int):
        self.ids = ids  # also the id that fills rows up: it is in no pair
        bits = max(4, int(4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
        key = left * (ids + 1) + right
        slot = self.slot(key)
        while len(key):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = key[placed], rank[placed]
            rest = np.ones(len(key), bool)
            rest[placed] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * FACTOR) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.ids + 1) + right
        slot = self.slot(key)
        held = self.keys[slot]
        found = np.where(held == key, self.ranks[slot], NEVER)
        again = np.flatnonzero(((held != key) & (held >= 0)).ravel())
        key, slot, flat = key.ravel(), slot.ravel(), found.reshape(-1)
        while len(again):
            slot[again] = (slot[again] + 1) & self.mask
            held = self.keys[slot[again]]
            hit = held == key[again]
            flat[again[hit]] = self.ranks[slot[again[hit]]]
            again = again[~hit & (held >= 0)]
        return flat.reshape(found.shape)


class Vocabulary:
    """Ranks, pairs and tokens of a file of lines ``base64(token) rank``, with the pattern that cuts texts into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in f if line.strip()}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks tokens of single bytes")
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(a, b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 3
        self.pairs = Pairs(left, right, rank, max(self.ranks.values()) + 1)

    def pretokens(self, text: str, most: int = 1 << 18) -> Iterator[list[str]]:
        """The matches of the pattern, ``most`` at a time where a text is long."""
        if len(text) <= most:
            yield self.find.findall(text)
            return
        matches = self.find.finditer(text)
        while some := [m.group() for m in islice(matches, most)]:
            yield some

    def encode(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids (unsigned, little-endian, 32 bits) of pre-tokens: a whole token is its id, all others are merged in matrices of rows of like length."""
        found: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for part in parts:
            raw = part.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                found[part] = whole.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                found[part] = np.array(self.by_heap(raw), "<u4").tobytes()
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((part, raw))
        for bits, rows in buckets.items():
            step = max(1, MOST_CELLS >> bits)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                found.update(zip((p for p, _ in some), self.merged([r for _, r in some], 1 << bits), strict=True))
        return found

    def merged(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of rows of at most ``width`` bytes: each round, every row merges the leftmost of its pairs of least rank, and what has none leaves the matrix."""
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[raw], self.pairs.ids)
        ranks = self.pairs.of(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(rows)), [b""] * len(rows)
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NEVER)
            over = best == NEVER
            if over.any():
                flat, wide = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (r, n) in enumerate(zip(row[over].tolist(), sizes[over].tolist(), strict=True)):
                    out[r] = flat[k * wide : k * wide + 4 * n]
                left = ~over
                row, ids, ranks, sizes, at, best = row[left], ids[left], ranks[left], sizes[left], at[left], best[left]
                if not len(row):
                    break
            here, every = at[:, None], np.arange(len(row))
            ids = np.where(np.arange(ids.shape[1] - 1) > here, ids[:, 1:], ids[:, :-1])
            ids[every, at] = best
            sizes = sizes - 1
            ranks = np.where(np.arange(ranks.shape[1] - 1) >= here, ranks[:, 1:], ranks[:, :-1])
            after, before = np.flatnonzero(at < ranks.shape[1]), np.flatnonzero(at > 0)
            ranks[after, at[after]] = self.pairs.of(best[after], ids[after, at[after] + 1])
            ranks[before, at[before] - 1] = self.pairs.of(ids[before, at[before] - 1], best[before])
        return out

    def by_heap(self, raw: bytes) -> list[int]:
        """The same merges for one long row: pairs by rank and place in a heap, tokens as a linked list."""
        ids: list[int] = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        ranks = self.pairs.of(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        waiting = [(int(ranks[i]), i) for i in np.flatnonzero(ranks < NEVER).tolist()]
        heapq.heapify(waiting)
        token, rank_of = self.tokens, self.ranks
        while waiting:
            rank, i = heapq.heappop(waiting)
            if not alive[i] or (j := after[i]) >= n or rank_of.get(token[ids[i]] + token[ids[j]]) != rank:
                continue
            ids[i], alive[j] = rank, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(token[rank] + token[ids[k]])) is not None:
                    heapq.heappush(waiting, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of.get(token[ids[h]] + token[rank])) is not None:
                heapq.heappush(waiting, (r, h))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as missing:
            raise ValueError(f"no token has the id {missing}") from None


def encode(docs: DataFrame, path: str, pattern: str, cached: int = 200_000, cached_bytes: int = 64 << 20) -> DataFrame:
    """Ids of every whole text: ``doc_id``, ``ids`` (binary: unsigned little-endian numbers of 32 bits).

    Every match of ``pattern`` is encoded by itself, as rank files' library does: a match that is a token is its id, otherwise pairs are merged
    by rank, ties leftmost first.  A worker keeps the ids of at most ``cached`` matches and about ``cached_bytes``; which it keeps never
    changes a result.  Matches of more than 256 bytes, of any length, are merged by a heap instead of a matrix.  Nothing is shuffled.
    Null or empty text: no ids.  Null doc_ids stay null, repeated rows each keep their row, an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache, held = Vocabulary(path, pattern), {}, 0

        def ids_of(texts: list[str]) -> list[bytes]:
            nonlocal held
            if len(cache) > cached or held > cached_bytes:
                cache.clear()
                held = 0
            cut = [vocabulary.find.findall(t) for t in texts]
            new = vocabulary.encode(set().union(*cut).difference(cache))
            held += sum(map(len, new)) + sum(map(len, new.values()))
            cache.update(new)
            return [b"".join(map(cache.__getitem__, x)) for x in cut]

        def ids_of_long(text: str) -> bytes:
            out = []
            for some in vocabulary.pretokens(text):
                new = vocabulary.encode(set(some).difference(cache))
                out.append(b"".join([new[x] if x in new else cache[x] for x in some]))
            return b"".join(out)

        for batch in common.slices(batches, most=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [ids_of_long(texts[0])] if len(texts) == 1 and len(texts[0]) > 1 << 18 else ids_of(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``decoded``, the bytes of the ids' tokens.

    Null ids: no bytes.  An id without a token ends the query with its number.  Repeated rows, null doc_ids and an empty table are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path, pattern)
        for batch in common.slices(batches, "ids", 2 << 20):
            raw = [vocabulary.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
