"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def frequent(docs: DataFrame, tokenizer: str, size: int, sample_rows: int) -> dict[str, int]:
    """Lengths of the ``size`` most frequent chunks of about ``sample_rows`` texts, chosen by hash.

    Which chunks are found decides the speed alone, never a count.  One task reads the sample and tells the table: no chunk is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(tokenizer), Counter()
        for batch in common.slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(encoder.chunks(text or ""))
        found = [x for x, _ in heapq.nsmallest(size, ((x, -n) for x, n in seen.items() if len(x) <= 64 and "\0" not in x), key=lambda e: (e[1], e[0]))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(encoder.lengths(found), pa.int64())], names=["chunk", "n"])

    every = max(1, docs.count() // sample_rows)
    # rows without a text have no chunk; copies of one text are told apart by their documents
    some = docs.where((F.octet_length("text") > 0) & (F.pmod(F.xxhash64("text", "doc_id"), F.lit(every)) == 0)).select("text")
    return {r["chunk"]: r["n"] for r in some.repartition(1).mapInArrow(count, "chunk string, n long").collect()}


class Frequent:
    """The first tier as it is broadcast: chunks in one string and a byte of length each, of which workers make their hash table."""

    def __init__(self, lengths: dict[str, int]):
        self.text = "\0".join(lengths).encode("utf-8", "surrogatepass")
        self.lengths = np.array([min(n, 255) for n in lengths.values()], np.uint8)

    def table(self) -> dict[str, int]:
        words = self.text.decode("utf-8", "surrogatepass").split("\0") if self.text else []
        return {w: n for w, n in zip(words, self.lengths.tolist(), strict=True) if n < 255}


def count_tokens(docs: DataFrame, tokenizer: str, size: int = 1 << 15, cached: int = 300_000, sample_rows: int = 4096) -> DataFrame:
    """Bytes and tokens of every text, as the tokenizer's library counts them without added tokens.

    Chunks between which no token reaches are looked up in a broadcast table of at most ``size`` frequent ones (of a sample of about
    ``sample_rows`` texts), then in the worker's cache of at most ``cached`` others; what neither knows is encoded, a batch at a time.  No chunk is ever shuffled.
    Null text: 0 bytes, 0 tokens.  Repeated rows each keep their row; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = docs.sparkSession.sparkContext.broadcast(Frequent(frequent(docs, tokenizer, size, sample_rows)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, cache = Encoder(tokenizer), first.value.table(), {}
        common_, seen = table.get, cache.get
        for batch in common.slices(batches):
            if len(cache) > cached:
                cache.clear()
            tokens, rests = [], []
            for text in batch.column("text").to_pylist():
                some = encoder.chunks(text or "")
                found = list(map(common_, some))
                rest = [x for x, n in zip(some, found, strict=True) if n is None]
                tokens.append(sum(filter(None, found)))
                rests.append(rest)
            missing = list(set().union(*rests).difference(cache))
            cache.update(zip(missing, encoder.lengths(missing), strict=True))
            tokens = [n + sum(map(seen, rest)) for n, rest in zip(tokens, rests, strict=True)]
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, SCHEMA)
