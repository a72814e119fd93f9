"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows a DataFrame may have to be sent to every executor; callers check it.
BROADCAST_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset a temporary one, for a session in one process alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later stages neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or what is like it and no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        while at < len(values):
            to = at
            while to < len(values) and values[to] == values[at]:
                to += 1
            if held and values[at] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last, at = values[at], to
    if held:
        yield pa.Table.from_batches(held)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about ``most`` bytes at most, or one row where its text alone is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def with_score(docs: DataFrame, text: str, into: str, start: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """``docs`` with ``into`` (replaced if there), a number for each text; ``start`` makes a worker's function for a batch of texts.  Other columns may have any names."""
    docs = docs.drop(into)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = plain[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = start()
        for batch in slices(batches, at, 2 << 20):
            out = pa.array(score(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*plain, "score"])

    schema = StructType([*(StructField(p, f.dataType, f.nullable) for p, f in zip(plain, docs.schema, strict=True)), StructField("score", DoubleType())])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns, into)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes by word; ``forget`` bounds what a worker remembers."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def forget(self) -> None:
        if len(self) > self.most:
            self.clear()

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: What str.split takes for white space beyond space and U+0009 to U+000D.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split_words(text: str) -> list[str]:
    """Runs of characters other than space and U+0009 to U+000D."""
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()
