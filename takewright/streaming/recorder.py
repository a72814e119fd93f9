"""A recorder: batches of samples, in whatever order they come, as recordings that end with a pause.

A recording ends when ``pause_ms`` of event time pass without a batch; it holds at most ``most`` samples, those of its lowest sequence numbers, and says whether
more came.  As a stream each recorder keeps its open recording as state, which a timer empties; as a batch the same rows are found by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RECORDED = "media_id long, first_seq long, batches long, samples long, truncated boolean, rms double, peak double"
PAUSE_MS, MOST = 500, 120 * 48_000


Held = tuple[int, int, int, np.ndarray]  # seq, time in ms, size, and the samples that are held of it


def recordings(rows: list[Held], pause_ms: int) -> list[list[Held]]:
    """Batches by recording: a new one begins after a pause."""
    out: list[list[Held]] = []
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        if not out or row[1] - out[-1][-1][1] > pause_ms:
            out.append([])
        out[-1].append(row)
    return out


class Recorder(StatefulProcessor):
    """State of one recorder: the batches of its open recordings, by sequence number, and a timer at the end of each.

    Of what lies beyond ``most`` samples the sizes alone are held, so that the samples in state have a bound however long a source goes on.
    """

    def __init__(self, pause_ms: int, most: int):
        self.pause_ms, self.most = pause_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "seq long", "at long, n long, samples array<double>")

    def open(self) -> list[list[Held]]:
        return recordings([(int(k[0]), int(v[0]), int(v[1]), np.asarray(v[2], np.float64)) for k, v in self.held.iterator()], self.pause_ms)

    def end(self, some: list[Held]) -> int:
        return some[-1][1] + self.pause_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for seq, at, samples in zip(batch["seq"], batch["at"], batch["samples"], strict=True):
                self.held.updateValue((int(seq),), (int(pd.Timestamp(at).value // 1_000_000), len(samples), [float(v) for v in samples]))
        for some in self.open():
            upto = 0
            for seq, at, n, samples in sorted(some, key=lambda r: r[0]):
                if upto >= self.most and len(samples):
                    self.held.updateValue((seq,), (at, n, []))
                upto += n
            self.handle.registerTimer(self.end(some) + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        for some in self.open():
            if self.end(some) >= now:
                continue
            some = sorted(some, key=lambda r: r[0])
            x = np.concatenate([s for *_, s in some])[: self.most]
            rms, peak = (float(np.sqrt(np.mean(x**2))), float(np.abs(x).max())) if len(x) else (0.0, 0.0)
            row = (key[0], some[0][0], len(some), len(x), sum(n for _, _, n, _ in some) > self.most, round(rms, 6), round(peak, 6))
            for seq, *_ in some:
                self.held.removeKey((seq,))
            yield pd.DataFrame([row], columns=[f.split()[0] for f in RECORDED.split(", ")])

    def close(self) -> None:
        pass


def record_stream(batches: DataFrame, pause_ms: int = PAUSE_MS, most: int = MOST, late: str = "2 seconds") -> DataFrame:
    """``batches`` (media_id, seq, at, samples) of a stream as recordings; batches that come later than ``late`` are left out.

    Needs the state store of RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = batches.withWatermark("at", late).groupBy("media_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Recorder(pause_ms, most), outputStructType=RECORDED, outputMode="append", timeMode="eventTime")


def record(batches: DataFrame, pause_ms: int = PAUSE_MS, most: int = MOST) -> DataFrame:
    """``batches`` (media_id, seq, at, samples) as recordings, all of which have ended.

    A window finds where they end, running sizes how much of each batch is kept; samples are summed where they lie, and none are gathered.
    """
    order = Window.partitionBy("media_id").orderBy("at", "seq")
    ms = F.unix_millis("at")
    x = batches.withColumn("gap", ms - F.lag(ms).over(order)).withColumn("n", F.sum(F.when(F.col("gap") > pause_ms, 1).otherwise(0)).over(order))
    size = F.size("samples").cast("long")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("media_id", "n").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("left", F.greatest(F.lit(0), F.least(size, most - before)).cast("int")).withColumn("kept", F.slice("samples", 1, F.col("left")))
    square = F.aggregate(F.col("kept").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)
    peak = F.greatest(F.coalesce(F.array_max("kept"), F.lit(0.0)), -F.coalesce(F.array_min("kept"), F.lit(0.0)))
    kept = F.sum("left")
    y = x.groupBy("media_id", "n").agg(F.min("seq").alias("first_seq"), F.count("*").alias("batches"), kept.alias("samples"), (F.sum(size) > most).alias("truncated"), F.round(F.sqrt(F.sum(square) / F.nullif(kept, F.lit(0))), 6).alias("rms"), F.round(F.max(peak), 6).alias("peak"))
    return y.select("media_id", "first_seq", "batches", "samples", "truncated", F.coalesce("rms", F.lit(0.0)).alias("rms"), "peak")
