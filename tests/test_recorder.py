"""The recorder as a batch and as a stream with late and unordered batches."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from takewright.streaming import recorder

SCHEMA = "media_id long, seq long, at timestamp, samples array<double>"
START = dt.datetime(2024, 1, 1)


def batches(seed: int = 0) -> list[tuple]:
    """Two recorders whose batches of 20 ms stop for a second now and then."""
    rng, rows = np.random.default_rng(seed), []
    for media in (1, 2):
        at = 0
        for seq in range(60):
            at += 1000 if seq % 23 == 22 else 20
            rows.append((media, seq, START + dt.timedelta(milliseconds=at), rng.uniform(-1, 1, 64).round(6).tolist()))
    return rows


def brute(rows: list[tuple], most: int) -> list[tuple]:
    out = []
    for media in sorted({r[0] for r in rows}):
        some: list[list[tuple]] = []
        for r in sorted((r for r in rows if r[0] == media), key=lambda r: r[2]):
            if not some or (r[2] - some[-1][-1][2]).total_seconds() > 0.5:
                some.append([])
            some[-1].append(r)
        for part in some:
            x = np.concatenate([r[3] for r in part])
            kept = x[:most]
            out.append((media, part[0][1], len(part), len(kept), len(x) > most, pytest.approx(np.sqrt(np.mean(kept**2)), abs=1e-6), pytest.approx(np.abs(kept).max(), abs=1e-6)))
    return out


@pytest.mark.parametrize("most", [10**6, 1000])
def test_batches_become_recordings(spark, most):
    rows = batches()
    got = sorted(tuple(r) for r in recorder.record(spark.createDataFrame(rows, SCHEMA), most=most).collect())
    assert got == brute(rows, most) and len(got) == 6
    assert recorder.record(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [10**6, 1000])
def test_the_stream_equals_the_batch(spark, tmp_path, most):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = batches()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2] + dt.timedelta(milliseconds=int(np.random.default_rng(i).integers(0, 300))), i))
    end = [(9, 0, START + dt.timedelta(seconds=60), [0.0]), (9, 1, START + dt.timedelta(seconds=120), [0.0])]  # they move the watermark on
    shuffled = [rows[i] for i in order]
    parts = [shuffled[i : i + 17] for i in range(0, len(shuffled), 17)] + [[e] for e in end]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"recorded_{most}"
    query = recorder.record_stream(source, most=most).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table(name).where("media_id < 9").collect())
    assert got == brute(rows, most)
    progress = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert progress[-1] < max(progress), "what has ended leaves the state"
