"""Filters over many recordings at once against the same filters over one, and notes' samples in workers against columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from takewright.functions import lanes as L
from takewright.functions import signal as S
from takewright.operators import blocks as B
from takewright.plans import catalog
from takewright.plans.base import Tables
from takewright.plans.recordings import RATE, SIZE, Tones, tone

SF = "/root/testdata/sf0.001"
ALL = ("l01_l02_l05_l10_recording_levels", "l03_l04_l09_recording_voices", "l06_l07_l08_recording_loudness", "l11_linear_rates", "l12_recording_rates", "l19_recording_vocal_bands")


def signals(lanes: int, n: int = 3000) -> np.ndarray:
    rng = np.random.default_rng(lanes)
    t = np.arange(n) / 16_000
    return np.stack([np.clip((0.2 + k % 5 / 4) * np.sin(2 * np.pi * (100 + 37 * k) * t) * (np.sin(40 * t + k) > 0) + 0.01 * rng.normal(size=n), -1, 1) for k in range(lanes)])


def run(filter_, x: np.ndarray, pieces: tuple[int, ...]) -> list:
    state, made = np.stack([filter_.start()] * len(x)), []
    for piece in np.split(x, np.cumsum(pieces), axis=1):
        state, rows = filter_.push(state, piece)
        made += rows
    return made + filter_.end(state)


@pytest.mark.parametrize("lanes", [1, L.FEW - 1, L.FEW, 40])
def test_lanes_are_recordings(lanes):
    x = signals(lanes)
    y, past = L.biquad(np.ascontiguousarray(x[:, :1000].T), *S.SHELF, np.zeros((4, lanes)))
    z, _ = L.biquad(np.ascontiguousarray(x[:, 1000:].T), *S.SHELF, past)
    assert np.array_equal(np.concatenate([y, z]).T, np.stack([S.biquad(v, *S.SHELF) for v in x]))
    [(rows, found)] = run(L.Transients(16_000), x, (1, 300, 256, 900, 1000))
    assert rows.tolist() == list(range(lanes)) and list(zip(*found, strict=True)) == [S.transients(v, 16_000) for v in x]
    [(_, (n, p, most))] = run(L.VocalBand(16_000), x, (7, 2000))
    whole = [S.vocal_band(v, 16_000) for v in x]
    gain = np.array([min(5.0, 0.9 / top) for top in most])
    assert n.tolist() == [3000] * lanes and p * gain**2 == pytest.approx([float(v @ v) for v in whole]) and most * gain == pytest.approx([np.abs(v).max() for v in whole])
    hops = run(L.Weighted(700), x, (699, 2, 1400))
    y = np.stack([S.biquad(S.biquad(v, *S.SHELF), *S.HIGH_PASS).astype(float) ** 2 for v in x])
    assert [int(place[0]) for _, (place, _, _) in hops] == [0, 1, 2, 3, 4] and [int(size[0]) for _, (_, _, size) in hops] == [700, 700, 700, 700, 200]
    for k, (_, (_, power, _)) in enumerate(hops):
        assert power == pytest.approx(y[:, 700 * k : 700 * (k + 1)].sum(axis=1))


def test_pitches_of_some_frames_are_those_of_each():
    frames = np.concatenate([signals(30, 2048), np.zeros((1, 2048)), np.full((1, 2048), 0.3)])
    found = [None if f != f else f for f in S.pitches_hz(frames, 16_000).tolist()]
    assert found == pytest.approx([S.pitch_hz(f, 16_000) for f in frames]) and None in found
    assert np.isnan(S.pitches_hz(frames[:, :100], 16_000)).all()


def test_notes_in_workers_sound_like_those_of_columns(spark):
    odd = spark.createDataFrame([(1, "view", 12.5), (1, "error", 7.0), (1, "signup", None), (1, "view", float("nan")), (1, "view", float("inf")), (1, "signup", 99.99), (1, None, 3.0)], "user_id long, event_type string, value double")
    events = odd.withColumns({"event_id": F.monotonically_increasing_id(), "ts": F.lit("2024-01-01").cast("timestamp")})

    class Odd(Tables):
        events = None

    t = Odd(spark, SF)
    t.events = events
    rows = t.notes.withColumn("samples", tone(F.col("note"))).orderBy("block").collect()
    notes = pa.array([r["note"].asDict() for r in rows])
    for k, r in enumerate(rows):
        assert np.abs(Tones().make(Tones().read(notes)[k : k + 1], 0, r["n"])[0] - np.array(r["samples"])).max() <= 1.01 / 32768, r
        assert np.array_equal(Tones().make(Tones().read(notes)[k : k + 1], 100, 200), Tones().make(Tones().read(notes)[k : k + 1], 0, r["n"])[:, 100:200])


@pytest.mark.parametrize("name", ALL)
def test_recordings_are_looked_at_once_and_their_samples_are_made_in_workers(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(sequence" not in plan and "sin(" not in plan.lower().replace("using(", "")
    assert plan.count("MapInArrow") == (2 if name.startswith(("l01", "l03")) else 1)


def test_notes_and_blocks_agree(spark):
    t = Tables(spark, SF)
    notes, blocks = (df.where("media_id <= 3") for df in (t.notes, t.tones))
    rows = lambda df: sorted(tuple(v if isinstance(v, list) or v is None else round(v, 9) for v in r) for r in df.collect())
    pairs = [(B.levels(notes, SIZE, RATE, Tones()), B.levels(blocks, SIZE, RATE)), (B.prosody(notes, SIZE, RATE, Tones()), B.prosody(blocks, SIZE, RATE)), (B.transients(notes, RATE, Tones()), B.transients(blocks, RATE)), (B.tails(notes, SIZE, RATE, Tones()), B.tails(blocks, SIZE, RATE)), (B.loudness(notes, SIZE, 48_000, Tones()), B.loudness(blocks, SIZE, 48_000))]
    for found, wanted in pairs:
        assert rows(found) == rows(wanted)
    sums = lambda df: df.groupBy("media_id").agg(F.sum("n"), F.round(F.sum("p"), 6), F.round(F.max("most"), 9))
    square = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v)
    told = lambda df: df.select("media_id", F.size("samples").alias("n"), square.alias("p"), F.greatest(F.array_max("samples"), -F.array_min("samples")).alias("most"))
    for found, wanted in [(B.resample(notes, SIZE, RATE, 48_000, make_samples=Tones(), sums=True), B.resample(blocks, SIZE, RATE, 48_000)), (B.resample_linear(notes, SIZE, RATE, 8000, make_samples=Tones(), sums=True), B.resample_linear(blocks, SIZE, RATE, 8000))]:
        assert [tuple(round(v, 5) for v in r) for r in rows(sums(found))] == [tuple(round(v, 5) for v in r) for r in rows(sums(told(wanted)))]
