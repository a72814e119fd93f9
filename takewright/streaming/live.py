"""Live operators: folds of ordered events that run alike in batches and as stateful streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.sequences import merge_transcripts


def clip(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


class SpeechActivity:
    """Live speech detection over levels: attack 48 ms, release 260 ms, 4 dB of hysteresis, a noise floor that falls fast and rises
    slowly.  A state is a plain dict, so that it can be kept between batches of a stream."""

    @staticmethod
    def start(floor: float | None = None) -> dict:
        return {"floor": clip(-60.0 if floor is None else floor, -78, -28), "active": False, "attack": 0.0, "heard": 0.0, "now": 0.0}

    @staticmethod
    def level(samples: np.ndarray) -> float:
        x = np.nan_to_num(np.asarray(samples, float), nan=0.0, posinf=0.0, neginf=0.0)
        if not len(x):
            return -96.0
        rms, peak = np.sqrt(np.mean(x**2)), np.abs(x).max()
        db = lambda v: 20 * np.log10(max(v, 1.5849e-5))
        return float(max(-96.0, db(rms), db(peak) - 13))

    @staticmethod
    def step(state: dict, level: float, ms: float) -> dict:
        threshold = clip(state["floor"] + 10, -50, -27)
        s = dict(state)
        s["now"] += ms
        if s["active"]:
            if level >= threshold - 4:
                s["heard"] = s["now"]
            elif s["now"] - s["heard"] >= 260:
                s["active"], s["attack"] = False, 0.0
        elif level >= threshold:
            s["attack"] += ms
            if s["attack"] >= 48:
                s["active"], s["attack"], s["heard"] = True, 0.0, s["now"]
        else:
            s["attack"] = 0.0
            if level < threshold - 2:  # only what can be background moves the floor
                rate = 0.008 if level > s["floor"] else 0.035
                s["floor"] = clip(s["floor"] + rate * (level - s["floor"]), -78, -28)
        return s


class RuntimeProfile:
    """Exponentially weighted real-time factors with counts; invalid observations change nothing."""

    @staticmethod
    def start() -> dict:
        return {"transcription": None, "separation": None, "n_transcription": 0, "n_separation": 0}

    @staticmethod
    def step(state: dict, kind: str, elapsed: float, duration: float) -> dict:
        if kind not in ("transcription", "separation") or not (np.isfinite(elapsed) and np.isfinite(duration) and elapsed > 0 and duration > 0):
            return state
        factor, old = min(20.0, elapsed / duration), state[kind]
        new = factor if old is None else old + 0.35 * (factor - old)
        return state | {kind: float(np.floor(new * 1000 + 0.5) / 1000), "n_" + kind: state["n_" + kind] + 1}


class Hypotheses:
    """A recogniser's hypotheses by (result, alternative).

    An event tells all results from ``offset`` on, each as (final, [(text, confidence), …]): what is held of these is replaced, what is held below
    the offset stays.  A hypothesis that was final and is so again keeps its first time; blank texts are none, and a confidence below 0 or not finite is unknown.
    """

    @staticmethod
    def start() -> dict:
        return {}

    @staticmethod
    def step(state: dict, offset: int, results: list, at: float) -> dict:
        held = {k: v for k, v in state.items() if int(k.split(":")[0]) < offset}
        for i, (final, alternatives) in enumerate(results):
            for j, (text, confidence) in enumerate(alternatives):
                if not text or not text.strip():
                    continue
                key = f"{offset + i}:{j}"
                old = state.get(key)
                known = confidence is not None and np.isfinite(confidence) and confidence >= 0
                held[key] = {"text": text.strip(), "confidence": float(confidence) if known else None, "final": bool(final), "at": old["at"] if old and old["final"] and final else at}
        return held


class Session:
    """A recognition session: the text committed so far and the current one; a commit appends the current final text, less what both share."""

    @staticmethod
    def start() -> dict:
        return {"committed": "", "display": "", "final": ""}

    @staticmethod
    def step(state: dict, display: str, final: str, commits: bool) -> dict:
        if commits:
            return {"committed": merge_transcripts(state["committed"], final), "display": "", "final": ""}
        return state | {"display": display, "final": final}

    @staticmethod
    def texts(state: dict) -> tuple[str, str]:
        """What is shown, and what is final."""
        return merge_transcripts(state["committed"], state["display"]), merge_transcripts(state["committed"], state["final"])


class Recognition:
    """Hypotheses of a recogniser by (result, alternative): events replace what they repeat; a final one keeps its first time."""

    @staticmethod
    def start() -> dict:
        return {}

    @staticmethod
    def step(state: dict, result: int, alternative: int, text: str, confidence: float | None, final: bool, at: float) -> dict:
        key = f"{result}:{alternative}"
        old = state.get(key)
        at = old["at"] if old and old["final"] and final else at
        return state | {key: {"text": text, "confidence": confidence, "final": bool(final), "at": at}}

    @staticmethod
    def transcript(state: dict, final: bool = True) -> str:
        keys = sorted((k for k in state if k.endswith(":0") and state[k]["final"] == final), key=lambda k: int(k.split(":")[0]))
        return " ".join(state[k]["text"].strip() for k in keys if state[k]["text"].strip())


def endpoint_ready(confirmed_ms: float | None, now_ms: float, active: bool, quiet_ms: float, expressive: bool = False) -> bool:
    """Whether a capture whose end was confirmed may stop: never before it has settled; then once it has been silent for as long, or at last when the fail-safe has passed."""
    if confirmed_ms is None:
        return False
    settle, failsafe = (640, 1900) if expressive else (520, 1550)
    since = max(0.0, now_ms - confirmed_ms)
    return since >= settle and ((not active and quiet_ms >= settle) or since >= failsafe)


def frame_pace(state: dict | None, gap_ms: float) -> dict:
    """Smoothed frame gaps; slow above 1000/36 ms until below 1000/50, pauses of over 250 ms ignored."""
    s = dict(state or {"mean": 1000 / 60, "slow": False})
    if 0 < gap_ms <= 250:
        s["mean"] += 0.12 * (gap_ms - s["mean"])
        s["slow"] = s["mean"] > 1000 / 36 or (s["slow"] and s["mean"] >= 1000 / 50)
    return s


def fold_groups(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], dict], step: Callable, show: Callable[[dict, tuple], list[tuple]], schema: str, last: bool = False) -> DataFrame:
    """Batch form: each key's rows in order through ``step``; ``show`` gives rows after each, or with ``last`` after the key's last alone.

    Rows come sorted by key, and a worker holds one state and one batch of them, however many a key has.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def table(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key, state and last row
        for batch in batches:
            out: list[tuple] = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns)), strict=True):
                if held is None or held[0] != k:
                    if held is not None and last:
                        out += [(held[0], *x) for x in show(*held[1:])]
                    held = (k, start(), ())
                held = (k, step(held[1], *row), tuple(row))
                if not last:
                    out += [(k, *x) for x in show(*held[1:])]
            yield from table(out)
        if held is not None and last:
            yield from table([(held[0], *x) for x in show(*held[1:])])

    needed = list(dict.fromkeys([key, *order, *columns]))
    return df.select(*needed).repartition(key).sortWithinPartitions(key, *order).mapInArrow(each, schema)


def fold_stream(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], dict], step: Callable, show: Callable[[dict, tuple], list[tuple]], schema: str) -> DataFrame:
    """Stream form: the same fold, its state kept as JSON between micro-batches; rows of one key come in order."""
    names = [f.split()[0] for f in schema.split(", ")][1:]

    def each(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, out = json.loads(held.get[0]) if held.exists else start(), []
        rows = pd.concat(list(frames)).sort_values(order)
        for row in rows[columns].itertuples(index=False, name=None):
            state = step(state, *row)
            out += show(state, row)
        held.update((json.dumps(state),))
        result = pd.DataFrame(out, columns=names)
        result.insert(0, key, k[0])
        yield result

    return df.groupBy(key).applyInPandasWithState(each, schema, "state string", "append", GroupStateTimeout.NoTimeout)


ACTIVITY = "media_id long, idx long, active boolean, floor double"


def activity(frames: DataFrame, ms: float = 1024 / 48, stream: bool = False) -> DataFrame:
    """Live speech activity after each frame (media_id, idx, level)."""
    step = lambda s, i, level: SpeechActivity.step(s, level, ms)
    show = lambda s, row: [(row[0], s["active"], round(s["floor"], 6))]
    fold = fold_stream if stream else fold_groups
    return fold(frames, "media_id", ["idx"], ["idx", "level"], SpeechActivity.start, step, show, ACTIVITY)


HYPOTHESES = "user_id long, result int, alternative int, text string, confidence double, final boolean, captured_at long"


def hypotheses(events: DataFrame, stream: bool = False) -> DataFrame:
    """Each user's hypotheses after the last event (user_id, event_id, offset, results), whose time is its event_id; as a stream, after each."""
    each = lambda x: [] if x is None else x
    unpacked = lambda rows: [(r["final"], [(a["transcript"], a["confidence"]) for a in each(r["alternatives"])]) for r in each(rows)]
    step = lambda s, i, offset, results: Hypotheses.step(s, offset, unpacked(results), i)
    show = lambda s, row: [(*map(int, k.split(":")), h["text"], h["confidence"], h["final"], int(h["at"])) for k, h in s.items()]
    columns = ["event_id", "offset", "results"]
    if stream:
        return fold_stream(events, "user_id", ["event_id"], columns, Hypotheses.start, step, show, HYPOTHESES)
    return fold_groups(events, "user_id", ["event_id"], columns, Hypotheses.start, step, show, HYPOTHESES, last=True)


def transcript_of(results: Column, final: bool) -> Column:
    """The first alternative with a text of each result, or of each final one, joined by a space."""
    some = F.filter(results, lambda r: r["final"]) if final else results
    spoken = F.transform(some, lambda r: F.get(F.filter(r["alternatives"], lambda a: F.trim(a["transcript"]) != ""), F.lit(0))["transcript"])
    return F.trim(F.array_join(F.filter(spoken, lambda t: t.isNotNull()), " "))


SESSION = "user_id long, display string, final string"


def sessions(updates: DataFrame, stream: bool = False) -> DataFrame:
    """Each user's texts after the last of ``updates`` (user_id, event_id, display, final, commits); as a stream, after each."""
    step = lambda s, i, display, final, commits: Session.step(s, display, final, commits)
    show = lambda s, row: [Session.texts(s)]
    columns = ["event_id", "display", "final", "commits"]
    if stream:
        return fold_stream(updates, "user_id", ["event_id"], columns, Session.start, step, show, SESSION)
    return fold_groups(updates, "user_id", ["event_id"], columns, Session.start, step, show, SESSION, last=True)


PROFILE = "user_id long, event_id long, transcription double, separation double"


def runtime_profiles(observations: DataFrame, stream: bool = False) -> DataFrame:
    """Real-time factors after each observation (user_id, event_id, kind, elapsed, duration)."""
    step = lambda s, i, kind, elapsed, duration: RuntimeProfile.step(s, kind, elapsed, duration)
    show = lambda s, row: [(row[0], s["transcription"], s["separation"])]
    fold = fold_stream if stream else fold_groups
    return fold(observations, "user_id", ["event_id"], ["event_id", "kind", "elapsed", "duration"], RuntimeProfile.start, step, show, PROFILE)


PACE = "user_id long, event_id long, mean double, slow boolean"


def frame_paces(ticks: DataFrame, stream: bool = False) -> DataFrame:
    """The pace after each frame (user_id, event_id, at): smoothed gaps in ms and whether they are slow; ``at`` is a time in ms."""

    def step(s: dict, i: int, at: float) -> dict:
        return {**frame_pace(s, at - s["at"] if s["at"] is not None else -1.0), "at": at}

    fold = fold_stream if stream else fold_groups
    return fold(ticks, "user_id", ["at", "event_id"], ["event_id", "at"], lambda: {"mean": 1000 / 60, "slow": False, "at": None}, step, lambda s, row: [(row[0], s["mean"], s["slow"])], PACE)


class Endpoint:
    """Whether a capture may stop, after each observation of (at, final, active): the end is confirmed by the first final one, and silence lasts since the last active one."""

    @staticmethod
    def start() -> dict:
        return {"confirmed": None, "quiet_from": None, "ready": False}

    @staticmethod
    def step(state: dict, at: float, final: bool, active: bool, expressive: bool) -> dict:
        confirmed = at if state["confirmed"] is None and final else state["confirmed"]
        quiet = None if active else at if state["quiet_from"] is None else state["quiet_from"]
        return {"confirmed": confirmed, "quiet_from": quiet, "ready": endpoint_ready(confirmed, at, active, 0.0 if quiet is None else at - quiet, expressive)}


ENDPOINTS = "user_id long, event_id long, ready boolean"


def endpoints(observations: DataFrame, stream: bool = False) -> DataFrame:
    """Readiness after each observation (user_id, event_id, at, final, active, expressive)."""
    step = lambda s, i, at, final, active, expressive: Endpoint.step(s, at, final, active, expressive)
    fold = fold_stream if stream else fold_groups
    return fold(observations, "user_id", ["at", "event_id"], ["event_id", "at", "final", "active", "expressive"], Endpoint.start, step, lambda s, row: [(row[0], s["ready"])], ENDPOINTS)


def count_batches(samples: DataFrame, key: str, seq: str, size: int = 1024) -> DataFrame:
    """Rows grouped by every ``size`` of a sequence number: a tumbling window of counts."""
    return samples.groupBy(key, F.floor(F.col(seq) / size).cast("long").alias("batch")).agg(F.count("*").alias("n"))
