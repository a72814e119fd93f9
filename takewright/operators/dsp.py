"""Signal kernels over array columns, in Arrow batches: one row a recording, never a row a sample."""

from __future__ import annotations

import pandas as pd

from ..functions import signal as S
from ..functions.arrow import pandas_udf

METRICS = "samples bigint, duration_ms bigint, peak_dbfs double, true_peak_dbfs double, rms_dbfs double, lufs double, floor_dbfs double, snr_db double, dc double, clipping boolean, active_ratio double, silence_ratio double, energy_deviation double, plosive double, mouth double, reverb double, voiced_ratio double, pitch_hz double, range double, deviation double"


def _array(x) -> list:
    return [] if x is None else x


@pandas_udf(METRICS)
def analyze(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([S.analyze(_array(x), int(r)) for x, r in zip(samples, rate, strict=True)])


@pandas_udf("array<double>")
def frame_levels(samples: pd.Series) -> pd.Series:
    return pd.Series([[S.dbfs(v) for v in S.frame_rms(_array(x))] for x in samples])


@pandas_udf("array<double>")
def resample(samples: pd.Series, rate: pd.Series, to: pd.Series) -> pd.Series:
    return pd.Series([S.resample(_array(x), int(r), int(t)) for x, r, t in zip(samples, rate, to, strict=True)])


@pandas_udf("array<double>")
def resample_linear(samples: pd.Series, rate: pd.Series, to: pd.Series) -> pd.Series:
    return pd.Series([S.resample_linear(_array(x), int(r), int(t)) for x, r, t in zip(samples, rate, to, strict=True)])


@pandas_udf("array<double>")
def vocal_band(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([S.vocal_band(_array(x), int(r)) for x, r in zip(samples, rate, strict=True)])


@pandas_udf("array<double>")
def stereo_focus(left: pd.Series, right: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([S.stereo_focus(_array(a), _array(b), int(r)) for a, b, r in zip(left, right, rate, strict=True)])


@pandas_udf("array<double>")
def separate(left: pd.Series, right: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([S.separate(_array(a), _array(b), int(r)) for a, b, r in zip(left, right, rate, strict=True)])


@pandas_udf("array<double>")
def fade_edges(samples: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([S.fade_edges(_array(x), int(k)) for x, k in zip(samples, n, strict=True)])


@pandas_udf("double")
def difference(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([S.difference(_array(a), _array(b)) for a, b in zip(x, y, strict=True)], dtype="float64")


@pandas_udf("double")
def loudness(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([S.lufs(_array(x), int(r)) for x, r in zip(samples, rate, strict=True)], dtype="float64")


@pandas_udf("binary")
def encode_wav24(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([S.encode_wav24(_array(x), int(r)) for x, r in zip(samples, rate, strict=True)])


@pandas_udf("rate int, channels int, depth int, duration_ms bigint, error string")
def validate_wav(content: pd.Series) -> pd.DataFrame:
    rows = [S.validate_wav(None if c is None else bytes(c)) for c in content]
    whole = {k: pd.array([r[k] for r in rows], dtype="Int64") for k in ("rate", "channels", "depth", "duration_ms")}
    return pd.DataFrame({**whole, "error": [r["error"] for r in rows]})


@pandas_udf("content binary, method string, error string")
def processed_voice(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([S.processed_voice(None if c is None else bytes(c)) for c in content], columns=["content", "method", "error"])


@pandas_udf("mono array<double>, focus array<double>, stereo boolean, spectral boolean, error string")
def analysis_signals(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        try:
            x = S.analysis_signals(None if c is None else bytes(c))
            rows.append((x["mono"], x["focus"], x["right"] is not None, x["spectral"], None))
        except ValueError as problem:
            rows.append((None, None, None, None, str(problem)))
    return pd.DataFrame(rows, columns=["mono", "focus", "stereo", "spectral", "error"])
