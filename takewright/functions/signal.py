"""Kernels over PCM arrays: levels, pitch, loudness, resampling, filters, separation, WAV."""

from __future__ import annotations

import struct

import numpy as np


def clean(x: np.ndarray) -> np.ndarray:
    """Samples as doubles; what is not finite counts as silence."""
    x = np.asarray(x, np.float64)
    return np.where(np.isfinite(x), x, 0.0)


def js_round(x: float, digits: int = 0) -> float:
    return float(np.floor(x * 10**digits + 0.5) / 10**digits)


def dbfs(x: float) -> float:
    return js_round(20 * np.log10(max(abs(x), 1.5849e-5)), 1)


def frame_rms(x: np.ndarray, size: int = 2048, hop: int = 1024) -> np.ndarray:
    """Root mean square of each frame; those at the end are shorter."""
    sums = np.r_[0.0, np.cumsum(clean(x) ** 2)]
    starts = np.arange(0, max(1, len(x)), hop)
    ends = np.minimum(starts + size, len(x))
    return np.sqrt(np.maximum(sums[ends] - sums[starts], 0) / np.maximum(ends - starts, 1))


def true_peak(x: np.ndarray) -> float:
    """Highest of the samples and of three points between each two, by cubic interpolation."""
    x = clean(x)
    if not len(x):
        return 0.0
    p = np.pad(x, (1, 2), "edge")
    a, b, c, d = p[:-3], p[1:-2], p[2:-1], p[3:]
    most = np.abs(x).max()
    for t in (0.25, 0.5, 0.75):
        y = 0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t**2 + (3 * b - a - 3 * c + d) * t**3)
        most = max(most, np.abs(y).max())
    return float(most)


def biquad(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
    """Direct form I, with output kept as 32-bit floats."""
    out, x1, x2, y1, y2 = np.empty(len(x), np.float32), 0.0, 0.0, 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        y = float(np.float32(b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2))
        x1, x2, y1, y2 = v, x1, y, y1
        out[i] = y
    return out


#: The two stages of K-weighting at 48 kHz.
SHELF = (1.53512485958697, -2.69169618940638, 1.19839281085285), (-1.69065929318241, 0.73248077421585)
HIGH_PASS = (1.0, -2.0, 1.0), (-1.99004745483398, 0.99007225036621)


def lufs(x: np.ndarray, rate: int) -> float:
    """Gated loudness of 400 ms blocks at 48 kHz; at other rates the level of the whole."""
    x = clean(x)
    if not len(x):
        return -96.0
    if rate != 48000:
        return js_round(max(-96.0, 20 * np.log10(max(np.sqrt(np.mean(x**2)), 1.5849e-5)) - 0.691), 1)
    y = biquad(biquad(x, *SHELF), *HIGH_PASS).astype(np.float64)
    size, hop = 19200, 4800
    sums = np.r_[0.0, np.cumsum(y**2)]
    starts = np.arange(0, max(1, len(y) - size + 1), hop)
    power = (sums[np.minimum(starts + size, len(y))] - sums[starts]) / np.minimum(size, len(y))
    level = -0.691 + 10 * np.log10(np.maximum(power, 1e-12))
    kept = power[level > -70]
    if not len(kept):
        return -96.0
    gate = -0.691 + 10 * np.log10(kept.mean()) - 10
    kept = power[(level > -70) & (level > gate)]
    return js_round(float(-0.691 + 10 * np.log10(kept.mean())), 1) if len(kept) else -96.0


def pitch_hz(frame: np.ndarray, rate: int) -> float | None:
    """Fundamental of a frame between 70 and 350 Hz by normalised autocorrelation of a decimated, windowed copy; null below 0.35."""
    x = clean(frame)
    x = x[: len(x) // 4 * 4].reshape(-1, 4).mean(axis=1)
    rate /= 4
    if len(x) < 32:
        return None
    x = (x - x.mean()) * np.hanning(len(x))
    energy = float(x @ x)
    low, high = int(rate // 350), min(int(np.ceil(rate / 70)), len(x) - 2)
    if energy <= 1e-9 or high <= low + 1:
        return None
    full = np.correlate(x, x, "full")[len(x) - 1 :]
    lags = np.arange(low, high + 1)
    heads, tails = np.cumsum(x**2), np.cumsum(x[::-1] ** 2)
    norm = np.sqrt(heads[len(x) - 1 - lags] * tails[len(x) - 1 - lags])
    r = full[lags] / np.maximum(norm, 1e-12)
    best = int(r.argmax())
    if r[best] < 0.35:
        return None
    shift = 0.0
    if 0 < best < len(r) - 1:
        bend = r[best - 1] - 2 * r[best] + r[best + 1]
        shift = 0.5 * (r[best - 1] - r[best + 1]) / bend if abs(bend) > 1e-12 else 0.0
    return float(rate / (lags[best] + shift))


def pitches_hz(frames: np.ndarray, rate: int) -> np.ndarray:
    """``pitch_hz`` of frames (row, place) of one length, not-a-number for null; only the lags that are looked at are correlated."""
    x = clean(frames)
    n, rate, rows = x.shape[1] // 4, rate / 4, np.arange(len(x))
    none = np.full(len(x), np.nan)
    low, high = int(rate // 350), min(int(np.ceil(rate / 70)), n - 2)
    if n < 32 or high <= low + 1:
        return none
    x = x[:, : n * 4].reshape(len(x), n, 4).mean(axis=2)
    x = (x - x.mean(axis=1, keepdims=True)) * np.hanning(n)
    lags, squares = np.arange(low, high + 1), x**2
    full = np.stack([np.einsum("ij,ij->i", x[:, : n - lag], x[:, lag:]) for lag in lags.tolist()], axis=1)
    heads, tails = np.cumsum(squares, axis=1), np.cumsum(squares[:, ::-1], axis=1)
    r = full / np.maximum(np.sqrt(heads[:, n - 1 - lags] * tails[:, n - 1 - lags]), 1e-12)
    best = r.argmax(axis=1)
    top, inner = r[rows, best], (best > 0) & (best < len(lags) - 1)
    before, after = r[rows, np.maximum(best - 1, 0)], r[rows, np.minimum(best + 1, len(lags) - 1)]
    bend = before - 2 * top + after
    bent = inner & (np.abs(bend) > 1e-12)
    shift = np.where(bent, 0.5 * (before - after) / np.where(bent, bend, 1), 0.0)
    return np.where((np.einsum("ij,ij->i", x, x) > 1e-9) & (top >= 0.35), rate / (lags[best] + shift), none)


def prosody(x: np.ndarray, rate: int) -> dict:
    """Pitch of voiced frames: share, mean, range and deviation in semitones."""
    x, voiced, frames = clean(x), [], 0
    for at in range(0, len(x), 2048):
        frame = x[at : at + 2048]
        if len(frame) < 512 or 20 * np.log10(max(np.sqrt(np.mean(frame**2)), 1.5849e-5)) < -45:
            continue
        frames += 1
        if (f := pitch_hz(frame, rate)) is not None:
            voiced.append(f)
    tones = 12 * np.log2(np.array(voiced) / 100) if voiced else np.zeros(0)
    return {"voiced_ratio": js_round(len(voiced) / frames, 3) if frames else 0.0, "pitch_hz": js_round(float(np.mean(voiced)), 1) if voiced else None, "range": js_round(float(np.ptp(tones)), 2) if len(tones) else 0.0, "deviation": js_round(float(tones.std()), 2) if len(tones) > 1 else 0.0}


def transients(x: np.ndarray, rate: int) -> tuple[float, float]:
    """Shares of audible frames with plosives and with mouth noise: sudden ones, mostly below, or mostly above 250 Hz."""
    x = clean(x)
    size, hop = max(1, round(rate * 0.02)), max(1, round(rate * 0.01))
    keep, state, last = np.exp(-2 * np.pi * 250 / rate), 0.0, -96.0
    audible = plosive = mouth = 0
    for at in range(0, len(x), hop):
        frame = x[at : at + size]
        low = np.empty(len(frame))
        for i, v in enumerate(frame.tolist()):  # the filter keeps its state although frames overlap
            low[i] = state = (1 - keep) * v + keep * state
        power = float(frame @ frame)
        level = dbfs(np.sqrt(power / len(frame)))
        deep, high = float(low @ low) / max(power, 1e-7), float((frame - low) @ (frame - low)) / max(power, 1e-7)
        if level >= -45:
            audible += 1
            plosive += level >= -35 and deep >= 0.52 and level - last >= 3
            mouth += level >= -40 and high >= 0.62 and level - last >= 4
        last = level
    return js_round(plosive / max(1, audible), 3), js_round(mouth / max(1, audible), 3)


def tail(x: np.ndarray, rate: int) -> float:
    x = clean(x)
    if len(x) < rate:
        return 0.0
    return js_round(float(np.clip(np.sqrt(np.mean(x[-int(0.35 * rate) :] ** 2)) / 0.08, 0, 1)), 3)


def analyze(x: np.ndarray, rate: int) -> dict:
    """The master kernel: levels, activity, prosody and defects of a recording."""
    raw, x = np.asarray(x, np.float64), clean(x)
    frames = np.array([dbfs(v) for v in frame_rms(x)]) if len(x) else np.array([-96.0])
    floor = float(np.sort(frames)[min(len(frames) - 1, int(len(frames) * 0.1))])
    rms, peak = (dbfs(np.sqrt(np.mean(x**2))), dbfs(np.abs(x).max())) if len(x) else (-96.0, -96.0)
    threshold = float(np.clip(js_round(floor + 12, 1), -45, -24))
    plosive, mouth = transients(x, rate)
    return {
        "samples": len(x), "duration_ms": int(js_round(len(x) / rate * 1000)), "peak_dbfs": peak, "true_peak_dbfs": dbfs(true_peak(x)), "rms_dbfs": rms, "lufs": lufs(x, rate), "floor_dbfs": floor,
        "snr_db": float(np.clip(js_round(rms - floor, 1), 0, 96)), "dc": js_round(float(x.mean()), 5) if len(x) else 0.0, "clipping": bool((np.abs(raw) >= 0.999).sum() > max(2, 5e-5 * len(x))),
        "active_ratio": js_round(float((frames >= threshold).mean()), 3), "silence_ratio": js_round(float((frames < -55).mean()), 3), "energy_deviation": js_round(float(frames.std()), 2) if len(frames) > 1 else 0.0,
        "plosive": plosive, "mouth": mouth, "reverb": tail(x, rate), **prosody(x, rate),
    }


def resample_linear(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """End points stay end points."""
    x = clean(x)
    n = max(1, int(js_round(len(x) * to / rate)))
    return x.copy() if rate == to or len(x) < 2 else np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


def resample(x: np.ndarray, rate: int, to: int, radius: int = 16) -> np.ndarray:
    """Windowed-sinc resampling, band-limited when going down."""
    x = clean(x)
    if rate == to or not len(x):
        return x.copy()
    ratio = to / rate
    cutoff, n = 0.94 * min(1.0, ratio), max(1, int(js_round(len(x) * ratio)))
    at = np.arange(n) / ratio
    near = np.floor(at).astype(int)[:, None] + np.arange(1 - radius, radius + 1)
    gap = at[:, None] - near
    taps = cutoff * np.sinc(cutoff * gap) * np.where(np.abs(gap) < radius, 0.5 + 0.5 * np.cos(np.pi * gap / radius), 0)
    inside = (near >= 0) & (near < len(x))
    taps = np.where(inside, taps, 0)
    return (taps * x[np.clip(near, 0, len(x) - 1)]).sum(axis=1) / np.maximum(np.abs(taps.sum(axis=1)), 1e-9)


def vocal_band(x: np.ndarray, rate: int) -> np.ndarray:
    """One-pole high pass at 105 Hz and low pass at 7.2 kHz, attacks held down, at most 5 times louder up to 0.9."""
    x = clean(x)
    hp, lp = np.exp(-2 * np.pi * 105 / rate), 1 - np.exp(-2 * np.pi * 7200 / rate)
    fast, slow = 1 - np.exp(-1 / (0.004 * rate)), 1 - np.exp(-1 / (0.08 * rate))
    out, last, h, low, a, b = np.empty(len(x)), 0.0, 0.0, 0.0, 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        h = hp * (h + v - last)
        last = v
        low += lp * (h - low)
        a += fast * (abs(low) - a)
        b += slow * (abs(low) - b)
        out[i] = low * (1.0 if a <= 2.4 * b + 1e-4 else max(0.35, (2.4 * b + 1e-4) / a))
    most = np.abs(out).max(initial=0)
    return out * min(5.0, 0.9 / most) if most > 1e-6 else out


def stereo_focus(left: np.ndarray, right: np.ndarray, rate: int) -> np.ndarray:
    left, right = clean(left), clean(right)
    mid, side = (left + right) / 2, (left - right) / 2
    return vocal_band(np.sign(mid) * np.maximum(0, np.abs(mid) - 0.58 * np.abs(side)), rate)


def band_weight(hz: np.ndarray, rate: int) -> np.ndarray:
    top = 0.49 * rate
    return np.clip(np.minimum((hz - 70) / 60, (top - hz) / max(1.0, top - 6800)), 0, 1)


def separate(left: np.ndarray, right: np.ndarray, rate: int, size: int = 512, hop: int = 128) -> np.ndarray:
    """Vocals by a mask in the short-time spectrum: what is in the middle, in the voice's band and above an adaptive floor."""
    left, right = clean(left), clean(right)
    window = np.sqrt(np.hanning(size))
    n = max(1, -(-len(left) // hop)) + size // hop
    pad = np.zeros(n * hop + size)
    l, r = pad.copy(), pad.copy()
    l[size : size + len(left)], r[size : size + len(right)] = left, right
    at = np.arange(n)[:, None] * hop + np.arange(size)
    a, b = np.fft.rfft(l[at] * window), np.fft.rfft(r[at] * window)
    mid, side = (a + b) / 2, (a - b) / 2
    strength = np.abs(mid)
    floor = np.quantile(strength, 0.2, axis=0)
    mask = strength**2 / (strength**2 + np.abs(side) ** 2 + (1.5 * floor) ** 2 + 1e-12) * band_weight(np.fft.rfftfreq(size, 1 / rate), rate)
    frames = np.fft.irfft(mid * mask, size) * window
    out, norm = np.zeros(len(pad)), np.zeros(len(pad))
    np.add.at(out, at, frames)
    np.add.at(norm, at, np.broadcast_to(window**2, frames.shape))
    return (out / np.maximum(norm, 1e-6))[size : size + len(left)]


def mask_activity(x: np.ndarray, rate: int, segments: list[tuple[int, int]], fade_ms: int = 36) -> np.ndarray:
    """Silence outside segments, with fades; unchanged where they cover almost nothing or almost all."""
    x, keep = clean(x), np.zeros(len(x))
    for s, e in segments:
        keep[int(s * rate / 1000) : int(e * rate / 1000)] = 1
    share = keep.mean() if len(x) else 0
    if share < 0.04 or share > 0.94:
        return x
    n = max(1, int(fade_ms * rate / 1000))
    return x * np.minimum(1, np.convolve(keep, np.ones(n) / n, "same"))


def difference(x: np.ndarray, y: np.ndarray) -> float:
    """1 - correlation squared, of at most 4096 strided samples."""
    n = min(len(x), len(y))
    step = max(1, n // 4096)
    x, y = clean(x[:n:step]), clean(y[:n:step])
    power = float((x @ x) * (y @ y))
    return js_round(1 - float(x @ y) ** 2 / power, 4) if power > 0 else 0.0


def fade_edges(x: np.ndarray, n: int) -> np.ndarray:
    x = clean(x)
    n = min(n, len(x) // 2)
    if n:
        ramp = np.arange(n) / n
        x[:n] *= ramp
        x[-n:] *= ramp[::-1]
    return x


def encode_wav24(x: np.ndarray, rate: int) -> bytes:
    """Mono RIFF file of 24-bit samples."""
    x = np.clip(clean(x), -1, 1)
    whole = np.floor(np.where(x < 0, x * 2**23, x * (2**23 - 1)) + 0.5).astype("<i4")
    data = np.ascontiguousarray(whole).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    pad = b"\0" * (len(data) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 3, 3, 24, b"data", len(data))
    return head + data + pad


def validate_wav(content: bytes | None) -> dict:
    """What a PCM WAV file declares, or the error that makes it invalid."""
    out = {"rate": None, "channels": None, "depth": None, "duration_ms": None, "error": None}
    try:
        if content is None or len(content) < 44 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
            raise ValueError("not a RIFF WAVE file")
        if struct.unpack_from("<I", content, 4)[0] != len(content) - 8:
            raise ValueError("RIFF size differs")
        at, form, size = 12, None, None
        while at + 8 <= len(content):
            kind, n = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
            if at + 8 + n > len(content):
                raise ValueError("chunk beyond the end")
            if kind == b"fmt " and n >= 16:
                form = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind == b"data" and size is None:
                size = n
            at += 8 + n + n % 2
        if form is None or size is None:
            raise ValueError("fmt or data chunk missing")
        code, channels, rate, _, align, depth = form
        if code != 1 or not channels or not rate or align != channels * depth // 8 or size % align:
            raise ValueError("not aligned PCM")
        out |= {"rate": rate, "channels": channels, "depth": depth, "duration_ms": int(js_round(size / align / rate * 1000))}
    except (ValueError, struct.error) as problem:
        out["error"] = str(problem)
    return out


def decode_wav(content: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (channel, place) and rate of a PCM WAV file of 8, 16, 24 or 32 bits; what is not valid raises an error that says why."""
    told = validate_wav(content)
    if told["error"] or told["depth"] not in (8, 16, 24, 32):
        raise ValueError(told["error"] or f"{told['depth']} bits a sample")
    at = 12
    while content[at : at + 4] != b"data":
        n = struct.unpack_from("<I", content, at + 4)[0]
        at += 8 + n + n % 2
    raw = np.frombuffer(content, np.uint8, struct.unpack_from("<I", content, at + 4)[0], at + 8).reshape(-1, told["depth"] // 8)
    if told["depth"] == 8:
        whole = raw[:, 0].astype(np.float64) - 128
    else:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - raw.shape[1] :] = raw
        whole = wide.reshape(-1).view("<i4").astype(np.float64) / 2 ** (32 - told["depth"])
    return (whole / 2 ** (told["depth"] - 1)).reshape(-1, told["channels"]).T, told["rate"]


ANALYSIS_RATE = 16_000
MOST_SPECTRAL_S = 5 * 60


def analysis_signals(content: bytes | None) -> dict:
    """A recording as it is analysed: at 16 kHz, the first two channels as ``left`` and ``right`` (none: null), their mean as ``mono``, and the voice that
    lies between them as ``focus``.  Separation is for recordings of five minutes at most."""
    channels, rate = decode_wav(content)
    left, *others = (resample(c, rate, ANALYSIS_RATE) for c in channels[:2])
    right = others[0] if others else None
    mono = left if right is None else (left + right) / 2
    focus = vocal_band(left, ANALYSIS_RATE) if right is None else stereo_focus(left, right, ANALYSIS_RATE)
    return {"mono": mono, "focus": focus, "left": left, "right": right, "spectral": len(left) <= MOST_SPECTRAL_S * ANALYSIS_RATE, "rate": ANALYSIS_RATE}


def processed_voice(content: bytes | None) -> dict:
    """The voice of a recording as a WAV file of 16 kHz and 24 bits, and by which method: separated in the spectrum, or where the recording is too long for that or
    separation leaves nothing that is finite, the focus in the voice's band.  A recording that cannot be decoded has an error and no file."""
    try:
        x = analysis_signals(content)
    except ValueError as problem:
        return {"content": None, "method": None, "error": str(problem)}
    out, method = x["focus"], "vocal_band_transient_reduction"
    if x["spectral"] and len(x["left"]):
        parted = separate(x["left"], x["left"] if x["right"] is None else x["right"], ANALYSIS_RATE)
        if np.isfinite(parted).all():
            out, method = parted, "spectral_mid_side_residual_vocal_band"
    return {"content": encode_wav24(out, ANALYSIS_RATE), "method": method, "error": None}
