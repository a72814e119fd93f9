"""What a browser tells of a capture: its device's settings, its level, its spectrum; and small parts of takes read strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clamp, finite

TARGET_HZ = 48_000
#: Bands of the acoustic field in Hz.
BANDS = {"ambience": (40, 8000), "bass": (40, 180), "presence": (300, 3400), "air": (3400, 10_000)}
#: Fixed value: the schema of a take's media record.
MEDIA = "voice.media.v1"


def acoustic_field(spectrum: Column, rate: Column, fft_size: Column) -> Column:
    """Mean energy of each band of a spectrum of bytes, each to the power of 0.7; all 0 where there is no spectrum or no rate."""
    hz, n = rate / F.nullif(fft_size, F.lit(0)), F.size(spectrum)

    def band(low: int, high: int) -> Column:
        start = F.greatest(F.lit(0), F.ceil(low / hz))
        end = F.least(n, F.floor(high / hz) + 1)
        total = F.aggregate(F.slice(spectrum, (start + 1).cast("int"), (end - start).cast("int")), F.lit(0.0), lambda s, v: s + v)
        return F.when(end > start, F.least(F.lit(1.0), F.pow(F.greatest(F.lit(0.0), total / (end - start) / 255), F.lit(0.7)))).otherwise(0.0)

    usable = F.coalesce((n > 0) & (rate > 0) & (fft_size > 0), F.lit(False))
    return F.struct(*(F.when(usable, band(*b)).otherwise(0.0).alias(name) for name, b in BANDS.items()))


def level(samples: Column) -> Column:
    """The height of a level meter, 0 to 1: of the mean level or, a little lower, of the highest sample; what is not finite counts as silence."""
    x = F.transform(samples, lambda v: F.coalesce(finite(v.cast("double")), F.lit(0.0)))
    mean = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.greatest(F.size(x), F.lit(1)))
    peak = F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))
    db = lambda v: 20 * F.log10(F.greatest(v, F.lit(1e-6)))
    return clamp(F.greatest((db(mean) + 60) / 45, (db(peak) + 36) / 36 * 0.78), 0.0, 1.0)


SETTINGS = ("echoCancellation", "noiseSuppression", "voiceIsolation")


def boolean(settings: Column, name: str) -> Column:
    """A setting that is true or false; a text, a number or nothing is null."""
    raw = F.get_json_object(settings, f"$.{name}")
    typed = F.from_json(settings, f"`{name}` boolean", {"mode": "PERMISSIVE"})[name]
    return F.when(raw.isin("true", "false"), typed)


def microphone_processing(settings: Column) -> Column:
    return F.struct(*(boolean(settings, n).alias(n) for n in SETTINGS))


def capture_provenance(settings: Column, label: Column, source_hz: Column) -> Column:
    """What is known of a capture from its track's settings (JSON) and label: what is of another kind, or blank, is null."""
    numbers = F.from_json(settings, "channelCount double, sampleRate double, groupId string, deviceId string", {"mode": "PERMISSIVE"})
    text = lambda x: F.when(F.length(F.trim(x)) > 0, x)
    return F.struct(
        F.lit("voice.capture_provenance.v1").alias("schemaVersion"), finite(numbers["channelCount"]).alias("channels"), finite(numbers["sampleRate"]).alias("captured_hz"), text(numbers["groupId"]).alias("group_id"), text(numbers["deviceId"]).alias("device_id"),
        text(label).alias("label"), boolean(settings, "autoGainControl").alias("autoGainControl"), microphone_processing(settings).alias("processing"), source_hz.alias("source_hz"), (source_hz != TARGET_HZ).alias("resampled"),
    )


def read_media(schema_version: Column, media: Column) -> Column:
    """A take's media record, if it is of the schema that is known."""
    return F.when(schema_version == MEDIA, media)


def with_budget(strategy: Column, budget: Column) -> Column:
    """An analysis' strategy with its ``runtime``; without a strategy there is nothing to add it to."""
    return F.when(strategy.isNotNull(), strategy.withField("runtime", budget))
