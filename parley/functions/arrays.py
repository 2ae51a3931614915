"""Vector and signal functions over array columns, folded in double precision inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PCM_SCALE = 32768.0
PCM_MAX, PCM_MIN = 32767, -32768


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and ones without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / F.nullif(norms, F.lit(0.0))).otherwise(F.lit(0.0))


def scaled(values: Column, factor: Column | float) -> Column:
    by = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return F.transform(values, lambda x: x * by)


def weighted_centroid(old: Column, old_count: Column, new: Column, added: Column) -> Column:
    """(old * n + new * k) / (n + k), where k is at least 1."""
    k = F.greatest(added, F.lit(1))
    return F.zip_with(old, new, lambda a, b: (a * old_count + b * k) / (old_count + k))


def rms(values: Column) -> Column:
    """Root mean square, 0 if empty."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(values) > 0, F.sqrt(squares / F.size(values))).otherwise(F.lit(0.0))


def from_pcm(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / F.lit(PCM_SCALE))


def to_pcm(values: Column) -> Column:
    """Clamped to [-1, 1], scaled and cut off towards 0."""
    return F.transform(values, lambda x: (F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * PCM_MAX).cast("int"))


def finite(values: Column) -> Column:
    """NaN and infinities as 0."""
    return F.transform(values, lambda x: F.when(F.isnan(x) | (F.abs(x) == math.inf), F.lit(0.0)).otherwise(x))


def mixed(a: Column, b: Column) -> Column:
    """Sum of two 16-bit signals of one length, clipped."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.least(x.cast("int") + y.cast("int"), F.lit(PCM_MAX)), F.lit(PCM_MIN)))


def downmixed(samples: Column, channels: int) -> Column:
    """Average of each frame's channels; an incomplete last frame is left out."""
    frames = F.floor(F.size(samples) / channels).cast("int")

    def frame(i: Column) -> Column:
        return sum((F.element_at(samples, i * channels + c + 1) for c in range(1, channels)), F.element_at(samples, i * channels + 1)) / float(channels)

    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), frame)).otherwise(F.array().cast("array<double>"))


def channel(samples: Column, number: int, channels: int) -> Column:
    return F.filter(samples, lambda x, i: i % channels == number)


def resampled(samples: Column, from_rate: int, to_rate: int) -> Column:
    """Linear interpolation; ceil(n * to / from) values. Whole numbers decide the places, so there is no drift."""
    n = F.size(samples)
    out = F.ceil(n * F.lit(to_rate) / F.lit(from_rate)).cast("int")

    def value(i: Column) -> Column:
        place = i.cast("long") * from_rate
        left = F.floor(place / to_rate).cast("int")
        share = (place % to_rate) / F.lit(float(to_rate))
        a = F.element_at(samples, F.least(left + 1, n)).cast("double")
        b = F.element_at(samples, F.least(left + 2, n)).cast("double")
        return a + (b - a) * share

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), out - 1), value)).otherwise(F.array().cast("array<double>"))


def decimated(samples: Column, from_rate: int, to_rate: int) -> Column:
    """The sample at or before each place of the slower rate; rates that aren't positive count as 48,000."""
    rate = from_rate if from_rate > 0 else 48_000
    n = F.size(samples)
    count = F.ceil(n.cast("long") * to_rate / F.lit(rate)).cast("int")
    picked = F.transform(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")), lambda i: F.element_at(samples, (F.floor(i * rate / to_rate) + 1).cast("int")))
    return F.when(n > 0, picked).otherwise(samples)


def emphasised(samples: Column, share: float = 0.97) -> Column:
    """Each sample less a share of the one before; the first as it is."""
    return F.transform(samples, lambda x, i: F.when(i == 0, x).otherwise(x - share * F.element_at(samples, F.greatest(i, F.lit(1)))))


def shifted(values: Column, by: int) -> Column:
    """Later by ``by`` places (earlier if negative), zeros moving in."""
    n = F.size(values)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i - by >= 1) & (i - by <= n), F.element_at(values, F.greatest(F.least(i - by, n), F.lit(1)))).otherwise(F.lit(0)))).otherwise(values)


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
    return u * u * (3 - 2 * u)


def gain_of_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def argmax(values: Column) -> Column:
    """0-based index of the first largest value; null if empty."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def hz_to_mel(hz: Column) -> Column:
    """Slaney scale: linear to 1000 Hz, logarithmic above."""
    return F.when(hz < 1000, hz * 3 / 200).otherwise(15 + F.log(F.greatest(hz, F.lit(1000.0)) / 1000) * 27 / math.log(6.4))


def mel_to_hz(mel: Column) -> Column:
    return F.when(mel < 15, mel * 200 / 3).otherwise(1000 * F.exp((mel - 15) * math.log(6.4) / 27))
