"""Signal functions on numpy arrays, run in Arrow batches: log-mel spectrogram, coherence, lag."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

RATE = 16_000
FFT, WINDOW, HOP = 512, 400, 160
MELS = 128
EMPHASIS = 0.97
FLOOR = 2.0**-24
SEGMENT = 512
_LOG_STEP = np.log(6.4) / 27


def hz_to_mel(hz: np.ndarray) -> np.ndarray:
    """Slaney scale."""
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1000) / 1000) / _LOG_STEP)


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * _LOG_STEP))


@lru_cache(maxsize=8)
def filterbank(mels: int = MELS) -> np.ndarray:
    """Triangular filters of equal area over the FFT's bins."""
    edges = mel_to_hz(np.linspace(hz_to_mel(np.array(0.0)), hz_to_mel(np.array(RATE / 2)), mels + 2))
    bins = np.arange(FFT // 2 + 1) * RATE / FFT
    rising = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    falling = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(np.minimum(rising, falling), 0) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=1)
def window() -> np.ndarray:
    """Hann, centred in the FFT's length."""
    side = (FFT - WINDOW) // 2
    return np.pad(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / (WINDOW - 1)), (side, FFT - WINDOW - side))


def log_mel(samples: np.ndarray, mels: int = MELS) -> np.ndarray:
    """Frames by mel bands, each band normalised over the frames (sample variance); a single frame stays as it is."""
    if not len(samples):
        return np.zeros((0, mels))
    x = np.concatenate([samples[:1], samples[1:] - EMPHASIS * samples[:-1]])
    padded = np.pad(x, FFT // 2)
    count = len(samples) // HOP
    if not count:
        return np.zeros((0, mels))
    frames = padded[np.arange(count)[:, None] * HOP + np.arange(FFT)]
    power = np.abs(np.fft.rfft(frames * window(), axis=1)) ** 2
    bands = np.log(power @ filterbank(mels).T + FLOOR)
    return bands if count < 2 else (bands - bands.mean(0)) / (bands.std(0, ddof=1) + 1e-5)


def coherence(near: np.ndarray, far: np.ndarray, low_hz: float = 300, high_hz: float = 3400, segments: int = 3) -> float:
    """Mean over a band of |Sxy|^2 / (Sxx Syy), spectra averaged over half overlapping segments; 0 for short signals."""
    length = len(near) * 2 // (segments + 1)
    if length < 8 or len(near) != len(far):
        return 0.0
    begin = np.arange(segments) * (length // 2)
    shape = np.hanning(length)
    x, y = (np.fft.rfft(s[begin[:, None] + np.arange(length)] * shape, axis=1) for s in (near, far))
    hz = np.arange(x.shape[1]) * RATE / length
    band = (hz >= low_hz) & (hz <= high_hz)
    cross = np.abs((x * y.conj()).mean(0)) ** 2
    return float(np.mean((cross / ((np.abs(x) ** 2).mean(0) * (np.abs(y) ** 2).mean(0) + 1e-12))[band])) if band.any() else 0.0


def best_lag(near: np.ndarray, far: np.ndarray, most: int = 1024) -> int:
    """Shift of ``far`` with the largest normalised product; shorter signals bound it."""
    n = min(len(near), len(far))
    most = min(most, n - 1)
    norm = np.sqrt((near[:n] @ near[:n]) * (far[:n] @ far[:n]))
    best, best_score = 0, -np.inf
    for lag in range(-most, most + 1):
        a, b = (near[lag:n], far[: n - lag]) if lag >= 0 else (near[: n + lag], far[-lag:n])
        score = a @ b / norm if norm else 0.0
        if score > best_score:
            best, best_score = lag, score
    return best


# Fixed values of the reference gate: least level of the far side; level of the near side, absolute and as a multiple of the far
# side's, from which somebody speaks; band of the coherence; least power; coherence from which the gate closes, and how far.
FAR_LEVEL, NEAR_LEVEL, NEAR_TIMES = 1e-4, 3e-3, 2.0
GATE_BAND = (300, 3400)
LEAST_POWER = 1e-9
GATE_FROM, GATE_DB = 0.65, 18.0


def window_lags(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each pair of windows (rows) the shift of the far one with the largest product, without sign, over the level of what
    meets; all shifts at once by a product of spectra."""
    n = near.shape[1]
    spectra = np.conj(np.fft.rfft(near, 2 * n)) * np.fft.rfft(far, 2 * n)
    products = np.fft.irfft(spectra, 2 * n)
    products = np.concatenate([products[:, n + 1 :], products[:, :n]], axis=1)  # shifts -(n - 1) to n - 1
    power = np.cumsum(far * far, axis=1)
    met = np.concatenate([power[:, :-1], power[:, -1:], power[:, -1:] - power[:, :-1]], axis=1)
    scores = np.where(met > LEAST_POWER, np.abs(products) / np.sqrt(np.maximum(met, LEAST_POWER)), 0.0)
    return np.argmax(scores, axis=1) - (n - 1)


def shifted(samples: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Each row from its lag on, zeros beyond either end."""
    n = samples.shape[1]
    place = np.arange(n) + lags[:, None]
    return np.where((place >= 0) & (place < n), np.take_along_axis(samples, np.clip(place, 0, n - 1), axis=1), 0.0)


def window_coherences(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Coherence of each pair of windows over the band, from three half overlapping segments under a periodic Hann window."""
    size = near.shape[1] // 2
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    place = np.arange(3)[:, None] * (size // 2) + np.arange(size)
    x, y = (np.fft.rfft(side[:, place] * shape, axis=2) for side in (near, far))
    low, high = int(GATE_BAND[0] * size // RATE), -int(-GATE_BAND[1] * size // RATE)
    cross = np.abs((x * y.conj()).sum(1))[:, low:high] ** 2
    power = ((np.abs(x) ** 2).sum(1) * (np.abs(y) ** 2).sum(1))[:, low:high]
    loud = power > LEAST_POWER
    return np.where(loud, cross / np.where(loud, power, 1.0), 0.0).sum(1) / np.maximum(loud.sum(1), 1)


def gate_targets(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The gain that each pair of windows asks for: NaN where the far side has gaps or is silent, somebody speaks nearby, or
    the near side isn't the far side's echo. All windows are worked through at once."""
    near, whole = np.nan_to_num(near), np.isfinite(far).all(axis=1)
    far = np.nan_to_num(far, posinf=0.0, neginf=0.0)
    far_level, near_level = (np.sqrt((side * side).mean(axis=1)) for side in (far, near))
    asked = np.flatnonzero(whole & (far_level >= FAR_LEVEL) & (near_level < NEAR_LEVEL) & (near_level < NEAR_TIMES * far_level))
    out = np.full(len(near), np.nan)
    if len(asked):
        echo = window_coherences(near[asked], shifted(far[asked], window_lags(near[asked], far[asked])))
        t = np.clip((echo - GATE_FROM) / (1 - GATE_FROM), 0, 1)
        out[asked] = np.where(echo >= GATE_FROM, 10.0 ** (-GATE_DB * t * t * (3 - 2 * t) / 20), np.nan)
    return out


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def log_mel_of(samples: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else log_mel(np.asarray(s, dtype=np.float64)).tolist() for s in samples])


@F.pandas_udf(DoubleType())
def coherence_of(near: pd.Series, far: pd.Series) -> pd.Series:
    return pd.Series([coherence(np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)) for a, b in zip(near, far, strict=True)])


@F.pandas_udf(IntegerType())
def best_lag_of(near: pd.Series, far: pd.Series) -> pd.Series:
    return pd.Series([best_lag(np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)) for a, b in zip(near, far, strict=True)])
