"""WAV files as rows of mono samples at 16 kHz."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, StructField, StructType

from parley.sources.folders import write_files

RATE = 16_000
_DECODED = StructType([StructField("samples", ArrayType(FloatType())), StructField("rate", IntegerType())])


def decode(data: bytes) -> tuple[np.ndarray, int] | None:
    """Mono samples in [-1, 1] and the file's rate; None if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as file:
            width, channels, rate, raw = file.getsampwidth(), file.getnchannels(), file.getframerate(), file.readframes(file.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        values = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    return values[: len(values) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to ceil(n * to / rate) samples."""
    if rate == to or not len(samples):
        return samples
    places = np.arange(-(-len(samples) * to // rate)) * rate
    left = np.minimum(places // to, len(samples) - 1)
    right = np.minimum(left + 1, len(samples) - 1)
    return samples[left] + (samples[right] - samples[left]) * (places % to / to)


@F.pandas_udf(_DECODED)
def _decoded(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        found = decode(data)
        rows.append((None, None) if found is None else (resampled(*found).astype(np.float32), found[1]))
    return pd.DataFrame(rows, columns=["samples", "rate"])


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, samples and source_rate of the readable WAV files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    rows = files.select("path", _decoded("content").alias("d"))
    return rows.where("d.samples is not null").select("path", "d.samples", F.col("d.rate").alias("source_rate"))


@F.pandas_udf(BinaryType())
def _encoded(samples: pd.Series, rates: pd.Series) -> pd.Series:
    out = []
    for values, rate in zip(samples, rates, strict=True):
        held = io.BytesIO()
        with wave.open(held, "wb") as file:
            file.setnchannels(1)
            file.setsampwidth(2)
            file.setframerate(int(rate))
            file.writeframes(np.asarray(values, dtype="<i2").tobytes())
        out.append(held.getvalue())
    return pd.Series(out, dtype=object)


def write_wav(rows: DataFrame, folder: str) -> None:
    """A mono WAV file of 16 bits for each row (name, samples, rate)."""
    write_files(rows.select("name", _encoded("samples", "rate").alias("content")), folder, ".wav")
