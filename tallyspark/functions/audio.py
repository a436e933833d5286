"""Audio in tables: WAV bytes to mono samples and back, resampling, and a store keyed by content."""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RATE = 32_000


def samples_of(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 (channels averaged) and the rate of 8-, 16- or 32-bit PCM."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128 if width == 1 else np.frombuffer(data, f"<i{width}") / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def wav_of(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def resample(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == wanted or not len(samples):
        return samples
    n = max(1, round(len(samples) * wanted / rate))
    return np.interp(np.arange(n) * rate / wanted, np.arange(len(samples)), samples).astype(np.float32)


def decode(df: DataFrame, key: str, content: str, rate: int = DEFAULT_RATE, most_seconds: float | None = None) -> DataFrame:
    """(key, samples, sample_rate, error) of WAV bytes at one rate, cut to most_seconds; bad bytes give an error, no failure."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    x = resample(*samples_of(raw), rate)
                    rows.append((k, x[: int(most_seconds * rate)] if most_seconds else x, rate, None))
                except (wave.Error, EOFError, TypeError, ValueError) as error:
                    rows.append((k, None, None, f"{type(error).__name__}: {error}"))
            kinds = (pa.string(), pa.list_(pa.float32()), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "samples", "sample_rate", "error"])

    return df.select(F.col(key).cast("string").alias("key"), content).mapInArrow(run, "key string, samples array<float>, sample_rate int, error string").withColumnRenamed("key", key)


def wav_files(df: DataFrame, key: str, samples: str, rate: str) -> DataFrame:
    """(key, file_name, audio_bytes): WAV bytes under a name that is their digest, so that writing twice adds nothing."""

    def run(batches):
        for batch in batches:
            raw = [wav_of(np.array(x, np.float32), r or DEFAULT_RATE) for x, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            names = [hashlib.sha256(b).hexdigest() + ".wav" for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(raw, pa.binary())], names=["key", "file_name", "audio_bytes"])

    return df.select(F.col(key).cast("string").alias("key"), samples, F.col(rate).cast("int")).mapInArrow(run, "key string, file_name string, audio_bytes binary").withColumnRenamed("key", key)
