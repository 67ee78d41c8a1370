"""Signal operators as Arrow UDFs over numpy: decoding, resampling, trimming, mel spectrograms, half precision."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.operators.flac import decode_flac

RATE = 16_000
CLIP = 10 * RATE
TRIM_DB, FRAME, HOP = 30.0, 2048, 512
_SAMPLES = T.ArrayType(T.FloatType())
#: Bytes of results that a task's Python hands on at once (Spark bounds what comes in).
SLICE_BYTES = 1 << 22
N_FFT, MEL_HOP, N_MELS, FLOOR = 400, 160, 80, 1e-10


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 samples and the rate of WAV bytes: PCM of 1 to 4 bytes, or floats."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not WAV")
    at, form, data = 12, None, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
            # The extensible form names the real one in the first bytes of its sub-format.
            kind = int.from_bytes(raw[at + 32 : at + 34], "little") if form[0] == 0xFFFE else form[0]
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or kind not in (1, 3):
        raise ValueError("WAV of another kind than PCM or float")
    channels, rate, width = form[1], form[2], form[5] // 8
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(data, f"<f{width}").astype(np.float32)
    elif width == 1:
        x = np.frombuffer(data, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 samples and the rate of WAV or FLAC bytes."""
    return decode_flac(raw) if raw[:4] == b"fLaC" else decode_wav(raw)


def resample(x: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Band-limited resampling through the spectrum; ceil(n * target / rate) samples."""
    if rate == target or not len(x):
        return x.astype(np.float32)
    n = -(-len(x) * target // rate)
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    keep = min(len(out), len(spectrum))
    out[:keep] = spectrum[:keep]
    return (np.fft.irfft(out, n) * (n / len(x))).astype(np.float32)


def trim(x: np.ndarray, top_db: float = TRIM_DB, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Cuts the edges whose frames lie ``top_db`` below the loudest frame (root mean square, centred frames)."""
    if not len(x):
        return x
    padded = np.pad(x.astype(np.float64), frame // 2)
    power = np.concatenate([[0.0], np.cumsum(padded**2)])
    starts = np.arange(0, len(padded) - frame + 1, hop)
    mean = np.maximum((power[starts + frame] - power[starts]) / frame, 0)
    top = mean.max()
    loud = np.flatnonzero(10 * np.log10(np.maximum(mean, 1e-20)) > 10 * np.log10(max(top, 1e-20)) - top_db)
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)] if len(loud) else x[:0]


def mel_filters(n_fft: int = N_FFT, n_mels: int = N_MELS, rate: int = RATE, slaney: bool = False) -> np.ndarray:
    """Triangular filters spaced evenly on a mel scale.

    The scale is 2595 * log10(1 + f / 700) with peaks of 1; or, as speech encoders expect (``slaney``), linear below 1 kHz
    and logarithmic above, with equal areas.
    """
    if slaney:
        # 3 mels in 200 Hz up to 15 mels at 1 kHz, then 27 mels for a factor of 6.4.
        mels = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)
        at = np.linspace(0, mels(rate / 2), n_mels + 2)
        edges = np.where(at < 15, at * 200 / 3, 1000 * 6.4 ** ((at - 15) / 27))
    else:
        edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), n_mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    filters = np.maximum(0, np.minimum(rise, fall))
    return filters * (2 / (edges[2:] - edges[:-2]))[:, None] if slaney else filters


def mel_power(x: np.ndarray, n_fft: int = N_FFT, hop: int = MEL_HOP, n_mels: int = N_MELS, rate: int = RATE, slaney: bool = False) -> np.ndarray:
    """(n_mels, frames) mel power spectrogram with reflected edges and a Hann window."""
    padded = np.pad(x.astype(np.float64), n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2
    return mel_filters(n_fft, n_mels, rate, slaney) @ power.T


def mel_db(x: np.ndarray, **options) -> np.ndarray:
    return 10 * np.log10(np.maximum(mel_power(x, **options), FLOOR))


def log_mel(x: np.ndarray, frames: int = 3000) -> np.ndarray:
    """(80, frames) encoder input: log10 power, floored 8 below the top, scaled to about [-1, 1], padded to 30 s."""
    whole = np.zeros(frames * MEL_HOP)
    whole[: min(len(x), len(whole))] = x[: len(whole)]
    log = np.log10(np.maximum(mel_power(whole, slaney=True)[:, :frames], FLOOR))
    return ((np.maximum(log, log.max() - 8) + 4) / 4).astype(np.float32)


def clips(files: DataFrame) -> DataFrame:
    """(path, samples) at 16 kHz mono from (path, content) rows of WAV or FLAC files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "samples": [resample(*decode(c)) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, samples array<float>")


def by_row(one: Callable[[np.ndarray], np.ndarray], kind: T.DataType = _SAMPLES) -> Callable[[Column], Column]:
    """A function of columns of samples that applies ``one`` to each row.

    Results go on in slices, so that memory doesn't grow with the rows of a batch, however long their results are.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            held, size = [], 0
            for v in part:
                held.append(one(np.asarray(v, np.float32)))
                size += held[-1].nbytes
                if size >= SLICE_BYTES:
                    yield pd.Series(held)
                    held, size = [], 0
            if held:
                yield pd.Series(held)

    return F.pandas_udf(run, kind)


def prepare(x: np.ndarray) -> np.ndarray:
    """Divided by the largest magnitude, trimmed, and cut or filled with zeros to ten seconds."""
    top = np.abs(x).max(initial=0)
    x = trim(x / top if top > 0 else x)[:CLIP]
    return np.pad(x, (0, CLIP - len(x))).astype(np.float32)


def mel_db_flat(n_fft: int = N_FFT, hop: int = MEL_HOP, n_mels: int = N_MELS) -> Callable[[Column], Column]:
    """A function of samples that gives their mel spectrogram in dB, row after row."""
    return by_row(lambda x: mel_db(x, n_fft=n_fft, hop=hop, n_mels=n_mels).ravel(), T.ArrayType(T.DoubleType()))


trimmed = by_row(trim)
prepared = by_row(prepare)
#: The encoder's input, row after row.
log_mel_flat = by_row(lambda x: log_mel(x).ravel())
#: Values as they come back from half precision.
half_round_trip = by_row(lambda x: x.astype(np.float16).astype(np.float32))
