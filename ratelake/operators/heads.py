"""Forward pass of the rating model over encoder features; weights are data, training is out of scope.

adapter (dense, layer norm with gain and bias) -> frames joined with the clip's mel vector -> bidirectional LSTM -> attention pooling ->
two scalar heads. The frozen encoder is replaced by its features, which come as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ratelake.operators.signal import mel_db

Weights = dict[str, np.ndarray]


def make_weights(hidden: int, projection: int = 16, mel: int = 0, seed: int = 0) -> Weights:
    """Seeded weights of the right shapes, for tests and demonstrations."""
    rng, width = np.random.default_rng(seed), projection + mel
    draw = lambda *shape: rng.normal(0, 0.3, shape)
    out = {"adapter_w": draw(projection, hidden), "adapter_b": draw(projection), "norm_gain": 1 + draw(projection), "norm_bias": draw(projection), "pool_w": draw(2 * projection), "acr_w": draw(2 * projection), "acr_b": draw(1), "ccr_w": draw(2 * projection), "ccr_b": draw(1)}
    for d in ("forward", "backward"):
        out |= {f"{d}_x": draw(4 * projection, width), f"{d}_h": draw(4 * projection, projection), f"{d}_b": draw(4 * projection)}
    if mel:
        sizes = (1, 4, 8, 8)
        for i in range(3):
            n = sizes[i + 1]
            out |= {f"conv{i}_w": draw(n, sizes[i], 3, 3), f"conv{i}_b": draw(n), f"conv{i}_gain": 1 + draw(n), f"conv{i}_bias": draw(n), f"conv{i}_mean": draw(n), f"conv{i}_var": 1 + abs(draw(n))}
        out |= {"mel_w": draw(mel, sizes[3]), "mel_b": draw(mel)}
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def adapter(x: np.ndarray, w: Weights) -> np.ndarray:
    """Dense layer and layer norm (biased variance, then gain and bias) of each frame; dropout is the identity here."""
    y = x @ w["adapter_w"].T + w["adapter_b"]
    return (y - y.mean(-1, keepdims=True)) / np.sqrt(y.var(-1, keepdims=True) + 1e-5) * w["norm_gain"] + w["norm_bias"]


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hidden states over time; gates in the order input, forget, cell, output."""
    n = wh.shape[1]
    h, c, out, pre = np.zeros(n), np.zeros(n), np.empty((len(x), n)), x @ wx.T + b
    for t, gates in enumerate(pre):
        i, f, g, o = np.split(gates + wh @ h, 4)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[t] = h
    return out


def bilstm(x: np.ndarray, w: Weights) -> np.ndarray:
    ahead = lstm(x, w["forward_x"], w["forward_h"], w["forward_b"])
    back = lstm(x[::-1], w["backward_x"], w["backward_h"], w["backward_b"])[::-1]
    return np.concatenate([ahead, back], axis=1)


def attention(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = np.exp((s := x @ w) - s.max())
    return (s / s.sum()) @ x


def mel_vector(spectrogram: np.ndarray, w: Weights) -> np.ndarray:
    """Three blocks of convolution (3x3, same size), batch norm by stored statistics and ReLU, then means and a dense layer.

    The second and third block are halved by max pooling.
    """
    x = spectrogram[None]
    for i in range(3):
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (1, 1), (1, 1))), (3, 3), axis=(1, 2))
        x = np.einsum("oikl,ihwkl->ohw", w[f"conv{i}_w"], windows, optimize=True) + w[f"conv{i}_b"][:, None, None]
        scale = w[f"conv{i}_gain"] / np.sqrt(w[f"conv{i}_var"] + 1e-5)
        x = np.maximum(0, (x - w[f"conv{i}_mean"][:, None, None]) * scale[:, None, None] + w[f"conv{i}_bias"][:, None, None])
        if i > 0:
            h, v = x.shape[1] // 2, x.shape[2] // 2
            x = x[:, : 2 * h, : 2 * v].reshape(len(x), h, 2, v, 2).max(axis=(2, 4))
    return x.mean(axis=(1, 2)) @ w["mel_w"].T + w["mel_b"]


def forward(features: np.ndarray, w: Weights, mel: np.ndarray | None = None) -> tuple[float, float]:
    """Absolute and comparative score of a clip."""
    x = adapter(features, w)
    if mel is not None:
        x = np.concatenate([x, np.broadcast_to(mel_vector(mel, w), (len(x), len(w["mel_b"])))], axis=1)
    pooled = attention(bilstm(x, w), w["pool_w"])
    return float(pooled @ w["acr_w"] + w["acr_b"][0]), float(pooled @ w["ccr_w"] + w["ccr_b"][0])


def weights_table(spark: SparkSession, checkpoints: dict[str, Weights]) -> DataFrame:
    """(checkpoint, param, shape, values): every array of every checkpoint, flattened."""
    rows = [(name, param, list(map(int, w[param].shape)), w[param].astype(float).ravel().tolist()) for name, w in checkpoints.items() for param in sorted(w)]
    return spark.createDataFrame(rows, "checkpoint string, param string, shape array<int>, values array<double>")


def weights_of(table: DataFrame) -> dict[str, Weights]:
    """The checkpoints of a weights table, which is as large as the models, whatever the number of clips."""
    out: dict[str, Weights] = {}
    for row in table.collect():
        out.setdefault(row["checkpoint"], {})[row["param"]] = np.array(row["values"], float).reshape(row["shape"])
    return dict(sorted(out.items()))


def score_checkpoints(clips: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """(checkpoint, path, acr, ccr) of (path, features), features being frames of ``width`` values laid end to end.

    Every clip is read once and scored by all checkpoints of the weights table. Where one has a mel branch, ``samples``
    (16 kHz) are needed too, and the spectrogram is made once. Make paths distinct first: the forward pass is the costly step.
    """
    models = weights_of(table)
    shared = clips.sparkSession.sparkContext.broadcast(models)
    with_mel = any("mel_w" in w for w in models.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, (path, flat) in enumerate(zip(f["path"], f["features"])):
                features = np.asarray(flat, np.float64).reshape(-1, width)
                mel = mel_db(np.asarray(f["samples"].iloc[k], np.float32)) if with_mel else None
                rows += [(name, path, *forward(features, w, mel if "mel_w" in w else None)) for name, w in shared.value.items()]
            yield pd.DataFrame(rows, columns=["checkpoint", "path", "acr", "ccr"])

    return clips.select("path", "features", *(["samples"] if with_mel else [])).mapInPandas(run, "checkpoint string, path string, acr double, ccr double")


def score_clips(clips: DataFrame, weights: Weights, width: int) -> DataFrame:
    """(path, acr, ccr) of (path, features) by one checkpoint."""
    return score_checkpoints(clips, weights_table(clips.sparkSession, {"": weights}), width).drop("checkpoint")


def trainable(parameters: DataFrame, frozen: str = "encoder.") -> DataFrame:
    """(param, value) rows worth saving: all but the frozen encoder's."""
    return parameters.where(~parameters["param"].startswith(frozen))
