"""Hand-computed values of the rating operators."""

import csv
import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.functions import columns as C
from ratelake.operators import arrays, checkpoint_table, existence, feature_store, heads, metrics, normalize, ranking, runs, sampling, scoring, signal
from ratelake.plans import manifest
from ratelake.sources import files, readers, writers


def one(df):
    return df.collect()[0]


def pairs(spark, p, t):
    return spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(p, t)], "g int, p double, t double")


def test_metrics(spark):
    r = one(metrics.compute(pairs(spark, range(1, 6), range(1, 6)), ["g"], "p", "t"))
    assert (round(r.srcc, 9), round(r.lcc, 9), r.mse) == (1, 1, 0)
    assert one(metrics.compute(pairs(spark, [5, 4, 3, 2, 1], range(1, 6)), ["g"], "p", "t")).srcc == pytest.approx(-1)
    r = one(metrics.compute(pairs(spark, [3, 3], [1, 1]), ["g"], "p", "t"))
    assert r.mse == 4 and math.isnan(r.srcc) and math.isnan(r.lcc)
    r = one(metrics.compute(pairs(spark, [1], [1]), ["g"], "p", "t"))
    assert math.isnan(r.srcc) and math.isnan(r.mse)
    r = one(metrics.compute(pairs(spark, [1, float("nan"), 3, 4], [1, 2, 3, 4]), ["g"], "p", "t"))
    assert r.n == 3 and r.srcc == pytest.approx(1)


@pytest.mark.parametrize("size", [1, 3, 2000])
def test_ranks(spark, size):
    """Average ranks against plain counting: ties, a null group, infinite and far values."""
    rng = np.random.default_rng(size)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in np.round(rng.normal(size=size) * 20) * (1e9 if g == "b" else 1)]
    rows += [("c", v) for v in (math.inf, -math.inf, 0.0, 0.0, 5.0)] if size == 3 else []
    got = {(r.g, r.v): r.k for r in metrics.average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "k").collect()}
    exp = {(g, v): sum(w < v for h, w in rows if h == g) + (sum(w == v for h, w in rows if h == g) + 1) / 2 for g, v in rows}
    assert got == exp


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}, {"spark.sql.shuffle.partitions": "211"}])
def test_batches_keep_rows(spark, conf):
    """Wide rows: every row comes back once, in the batch of its place."""
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for n in (20_000,) if conf else (0, 20_000, 100_000, 400_000):
            rows = spark.range(n).select((F.col("id") * 7919 % max(n, 1)).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 16).alias("payload"))
            out = sampling.with_batches(rows, "k", 16)
            assert out.columns == ["k", "payload", "batch_id"]
            wrong, total, distinct = out.select(F.count_if(F.col("batch_id") != F.expr("k div 16")), F.count("*"), F.count_distinct("k")).first()
            assert (wrong, total, distinct) == (0, n, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_normalise(spark):
    train = spark.createDataFrame([("n", 1.0), ("n", 3.0), ("n", 5.0), ("c", 0.1), ("c", 0.1), ("c", 0.1)], "source string, acr double")
    stats = normalize.fit(train, "source", "acr")
    dev = spark.createDataFrame([("n", 3.0), ("other", 7.0)], "source string, acr double")
    assert {(r.source, round(r.acr, 6)) for r in normalize.apply(dev, stats, "source", "acr").collect()} == {("n", 0.0), ("other", 7.0)}
    out = sorted(round(r.acr, 6) for r in normalize.apply(train, stats, "source", "acr").collect())
    assert out == [-1.224745, 0.0, 0.0, 0.0, 0.0, 1.224745]


def test_cap_and_split(spark):
    df = spark.range(100).select(F.col("id"), F.lit("s").alias("source"))
    ids = {r.id for r in sampling.cap(df, "source", "id", 10).collect()}
    assert len(ids) == 10 and ids == {r.id for r in sampling.cap(df.repartition(7), "source", "id", 10).collect()}
    assert sampling.cap(df, "source", "id", None).count() == sampling.cap(df, "source", "id", 0).count() == sampling.cap(df, "source", "id", 500).count() == 100
    split = {r.id: r.split for r in sampling.split(df, "source", "id").collect()}
    assert sum(v == "train" for v in split.values()) == 90 and split == {r.id: r.split for r in sampling.split(df.repartition(5), "source", "id").collect()}


def test_rescale_and_clamp(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "v double")
    assert [r.v for r in scoring.rescaled(df, "v", 1.0, 5.0).orderBy("v").collect()] == [1, 3, 5]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v for r in scoring.rescaled(same, "v", 1.0, 5.0).collect()] == [1, 1]
    wide = spark.createDataFrame([(9.0,), (-9.0,), (float("nan"),), (None,)], "v double")
    assert [r.v for r in scoring.clamped(wide, "v", 1.0, 5.0).collect()] == [5, 1, 1, 1]


def test_losses(spark):
    rows = lambda p, t, s: spark.createDataFrame([(0, i, float(a), b, c) for i, (a, b, c) in enumerate(zip(p, t, s))], "batch int, i int, p double, t double, s string")
    loss = lambda df, **o: one(ranking.rating_loss(df, "batch", "i", ("p", "t"), **o)).total_loss
    assert loss(rows([3, 4], [1.0, 2.0], "aa")) == 4
    assert loss(rows([3, 4], [None, None], "aa")) == 0
    assert loss(rows([2, 1], [1.0, 2.0], "aa"), source="s", alpha=1.0) == 2
    assert loss(rows([2, 1], [1.0, 2.0], "ab"), source="s", alpha=1.0) == 1
    assert loss(rows([1, 2, 3, 4], [1.0, 2.0, 3.0, 4.0], "aaaa"), ccr=("p", "t"), weight=1.0) == 0


def test_runs(spark):
    dev = [0.5, 0.6, float("nan"), 0.55, 0.59, 0.7]
    history = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(dev)], "run string, epoch long, dev double")
    done = runs.stopped(history, 3).orderBy("epoch").collect()
    assert [r.no_improve for r in done] == [0, 0, 1, 2, 3]
    assert runs.stopped(history, 0).count() == 6
    assert one(runs.best_epoch(history.where("epoch < 6"))).best_epoch == 2
    kinds = {(r.kind, r.epoch) for r in runs.checkpoints(history, 3, 2).collect()}
    assert kinds == {("last", 5), ("best", 2), ("periodic", 2), ("periodic", 4)}
    flat = spark.createDataFrame([("a", 1, float("nan"))], "run string, epoch long, dev double")
    assert {(r.kind, r.epoch) for r in runs.checkpoints(flat, 3, 2).collect()} == {("last", 1), ("best", 1)}


def test_keys_and_ids(spark):
    assert one(spark.range(1).select(C.content_key(F.lit("/a/b.wav")).alias("k"))).k == "00164423f8575d9b64ccb7b6c9ea8813.npy"
    df = spark.createDataFrame([(0, "bvcc"), (0, "tmhint"), (0, "bvcc")], "b int, s string")
    assert sorted(r.source_id for r in sampling.dense_ids(df, "s", "b").collect()) == [0, 0, 1]
    assert one(spark.range(1).select(C.stem(F.lit("/x/a.b.wav")).alias("s"), C.dir_name(F.lit("/x/a.wav")).alias("d"))) == ("a.b", "/x")


def test_missing_score_fails(spark):
    with pytest.raises(Exception, match="no score"):
        scoring.lookup(spark.range(2).select(F.col("id").alias("k")), spark.createDataFrame([(0, 1.0)], "p long, s double"), "k", "p", "s", "out").collect()


def wav(x, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_signal():
    t = np.arange(2 * 44100) / 44100
    x, rate = signal.decode_wav(wav(0.5 * np.sin(2 * np.pi * 440 * t), 44100))
    y = signal.resample(x, rate)
    assert len(y) == 32000
    assert np.allclose(y[1000:-1000], 0.5 * np.sin(2 * np.pi * 440 * np.arange(32000) / 16000)[1000:-1000], atol=1e-3)
    quiet = np.concatenate([np.zeros(8000), np.random.default_rng(0).normal(0, 0.3, 16000), np.zeros(8000)]).astype(np.float32)
    assert 16000 <= len(signal.trim(quiet)) <= 16000 + 2 * signal.FRAME
    assert signal.mel_db(quiet).shape[0] == 80 and signal.log_mel(quiet).shape == (80, 3000)


def test_results_in_slices(spark, monkeypatch):
    """Long results leave a task's Python in slices, in order, and are those of each row alone."""
    import pandas as pd

    rng = np.random.default_rng(3)
    clips = [rng.normal(size=n).astype(np.float32) for n in (5000, 0, 30_000, 1, 9000, 20_000)]
    monkeypatch.setattr(signal, "SLICE_BYTES", 1 << 15)
    parts = list(signal.trimmed.func(iter([pd.Series(clips[:4]), pd.Series(clips[4:])])))
    assert len(parts) > 2 and all(sum(v.nbytes for v in p[:-1]) < 1 << 15 for p in parts)
    assert all(np.array_equal(x, signal.trim(c)) for x, c in zip([v for p in parts for v in p], clips, strict=True))
    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(clips)], "k int, x array<float>").coalesce(1)
    got = df.select("k", signal.prepared("x").alias("x")).orderBy("k").collect()
    assert all(np.array_equal(np.array(r.x, np.float32), signal.prepare(clips[r.k])) for r in got)


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.5],)], "x array<double>")
    r = one(df.select(arrays.peak_normalized(F.col("x")).alias("p"), arrays.pad_or_clip(F.col("x"), 5).alias("l"), arrays.pad_or_clip(F.col("x"), 2).alias("s"), arrays.dot(F.col("x"), [1, 1, 2]).alias("d")))
    assert r.p == [0.5, -1.0, 0.25] and list(r.l) == [1, -2, 0.5, 0, 0] and list(r.s) == [1, -2] and r.d == 0


def mel_by_hand(spec, w):
    """The mel branch by plain loops."""
    x = spec[None]
    for i in range(3):
        out = np.zeros((len(w[f"conv{i}_b"]), *x.shape[1:]))
        for o in range(len(out)):
            for r in range(x.shape[1]):
                for c in range(x.shape[2]):
                    v = w[f"conv{i}_b"][o]
                    for k in range(len(x)):
                        for dr in (-1, 0, 1):
                            for dc in (-1, 0, 1):
                                if 0 <= r + dr < x.shape[1] and 0 <= c + dc < x.shape[2]:
                                    v += w[f"conv{i}_w"][o, k, dr + 1, dc + 1] * x[k, r + dr, c + dc]
                    v = (v - w[f"conv{i}_mean"][o]) / math.sqrt(w[f"conv{i}_var"][o] + 1e-5) * w[f"conv{i}_gain"][o] + w[f"conv{i}_bias"][o]
                    out[o, r, c] = max(0.0, v)
        x = out
        if i:
            x = np.array([[[ch[2 * r : 2 * r + 2, 2 * c : 2 * c + 2].max() for c in range(ch.shape[1] // 2)] for r in range(ch.shape[0] // 2)] for ch in x])
    return w["mel_w"] @ x.mean(axis=(1, 2)) + w["mel_b"]


def test_forward():
    w = heads.make_weights(6, 4, mel=3, seed=2)
    rng = np.random.default_rng(1)
    feats, spec = rng.normal(size=(5, 6)), rng.normal(size=(9, 12))
    mel = heads.mel_vector(spec, w)
    assert np.allclose(mel, mel_by_hand(spec, w))
    frames = []
    for f in feats:
        y = w["adapter_w"] @ f + w["adapter_b"]
        y = (y - y.mean()) / math.sqrt(((y - y.mean()) ** 2).mean() + 1e-5) * w["norm_gain"] + w["norm_bias"]
        frames.append(np.concatenate([y, mel]))

    def walk(order, d):
        h, c, out = np.zeros(4), np.zeros(4), {}
        sig = lambda v: 1 / (1 + np.exp(-v))
        for t in order:
            z = w[f"{d}_x"] @ frames[t] + w[f"{d}_h"] @ h + w[f"{d}_b"]
            c = sig(z[4:8]) * c + sig(z[:4]) * np.tanh(z[8:12])
            h = sig(z[12:]) * np.tanh(c)
            out[t] = h
        return out

    ahead, back = walk(range(5), "forward"), walk(range(4, -1, -1), "backward")
    states = np.array([np.concatenate([ahead[t], back[t]]) for t in range(5)])
    share = np.exp(states @ w["pool_w"])
    pooled = (share / share.sum()) @ states
    exp = (pooled @ w["acr_w"] + w["acr_b"][0], pooled @ w["ccr_w"] + w["ccr_b"][0])
    assert np.allclose(heads.forward(feats, w, spec), exp)
    assert not np.allclose(heads.forward(feats, heads.make_weights(6, 4, seed=2)), exp)
    assert np.allclose(heads.attention(np.ones((4, 3)), np.zeros(3)), 1)


def flac(channels, layout, depth=16, rate=16000, kinds=("fixed",)):
    """A plain FLAC writer: blocks of 64 samples, subframes of the given kinds in turn."""
    text = []
    put = lambda v, n: text.append(format(v & ((1 << n) - 1), f"0{n}b") if n else "")
    n = len(channels[0])
    for number, start in enumerate(range(0, n, 64)):
        block = [np.asarray(c[start : start + 64], np.int64) for c in channels]
        put(0x3FFE, 14), put(0, 2), put(6, 4), put(5, 4), put(layout, 4), put({16: 4, 24: 6}[depth], 3), put(0, 1)
        put(number, 8) if number < 128 else (put(0xC0 | number >> 6, 8), put(0x80 | number & 63, 8))
        put(len(block[0]) - 1, 8), put(0, 8)
        if layout == 8:
            block[1] = block[0] - block[1]
        elif layout == 9:
            block[0] = block[0] - block[1]
        elif layout == 10:
            block = [(block[0] + block[1]) >> 1, block[0] - block[1]]
        for k, x in enumerate(block):
            own = depth + ((k == 1) if layout in (8, 10) else (k == 0) if layout == 9 else 0)
            kind = kinds[number % len(kinds)]
            if kind == "constant" and len(set(x.tolist())) > 1:
                kind = "verbatim"
            put(0, 1)
            if kind == "constant":
                put(0, 6), put(0, 1), put(int(x[0]), own)
                continue
            if kind == "verbatim":
                put(1, 6), put(0, 1)
                [put(int(v), own) for v in x]
                continue
            if kind == "wasted":
                if (x & 1).any():
                    put(1, 6), put(0, 1)
                    [put(int(v), own) for v in x]
                else:
                    put(1, 6), put(1, 1), put(1, 1)
                    [put(int(v) >> 1, own - 1) for v in x]
                continue
            order = 2 if kind == "fixed" else 3
            if kind == "fixed":
                put(8 + order, 6), put(0, 1)
                [put(int(v), own) for v in x[:order]]
                rest = [int(x[t] - 2 * x[t - 1] + x[t - 2]) for t in range(order, len(x))]
            else:
                weights, shift = (30, -17, 4), 4
                put(31 + order, 6), put(0, 1)
                [put(int(v), own) for v in x[:order]]
                put(7 - 1, 4), put(shift, 5)
                [put(v, 7) for v in weights]
                rest = [int(x[t]) - (sum(v * int(x[t - 1 - i]) for i, v in enumerate(weights)) >> shift) for t in range(order, len(x))]
            parts = 1 if len(x) % 4 == 0 and len(x) // 2 > order else 0
            put(0, 2), put(parts, 4)
            size = len(x) >> parts
            for p in range(1 << parts):
                own_rest = rest[max(0, p * size - order) : (p + 1) * size - order]
                if p == 1 and number % 2:  # an escaped partition
                    put(15, 4), put(30, 5)
                    [put(v, 30) for v in own_rest]
                    continue
                put(6, 4)
                for v in own_rest:
                    z = 2 * v if v >= 0 else -2 * v - 1
                    text.append("0" * (z >> 6) + "1"), put(z & 63, 6)
        whole = "".join(text)
        text[:] = [whole + "0" * (-len(whole) % 8)]
        put(0, 16)
    bits = "".join(text)
    info = (64).to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (len(channels) - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("layout", [0, 1, 8, 9, 10])
@pytest.mark.parametrize("depth", [16, 24])
def test_flac(layout, depth):
    rng = np.random.default_rng(layout)
    n = 64 * 130 + 17
    base = (rng.normal(size=n).cumsum() * 20).astype(np.int64)
    second = base + rng.integers(-9, 9, n)
    base[64:128] = 5
    second[64:128] = 7
    base[192:256] &= ~1
    channels = [base] if layout == 0 else [base, second]
    x, rate = signal.decode(flac(channels, layout, depth, kinds=("fixed", "constant", "lpc", "wasted", "verbatim")))
    assert rate == 16000 and len(x) == n
    assert np.allclose(x, np.mean(channels, axis=0) / 2 ** (depth - 1), atol=1e-7)


def test_wav_kinds():
    import struct

    x = np.linspace(-0.9, 0.9, 50)

    def riff(form, data, extra=b""):
        fmt = struct.pack("<HHIIHH", *form) + extra
        body = b"WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + b"data" + len(data).to_bytes(4, "little") + data
        return b"RIFF" + len(body).to_bytes(4, "little") + body

    for width in (4, 8):
        y, rate = signal.decode(riff((3, 1, 8000, 8000 * width, width, 8 * width), x.astype(f"<f{width}").tobytes()))
        assert rate == 8000 and np.allclose(y, x, atol=1e-6)
    stereo = np.stack([x, -x / 2], axis=1)
    y, _ = signal.decode(riff((0xFFFE, 2, 8000, 32000, 4, 16), (stereo * 32767).astype("<i2").tobytes(), bytes(8) + b"\x01\x00" + bytes(14)))
    assert np.allclose(y, x / 4, atol=1e-4)
    three = b"".join(int(v * (2**23 - 1)).to_bytes(3, "little", signed=True) for v in x)
    assert np.allclose(signal.decode(riff((1, 1, 8000, 24000, 3, 24), three))[0], x, atol=1e-6)
    for bad in (b"RIFF", b"OggS" + bytes(40), riff((6, 1, 8000, 8000, 1, 8), b"\0" * 4)):
        with pytest.raises(ValueError):
            signal.decode(bad)


def test_mel():
    """Filters and a spectrogram by plain sums."""
    htk = lambda f: 2595 * math.log10(1 + f / 700)
    slaney = lambda f: 3 * f / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
    for flag, scale in ((False, htk), (True, slaney)):
        filters = signal.mel_filters(400, 80, slaney=flag)
        grid = np.linspace(0, 8000, 80001)
        mels = np.array([scale(f) for f in grid])
        edges = np.interp(np.linspace(0, mels[-1], 82), mels, grid)
        for m in (0, 7, 40, 79):
            peak = 2 / (edges[m + 2] - edges[m]) if flag else 1.0
            exp = [max(0.0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1]))) * peak for f in np.arange(201) * 40.0]
            assert np.allclose(filters[m], exp, atol=2e-3 * peak)
    x = np.random.default_rng(0).normal(size=200)
    padded = np.concatenate([x[16:0:-1], x, x[-2:-18:-1]])
    got = signal.mel_power(x, n_fft=32, hop=16, n_mels=6)
    for f in (0, 3, got.shape[1] - 1):
        own = padded[16 * f : 16 * f + 32] * [0.5 - 0.5 * math.cos(2 * math.pi * j / 32) for j in range(32)]
        power = [abs(sum(v * np.exp(-2j * math.pi * j * k / 32) for j, v in enumerate(own))) ** 2 for k in range(17)]
        assert np.allclose(got[:, f], signal.mel_filters(32, 6) @ power)
    log = signal.log_mel(np.sin(np.arange(16000) / 5))
    assert log.max() - log.min() <= 2 + 1e-6 and log.dtype == np.float32


def test_items(spark, tmp_path):
    """Stored features or computed ones, and no file opened where none is needed."""
    from ratelake.plans import inference

    gone = spark.createDataFrame([("/nonexistent/clip.wav", 3.0, float("nan"), None)], "path string, acr double, ccr double, source string")
    store = inference.cache_keys(gone.select("path")).select("cache_key", F.array(F.lit(0.5), F.lit(0.25)).alias("features"))
    r = one(inference.items(gone, store, load_waveform=False))
    assert list(r.encoder_feats) == [0.5, 0.25] and list(r.waveform) == [0.0] and r.ccr is None and r.source == "unknown" and "input_features" not in r
    (tmp_path / "a.wav").write_bytes(wav(np.sin(np.arange(8000) / 9) * 0.5, 16000))
    files = readers.binary(spark, str(tmp_path))
    rows = spark.createDataFrame([(f"{tmp_path}/a.wav", 4.0, 0.3)], "path string, acr double, ccr double")
    r = one(inference.items(rows, files=files))
    assert len(r.waveform) == 160000 and max(r.waveform) == 1 and len(r.input_features) == 80 * 3000 and r.acr == 4 and "encoder_feats" not in r
    with pytest.raises(Exception, match="no file"):
        inference.items(gone.drop("source"), files=files).collect()


def test_predict(spark, tmp_path):
    """Every clip is scored once; ranges, order and archives of two checkpoints."""
    import zipfile

    from ratelake.plans import inference

    rng = np.random.default_rng(4)
    feats = {f"/c{i}.wav": rng.normal(size=12) * 3 for i in range(8)}
    store = inference.cache_keys(spark.createDataFrame([(p, v.tolist()) for p, v in feats.items()], "path string, features array<double>")).select("cache_key", "features")
    rated = spark.createDataFrame([(f"r{i}", f"/c{i % 6}.wav") for i in range(9)], "sample_id string, path string")
    compared = spark.createDataFrame([(f"p{i}", f"/c{i}.wav", f"/c{7 - i}.wav") for i in range(8)], "sample_id string, path_a string, path_b string")
    w = heads.make_weights(4, 4)
    raw = {p: heads.forward(np.float32(v).astype(float).reshape(-1, 4), w)[0] for p, v in feats.items()}
    both = heads.weights_table(spark, {"one": w, "two": heads.make_weights(4, 4, seed=1)})
    made = inference.predict(rated, compared, store, both, 4)
    assert made.where("checkpoint = 'two'").count() == 17
    got = {r.sample_id: r.pred_score for r in made.where("checkpoint = 'one'").collect()}
    exp = {f"r{i}": min(5.0, max(1.0, raw[f"/c{i % 6}.wav"])) for i in range(9)} | {f"p{i}": min(3.0, max(-3.0, raw[f"/c{i}.wav"] - raw[f"/c{7 - i}.wav"])) for i in range(8)}
    assert got == pytest.approx(exp)
    scaled = {r.sample_id: r.pred_score for r in inference.predict(rated, compared, store, both, 4, mode="rescale").where("checkpoint = 'one'").collect()}
    for kind, lo, hi in (("r", 1, 5), ("p", -3, 3)):
        own = {k: v for k, v in scaled.items() if k[0] == kind}
        assert min(own.values()) == pytest.approx(lo) and max(own.values()) == pytest.approx(hi)
        values = {f"r{i}": raw[f"/c{i % 6}.wav"] for i in range(9)} | {f"p{i}": raw[f"/c{i}.wav"] - raw[f"/c{7 - i}.wav"] for i in range(8)}
        order = sorted(own, key=values.get)
        assert all(own[a] <= own[b] + 1e-9 for a, b in zip(order, order[1:]))
    zips = inference.submissions(rated, compared, store, both, 4, str(tmp_path))
    assert all(len(zipfile.ZipFile(z).read("predictions.csv").decode().splitlines()) == 18 for z in zips.values()) and len(zips) == 2
    with pytest.raises(AssertionError, match="rated clips is empty"):
        inference.predict(rated.limit(0), compared, store, both, 4)


def test_small_operators(spark):
    a, b = spark.range(5).withColumnRenamed("id", "x"), spark.createDataFrame([("c",), ("a",), ("b",)], "y string")
    assert {(r.x, r.y) for r in sampling.zipped(a, b, "x", "y").collect()} == {(0, "a"), (1, "b"), (2, "c")}
    assert sampling.is_set(b, "y", "abc") and not sampling.is_set(b, "y", "ab") and not sampling.is_set(b, "y", "abcd")
    with pytest.raises(AssertionError, match="dev is empty"):
        sampling.required(a.limit(0), "dev")
    parts = {"x": a, "y": b}
    assert set(manifest.chosen(parts, ["x", "z"])) == {"x"} and not manifest.chosen(parts, ["x"], {"x": "/nonexistent"})
    hyp = spark.createDataFrame([([[1.0], [2.0]], [9.0], [1.0, None, float("nan")], [2.0, 3.0])], "f array<array<double>>, v array<double>, m array<double>, x array<double>")
    r = one(hyp.select(arrays.with_repeated(F.col("f"), F.col("v")).alias("f"), arrays.without_missing(F.col("m")).alias("m"), arrays.affine(F.col("x"), [[1, 1], [0, 2]], [0.5, 0]).alias("y")))
    assert r.f == [[1, 9], [2, 9]] and r.m == [1] and r.y == [5.5, 6]
    group = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    assert sorted((r.g or "", r.v) for r in scoring.rescaled(group, "v", 1.0, 5.0, ["g"]).collect()) == [("", 1.0), ("", 5.0), ("a", 1.0)]


def test_corpora(tmp_path):
    """Fetching with an offline ``get``: what is there stays, broken archives go."""
    import zipfile

    from ratelake.sources import corpora

    calls = []

    def get(url, dest):
        calls.append(url)
        if url == "fail":
            raise OSError(url)
        if url == "none":
            return
        if url == "broken":
            open(dest, "w").write("no zip")
            return
        with zipfile.ZipFile(dest, "w") as z:
            z.writestr(f"{url}/inner.csv", "x")

    record = '{"files": [{"key": "a.zip", "links": {"self": "one"}}, {"key": "b.zip", "links": {"self": "two"}}]}'
    files = corpora.record_files(record)
    out = tmp_path / "r"
    assert corpora.fetch_files(files, str(out), get) == ["a.zip", "b.zip"] and (out / "one" / "inner.csv").exists()
    (out / "one" / "inner.csv").unlink()
    assert corpora.fetch_files(files, str(out), get) == [] and (out / "one" / "inner.csv").exists() and len(calls) == 2
    state = corpora.fetch_tolerant([("a.zip", "one"), ("b.zip", "broken"), ("c.csv", "fail"), ("d.csv", "none")], str(tmp_path / "t"), get)
    assert state == {"a.zip": "fetched", "b.zip": "broken", "c.csv": "failed", "d.csv": "failed"} and not (tmp_path / "t" / "b.zip").exists()
    assert corpora.fetch_tolerant([("a.zip", "one")], str(tmp_path / "t"), get) == {"a.zip": "there"}
    assert corpora.fetch_once("three", str(tmp_path / "o"), "inner*.csv", get=get) and not (tmp_path / "o" / "corpus.zip").exists()
    assert not corpora.fetch_once("three", str(tmp_path / "o"), "inner*.csv", get=get)
    clone = lambda source, dest: (tmp_path / "l").mkdir()
    assert corpora.clone_and_fetch("labels", "wav", str(tmp_path / "l"), "wav", get, clone) == (True, True)
    assert corpora.clone_and_fetch("labels", "wav", str(tmp_path / "l"), "wav", get, clone) == (False, False)
    assert corpora.first_copy(["x*/none", "o/**/*.csv"], str(tmp_path), str(tmp_path / "copy")).endswith("inner.csv") and corpora.first_copy(["none"], str(tmp_path), str(tmp_path)) is None
    link = corpora.linked(str(tmp_path / "o"), str(tmp_path / "deep" / "link"))
    assert corpora.linked("/elsewhere", link) == link and (tmp_path / "deep" / "link" / "three").is_dir()
    (tmp_path / "c.yaml").write_text("model:\n  proj_dim: 256\ntraining:\n  lr: 1.0e-4\n  use: false\n")
    pytest.importorskip("yaml")
    assert corpora.config(str(tmp_path / "c.yaml")) == {"model": {"proj_dim": 256}, "training": {"lr": 1e-4, "use": False}}


def test_fetch_and_extract(tmp_path):
    import tarfile

    (tmp_path / "a.txt").write_text("x" * 20000)
    url = (tmp_path / "a.txt").as_uri()
    assert readers.fetch(url, str(tmp_path / "b.txt")) and (tmp_path / "b.txt").read_text() == "x" * 20000
    (tmp_path / "b.txt").write_text("kept")
    readers.fetch(url, str(tmp_path / "b.txt"))
    assert (tmp_path / "b.txt").read_text() == "kept"
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.txt", "in/a.txt")
    assert readers.extract(str(tmp_path / "t.tar.gz"), str(tmp_path / "x")) == ["in/a.txt"] and (tmp_path / "x" / "in" / "a.txt").exists()
    assert readers.extract(str(tmp_path / "a.txt"), str(tmp_path / "x")) == []


def test_dev_set(spark, tmp_path):
    """Embedded audio kept once, and the manifests of rated and compared clips."""
    rows = spark.createDataFrame([("s1", (b"one", "f")), ("s2", (b"two", "g"))], "sample_id string, audio struct<bytes: binary, path: string>")
    rows.write.parquet(str(tmp_path / "set"))
    audio = readers.embedded_audio(spark, str(tmp_path / "set"))
    for _ in range(2):
        writers.save_clips(audio, str(tmp_path / "clips"))
    assert sorted((r.sample_id, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "clips")).collect()) == [("s1", b"one"), ("s2", b"two")]
    assert one(manifest.dev_acr(audio.where("sample_id = 's1'"), "/d")) == ("s1", "/d/s1.flac")
    assert one(manifest.dev_ccr(audio.where("sample_id = 's2'"), "/d")) == ("s2", "/d/s2_a.flac", "/d/s2_b.flac")
    writers.write_predictions(spark.createDataFrame([("a,b", 1.5)], "sample_id string, pred_score double"), str(tmp_path / "p"))
    assert one(spark.read.csv(str(tmp_path / "p"), header=True)) == ("a,b", "1.5")
    done = spark.createDataFrame([("r", 5, 0.4), ("r", 10, 0.6)], "run string, epoch long, best double")
    assert one(runs.resume_point(done)) == ("r", 11, 0.6)


def test_window_means(spark, tmp_path):
    """A stream's means by window, late rows dropped with their state."""
    from ratelake.streaming import ingest

    (tmp_path / "in").mkdir()
    text = {"1": "2024-01-01T01:00:00,a,1.0\n2024-01-01T02:00:00,a,3.0\n", "2": "2024-01-09T00:00:00,a,5.0\n", "3": "2024-01-01T03:00:00,a,99.0\n"}
    out = []
    for k in "123":
        (tmp_path / "in" / f"{k}.csv").write_text("ts,key,value\n" + text[k])
        stream = ingest.ratings(spark, str(tmp_path / "in"), "ts timestamp, key string, value double")
        means = ingest.mean_by_window(stream, "ts", "key", "value")
        query = means.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend((str(r.start.date()), r.mean, r.n) for r in df.collect())).start()
        query.awaitTermination()
    assert out == [("2024-01-01", 2.0, 2)]


def test_parsers(spark, tmp_path):
    wavs = tmp_path / "wav"
    wavs.mkdir()
    for n in ("sys1_utt001.wav", "sys1_utt002.wav", "a.wav"):
        (wavs / n).write_bytes(wav(np.zeros(160), 16000))
    (tmp_path / "t.csv").write_text("file_name,quality_score\nsys1_utt001,3.0\nsys1_utt001,4.0\nsys1_utt002,4.0\nsys9_gone,1.0\n")
    listing = readers.listing(spark, str(wavs))
    rows = {r.path: r for r in manifest.parse_tmhint(spark, str(tmp_path / "t.csv"), str(wavs), listing).rows.collect()}
    assert len(rows) == 2 and rows[f"{wavs}/sys1_utt001.wav"].acr == 3.5 and rows[f"{wavs}/sys1_utt001.wav"].system == "sys1"
    (tmp_path / "b.csv").write_text("s1,a.wav,2,x,y\ns1,a.wav,4,x,y\n")
    assert one(manifest.parse_bvcc(spark, {"dev": str(tmp_path / "b.csv")}, str(wavs), listing).rows).acr == 3.0
    (tmp_path / "m.csv").write_text("filename,mos,sr\na.wav,3.2,16000\n")
    assert one(manifest.parse_audiomos(spark, str(tmp_path / "m.csv"), str(wavs), listing).rows).acr == 3.2
    corpus = tmp_path / "nisqa"
    (corpus / "deg").mkdir(parents=True)
    for n in "abc":
        (corpus / "deg" / f"{n}.wav").write_bytes(b"x")
    (corpus / "NISQA_corpus_con.csv").write_text("db,con,mos\nNISQA_TRAIN_SIM,1,3.0\n")
    (corpus / "NISQA_corpus_file.csv").write_text("db,filepath_deg,mos\nNISQA_TRAIN_SIM,deg/a.wav,3.1\nNISQA_VAL_LIVE,deg/b.wav,4.2\nNISQA_TEST_P501,deg/c.wav,2.0\n")
    found, _, counts = manifest.parse_nisqa(spark, str(corpus), readers.listing(spark, str(corpus)))
    assert sorted(r.system for r in found.collect()) == ["NISQA_TRAIN_SIM", "NISQA_VAL_LIVE"] and sum(r.n_kept for r in counts.collect()) == 2
    whole = manifest.build({"tmhint": manifest.parse_tmhint(spark, str(tmp_path / "t.csv"), str(wavs), listing).rows, "nisqa": found}, per_source_z=True)
    assert whole.columns == readers.MANIFEST.names and whole.count() == 4


def test_rejected_lines(spark, tmp_path):
    """Lines that don't fit are told apart from missing values, with their file and reason."""
    (tmp_path / "t.csv").write_text('file_name,quality_score,note\na,3.0,x\nb,,x\nc,NaN,x\nd,four,x\n,2.0,x\ne,5.0\nf,1.0,x,y\n"g,h",2.5,"x ""q"""\n')
    rows, rejected = readers.checked_csv(spark, str(tmp_path / "t.csv"), "file_name string, quality_score double", "file_name")
    assert {(r.file_name, r.quality_score) for r in rows.collect()} == {("a", 3.0), ("b", None), ("c", None), ("g,h", 2.5)}
    assert {(r.line, r.reason) for r in rejected.collect()} == {("d,four,x", "quality_score is not double"), (",2.0,x", "no file_name"), ("e,5.0", "columns"), ("f,1.0,x,y", "columns")}
    assert {r.file.rpartition("/")[2] for r in rejected.collect()} == {"t.csv"} and rejected.count() == 4
    with pytest.raises(AssertionError, match="no columns"):
        readers.checked_csv(spark, str(tmp_path / "t.csv"), "file_name string, score double", "file_name")


def test_checkpoint_table(spark, tmp_path):
    """What a run resumes from is whole, whatever died in between."""
    table = checkpoint_table.CheckpointTable(spark, f"file://{tmp_path}/runs")
    epochs = lambda lo, hi, dev, w: spark.createDataFrame([("r", e, dev.get(e, 0.1), "head.w", [w + e, 1.0]) for e in range(lo, hi)], checkpoint_table.SCHEMA)
    assert table.versions() == [] and table.resume().count() == 0
    table.save(epochs(1, 4, {2: 0.5}, 0.0))
    assert one(table.resume()) == ("r", 4, 0.5, "head.w", [3.0, 1.0])
    lost = table.write(epochs(4, 7, {5: 0.9}, 100.0))  # dies before the pointer moves
    assert one(table.resume()) == ("r", 4, 0.5, "head.w", [3.0, 1.0])
    table.save(epochs(3, 6, {4: 0.7}, 10.0))  # goes on, with epoch 3 again
    assert one(table.resume()) == ("r", 6, 0.7, "head.w", [15.0, 1.0])
    got = {(r.kind, r.epoch, r.values[0]) for r in table.kept(2).collect()}
    assert got == {("last", 5, 15.0), ("best", 4, 14.0), ("periodic", 2, 2.0), ("periodic", 4, 14.0)}
    table.vacuum()
    assert lost not in files.names(spark, f"{table.folder}/versions") and one(table.resume())[1] == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("/a.wav", 3.5)], "path string, acr double")
    writers.write_manifest(df, str(tmp_path / "m"), single=True)
    assert one(readers.manifest(spark, str(tmp_path / "m"))).source == "unknown"
    import zipfile

    z = writers.zip_predictions(spark.createDataFrame([('a,"b"', 1.5)], "sample_id string, pred_score double"), str(tmp_path / "p.zip"))
    assert zipfile.ZipFile(z).read("predictions.csv").decode() == 'sample_id,pred_score\n"a,""b""",1.5\n'
    assert readers.valid_zip(z) and readers.extract(z, str(tmp_path / "x")) == ["predictions.csv"]


def test_zip_by_partitions(spark, tmp_path, monkeypatch):
    """An archive put together from many tasks' pieces is the one a single writer makes."""
    import zipfile
    import zlib

    monkeypatch.setattr(writers, "_PIECE", 500)
    rows = [(f's"{k}",é' if k % 9 == 0 else f"s{k}", None if k % 50 == 0 else k / 7) for k in range(700)]
    df = spark.createDataFrame(rows, "sample_id string, pred_score double").orderBy(F.rand(1))
    df = spark.createDataFrame(df.collect(), df.schema).repartition(5)
    for part in (df, df.limit(0)):
        z = zipfile.ZipFile(writers.zip_predictions(part, str(tmp_path / "p.zip")))
        assert z.testzip() is None and z.namelist() == ["predictions.csv"]
        with z.open("predictions.csv") as f:
            got = list(csv.reader(io.TextIOWrapper(f, "utf-8")))
        assert got[0] == ["sample_id", "pred_score"] and sorted(got[1:]) == sorted([r[0], "" if r[1] is None else str(r[1])] for r in part.collect())
    for a, b in ((b"", b""), (b"x", b""), (b"", b"yz"), (b"left" * 99, b"right" * 1001)):
        assert writers.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_feature_store(spark, tmp_path):
    """A retried append counts once, one without its commit not at all, and reads shuffle nothing of the store."""
    store = feature_store.FeatureStore(spark, f"file://{tmp_path}/store", feature_store.store_schema(), buckets=4)
    rows = spark.createDataFrame([(f"/{i}.wav", [float(i), 0.5]) for i in range(40)], "path string, features array<float>")
    early, late = rows.where("features[0] < 25"), rows.where("features[0] >= 20")
    assert store.read().count() == 0 and store.commits() == {}
    lost = store.write_part(late)  # its job dies before the commit
    assert store.append("early", early) and not store.append("early", early) and store.read().count() == 25
    again = store.write_part(early.limit(3))
    assert not store.commit("early", again) and store.read().count() == 25  # two jobs of one name: the first counts
    assert sorted(r.path for r in existence.still_to_do(rows.select("path"), store.read()).collect()) == sorted(f"/{i}.wav" for i in range(25, 40))
    with pytest.raises(Exception, match="no features"):
        existence.read_features(rows.select("path"), store.read()).collect()
    assert store.append("late", late)  # five keys again
    read = existence.read_features(rows.select("path"), store.read())
    assert {r.path: r.features for r in read.collect()} == {f"/{i}.wav": [float(i), 0.5] for i in range(40)}
    assert sorted(store.commits()) == ["early", "late"] and lost not in store.commits().values()
    with pytest.raises(ValueError, match="not a name"):
        store.commit("a/b", lost)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = existence.read_features(rows.select("path"), store.read())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "Exchange" not in plan[plan.index("Window") :]
    other = feature_store.FeatureStore(spark.newSession(), store.folder, store.schema, 4)
    assert other.read().count() == 40


def test_shuffled_batches(spark):
    """Every row once in each epoch, epochs differ, and partitions don't matter."""
    for n in (0, 1, 2, 5, 17, 64, 1000):
        df = spark.range(n).withColumnRenamed("id", "k")
        got = sampling.shuffled_batches(df, "k", 8, range(3), seed=3).collect()
        for e in range(3):
            assert sorted(r.batch_id * 8 + r.slot for r in got if r.epoch == e) == list(range(n))
            assert sorted(r.k for r in got if r.epoch == e) == list(range(n))
        if n == 1000:
            order = [[r.k for r in sorted((r for r in got if r.epoch == e), key=lambda r: (r.batch_id, r.slot))] for e in range(3)]
            assert all(sum(a == b for a, b in zip(x, y)) < 20 for x, y in ((order[0], order[1]), (order[1], order[2]), (order[0], sorted(order[0]))))
            # No trace of the order: the mean distance of neighbours is that of random places.
            assert abs(np.abs(np.diff(order[0])).mean() - 1000 / 3) < 40
            again = sampling.shuffled_batches(df.repartition(7), "k", 8, [2], seed=3).collect()
            assert sorted((r.k, r.batch_id, r.slot) for r in again) == sorted((r.k, r.batch_id, r.slot) for r in got if r.epoch == 2)


def brute_rank(rows):
    """Pairs of unequal targets and their mean hinge, for rows (pred, target)."""
    lost, n = 0.0, 0
    for i, (p, t) in enumerate(rows):
        for q, u in rows[:i]:
            if t != u:
                n += 1
                lost += max(0.0, (q - p) * (1 if t > u else -1))
    return n, lost / n if n else 0.0


def test_pair_rank_without_pairs(spark):
    rng = np.random.default_rng(11)
    rows = [("tied", float(rng.integers(0, 4)), float(rng.integers(0, 3)), "a") for _ in range(60)]
    rows += [("wide", float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(90)]
    rows += [("one", 1.0, 2.0, "a"), ("equal", 1.0, 2.0, "a"), ("equal", 3.0, 2.0, "a"), ("none", 1.0, None, "a"), ("alone", 1.0, 1.0, "a"), ("alone", 0.0, 2.0, "b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, b string, p double, t double, s string")
    for source in (None, "s"):
        for most in (1 << 16, 7):  # groups in several ranges of predictions
            got = {r.b: (r.n_pairs, r.rank_loss) for r in ranking.pair_rank(df, "b", "k", "p", "t", source, range_rows=most).collect()}
            for b in {r[0] for r in rows}:
                parts = [brute_rank([(p, t) for x, p, t, s in rows if x == b and t is not None and (source is None or s == one_)]) for one_ in ("ab" if source else "a")]
                n = sum(k for k, _ in parts)
                assert got[b][0] == n and got[b][1] == pytest.approx(sum(k * v for k, v in parts) / n if n else 0.0, abs=1e-9)
    odd = spark.createDataFrame([(1, "x", float("nan"), 1.0), (2, "x", 1.0, 2.0), (3, "y", float("nan"), 1.0), (4, "y", 1.0, 1.0), (5, "z", None, 1.0), (6, "z", 9.0, 0.0)], "k long, b string, p double, t double")
    got = {r.b: (r.n_pairs, r.rank_loss) for r in ranking.pair_rank(odd, "b", "k", "p", "t").collect()}
    assert got["x"][0] == 1 and math.isnan(got["x"][1]) and got["y"] == (0, 0.0) and got["z"] == (1, 0.0)


def test_pair_rank_large_batch(spark):
    """A batch of 60,000 rows (1.8 thousand million pairs)."""
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(0).alias("b"), ((F.col("id") * 7919) % n).cast("double").alias("p"), ((F.col("id") * 104729) % 1009).cast("double").alias("t"))
    r = one(ranking.pair_rank(df, "b", "k", "p", "t", range_rows=1 << 13))
    i = np.arange(n)
    p, t = (i * 7919 % n).astype(float), i * 104729 % 1009
    order = np.lexsort((p, t))
    p, t = p[order], t[order]
    lost = pairs_ = 0
    below = np.zeros(0)
    for value in np.unique(t):  # rows of one target against all lower ones, in order of predictions
        own = p[t == value]
        at = np.searchsorted(below, own)
        upto = np.concatenate([[0], np.cumsum(below)])
        lost += ((upto[-1] - upto[at]) - (len(below) - at) * own).sum()
        pairs_ += len(own) * len(below)
        below = np.sort(np.concatenate([below, own]))
    assert r.n_pairs == pairs_ and r.rank_loss == pytest.approx(lost / pairs_, rel=1e-9)


def test_ranks_by_splitters(spark):
    """Lognormal values with one far outlier: ranges of distinct values are even, ties and borders are right."""
    rng = np.random.default_rng(12)
    values = np.round(rng.lognormal(0, 2, 30_000), 3).tolist() + [1e300, -1e300] + [1.5] * 5000
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0), ("h", 1.0), (None, 3.0)], "g string, v double")
    counts = df.groupBy("g", "v").count()
    cuts = metrics.splitters(counts, ["g"], "v", most=1000)
    (row,) = cuts.collect()
    sizes = np.bincount(np.searchsorted(row["__splitters"], np.unique(values)), minlength=metrics.RANGES)
    assert row.g == "g" and sizes.max() < 2 * sizes.mean() and sizes.sum() == len(set(values))
    got = {(r.g, r.v): r.k for r in metrics.average_ranks(df, ["g"], "v", "k", most=1000).collect()}
    ranks = {("h", 1.0): 1.5, (None, 3.0): 1.0}
    at = 0
    for v, n in zip(*np.unique(values, return_counts=True)):
        ranks["g", v] = at + (n + 1) / 2
        at += n
    assert got == ranks


def test_attention_in_one_pass(spark):
    """Clips of 1,500 frames of 1,024 values in blocks, one shuffle; extreme scores; blocks anywhere."""
    rng = np.random.default_rng(13)
    clips = {f"c{k}": (rng.normal(size=1500) * (200 if k else 1), rng.normal(size=(1500, 1024)).astype(np.float32)) for k in range(2)}
    rows = [(c, s[i : i + 100].tolist(), v[i : i + 100].ravel().tolist()) for c, (s, v) in clips.items() for i in range(0, 1500, 100)] + [("empty", [], [])]
    df = spark.createDataFrame(rows, "c string, s array<double>, v array<float>").repartition(5)
    pooled = arrays.attention_pool_blocks(df, "c", "s", "v")
    got = {r.c: r.pooled for r in pooled.collect()}
    for c, (s, v) in clips.items():
        w = np.exp(s - s.max())
        assert got[c] == pytest.approx((w @ v.astype(float) / w.sum()).tolist(), rel=1e-6, abs=1e-9)
    assert set(got) == set(clips)
    plan = arrays.attention_pool_blocks(spark.createDataFrame(rows, "c string, s array<double>, v array<float>"), "c", "s", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_stream_resumes(spark, tmp_path):
    from ratelake.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("file_name,quality_score\na,1.0\n")
    go = lambda: ingest.ingest(ingest.ratings(spark, str(tmp_path / "in"), "file_name string, quality_score double"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    (tmp_path / "in" / "2.csv").write_text("file_name,quality_score\nb,2.0\n")
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
