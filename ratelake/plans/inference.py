"""Items for training and scoring, and predictions of rated and compared clips by one or more checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import ACR_RANGE, CCR_RANGE, content_key, missing_as_null
from ratelake.operators import existence, heads, scoring, signal
from ratelake.operators.sampling import required
from ratelake.operators.shared import cut
from ratelake.sources import writers


def with_features(rows: DataFrame, store: DataFrame | None, files: DataFrame | None = None, load_waveform: bool = True) -> DataFrame:
    """Adds either ``encoder_feats`` (if there is a ``store``) or ``input_features``, and ``waveform``.

    Clips are decoded only where something needs them: with a store and without waveforms no file is opened, and the
    waveform is one zero. A path without stored features, or without a file that is needed, fails the query.
    """
    out = rows
    if load_waveform or store is None:
        decoded = signal.clips(files).select("path", signal.prepared("samples").alias("waveform"))
        missing = F.raise_error(F.concat(F.lit("no file "), F.col("path"))).cast("array<float>")
        out = out.join(decoded, "path", "left").withColumn("waveform", F.coalesce("waveform", missing))
    if store is not None:
        known = store.select("cache_key", F.col("features").cast("array<float>").alias("features"))
        out = existence.read_features(out, known).withColumnRenamed("features", "encoder_feats").drop("cache_key")
    else:
        out = out.withColumn("input_features", signal.log_mel_flat("waveform"))
    return out if load_waveform else out.withColumn("waveform", F.array(F.lit(0.0).cast("float")))


def items(manifest: DataFrame, store: DataFrame | None = None, files: DataFrame | None = None, load_waveform: bool = True) -> DataFrame:
    """One row per manifest row: path, acr, ccr (null if missing), source (unknown if there is none), features, waveform."""
    source = F.coalesce("source", F.lit("unknown")) if "source" in manifest.columns else F.lit("unknown")
    rows = manifest.select("path", F.col("acr").cast("float").alias("acr"), missing_as_null(F.col("ccr").cast("float")).alias("ccr"), source.alias("source"))
    return with_features(rows, store, files, load_waveform)


def score_paths(paths: DataFrame, store: DataFrame, table: DataFrame, width: int, files: DataFrame | None = None) -> DataFrame:
    """(checkpoint, path, acr, ccr): every distinct path, with its features read once, scored by every checkpoint."""
    with_mel = not table.where("param = 'mel_w'").isEmpty()
    own = with_features(paths.select("path").distinct(), store, files, load_waveform=with_mel)
    return heads.score_checkpoints(own.select("path", F.col("encoder_feats").alias("features"), F.col("waveform").alias("samples")), table, width)


def predictions(rated: DataFrame, compared: DataFrame, scores: DataFrame, mode: str = "clamp") -> DataFrame:
    """(checkpoint, sample_id, pred_score) of rated (sample_id, path) and compared (sample_id, path_a, path_b) clips.

    ``scores`` are (checkpoint, path, acr). A comparison is the difference of its clips' scores by the same checkpoint.
    Both kinds are held within their range (``clamp``), or mapped onto it in their order, by checkpoint (``rescale``). A
    clip that a checkpoint has no score of fails the query.
    """
    every = scores.select("checkpoint").distinct()  # a handful
    per = lambda rows: rows.join(F.broadcast(every))
    side = scores.select(F.struct("checkpoint", "path").alias("__clip"), "acr")
    clip = lambda path: F.struct("checkpoint", F.col(path).alias("path"))
    acr = scoring.lookup(per(rated).withColumn("__at", clip("path")), side, "__at", "__clip", "acr", "pred_score").select("checkpoint", "sample_id", "pred_score")
    both = per(compared).withColumns({"__a": clip("path_a"), "__b": clip("path_b")})
    ccr = scoring.pair_difference(both, side, "__a", "__b", "__clip", "acr").select("checkpoint", "sample_id", F.col("diff").alias("pred_score"))
    if mode == "clamp":
        parts = [scoring.clamped(x, "pred_score", *to) for x, to in ((acr, ACR_RANGE), (ccr, CCR_RANGE))]
    elif mode == "rescale":
        parts = [scoring.rescaled(x, "pred_score", *to, group=["checkpoint"]) for x, to in ((acr, ACR_RANGE), (ccr, CCR_RANGE))]
    else:
        raise ValueError(f"neither clamp nor rescale: {mode}")
    return parts[0].unionByName(parts[1])


def predict(rated: DataFrame, compared: DataFrame, store: DataFrame, table: DataFrame, width: int, files: DataFrame | None = None, mode: str = "clamp") -> DataFrame:
    """From manifests, features and a table of checkpoints to predictions; scores are computed once and looked up three times."""
    paths = required(rated, "rated clips").select("path").unionByName(scoring.paths_of_pairs(compared, "path_a", "path_b"))
    return predictions(rated, compared, cut(score_paths(paths, store, table, width, files)), mode)


def submissions(rated: DataFrame, compared: DataFrame, store: DataFrame, table: DataFrame, width: int, folder: str, files: DataFrame | None = None, mode: str = "clamp") -> dict[str, str]:
    """A zipped table of predictions for each checkpoint, all from one plan; the archives' paths by checkpoint.

    Predictions are written once, partitioned by checkpoint, below ``folder``.
    """
    spark, whole = rated.sparkSession, f"{folder}/predictions"
    predict(rated, compared, store, table, width, files, mode).write.mode("overwrite").partitionBy("checkpoint").parquet(whole)
    rows = spark.read.parquet(whole).withColumn("checkpoint", F.col("checkpoint").cast("string"))
    names = [r[0] for r in table.select("checkpoint").distinct().orderBy("checkpoint").collect()]
    return {name: writers.zip_predictions(rows.where(F.col("checkpoint") == name), f"{folder}/submission_{name}.zip") for name in names}


def cache_keys(rows: DataFrame) -> DataFrame:
    """Adds the key under which the store holds a path's features."""
    return rows.withColumn("cache_key", content_key(F.col("path")))
