"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACR_RANGE = (1.0, 5.0)
CCR_RANGE = (-3.0, 3.0)


def missing_as_null(value: Column) -> Column:
    """NaN becomes NULL; inside the engine NULL alone means a missing value."""
    return F.when(~F.isnan(value), value)


def clamp(value: Column, lo: float, hi: float) -> Column:
    """``value`` held within [lo, hi]; a missing value gives ``lo``."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), missing_as_null(value)))


def rescale(value: Column, least: Column, most: Column, lo: float, hi: float) -> Column:
    """Linear map of [least, most] to [lo, hi]; a constant input gives ``lo``."""
    share = F.try_divide(value - least, most - least)
    return F.when(most == least, F.lit(lo)).otherwise(F.lit(lo) + share * (hi - lo))


def first_token(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *parts)


def content_key(path: Column, suffix: str = ".npy") -> Column:
    """The feature store's key of a clip: md5 of its path."""
    return F.concat(F.md5(path), F.lit(suffix))


def ramp(epoch: Column, target: float, length: int) -> Column:
    """Grows linearly to ``target`` over ``length`` epochs; at once if ``length`` is 0."""
    return F.lit(float(target)) if length == 0 else F.least(F.lit(float(target)), epoch * (target / length))


def decayed_rate(epoch: Column, rate: float, gamma: float) -> Column:
    return F.lit(rate) * F.pow(F.lit(gamma), epoch - 1)


def epoch_name(epoch: Column) -> Column:
    return F.format_string("epoch_%03d", epoch.cast("int"))


def default_lookup(key: Column, table: dict[str, int], default: int) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


#: Feature sizes of the public speech encoders by name, and of any other.
ENCODER_SIZES = {"openai/whisper-tiny": 384, "openai/whisper-base": 512, "openai/whisper-small": 768, "openai/whisper-medium": 1024, "openai/whisper-large-v3": 1280}
DEFAULT_ENCODER_SIZE = 1024
