"""Features of every epoch and channel, and their wide form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, signal

COMPLEXITY = ("sampen", "higuchi_fd", "dfa", "hurst")
SPECTRAL = tuple(f"bp_{b}" for b in signal.BANDS)
STFT = tuple(f"stft_bp_{b}" for b in signal.BANDS)


def _batches(samples: pd.Series):
    """Equally long, finite signals of a batch as 2-D arrays with their rows."""
    length = samples.map(lambda s: -1 if s is None else len(s)).to_numpy()
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        if n > 0:
            yield at, np.stack(samples.iloc[at].to_list()).astype(float)


def spectral(fs: float, stft: bool = False):
    """Arrow UDF: samples -> struct of band powers (null where they cannot be computed)."""
    names, bands = (STFT, signal.stft_bands) if stft else (SPECTRAL, signal.welch_bands)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def powers(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = np.full((len(s), len(names)), np.nan)
            for at, x in _batches(s):
                for k, v in enumerate(bands(x, fs).values()):
                    out[at, k] = v
            yield pd.DataFrame(out, columns=list(names))

    return powers


def complexity(names: tuple[str, ...] = COMPLEXITY):
    """Arrow UDF: samples -> struct of the named entropy, fractal and fluctuation measures, signals of a length at once."""
    measure = dict(zip(COMPLEXITY, (signal.sample_entropy, signal.higuchi, signal.dfa, signal.hurst), strict=True))

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def measures(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = np.full((len(s), len(names)), np.nan)
            for at, x in _batches(s):
                if x.shape[1] > 3:
                    for k, name in enumerate(names):
                        out[at, k] = measure[name](x)
            yield pd.DataFrame(out, columns=list(names))

    return measures


def register(spark, fs: float) -> None:
    """The feature functions under names for SQL: band_powers, stft_powers and complexity of an array of samples."""
    for name, function in (("band_powers", spectral(fs)), ("stft_powers", spectral(fs, stft=True)), ("complexity", complexity())):
        spark.udf.register(name, function)


def extract(epochs: DataFrame, fs: float, complexity_features: bool = True, time: bool = False, stft: bool = False) -> DataFrame:
    """epochs with one column per feature; NaN becomes null."""
    x, out, names = F.col("samples"), epochs, []
    if complexity_features:
        out = out.withColumns({"perm_ent": arrays.permutation_entropy(x), "svd_ent": arrays.svd_entropy(x), "petrosian_fd": arrays.petrosian(x), "__c": complexity()(x), "__s": spectral(fs)(x)})
        out = out.select("*", "__c.*", "__s.*").drop("__c", "__s")
        names += ["perm_ent", "svd_ent", "petrosian_fd", *COMPLEXITY, *SPECTRAL]
    if time:
        out = out.withColumns({n: f(x) for n, f in arrays.TIME_FEATURES.items()})
        names += list(arrays.TIME_FEATURES)
    if stft:
        out = out.withColumn("__t", spectral(fs, stft=True)(x)).select("*", "__t.*").drop("__t")
        names += list(STFT)
    return out.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names})


def wide(features: DataFrame, names: list[str], channels: list[int]) -> DataFrame:
    """One row per epoch with columns ch{channel}_{feature} in lexicographic order."""
    pivoted = features.groupBy("epoch_id").pivot("channel", channels).agg(*(F.first(n).alias(n) for n in names))
    named = {f"ch{c}_{n}": (f"{c}_{n}" if len(names) > 1 else str(c)) for c in channels for n in names}
    return pivoted.select("epoch_id", *(F.col(f"`{named[k]}`").alias(k) for k in sorted(named)))


def channel_summary(epochs: DataFrame, fs: float) -> DataFrame:
    """epoch_id, channel, y, rms and the four band powers: what channel selection looks at."""
    out = epochs.withColumns({"rms": arrays.rms(F.col("samples")), "__s": spectral(fs)("samples")})
    return out.select("epoch_id", "channel", "y", "rms", "__s.*")
