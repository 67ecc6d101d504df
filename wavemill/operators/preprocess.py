"""Signal preprocessing: array to array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal


def filters(fs: float, low: float | None = 0.5, high: float | None = 40.0, notch_at: float | None = 60.0):
    """Arrow UDF: band-pass, then notch, both zero-phase, in one pass over the samples."""
    steps = []
    if low is not None and high is not None:
        steps.append(signal.band_pass(low, high, fs))
    if notch_at is not None:
        steps.append(signal.notch(notch_at, fs))

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = pd.Series([None] * len(s), dtype=object)
            length = s.map(lambda x: -1 if x is None else len(x)).to_numpy()
            for n in np.unique(length[length > 0]):
                at = np.flatnonzero(length == n)
                x = np.stack(s.iloc[at].to_list()).astype(float)
                for b, a in steps:
                    x = signal.zero_phase(b, a, x)
                for k, row in zip(at, x, strict=True):
                    out.iloc[k] = row
            yield out

    return run


def remove_artefacts(epochs: DataFrame, components: int = 10, rounds: int = 200) -> DataFrame:
    """Independent-component cleaning of each epoch; `ica_status` says whether it ran or the epoch was left as it is."""
    columns = epochs.columns

    def cleaned(stacks: list[np.ndarray | None]) -> list[tuple[np.ndarray | None, str]]:
        """Each epoch's cleaned channels; epochs of one shape at once, those that are not numbers left as they are."""
        out = [(None, "left")] * len(stacks)
        shapes = [x.shape if x is not None and np.isfinite(x).all() else None for x in stacks]
        for shape in set(shapes) - {None}:
            at = [k for k, s in enumerate(shapes) if s == shape]
            try:
                found = signal.drop_artefacts_each(np.stack([stacks[k] for k in at]), components, rounds)
            except np.linalg.LinAlgError:  # one epoch stops them all
                if len(at) > 1:
                    for k in at:
                        out[k] = cleaned([stacks[k]])[0]
                continue
            for k, x in zip(at, found, strict=True):
                out[k] = x, "cleaned"
        return out

    def stack(rows: pd.DataFrame) -> np.ndarray | None:
        try:
            x = np.stack(rows["samples"].to_list()).astype(float)
        except ValueError:
            return None
        return x if x.ndim == 2 and x.size else None

    def clean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def finished(pdf: pd.DataFrame) -> pd.DataFrame:
            _, first = np.unique(pd.factorize(pdf["epoch_id"], use_na_sentinel=False)[0], return_index=True)
            first = [*np.sort(first).tolist(), len(pdf)]
            spans = list(zip(first[:-1], first[1:], strict=True))
            samples, status = pdf["samples"].to_list(), []
            for (lo, hi), (x, word) in zip(spans, cleaned([stack(pdf.iloc[lo:hi]) for lo, hi in spans]), strict=True):
                if x is not None:
                    samples[lo:hi] = list(x)
                status += [word] * (hi - lo)
            return pdf.assign(samples=pd.Series(samples, index=pdf.index, dtype=object), ica_status=status)[[*columns, "ica_status"]]

        for part in parts:
            pdf = part if held is None else pd.concat([held, part], ignore_index=True)
            if len(pdf):  # the last epoch may go on
                ids = pd.factorize(pdf["epoch_id"], use_na_sentinel=False)[0]
                whole = int(np.flatnonzero(ids == ids[-1])[0])
                held = pdf.iloc[whole:].reset_index(drop=True)
                if whole:
                    yield finished(pdf.iloc[:whole].reset_index(drop=True))
        if held is not None:
            yield finished(held)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in epochs.schema.fields)
    return epochs.repartition("epoch_id").sortWithinPartitions("epoch_id", "channel").mapInPandas(clean, f"{fields}, ica_status string")


def preprocess(epochs: DataFrame, fs: float, low: float = 0.5, high: float = 40.0, notch_at: float | None = 60.0, ica: bool = True, components: int = 10) -> DataFrame:
    out = epochs.withColumn("samples", filters(fs, low, high, notch_at)("samples"))
    return remove_artefacts(out, components) if ica else out


def limit_epochs(epochs: DataFrame, n: int) -> DataFrame:
    """The first n epochs (0: all): a predicate on epoch_id, so that a scan can skip the rest."""
    return epochs.where(F.col("epoch_id") < n) if n else epochs


def project_channels(epochs: DataFrame, selected: list[int]) -> DataFrame:
    """The selected channels, renumbered in selection order."""
    place = F.create_map(*(F.lit(v) for c, p in zip(selected, range(len(selected)), strict=True) for v in (c, p)))
    return epochs.where(F.col("channel").isin(selected)).withColumn("channel", place[F.col("channel")])
