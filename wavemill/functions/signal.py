"""Small numpy helpers over a batch of equally long signals, (rows, samples); Spark hands them Arrow batches."""

from __future__ import annotations

from functools import wraps

import numpy as np

#: Pairs of templates compared at once.
PAIRS = 1 << 21
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def _trapezoid(power: np.ndarray, freq: np.ndarray) -> dict[str, np.ndarray]:
    """Area under each band's own bins (0 where a band has fewer than two)."""
    out = {}
    for name, (low, high) in BANDS.items():
        inside = np.flatnonzero((freq >= low) & (freq < high))
        out[name] = np.trapezoid(power[..., inside], freq[inside], axis=-1) if len(inside) > 1 else np.zeros(power.shape[:-1])
    return out


def _frames(x: np.ndarray, size: int) -> np.ndarray:
    step = size - size // 2
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::step, :]


def _window(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)


def welch_bands(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Band power from mean periodograms: Hann, half overlap, each segment's mean removed, one-sided density."""
    size = min(256, x.shape[-1])
    w = _window(size)
    seg = _frames(x, size)
    z = np.fft.rfft((seg - seg.mean(-1, keepdims=True)) * w, axis=-1)
    power = np.abs(z) ** 2 / (fs * (w**2).sum())
    power[..., 1 : (size + 1) // 2] *= 2
    return _trapezoid(power.mean(-2), np.fft.rfftfreq(size, 1 / fs))


def stft_bands(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Band power per frame of a short-time transform (zero boundary, padded, spectrum scaling), averaged over frames."""
    size = min(256, x.shape[-1])
    w, half, step = _window(size), size // 2, size - size // 2
    n = x.shape[-1] + 2 * half
    x = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half + (-(n - size)) % step)])
    z = np.fft.rfft(_frames(x, size) * w, axis=-1) / w.sum()
    return {k: v.mean(-1) for k, v in _trapezoid(np.abs(z) ** 2, np.fft.rfftfreq(size, 1 / fs)).items()}


def _each(measure):
    """A measure of signals (rows of equal length) that takes one signal as well."""

    @wraps(measure)
    def run(x: np.ndarray, *args, **options):
        x = np.asarray(x, float)
        return measure(x, *args, **options) if x.ndim > 1 else float(measure(x[None], *args, **options)[0])

    return run


def _slopes(at: list[float], values: np.ndarray) -> np.ndarray:
    """Least-squares slope over `at` of each row's finite values; NaN for fewer than two."""
    ok = np.isfinite(values)
    n, t = ok.sum(1), np.array(at)
    v = np.where(ok, values, 0.0)
    with np.errstate(all="ignore"):
        centre = ok @ t / n
        away = np.where(ok, t - centre[:, None], 0.0)
        slope = (away * v).sum(1) / (away * away).sum(1)
    return np.where(n > 1, slope, np.nan)


@_each
def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> np.ndarray:
    """-ln of the ratio of template matches of length m + 1 and m within r standard deviations (maximum norm).

    Templates are sorted by their first value, so that each is compared only with those whose first value is in reach; the
    pairs of many signals are compared at once.
    """
    count, length = x.shape
    n = length - m
    if n < 2:
        return np.full(count, np.nan)
    s = x.std(1)
    tolerance = (r if 0 < r < 1 else 0.2) * np.where(s > 0, s, 1.0)
    order = np.argsort(x[:, :n], axis=1, kind="stable")
    grams = np.lib.stride_tricks.sliding_window_view(x, m + 1, axis=1)[np.arange(count)[:, None], order]
    first = grams[:, :, 0]
    with np.errstate(invalid="ignore"):
        reach = np.stack([np.searchsorted(a, a + t * (1 + 1e-9), side="right") for a, t in zip(first, tolerance, strict=True)])
    partners = np.maximum(reach - 1 - np.arange(n), 0).ravel()
    grams, ends = grams.reshape(-1, m + 1), np.cumsum(partners)
    short, long, begin = np.zeros(count), np.zeros(count), 0
    while begin < len(partners):
        stop = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")), begin + 1)
        some = partners[begin:stop]
        i = np.repeat(np.arange(begin, stop), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        near = np.abs(grams[i] - grams[j]) <= tolerance[i // n][:, None]
        alike = near[:, :m].all(1)
        short += np.bincount(i[alike] // n, minlength=count)
        alike &= near[:, m]
        long += np.bincount(i[alike] // n, minlength=count)
        begin = stop
    with np.errstate(all="ignore"):
        return np.where((short > 0) & (long > 0), -np.log(long / short), np.nan)


@_each
def higuchi(x: np.ndarray, kmax: int = 10) -> np.ndarray:
    n, at, logs = x.shape[1], [], []
    for k in range(1, kmax + 1):
        lengths = []
        for m in range(k):
            count = (n - m - 1) // k
            if count > 0:
                path = np.abs(np.diff(x[:, m : m + count * k + 1 : k], axis=1)).sum(1)
                lengths.append(path / k * (n - 1) / (k * count))
        if lengths:
            with np.errstate(divide="ignore"):
                logs.append(np.log(np.mean(lengths, axis=0)))
            at.append(np.log(1 / k))
    return _slopes(at, np.stack(logs, 1)) if logs else np.full(len(x), np.nan)


def _log_windows(low: int, high: int, factor: float) -> list[int]:
    out, w = [], float(low)
    while w <= high:
        if int(w) not in out:
            out.append(int(w))
        w *= factor
    return out


@_each
def dfa(x: np.ndarray) -> np.ndarray:
    """Detrended fluctuation exponent over log-spaced windows of 4 to a tenth of the signal."""
    length, at, logs = x.shape[1], [], []
    walk = np.cumsum(x - x.mean(1, keepdims=True), axis=1)
    for w in _log_windows(4, max(length // 10, 8), 1.2):
        parts = walk[:, : length // w * w].reshape(len(x), -1, w)
        if not parts.shape[1]:
            continue
        t = np.arange(w) - (w - 1) / 2
        slope = parts @ t / (t @ t)
        rest = parts - parts.mean(2, keepdims=True) - slope[:, :, None] * t
        with np.errstate(divide="ignore"):
            logs.append(np.log(np.sqrt((rest**2).mean(2)).mean(1)))
        at.append(np.log(w))
    return _slopes(at, np.stack(logs, 1)) if logs else np.full(len(x), np.nan)


@_each
def hurst(x: np.ndarray) -> np.ndarray:
    """Rescaled-range exponent over doubling windows from 8."""
    length, at, logs, w = x.shape[1], [], [], 8
    while w <= length // 2:
        parts = x[:, : length // w * w].reshape(len(x), -1, w)
        walk = np.cumsum(parts - parts.mean(2, keepdims=True), axis=2)
        spread, s = walk.max(2) - walk.min(2), parts.std(2)
        with np.errstate(all="ignore"):
            logs.append(np.log(np.where(s > 0, spread / s, 0.0).sum(1) / (s > 0).sum(1)))
        at.append(np.log(w))
        w *= 2
    return _slopes(at, np.stack(logs, 1)) if logs else np.full(len(x), np.nan)


def band_pass(low: float, high: float, fs: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth band-pass coefficients by the bilinear transform with prewarped edges."""
    edges = np.clip(np.array([low, high]) / (fs / 2), 0.0001, 0.9999)
    warped = 4 * np.tan(np.pi * edges / 2)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2)
    analog = np.r_[poles + root, poles - root]
    digital = (4 + analog) / (4 - analog)
    gain = (width**order * 4.0**order / np.prod(4 - analog)).real
    return gain * np.poly(np.r_[np.ones(order), -np.ones(order)]), np.poly(digital).real


def notch(freq: float, fs: float, quality: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * np.pi * freq / fs
    g = 1 / (1 + np.tan(w / quality / 2))
    return g * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * g * np.cos(w), 2 * g - 1])


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Transposed direct form, sample by sample, for all rows of a batch at once."""
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + state[:, 0]
        state[:, :-1] = state[:, 1:] + np.outer(x[:, t], b[1:-1]) - np.outer(out[:, t], a[1:-1])
        state[:, -1] = b[-1] * x[:, t] - a[-1] * out[:, t]
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards with odd padding of three times the filter's length and settled start states."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        raise ValueError(f"signals must be longer than {pad} samples")
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    m = len(a) - 1
    companion = np.eye(m) - np.eye(m, k=1)
    companion[:, 0] += a[1:]
    start = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    y = _filter(b, a, ext, ext[:, :1] * start)
    y = _filter(b, a, y[:, ::-1], y[:, -1:] * start)[:, ::-1]
    return y[:, pad:-pad]


def drop_artefacts(x: np.ndarray, components: int = 10, rounds: int = 200, limit: float = 5.0, seed: int = 97) -> np.ndarray:
    """Independent components (channels, samples) by fixed-point iteration; those of |unbiased kurtosis| > limit go."""
    centre = x.mean(1, keepdims=True)
    u, s, _ = np.linalg.svd(x - centre, full_matrices=False)
    k = min(components, int((s > s[0] * 1e-9).sum())) if s[0] > 0 else 0
    if k < 2 or x.shape[1] < 4:
        return x
    n = x.shape[1]
    white = (u[:, :k] / s[:k]).T * np.sqrt(n)
    z = white @ (x - centre)
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(w @ z)
        p, _, q = np.linalg.svd(g @ z.T / n - np.diag((1 - g**2).mean(1)) @ w)
        new = p @ q
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-4
        w = new
        if done:
            break
    sources = w @ z
    d = sources - sources.mean(1, keepdims=True)
    g2 = (d**4).mean(1) / (d**2).mean(1) ** 2 - 3
    unbiased = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    sources[np.abs(unbiased) > limit] = 0
    return (u[:, :k] * s[:k] / np.sqrt(n)) @ (w.T @ sources) + centre


def drop_artefacts_each(x: np.ndarray, components: int = 10, rounds: int = 200, limit: float = 5.0, seed: int = 97) -> np.ndarray:
    """drop_artefacts of many epochs of one shape (epochs, channels, samples); an epoch iterates until it has converged."""
    n, out = x.shape[2], x.copy()
    centre = x.mean(2, keepdims=True)
    u, s, _ = np.linalg.svd(x - centre, full_matrices=False)
    ranks = np.where(s[:, 0] > 0, np.minimum(components, (s > s[:, :1] * 1e-9).sum(1)), 0)
    for k in np.unique(ranks[ranks >= 2]).tolist() if n >= 4 else []:
        at = np.flatnonzero(ranks == k)
        u_k, s_k = u[at][:, :, :k], s[at][:, None, :k]
        z = (u_k / s_k).transpose(0, 2, 1) * np.sqrt(n) @ (x[at] - centre[at])
        w = np.repeat(np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0][None], len(at), 0)
        left, z_left, w_left = np.arange(len(at)), z, w
        for _ in range(rounds):
            g = np.tanh(w_left @ z_left)
            p, _, q = np.linalg.svd(g @ z_left.transpose(0, 2, 1) / n - (1 - g**2).mean(2)[:, :, None] * w_left)
            new = p @ q
            done = np.abs(np.abs((new * w_left).sum(2)) - 1).max(1) < 1e-4
            w[left] = new
            left, z_left, w_left = left[~done], z_left[~done], new[~done]
            if not len(left):
                break
        sources = w @ z
        d = sources - sources.mean(2, keepdims=True)
        g2 = (d**4).mean(2) / (d**2).mean(2) ** 2 - 3
        unbiased = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        sources[np.abs(unbiased) > limit] = 0
        out[at] = (u_k * s_k / np.sqrt(n)) @ (w.transpose(0, 2, 1) @ sources) + centre[at]
    return out
