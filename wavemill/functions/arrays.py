"""Time-domain and ordinal features of a sample array, as Column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def moment(x: Column, k: int) -> Column:
    """Central population moment of order k."""
    power = lambda d: d * d if k == 2 else F.pow(d, F.lit(k))
    return let(mean(x), lambda m: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + power(v - m)), F.size(x)))


def std(x: Column) -> Column:
    return F.sqrt(moment(x, 2))


def skewness(x: Column) -> Column:
    return F.try_divide(moment(x, 3), F.pow(moment(x, 2), F.lit(1.5)))


def kurtosis(x: Column) -> Column:
    """Excess, biased."""
    return F.try_divide(moment(x, 4), F.pow(moment(x, 2), F.lit(2.0))) - 3


def peak_to_peak(x: Column) -> Column:
    return F.array_max(x) - F.array_min(x)


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v), F.size(x)))


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b - a)


def petrosian(x: Column) -> Column:
    """Petrosian fractal dimension from the sign changes of the first difference."""
    n = F.size(x).cast("double")
    pairs = lambda d: F.zip_with(F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), lambda b, a: b * a)
    turns = let(differences(x), lambda d: F.size(F.filter(pairs(d), lambda v: v < 0)))
    return F.when(n >= 3, F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * turns))))


def _entropy(shares: Column) -> Column:
    """Entropy in bits of an array of shares."""
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def permutation_entropy(x: Column) -> Column:
    """Normalised entropy of the ordinal patterns of three consecutive samples; equal samples keep their order."""
    n = F.size(x) - 2
    code = lambda i: (F.get(x, i) <= F.get(x, i + 1)).cast("int") * 4 + (F.get(x, i) <= F.get(x, i + 2)).cast("int") * 2 + (F.get(x, i + 1) <= F.get(x, i + 2)).cast("int")
    codes = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), code)
    count = lambda all_, k: F.size(F.filter(all_, lambda c: c == k)).cast("double")
    shares = let(codes, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: count(all_, k) / n))
    return F.when(n > 0, _entropy(shares) / 2.584962500721156)


def svd_entropy(x: Column) -> Column:
    """Normalised entropy of the singular values of the 3-sample delay embedding, from its 3 x 3 Gram matrix.

    The eigenvalues of the symmetric Gram matrix have a closed (trigonometric) form, so no decomposition is needed.
    """
    n = F.size(x) - 2
    cut = lambda k: F.slice(x, k + 1, F.greatest(n, F.lit(0)))
    dot = lambda i, j: F.aggregate(F.zip_with(cut(i), cut(j), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    gram = F.struct(*(dot(i, j).alias(name) for name, i, j in (("a", 0, 0), ("b", 1, 1), ("c", 2, 2), ("d", 0, 1), ("e", 0, 2), ("f", 1, 2))))

    def eigenvalues(g: Column) -> Column:
        a, b, c, d, e, f = (g[k] for k in "abcdef")

        def spread(q: Column) -> Column:
            p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6)
            det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
            r = lambda p: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0))))
            third = 2.0943951023931953
            return let(p, lambda p: let(F.acos(r(p)) / 3, lambda phi: F.array(*(q + 2 * p * F.cos(phi + k * third) for k in range(3)))))

        return let((a + b + c) / 3, spread)

    values = F.transform(let(gram, eigenvalues), lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))
    shares = let(values, lambda v: let(total(v), lambda s: F.transform(v, lambda w: F.try_divide(w, s))))
    return F.when(n > 0, let(shares, lambda p: F.when(F.get(p, F.lit(0)).isNotNull(), _entropy(p) / 1.584962500721156)))


TIME_FEATURES = {"mean": mean, "std": std, "skew": skewness, "kurt": kurtosis, "ptp": peak_to_peak, "rms": rms}
