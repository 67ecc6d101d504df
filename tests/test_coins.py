"""Coins from md5 made many at once."""

import hashlib

import numpy as np

from wavemill.functions.coins import tails


def test_coins_are_those_of_md5():
    rows = ["1-0", "x" * 47, "y" * 48, "z" * 200, "", "äß-7", None, *(f"{k * 7919}-{k}" for k in range(200))]
    want = [[hashlib.md5("|".join(x for x in ("42", str(r), row) if x is not None).encode()).hexdigest()[0] < "8" for r in range(1, 1203)] for row in rows]
    assert (tails("42", 1, 1202, rows) == np.array(want)).all()
