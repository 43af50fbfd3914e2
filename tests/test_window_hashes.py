"""Hashes of windows by prefix sums are the polynomials they stand for."""

import numpy as np

from codelake.operators.analyses import BASES, _window_hashes


def test_prefix_sums_give_each_window_polynomial():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (7, 1), (7, 7), (50, 3), (400, 100)):
        t = rng.integers(0, 2**64, n, dtype=np.uint64)
        for base in BASES:
            want = [sum(int(t[i + j]) * pow(base, k - 1 - j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(n - k + 1)]
            assert _window_hashes(t, base, k).tolist() == want
