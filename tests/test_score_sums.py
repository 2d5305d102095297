"""Sums of normal scores over ranges of ranks."""

import math
import random
from statistics import NormalDist

import pytest

from casemill.functions import special


def direct(first, last, n):
    normal, scores = NormalDist(), []
    for r in range(first, last + 1):
        near = min(r, n + 1 - r)
        z = normal.inv_cdf((near - 0.375) / (n + 0.25))
        scores.append(z if near == r else -z)
    return math.fsum(scores), math.fsum(z * z for z in scores)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 32, 33, 34, 35, 64, 100, 513, 5000, 10**9, 10**13])
def test_equal_to_a_direct_sum_anywhere(n):
    rng = random.Random(n)
    ends = [1, 2, 15, 16, 17, 18, 40, n // 2, n - 40, n - 17, n - 16, n - 15, n - 1, n]
    starts = sorted({r for r in ends if 1 <= r <= n})
    ranges = [(a, b) for a in starts for b in starts if a <= b <= a + 6000]
    ranges += [(a, min(n, a + rng.randrange(3000))) for a in (rng.randrange(1, n + 1) for _ in range(20))]
    for first, last in ranges:
        assert special.score_sums(first, last, n) == pytest.approx(direct(first, last, n), rel=1e-9, abs=1e-9), (first, last)


@pytest.mark.parametrize("n", [10**6, 10**12])
def test_ranges_add_up(n):
    cuts = [1, 9, 17, 300, n // 7, n // 2, n - 1000, n - 16, n - 3, n + 1]
    parts = [special.score_sums(a, b - 1, n) for a, b in zip(cuts, cuts[1:])]
    whole = special.score_sums(1, n, n)
    assert sum(p[0] for p in parts) == pytest.approx(whole[0], abs=1e-9 * n) and abs(whole[0]) < 1e-9 * n
    assert sum(p[1] for p in parts) == pytest.approx(whole[1], rel=1e-12)
    assert whole[1] < n and special.score_sums(5, 5, n)[0] == pytest.approx(float(special.normal_score(5, n)), rel=1e-8)
