"""Exact small-sample inference on counts; plain numbers on the driver."""

from __future__ import annotations

import math
from itertools import product
from statistics import NormalDist


def sign_test_p(wins: int, losses: int) -> float:
    """Two-sided exact sign test over the pairs that differ; 1 without any."""
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def minimum_discordant_pairs(confidence: float = 0.95) -> int:
    """The least number of differing pairs that can reach the confidence at all."""
    return math.ceil(1 - math.log2(1 - confidence))


def wilson(successes: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Wilson interval of a share; the whole range for no trials."""
    if not n:
        return 0.0, 1.0
    z, p = NormalDist().inv_cdf((1 + confidence) / 2), successes / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, mid - half), min(1.0, mid + half)


def required_sample_size(sd: float, delta: float, alpha: float = 0.05, power: float = 0.8) -> int:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return max(2, math.ceil((z * sd / delta) ** 2))


def resolvable_delta(sd: float, n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    return (NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)) * sd / math.sqrt(n)


def randomization_p(deltas: list[float], exact_limit: int = 16) -> float:
    """One-sided exact sign-flip test of a mean above zero, for up to ``exact_limit`` differences that aren't zero."""
    d = [x for x in deltas if x]
    if len(d) > exact_limit:
        raise ValueError("too many differences for the exact test")
    if not d:
        return 1.0
    seen = sum(d)
    return sum(sum(s * abs(x) for s, x in zip(signs, d)) >= seen - 1e-12 for signs in product((1, -1), repeat=len(d))) / 2 ** len(d)


def kv_cache_mib(layers: int, width: int, context: int, window: int | None = None, every: int = 0) -> float:
    """Memory of keys and values in half precision; with a sliding window all layers but every ``every``-th keep the window only."""
    full = layers if not window else (layers // every if every else 0)
    return 2 * 2 * width * (full * context + (layers - full) * min(context, window or context)) / 2**20
