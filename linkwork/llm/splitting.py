"""Keyed permutations and the hypergeometric splitting tree (operator 12)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shards into which one task splits a node of the tree; a round of Spark goes that much deeper.
FAN = 64
#: Beyond this population numpy's sampler refuses; the window sampler below takes over.
NUMPY_LIMIT = 10**9


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising hash of unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(value: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Place of each ``value`` in the permutation of ``0..size-1`` named by ``key``.

    A balanced Feistel network over the least even number of bits that hold ``size``; values that leave the range
    are sent through again until they are back, which keeps it a permutation.
    """
    size = size.astype(np.int64)
    bits = np.zeros(len(size), dtype=np.int64)
    for b in range(1, 63):  # bits of size - 1
        bits += (size - 1) >> (b - 1) > 0
    half = np.maximum((bits + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = key.astype(np.int64).view(np.uint64)
    out = value.astype(np.int64).view(np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(rounds):
                left, right = right, left ^ (_mixed(right + k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= size[todo].view(np.uint64)]
    return out.view(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, for populations of any size.

    Beyond numpy's limit by inversion over a window of twelve deviations around the mode, built from ratios of
    neighbouring probabilities; what lies outside weighs less than a rounding error.
    """
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    p = good / total
    wide = int(12 * (draws * p * (1 - p) * (total - draws) / (total - 1)) ** 0.5) + 12
    first, last = max(low, mode - wide), min(high, mode + wide)
    x = np.arange(first, last, dtype=float)
    steps = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return first + int(min(at, len(weights) - 1))


def _halves(quotas: list[int], part: int, rng: np.random.Generator) -> list[int]:
    """A multivariate hypergeometric draw of ``part`` blocks: how many of each source go left."""
    rest, out = sum(quotas), []
    for q in quotas:
        rest -= q
        x = hypergeometric(rng, q, rest, part)
        part -= x
        out.append(x)
    return out


def _seeds(seed: int, lo: int, hi: int) -> np.random.Generator:
    return np.random.default_rng([seed, lo, hi])


def _leaves(lo: int, hi: int, grain: int, quotas: list[int], begins: list[int], seed: int):
    """Nodes of at most ``grain`` shards below ``[lo, hi)``: ``lo, hi, quotas, begins``."""
    if hi - lo <= grain:
        yield lo, hi, quotas, begins
        return
    mid = (lo + hi) // 2
    left = _halves(quotas, sum(quotas) * (mid - lo) // (hi - lo), _seeds(seed, lo, hi))
    yield from _leaves(lo, mid, grain, left, begins, seed)
    right = [q - x for q, x in zip(quotas, left)]
    yield from _leaves(mid, hi, grain, right, [b + x for b, x in zip(begins, left)], seed)


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, source, begin, quota`` from ``source, quota``: the run of a source's draws that each shard gets.

    The root holds every source's quota.  A node of several shards draws how many blocks of each source its left
    half gets, from a generator seeded by the node's own place, and hands the rest to the right.  A task splits a
    node ``FAN`` ways, so a million shards take four rounds; it holds one number per source.  Nothing depends on
    which task does it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", kind="stable")
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        names = pdf["source"].to_numpy()
        rows = {"lo": [], "hi": [], "source": [], "quota": [], "begin": []}
        grain = max(1, -(-(hi - lo) // FAN))
        for l, h, qs, bs in _leaves(lo, hi, grain, [int(x) for x in pdf["quota"]], [int(x) for x in pdf["begin"]], seed):
            for name, q, b in zip(names, qs, bs):
                if q:
                    for c, v in zip(rows, (l, h, name, q, b)):
                        rows[c].append(v)
        return pd.DataFrame(rows)

    kind = "lo long, hi long, source string, quota long, begin long"
    whole = quotas.where("quota > 0").select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "source", "quota", F.lit(0).cast("long").alias("begin"))
    nodes, wide = whole, shards
    while wide > 1:
        nodes = nodes.groupBy("lo", "hi").applyInPandas(run, kind)
        wide = -(-wide // FAN)
    return nodes.select(F.col("lo").alias("shard"), "source", "begin", "quota")
