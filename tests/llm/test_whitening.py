"""Embedding whitening against exact integer arithmetic and numpy's symmetric eigensolver."""

import math

import numpy as np
import pytest

from linkwork.llm.bidiagonal import bidiagonalise, directions, singular_squares
from linkwork.llm.whitening import whiten
from paths import SF_SMALL


def brute(rows, k=16):
    """``{(id, occurrence): (n, deviation, ...)}`` by Python integers and numpy."""
    keep = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in keep})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in keep:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = np.array([n * c - s for c, s in zip(x, sums)], dtype=float) / n
        out.append((i, dev, (y @ vectors) / np.sqrt(values)))
    return n, out, values / (centred**2).sum() * n


def check(spark, rows, got, k=16):
    n, want, explained = brute(rows, k)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error <= 1e-8
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert sum(len(x) for c in by.values() for x in c.values()) == len(want) * k
    signs = np.zeros(k)
    for i, dev, w in want:
        for c in range(k):
            value = by[i, dev][c + 1][0].whitened
            signs[c] = signs[c] or (np.sign(value * w[c]) if abs(w[c]) > 0.1 else 0)
    for i, dev, w in want:
        got_w = [by[i, dev][c + 1][0].whitened for c in range(k)]
        assert np.allclose(got_w, w * np.where(signs == 0, 1, signs), atol=1e-7)


def test_whole_table_against_numpy(spark):
    import __spark_entry__ as E

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check(spark, rows, E.queries()["op13_embedding_whitening"](spark, SF_SMALL).collect())


SCHEMA = "vec_id long, embedding array<float>, x int, id string, w double"


def test_bad_rows_copies_and_null_ids(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    rows = good + [(None, good[0][1]), (7, good[7][1]), (7, good[8][1]), (90, None), (91, [1.0, None, 2.0]),
                   (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in rows], SCHEMA).repartition(5)
    check(spark, rows, whiten(df).collect(), k=3)
    other = df.union(spark.createDataFrame([(95, [1.0], 1, "a", 0.5), (96, [], 1, "a", 0.5)], SCHEMA))
    check(spark, rows, whiten(other).collect(), k=3)


def test_rank_deficient_and_empty(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1, "a", 0.5) for i in range(20)], SCHEMA)
    got = whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 20
    assert got[0].explained == pytest.approx(1.0)
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "a", 0.5) for i in range(5)], SCHEMA)
    assert whiten(same).collect() == []
    assert whiten(same.limit(0)).collect() == []
    assert whiten(same.limit(0)).columns == whiten(line).columns


def test_common_vector_counts_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in rows], SCHEMA)
    check(spark, rows, whiten(df).collect(), k=4)


@pytest.mark.parametrize("kind", ["gauss", "graded", "equal", "cluster", "zero"])
def test_solver(kind):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 40))
    if kind == "graded":
        m *= np.logspace(-6, 0, 40)
    if kind == "equal":
        m = np.vstack([np.eye(40)] * 3)
    if kind == "cluster":
        m = np.linalg.qr(m)[0] * np.r_[np.ones(10), np.full(10, 1 - 1e-13), np.full(20, 0.1)]
        m = m @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    if kind == "zero":
        m[:, 3] = 0
    r = np.linalg.qr(m, mode="r")
    a, b, right = bidiagonalise(r)
    squares = singular_squares(a, b)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(squares, want, atol=1e-13 * want[0])
    z = right @ directions(a, b, squares[:16])
    assert np.abs(r.T @ (r @ z) - z * squares[:16]).max() < 1e-13 * want[0]
    assert np.abs(z.T @ z - np.eye(16)).max() < 1e-11
