"""Source mixing: targets by bisection, takes against the targets, the mix's own rules, and the samplers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from linkwork.llm.mixing import mix, shares, taken, word_counts
from linkwork.llm.splitting import _halves, hypergeometric, permuted
from paths import SF_MID, SF_SMALL

WORD = re.compile("[^\x20\x09-\x0D]+")


def words_of(text):
    return len(WORD.findall(text or ""))


def levels(sizes):
    """Targets by bisection on the level at which the shares by weight fill up."""
    total = sum(sizes)
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 3.0 * total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * z, mid * w) for z, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(3 * z, hi * w) for z, w in zip(sizes, weights)]


def check(docs, got):
    """``docs``: (id, text, source); ``got``: rows of ``taken``."""
    by = defaultdict(int)
    for _, text, source in docs:
        by[source] += words_of(text)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    target = dict(zip(names, levels([by[s] for s in names])))
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, words_of(t), by[s]) for i, t, s in docs)
    source_of = {}
    if len({i for i, _, _ in docs}) == len(docs):
        source_of = {i: s for i, _, s in docs}
    sums = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.source_size:  # every block as often as the source's whole epochs, at most once more
            epochs = int(r.target + 0.5) // r.source_size
            assert epochs * r.size <= r.taken <= (epochs + 1) * r.size
        if source_of:
            assert r.target == pytest.approx(target[source_of[r.doc_id]], rel=1e-9)
            sums[source_of[r.doc_id]] += r.taken
    for s, n in sums.items():
        assert abs(n - target[s]) <= 0.5 + 1e-6
    assert abs(sum(r.taken for r in got) - sum(by.values())) <= len(by)


def rows(spark, path):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def test_query_meets_targets(spark):
    import __spark_entry__ as E

    check(rows(spark, SF_MID), E.queries()["op12_source_mixing"](spark, SF_MID).collect())


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = ["doc_id", "size", "source_size", "target", "taken", "shard", "place"]
    one = taken(docs, block_words=64, shard_words=5000).select(columns).collect()
    two = taken(docs.repartition(13), block_words=64, shard_words=5000).select(columns).collect()
    assert sorted(one) == sorted(two)
    other = taken(docs, block_words=64, shard_words=5000, seed=5).select(columns).collect()
    assert sorted(one) != sorted(other)


def test_pieces_are_disjoint_and_shards_even(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = mix(docs, block_words=64, shard_words=5000)
    size = {r["at"]: r["size"] for r in out.documents.collect()}
    places, spans, blocks = defaultdict(list), defaultdict(list), defaultdict(set)
    for p in out.pieces.collect():
        places[p.shard].append(p.place)
        spans[p["at"], p.epoch].append((p["first"], p["first"] + p.words))
        blocks[p.shard].add((p.source, p.draw))
    for shard, seen in places.items():
        assert sorted(seen) == list(range(1, len(seen) + 1))
    for (at, _), parts in spans.items():
        parts.sort()
        assert parts[0][0] >= 0 and parts[-1][1] <= size[at]
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    counts = [len(x) for x in blocks.values()]
    assert max(counts) - min(counts) <= int(np.log2(len(counts))) + 1
    assert sum(counts) == len(set().union(*blocks.values()))  # no draw in two shards


DOCS = "doc_id long, text string, source string, size int, at string, place double"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, s, 1, "x", 0.5) for i, t, s in docs], DOCS)


def test_nulls_copies_hot_and_long(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 50, n))
    docs = [(i, say(int(rng.integers(1, 60))), "hot" if i % 3 else f"s{i % 5}") for i in range(200)]
    docs += [(1000, say(20000), "long"), (1001, None, "s0"), (1002, " \t\n", "none"), (1003, "a\x0bb\x1fc", None), (1004, "", ""), (1005, "é ü x", "")]
    check(docs, taken(frame(spark, docs).repartition(7), block_words=32, shard_words=500).collect())
    copies = docs + [(5, "same words here", "s1")] * 40 + [(None, "no id at all", None)] * 7 + [(None, "other", "hot")]
    check(copies, taken(frame(spark, copies), block_words=32, shard_words=500).collect())


def test_empty_tables(spark):
    none = frame(spark, [(1, "a", "b")]).limit(0)
    assert taken(none).collect() == []
    blank = [(1, None, "a"), (2, "", None)]
    got = taken(frame(spark, blank)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


@pytest.mark.parametrize("sizes", [[10], [1, 1000], [1000, 1], [5, 0, 5], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3], [0, 0], [7, 7, 7000]])
def test_shares(sizes):
    assert shares(sizes) == pytest.approx(levels(sizes), rel=1e-9, abs=1e-9)


def test_word_counts_of_slices():
    texts = ["a b", None, "", " x", "y ", "z", "　é\x0c1", "a" * 50, "   "] * 3
    for at in range(5):
        column = pa.array(texts).slice(at, 15)
        assert word_counts(column).tolist() == [words_of(t) for t in texts[at: at + 15]]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 100, 1025])
def test_permutation(size):
    got = permuted(np.arange(size), np.full(size, size), np.full(size, -77))
    assert sorted(got) == list(range(size))
    if size > 10:
        assert not np.array_equal(got, permuted(np.arange(size), np.full(size, size), np.full(size, -76)))


def test_hypergeometric_window_beyond_numpy(monkeypatch):
    import linkwork.llm.splitting as splitting

    monkeypatch.setattr(splitting, "NUMPY_LIMIT", 10)
    rng = np.random.default_rng(0)
    got = np.array([hypergeometric(rng, 60, 140, 50) for _ in range(4000)])
    want = np.random.default_rng(1).hypergeometric(60, 140, 50, 4000)
    assert abs(got.mean() - 15) < 0.2 and abs(got.var() - want.var()) < 1.0
    assert hypergeometric(rng, 10**12, 10**12, 10**12) == pytest.approx(5 * 10**11, rel=1e-4)
    edge = [hypergeometric(rng, 3, 20, 22) for _ in range(200)]
    assert set(edge) <= {2, 3} and hypergeometric(rng, 5, 0, 4) == 4 and hypergeometric(rng, 0, 50, 4) == 0


def test_halves_are_exact():
    rng = np.random.default_rng(0)
    for _ in range(200):
        quotas = rng.integers(0, 30, 6).tolist()
        part = int(rng.integers(0, sum(quotas) + 1))
        left = _halves(quotas, part, rng)
        assert sum(left) == part and all(0 <= x <= q for x, q in zip(left, quotas))
