"""Duplicate removal: the tool's demo records, keep strategies, fuzzy grouping vs a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

import pyref
from linkwork.operators.dedup import DedupConfig, duplicate_pairs, mark_duplicates, remove_duplicates

SCHEMA = "collection_id string, pos bigint, url string, formatted_label string, domain string, clean_title string"

DEMO = [
    (0, "https://example.com", "Example Site", "example.com"),
    (1, "https://www.example.com/", "Example Site", "example.com"),
    (2, "https://github.com", "GitHub", "github.com"),
    (3, "https://github.com?utm_source=google&utm_medium=cpc", "GitHub Homepage", "github.com"),
    (4, "https://STACKOVERFLOW.COM/questions", "Stack Overflow Questions", "stackoverflow.com"),
    (5, "https://stackoverflow.com/questions/", "Stack Overflow Q&A", "stackoverflow.com"),
    (6, "https://site1.com/python-tutorial", "Python Programming Tutorial", "site1.com"),
    (7, "https://site2.com/python-guide", "Python Programming Guide", "site2.com"),
    (8, "https://unique1.com", "Unique Site 1", "unique1.com"),
    (9, "https://unique2.com", "Unique Site 2", "unique2.com"),
]


def frame(spark, rows, cid="c"):
    return spark.createDataFrame([(cid, p, u, lab, d, lab) for p, u, lab, d in rows], SCHEMA)


def removed(spark, rows, **kw):
    m = mark_duplicates(frame(spark, rows), DedupConfig(**kw))
    return {r.pos for r in m.filter("removed").collect()}


@pytest.mark.parametrize("kw,expected", [
    (dict(strategy="url"), {1, 3, 5}),
    (dict(strategy="smart"), {1, 3, 5}),
    (dict(strategy="fuzzy", similarity_threshold=0.7), {1, 3, 5}),
    (dict(strategy="title"), {1}),
    (dict(strategy="fuzzy", similarity_threshold=0.9), {1}),
    (dict(strategy="fuzzy", similarity_threshold=0.85), {1, 3, 5}),
    (dict(strategy="url", keep_strategy="last"), {0, 2, 4}),
    (dict(strategy="url", keep_strategy="shortest"), {1, 3, 4}),
    (dict(strategy="url", keep_strategy="longest"), {1, 2, 5}),
    (dict(strategy="nonsense"), set()),
])
def test_demo_set(spark, kw, expected):
    assert removed(spark, DEMO, **kw) == expected


def test_four_rows_url_first(spark):
    rows = [(0, "https://example.com", "a", "example.com"), (1, "https://www.example.com", "b", "example.com"),
            (2, "https://example.com/", "c", "example.com"), (3, "https://other.com", "d", "other.com")]
    assert removed(spark, rows, strategy="url") == {1, 2}


def test_tracking_variants_last_pairwise_and_whole(spark):
    rows = [(0, "https://a.com?utm_source=x", "L0", "a.com"), (1, "https://a.com?fbclid=1", "L1", "a.com"),
            (2, "https://a.com", "L2", "a.com")]
    assert len(DEMO) == 10
    assert removed(spark, rows, strategy="url", keep_strategy="last") == {0}  # two left, as the tool does
    assert removed(spark, rows, strategy="url", keep_strategy="last", grouping="whole") == {0, 1}


@pytest.mark.parametrize("lens,keep,expected", [
    ((3, 2, 4), "first", {1, 2}), ((3, 2, 4), "last", {0}), ((3, 2, 4), "shortest", {0, 2}),
    ((3, 2, 4), "longest", {0, 1}), ((2, 2, 2), "first", {1, 2}), ((2, 2, 2), "last", {0}),
    ((2, 2, 2), "shortest", {1, 2}), ((2, 2, 2), "longest", {1, 2}), ((5, 2, 3), "shortest", {0}),
    ((5, 2, 3), "longest", {1, 2}),
])
def test_keep_triples(spark, lens, keep, expected):
    rows = [(i, "https://k.com", "x" * n, "k.com") for i, n in enumerate(lens)]
    assert removed(spark, rows, strategy="url", keep_strategy=keep) == expected


def test_fuzzy_not_transitive(spark):
    rows = [(0, "https://d.com", "a b", "d.com"), (1, "https://d.com", "b c", "d.com"), (2, "https://d.com", "c d", "d.com")]
    assert removed(spark, rows, strategy="fuzzy", similarity_threshold=0.75) == {1}


def test_three_sites_fuzzy_06(spark):
    rows = [(0, "https://a.com/x", "Alpha news", "a.com"), (1, "https://b.com/y", "Beta shop", "b.com"),
            (2, "https://c.com/z", "Gamma blog", "c.com")]
    assert removed(spark, rows, strategy="fuzzy", similarity_threshold=0.6) == set()


def test_scaling_set(spark):
    rows = [(i, f"https://unique{i}.com", f"u{i}", f"unique{i}.com") for i in range(800)]
    rows += [(800 + i, f"https://unique{i}.com", f"u{i}", f"unique{i}.com") for i in range(200)]
    kept = remove_duplicates(frame(spark, rows), DedupConfig(strategy="url"))
    assert kept.count() == 800


def _random_links(seed, n):
    rng = random.Random(seed)
    hosts = ["a.com", "www.a.com", "b.org", "a.com:443"]
    paths = ["", "/", "/x", "/x?utm_source=1", "/y"]
    words = ["alpha", "beta", "gamma", "delta", ""]
    out = []
    for i in range(n):
        url = "https://" + rng.choice(hosts) + rng.choice(paths)
        label = " ".join(w for w in rng.sample(words, rng.randint(0, 3)) if w)
        out.append((i * 3, url, label, pyref.domain(url)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("t", [0.95, 0.75, 0.45, 0.25, 0.1])
def test_fuzzy_matches_plain_loop(spark, seed, t):
    rows = _random_links(seed, 14)
    got = removed(spark, rows, strategy="fuzzy", similarity_threshold=t)
    recs = [(u, lab, d) for _, u, lab, d in rows]
    lens = [len(lab) for _, _, lab, _ in rows]
    exp = {rows[i][0] for i in pyref.keep_removed(pyref.fuzzy_groups(recs, t), lens, "first")}
    assert got == exp


@pytest.mark.parametrize("strategy", ["url", "smart"])
def test_pair_listing_order(spark, strategy):
    pairs = duplicate_pairs(mark_duplicates(frame(spark, DEMO), DedupConfig(strategy=strategy)), strategy)
    got = [(r.group_no, r.first_pos, r.dup_pos) for r in pairs.orderBy("group_no").collect()]
    assert got == [(1, 0, 1), (2, 2, 3), (3, 4, 5)]


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("t", [0.95, 0.8, 0.6, 0.3, 0.2])
def test_fuzzy_one_page_many_labels(spark, seed, t):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = []
    for i in range(60):
        host = rng.choice(["a.com", "www.a.com", "a.com:443"])
        label = "a.com | " + " ".join(rng.sample(words, rng.randint(1, 3)))
        rows.append((i * 2, "https://" + host + rng.choice(["/x", "/x/", f"/{i % 7}"]), label, pyref.domain("https://" + host)))
    got = removed(spark, rows, strategy="fuzzy", similarity_threshold=t)
    recs = [(u, lab, d) for _, u, lab, d in rows]
    lens = [len(lab) for _, _, lab, _ in rows]
    exp = {rows[i][0] for i in pyref.keep_removed(pyref.fuzzy_groups(recs, t), lens, "first")}
    assert got == exp


def test_fuzzy_chain_of_near_links(spark):
    """Each link is near the next one only: every second one leads, a round after the other."""
    rows = [(i, f"https://a.com/{i}", f"w{i} w{i + 1}", "a.com") for i in range(9)]
    assert removed(spark, rows, strategy="fuzzy", similarity_threshold=0.3) == {1, 3, 5, 7}


def test_fuzzy_late_class_of_likes(spark):
    """Unlike links first, then many likes of one another: they meet through their own first link."""
    rows = [(i, f"https://s{i}.com/{i}", f"u{i} common", f"s{i}.com") for i in range(50)]
    rows += [(50 + i, "https://hot.com/x", f"hot page common {i}", "hot.com") for i in range(300)]
    assert removed(spark, rows, strategy="fuzzy", similarity_threshold=0.85) == set(range(51, 350))


def test_comparison_signs_links_once_for_all_thresholds(spark, monkeypatch):
    from linkwork.operators import dedup, fuzzy

    calls = []
    plain = fuzzy._signature_rows
    monkeypatch.setattr(fuzzy, "_signature_rows", lambda *a: calls.append(1) or plain(*a))
    links = frame(spark, DEMO)
    got = dedup.strategy_comparison(links, thresholds=(0.7, 0.9)).filter("strategy = 'fuzzy'").collect()
    want = {t: len(removed(spark, DEMO, strategy="fuzzy", similarity_threshold=t)) for t in (0.7, 0.9)}
    assert {r.similarity_threshold: r.rows_removed for r in got} == want
    assert len(calls) == 3  # one for the comparison, two for ``want``


@pytest.mark.parametrize("keep", ["first", "last", "shortest", "longest"])
def test_fuzzy_keep_rules_over_nodes_of_several_rows(spark, keep):
    rows = [(0, "https://a.com/x", "b a", "a.com"), (1, "https://a.com/x", "a  b", "a.com"), (2, "https://a.com/x", "a b c", "a.com"),
            (3, "https://a.com/x", "c b a", "a.com"), (4, "https://z.org/q", "other words", "z.org")]
    lengths = {p: len(label) for p, _, label, _ in rows if p < 4}
    survivor = {"first": 0, "last": 3, "shortest": min(lengths, key=lambda p: (lengths[p], p)),
                "longest": min(lengths, key=lambda p: (-lengths[p], p))}[keep]
    assert removed(spark, rows, strategy="fuzzy", similarity_threshold=0.7, keep_strategy=keep) == {0, 1, 2, 3} - {survivor}
