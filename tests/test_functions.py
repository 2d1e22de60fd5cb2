"""Scalar column functions against literal cases and the plain-Python statements."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyref
from linkwork.functions import (
    clean_title, extract_domain, is_dangerous_url, levenshtein_ratio, normalize_url, py_title, sanitize_url,
    strip_ws, title_similarity,
)


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    rows = df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def run2(spark, fn, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    return [r.o for r in df.select("i", fn(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]


SANITIZE_CASES = [
    ('javascript:alert("xss")', ""), ('JAVASCRIPT:alert("XSS")', ""), ("data:text/html,<script>x</script>", ""),
    ('vbscript:msgbox("xss")', ""), ("file:///etc/passwd", ""), ("about:blank", ""),
    ("http://example.com", "http://example.com"), ("https://example.com", "https://example.com"),
    ("//example.com", "https://example.com"), ("example.com", "https://example.com"),
    ("www.example.com", "https://www.example.com"), ("", ""), (None, ""), ("   ", ""), ("http://", ""),
    ("https://", ""), ("HTTP://X.com/?#", "http://X.com/"), ("mailto:a@b.c", "https://mailto:a@b.c"),
    ("/rel", ""), ("#f", ""), ("https://e.com/a;", "https://e.com/a"), ("https://e.com/a;b", "https://e.com/a;b"),
    ("https://[::1", ""), ("  https://a.com/x y  ", "https://a.com/x y"),
]


def test_sanitize_cases(spark):
    got = run(spark, sanitize_url, [c[0] for c in SANITIZE_CASES])
    assert got == [c[1] for c in SANITIZE_CASES]


def test_dangerous_flag(spark):
    got = run(spark, is_dangerous_url, ["javascript:x", " About:blank", "https://a", None])
    assert got == [True, True, False, False]


def test_domain_cases(spark):
    cases = [("javascript:alert(1)", "unknown.com"), ("", "unknown.com"),
             ("https://evil.com/../../../etc/passwd", "evil.com"), ("https://www.example.com", "example.com"),
             ("https://sub.example.com", "sub.example.com"), ("http://A.com:80", "a.com:80")]
    assert run(spark, extract_domain, [c[0] for c in cases]) == [c[1] for c in cases]


NORMALIZE_CASES = [
    ("HTTPS://EXAMPLE.COM", "https://example.com"), ("https://example.com/", "https://example.com"),
    ("https://www.example.com", "https://example.com"), ("https://example.com:443", "https://example.com"),
    ("http://www.example.com", "http://example.com"), ("http://example.com:80", "http://example.com"),
    ("https://example.com?utm_source=google&utm_medium=cpc&utm_campaign=test", "https://example.com"),
    ("https://example.com?fbclid=123&gclid=456", "https://example.com"),
    ("https://example.com?page=1&utm_source=google&sort=date", "https://example.com?page=1&sort=date"),
    ("http://example.com:8080", "http://example.com:8080"), ("", ""), (None, ""),
    ("https://e.com/a/?b&c=%20x#t/", "https://e.com/a?b=&c=+x#t"),
]


def test_normalize_cases(spark):
    assert run(spark, normalize_url, [c[0] for c in NORMALIZE_CASES]) == [c[1] for c in NORMALIZE_CASES]


CLEAN_CASES = [
    ('<script>alert("xss")</script>Title', 'alert("xss")Title'), ("Title &lt;script&gt;", "Title  script"),
    ("Title &amp; Company", "Title   Company"), ('<img onerror="alert(1)" src="x">Title', "Title"),
    ("Normal Title", "Normal Title"), ("", "Untitled"), (None, "Untitled"),
    ("Capital One | Personal Banking Services & Products", "Capital One"),
    ("Charles Schwab | A modern approach to investing & retirement", "Charles Schwab"),
    ("On-line shop", "On-line shop"), ("Self-hosted git", "Self"), ("Indexing guide", "ing guide"),
    ("Homepage", "Untitled"), ("a" * 61, "a" * 57 + "..."), ("Welcome to Official Site Foo.", "Foo"),
]


def test_clean_title_cases(spark):
    assert run(spark, clean_title, [c[0] for c in CLEAN_CASES]) == [c[1] for c in CLEAN_CASES]


def test_similarity_cases(spark):
    pairs = [("Test Title", "test title"), ("GitHub Repository", "GitHub Project"), ("GitHub", "Facebook"),
             ("", ""), ("test", ""), (None, None)]
    got = run2(spark, title_similarity, pairs)
    assert got == pytest.approx([1.0, 1 / 3, 0.0, 1.0, 0.0, 1.0])


def test_levenshtein_cases(spark):
    pairs = [("test", "test"), ("abc", "xyz"), ("kitten", "sitting"), ("", ""), ("test", "")]
    assert run2(spark, levenshtein_ratio, pairs) == pytest.approx([1.0, 0.0, 4 / 7, 1.0, 0.0])


def test_title_case(spark):
    vals = ["ffxiv ember overlay", "abc1def", "o'neil x", "ÉCOLE été", "a_b", "  x  y"]
    assert run(spark, py_title, vals) == [v.title() for v in vals]


url_chars = st.sampled_from(list("aAbB09:/?#&=.%-_~*+; []@!$'()") + ["www.", "http://", "https://", "utm_source", "ref", "\t", "é"])
urls = st.lists(url_chars, max_size=14).map("".join)
text_chars = st.sampled_from(list("aBc |-:.,;<>&#!?") + [" ", " ", "\n", "...", "&amp;", "Index", "Home Page", "é"])
titles = st.lists(text_chars, max_size=16).map("".join)


@settings(max_examples=20, deadline=None)
@given(st.lists(urls, min_size=1, max_size=25))
def test_urls_property(spark, values):
    assert run(spark, sanitize_url, values) == [pyref.sanitize(v) for v in values]
    assert run(spark, extract_domain, values) == [pyref.domain(v) for v in values]
    expect = []
    for v in values:
        try:
            expect.append(pyref.normalize(v))
        except ValueError:
            expect.append(None)
    got = run(spark, normalize_url, values)
    for g, e, v in zip(got, expect, values):
        if e is not None:
            assert g == e, v


@settings(max_examples=20, deadline=None)
@given(st.lists(titles, min_size=1, max_size=25))
def test_titles_property(spark, values):
    assert run(spark, clean_title, values) == [pyref.clean(v) for v in values]
    assert run(spark, strip_ws, values) == [v.strip() for v in values]


def test_bracketed_hosts(spark):
    vals = ["[]", "https://[::1]:8080/x", "https://[1.2.3.4]/", "https://[v1.fe]/", "https://a[::1]/", "https://[::1]x/",
            "https://u@[fe80::1%25en0]/", "http://[x]@example.com/", "[::1", "http://[v1.a]@v1.b/"]
    assert run(spark, sanitize_url, vals) == [pyref.sanitize(v) for v in vals]
