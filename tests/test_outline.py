"""Outline parsing (S4/W6) and matching."""

from linkwork.operators.labels import build_links
from linkwork.operators.outline import match_outline, outline_entries
from linkwork.sources.outline import outline_lines

OWN_OUTLINE = """FOLDER: Cooking
  bread.example | Sourdough basics
  soup.example | Soups

  FOLDER: Baking
    cake.example | Cakes

FOLDER: Travel
  rail.example | Night trains
  ferry.example | Ferries

FOLDER: Garden
  seed.example | Seeds
"""


def entries(spark, texts):
    df = spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(texts)], "collection_id string, text string")
    return outline_entries(outline_lines(df))


def test_readme_outline(spark):
    rows = entries(spark, [OWN_OUTLINE]).filter("kind = 'bookmark'").groupBy("folder_path").count().collect()
    assert {r.folder_path: r["count"] for r in rows} == {
        "Cooking": 2, "Cooking/Baking": 1, "Travel": 2, "Garden": 1}


def paths(spark, text):
    return [(r.kind, r.folder_path, r.title) for r in entries(spark, [text]).orderBy("line_no").collect()]


def test_irregular_indents(spark):
    assert paths(spark, "a.com | A") == [("bookmark", "root", "A")]
    assert paths(spark, "#x | y\nplain text\n\n") == []
    assert paths(spark, "FOLDER: A\n    FOLDER: B\n      b.com | B1") == [
        ("folder", "A", None), ("folder", "A/Unknown/B", None), ("bookmark", "A/Unknown/B", "B1")]
    assert paths(spark, "FOLDER: A\n  FOLDER: B\n  x.com | X")[-1] == ("bookmark", "A", "X")
    assert paths(spark, "FOLDER: A\n    x.com | X")[-1] == ("bookmark", "A", "X")
    assert paths(spark, "FOLDER: A\na.com | T | U")[-1] == ("bookmark", "A", "T | U")


def test_matching_rules(spark):
    src = spark.createDataFrame([
        ("o0", 0, "https://one.com/", "One"),
        ("o0", 1, "https://two.com/a", "Alpha page"), ("o0", 2, "https://two.com/b", "Beta page"),
        ("o0", 3, "https://three.com/a", "Alpha"), ("o0", 4, "https://three.com/b", "Beta"),
    ], "collection_id string, pos bigint, href string, text string")
    links = build_links(src)
    text = "FOLDER: F\n  one.com | One\n  two.com | beta\n  three.com | gamma\n  four.com | Four"
    m = match_outline(entries(spark, [text]), links).orderBy("line_no").collect()
    assert [(r.url, r.match_kind) for r in m] == [
        ("https://one.com/", "label"), ("https://two.com/b", "domain"), ("https://three.com/a", "domain"),
        ("https://four.com", "default")]


import pytest


def test_domain_fallback_matches_plain_rule(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "ab", "x", "Beta Max"]
    links, lines = [], []
    for i in range(30):
        links.append(("o0", i, f"https://d.com/p{i}", " ".join(rng.sample(words, rng.randint(1, 3)))))
    titles = ["", "a", "b", "et", "alpha", "beta max", "zzz", "GAMMA delta", "x", "lpha be", "ta"]
    text = "FOLDER: F\n" + "\n".join(f"  d.com | {t}" if t else "  d.com | " for t in titles)
    src = spark.createDataFrame(links, "collection_id string, pos bigint, href string, text string")
    built = build_links(src).cache()
    m = match_outline(entries(spark, [text]), built).orderBy("line_no").collect()
    originals = sorted(built.collect(), key=lambda r: r.pos)
    for r in m:
        if r.match_kind == "label":
            continue
        t = (r.title or "").lower()
        hit = next((o for o in originals if t in o.clean_title.lower() or t in o.original_title.lower()), originals[0])
        assert r.url == hit.url, (r.title, r.url, hit.url)


def test_small_domains_are_compared_directly(spark, monkeypatch):
    from linkwork.operators import outline

    links = build_links(spark.createDataFrame(
        [("o0", i, f"https://big.org/{i}", f"Long page {i}") for i in range(40)] + [("o0", 100 + i, f"https://small.org/{i}", f"Note {i}") for i in range(3)],
        "collection_id string, pos bigint, href string, text string"))
    ent = entries(spark, ["big.org | page 33\nbig.org | nothing\nsmall.org | ote 2\nsmall.org | none\ngone.org | x"])
    filed = []
    plain = outline._near_by_grams
    monkeypatch.setattr(outline, "_near_by_grams", lambda t, c, k: filed.append({r.domain for r in c.collect()}) or plain(t, c, k))

    def urls():
        return {r.line_no: (r.url, r.match_kind) for r in match_outline(ent, links).collect()}

    want = {1: ("https://big.org/33", "domain"), 2: ("https://big.org/0", "domain"), 3: ("https://small.org/2", "domain"),
            4: ("https://small.org/0", "domain"), 5: ("https://gone.org", "default")}
    assert urls() == want and filed == [{"big.org"}]
    monkeypatch.setattr(outline, "DIRECT", 0)
    assert urls() == want and filed[-1] == {"big.org", "small.org"}
    monkeypatch.setattr(outline, "DIRECT", 100)
    assert urls() == want and len(filed) == 2
