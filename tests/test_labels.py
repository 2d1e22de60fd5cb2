"""Link records and labels (W4/W5/P5) on literal collections."""

from linkwork.operators.labels import build_links


def labels(spark, rows):
    src = spark.createDataFrame([("c", i, u, t) for i, (u, t) in enumerate(rows)],
                                "collection_id string, pos bigint, href string, text string")
    return [r.formatted_label for r in build_links(src).orderBy("pos").collect()]


def test_homepages_numbered(spark):
    rows = [("https://d.com/en/", "A"), ("https://d.com/", "B"), ("https://d.com/index.html", "C")]
    assert labels(spark, rows) == ["d.com | Homepage", "d.com | Homepage 2", "d.com | Homepage 3"]


def test_path_parts_title_cased(spark):
    rows = [("https://github.com/quisquous/cactbot", "x"), ("https://github.com/GoldenChrysus/ffxiv-ember-overlay", "y")]
    assert labels(spark, rows) == ["github.com | Cactbot", "github.com | Ffxiv Ember Overlay"]


def test_collision_repaired_sequentially(spark):
    rows = [("https://d.com/x-2", "a"), ("https://d.com/x", "b"), ("https://d.com/y/x", "c")]
    assert labels(spark, rows) == ["d.com | X 2", "d.com | X", "d.com | X 3"]


def test_special_urls(spark):
    rows = [("https://d.com/a/full-node", "a"), ("https://d.com/calculator/z", "b")]
    assert labels(spark, rows) == ["d.com | Full Node", "d.com | Calculator"]


def test_page_fallbacks(spark):
    rows = [("https://d.com/blog/page", "Home"), ("https://d.com/blog/page", "Home")]
    assert labels(spark, rows) == ["d.com | Page 1", "d.com | Page 2"]
    rows = [("https://d.com/blog/page", "Great post"), ("https://d.com/other", "x")]
    assert labels(spark, rows)[0] == "d.com | Great post"


def test_single_link_domain_uses_title(spark):
    assert labels(spark, [("https://www.capitalone.com", "Capital One")]) == ["capitalone.com | Capital One"]


def test_dangerous_links_dropped(spark):
    rows = [("https://example.com", "Safe"), ("javascript:alert(1)", "x"), ("data:text/html,hi", "y")]
    assert labels(spark, rows) == ["example.com | Safe"]


def test_repair_matches_literal_rule_on_random_families(spark):
    import random

    from pyspark.sql import functions as F

    from linkwork.operators.labels import label_links

    rng = random.Random(7)
    choices = ["X", "X 2", "X 3", "X 2 2", "X 2 3", "X 4", "Y", "Y 2", "X 1", "X 02"]
    rows, given = [], {}
    for c in range(40):
        parts = [rng.choice(choices) for _ in range(rng.randint(2, 12))]
        cid = f"c{c}"
        for i, p in enumerate(parts):
            rows.append((cid, i * 7 + c % 3, p))
        given[cid] = [(i * 7 + c % 3, p) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "collection_id string, pos bigint, part string")
    # a link row per part: the URL path carries the part so path_identifier gives it back
    links = df.select("collection_id", "pos", F.concat(F.lit("https://d.com/s/"), F.replace("part", F.lit(" "), F.lit("_")))
                      .alias("url"), F.lit("d.com").alias("domain"), F.lit("t").alias("original_title"),
                      F.lit("t").alias("clean_title"), F.lit(None).cast("string").alias("icon"),
                      F.lit(None).cast("string").alias("add_date"), F.lit("").alias("href"))
    got = {(r.collection_id, r.pos): r.formatted_label for r in label_links(links).collect()}
    for cid, parts in given.items():
        taken = set()
        for pos, part in parts:  # each label is the part's first free number at its turn
            label = got[cid, pos].removeprefix("d.com | ")
            number = 1 if label == part else int(label.removeprefix(part + " "))
            assert label not in taken and number != 1 or label == part
            assert {part, *(f"{part} {k}" for k in range(2, number))} - {label} <= taken and label not in taken
            taken.add(label)


def test_huge_numbers_and_many_numbered_paths(spark):
    from linkwork.operators.labels import label_links

    urls = ["/x", "/y/x", "/x-2", "/x-99999999999999999999"] + [f"/n-{i}" for i in range(2000)]
    rows = [("c", i, f"https://d.com{u}", "d.com", "t", "t", None, None, "") for i, u in enumerate(urls)]
    schema = ("collection_id string, pos bigint, url string, domain string, original_title string, clean_title string, "
              "icon string, add_date string, href string")
    found = [r.formatted_label for r in label_links(spark.createDataFrame(rows, schema)).collect()]
    assert len(set(found)) == len(urls)


def test_numbered_paths_beside_many_copies(spark):
    """X has many rows and every number is taken by a path of its own: as many probes as rows, not their square."""
    from linkwork.operators.labels import label_links

    m = 1500
    urls = [f"/x-{i}" for i in range(2, m)] + ["/x"] * m
    rows = [("c", i, f"https://d.com{u}", "d.com", "t", "t", None, None, "") for i, u in enumerate(urls)]
    schema = ("collection_id string, pos bigint, url string, domain string, original_title string, clean_title string, "
              "icon string, add_date string, href string")
    got = [r.formatted_label for r in label_links(spark.createDataFrame(rows, schema)).orderBy("pos").collect()]
    want = [f"d.com | X {i}" for i in range(2, m)] + ["d.com | X"] + [f"d.com | X {i}" for i in range(m, 2 * m - 1)]
    assert got == want


def test_labels_with_many_buckets(spark, monkeypatch):
    from linkwork.operators import ordinal

    monkeypatch.setattr(ordinal, "DEFAULT_BUCKET", 2)
    test_homepages_numbered(spark)
    test_collision_repaired_sequentially(spark)
    test_page_fallbacks(spark)
    test_repair_matches_literal_rule_on_random_families(spark)


def test_links_are_cleaned_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [("c", i, f"https://d{i % 3}.com/p{i % 5}", f"Title {i}") for i in range(50)]
    schema = "collection_id string, pos bigint, href string, text string"
    out = build_links(spark.createDataFrame(rows, schema).mapInPandas(count, schema))
    assert out.count() == 50
    assert seen.value == 50
