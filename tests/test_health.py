"""Link status join and summaries."""

from linkwork.operators.health import attach_status, broken_links, health_summary


def test_status_rules(spark):
    links = spark.createDataFrame(
        [("c", i, f"https://example{i}.com", f"example{i}.com | E{i}") for i in range(14)] + [("c", 99, "", "x | y")],
        "collection_id string, pos bigint, url string, formatted_label string")
    status = spark.createDataFrame(
        [(f"https://example{i}.com", i % 3 != 0, None if i % 3 == 0 else 404, "Request timeout" if i % 3 == 0 else None, 1)
         for i in range(12)],
        "url string, is_valid boolean, status_code int, error string, checked_seq int")
    c = attach_status(links, status).cache()
    s = health_summary(c).collect()[0]
    assert (s.total, s.valid, s.invalid, s.unchecked) == (15, 8, 5, 2)
    assert s.success_rate == round(8 / 13 * 100, 1)
    bad = c.filter("pos = 99").collect()[0]
    assert (bad.is_valid, bad.error) == (False, "Invalid or dangerous URL")
    b = broken_links(c, shown=3).collect()
    assert len(b) == 3 and all(r.more_broken == 2 for r in b)
