"""Composite flows end to end on generated documents, with the sinks written to a scratch folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from paths import SF_SMALL
from linkwork.operators.dedup import DedupConfig
from linkwork.plans.flows import clean, clean_and_dedup, export, link_health, organise, write_clean_run
from linkwork.sinks.render import rewrite_document
from linkwork.sinks.export import write_lines
from linkwork.sinks.report import REPORT_FIELDS, job_id_for, report_json_lines
from linkwork.sources.tables import (
    link_status_view, page_bookmark_documents, supplier_outline_links, supplier_outlines,
)
from linkwork.operators.labels import build_links


def test_clean_dedup_and_write(spark):
    docs = page_bookmark_documents(spark, SF_SMALL, variants=True)
    links = clean(docs)
    run = clean_and_dedup(links, DedupConfig("url"))
    n_links, n_kept = links.count(), run.kept.count()
    assert n_links == 200 and n_kept == 50
    out = tempfile.mkdtemp(prefix="lw-flow-")
    job = job_id_for("pages", "20260101_000000")
    write_clean_run(docs, run, out, job)
    write_clean_run(docs, run, out, job + "_again")  # another job's run leaves the first one's output
    for name in (job, job + "_again"):
        assert spark.read.json(os.path.join(out, "reports", name, "rows")).count() == n_kept
        assert spark.read.json(os.path.join(out, "reports", name, "summary")).count() > 0
    html = spark.read.text(os.path.join(out, "cleaned", job), wholetext=True).collect()
    removed = sum(int(h.value.split(" duplicates removed")[0].rsplit(" ", 1)[-1]) for h in html)
    assert removed == n_links - n_kept
    lines = spark.read.text(os.path.join(out, "reports", job, "duplicates"))
    assert lines.filter(F.col("value").startswith("Group ")).count() == n_links - n_kept


def test_nested_report_is_json(spark, tmp_path):
    links = spark.createDataFrame(
        [("a", i, f"t{i}", 'q"\\\n\x7f', "é \U0001f600 <", "d.com", "https://d.com/", i % 2 == 0, 200) for i in (5, 3, 9)]
        + [("b", 1, None, "", "x", "d.com", "u", None, None)],
        "collection_id string, pos bigint, original_title string, clean_title string, formatted_label string, domain string, "
        "url string, is_valid boolean, status_code int")
    write_lines(report_json_lines(links, "job_x", "2026-01-01 00:00:00"), str(tmp_path / "r"))
    for cid in "ab":
        parts = sorted((tmp_path / "r" / f"collection_id={cid}").glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        rows = sorted((r for r in links.collect() if r.collection_id == cid), key=lambda r: r.pos)
        want = {"generation_date": "2026-01-01 00:00:00", "source_file": cid, "job_id": "job_x",
                "summary": {"total_bookmarks": len(rows), "original_structure_preserved": True, "labels_cleaned": True,
                            "duplicates_handled": True},
                "bookmarks": [{c: r[c] for c in REPORT_FIELDS} for r in rows]}
        assert text == json.dumps(want, indent=2) + "\n"


def test_fuzzy_run_has_groups_and_a_report(spark):
    links = clean(page_bookmark_documents(spark, SF_SMALL, variants=True))
    run = clean_and_dedup(links, DedupConfig("fuzzy", 0.6, "longest"))
    groups = run.groups.collect()
    assert sum(1 for g in groups if g.member_no > 1) == links.count() - run.kept.count()
    assert {(g.collection_id, g.group_no, g["size"]) for g in groups} == {
        (c, n, sum(1 for g in groups if (g.collection_id, g.group_no) == (c, n))) for c, n in {(g.collection_id, g.group_no) for g in groups}}
    lines = run.report_lines.filter(F.col("line").startswith("  - Index")).count()
    assert lines == len(groups)


def test_exports_and_health(spark):
    docs = page_bookmark_documents(spark, SF_SMALL)
    links = clean(docs)
    flat = export(links, "flat")
    assert flat.count() == links.count() + 2 * links.select("collection_id").distinct().count()
    structured = export(links, "structured", docs)
    assert structured.filter(F.col("line").contains("FOLDER: ")).count() > 0
    checked, summary, broken = link_health(links, link_status_view(spark, SF_SMALL))
    s = summary.agg(F.sum("total").alias("t")).collect()[0]
    assert s.t == links.count()


def test_organise(spark):
    lines = organise(supplier_outlines(spark, SF_SMALL), build_links(supplier_outline_links(spark, SF_SMALL)))
    text = [r.line for r in lines.orderBy("collection_id", "line_no").collect()]
    assert text[0] == "<!DOCTYPE NETSCAPE-Bookmark-file-1>"
    assert any("Favorites bar" in t for t in text)


def test_rewrite_keeps_folders():
    doc = '<DL><p>\n<DT><H3>F</H3>\n<DL><p>\n<DT><A HREF="https://a.com">x</A>\n</DL><p>\n</DL><p>'
    assert "<H3>F</H3>" in rewrite_document(doc, {0: None})
