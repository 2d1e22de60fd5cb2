"""Document scans (S1-S3) and the relabelled document writer (K2)."""

import os
import tempfile

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from linkwork.sinks.render import rewrite_document
from linkwork.sources.html import parse_document, read_collections, scan_anchors, scan_folders

SECURITY = """<!DOCTYPE NETSCAPE-Bookmark-file-1><META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=UTF-8">
<TITLE>Bookmarks</TITLE><H1>Bookmarks</H1>
<DL><p><DT><H3>Folder</H3><DL><p>
<DT><A HREF="https://example.com">Safe Link</A>
<DT><A HREF="javascript:alert('xss')">XSS Link</A>
<DT><A HREF="data:text/html,<script>alert('xss')</script>">Data Link</A>
</DL><p></DL><p>"""

BARE = ('<DL><p><DT><H3>A</H3><DL><p><DT><A HREF="https://a.com" ADD_DATE="1">A one</A><DT><H3>B</H3><DL><p>'
        '<DT><A HREF="https://b.com">B &amp; one</A></DL><p></DL><p><DT><A HREF="https://r.com">R</A></DL><p>')
DD = ('<dl><dt><h3>A</h3></dt><dd><dl><dt><a href="https://a.com" add_date="1">A one</a></dt><dt><h3>B</h3></dt>'
      '<dd><dl><dt><a href="https://b.com">B &amp; one</a></dt></dl></dd></dl></dd><dt><a href="https://r.com">R</a></dt></dl>')
DT = ('<dl><dt><h3>A</h3><dl><dt><a href="https://a.com" add_date="1">A one</a></dt><dt><h3>B</h3><dl><dt>'
      '<a href="https://b.com">B &amp; one</a></dt></dl></dt></dl></dt><dt><a href="https://r.com">R</a></dt></dl>')


def test_three_nestings_same_entries():
    want = [("folder", "A", None, None, "A", 0), ("bookmark", None, "https://a.com", "A one", "A", 1),
            ("folder", "B", None, None, "A/B", 1), ("bookmark", None, "https://b.com", "B & one", "A/B", 2),
            ("bookmark", None, "https://r.com", "R", "root", 0)]
    for doc in (BARE, DD, DT):
        assert [e[:6] for e in parse_document(doc).entries] == want


def test_scan_files(spark):
    d = tempfile.mkdtemp(prefix="lw-html-")
    with open(os.path.join(d, "good.html"), "w", encoding="utf-8") as f:
        f.write(SECURITY)
    with open(os.path.join(d, "bad.html"), "wb") as f:
        f.write(b"\xff\xfe<html><a href='https://x.com'>x</a></html>")
    docs, rejected = read_collections(spark, d)
    assert docs.count() == 1
    assert [(os.path.basename(r.path), r.reason) for r in rejected.collect()] == [("bad.html", "not valid UTF-8")]
    anchors = scan_anchors(docs).collect()
    assert [a.href for a in anchors] == ["https://example.com", "javascript:alert('xss')",
                                         "data:text/html,<script>alert('xss')</script>"]
    from linkwork.operators.labels import build_links
    from linkwork.sources.html import anchors_as_links

    links = build_links(anchors_as_links(scan_anchors(docs))).collect()
    assert [r.url for r in links] == ["https://example.com"]
    entries = scan_folders(docs).collect()
    assert {(e.type, e.path) for e in entries} == {("folder", "Folder"), ("bookmark", "Folder")}


def test_missing_path_gives_no_rows(spark):
    docs, rejected = read_collections(spark, "/nonexistent/dir/x.html")
    assert docs.count() == 0
    assert [tuple(r) for r in rejected.collect()] == [("/nonexistent/dir/x.html", "path does not exist")]


def test_document_files(spark, tmp_path):
    """One file per document, without folders; a second write replaces the first; a failing job changes nothing."""
    from pyspark.sql import functions as F

    from linkwork.sinks.files import file_name, write_documents

    path = str(tmp_path / "cleaned")
    ids = ["a/0", "b c", "é", "_x", "x" * 300, "x" * 299 + "y"]
    docs = spark.createDataFrame([(i, f"<p>{i}</p>\n") for i in ids], "collection_id string, html string").repartition(3)
    write_documents(docs, path)
    names = {file_name(i, "_cleaned.html"): i for i in ids}
    assert len(names) == len(ids) and {p.name for p in (tmp_path / "cleaned").iterdir()} == set(names)
    assert all((tmp_path / "cleaned" / n).read_text() == f"<p>{i}</p>\n" for n, i in names.items())
    write_documents(docs.limit(2), path)
    before = {p.name for p in (tmp_path / "cleaned").iterdir()}
    assert len(before) == 2
    broken = docs.withColumn("html", F.when(F.col("collection_id") == "b c", F.raise_error(F.lit("stop"))).otherwise(F.col("html")))
    with pytest.raises(Exception):
        write_documents(broken, path)
    assert {p.name for p in (tmp_path / "cleaned").iterdir()} - {"_temporary"} == before


def test_rewrite_document():
    doc = ('<META HTTP-EQUIV="x">\n<DL><p>\n<DT><A HREF="https://a.com">old a</A>\n'
           '<DT><A HREF="https://b.com">old b</A>\n<DT><A HREF="https://a.com">again</A>\n</DL><p>')
    out = rewrite_document(doc, {0: "a.com | A", 1: None, 2: None})
    assert "a.com | A" in out and "old b" not in out and "again" not in out
    assert "2 duplicates removed" in out


def test_relabel_strict_matches_raw_href(spark):
    from linkwork.sinks.render import relabel_decisions

    anchors = spark.createDataFrame([("d", 0, "example.com"), ("d", 1, "https://b.com"), ("d", 2, "https://b.com")],
                                    "collection_id string, anchor_no bigint, href string")
    kept = spark.createDataFrame([("d", 0, "https://example.com", "example.com | E"), ("d", 1, "https://b.com", "b.com | B")],
                                 "collection_id string, pos bigint, url string, formatted_label string")
    loose = {r.anchor_no: r.label for r in relabel_decisions(anchors, kept).collect()}
    strict = {r.anchor_no: r.label for r in relabel_decisions(anchors, kept, strict=True).collect()}
    assert loose == {0: "example.com | E", 1: "b.com | B", 2: None}
    assert strict == {0: None, 1: "b.com | B", 2: None}


def test_folder_name_with_slash_is_one_level():
    doc = '<DL><DT><H3>TV/Movies</H3><DL><DT><A HREF="https://a.com">a</A></DL></DL>'
    assert [e[4:6] for e in parse_document(doc).entries] == [("TV/Movies", 0), ("TV/Movies", 1)]


def test_rewrite_two_links_in_one_item():
    doc = '<DL><DT><A HREF="https://a.com">a</A> <A HREF="https://a.com">dup</A>TAIL</DL>'
    assert rewrite_document(doc, {0: "a.com | A", 1: None}) == '<DL><DT><A HREF="https://a.com">a.com | A</A> TAIL</DL>'
    assert rewrite_document(doc, {0: None, 1: None}) == "<DL></DL>"


def test_rewrite_loose_closed_and_unclosed():
    doc = '<DL><DT><A HREF="x">x</A></DT><DD>note</DD>\n<A HREF="y">y</A >tail<DT><A HREF="z">z<DT><H3>F</H3></DL>'
    assert rewrite_document(doc, {0: None, 1: "Y", 2: "Z"}) == (
        '<DL><A HREF="y">Y</A >tail<DT><A HREF="z">Z</A><DT><H3>F</H3></DL>')
    assert rewrite_document(doc, {0: "X", 1: None, 2: None}) == (
        '<DL><DT><A HREF="x">X</A></DT><DD>note</DD>\ntail<DT><H3>F</H3></DL>')


@given(st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_rewrite_keeps_exactly_the_kept_links(rng):
    parts, n = ["<META HTTP-EQUIV='x'>\n<DL><p>\n"], 0
    for _ in range(rng.randint(1, 12)):
        kind = rng.choice(["item", "item", "two", "loose", "open", "folder", "rule"])
        links = [f'<A HREF="https://l{n + k}.com">old {n + k}' for k in range(2)]
        end = rng.choice(["</A>", "</a >"])
        close = rng.choice(["", "</DT>"])
        note = rng.choice(["", "\n<DD>note", "\n<DD>note</DD>"])
        n += {"two": 2, "folder": 0, "rule": 0}.get(kind, 1)
        parts.append({"item": f"<DT>{links[0]}{end}{close}{note}\n", "two": f"<DT>{links[0]}{end} and {links[1]}{end}{close}\n",
                      "loose": f"{links[0]}{end}\n", "open": f"<DT>{links[0]}\n<DT><H3>Inner</H3><DL></DL>\n",
                      "folder": "<DT><H3>F</H3>\n<DL><p>\n</DL><p>\n", "rule": "<HR>\n"}[kind])
    doc = "".join([*parts, "</DL><p>\n"])
    decisions = {i: rng.choice([None, f"new {i} & <b>"]) for i in range(n)}
    out = rewrite_document(doc, decisions)
    kept = [(f"https://l{i}.com", label) for i, label in decisions.items() if label is not None]
    assert [a[1:3] for a in parse_document(out).anchors] == kept
    assert out.count("<H3>") == doc.count("<H3>") and out.count("<HR>") == doc.count("<HR>")
    assert f"{n - len(kept)} duplicates removed" in out
