"""Large single documents, as in the tool's performance tests: correctness of every row and the run time."""

import os
import tempfile
import time

from linkwork.plans.flows import clean
from linkwork.sources.html import read_collections


def _flat_document(n):
    items = "\n".join(
        f'<dt><a href="https://example{i % 100}.com/page{i}">"Test Bookmark {i} - Example Site {i % 100}"</a></dt>'
        for i in range(n))
    return f"<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<dl>\n{items}\n</dl>"


def _write(n):
    d = tempfile.mkdtemp(prefix="lw-perf-")
    with open(os.path.join(d, "big.html"), "w", encoding="utf-8") as f:
        f.write(_flat_document(n))
    return d


def test_thousand_links_labelled(spark):
    d = _write(1000)
    t0 = time.time()
    rows = clean(read_collections(spark, d)[0]).orderBy("pos").collect()
    elapsed = time.time() - t0
    assert len(rows) == 1000
    assert all(r.clean_title == f'"Test Bookmark {i}' for i, r in enumerate(rows))
    assert all(r.formatted_label == f"example{i % 100}.com | Page{i}" for i, r in enumerate(rows))
    assert elapsed < 60  # generous: includes JIT warm-up of a fresh plan on local[*]


def test_five_thousand_links_complete(spark):
    rows = clean(read_collections(spark, _write(5000))[0])
    assert rows.count() == 5000
    assert rows.select("formatted_label").distinct().count() == 5000
