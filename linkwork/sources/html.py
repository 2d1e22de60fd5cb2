"""HTML link documents: file scan (S1), anchor scan (S2), folder-tree scan (S3).

Parsing runs on the executors in ``mapInPandas`` with the standard library's
``html.parser`` (entities decoded, no external entity expansion).  Only the document id
and text cross into Python; the rows that come back are plain columns.

Folder semantics follow the nesting of ``<DL>`` lists: a ``<H3>`` names a folder and the
next ``<DL>`` opened before another entry is that folder's list, so all three shapes of
browser exports give the same rows -- ``<DT><H3>..</H3><DL>`` (bare), ``<DT><H3>..</H3>
</DT><DD><DL>`` (list in a ``DD`` sibling) and ``<DT><H3>..</H3><DL>..</DL></DT>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR_SCHEMA = "collection_id string, anchor_no bigint, href string, text string, icon string, add_date string"
ENTRY_SCHEMA = ("collection_id string, seq bigint, type string, name string, url string, title string, "
                "path string, depth int, add_date string, icon string")
ROOT = "root"


class _LinkParser(HTMLParser):
    """One pass over a document collecting anchors and folder-tree entries."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[tuple] = []
        self.entries: list[tuple] = []
        self._a: dict | None = None       # open anchor
        self._h3: list[str] | None = None  # open folder heading text
        self._pending: tuple[str, int] | None = None  # folder path and depth waiting for its <dl>
        self._stack: list[tuple[str, int]] = []       # folder path and depth of each open <dl>
        self._skip = 0                     # inside <script>/<style>

    # -- helpers
    def _folder(self) -> tuple[str, int]:
        return self._stack[-1] if self._stack else (ROOT, 0)

    def _close_anchor(self) -> None:
        a = self._a
        if a is None:
            return
        self._a = None
        text = "".join(a["text"]).strip()
        href = a["href"].strip()
        self.anchors.append((len(self.anchors), href, text, a["icon"], a["add_date"]))
        if self._stack and href and text:
            path, depth = self._folder()
            self.entries.append(("bookmark", None, href, text, path, depth, a["add_date"], a["icon"]))

    # -- parser callbacks
    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
            return
        if tag == "a":
            self._close_anchor()
            d = dict(attrs)
            if "href" in d:
                self._a = {"href": d.get("href") or "", "text": [], "icon": d.get("icon"),
                           "add_date": d.get("add_date")}
            self._pending = None
        elif tag == "h3":
            self._h3 = []
        elif tag == "dt":
            self._pending = None
        elif tag == "dl":
            if not self._stack:
                self._stack.append((ROOT, 0))
            elif self._pending is not None:
                self._stack.append(self._pending)
            else:
                self._stack.append(self._folder())
            self._pending = None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag == "a":
            self._close_anchor()
        elif tag == "h3" and self._h3 is not None:
            name = "".join(self._h3).strip()
            self._h3 = None
            if self._stack:
                parent, depth = self._folder()
                path = f"{parent}/{name}" if depth else name
                self.entries.append(("folder", name, None, None, path, depth, None, None))
                self._pending = (path, depth + 1)
        elif tag == "dl":
            if self._stack:
                self._stack.pop()
            self._pending = None

    def handle_data(self, data):
        if self._skip:
            return
        if self._a is not None:
            self._a["text"].append(data)
        if self._h3 is not None:
            self._h3.append(data)

    def finish(self) -> None:
        self.close()
        self._close_anchor()


def parse_document(html: str) -> _LinkParser:
    p = _LinkParser()
    p.feed(html or "")
    p.finish()
    return p


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for cid, html in zip(pdf["collection_id"], pdf["html"]):
            out.extend((cid, *a) for a in parse_document(html).anchors)
        yield pd.DataFrame(out, columns=["collection_id", "anchor_no", "href", "text", "icon", "add_date"])


def _entry_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["collection_id", "seq", "type", "name", "url", "title", "path", "depth", "add_date", "icon"]
    for pdf in batches:
        out = []
        for cid, html in zip(pdf["collection_id"], pdf["html"]):
            out.extend((cid, i, *e) for i, e in enumerate(parse_document(html).entries))
        yield pd.DataFrame(out, columns=cols)


def scan_anchors(docs: DataFrame) -> DataFrame:
    """Every ``<a href>`` of each document in order: ``(collection_id, anchor_no, href, text, icon, add_date)``."""
    return docs.select("collection_id", "html").mapInPandas(_anchor_rows, ANCHOR_SCHEMA)


def scan_folders(docs: DataFrame) -> DataFrame:
    """S3: folder and bookmark entries (schema E) of each document."""
    return docs.select("collection_id", "html").mapInPandas(_entry_rows, ENTRY_SCHEMA)


DOC_SCHEMA = "collection_id string, html string"


REJECTED_SCHEMA = "path string, reason string"


def read_collections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents ``(collection_id, html)``, a row per file, and rejected inputs ``(path, reason)``.

    A file that is not valid UTF-8 is rejected, and so is a path that does not exist: the tool logs and carries on.
    """
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.format("binaryFile").load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err) and "does not exist" not in str(err):
            raise
        return spark.createDataFrame([], DOC_SCHEMA), spark.createDataFrame([(path, "path does not exist")], REJECTED_SCHEMA)
    text = F.col("content").cast("string")
    docs = raw.filter(F.is_valid_utf8(text)).select(F.col("path").alias("collection_id"), text.alias("html"))
    return docs, raw.filter(~F.is_valid_utf8(text)).select("path", F.lit("not valid UTF-8").alias("reason"))


def anchors_as_links(anchors: DataFrame) -> DataFrame:
    """Link-source view of scanned anchors: ``pos`` is the anchor's document position."""
    return anchors.select("collection_id", F.col("anchor_no").alias("pos"), "href", "text", "icon", "add_date")
