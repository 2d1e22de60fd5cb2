"""HTML writers: organised Netscape files from outlines (K3) and relabelled documents (K2).

K3 produces ordered line rows.  Every line carries a sort key -- an array of
``(name, first_seen)`` pairs naming its place in the tree -- so ordering is a plain sort
by ranges, which spreads one huge outline over tasks, and no recursion is needed: top-level folders sort by name, subfolders by the outline
line where they first appear, a folder's own bookmarks come before its subfolders, and
bookmarks outside any folder come last.  Folders whose only content is a subfolder are
written with their subtree, and text is HTML-escaped.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, strip_ws
from ..functions.urls import with_sanitized_url
from ..operators.scan import sorted_places
from ..sources.html import _LinkParser

SENTINEL = "\U0010ffff"  # sorts after every folder name
INDENT = "    "


def _k(name, seen) -> F.Column:
    return F.struct(F.lit(name).alias("n") if isinstance(name, str) else name.alias("n"),
                    (F.lit(seen) if isinstance(seen, int) else seen).cast("bigint").alias("f"))


def netscape_header(timestamp: str = "0") -> list[str]:
    return [
        "<!DOCTYPE NETSCAPE-Bookmark-file-1>",
        "<!-- This is an automatically generated file.",
        "     It will be read and overwritten.",
        "     DO NOT EDIT! -->",
        '<META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=UTF-8">',
        "<TITLE>Bookmarks</TITLE>",
        "<H1>Bookmarks</H1>",
        "<DL><p>",
        f'{INDENT}<DT><H3 ADD_DATE="{timestamp}" LAST_MODIFIED="0" PERSONAL_TOOLBAR_FOLDER="true">Favorites bar</H3>',
        f"{INDENT}<DL><p>",
    ]


NETSCAPE_FOOTER = [f"{INDENT}</DL><p>", "</DL><p>"]


def _bookmark_line(indent: F.Column) -> F.Column:
    date = F.when(F.coalesce(F.col("add_date"), F.lit("")) != "",
                  F.concat(F.lit(' ADD_DATE="'), html_escape(F.col("add_date")), F.lit('"'))).otherwise(F.lit(""))
    icon = F.when(F.coalesce(F.col("icon"), F.lit("")) != "",
                  F.concat(F.lit(' ICON="'), html_escape(F.col("icon")), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(indent, F.lit('<DT><A HREF="'), html_escape(F.col("url")), F.lit('"'), date, icon, F.lit(">"),
                    html_escape(F.col("formatted_label"), quote=False), F.lit("</A>"))


def render_netscape_lines(entries: DataFrame, matched: DataFrame, timestamp: str = "0") -> DataFrame:
    """K3: ``(collection_id, line_no, line)`` of one bookmark file per outline.

    ``entries``: outline rows (``kind, line_no, folder_path``); ``matched``: output of ``match_outline``.
    """
    seen = entries.filter(F.col("kind") == "folder").select("collection_id", "folder_path", "line_no").unionByName(
        matched.filter(F.col("folder_path") != "root").select("collection_id", "folder_path", "line_no"))
    parts = F.split(F.col("folder_path"), "/")
    prefixes = seen.select("collection_id", "line_no", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ).alias("_i", "path"))
    folders = prefixes.groupBy("collection_id", "path").agg(F.min("line_no").alias("first_seen"),
                                                           F.first("_i").alias("_d"))
    folders = folders.withColumn("depth", (F.col("_d") + 1).cast("int")).drop("_d")
    # sort key of a folder: top level by name, deeper levels by first appearance of each prefix
    fp = F.split(F.col("path"), "/")
    anc = folders.select("collection_id", "path", "depth", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.size(fp)), lambda i: F.array_join(F.slice(fp, 1, i), "/"))
    ).alias("_i", "prefix"))
    anc = anc.join(folders.select("collection_id", F.col("path").alias("prefix"), F.col("first_seen").alias("_fs")),
                   ["collection_id", "prefix"])
    elem = F.struct(F.col("_i").alias("i"),
                    F.when(F.col("_i") == 0, F.col("prefix")).otherwise(F.lit("")).alias("n"),
                    F.when(F.col("_i") == 0, F.lit(0)).otherwise(F.col("_fs")).cast("bigint").alias("f"))
    keys = anc.groupBy("collection_id", "path", "depth").agg(F.array_sort(F.collect_list(elem)).alias("_e"))
    keys = keys.select("collection_id", "path", "depth", F.concat(
        F.array(_k("", 1)), F.transform("_e", lambda x: F.struct(x["n"].alias("n"), x["f"].alias("f")))).alias("key"))
    keys = keys.withColumn("name", F.element_at(F.split(F.col("path"), "/"), -1))
    ind = F.expr(f"repeat('{INDENT}', depth + 1)")
    h3 = F.concat(ind, F.lit(f'<DT><H3 ADD_DATE="{timestamp}" LAST_MODIFIED="{timestamp}">'),
                  html_escape(F.col("name"), quote=False), F.lit("</H3>"))
    opens = keys.select("collection_id", F.concat("key", F.array(_k("", -10))).alias("key"), h3.alias("line")) \
        .unionByName(keys.select("collection_id", F.concat("key", F.array(_k("", -9))).alias("key"),
                                 F.concat(ind, F.lit("<DL><p>")).alias("line"))) \
        .unionByName(keys.select("collection_id", F.concat("key", F.array(_k(SENTINEL, 0))).alias("key"),
                                 F.concat(ind, F.lit("</DL><p>")).alias("line")))
    in_folder = matched.filter(F.col("folder_path") != "root").join(
        keys.select("collection_id", F.col("path").alias("folder_path"), "key", "depth"), ["collection_id", "folder_path"])
    marks = in_folder.select("collection_id", F.concat("key", F.array(_k("", -5), _k("", F.col("line_no")))).alias("key"),
                             _bookmark_line(F.expr(f"repeat('{INDENT}', depth + 2)")).alias("line"))
    root = matched.filter(F.col("folder_path") == "root").select(
        "collection_id", F.array(_k("", 2), _k("", F.col("line_no"))).alias("key"),
        _bookmark_line(F.lit(INDENT * 2)).alias("line"))
    docs = entries.select("collection_id").distinct()
    head = docs.select("collection_id", F.posexplode(F.array(*[F.lit(x) for x in netscape_header(timestamp)]))
                       .alias("_i", "line")).select("collection_id", F.array(_k("", 0), _k("", F.col("_i"))).alias("key"), "line")
    foot = docs.select("collection_id", F.posexplode(F.array(*[F.lit(x) for x in NETSCAPE_FOOTER]))
                       .alias("_i", "line")).select("collection_id", F.array(_k("", 3), _k("", F.col("_i"))).alias("key"), "line")
    lines = head.unionByName(opens).unionByName(marks).unionByName(root).unionByName(foot)
    return sorted_places(lines, "collection_id", ["key"], "line_no").select("collection_id", "line_no", "line")


# ---------------------------------------------------------------------------- K2

COMMENT = "<!-- {n} duplicates removed; labels rewritten -->"


class _Spans(_LinkParser):
    """Records the character spans of links and of the ``<DT>`` items that hold them.

    An item runs from its ``<DT>`` over a ``<DD>`` note to the next item, folder, rule or end of its list;
    a ``<DT>`` that opens a folder is no item.  Items never overlap, and neither do links.
    """

    _ENDS = {"dl", "hr", "h1", "h2", "h3"}

    def __init__(self, text: str) -> None:
        super().__init__()
        self._text = text
        self._starts = [0]
        at = text.find("\n")
        while at >= 0:
            self._starts.append(at + 1)
            at = text.find("\n", at + 1)
        self.items: list[list[int]] = []   # start, end
        self.links: list[dict] = []        # per anchor: its item if any, start, text start, text end, end
        self._item: int | None = None
        self._closed: int | None = None    # item that a note may follow
        self._open = False                 # the last link has no end yet
        self.meta_end: int | None = None

    def _off(self) -> int:
        line, col = self.getpos()
        return self._starts[line - 1] + col

    def _end_link(self, at: int, end: int) -> None:
        if self._open:
            self._open = False
            self.links[-1].update(text_end=at, end=end)

    def _end_item(self, at: int) -> None:
        self._end_link(at, at)
        if self._item is not None:
            self.items[self._item][1] = at
        self._closed, self._item = self._item, None

    def _tag_end(self) -> int:
        """Behind the current end tag and the rest of its line, if blank."""
        at = self._text.find(">", self._off()) + 1 or len(self._text)
        line = at
        while line < len(self._text) and self._text[line] in " \t\r":
            line += 1
        return line + 1 if self._text[line:line + 1] == "\n" else at

    def handle_starttag(self, tag, attrs):
        at = self._off()
        behind = at + len(self.get_starttag_text() or "")
        if tag == "a":
            self._end_link(at, at)
            if "href" in dict(attrs):
                self.links.append({"item": self._item, "start": at, "text": behind})
                self._open = True
        elif tag == "dt":
            self._end_item(at)
            self._item = len(self.items)
            self.items.append([at, at])
        elif tag == "dd":
            self._end_link(at, at)
            if self._item is None and self._closed is not None and not self._text[self.items[self._closed][1]:at].strip():
                self._item = self._closed
        elif tag in self._ENDS:
            self._end_item(at)
            self._closed = None
        elif tag == "meta" and self.meta_end is None:
            self.meta_end = behind
        super().handle_starttag(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag == "a":
            self._end_link(self.links[-1]["text"] if self._open else 0, self.links[-1]["text"] if self._open else 0)
            super().handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self._end_link(self._off(), self._text.find(">", self._off()) + 1 or len(self._text))
        elif tag in ("dt", "dd") and self._item is not None:
            self._end_item(self._tag_end())
        elif tag in ("dl", "body", "html"):
            self._end_item(self._off())
            self._closed = None
        super().handle_endtag(tag)

    def finish(self) -> None:
        super().finish()
        self._end_item(len(self._text))


def rewrite_document(html: str, decisions: dict[int, str | None]) -> str:
    """Apply ``anchor_no -> new label`` (``None`` drops the link) to one document.

    An item goes with its note when none of its links stays; of any other item, and outside of items, only the
    dropped link itself goes.  Anchors without a decision stay as they are.
    """
    p = _Spans(html)
    p.feed(html)
    p.finish()
    dropped = {i for i, link in enumerate(p.links) if i in decisions and decisions[i] is None}
    staying = {link["item"] for i, link in enumerate(p.links) if i not in dropped}
    gone = {p.links[i]["item"] for i in dropped} - staying - {None}
    edits = [(*p.items[i], "") for i in gone]  # start, end, replacement
    for i, link in enumerate(p.links):
        if link["item"] in gone:
            continue
        if i in dropped:
            edits.append((link["start"], link["end"], ""))
        elif i in decisions:
            close = "</A>" if link["end"] == link["text_end"] else ""
            edits.append((link["text"], link["text_end"], escape(decisions[i], quote=False) + close))
    if p.meta_end is not None and not any(a < p.meta_end < b for a, b, _ in edits):
        edits.append((p.meta_end, p.meta_end, COMMENT.format(n=len(dropped))))
    pieces, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1])):
        if start < at:
            raise AssertionError(f"overlapping edits at {start}")
        pieces += [html[at:start], new]
        at = end
    return "".join([*pieces, html[at:]])


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for cid, html, nos, labels in zip(pdf["collection_id"], pdf["html"], pdf["anchor_nos"], pdf["labels"]):
            decisions = dict(zip(list(nos if nos is not None else []), list(labels if labels is not None else [])))
            out.append((cid, rewrite_document(html, decisions)))
        yield pd.DataFrame(out, columns=["collection_id", "html"])


def relabel_decisions(anchors: DataFrame, kept_links: DataFrame, strict: bool = False) -> DataFrame:
    """Per anchor of each document: its new label, or null when the item is to be dropped.

    Matching is on the sanitised URL; the first anchor of a kept URL keeps its place and gets
    the label (last link with that URL wins, J1); later anchors of the URL and anchors whose
    URL was removed are dropped (W7, J4).  ``strict`` compares the raw stripped ``href`` with
    the sanitised kept URLs instead, as the tool does (so any link whose URL sanitising changed
    is dropped).
    """
    base = anchors.select("collection_id", "anchor_no", "href")
    a = (base.withColumn("url", strip_ws(F.col("href"))) if strict
         else with_sanitized_url(base, "href", "url"))
    labels = kept_links.groupBy("collection_id", "url").agg(F.max_by("formatted_label", "pos").alias("_label"))
    a = a.join(labels, ["collection_id", "url"], "left")
    firsts = a.groupBy("collection_id", "url").agg(F.min("anchor_no").alias("_first"))
    a = a.join(firsts, ["collection_id", "url"])
    keep = F.col("_label").isNotNull() & (F.col("anchor_no") == F.col("_first"))
    return a.select("collection_id", "anchor_no", F.when(keep, F.col("_label")).alias("label"))


def relabel_html(docs: DataFrame, anchors: DataFrame, kept_links: DataFrame, strict: bool = False) -> DataFrame:
    """K2: ``(collection_id, html)`` with kept items relabelled and removed items dropped."""
    d = relabel_decisions(anchors, kept_links, strict)
    per_doc = d.groupBy("collection_id").agg(
        F.array_sort(F.collect_list(F.struct("anchor_no", "label"))).alias("_d"))
    per_doc = per_doc.select("collection_id", F.col("_d.anchor_no").alias("anchor_nos"), F.col("_d.label").alias("labels"))
    j = docs.select("collection_id", "html").join(per_doc, "collection_id", "left")
    return j.mapInPandas(_rewrite, "collection_id string, html string")
