"""Link sources derived from the driver's tables.

``pages(page_id, url, html)`` is the main input: one link per page, its title from
``<title>``.  The collection is the first path segment (the page language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_unescape_basic

#: A page's title: any case, with or without attributes.
TITLE = r"(?is)<title(?:\s[^>]*)?>([^<]*)</title>"

LINK_SOURCE_COLUMNS = ["collection_id", "pos", "href", "text"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def page_links(spark: SparkSession, sf_dir: str, decode_entities: bool = True) -> DataFrame:
    """``(collection_id, pos, href, text)``, one row per page.

    ``text`` is the ``<title>`` content; with ``decode_entities`` the five XML
    entities are decoded as an HTML parser would before the title is cleaned.
    """
    pages = read_table(spark, sf_dir, "pages")
    title = F.regexp_extract(F.col("html"), TITLE, 1)
    return pages.select(
        F.split_part(F.col("url"), F.lit("/"), F.lit(4)).alias("collection_id"),
        F.col("page_id").cast("bigint").alias("pos"),
        F.col("url").alias("href"),
        (html_unescape_basic(title) if decode_entities else title).alias("text"),
    )


VARIANTS = 4


def page_link_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BV: every page link four times, as the same page saved in different spellings.

    ``v=0`` as is; ``v=1`` toggles ``www.``; ``v=2`` upper-cases the URL, adds a tracking
    parameter before any fragment and suffixes the title with `` copy``; ``v=3`` spells out
    the default port.  ``pos = page_id * 4 + v`` keeps the copies next to their page.
    """
    b0 = page_links(spark, sf_dir)
    href, text, pos = F.col("href"), F.col("text"), F.col("pos")
    head = F.regexp_extract(href, "^([^#]*)", 1)
    frag = F.regexp_extract(href, "^[^#]*(.*)$", 1)
    prefix = F.concat(F.split_part(href, F.lit("/"), F.lit(1)), F.lit("//"), F.split_part(href, F.lit("/"), F.lit(3)))
    www = (F.when(href.contains("://www."), F.replace(href, F.lit("://www."), F.lit("://")))
           .otherwise(F.replace(href, F.lit("://"), F.lit("://www."))))
    tracked = F.concat(F.upper(head), F.when(head.contains("?"), F.lit("&")).otherwise(F.lit("?")),
                       F.lit("utm_source=mail"), frag)
    ported = F.concat(prefix, F.when(href.startswith("https"), F.lit(":443")).otherwise(F.lit(":80")),
                      F.substring(href, F.length(prefix) + 1, 1 << 30))
    spellings = [(href, text), (www, text), (tracked, F.concat(text, F.lit(" copy"))), (ported, text)]
    variants = F.array(*[
        F.struct((pos * VARIANTS + i).alias("pos"), h.alias("href"), t.alias("text"))
        for i, (h, t) in enumerate(spellings)
    ])
    return b0.select("collection_id", F.inline(variants))


def page_odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO: every page's URL once in a spelling that sanitising has to refuse or mend, by ``page_id % 10``.

    0 a script URL, 1 a data URL in capitals, 2 no scheme, 3 scheme-relative, 4 spaces around and a tab inside, 5 an
    unclosed bracket host, 6 empty, 7 blank, 8 null, 9 a file URL.
    """
    b0 = page_links(spark, sf_dir)
    href = F.col("href")
    bare = F.regexp_replace(href, "^[a-z]+://", "")
    odd = [F.concat(F.lit("javascript:alert('"), href, F.lit("')")), F.concat(F.lit("DATA:text/html,"), bare), bare,
           F.concat(F.lit("//"), bare), F.concat(F.lit("  "), F.regexp_replace(href, "^([a-z]+://.)", "$1\t"), F.lit(" \n")),
           F.concat(F.lit("https://["), bare), F.lit(""), F.lit(" \t "), F.lit(None).cast("string"), F.concat(F.lit(" file:///"), bare)]
    return b0.select("collection_id", "pos", F.get(F.array(*odd), (F.col("pos") % 10).cast("int")).alias("href"), "text")


#: Paths of ``page_numbered_links``: parts that meet the numbers given to equal parts.
NUMBERED_PATHS = ["item", "item", "item-2", "item-2-2", "item-3", "item", "item-2"]


def page_numbered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BN: one shop per collection whose pages are called ``item``, ``item-2``, ``item-2-2`` ..., by ``page_id * 5 % 7``."""
    b0 = page_links(spark, sf_dir)
    path = F.get(F.array(*[F.lit(p) for p in NUMBERED_PATHS]), (F.col("pos") * 5 % 7).cast("int"))
    return b0.select("collection_id", "pos", F.concat(F.lit("https://shop.example.com/"), path).alias("href"), "text")


def link_status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V: a deterministic probe-result table over the page URLs.

    Status class ``page_id % 5``: 0 -> timeout, 1 -> 404 (a response, so valid), 2 -> not
    checked (all nulls), else 200.  Stands in for the results of a separate probing job.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    m = F.col("page_id") % 5
    checked = m != 2
    return pages.select(
        F.col("url"),
        F.when(checked, m != 0).alias("is_valid"),
        F.when(m == 1, F.lit(404)).when(checked & (m != 0), F.lit(200)).alias("status_code"),
        F.when(m == 0, F.lit("Request timeout")).alias("error"),
        F.col("page_id").alias("checked_seq"),
    )


DOC_CHUNK = 500  # pages per generated bookmark document; keeps every document bounded
# nesting shape of generated documents per collection (all three shapes browsers write)
DOC_SHAPES = {"de": "dd", "fr": "dt"}  # others: bare Netscape


def page_bookmark_documents(spark: SparkSession, sf_dir: str, chunk: int = DOC_CHUNK,
                            variants: bool = False) -> DataFrame:
    """Netscape bookmark files built from ``pages``: ``(collection_id, html)``.

    One document per (language, block of ``chunk`` page ids); inside it one folder per
    host (sorted) holding that host's pages in id order.  Titles and URLs are escaped.
    With ``variants`` every page appears in its four spellings (``page_link_variants``).
    """
    from ..functions.text import html_escape

    b0 = page_link_variants(spark, sf_dir) if variants else page_links(spark, sf_dir)
    per_page = VARIANTS if variants else 1
    doc = F.concat(F.col("collection_id"), F.lit("/"),
                   F.floor(F.col("pos") / F.lit(chunk * per_page)).cast("string"))
    shape = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DOC_SHAPES.items() for x in kv]),
                                    F.col("collection_id")), F.lit("bare"))
    pages = b0.select(doc.alias("doc"), shape.alias("shape"), F.split_part(F.col("href"), F.lit("/"), F.lit(3)).alias("host"),
                      "pos", "href", "text")
    link = F.concat(F.lit("<DT><A HREF=\""), html_escape(F.col("href")), F.lit("\" ADD_DATE=\""),
                    F.col("pos").cast("string"), F.lit("\">"), html_escape(F.col("text"), quote=False), F.lit("</A>"))
    body = pages.select("doc", F.lit(1).alias("sec"), "host", F.lit(1).alias("phase"), "pos", link.alias("line"))
    hosts = pages.select("doc", "shape", "host").distinct()
    h = html_escape(F.col("host"), quote=False)
    opens = F.when(F.col("shape") == "dd", F.array(F.concat(F.lit("<DT><H3>"), h, F.lit("</H3></DT>")), F.lit("<DD><DL><p>"))) \
        .otherwise(F.array(F.concat(F.lit("<DT><H3>"), h, F.lit("</H3>")), F.lit("<DL><p>")))
    closes = F.when(F.col("shape") == "dd", F.array(F.lit("</DL></DD>"))) \
        .when(F.col("shape") == "dt", F.array(F.lit("</DL></DT>"))).otherwise(F.array(F.lit("</DL><p>")))
    heads = hosts.select("doc", F.lit(1).alias("sec"), "host", F.lit(0).alias("phase"),
                         F.posexplode(opens).alias("pos", "line"))
    tails = hosts.select("doc", F.lit(1).alias("sec"), "host", F.lit(2).alias("phase"),
                         F.posexplode(closes).alias("pos", "line"))
    header = ["<!DOCTYPE NETSCAPE-Bookmark-file-1>",
              "<META HTTP-EQUIV=\"Content-Type\" CONTENT=\"text/html; charset=UTF-8\">",
              "<TITLE>Bookmarks</TITLE>", "<H1>Bookmarks</H1>", "<DL><p>"]
    docs = hosts.select("doc").distinct()
    top = docs.select("doc", F.lit(0).alias("sec"), F.lit("").alias("host"), F.lit(0).alias("phase"),
                      F.posexplode(F.array(*[F.lit(x) for x in header])).alias("pos", "line"))
    bottom = docs.select("doc", F.lit(2).alias("sec"), F.lit("").alias("host"), F.lit(0).alias("phase"),
                         F.lit(0).cast("bigint").alias("pos"), F.lit("</DL><p>").alias("line"))
    lines = top.unionByName(heads.withColumn("pos", F.col("pos").cast("bigint"))) \
        .unionByName(body).unionByName(tails.withColumn("pos", F.col("pos").cast("bigint"))).unionByName(bottom)
    ordered = F.array_sort(F.collect_list(F.struct("sec", "host", "phase", "pos", "line")))
    return lines.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("html")) \
        .select(F.col("doc").alias("collection_id"), "html")


OUTLINE_CHUNK = 500  # suppliers per generated outline; keeps every outline bounded


def _supplier_geo(spark: SparkSession, sf_dir: str, chunk: int) -> DataFrame:
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    sup = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, F.col("n_regionkey") == F.col("r_regionkey"))
    return sup.withColumn("collection_id", F.concat(F.col("r_name"), F.lit("#"),
                                                    F.floor(F.col("s_suppkey") / F.lit(chunk)).cast("string")))


def supplier_outlines(spark: SparkSession, sf_dir: str, chunk: int = OUTLINE_CHUNK) -> DataFrame:
    """Organised outlines ``(collection_id, text)`` built from region -> nation -> supplier.

    One outline per (region, block of ``chunk`` supplier keys)::

        FOLDER: {region}
                                                       (a blank line, a comment, a line that is neither)
          {nation lower}.example.org | {nation}        (every nation of the region)
          {nation lower}.example.org | {letters 2 to 5 of the nation, lower-case}
          missing.example.net | Nobody                 (no link has that domain)
          FOLDER: {nation}
            s{suppkey}.example.com | {supplier}      (" (closed)" appended when acctbal < 0)
        FOLDER: Archive
          old.example.net | Old
            FOLDER: Inner                              (two levels deeper: a level is filled in)
              deep.example.net | Deep
    """
    sup = _supplier_geo(spark, sf_dir, chunk)
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    outlines = sup.select("collection_id", "r_regionkey").distinct()
    nations = outlines.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(region, "r_regionkey")
    k = lambda a, b, c, d, line: F.struct(F.lit(a).alias("a"), b.cast("bigint").alias("b"), F.lit(c).alias("c"),
                                          d.cast("bigint").alias("d"), line.alias("line"))
    heads = nations.select("collection_id", k(0, F.lit(0), 0, F.lit(0),
                                              F.concat(F.lit("FOLDER: "), F.col("r_name"))).alias("l")).distinct()
    nat_links = nations.select("collection_id", k(1, F.col("n_nationkey"), 0, F.lit(0), F.concat(
        F.lit("  "), F.lower(F.col("n_name")), F.lit(".example.org | "), F.col("n_name"))).alias("l"))
    nat_folders = nations.select("collection_id", k(2, F.col("n_nationkey"), 0, F.lit(0), F.concat(
        F.lit("  FOLDER: "), F.col("n_name"))).alias("l"))
    title = F.when(F.col("s_acctbal") < 0, F.concat(F.col("s_name"), F.lit(" (closed)"))).otherwise(F.col("s_name"))
    sups = sup.select("collection_id", k(2, F.col("n_nationkey"), 1, F.col("s_suppkey"), F.concat(
        F.lit("    s"), F.col("s_suppkey").cast("string"), F.lit(".example.com | "), title)).alias("l"))
    contained = nations.select("collection_id", k(1, F.col("n_nationkey"), 1, F.lit(0), F.concat(
        F.lit("  "), F.lower(F.col("n_name")), F.lit(".example.org | "), F.lower(F.substring("n_name", 2, 4)))).alias("l"))
    fixed = [(0, 1, ""), (0, 2, "# made from the supplier table"), (0, 3, "neither folder nor bookmark"),
             (1, 1000, "  missing.example.net | Nobody"), (4, 0, "FOLDER: Archive"), (4, 1, "  old.example.net | Old"),
             (4, 2, "    FOLDER: Inner"), (4, 3, "      deep.example.net | Deep")]
    more = outlines.select("collection_id", F.explode(F.array(*[k(a, F.lit(b), 0, F.lit(0), F.lit(x)) for a, b, x in fixed])).alias("l"))
    lines = heads.unionByName(nat_links).unionByName(contained).unionByName(nat_folders).unionByName(sups).unionByName(more)
    ordered = F.array_sort(F.collect_list("l"))
    return lines.groupBy("collection_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def supplier_outline_links(spark: SparkSession, sf_dir: str, chunk: int = OUTLINE_CHUNK) -> DataFrame:
    """The original links each generated outline was organised from: ``(collection_id, pos, href, text)``.

    Every nation of the outline's region has ``https://{nation lower}.example.org/``; every
    supplier has a ``/contact`` page (title ``Contact``) and its home page (title = name).
    """
    sup = _supplier_geo(spark, sf_dir, chunk)
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    outlines = sup.select("collection_id", "r_regionkey").distinct()
    nat = outlines.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "collection_id", F.col("n_nationkey").cast("bigint").alias("pos"),
        F.concat(F.lit("https://"), F.lower(F.col("n_name")), F.lit(".example.org/")).alias("href"),
        F.col("n_name").alias("text"))
    host = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com/"))
    base = F.lit(1000) + F.col("s_suppkey").cast("bigint") * 2
    pages = F.array(
        F.struct(base.alias("pos"), F.concat(host, F.lit("contact")).alias("href"), F.lit("Contact").alias("text")),
        F.struct((base + 1).alias("pos"), host.alias("href"), F.col("s_name").alias("text")))
    sups = sup.select("collection_id", F.inline(pages))
    return nat.unionByName(sups)
