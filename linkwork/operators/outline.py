"""Outline folders (W6) and matching outline bookmarks back to original links.

W6 from running values over the lines of each outline, in line order.  The folder stack
is at most three deep and each level has a closed form:

* level 0 = name of the last top-level folder line, or -- before any -- "Unknown"/the
  name given by the first folder line when it was indented;
* level 1 = name of the last level-1 folder line unless a top-level folder came after it
  or it opened the outline; "Unknown" when a deeper folder had to be padded;
* level 2 = name of the last folder line if that line was indented two levels or more.

The running values come from a segmented scan (``scan.running``), so an outline of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import leading_ws_len, rstrip_ws, strip_ws
from ..functions.urls import default_url
from ..session import materialize
from .scan import running

UNKNOWN = "Unknown"
ROOT = "root"
FOLDER_PREFIX = "FOLDER:"
SEPARATOR = " | "


def outline_entries(lines: DataFrame) -> DataFrame:
    """Classify lines (F5) and give every folder and bookmark line its folder path.

    Output: ``collection_id, line_no, kind ('folder'|'bookmark'), level, name, domain, title,
    folder_path, formatted_label``; blank, comment and other lines are dropped.
    """
    r = rstrip_ws(F.col("line"))
    content = strip_ws(r)
    level = F.floor(leading_ws_len(r) / 2).cast("int")
    is_folder = content.startswith(FOLDER_PREFIX)
    is_mark = content.contains(SEPARATOR) & ~content.startswith("#")
    kind = F.when(r == "", F.lit(None)).when(is_folder, F.lit("folder")).when(is_mark, F.lit("bookmark"))
    df = lines.select("collection_id", "line_no", content.alias("content"), level.alias("level"), kind.alias("kind"))
    df = df.filter(F.col("kind").isNotNull())
    name = strip_ws(F.substring(F.col("content"), len(FOLDER_PREFIX) + 1, 1 << 30))
    df = df.withColumn("name", F.when(F.col("kind") == "folder", name))
    fold = F.col("kind") == "folder"
    lv = F.col("level")
    df = running(df, "collection_id", "line_no", firsts={"_first": F.when(fold, F.struct("line_no", "level", "name"))}, lasts={
        "_l0": F.when(fold & (lv == 0), F.col("name")),
        "_g": F.when(fold & (lv <= 1), F.struct("line_no", "level", "name")),
        "_deep": F.when(fold & (lv >= 2), F.col("line_no")),
        "_lastf": F.when(fold, F.struct("level", "name")),
    })
    first, g = F.col("_first"), F.col("_g")
    s0 = F.coalesce(F.col("_l0"), F.when(first["level"] == 1, first["name"]).when(first["level"] >= 2, F.lit(UNKNOWN)))
    padded = F.when(F.col("_deep") > g["line_no"], F.lit(UNKNOWN))
    s1 = (F.when(first.isNull(), F.lit(None))
          .when(g.isNull(), F.lit(UNKNOWN))
          .when((g["level"] == 0) | (g["line_no"] == first["line_no"]), padded)
          .otherwise(g["name"]))
    s2 = F.when(F.col("_lastf")["level"] >= 2, F.col("_lastf")["name"])
    df = df.withColumn("_s0", s0).withColumn("_s1", s1).withColumn("_s2", s2)
    stack = F.concat_ws("/", F.col("_s0"), F.col("_s1"), F.col("_s2"))
    has = F.col("_first").isNotNull()
    s01 = F.concat_ws("/", F.col("_s0"), F.col("_s1"))
    mark_path = (F.when(~has, F.lit(ROOT))
                 .when(lv <= 1, F.col("_s0"))
                 .when(lv == 2, s01)
                 .otherwise(stack))
    parts = F.split(F.col("content"), r" \| ", 2)
    return df.select(
        "collection_id", "line_no", "kind", "level", "name",
        F.when(F.col("kind") == "bookmark", strip_ws(F.element_at(parts, 1))).alias("domain"),
        F.when(F.col("kind") == "bookmark", strip_ws(F.element_at(parts, 2))).alias("title"),
        F.when(fold, stack).otherwise(mark_path).alias("folder_path"),
        F.when(F.col("kind") == "bookmark", F.col("content")).alias("formatted_label"),
    )


def match_outline(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Outline bookmarks with the original link they stand for.

    J2: equal ``formatted_label`` (last original wins).  J3, only for misses: originals of
    the same domain -- the first (by position) whose clean or original title contains the
    outline title, case-insensitively, else the first.  P8: no original -> ``https://domain``.
    """
    marks = entries.filter(F.col("kind") == "bookmark").select(
        "collection_id", "line_no", "folder_path", "domain", "title", "formatted_label")
    links = materialize(links.select("collection_id", "pos", "domain", "formatted_label", "clean_title", "original_title",
                                     "url", "add_date", "icon"))
    orig = F.struct("url", "add_date", "icon")
    by_label = links.groupBy("collection_id", "formatted_label").agg(F.max_by(orig, "pos").alias("_exact"))
    j = materialize(marks.join(by_label, ["collection_id", "formatted_label"], "left"))
    misses = j.filter(F.col("_exact").isNull()).select("collection_id", "line_no", "domain", "title")
    best = _domain_fallback(misses, links, orig)
    out = j.join(best, ["collection_id", "line_no"], "left")
    m = F.coalesce(F.col("_exact"), F.col("_dom"))
    kind = F.when(F.col("_exact").isNotNull(), F.lit("label")).when(F.col("_dom").isNotNull(), F.lit("domain")) \
        .otherwise(F.lit("default"))
    return out.select(
        "collection_id", "line_no", "folder_path", "formatted_label", "domain", "title",
        F.coalesce(m["url"], default_url(F.col("domain"))).alias("url"),
        m["add_date"].alias("add_date"), m["icon"].alias("icon"), kind.alias("match_kind"))


#: Lengths of the substrings under which titles are filed; a title is looked up by the longest that it has.
GRAMS = (1, 2, 3, 6)
#: A title is looked up by so many of its rarest substrings; a candidate has to have them all.
RAREST = 3
#: In a domain of at most so many originals a title is compared with each; only larger ones are filed under substrings.
DIRECT = 16


def _grams(text: F.Column, k: int) -> F.Column:
    """All substrings of length ``k`` (none when the text is shorter), marked with their length."""
    n = F.length(text) - F.lit(k) + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                      lambda i: F.concat(F.lit(f"{k}:"), F.substring(text, i, k)))).otherwise(F.array().cast("array<string>"))


def _domain_fallback(misses: DataFrame, links: DataFrame, orig: F.Column) -> DataFrame:
    """J3 for unmatched outline lines: ``(collection_id, line_no, _dom)``.

    The first original of the domain (by position) whose clean or original title contains the
    outline title, case-insensitively; else the domain's first original.  Originals of a domain with more than ``DIRECT``
    of them are filed, by position only, under their titles' substrings; a title's candidates stand under all of its
    ``RAREST`` rarest substrings.  Only their texts are read and checked for the full containment.  In smaller domains
    every original is a candidate.  Equal titles of a domain are looked up once.
    """
    keys = ["collection_id", "domain"]
    cand = links.join(misses.select(*keys).distinct(), keys, "left_semi").select(
        *keys, "pos", orig.alias("_o"), F.lower(F.col("clean_title")).alias("_ct"),
        F.lower(F.col("original_title")).alias("_ot"))
    first = materialize(cand.groupBy(*keys).agg(F.min_by("_o", "pos").alias("_first"), F.count(F.lit(1)).alias("_size")))
    m = misses.withColumn("_t", F.lower(F.coalesce(F.col("title"), F.lit(""))))
    titles = m.select(*keys, "_t").distinct()
    small = titles.join(first.filter(F.col("_size") <= DIRECT).select(*keys), keys)
    contains = F.col("_ct").contains(F.col("_t")) | F.col("_ot").contains(F.col("_t"))
    # as among filed originals, a position that comes twice is no hit, and neither is an empty title
    hits = small.join(cand, keys).filter(contains & (F.col("_t") != "")).groupBy(*keys, "_t", "pos").agg(
        F.first("_o").alias("_o"), F.count(F.lit(1)).alias("_have")).filter(F.col("_have") == 1).drop("_have")
    large = first.filter(F.col("_size") > DIRECT).select(*keys)
    if not large.isEmpty():
        held = cand.join(large, keys, "left_semi")
        near = _near_by_grams(titles.join(large, keys, "left_semi"), held, keys).join(held, [*keys, "pos"])
        hits = hits.unionByName(near.filter(contains).select(*keys, "_t", "pos", "_o"))
    # the empty title is contained in every original: the first one serves, as without a hit
    hit = hits.groupBy(*keys, "_t").agg(F.min_by("_o", "pos").alias("_hit"))
    out = m.join(first, keys, "left").join(hit, [*keys, "_t"], "left")
    return out.select("collection_id", "line_no", F.coalesce(F.col("_hit"), F.col("_first")).alias("_dom"))


def _near_by_grams(titles: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """Titles ``_t`` and the positions of the originals that have the rarest substrings of them."""
    filed = materialize(cand.select(*keys, "pos", F.explode(F.array_distinct(F.flatten(F.array(*[
        F.concat(_grams(F.col("_ct"), k), _grams(F.col("_ot"), k)) for k in GRAMS])))).alias("_g")))
    freq = filed.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    asked = F.array().cast("array<string>")
    for k in GRAMS:  # the longest substrings that the title has
        asked = F.when(F.length("_t") >= k, F.array_distinct(_grams(F.col("_t"), k))).otherwise(asked)
    want = titles.select(*keys, "_t", F.explode(asked).alias("_g"))
    # a substring that no candidate has means that no candidate contains the title
    n = F.coalesce(F.col("_n"), F.lit(0))
    rare = want.join(freq, [*keys, "_g"], "left").groupBy(*keys, "_t").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(n.alias("n"), "_g"))), 1, RAREST).alias("_r"))
    rare = rare.filter(F.get("_r", F.lit(0))["n"] > 0).select(*keys, "_t", F.size("_r").alias("_need"), F.explode("_r._g").alias("_g"))
    near = rare.join(filed, [*keys, "_g"]).groupBy(*keys, "_t", "pos").agg(F.count(F.lit(1)).alias("_have"), F.first("_need").alias("_need"))
    return near.filter(F.col("_have") == F.col("_need")).select(*keys, "_t", "pos")
