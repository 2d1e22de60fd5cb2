"""Link records and unique ``domain | part`` labels.

A domain with one link is labelled with the cleaned title.  In a domain with several
links each link gets a part from its URL path (or a title fallback), and equal parts are
numbered `` 2``, `` 3``... in position order.  The numbering is a row number per
``(collection, domain, part)``; it equals the sequential first-free-number rule unless a
numbered label collides with another part (``X 2`` vs the second ``X``).  Only the
parts where that can happen are repaired, and the repair never gathers their rows: each part's
numbering is its rank plus a short skip list, worked out from per-part counts, first positions and
the number of a part's rows before another's first, level by level, then joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_ws, strip_ws
from ..functions.titles import format_label, with_clean_title
from ..functions.urls import domain_of_sanitized, path_identifier, with_sanitized_url
from ..session import materialize
from .ordinal import with_ordinal

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference tool's behaviour.
# Parts that trigger the title fallback (compared lower-cased).
FALLBACK_PARTS = ["en", "us", "index", "home", "main", "page"]
# Titles that are not used as a fallback label (besides the first domain label).
GENERIC_TITLES = ["en", "us", "home", "homepage", "main", "index"]
# Words skipped when a fallback label is made from title words; at most 3 are kept.
STOP_WORDS = ["en", "us", "home", "the", "and", "or", "of", "in", "to", "for"]
FALLBACK_WORDS = 3
# ---------------------------------------------------------------------------

LINK_COLUMNS = [
    "collection_id", "pos", "href", "url", "domain", "original_title", "clean_title", "icon", "add_date",
]


def clean_links(src: DataFrame, title_col: str = "text") -> DataFrame:
    """Sanitise URLs, clean titles, drop unusable links.

    ``src`` has ``collection_id, pos, href`` and a title column; optional ``icon, add_date``.
    """
    cols = set(src.columns)
    icon = F.col("icon") if "icon" in cols else F.lit(None).cast("string")
    add_date = F.col("add_date") if "add_date" in cols else F.lit(None).cast("string")
    df = src.select("collection_id", "pos", "href", F.col(title_col).alias("_title"),
                    icon.alias("icon"), add_date.alias("add_date"))
    df = with_sanitized_url(df, "href", "_url")
    # unusable links go by an explode: a filter moves below the projections and sanitises every URL once more
    df = df.select("*", F.explode(F.when(F.col("_url") != "", F.array("_url"))).alias("url")).drop("_url")
    df = with_clean_title(df, "_title", "original_title")
    return df.select(
        "collection_id", "pos", "href", "url", domain_of_sanitized(F.col("url")).alias("domain"),
        "original_title", F.col("original_title").alias("clean_title"), "icon", "add_date",
    )


def label_links(links: DataFrame, repair: bool = True, reuse: str = "checkpoint") -> DataFrame:
    """Add ``domain_links`` (A1), ``domain_ordinal`` (W5), ``part`` and ``formatted_label``.

    ``reuse`` says how intermediates read by several branches are kept (see ``materialize``).
    """
    title_low = F.lower(F.col("clean_title"))
    first_label = F.split_part(F.col("domain"), F.lit("."), F.lit(1))
    words = F.filter(split_ws(F.col("original_title")), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    fallback = (
        F.when(~((title_low == first_label) | title_low.isin(*GENERIC_TITLES)), F.col("clean_title"))
        .when(F.size(words) > 1, F.array_join(F.slice(words, 1, FALLBACK_WORDS), " "))
    )
    df = links.withColumn("_part0", path_identifier(F.col("url")))
    df = df.withColumn("_falls", F.lower("_part0").isin(*FALLBACK_PARTS)).withColumn("_fallback", F.when(F.col("_falls"), fallback))
    # cleaned once: numbering reads its input several times
    df = materialize(df, reuse)
    df = with_ordinal(df, ["collection_id", "domain"], "pos", "domain_ordinal", total="domain_links",
                      keep_bucket=True)
    page = F.concat(F.lit("Page "), F.col("domain_ordinal").cast("string"))
    df = df.withColumn("part", F.when(F.col("_falls"), F.coalesce("_fallback", page)).otherwise(F.col("_part0")))
    df = df.drop("_part0", "_falls", "_fallback")
    # one pass over all rows: a single-link domain ranks its part 1 and is labelled by its title
    df = with_ordinal(df, ["collection_id", "domain", "part"], "pos", "part_rank")
    df = df.withColumn(
        "label_part",
        F.when(F.col("domain_links") == 1, F.col("clean_title"))
        .when(F.col("part_rank") == 1, F.col("part"))
        .otherwise(F.concat(F.col("part"), F.lit(" "), F.col("part_rank").cast("string"))),
    )
    if repair:
        df = _repair_collisions(materialize(df, reuse))
    return (df.withColumn("formatted_label", format_label(F.col("domain"), F.col("label_part")))
            .drop("label_part", "part_rank"))


# A part "b k" (k a canonical integer >= 2) is the only other part whose labels can meet b's:
# its first label "b k" is b's k-th.  So b's rows take numbers 1, 2, 3 ... in order and skip
# exactly the numbers k whose part "b k" showed up first; and "b" itself is skipped when b's
# parent reached b's number before b's first row.  Each part's numbering is therefore its rank
# plus the count of skips recorded at or before that rank -- a short list per part.
_CHILD = r"^(.*) ([2-9]|[1-9][0-9]+)$"


def _skips(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``part, _skips``: the ranks before which a part leaves out a number, for the parts that do.

    Children of one part are walked by slot: the row of rank ``slot - skips so far`` would take the number, and the
    child has it if it came first.  A child that came later has lost its own first label.  That is known once its
    parent is done, so parts are done level by level, from those that are nobody's child.
    """
    child = F.struct("slot", "ahead", "part")
    empty = "array<bigint>"

    def step(s, x):
        rank = x["slot"] - F.size(s["skips"])
        reached = rank <= F.col("parent_n")
        first = reached & (x["ahead"] < rank)
        return F.struct(F.when(first, F.array_append(s["skips"], rank)).otherwise(s["skips"]).alias("skips"),
                        F.when(reached & ~first, F.array_append(s["lost"], x["part"])).otherwise(s["lost"]).alias("lost"))

    parents = materialize(edges.select(*keys, F.col("parent").alias("part")).distinct())
    level = parents.join(edges.select(*keys, "part"), [*keys, "part"], "left_anti").withColumn("late", F.lit(False))
    found = []
    while True:
        level = materialize(level)
        if level.isEmpty():
            break
        open_edges = edges.join(level.withColumnRenamed("part", "parent"), [*keys, "parent"])
        start = F.struct(F.when(F.col("late"), F.array(F.lit(1).cast("bigint"))).otherwise(F.array().cast(empty)).alias("skips"),
                         F.array().cast("array<string>").alias("lost"))
        done = open_edges.groupBy(*keys, "parent", "late", "parent_n").agg(F.array_sort(F.collect_list(child)).alias("_kids"))
        done = materialize(done.select(*keys, "parent", "_kids", F.aggregate("_kids", start, step).alias("_s")))
        found.append(done.select(*keys, F.col("parent").alias("part"), F.col("_s.skips").alias("_skips")))
        kids = done.select(*keys, F.col("_s.lost").alias("_lost"), F.explode("_kids.part").alias("part"))
        kids = kids.select(*keys, "part", F.array_contains("_lost", F.col("part")).alias("late"))
        leaf = kids.filter("late").join(parents, [*keys, "part"], "left_anti")
        found.append(leaf.select(*keys, "part", F.array(F.lit(1).cast("bigint")).alias("_skips")))
        level = kids.join(parents, [*keys, "part"], "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.filter(F.size("_skips") > 0)


def _repair_collisions(df: DataFrame) -> DataFrame:
    keys = ["collection_id", "domain"]
    bases = df.filter(F.col("domain_links") > 1).groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    # a number beyond bigint is never reached by a rank: such a part has no parent
    bases = bases.withColumn("slot", F.when(F.col("part").rlike(_CHILD), F.regexp_extract("part", _CHILD, 2).try_cast("bigint"))) \
        .withColumn("parent", F.when(F.col("slot").isNotNull(), F.regexp_extract("part", _CHILD, 1)))
    bases = materialize(bases)
    above = bases.select(*keys, F.col("part").alias("parent"), F.col("n").alias("parent_n"), F.col("first").alias("parent_first"),
                         F.col("slot").isNotNull().cast("int").alias("spare"))
    edges = bases.filter(F.col("parent").isNotNull()).join(above, [*keys, "parent"])
    # by rank alone a number meets a part only if the parent has that many rows
    if edges.filter(F.col("slot") <= F.col("parent_n")).isEmpty():
        return df
    # each skip of a smaller number, and the parent's own, lowers the rank that gets a number by one; parts beyond the
    # parent's rows even so are never met, so ordinary numbered paths take no part
    edges = with_ordinal(edges, [*keys, "parent"], "slot", "_j")
    edges = edges.withColumn("low", F.greatest(F.lit(1), F.col("slot") - (F.col("_j") - 1) - F.col("spare"))) \
        .withColumn("high", F.least("slot", "parent_n")).filter(F.col("low") <= F.col("parent_n"))
    edges = edges.select(*keys, "parent", "part", "slot", "first", "parent_n")
    # rows of the parent before the child's first: a running count over the parent's rows and the children's marks
    parents = edges.select(*keys, F.col("parent").alias("part")).distinct()
    rows = df.select(*keys, "part", "pos", F.lit(1).alias("_row"), F.lit(None).cast("string").alias("_child"))
    marks = edges.select(*keys, F.col("parent").alias("part"), F.col("first").alias("pos"), F.lit(0).alias("_row"), F.col("part").alias("_child"))
    counted = with_ordinal(rows.join(parents, [*keys, "part"], "left_semi").unionByName(marks), [*keys, "part"], "pos", "ahead", weight="_row")
    ahead = counted.filter(F.col("_child").isNotNull()).select(*keys, F.col("part").alias("parent"), F.col("_child").alias("part"), "ahead")
    edges = materialize(edges.join(ahead, [*keys, "parent", "part"]))
    skip_lists = _skips(edges, keys)
    fixed = df.join(skip_lists, [*keys, "part"], "left")
    slot = F.col("part_rank") + F.size(F.filter("_skips", lambda x: x <= F.col("part_rank")))
    label = F.when(slot == 1, F.col("part")).otherwise(F.concat(F.col("part"), F.lit(" "), slot.cast("string")))
    return fixed.withColumn("label_part", F.when(F.col("_skips").isNull(), F.col("label_part")).otherwise(label)).drop("_skips")


def build_links(src: DataFrame, title_col: str = "text") -> DataFrame:
    """C1 core: schema L with ``formatted_label``."""
    return label_links(clean_links(src, title_col))
