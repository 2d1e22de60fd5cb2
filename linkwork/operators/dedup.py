"""Duplicate removal by key: ``url`` (D1), ``title`` (D2), ``smart`` (D3); keep strategies.

A key strategy pairs every later row of a key with the key's first row, and each pair is
resolved alone (``grouping='pairwise'``, the tool's rule).  For a key with first row ``f``
that has the closed form below, which needs only per-key aggregates -- ``min(pos)``, the
label length at ``f``, ``min/max`` length and ``count`` -- so a hot key is reduced
map-side instead of being gathered into one window partition:

* ``first``: remove every row but ``f``.        * ``last``: remove ``f`` only.
* ``shortest``: remove ``i != f`` with ``len(i) >= len(f)``; remove ``f`` if some ``len(i) < len(f)``.
* ``longest``: remove ``i != f`` with ``len(i) <= len(f)``; remove ``f`` if some ``len(i) > len(f)``.

``grouping='whole'`` keeps one survivor per key instead (first, last, shortest or
longest label with ties to the earliest position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..functions.urls import with_normalized_url
from .ordinal import with_ordinal

STRATEGIES = ("url", "title", "smart", "fuzzy")
KEEP_STRATEGIES = ("first", "last", "shortest", "longest")


@dataclass(frozen=True)
class DedupConfig:
    strategy: str = "url"
    similarity_threshold: float = 0.85
    keep_strategy: str = "first"
    grouping: str = "pairwise"          # 'pairwise' (the tool) or 'whole' (one survivor per group)
    label_col: str = "formatted_label"  # compared by 'title' (and word sets of 'fuzzy')
    length_col: str = "formatted_label"  # lengths for the 'shortest'/'longest' keep strategies


def _label_len(label_col: str) -> Column:
    return F.length(F.coalesce(F.col(label_col), F.lit(""))).cast("bigint")


def with_dedup_keys(links: DataFrame, strategy: str, label_col: str = "formatted_label") -> tuple[DataFrame, list[str]]:
    """Add the key columns of a strategy; a null key never matches."""
    have_url = "_k_url" in links.columns  # computed once by the caller (see strategy_comparison)
    if strategy == "url":
        return (links if have_url else with_normalized_url(links, "url", "_k_url")), ["_k_url"]
    if strategy == "title":
        t = F.lower(strip_ws(F.coalesce(F.col(label_col), F.lit(""))))
        return links.withColumn("_k_title", F.when(t != "", t)), ["_k_title"]
    if strategy == "smart":
        df = links if have_url else with_normalized_url(links, "url", "_k_url")
        return df.withColumn("_k_domain", F.coalesce(F.col("domain"), F.lit(""))), ["_k_domain", "_k_url"]
    raise ValueError(f"not a key strategy: {strategy}")


def _keep_removed(keep: str, pos: Column, ln: Column, f: Column, lenf: Column, mn: Column, mx: Column) -> Column:
    if keep == "last":
        return pos == f
    if keep == "shortest":
        return F.when(pos == f, mn < lenf).otherwise(ln >= lenf)
    if keep == "longest":
        return F.when(pos == f, mx > lenf).otherwise(ln <= lenf)
    return pos != f  # 'first' and any unknown value keep the group's first row


def mark_key_duplicates(links: DataFrame, cfg: DedupConfig) -> DataFrame:
    """All rows with ``dup_first`` (first position of the key, null if the key is unique) and ``removed``."""
    df, keys = with_dedup_keys(links, cfg.strategy, cfg.label_col)
    df = df.withColumn("_len", _label_len(cfg.length_col))
    gk = ["collection_id", *keys]
    stats = (
        df.filter(F.col(keys[-1]).isNotNull())
        .groupBy(*gk)
        .agg(
            F.min("pos").alias("dup_first"),
            F.min_by("_len", "pos").alias("_lenf"),
            F.min("_len").alias("_mn"),
            F.max("_len").alias("_mx"),
            F.max("pos").alias("_last"),
            F.min_by("pos", F.struct("_len", "pos")).alias("_short"),
            F.min_by("pos", F.struct(-F.col("_len"), F.col("pos"))).alias("_long"),
            F.count(F.lit(1)).alias("dup_size"),
        )
        .filter(F.col("dup_size") > 1)
    )
    j = df.join(stats, gk, "left")
    pos = F.col("pos")
    if cfg.grouping == "whole":
        survivor = {"last": "_last", "shortest": "_short", "longest": "_long"}.get(cfg.keep_strategy, "dup_first")
        removed = pos != F.col(survivor)
    else:
        removed = _keep_removed(cfg.keep_strategy, pos, F.col("_len"), F.col("dup_first"), F.col("_lenf"),
                                F.col("_mn"), F.col("_mx"))
    out = j.withColumn("removed", F.coalesce(removed, F.lit(False)))
    return out.drop("_len", "_lenf", "_mn", "_mx", "_last", "_short", "_long", *keys)


def mark_duplicates(links: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Dispatch on the strategy; an unknown strategy removes nothing."""
    if cfg.strategy in ("url", "title", "smart"):
        return mark_key_duplicates(links, cfg)
    if cfg.strategy == "fuzzy":
        from .fuzzy import mark_fuzzy_duplicates

        return mark_fuzzy_duplicates(links, cfg)
    return (links.withColumn("dup_first", F.lit(None).cast("bigint"))
            .withColumn("dup_size", F.lit(None).cast("bigint")).withColumn("removed", F.lit(False)))


def remove_duplicates(links: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """Surviving links (input columns only), input order is by ``pos``."""
    return mark_duplicates(links, cfg).filter(~F.col("removed")).select(*links.columns)


def duplicate_pairs(marked: DataFrame, strategy: str) -> DataFrame:
    """A5 for key strategies: one group ``[first, i]`` per later row, numbered in report order.

    ``url``/``title``: groups in order of ``i``; ``smart``: by the domain's first position, then ``i``.
    Returns ``(collection_id, group_no, first_pos, dup_pos)``.
    """
    later = marked.filter(F.col("dup_first").isNotNull() & (F.col("pos") != F.col("dup_first")))
    if strategy == "smart":
        # domains in first-seen order, rows by position inside a domain
        dom = marked.groupBy("collection_id", "domain").agg(F.min("pos").alias("_df"))
        per_dom = later.groupBy("collection_id", "domain").agg(F.count(F.lit(1)).alias("_n"))
        # groups of earlier domains: a skew-safe running sum over domains in first-seen order
        offsets = with_ordinal(per_dom.join(dom, ["collection_id", "domain"]), ["collection_id"], "_df", "_cum",
                               weight="_n")
        offsets = offsets.select("collection_id", "domain", (F.col("_cum") - F.col("_n")).alias("_off"))
        ranked = with_ordinal(later, ["collection_id", "domain"], "pos", "_r").join(offsets, ["collection_id", "domain"])
        ranked = ranked.withColumn("group_no", F.col("_off") + F.col("_r"))
    else:
        ranked = with_ordinal(later, ["collection_id"], "pos", "group_no")
    return ranked.select("collection_id", "group_no", F.col("dup_first").alias("first_pos"),
                         F.col("pos").alias("dup_pos"))


def with_place(links: DataFrame, name: str = "place") -> DataFrame:
    """``links`` with their place among the rows of their collection, counted from 0."""
    return with_ordinal(links, ["collection_id"], "pos", name).withColumn(name, F.col(name) - 1)


def pair_members(pairs: DataFrame) -> DataFrame:
    """``duplicate_pairs`` as members: ``(collection_id, group_no, size, member_no, pos)``, two rows for each pair."""
    both = F.posexplode(F.array("first_pos", "dup_pos")).alias("member_no", "pos")
    return pairs.select("collection_id", "group_no", F.lit(2).cast("bigint").alias("size"), both).withColumn(
        "member_no", (F.col("member_no") + 1).cast("bigint"))


def whole_groups(marked: DataFrame) -> DataFrame:
    """A5 for whole groups: ``(collection_id, group_no, size, member_no, pos)``, one row for each member.

    Groups are numbered in the order of their first members, members by position; a group of any size stays rows.
    """
    rows = marked.filter(F.col("dup_first").isNotNull()).select("collection_id", "dup_first", "dup_size", "pos")
    heads = rows.filter(F.col("pos") == F.col("dup_first")).select("collection_id", "dup_first")
    heads = with_ordinal(heads, ["collection_id"], "dup_first", "group_no")
    members = with_ordinal(rows, ["collection_id", "dup_first"], "pos", "member_no")
    return members.join(heads, ["collection_id", "dup_first"]).select(
        "collection_id", "group_no", F.col("dup_size").alias("size"), "member_no", "pos")


def duplicate_groups(marked: DataFrame, strategy: str) -> DataFrame:
    """The groups that the strategy reports, as members: pairs for the key strategies, whole groups for ``fuzzy``."""
    if strategy == "fuzzy":
        return whole_groups(marked)
    return pair_members(duplicate_pairs(marked, strategy))


def dense_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``pos`` as the place of the link in its collection, counted from 0."""
    place = with_place(links.select("collection_id", "pos"))
    return members.join(place, ["collection_id", "pos"]).drop("pos").withColumnRenamed("place", "pos")


def strategy_comparison(links: DataFrame, title_col: str = "clean_title", thresholds: tuple[float, ...] = (0.7, 0.9),
                        label_col: str = "formatted_label") -> DataFrame:
    """``(strategy, keep_strategy, similarity_threshold, collection_id, rows_left, rows_removed)``.

    The key strategies come from one pass: every link is expanded to its three keys, keys are counted by label
    length, and the counts give what each keep rule removes.  ``fuzzy`` follows for each threshold (null otherwise).
    """
    from ..session import materialize
    from .fuzzy import mark_fuzzy_each

    keyed = with_normalized_url(links, "url", "_k_url")
    keyed = materialize(keyed.select(*dict.fromkeys(["collection_id", "pos", "domain", "_k_url", title_col, label_col])))
    title = F.lower(strip_ws(F.coalesce(F.col(title_col), F.lit(""))))
    keys = F.explode(F.array(*[
        F.struct(F.lit(name).alias("strategy"), key.alias("_key"), F.coalesce("domain", F.lit("")).alias("_dom") if name == "smart" else F.lit("").alias("_dom"))
        for name, key in (("url", F.col("_k_url")), ("title", F.when(title != "", title)), ("smart", F.col("_k_url")))]))
    rows = keyed.select("collection_id", "pos", _label_len(label_col).alias("_len"), keys.alias("_k")).select("collection_id", "pos", "_len", "_k.*")
    # a key is as long as its lengths are many: counts, not rows
    lengths = rows.groupBy("collection_id", "strategy", "_dom", "_key", "_len").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_p"))
    per = lengths.groupBy("collection_id", "strategy", "_dom", "_key").agg(
        F.sum("_n").alias("_n"), F.min_by("_len", "_p").alias("_lenf"), F.min("_len").alias("_mn"), F.max("_len").alias("_mx"),
        F.collect_list(F.struct("_len", "_n")).alias("_by"))
    held = lambda test: F.aggregate("_by", F.lit(0).cast("bigint"), lambda s, x: s + F.when(test(x["_len"]), x["_n"]).otherwise(0))
    gone = {
        "first": F.col("_n") - 1,
        "last": F.least(F.col("_n") - 1, F.lit(1)),
        "shortest": held(lambda x: x >= F.col("_lenf")) - 1 + (F.col("_mn") < F.col("_lenf")).cast("bigint"),
        "longest": held(lambda x: x <= F.col("_lenf")) - 1 + (F.col("_mx") > F.col("_lenf")).cast("bigint"),
    }
    per = per.withColumns({f"_{k}": F.when(F.col("_key").isNotNull(), v).otherwise(0) for k, v in gone.items()})
    sums = per.groupBy("collection_id", "strategy").agg(F.sum("_n").alias("_all"), *[F.sum(f"_{k}").alias(f"_{k}") for k in KEEP_STRATEGIES])
    kept = F.explode(F.array(*[F.struct(F.lit(k).alias("keep_strategy"), F.col(f"_{k}").alias("rows_removed")) for k in KEEP_STRATEGIES]))
    out = sums.select("collection_id", "strategy", "_all", kept.alias("_r")).select(
        "strategy", "_r.keep_strategy", F.lit(None).cast("double").alias("similarity_threshold"), "collection_id",
        (F.col("_all") - F.col("_r.rows_removed")).alias("rows_left"), "_r.rows_removed")
    words = keyed.select("collection_id", "pos", "domain", "_k_url", label_col)
    for t, m in zip(thresholds, mark_fuzzy_each(words, thresholds, "first", label_col, label_col), strict=True):
        out = out.unionByName(m.groupBy("collection_id").agg(
            F.count_if(~F.col("removed")).alias("rows_left"), F.count_if("removed").alias("rows_removed")).select(
            F.lit("fuzzy").alias("strategy"), F.lit("first").alias("keep_strategy"), F.lit(float(t)).alias("similarity_threshold"), "*"))
    return out


def duplicate_metrics(marked: DataFrame, strategy: str = "url") -> DataFrame:
    """A4: per collection ``rows_before, rows_removed, rows_after`` and the number of groups.

    The key strategies report pairs: ``pair_groups``, and ``keys_with_duplicates`` beside it.  ``fuzzy`` reports whole
    groups: ``groups``.
    """
    in_group = F.col("dup_first").isNotNull()
    if strategy == "fuzzy":
        groups = [F.count_if(in_group & (F.col("pos") == F.col("dup_first"))).alias("groups")]
    else:
        groups = [F.count_if(in_group & (F.col("pos") != F.col("dup_first"))).alias("pair_groups"),
                  F.count_distinct(F.when(in_group, F.col("dup_first"))).alias("keys_with_duplicates")]
    return marked.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col("removed")).alias("rows_removed"),
        F.count_if(~F.col("removed")).alias("rows_after"),
        *groups,
    )
