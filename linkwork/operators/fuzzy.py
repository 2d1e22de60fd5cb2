"""Fuzzy duplicate removal (D4) with an exact blocked similarity join.

Score of two links: ``url_eq*0.5 + jaccard(label words)*0.3 + domain_eq*0.2`` (url on the
normalised form).  A row joins the first earlier *leader* it reaches the threshold with,
and rows already in a group never lead: the leaders are the lexicographically first
maximal independent set of the score graph, and a member belongs to its smallest
adjacent earlier leader.

Pairs are never listed.  For each (url_eq, domain_eq) case the threshold fixes the Jaccard
index needed, ``need = (t - 0.5u - 0.2d) / 0.3``, and each case files nodes under keys:

* ``need > 1``: none, the case has no edges;
* ``need <= 0``: one key for the case's class, all of whose pairs are edges;
* otherwise: a key for each of the first ``|x| - ceil(need*|x|) + 1`` words in rarest-first
  order, inside the case's block (two sets that reach ``need`` share such a word).

So whatever a node reaches shares a key with it.  A round elects leaders among the ``k``
smallest undecided nodes of each key: a node that is among them under *all* its keys knows
every earlier node it could reach, and leads if it reaches none of them.  The new leaders
are then compared with what is left under their keys, and what they reach never leads.
``k`` starts at 1 and grows fourfold, so a round is linear in the postings for its ``k``, a
class of similar links is gone after one round, and keys of unlike links take few rounds.
Every round decides at least each collection's smallest undecided node.

Rows with the same (normalised url, domain, word set) score 1.0 with each other and
alike with everyone else, so they are collapsed to one node first and expanded after.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import token_set
from ..functions.urls import with_normalized_url
from ..session import materialize

EMPTY_TOKEN = "\u0000"  # stands for a blank label: blank vs blank scores 1, blank vs text 0
URL_W, TITLE_W, DOMAIN_W = 0.5, 0.3, 0.2
# (url_eq, domain_eq, block columns)
CASES = [(1, 1, ["_nurl", "_dom"]), (1, 0, ["_nurl"]), (0, 1, ["_dom"]), (0, 0, [])]
EPS = 1e-9
#: Growth of ``k`` from round to round.
GROWTH = 4
_log = logging.getLogger(__name__)


def _score(u, j, d):
    return (u * F.lit(URL_W)) + (j * F.lit(TITLE_W)) + (d * F.lit(DOMAIN_W))


def fuzzy_plan(threshold: float) -> tuple[list[list[str]], list[tuple[list[str], float]]]:
    """Clique classes and prefix-filter blocks (with needed Jaccard) for a threshold."""
    cliques, joins = [], []
    for u, d, block in CASES:
        need = (threshold - URL_W * u - DOMAIN_W * d) / TITLE_W
        if need > 1 + EPS:
            continue
        if need <= 0:
            cliques.append(block)
        else:
            joins.append((block, need))
    return cliques, joins


def _signature_rows(links: DataFrame, label_col: str) -> DataFrame:
    have_url = "_k_url" in links.columns  # computed once by the caller (see strategy_comparison)
    df = links.withColumn("_nurl", F.col("_k_url")) if have_url else with_normalized_url(links, "url", "_nurl")
    toks = token_set(F.col(label_col))
    return (df.withColumn("_dom", F.coalesce(F.col("domain"), F.lit("")))
            .withColumn("_toks", F.when(F.size(toks) == 0, F.array(F.lit(EMPTY_TOKEN))).otherwise(toks))
            .withColumn("_tkey", F.array_join(F.col("_toks"), " ")))


def candidate_edges(nodes: DataFrame, threshold: float, joins: list[tuple[list[str], float]]) -> DataFrame:
    """Verified edges ``(collection_id, a, b, score)`` with ``a < b`` from prefix-filtered blocks."""
    if not joins:
        return nodes.sparkSession.createDataFrame([], "collection_id string, a bigint, b bigint, score double")
    tok = nodes.select("collection_id", "node", "_nurl", "_dom", "_toks", F.explode("_toks").alias("_t"))
    freq = tok.groupBy("collection_id", "_t").agg(F.count(F.lit(1)).alias("_df"))
    ranked = tok.join(freq, ["collection_id", "_t"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy("collection_id", "node").orderBy("_df", "_t")))
    if len(joins) > 1:  # read once per block
        ranked = materialize(ranked)
    cands = None
    for block, need in joins:
        n = F.size("_toks")
        plen = n - F.ceil(n.cast("double") * F.lit(need - EPS)) + 1
        pref = ranked.filter(F.col("_r") <= plen).select("collection_id", *block, "_t", "node")
        keys = ["collection_id", *block, "_t"]
        pairs = (pref.alias("x").join(pref.alias("y"), keys)
                 .where(F.col("x.node") < F.col("y.node"))
                 .select("collection_id", F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        cands = pairs if cands is None else cands.unionByName(pairs)
    cands = cands.distinct()
    attrs = nodes.select("collection_id", "node", "_nurl", "_dom", "_toks")
    x = attrs.select("collection_id", F.col("node").alias("a"), F.col("_nurl").alias("nu_a"),
                     F.col("_dom").alias("do_a"), F.col("_toks").alias("to_a"))
    y = attrs.select("collection_id", F.col("node").alias("b"), F.col("_nurl").alias("nu_b"),
                     F.col("_dom").alias("do_b"), F.col("_toks").alias("to_b"))
    e = cands.join(x, ["collection_id", "a"]).join(y, ["collection_id", "b"])
    inter = F.size(F.array_intersect("to_a", "to_b")).cast("double")
    union = F.size(F.array_union("to_a", "to_b")).cast("double")
    score = _score((F.col("nu_a") == F.col("nu_b")).cast("double"), inter / union,
                   (F.col("do_a") == F.col("do_b")).cast("double"))
    return e.select("collection_id", "a", "b", score.alias("score")).filter(F.col("score") >= F.lit(threshold))


def _under(where):
    return lambda t: F.xxhash64(where, t)


def with_rare_words(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``_rare``: their words, rarest in the collection first; the same for every threshold."""
    words = nodes.select("_cid", "node", F.explode("_toks").alias("_t"))
    freq = words.groupBy("_cid", "_t").agg(F.count(F.lit(1)).alias("_df"))
    ranked = words.join(freq, ["_cid", "_t"]).groupBy("_cid", "node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_df", "_t"))), lambda x: x["_t"]).alias("_rare"))
    return nodes.join(ranked, ["_cid", "node"])


def _keyed_nodes(nodes: DataFrame, threshold: float) -> DataFrame:
    """``nodes`` with ``_keys``: what they are filed under, where another node stands there too (else empty)."""
    cliques, joins = fuzzy_plan(threshold)
    filed = nodes if "_rare" in nodes.columns else with_rare_words(nodes)
    n = F.size("_rare")
    keys = []
    for block in cliques:
        keys.append(F.array(F.xxhash64(F.lit("class"), F.lit("+".join(block)), "_cid", *block)))
    for block, need in joins:
        plen = n - F.ceil(n.cast("double") * F.lit(need - EPS)).cast("int") + 1
        where = F.xxhash64(F.lit("word"), F.lit("+".join(block)), "_cid", *block)
        keys.append(F.transform(F.slice("_rare", F.lit(1), plen), _under(where)))
    keyed = filed.withColumn("_keys", F.array_distinct(F.concat(*keys)) if keys else F.array().cast("array<bigint>"))
    keyed = materialize(keyed.drop("_rare"))
    post = keyed.select("_cid", "node", F.explode("_keys").alias("_key"))
    shared = post.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    useful = post.join(shared, "_key").groupBy("_cid", "node").agg(F.collect_list("_key").alias("_keys"))
    return keyed.drop("_keys").join(useful, ["_cid", "node"], "left")


ATTRIBUTES = ["_nurl", "_dom", "_toks"]


def _reached(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows ``a`` of ``x`` and later ``b`` of ``y`` under one key that reach the threshold, once for each key."""
    names = ["_cid", "node", *ATTRIBUTES]
    a = x.select("_key", *[F.col(c).alias(f"_a{c}") for c in names])
    j = a.join(y, "_key").filter((F.col("_a_cid") == F.col("_cid")) & (F.col("_anode") < F.col("node")))
    inter = F.size(F.array_intersect("_a_toks", "_toks")).cast("double")
    union = F.size(F.array_union("_a_toks", "_toks")).cast("double")
    score = _score((F.col("_a_nurl") == F.col("_nurl")).cast("double"), inter / union,
                   (F.col("_a_dom") == F.col("_dom")).cast("double"))
    return j.filter(score >= F.lit(threshold))


def elect_groups(nodes: DataFrame, threshold: float) -> DataFrame:
    """``(_cid, node, group_node)``: leaders lead themselves, members belong to the smallest earlier leader they reach."""
    live = materialize(_keyed_nodes(nodes, threshold).withColumn("_g", F.lit(None).cast("bigint")))
    alone = F.col("_keys").isNull()
    decided = [live.filter(alone).select("_cid", "node", F.col("node").alias("group_node"))]
    live = live.filter(~alone)
    k = 1
    while True:
        filed = live.select("_cid", "node", F.size("_keys").alias("_nk"), "_g", *ATTRIBUTES, F.explode("_keys").alias("_key"))
        first = Window.partitionBy("_key").orderBy("node", "_cid")
        # a row number below a constant is limited on the map side, so a hot key sends k rows of each task
        top = filed.filter(F.col("_g").isNull()).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
        top = materialize(top.drop("_r", "_g"))
        if top.isEmpty():
            break
        ready = top.groupBy("_cid", "node").agg(F.count(F.lit(1)).alias("_c"), F.first("_nk").alias("_nk"))
        ready = ready.filter(F.col("_c") == F.col("_nk")).select("_cid", "node")
        if k > 1:  # the only one under a key has no earlier one there
            ready = ready.join(_reached(top, top, threshold).select("_cid", "node").distinct(), ["_cid", "node"], "left_anti")
        ready = materialize(ready)
        decided.append(ready.select("_cid", "node", F.col("node").alias("group_node")))
        heads = top.join(ready, ["_cid", "node"], "left_semi")
        claims = (_reached(heads, filed, threshold).filter(F.col("_g").isNull() | (F.col("_anode") < F.col("_g")))
                  .groupBy("_cid", "node").agg(F.min("_anode").alias("_l")))
        # what has a leader before every node that was undecided in its collection cannot get an earlier one
        floor = top.groupBy("_cid").agg(F.min("node").alias("_floor"))
        state = (live.join(ready, ["_cid", "node"], "left_anti").join(claims, ["_cid", "node"], "left").join(floor, "_cid", "left")
                 .withColumn("_done", F.col("_g").isNotNull() & (F.col("_floor").isNull() | (F.col("_g") < F.col("_floor"))))
                 .withColumn("_g", F.least("_g", "_l")).drop("_l", "_floor"))
        state = materialize(state)
        decided.append(state.filter("_done").select("_cid", "node", F.col("_g").alias("group_node")))
        live = state.filter("not _done").drop("_done")
        _log.info("leader election: k = %d", k)
        k *= GROWTH
    out = live.select("_cid", "node", F.col("_g").alias("group_node"))
    for part in decided:
        out = out.unionByName(part)
    return out


SIGNATURE = ["_cid", "_nurl", "_dom", "_tkey"]


def mark_fuzzy_duplicates(links: DataFrame, cfg) -> DataFrame:
    """All rows with ``dup_first`` (group leader position, null when alone), ``dup_size`` and ``removed``."""
    return mark_fuzzy_each(links, [cfg.similarity_threshold], cfg.keep_strategy, cfg.label_col, cfg.length_col)[0]


def mark_fuzzy_each(links: DataFrame, thresholds, keep_strategy: str, label_col: str, length_col: str) -> list[DataFrame]:
    """``mark_fuzzy_duplicates`` for each threshold: rows are signed, collapsed and their words ranked once for all."""
    same = F.coalesce(F.concat(F.lit("c"), F.col("collection_id").cast("string")), F.lit("n"))
    rows = _signature_rows(links, label_col).withColumn("_cid", same)
    rows = materialize(rows.withColumn("_len", F.length(F.coalesce(F.col(length_col), F.lit(""))).cast("bigint")))
    # what the keep rules need of a node's rows travels with the node, so the rows themselves are joined once
    nodes = rows.groupBy(*SIGNATURE).agg(
        F.min("pos").alias("node"), F.first("_toks").alias("_toks"), F.count(F.lit(1)).alias("_n"), F.max("pos").alias("_last"),
        F.min(F.struct("_len", "pos")).alias("_short"), F.min(F.struct((-F.col("_len")).alias("_len"), "pos")).alias("_long"))
    nodes = materialize(nodes)
    words = nodes.select("_cid", "node", *ATTRIBUTES)
    if len(thresholds) > 1:
        words = materialize(with_rare_words(words))
    return [_marked(rows, nodes, words, float(t), keep_strategy).select(*links.columns, "dup_first", "dup_size", "removed")
            for t in thresholds]


def _marked(rows: DataFrame, nodes: DataFrame, words: DataFrame, t: float, keep_strategy: str) -> DataFrame:
    if t > 1.0 + EPS:
        groups = nodes.select("_cid", "node", F.col("node").alias("group_node"))
    else:
        groups = elect_groups(words, t)
    member = nodes.select(*SIGNATURE, "node", "_n", "_last", "_short", "_long").join(groups, ["_cid", "node"])
    stats = member.groupBy("_cid", "group_node").agg(
        F.sum("_n").alias("dup_size"), F.min("node").alias("_first"), F.max("_last").alias("_last"),
        F.min("_short")["pos"].alias("_short"), F.min("_long")["pos"].alias("_long"))
    survivor = {"last": "_last", "shortest": "_short", "longest": "_long"}.get(keep_strategy, "_first")
    stats = stats.select("_cid", "group_node", "dup_size", "_first", F.col(survivor).alias("_kept"))
    member = member.select(*SIGNATURE, "group_node").join(stats, ["_cid", "group_node"]).drop("group_node")
    g = rows.join(member, SIGNATURE)
    in_group = F.col("dup_size") > 1
    return (g.withColumn("removed", in_group & (F.col("pos") != F.col("_kept")))
            .withColumn("dup_first", F.when(in_group, F.col("_first")))
            .withColumn("dup_size", F.when(in_group, F.col("dup_size"))))


def fuzzy_pairs(links: DataFrame, threshold: float = 0.85, label_col: str = "formatted_label") -> DataFrame:
    """Every pair ``pos_a < pos_b`` in a collection with score >= threshold, from the blocked join.

    Clique classes (thresholds <= 0.7 make whole url/domain classes edges) are expanded
    here because the pair list itself is the requested output.
    """
    rows = _signature_rows(links, label_col).select("collection_id", F.col("pos").alias("node"), "_nurl", "_dom",
                                                    "_toks")
    rows = materialize(rows)
    cliques, joins = fuzzy_plan(threshold)
    edges = candidate_edges(rows, threshold, joins + [(k, EPS) for k in cliques])
    return edges.select("collection_id", F.col("a").alias("pos_a"), F.col("b").alias("pos_b"),
                        F.round("score", 6).alias("score"))
