"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_unescape_basic
from ..functions.titles import levenshtein_ratio, preview, title_similarity, with_clean_title
from ..functions.urls import extract_domain, is_dangerous_url, with_normalized_url, with_sanitized_url
from ..operators.dedup import (
    DedupConfig, dense_members, duplicate_groups, duplicate_metrics, duplicate_pairs, mark_duplicates, remove_duplicates,
    strategy_comparison, whole_groups, with_place,
)
from ..operators.health import attach_status, broken_links, health_summary
from ..operators.outline import match_outline, outline_entries
from ..sinks.export import flat_export, instructions_export
from ..sinks.render import relabel_html, render_netscape_lines
from ..sources.outline import outline_lines
from ..sinks.report import duplicate_report_lines, report_json_lines, report_rows, report_summary
from ..operators.fuzzy import fuzzy_pairs
from ..session import materialize
from ..operators.labels import build_links
from ..sources.html import anchors_as_links, scan_anchors, scan_folders
from ..sources.tables import (
    link_status_view, page_bookmark_documents, page_link_variants, page_links, page_numbered_links, page_odd_links, read_table,
    supplier_outline_links, supplier_outlines,
)
from ..sinks.export import structured_export

Query = Callable[[SparkSession, str], DataFrame]


def _bv(spark, sf):
    return page_link_variants(spark, sf)


def _links(spark, sf, variants=True):
    return build_links(_bv(spark, sf) if variants else page_links(spark, sf))


def q_sanitize_urls(spark, sf):
    df = with_sanitized_url(_bv(spark, sf), "href", "url")
    return df.select("collection_id", "pos", "href", "url", is_dangerous_url(F.col("href")).alias("dangerous"),
                     (F.col("url") != "").alias("kept"))


def q_sanitize_odd_urls(spark, sf):
    """P1, F2, F1 on spellings that are refused or mended."""
    df = with_sanitized_url(page_odd_links(spark, sf), "href", "url")
    return df.select("collection_id", "pos", "href", "url", is_dangerous_url(F.col("href")).alias("dangerous"),
                     (F.col("url") != "").alias("kept"), extract_domain(F.col("href")).alias("domain"))


def q_labels_numbered(spark, sf):
    """W4 where numbered labels meet parts that look like them."""
    src = materialize(page_numbered_links(spark, sf))  # else the URL's making is repeated in every cleaning step
    return build_links(src).select("collection_id", "pos", "part", "formatted_label")


def q_domains(spark, sf):
    return _bv(spark, sf).select("collection_id", "pos", "href", extract_domain(F.col("href")).alias("domain"))


def q_normalize_urls(spark, sf):
    return with_normalized_url(_bv(spark, sf), "href", "normalized_url").select(
        "collection_id", "pos", "href", "normalized_url")


def q_clean_titles(spark, sf):
    return with_clean_title(_bv(spark, sf), "text", "clean_title").select("collection_id", "pos", "text", "clean_title")


def q_title_scores(spark, sf):
    df = with_clean_title(_bv(spark, sf), "text", "clean_title")
    return df.select("collection_id", "pos",
                     F.round(title_similarity(F.col("text"), F.col("clean_title")), 6).alias("title_sim"))


def q_levenshtein_ratio(spark, sf):
    """P7 per title pair (character based; DuckDB's levenshtein counts bytes, so no SQL statement)."""
    df = with_clean_title(_bv(spark, sf), "text", "clean_title")
    return df.select("collection_id", "pos",
                     F.round(levenshtein_ratio(F.col("text"), F.col("clean_title")), 6).alias("lev_ratio"))


def q_domain_counts(spark, sf):
    return _links(spark, sf).groupBy("collection_id", "domain").agg(F.count(F.lit(1)).alias("n_links"))


def q_cleaning_examples(spark, sf, n: int = 5):
    """L1/P10: the first ``n`` links of each collection with a title preview (a top-k report)."""
    links = _links(spark, sf, variants=False)
    w = Window.partitionBy("collection_id").orderBy("pos")
    top = links.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return top.select("collection_id", "pos", preview(F.col("original_title"), 60).alias("title_preview"),
                      "formatted_label")


def q_labels(spark, sf):
    return _links(spark, sf).select("collection_id", "pos", "url", "domain", "domain_links", "domain_ordinal", "part",
                                    "formatted_label")


def _kept(spark, sf, cfg: DedupConfig):
    m = mark_duplicates(_links(spark, sf), cfg)
    return m.filter(~F.col("removed")).select("collection_id", "pos", "url", "formatted_label")


def q_dedup(strategy: str, keep: str, label_col: str = "formatted_label", threshold: float = 0.85) -> Query:
    return lambda spark, sf: _kept(spark, sf, DedupConfig(strategy, threshold, keep, "pairwise", label_col))


def q_dup_groups(strategy: str, label_col: str = "formatted_label") -> Query:
    def run(spark, sf):
        cfg = DedupConfig(strategy=strategy, label_col=label_col)
        return duplicate_pairs(mark_duplicates(_links(spark, sf), cfg), strategy)
    return run


def q_dup_groups_fuzzy(spark, sf):
    """A5: the members of every fuzzy group."""
    return whole_groups(materialize(mark_duplicates(_links(spark, sf), DedupConfig("fuzzy", 0.6))))


def q_dup_metrics(spark, sf):
    return duplicate_metrics(mark_duplicates(_links(spark, sf), DedupConfig(strategy="url")))


def q_dup_metrics_fuzzy(spark, sf):
    return duplicate_metrics(mark_duplicates(_links(spark, sf), DedupConfig("fuzzy", 0.6)), "fuzzy")


def q_link_places(spark, sf):
    """Every link with its place in its collection, counted from 0."""
    return with_place(_links(spark, sf)).select("collection_id", "place", "pos", "url", "formatted_label")


def q_strategy_comparison(spark, sf):
    """Rows left and removed per strategy, keep strategy and threshold over one keyed link table."""
    return strategy_comparison(_links(spark, sf))


def q_fuzzy_pairs(threshold: float) -> Query:
    return lambda spark, sf: fuzzy_pairs(_links(spark, sf), threshold)


def q_link_scan(spark, sf):
    """S2 + P1 over the raw pages: every anchor, its sanitised URL ('' when rejected)."""
    pages = read_table(spark, sf, "pages")
    docs = pages.select(F.col("page_id").cast("string").alias("collection_id"), "html")
    a = with_sanitized_url(scan_anchors(docs), "href", "url")
    return a.select(F.col("collection_id").cast("bigint").alias("page_id"), "anchor_no", "href", "text", "url")


def _doc_entries(spark, sf):
    return scan_folders(page_bookmark_documents(spark, sf))


def q_folder_entries(spark, sf):
    return _doc_entries(spark, sf).select("collection_id", "seq", "type", "name", "url", "title", "path", "depth",
                                          "add_date")


def q_folder_summary(spark, sf):
    """Bookmarks per folder path of each document."""
    e = _doc_entries(spark, sf).filter(F.col("type") == "bookmark")
    return e.groupBy("collection_id", "path").agg(F.count(F.lit(1)).alias("n_links"))


def q_export_structured(spark, sf):
    """K6: the folder tree as indented text lines, labels looked up by URL."""
    docs = materialize(page_bookmark_documents(spark, sf))
    links = build_links(anchors_as_links(scan_anchors(docs)))
    return structured_export(scan_folders(docs), links)


JOB_ID = "job_20260101_000000_pages"


def _checked(spark, sf):
    return attach_status(_links(spark, sf, variants=False), link_status_view(spark, sf))


def q_link_health(spark, sf):
    return _checked(spark, sf).select("collection_id", "pos", "url", "is_valid", "status_code", "error")


def q_health_summary(spark, sf):
    return health_summary(_checked(spark, sf))


def q_broken_links(spark, sf):
    return broken_links(_checked(spark, sf))


def q_report_rows(spark, sf):
    return report_rows(_checked(spark, sf), JOB_ID)


def q_report_summary(spark, sf):
    kept = remove_duplicates(_links(spark, sf), DedupConfig(strategy="url"))
    return report_summary(kept, JOB_ID)


def q_report_json(spark, sf):
    """K1 nested: the JSON report of each collection, as lines."""
    return report_json_lines(_checked(spark, sf), JOB_ID, "2026-01-01 00:00:00")


def q_dup_report(strategy: str, threshold: float = 0.85, keep: str = "first") -> Query:
    """K7: the lines of the duplicate report."""
    def run(spark, sf):
        marked = materialize(mark_duplicates(_links(spark, sf), DedupConfig(strategy, threshold, keep)))
        members = dense_members(duplicate_groups(marked, strategy), marked)
        return duplicate_report_lines(members, duplicate_metrics(marked), strategy, threshold, keep)
    return run


def q_export_flat(spark, sf):
    return flat_export(remove_duplicates(_links(spark, sf), DedupConfig(strategy="url")))


def q_export_instructions(spark, sf):
    return instructions_export(remove_duplicates(_links(spark, sf), DedupConfig(strategy="url")))


def _outline_entries(spark, sf):
    return outline_entries(outline_lines(supplier_outlines(spark, sf)))


def q_outline_parse(spark, sf):
    """S4 + F5 + W6: every folder and bookmark line of the generated outlines with its folder path."""
    return _outline_entries(spark, sf)


def q_organise_match(spark, sf):
    """Outline bookmarks matched to the outline's original links."""
    links = build_links(supplier_outline_links(spark, sf))
    return match_outline(_outline_entries(spark, sf), links)


def q_render_netscape(spark, sf):
    """K3: organised bookmark files (as ordered lines) from the outlines."""
    entries = materialize(_outline_entries(spark, sf))
    links = build_links(supplier_outline_links(spark, sf))
    return render_netscape_lines(entries, match_outline(entries, links))


def q_relabel_html(spark, sf):
    """K2: generated bookmark files (every page in four spellings) rewritten with clean labels and
    URL duplicates removed."""
    docs = materialize(page_bookmark_documents(spark, sf, variants=True))
    anchors = materialize(scan_anchors(docs))
    kept = remove_duplicates(build_links(anchors_as_links(anchors)), DedupConfig(strategy="url"))
    return relabel_html(docs, anchors, kept)


def registry() -> dict[str, Query]:
    q: dict[str, Query] = {
        "sanitize_urls": q_sanitize_urls,
        "sanitize_odd_urls": q_sanitize_odd_urls,
        "domains": q_domains,
        "normalize_urls": q_normalize_urls,
        "clean_titles": q_clean_titles,
        "title_scores": q_title_scores,
        "levenshtein_ratio": q_levenshtein_ratio,
        "domain_counts": q_domain_counts,
        "cleaning_examples": q_cleaning_examples,
        "labels": q_labels,
        "labels_numbered": q_labels_numbered,
    }
    for keep in ("first", "last", "shortest", "longest"):
        q[f"dedup_url_{keep}"] = q_dedup("url", keep)
    q["dedup_smart_first"] = q_dedup("smart", "first")
    q["dedup_smart_longest"] = q_dedup("smart", "longest")
    q["dedup_title_clean"] = q_dedup("title", "first", "clean_title")
    q["dedup_title_label"] = q_dedup("title", "first")
    q["dup_groups_url"] = q_dup_groups("url")
    q["dup_groups_smart"] = q_dup_groups("smart")
    q["dup_groups_title"] = q_dup_groups("title", "clean_title")
    q["dup_groups_fuzzy"] = q_dup_groups_fuzzy
    q["dup_metrics_url"] = q_dup_metrics
    q["dup_metrics_fuzzy"] = q_dup_metrics_fuzzy
    q["link_places"] = q_link_places
    q["strategy_comparison"] = q_strategy_comparison
    q["fuzzy_pairs_085"] = q_fuzzy_pairs(0.85)
    q["fuzzy_pairs_060"] = q_fuzzy_pairs(0.60)
    q["dedup_fuzzy_085"] = q_dedup("fuzzy", "first", threshold=0.85)
    q["dedup_fuzzy_060"] = q_dedup("fuzzy", "first", threshold=0.60)
    q["dedup_fuzzy_030_longest"] = q_dedup("fuzzy", "longest", threshold=0.30)
    q["link_scan"] = q_link_scan
    q["folder_entries"] = q_folder_entries
    q["folder_summary"] = q_folder_summary
    q["export_structured"] = q_export_structured
    q["link_health"] = q_link_health
    q["health_summary"] = q_health_summary
    q["broken_links"] = q_broken_links
    q["report_rows"] = q_report_rows
    q["report_summary"] = q_report_summary
    q["report_json"] = q_report_json
    q["dup_report"] = q_dup_report("url")
    q["dup_report_fuzzy"] = q_dup_report("fuzzy", 0.6, "longest")
    q["export_flat"] = q_export_flat
    q["export_instructions"] = q_export_instructions
    q["outline_parse"] = q_outline_parse
    q["organise_match"] = q_organise_match
    q["render_netscape"] = q_render_netscape
    q["relabel_html"] = q_relabel_html
    return q
