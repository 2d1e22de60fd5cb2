"""Composite flows (C1-C5): what one run of the tool does, as DataFrame-in/DataFrame-out steps.

Flows checkpoint what they reuse; outputs go to a folder for each ``job_id``, so reruns of one
job never overwrite another's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import DedupConfig, dense_members, duplicate_groups, duplicate_metrics, mark_duplicates
from ..operators.health import attach_status, broken_links, health_summary
from ..operators.labels import build_links
from ..operators.outline import match_outline, outline_entries
from ..session import materialize
from ..sinks.export import flat_export, instructions_export, structured_export, write_lines
from ..sinks.files import write_documents
from ..sinks.render import relabel_html, render_netscape_lines
from ..sinks.report import duplicate_report_lines, report_json_lines, report_rows, report_summary
from ..sources.html import anchors_as_links, scan_anchors, scan_folders
from ..sources.outline import outline_lines


def clean(docs: DataFrame) -> DataFrame:
    """Documents ``(collection_id, html)`` -> labelled links (schema L)."""
    return build_links(anchors_as_links(scan_anchors(docs)))


@dataclass
class CleanRun:
    links: DataFrame        # all labelled links
    marked: DataFrame       # links with dup_first / dup_size / removed
    kept: DataFrame         # surviving links
    groups: DataFrame        # members of the duplicate groups
    metrics: DataFrame
    report_lines: DataFrame


def clean_and_dedup(links: DataFrame, cfg: DedupConfig = DedupConfig()) -> CleanRun:
    """C2 core: de-duplicate labelled links and build the duplicate report rows."""
    marked = materialize(mark_duplicates(links, cfg))
    kept = marked.filter(~F.col("removed")).select(*links.columns)
    metrics = duplicate_metrics(marked, cfg.strategy)
    groups = materialize(duplicate_groups(marked, cfg.strategy))
    lines = duplicate_report_lines(dense_members(groups, marked), metrics, cfg.strategy, cfg.similarity_threshold, cfg.keep_strategy)
    return CleanRun(links, marked, kept, groups, metrics, lines)


def write_clean_run(docs: DataFrame, run: CleanRun, out_dir: str, job_id: str, generation_date: str = "") -> None:
    """C2 sinks: report rows and summary, the nested JSON report, duplicate report text and relabelled HTML files."""
    base = out_dir.rstrip("/")
    # a folder for each job, so that a rerun replaces its own output only
    report_rows(run.kept, job_id).write.mode("overwrite").partitionBy("collection_id").json(f"{base}/reports/{job_id}/rows")
    report_summary(run.kept, job_id).write.mode("overwrite").json(f"{base}/reports/{job_id}/summary")
    write_lines(report_json_lines(run.kept, job_id, generation_date), f"{base}/reports/{job_id}/report")
    write_lines(run.report_lines, f"{base}/reports/{job_id}/duplicates")
    write_documents(relabel_html(docs, scan_anchors(docs), run.kept), f"{base}/cleaned/{job_id}")


def organise(outlines: DataFrame, links: DataFrame, timestamp: str = "0") -> DataFrame:
    """Outline texts + original links -> Netscape file lines per outline."""
    entries = materialize(outline_entries(outline_lines(outlines)))
    return render_netscape_lines(entries, match_outline(entries, links), timestamp)


def export(links: DataFrame, kind: str = "flat", docs: DataFrame | None = None) -> DataFrame:
    """C4: ``flat`` (K4), ``instructions`` (K5) or ``structured`` (K6, needs the documents)."""
    if kind == "flat":
        return flat_export(links)
    if kind == "instructions":
        return instructions_export(links)
    if kind == "structured":
        if docs is None:
            raise ValueError("structured export needs the source documents")
        return structured_export(scan_folders(docs), links)
    raise ValueError(f"unknown export kind: {kind}")


def link_health(links: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with status, the per-collection summary and the broken-link listing."""
    checked = materialize(attach_status(links, status))
    return checked, health_summary(checked), broken_links(checked)
