"""DuckDB statements of fuzzy duplicate removal: all pairs scored, leaders by a recursive walk over the rows."""

from __future__ import annotations

from .oracle import fuzzy_groups_ctes

_SURVIVOR = {"first": "i", "last": "-i", "shortest": "length(formatted_label), i", "longest": "-length(formatted_label), i"}


def dedup_fuzzy_sql(threshold: float, keep: str) -> str:
    return fuzzy_groups_ctes(threshold) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection_id, lead ORDER BY {_SURVIVOR[keep]}) AS rn FROM grouped)
SELECT collection_id, pos, url, formatted_label FROM ranked WHERE rn = 1"""


GROUPS = """,
firsts AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY i) AS group_no FROM grouped WHERE members > 1 AND i = lead),
mem AS (
  SELECT g.*, f.group_no, row_number() OVER (PARTITION BY g.collection_id, g.lead ORDER BY g.i) AS member_no
  FROM grouped g JOIN firsts f ON f.collection_id = g.collection_id AND f.lead = g.lead)"""


def dup_report_fuzzy_sql(threshold: float, keep: str) -> str:
    return fuzzy_groups_ctes(threshold) + GROUPS + f""",
places AS (SELECT collection_id, group_no, members, 5 + sum(members + 2) OVER (PARTITION BY collection_id ORDER BY group_no) - members AS line0
       FROM firsts),
meta AS (SELECT g.collection_id, count(*) - count(DISTINCT lead) AS gone,
                (SELECT count(*) FROM firsts f WHERE f.collection_id = g.collection_id) AS ng FROM grouped g GROUP BY g.collection_id)
SELECT collection_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT collection_id, 0 AS line_no, 'No duplicates found.' AS line FROM meta WHERE ng = 0
  UNION ALL SELECT collection_id, k, CASE k WHEN 0 THEN 'Duplicate Analysis Report - Strategy: fuzzy'
      WHEN 1 THEN 'Similarity Threshold: {threshold!r}' WHEN 2 THEN 'Keep Strategy: {keep}'
      WHEN 3 THEN 'Total Duplicates Removed: ' || gone WHEN 4 THEN 'Duplicate Groups Found: ' || ng
      WHEN 5 THEN '' ELSE 'Duplicate Groups:' END
    FROM meta, range(0, 7) t(k) WHERE ng > 0
  UNION ALL SELECT collection_id, line0 + k, CASE k WHEN 0 THEN '' ELSE 'Group ' || group_no || ': ' || members || ' duplicates' END
    FROM places, range(0, 2) t(k)
  UNION ALL SELECT m.collection_id, a.line0 + 1 + m.member_no, '  - Index ' || m.i
    FROM mem m JOIN places a ON a.collection_id = m.collection_id AND a.group_no = m.group_no)"""


def statements() -> dict[str, str]:
    return {
        "dedup_fuzzy_085": dedup_fuzzy_sql(0.85, "first"),
        "dedup_fuzzy_060": dedup_fuzzy_sql(0.60, "first"),
        "dedup_fuzzy_030_longest": dedup_fuzzy_sql(0.30, "longest"),
        "dup_groups_fuzzy": fuzzy_groups_ctes(0.60) + GROUPS + """
SELECT collection_id, group_no, members AS size, member_no, pos FROM mem""",
        "dup_metrics_fuzzy": fuzzy_groups_ctes(0.60) + """
SELECT collection_id, count(*) AS rows_before, count(*) - count(DISTINCT lead) AS rows_removed, count(DISTINCT lead) AS rows_after,
       count(DISTINCT lead) FILTER (WHERE members > 1) AS groups FROM grouped GROUP BY collection_id""",
        "dup_report_fuzzy": dup_report_fuzzy_sql(0.60, "longest"),
    }
