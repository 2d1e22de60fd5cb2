"""DuckDB statements over the sources that reach the rare branches: refused URLs and colliding labels."""

from __future__ import annotations

from .oracle import B0, BV, _with, clean_title_ctes, domain_expr, links_ctes, sanitize_ctes, with_links

BARE = "regexp_replace(href, '^[a-z]+://', '')"
ODD = f"""bo AS (
  SELECT collection_id, pos, text, CASE pos % 10
      WHEN 0 THEN 'javascript:alert(''' || href || ''')'
      WHEN 1 THEN 'DATA:text/html,' || {BARE}
      WHEN 2 THEN {BARE}
      WHEN 3 THEN '//' || {BARE}
      WHEN 4 THEN '  ' || regexp_replace(href, '^([a-z]+://.)', '\\1' || chr(9)) || ' ' || chr(10)
      WHEN 5 THEN 'https://[' || {BARE}
      WHEN 6 THEN '' WHEN 7 THEN ' ' || chr(9) || ' ' WHEN 8 THEN NULL
      ELSE ' file:///' || {BARE} END AS href FROM b0)"""
NUMBERED = """bn AS (
  SELECT collection_id, pos, text, 'https://shop.example.com/'
         || CASE pos * 5 % 7 WHEN 2 THEN 'item-2' WHEN 3 THEN 'item-2-2' WHEN 4 THEN 'item-3' WHEN 6 THEN 'item-2' ELSE 'item' END AS href
  FROM b0)"""


def statements() -> dict[str, str]:
    odd = _with(B0, ODD, sanitize_ctes("bo", "san")) + f"""
SELECT collection_id, pos, href, url, dangerous, url <> '' AS kept, {domain_expr('url')} AS domain FROM san"""
    # one row after the other: the part itself where it is free, else with the first free number
    numbered = "WITH RECURSIVE " + B0 + ",\n" + NUMBERED + links_ctes("bn", "links") + """,
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY collection_id, domain ORDER BY pos) AS i FROM links_l3),
walk(collection_id, domain, i, used) AS (
  SELECT DISTINCT collection_id, domain, 0::BIGINT, []::VARCHAR[] FROM ordered
  UNION ALL
  SELECT w.collection_id, w.domain, o.i, list_append(w.used, CASE WHEN NOT list_contains(w.used, o.part) THEN o.part
      ELSE o.part || ' ' || list_filter(range(2, o.i + 2), lambda n: NOT list_contains(w.used, o.part || ' ' || n))[1] END)
  FROM walk w JOIN ordered o ON o.collection_id = w.collection_id AND o.domain = w.domain AND o.i = w.i + 1)
SELECT o.collection_id, o.pos, o.part,
       o.domain || ' | ' || CASE WHEN o.domain_links = 1 THEN o.clean_title ELSE w.used[len(w.used)] END AS formatted_label
FROM ordered o JOIN walk w ON w.collection_id = o.collection_id AND w.domain = o.domain AND w.i = o.i"""
    # DuckDB's distance is over bytes: other than ASCII characters of a pair become control characters first
    plain = "list_reduce(list_prepend({x}, odd), lambda acc, c, i: replace(acc, c, chr(CAST(i AS INTEGER))))"
    ratio = _with(B0, BV, clean_title_ctes("bv", "text", "ct")) + f""",
odd AS (
  SELECT *, list_distinct(list_filter(string_split(text || clean_title, ''), lambda c: unicode(c) > 127)) AS odd FROM ct),
two AS (
  SELECT *, CASE WHEN len(odd) = 0 THEN text ELSE {plain.format(x="text")} END AS a,
         CASE WHEN len(odd) = 0 THEN clean_title ELSE {plain.format(x="clean_title")} END AS b FROM odd)
SELECT collection_id, pos, round(CASE WHEN text = clean_title THEN 1.0 WHEN text = '' OR clean_title = '' THEN 0.0
       ELSE (greatest(length(a), length(b)) - levenshtein(a, b))::DOUBLE / greatest(length(a), length(b))::DOUBLE END, 6) AS lev_ratio FROM two"""
    places = with_links("bv") + """
SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY pos) - 1 AS place, pos, url, formatted_label FROM links"""
    return {"levenshtein_ratio": ratio, "link_places": places, "sanitize_odd_urls": odd, "labels_numbered": numbered}
