"""DuckDB statements of the file outputs: relabelled documents (K2) and the nested JSON report (K1)."""

from __future__ import annotations

from .oracle import B0, BV, JOB_ID, STATUS, _with, links_ctes, normalize_ctes, sanitize_ctes, strip, with_links


def _escaped(x: str, quote: bool) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace(replace({out}, '\"', '&quot;'), '''', '&#x27;')" if quote else out


def relabel_sql() -> str:
    """Documents of 500 pages, each page in four spellings: items of dropped links go, labels replace texts."""
    src = """src AS (
  SELECT collection_id || '/' || CAST(floor(pos / 2000) AS BIGINT) AS collection_id, collection_id AS lang,
         split_part(href, '/', 3) AS host, pos AS page_pos, href AS raw, text AS title,
         row_number() OVER (PARTITION BY collection_id, floor(pos / 2000) ORDER BY split_part(href, '/', 3), pos) - 1 AS pos
  FROM bv)"""
    anchors = f"""anc AS (SELECT collection_id, lang, host, page_pos, raw, pos, title, {strip('raw')} AS href, {strip('title')} AS text FROM src)"""
    return _with(B0, BV, src, anchors) + links_ctes("anc", "links") + f""",
{normalize_ctes("links", "url", "nl", "nurl")},
kept AS (SELECT * FROM nl QUALIFY row_number() OVER (PARTITION BY collection_id, nurl ORDER BY pos) = 1),
label_of AS (SELECT collection_id, url, arg_max(formatted_label, pos) AS label FROM kept GROUP BY collection_id, url),
{sanitize_ctes("anc", "sa")},
decided AS (
  SELECT a.*, CASE WHEN row_number() OVER (PARTITION BY a.collection_id, a.url ORDER BY a.pos) = 1 THEN l.label END AS label
  FROM sa a LEFT JOIN label_of l ON l.collection_id = a.collection_id AND l.url = a.url),
dropped AS (SELECT collection_id, count(*) FILTER (WHERE label IS NULL) AS n FROM decided GROUP BY collection_id),
lines AS (
  SELECT d.collection_id, 0 AS sec, '' AS host, 0 AS phase, t.i AS k, CASE t.i
      WHEN 0 THEN '<!DOCTYPE NETSCAPE-Bookmark-file-1>'
      WHEN 1 THEN '<META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=UTF-8"><!-- ' || d.n || ' duplicates removed; labels rewritten -->'
      WHEN 2 THEN '<TITLE>Bookmarks</TITLE>' WHEN 3 THEN '<H1>Bookmarks</H1>' ELSE '<DL><p>' END AS line
  FROM dropped d, range(0, 5) t(i)
  UNION ALL
  SELECT h.collection_id, 1, h.host, 0, t.i, CASE
      WHEN t.i = 0 THEN '<DT><H3>' || {_escaped('h.host', False)} || '</H3>' || CASE WHEN h.lang = 'de' THEN '</DT>' ELSE '' END
      WHEN h.lang = 'de' THEN '<DD><DL><p>' ELSE '<DL><p>' END
  FROM (SELECT DISTINCT collection_id, lang, host FROM src) h, range(0, 2) t(i)
  UNION ALL
  SELECT collection_id, 1, host, 1, page_pos, '<DT><A HREF="' || {_escaped('raw', True)} || '" ADD_DATE="' || page_pos || '">'
         || {_escaped('label', False)} || '</A>'
  FROM decided WHERE label IS NOT NULL
  UNION ALL
  SELECT DISTINCT collection_id, 1, host, 2, 0, CASE lang WHEN 'de' THEN '</DL></DD>' WHEN 'fr' THEN '</DL></DT>' ELSE '</DL><p>' END FROM src
  UNION ALL
  SELECT collection_id, 2, '', 0, 0, '</DL><p>' FROM dropped)
SELECT collection_id, string_agg(line, chr(10) ORDER BY sec, host, phase, k) AS html FROM lines GROUP BY collection_id"""


def _json(x: str) -> str:
    marked = f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
    shown = ("CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' "
             "WHEN c = chr(9) THEN '\\t' WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' "
             "WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c)) "
             "ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END")
    return f"'\"' || array_to_string(list_transform(string_split({marked}, ''), lambda c: {shown}), '') || '\"'"


def report_json_sql() -> str:
    texts = ["original_title", "clean_title", "formatted_label", "domain", "url"]
    fields = [f"""'      "{c}": ' || coalesce({_json(c)}, 'null') || ','""" for c in texts]
    fields.append("""'      "is_valid": ' || coalesce(CAST(is_valid AS VARCHAR), 'null') || ','""")
    fields.append("""'      "status_code": ' || coalesce(CAST(status_code AS VARCHAR), 'null')""")
    item = ", ".join(["'    {'", *fields, "CASE WHEN n < total THEN '    },' ELSE '    }' END"])
    head = f"""['{{', '  "generation_date": "2026-01-01 00:00:00",', '  "source_file": ' || {_json('collection_id')} || ',',
      '  "job_id": "{JOB_ID}",', '  "summary": {{', '    "total_bookmarks": ' || total || ',',
      '    "original_structure_preserved": true,', '    "labels_cleaned": true,', '    "duplicates_handled": true', '  }},',
      '  "bookmarks": [']"""
    return with_links("b0") + ",\n" + STATUS + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY collection_id) AS total FROM checked),
heads AS (SELECT collection_id, max(total) AS total FROM ranked GROUP BY collection_id),
pieces AS (
  SELECT collection_id, 0 AS line0, {head} AS part FROM heads
  UNION ALL SELECT collection_id, 11 + (n - 1) * 9, [{item}] FROM ranked
  UNION ALL SELECT collection_id, 11 + total * 9, ['  ]', '}}'] FROM heads)
SELECT collection_id, CAST(line0 + unnest(generate_series(0, len(part) - 1)) AS BIGINT) AS line_no, unnest(part) AS line FROM pieces"""


def statements() -> dict[str, str]:
    return {"relabel_html": relabel_sql(), "report_json": report_json_sql()}
