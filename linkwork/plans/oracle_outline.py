"""DuckDB statements for the outline queries, built from region/nation/supplier by construction."""

from __future__ import annotations

from ..sinks.render import NETSCAPE_FOOTER, netscape_header
from .oracle import _q, _with, links_ctes

OUTLINE = """sup AS (
  SELECT s.s_suppkey, s.s_name, s.s_acctbal, n.n_nationkey, n.n_name, r.r_regionkey, r.r_name,
         r.r_name || '#' || CAST(floor(s.s_suppkey / 500) AS BIGINT) AS collection_id
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
outl AS (SELECT DISTINCT collection_id, r_regionkey, r_name FROM sup),
nat AS (SELECT o.collection_id, o.r_name, n.n_nationkey, n.n_name FROM outl o JOIN nation n ON n.n_regionkey = o.r_regionkey),
olines AS (
  SELECT collection_id, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 'FOLDER: ' || r_name AS line, 'folder' AS kind, 0 AS level,
         r_name AS name, NULL AS domain, NULL AS title, r_name AS folder_path FROM outl
  UNION ALL SELECT collection_id, 1, n_nationkey, 0, 0, '  ' || lower(n_name) || '.example.org | ' || n_name, 'bookmark', 1,
         NULL, lower(n_name) || '.example.org', n_name, r_name FROM nat
  UNION ALL SELECT collection_id, 2, n_nationkey, 0, 0, '  FOLDER: ' || n_name, 'folder', 1, n_name, NULL, NULL,
         r_name || '/' || n_name FROM nat
  UNION ALL SELECT collection_id, 2, n_nationkey, 1, s_suppkey,
         '    s' || s_suppkey || '.example.com | ' || CASE WHEN s_acctbal < 0 THEN s_name || ' (closed)' ELSE s_name END,
         'bookmark', 2, NULL, 's' || s_suppkey || '.example.com',
         CASE WHEN s_acctbal < 0 THEN s_name || ' (closed)' ELSE s_name END, r_name || '/' || n_name FROM sup
  UNION ALL SELECT collection_id, 1, n_nationkey, 1, 0, '  ' || lower(n_name) || '.example.org | ' || lower(substr(n_name, 2, 4)),
         'bookmark', 1, NULL, lower(n_name) || '.example.org', lower(substr(n_name, 2, 4)), r_name FROM nat
  UNION ALL SELECT collection_id, x.a, x.b, 0, 0, x.line, x.kind, x.level, x.name, x.domain, x.title, coalesce(x.path, r_name)
  FROM outl, (VALUES
    (0, 1, '', NULL, NULL, NULL, NULL, NULL, NULL), (0, 2, '# made from the supplier table', NULL, NULL, NULL, NULL, NULL, NULL),
    (0, 3, 'neither folder nor bookmark', NULL, NULL, NULL, NULL, NULL, NULL),
    (1, 1000, '  missing.example.net | Nobody', 'bookmark', 1, NULL, 'missing.example.net', 'Nobody', NULL),
    (4, 0, 'FOLDER: Archive', 'folder', 0, 'Archive', NULL, NULL, 'Archive'),
    (4, 1, '  old.example.net | Old', 'bookmark', 1, NULL, 'old.example.net', 'Old', 'Archive'),
    (4, 2, '    FOLDER: Inner', 'folder', 2, 'Inner', NULL, NULL, 'Archive/Unknown/Inner'),
    (4, 3, '      deep.example.net | Deep', 'bookmark', 3, NULL, 'deep.example.net', 'Deep', 'Archive/Unknown/Inner'))
    x(a, b, line, kind, level, name, domain, title, path)),
oentries AS (
  SELECT * FROM (
  SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY a, b, c, d, line) AS line_no, kind,
         CAST(level AS INTEGER) AS level, name, domain, title, folder_path,
         CASE WHEN kind = 'bookmark' THEN domain || ' | ' || title END AS formatted_label, a, b, c, d
  FROM olines) WHERE kind IS NOT NULL),
orig AS (
  SELECT collection_id, CAST(n_nationkey AS BIGINT) AS pos, 'https://' || lower(n_name) || '.example.org/' AS href,
         n_name AS text FROM nat
  UNION ALL SELECT collection_id, 1000 + 2 * s_suppkey, 'https://s' || s_suppkey || '.example.com/contact', 'Contact' FROM sup
  UNION ALL SELECT collection_id, 1000 + 2 * s_suppkey + 1, 'https://s' || s_suppkey || '.example.com/', s_name FROM sup)"""

MATCH = """ex AS (SELECT collection_id, formatted_label, arg_max(url, pos) AS url FROM links GROUP BY collection_id, formatted_label),
m1 AS (SELECT o.*, ex.url AS exact_url FROM oentries o LEFT JOIN ex USING (collection_id, formatted_label)
       WHERE o.kind = 'bookmark'),
cand AS (
  SELECT m1.collection_id, m1.line_no, l.url,
         row_number() OVER (PARTITION BY m1.collection_id, m1.line_no ORDER BY
           CASE WHEN contains(lower(l.clean_title), lower(m1.title)) OR contains(lower(l.original_title), lower(m1.title))
                THEN 0 ELSE 1 END, l.pos) AS rk
  FROM m1 JOIN links l ON l.collection_id = m1.collection_id AND l.domain = m1.domain WHERE m1.exact_url IS NULL),
matched AS (
  SELECT m1.*, coalesce(m1.exact_url, cand.url,
                        CASE WHEN starts_with(m1.domain, 'http') THEN m1.domain ELSE 'https://' || m1.domain END) AS url,
         CASE WHEN m1.exact_url IS NOT NULL THEN 'label' WHEN cand.url IS NOT NULL THEN 'domain' ELSE 'default' END
           AS match_kind
  FROM m1 LEFT JOIN cand ON cand.collection_id = m1.collection_id AND cand.line_no = m1.line_no AND cand.rk = 1)"""


def esc(x: str, quote: bool = True) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    if quote:
        out = f"""replace(replace({out}, '"', '&quot;'), '''', '&#x27;')"""
    return out


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["outline_parse"] = _with(OUTLINE) + """
SELECT collection_id, CAST(line_no AS BIGINT) AS line_no, kind, level, name, domain, title, folder_path, formatted_label
FROM oentries"""
    s["organise_match"] = _with(OUTLINE) + links_ctes("orig", "links") + ",\n" + MATCH + """
SELECT collection_id, CAST(line_no AS BIGINT) AS line_no, folder_path, formatted_label, domain, title, url,
       CAST(NULL AS VARCHAR) AS add_date, CAST(NULL AS VARCHAR) AS icon, match_kind FROM matched"""
    head = " UNION ALL ".join(f"SELECT {i} AS i, {_q(h)} AS h" for i, h in enumerate(netscape_header("0")))
    foot = " UNION ALL ".join(f"SELECT {i} AS i, {_q(h)} AS h" for i, h in enumerate(NETSCAPE_FOOTER))
    mark = """'<DT><A HREF="' || """ + esc("url") + """ || '">' || """ + esc("formatted_label", False) + " || '</A>'"
    h3 = """'<DT><H3 ADD_DATE="0" LAST_MODIFIED="0">' || """ + esc("name", False) + " || '</H3>'"
    s["render_netscape"] = _with(OUTLINE) + links_ctes("orig", "links") + ",\n" + MATCH + f""",
fl AS (SELECT collection_id, line_no AS fl_no, a, b, name FROM oentries WHERE kind = 'folder'),
docs AS (SELECT DISTINCT collection_id FROM oentries),
head AS ({head}), foot AS ({foot}),
top AS (SELECT DISTINCT collection_id, r_name FROM outl),
plain AS (SELECT * FROM (VALUES (0, 'Archive', '        '), (2, 'Unknown', '            '), (4, 'Inner', '                ')) v(k, name, ind)),
keyed AS (
  SELECT collection_id, 0 AS sec, '' AS t, 0 AS k1, 0 AS k2, i AS k3, h AS line FROM docs, head
  UNION ALL SELECT collection_id, 1, name, 0, 0, 0, '        ' || {h3} FROM fl WHERE a = 0
  UNION ALL SELECT collection_id, 1, name, 0, 0, 1, '        <DL><p>' FROM fl WHERE a = 0
  UNION ALL SELECT collection_id, 1, r_name, 0, 1, line_no, '            ' || {mark} FROM matched JOIN top USING (collection_id) WHERE a = 1
  UNION ALL SELECT collection_id, 1, r_name, fl_no, 0, 0, '            ' || {h3} FROM fl JOIN top USING (collection_id) WHERE a = 2
  UNION ALL SELECT collection_id, 1, r_name, fl_no, 0, 1, '            <DL><p>' FROM fl JOIN top USING (collection_id) WHERE a = 2
  UNION ALL SELECT m.collection_id, 1, r_name, f.fl_no, 1, m.line_no, '                ' || {mark}
    FROM matched m JOIN fl f ON f.collection_id = m.collection_id AND f.a = 2 AND f.b = m.b
    JOIN top ON top.collection_id = m.collection_id WHERE m.a = 2
  UNION ALL SELECT collection_id, 1, r_name, fl_no, 2, 0, '            </DL><p>' FROM fl JOIN top USING (collection_id) WHERE a = 2
  UNION ALL SELECT collection_id, 1, name, 1000000000, 0, 0, '        </DL><p>' FROM fl WHERE a = 0
  UNION ALL SELECT collection_id, 1, 'Archive', 0, k, 0, ind || {h3} FROM docs, plain
  UNION ALL SELECT collection_id, 1, 'Archive', 0, k, 1, ind || '<DL><p>' FROM docs, plain
  UNION ALL SELECT collection_id, 1, 'Archive', 0, CASE b WHEN 1 THEN 1 ELSE 5 END, 2,
         CASE b WHEN 1 THEN '            ' ELSE '                    ' END || {mark} FROM matched WHERE a = 4
  UNION ALL SELECT collection_id, 1, 'Archive', 0, 10 - k, 0, ind || '</DL><p>' FROM docs, plain
  UNION ALL SELECT collection_id, 3, '', 0, 0, i, h FROM docs, foot)
SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY sec, t, k1, k2, k3) AS line_no, line FROM keyed"""
    return s
