"""DuckDB statements of the registered queries (the correctness oracle).

Each statement reads the driver's tables (``pages region nation supplier``) and
restates the query in plain SQL: regular expressions where Spark uses them, window
functions where the order matters, and brute-force pair scans where Spark uses a
blocked join.  Column names equal the Spark query's.
"""

from __future__ import annotations

from urllib.parse import uses_netloc as USES_NETLOC
from urllib.parse import uses_params as USES_PARAMS

from ..sinks.export import DEFAULT_INSTRUCTIONS

# Fixed values of the tool, stated here once more: the statements take none of them from the code they check.
JUNK_PREFIXES = ["Welcome to", "Official Site", "Official Website", "Home Page", "Homepage", "Main Page", "Index"]
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "_ga", "ref", "source", "campaign",
]
FALLBACK_PARTS = ["en", "us", "index", "home", "main", "page"]
GENERIC_TITLES = ["en", "us", "home", "homepage", "main", "index"]
STOP_WORDS = ["en", "us", "home", "the", "and", "or", "of", "in", "to", "for"]

URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def unescape(x: str) -> str:
    out = x
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {_q(ent)}, {_q(ch)})"
    return out


B0 = f"""b0 AS (
  SELECT split_part(url, '/', 4) AS collection_id, CAST(page_id AS BIGINT) AS pos, url AS href,
         {unescape("regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>([^<]*)</title>', 1)")} AS text
  FROM pages)"""

BV = """bv AS (
  SELECT collection_id, pos * 4 + v AS pos,
    CASE v WHEN 0 THEN href
      WHEN 1 THEN CASE WHEN contains(href, '://www.') THEN replace(href, '://www.', '://')
                       ELSE replace(href, '://', '://www.') END
      WHEN 2 THEN upper(regexp_extract(href, '^([^#]*)', 1))
                  || CASE WHEN contains(regexp_extract(href, '^([^#]*)', 1), '?') THEN '&' ELSE '?' END
                  || 'utm_source=mail' || regexp_extract(href, '^[^#]*(.*)$', 1)
      ELSE split_part(href, '/', 1) || '//' || split_part(href, '/', 3)
           || CASE WHEN starts_with(href, 'https') THEN ':443' ELSE ':80' END
           || substr(href, length(split_part(href, '/', 1) || '//' || split_part(href, '/', 3)) + 1) END AS href,
    CASE v WHEN 2 THEN text || ' copy' ELSE text END AS text
  FROM b0, (VALUES (0), (1), (2), (3)) t(v))"""


def sanitize_ctes(src: str, out: str) -> str:
    """CTEs ``{out}_s1..`` ending in ``{out}`` = src columns + ``url`` (P1) + ``dangerous`` (F2)."""
    return f"""{out}_a AS (
  SELECT *, {strip("coalesce(href, '')")} AS _s FROM {src}),
{out}_b AS (
  SELECT *, regexp_replace(CASE WHEN starts_with(lower(_s), 'http://') OR starts_with(lower(_s), 'https://') THEN _s
                                WHEN starts_with(_s, '//') THEN 'https:' || _s ELSE 'https://' || _s END,
                           '[\\t\\r\\n]', '', 'g') AS _u FROM {out}_a),
{out}_c AS (
  SELECT *, regexp_extract(_u, {_q(URL_RE)}, 1) AS _p1, regexp_extract(_u, {_q(URL_RE)}, 2) AS _p2,
         regexp_extract(_u, {_q(URL_RE)}, 3) AS _p3, regexp_extract(_u, {_q(URL_RE)}, 4) AS _p4,
         regexp_extract(_u, {_q(URL_RE)}, 5) AS _p5,
         regexp_matches(_s, '(?i)^(javascript|data|vbscript|file|about):') AS dangerous FROM {out}_b),
{out} AS (
  SELECT * EXCLUDE (_s, _u, _p1, _p2, _p3, _p4, _p5),
    CASE WHEN dangerous THEN ''
         WHEN _p2 = '' OR (contains(_p2, '[') <> contains(_p2, ']')) THEN ''
         ELSE lower(_p1) || '://' || _p2 || regexp_replace(_p3, '^(.*/)?([^/;]*);$', '\\1\\2')
              || CASE WHEN _p4 <> '' THEN '?' || _p4 ELSE '' END || CASE WHEN _p5 <> '' THEN '#' || _p5 ELSE '' END
    END AS url
  FROM {out}_c)"""


def domain_expr(url: str) -> str:
    return (f"CASE WHEN {url} = '' THEN 'unknown.com' ELSE "
            f"regexp_replace(lower(regexp_extract({url}, '(?s)^[^:]+://([^/?#]*)', 1)), '^www\\.', '') END")


def normalize_ctes(src: str, col: str, out: str, name: str = "normalized_url") -> str:
    """CTEs ending in ``{out}`` = src columns + ``{name}`` (P4 of ``col``)."""
    dec = "url_decode(replace({x}, '+', ' '))"
    enc = "replace(url_encode({x}), '%20', '+')"
    k = dec.format(x="regexp_extract(p, '^([^=]*)', 1)")
    v = dec.format(x="regexp_extract(p, '(?s)^[^=]*=?(.*)$', 1)")
    return f"""{out}_a AS (
  SELECT *, regexp_replace(regexp_replace({strip(f"lower(coalesce({col}, ''))")}, '^[\\x00-\\x20]+', ''),
                           '[\\t\\r\\n]', '', 'g') AS _nu FROM {src}),
{out}_b AS (
  SELECT *, regexp_extract(_nu, {_q(URL_RE)}, 1) AS _n1, regexp_extract(_nu, {_q(URL_RE)}, 2) AS _n2,
         regexp_extract(_nu, {_q(URL_RE)}, 3) AS _n3, regexp_extract(_nu, {_q(URL_RE)}, 4) AS _n4,
         regexp_extract(_nu, {_q(URL_RE)}, 5) AS _n5 FROM {out}_a),
{out}_c AS (
  SELECT *,
    regexp_replace(CASE WHEN _n1 = 'http' AND ends_with(_n2, ':80') THEN regexp_replace(_n2, ':80$', '')
                        WHEN _n1 = 'https' AND ends_with(_n2, ':443') THEN regexp_replace(_n2, ':443$', '')
                        ELSE _n2 END, '^www\\.', '') AS _host,
    regexp_replace(CASE WHEN _n1 IN {_list(USES_PARAMS)} THEN regexp_replace(_n3, '^((?:.*/)?[^/;]*);[^/]*$', '\\1')
                        ELSE _n3 END, '/+$', '') AS _path,
    CASE WHEN _n1 IN {_list(USES_PARAMS)} THEN regexp_extract(_n3, '(?s)^(?:.*/)?[^/;]*;([^/]*)$', 1) ELSE '' END
      AS _params,
    array_to_string(list_transform(
        list_filter(list_transform(list_filter(string_split(_n4, '&'), lambda p: p <> ''),
                                   lambda p: {{'k': {k}, 'v': {v}}}),
                    lambda kv: kv.k NOT IN {_list(TRACKING_PARAMS)}),
        lambda kv: {enc.format(x="kv.k")} || '=' || {enc.format(x="kv.v")}), '&') AS _query
  FROM {out}_b),
{out}_d AS (
  SELECT *, _path || CASE WHEN _params <> '' THEN ';' || _params ELSE '' END AS _body FROM {out}_c),
{out} AS (
  SELECT * EXCLUDE (_nu, _n1, _n2, _n3, _n4, _n5, _host, _path, _params, _query, _body),
    regexp_replace(
      CASE WHEN _n1 <> '' THEN _n1 || ':' ELSE '' END
      || CASE WHEN _host <> '' THEN '//' || _host || CASE WHEN _body <> '' AND NOT starts_with(_body, '/') THEN '/' || _body ELSE _body END
              WHEN starts_with(_body, '//') THEN '//' || _body
              WHEN _n1 <> '' AND _n1 IN {_list(USES_NETLOC)} AND (_body = '' OR starts_with(_body, '/')) THEN '//' || _body
              ELSE _body END
      || CASE WHEN _query <> '' THEN '?' || _query ELSE '' END
      || CASE WHEN _n5 <> '' THEN '#' || _n5 ELSE '' END, '/+$', '') AS {name}
  FROM {out}_d)"""


JUNK_RE = "(?i)^" + "".join("(?:" + j + r"\s*)?" for j in JUNK_PREFIXES)


def clean_title_ctes(src: str, col: str, out: str, name: str = "clean_title") -> str:
    return f"""{out}_a AS (
  SELECT *, CAST({col} AS VARCHAR) AS _tr,
         regexp_replace(regexp_replace(CAST({col} AS VARCHAR), '<[^>]*>', '', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g') AS _tb
  FROM {src}),
{out}_b AS (
  SELECT *, {strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(_tb, '\\s*\\|\\s*.*$', ''), '\\s*-\\s*.*$', ''), '\\s*:\\s*.*$', ''), '\\s*\\.\\.\\.$', '')")} AS _tc
  FROM {out}_a),
{out}_c AS (
  SELECT *, regexp_replace(regexp_replace(
      CASE WHEN length(_tc) < 3 AND length(_tb) > length(_tc) THEN {strip("_tb")} ELSE _tc END,
      {_q(JUNK_RE)}, ''), '[.,;:]+$', '') AS _te
  FROM {out}_b),
{out} AS (
  SELECT * EXCLUDE (_tr, _tb, _tc, _te),
    CASE WHEN _tr IS NULL OR _tr = '' OR _te = '' THEN 'Untitled'
         WHEN length(_te) > 60 THEN substr(_te, 1, 57) || '...' ELSE _te END AS {name}
  FROM {out}_c)"""


def py_title(x: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(" + x +
            ", '[\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+'), "
            "lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')")


def links_ctes(src: str, out: str) -> str:
    """``{out}`` = collection_id, pos, href, url, domain, original_title, clean_title, formatted_label, ..."""
    path_parts = (f"list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(url, {_q(URL_RE)}, 3), "
                  "'^((?:.*/)?[^/;]*);[^/]*$', '\\1'), '^/+|/+$', '', 'g'), '/'), "
                  "lambda p: p <> '' AND p NOT IN ('index.html', 'index.php'))")
    words = (f"list_filter(list_filter(string_split_regex({strip('original_title')}, '\\s+'), lambda w: w <> ''), "
             f"lambda w: lower(w) NOT IN {_list(STOP_WORDS)})")
    return f""",
{sanitize_ctes(src, out + "_san")},
{clean_title_ctes(out + "_san", "text", out + "_ct", "original_title")},
{out}_l0 AS (
  SELECT collection_id, pos, href, url, {domain_expr("url")} AS domain, original_title,
         original_title AS clean_title
  FROM {out}_ct WHERE url <> ''),
{out}_l1 AS (
  SELECT *, count(*) OVER (PARTITION BY collection_id, domain) AS domain_links,
         row_number() OVER (PARTITION BY collection_id, domain ORDER BY pos) AS domain_ordinal,
         {path_parts} AS _pp
  FROM {out}_l0),
{out}_l2 AS (
  SELECT *, CASE WHEN len(_pp) = 0 OR (len(_pp) = 1 AND lower(_pp[1]) IN ('en', 'us', 'home', 'index')) THEN 'Homepage'
                 WHEN contains(url, 'full-node') THEN 'Full Node'
                 WHEN contains(url, 'calculator') THEN 'Calculator'
                 ELSE {py_title("translate(_pp[len(_pp)], '-_', '  ')")} END AS _p0,
         {words} AS _words
  FROM {out}_l1),
{out}_l3 AS (
  SELECT *, CASE WHEN lower(CASE WHEN lower(_p0) IN ('en', 'us', 'index', 'home', 'main') THEN 'Homepage' ELSE _p0 END)
                      IN {_list(FALLBACK_PARTS)} THEN
                   CASE WHEN NOT (lower(clean_title) = split_part(domain, '.', 1)
                                  OR lower(clean_title) IN {_list(GENERIC_TITLES)}) THEN clean_title
                        WHEN len(_words) > 1 THEN array_to_string(_words[1:3], ' ')
                        ELSE 'Page ' || CAST(domain_ordinal AS VARCHAR) END
                 WHEN lower(_p0) IN ('en', 'us', 'index', 'home', 'main') THEN 'Homepage'
                 ELSE _p0 END AS part
  FROM {out}_l2),
{out} AS (
  SELECT collection_id, pos, href, url, domain, original_title, clean_title, domain_links, domain_ordinal, part,
    domain || ' | ' || CASE WHEN domain_links = 1 THEN clean_title
         WHEN row_number() OVER (PARTITION BY collection_id, domain, part ORDER BY pos) = 1 THEN part
         ELSE part || ' ' || CAST(row_number() OVER (PARTITION BY collection_id, domain, part ORDER BY pos) AS VARCHAR)
         END AS formatted_label
  FROM {out}_l3)"""


def with_links(src_cte: str, out: str = "links") -> str:
    """WITH clause: b0 [+ bv] and the link table ``out`` built from ``src_cte`` ('b0' or 'bv')."""
    ctes = B0 + (",\n" + BV if src_cte == "bv" else "")
    return "WITH " + ctes + links_ctes(src_cte, out)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def _key_sql(strategy: str, label_col: str) -> tuple[str, str, str]:
    """(extra CTEs after links, source name, key expression) for a key strategy."""
    if strategy in ("url", "smart"):
        extra = ",\n" + normalize_ctes("links", "url", "nl", "nurl")
        key = "nurl" if strategy == "url" else "domain || chr(1) || nurl"
        return extra, "nl", key
    t = strip(f"lower(coalesce({label_col}, ''))")
    return "", "links", f"CASE WHEN {t} <> '' THEN {t} END"


_REMOVED = {
    "first": "ipos",
    "last": "fpos",
    "shortest": "CASE WHEN li < lf THEN fpos ELSE ipos END",
    "longest": "CASE WHEN li > lf THEN fpos ELSE ipos END",
}


def dedup_sql(strategy: str, keep: str, label_col: str = "formatted_label", select: str | None = None) -> str:
    """Kept rows, by the literal rule: every later row of a key pairs with the key's first row,
    and each pair drops the member the keep strategy does not keep."""
    extra, src, key = _key_sql(strategy, label_col)
    body = f"""{with_links('bv')}{extra},
keyed AS (SELECT *, {key} AS _key FROM {src}),
firsts AS (SELECT *, min(pos) OVER (PARTITION BY collection_id, _key) AS _f FROM keyed WHERE _key IS NOT NULL),
pairs AS (
  SELECT b.collection_id, a.pos AS fpos, b.pos AS ipos,
         length(coalesce(a.formatted_label, '')) AS lf, length(coalesce(b.formatted_label, '')) AS li
  FROM firsts b JOIN firsts a ON a.collection_id = b.collection_id AND a.pos = b._f
  WHERE b.pos <> b._f),
removed AS (SELECT DISTINCT collection_id, {_REMOVED.get(keep, 'ipos')} AS rpos FROM pairs)"""
    sel = select or """SELECT collection_id, pos, url, formatted_label FROM keyed k
WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.collection_id = k.collection_id AND r.rpos = k.pos)"""
    return body + "\n" + sel


def dup_groups_sql(strategy: str, label_col: str = "formatted_label") -> str:
    extra, src, key = _key_sql(strategy, label_col)
    order = "_dfirst, pos" if strategy == "smart" else "pos"
    return f"""{with_links('bv')}{extra},
keyed AS (SELECT *, {key} AS _key, min(pos) OVER (PARTITION BY collection_id, domain) AS _dfirst FROM {src}),
firsts AS (SELECT *, min(pos) OVER (PARTITION BY collection_id, _key) AS _f FROM keyed WHERE _key IS NOT NULL)
SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY {order}) AS group_no,
       _f AS first_pos, pos AS dup_pos
FROM firsts WHERE pos <> _f"""


def fuzzy_pairs_sql(threshold: float) -> str:
    toks = (f"list_sort(list_distinct(list_filter(string_split_regex(lower({strip('formatted_label')}), '\\s+'), "
            "lambda w: w <> '')))")
    return f"""{with_links('bv')},
{normalize_ctes("links", "url", "nl", "nurl")},
t AS (SELECT collection_id, pos, nurl, domain, {toks} AS toks FROM nl),
s AS (
  SELECT a.collection_id, a.pos AS pos_a, b.pos AS pos_b,
    (CASE WHEN a.nurl = b.nurl THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.5::DOUBLE
    + (CASE WHEN len(a.toks) = 0 AND len(b.toks) = 0 THEN 1.0
            ELSE len(list_intersect(a.toks, b.toks))::DOUBLE
                 / len(list_distinct(list_concat(a.toks, b.toks)))::DOUBLE END)::DOUBLE * 0.3::DOUBLE
    + (CASE WHEN a.domain = b.domain THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.2::DOUBLE AS score
  FROM t a JOIN t b ON a.collection_id = b.collection_id AND a.pos < b.pos)
SELECT collection_id, pos_a, pos_b, round(score, 6) AS score FROM s WHERE score >= {threshold!r}::DOUBLE"""


def fuzzy_groups_ctes(threshold: float) -> str:
    """CTEs ending in ``grouped``: every link with ``i`` (place in its collection, from 0), ``lead`` and ``members``."""
    words = (f"list_sort(list_distinct(list_filter(string_split_regex(lower({strip('formatted_label')}), '\\s+'), "
             "lambda w: w <> '')))")
    both_blank = "len(a.words) = 0 AND len(b.words) = 0"
    jaccard = "len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words)))::DOUBLE"
    links = with_links("bv").replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{links},
{normalize_ctes("links", "url", "nl", "nurl")},
seq AS MATERIALIZED (
  SELECT *, {words} AS words, row_number() OVER (PARTITION BY collection_id ORDER BY pos) - 1 AS i FROM nl),
near AS MATERIALIZED (
  SELECT b.collection_id, b.i, list(a.i) AS earlier
  FROM seq a JOIN seq b ON a.collection_id = b.collection_id AND a.i < b.i
  WHERE (CASE WHEN a.nurl = b.nurl THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.5::DOUBLE
        + (CASE WHEN {both_blank} THEN 1.0 ELSE {jaccard} END)::DOUBLE * 0.3::DOUBLE
        + (CASE WHEN a.domain = b.domain THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.2::DOUBLE >= {threshold!r}::DOUBLE
  GROUP BY b.collection_id, b.i),
walk(collection_id, i, leaders) AS (
  SELECT DISTINCT collection_id, -1::BIGINT, []::BIGINT[] FROM seq
  UNION ALL
  SELECT w.collection_id, q.i,
         CASE WHEN list_has_any(coalesce(n.earlier, []), w.leaders) THEN w.leaders ELSE list_append(w.leaders, q.i) END
  FROM walk w JOIN seq q ON q.collection_id = w.collection_id AND q.i = w.i + 1
  LEFT JOIN near n ON n.collection_id = q.collection_id AND n.i = q.i),
heads AS (SELECT collection_id, arg_max(leaders, i) AS leaders FROM walk GROUP BY collection_id),
led AS (
  SELECT q.*, coalesce(list_min(list_intersect(n.earlier, h.leaders)), q.i) AS lead
  FROM seq q JOIN heads h ON h.collection_id = q.collection_id
  LEFT JOIN near n ON n.collection_id = q.collection_id AND n.i = q.i),
grouped AS (SELECT *, count(*) OVER (PARTITION BY collection_id, lead) AS members FROM led)"""


DOCS = """docs AS (
  SELECT collection_id || '/' || CAST(floor(pos / 500) AS BIGINT) AS doc, split_part(href, '/', 3) AS host,
         pos, href, text
  FROM b0),
doc_entries AS (
  SELECT doc AS collection_id, 'folder' AS type, host AS name, NULL AS url, NULL AS title, host AS path, 0 AS depth,
         NULL AS add_date, host AS _host, -1 AS _pos FROM (SELECT DISTINCT doc, host FROM docs)
  UNION ALL
  SELECT doc, 'bookmark', NULL, href, """ + strip("text") + """, host, 1, CAST(pos AS VARCHAR), host, pos FROM docs),
entries AS (
  SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY _host, _pos) - 1 AS seq FROM doc_entries)"""


STATUS = """status AS (
  SELECT url, CASE WHEN page_id % 5 <> 2 THEN page_id % 5 <> 0 END AS is_valid,
         CASE WHEN page_id % 5 = 1 THEN 404 WHEN page_id % 5 NOT IN (0, 2) THEN 200 END AS status_code,
         CASE WHEN page_id % 5 = 0 THEN 'Request timeout' END AS error, page_id AS checked_seq
  FROM pages),
latest AS (
  SELECT url, arg_max({'v': is_valid, 's': status_code, 'e': error}, checked_seq) AS st FROM status GROUP BY url),
checked AS (
  SELECT l.*, CASE WHEN l.url = '' THEN false ELSE st.v END AS is_valid,
         CASE WHEN l.url = '' THEN NULL ELSE st.s END AS status_code,
         CASE WHEN l.url = '' THEN 'Invalid or dangerous URL' ELSE st.e END AS error
  FROM links l LEFT JOIN latest t ON t.url = l.url)"""

JOB_ID = "job_20260101_000000_pages"


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["sanitize_urls"] = _with(B0, BV, sanitize_ctes("bv", "san")) + """
SELECT collection_id, pos, href, url, dangerous, url <> '' AS kept FROM san"""
    s["domains"] = _with(B0, BV, sanitize_ctes("bv", "san")) + f"""
SELECT collection_id, pos, href, {domain_expr('url')} AS domain FROM san"""
    s["normalize_urls"] = _with(B0, BV, normalize_ctes("bv", "href", "nrm")) + """
SELECT collection_id, pos, href, normalized_url FROM nrm"""
    s["clean_titles"] = _with(B0, BV, clean_title_ctes("bv", "text", "ct")) + """
SELECT collection_id, pos, text, clean_title FROM ct"""
    s["title_scores"] = _with(B0, BV, clean_title_ctes("bv", "text", "ct")) + f""",
sc AS (
  SELECT collection_id, pos, text, clean_title, lower({strip("coalesce(text, '')")}) AS t1,
         lower({strip("coalesce(clean_title, '')")}) AS t2 FROM ct),
tk AS (
  SELECT *, list_distinct(list_filter(string_split_regex(t1, '\\s+'), lambda w: w <> '')) AS w1,
            list_distinct(list_filter(string_split_regex(t2, '\\s+'), lambda w: w <> '')) AS w2 FROM sc)
SELECT collection_id, pos,
  round(CASE WHEN t1 = '' AND t2 = '' THEN 1.0 WHEN t1 = '' OR t2 = '' THEN 0.0 WHEN t1 = t2 THEN 1.0
        ELSE len(list_intersect(w1, w2))::DOUBLE / len(list_distinct(list_concat(w1, w2)))::DOUBLE END, 6) AS title_sim
FROM tk"""
    s["domain_counts"] = with_links("bv") + """
SELECT collection_id, domain, count(*) AS n_links FROM links GROUP BY collection_id, domain"""
    s["cleaning_examples"] = with_links("b0") + """
SELECT collection_id, pos, substr(original_title, 1, 60) || '...' AS title_preview, formatted_label
FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY pos) AS rn FROM links) WHERE rn <= 5"""
    s["labels"] = with_links("bv") + """
SELECT collection_id, pos, url, domain, domain_links, domain_ordinal, part, formatted_label FROM links"""
    for keep in ("first", "last", "shortest", "longest"):
        s[f"dedup_url_{keep}"] = dedup_sql("url", keep)
    s["dedup_smart_first"] = dedup_sql("smart", "first")
    s["dedup_smart_longest"] = dedup_sql("smart", "longest")
    s["dedup_title_clean"] = dedup_sql("title", "first", "clean_title")
    s["dedup_title_label"] = dedup_sql("title", "first")
    s["dup_groups_url"] = dup_groups_sql("url")
    s["dup_groups_smart"] = dup_groups_sql("smart")
    s["dup_groups_title"] = dup_groups_sql("title", "clean_title")
    s["dup_metrics_url"] = dedup_sql("url", "first", select="""
SELECT k.collection_id, count(*) AS rows_before,
       count(*) FILTER (WHERE r.rpos IS NOT NULL) AS rows_removed,
       count(*) FILTER (WHERE r.rpos IS NULL) AS rows_after,
       (SELECT count(*) FROM pairs p WHERE p.collection_id = k.collection_id) AS pair_groups,
       (SELECT count(DISTINCT fpos) FROM pairs p WHERE p.collection_id = k.collection_id) AS keys_with_duplicates
FROM keyed k LEFT JOIN removed r ON r.collection_id = k.collection_id AND r.rpos = k.pos
GROUP BY k.collection_id""")
    parts = []
    for strategy, label_col in (("url", "formatted_label"), ("title", "clean_title"), ("smart", "formatted_label")):
        for keep in ("first", "last", "shortest", "longest"):
            q = dedup_sql(strategy, keep, label_col, select=f"""
SELECT '{strategy}' AS strategy, '{keep}' AS keep_strategy, NULL::DOUBLE AS similarity_threshold, k.collection_id,
       count(*) FILTER (WHERE r.rpos IS NULL) AS rows_left, count(*) FILTER (WHERE r.rpos IS NOT NULL) AS rows_removed
FROM keyed k LEFT JOIN removed r ON r.collection_id = k.collection_id AND r.rpos = k.pos
GROUP BY k.collection_id""")
            parts.append("(" + q + ")")
    for t in (0.7, 0.9):
        parts.append(f"""({fuzzy_groups_ctes(t)}
SELECT 'fuzzy', 'first', {t!r}::DOUBLE, collection_id, count(DISTINCT lead), count(*) - count(DISTINCT lead) FROM grouped GROUP BY collection_id)""")
    s["strategy_comparison"] = "\nUNION ALL\n".join(parts)
    s["fuzzy_pairs_085"] = fuzzy_pairs_sql(0.85)
    s["fuzzy_pairs_060"] = fuzzy_pairs_sql(0.60)
    anchor = "'<a href=\"([^\"]*)\">([^<]*)</a>'"
    s["link_scan"] = f"""WITH a AS (
  SELECT page_id, regexp_extract_all(html, {anchor}, 1) AS hs, regexp_extract_all(html, {anchor}, 2) AS ts FROM pages),
scan AS (
  SELECT page_id, unnest(generate_series(0, len(hs) - 1)) AS anchor_no, unnest(hs) AS href0, unnest(ts) AS text0 FROM a),
src AS (SELECT page_id, anchor_no, {strip("href0")} AS href, {strip(unescape("text0"))} AS text FROM scan),
{sanitize_ctes("src", "san")}
SELECT page_id, anchor_no, href, text, url FROM san"""
    s["folder_entries"] = _with(B0, DOCS) + """
SELECT collection_id, seq, type, name, url, title, path, CAST(depth AS INTEGER) AS depth, add_date FROM entries"""
    s["folder_summary"] = _with(B0, DOCS) + """
SELECT collection_id, path, count(*) AS n_links FROM entries WHERE type = 'bookmark' GROUP BY collection_id, path"""
    doc_links = """doc_src AS (
  SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY _host, _pos) - 1 AS pos, url AS href,
         title AS text FROM entries WHERE type = 'bookmark')"""
    s["export_structured"] = _with(B0, DOCS, doc_links) + links_ctes("doc_src", "links") + f""",
lookup AS (SELECT collection_id, url, arg_max(formatted_label, pos) AS _label FROM links GROUP BY collection_id, url),
ent AS (SELECT e.*, l._label, e.url AS href FROM entries e LEFT JOIN lookup l ON l.collection_id = e.collection_id AND l.url = e.url),
{sanitize_ctes("ent", "es")},
{clean_title_ctes("es", "title", "ec", "_ct")}
SELECT collection_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT collection_id, 0 AS line_no, '# Bookmarks with Original Structure Preserved' AS line FROM (SELECT DISTINCT collection_id FROM entries)
  UNION ALL SELECT collection_id, 1, '' FROM (SELECT DISTINCT collection_id FROM entries)
  UNION ALL SELECT collection_id, seq + 2, repeat('  ', depth) || CASE WHEN type = 'folder' THEN 'FOLDER: ' || name
      ELSE coalesce(_label, {domain_expr('url')} || ' | ' || _ct) END FROM ec)"""
    s["link_health"] = with_links("b0") + ",\n" + STATUS + """
SELECT collection_id, pos, url, is_valid, status_code, error FROM checked"""
    s["health_summary"] = with_links("b0") + ",\n" + STATUS + """,
agg AS (
  SELECT collection_id, count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid,
         count(*) FILTER (WHERE NOT is_valid) AS invalid, count(*) FILTER (WHERE is_valid IS NULL) AS unchecked
  FROM checked GROUP BY collection_id)
SELECT *, CASE WHEN valid + invalid > 0 THEN round_even(valid::DOUBLE / (valid + invalid)::DOUBLE * 100.0, 1) END AS success_rate
FROM agg"""
    s["broken_links"] = with_links("b0") + ",\n" + STATUS + """,
broken AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY pos) AS rn,
                  count(*) OVER (PARTITION BY collection_id) AS n FROM checked WHERE is_valid = false)
SELECT collection_id, pos, substr(formatted_label, 1, 60) || '...' AS label_preview, error,
       greatest(n - 10, 0) AS more_broken
FROM broken WHERE rn <= 10"""
    s["report_rows"] = with_links("b0") + ",\n" + STATUS + f"""
SELECT '{JOB_ID}' AS job_id, collection_id, pos, original_title, clean_title, formatted_label, domain, url,
       is_valid, status_code FROM checked"""
    s["report_summary"] = dedup_sql("url", "first", select=f"""
SELECT '{JOB_ID}' AS job_id, k.collection_id, count(*) AS total_bookmarks, true AS original_structure_preserved,
       true AS labels_cleaned, true AS duplicates_handled
FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.collection_id = k.collection_id AND r.rpos = k.pos)
GROUP BY k.collection_id""")
    s["dup_report"] = dedup_sql("url", "first", select="""
, places AS (SELECT collection_id, pos, row_number() OVER (PARTITION BY collection_id ORDER BY pos) - 1 AS n FROM keyed),
grp AS (
  SELECT p.collection_id, row_number() OVER (PARTITION BY p.collection_id ORDER BY p.ipos) AS g, f.n AS fpos, i.n AS ipos
  FROM pairs p JOIN places f ON f.collection_id = p.collection_id AND f.pos = p.fpos
  JOIN places i ON i.collection_id = p.collection_id AND i.pos = p.ipos),
meta AS (
  SELECT k.collection_id, (SELECT count(*) FROM removed r WHERE r.collection_id = k.collection_id) AS nrem,
         (SELECT count(*) FROM grp WHERE grp.collection_id = k.collection_id) AS ng
  FROM (SELECT DISTINCT collection_id FROM keyed) k)
SELECT collection_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT collection_id, 0 AS line_no, 'No duplicates found.' AS line FROM meta WHERE ng = 0
  UNION ALL SELECT collection_id, i, CASE i WHEN 0 THEN 'Duplicate Analysis Report - Strategy: url'
      WHEN 1 THEN 'Similarity Threshold: 0.85' WHEN 2 THEN 'Keep Strategy: first'
      WHEN 3 THEN 'Total Duplicates Removed: ' || nrem WHEN 4 THEN 'Duplicate Groups Found: ' || ng
      WHEN 5 THEN '' ELSE 'Duplicate Groups:' END
    FROM meta, range(0, 7) t(i) WHERE ng > 0
  UNION ALL SELECT collection_id, 7 + (g - 1) * 4 + i, CASE i WHEN 0 THEN '' WHEN 1 THEN 'Group ' || g || ': 2 duplicates'
      WHEN 2 THEN '  - Index ' || fpos ELSE '  - Index ' || ipos END
    FROM grp, range(0, 4) t(i))""").replace("removed AS (SELECT DISTINCT collection_id, ipos AS rpos FROM pairs)\n,",
                                             "removed AS (SELECT DISTINCT collection_id, ipos AS rpos FROM pairs),")
    kept = """
, kept AS (SELECT k.* FROM keyed k
           WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.collection_id = k.collection_id AND r.rpos = k.pos))
"""
    s["export_flat"] = dedup_sql("url", "first", select=kept + """
SELECT collection_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT DISTINCT collection_id, 0 AS line_no, '# Flattened Bookmarks List' AS line FROM kept
  UNION ALL SELECT DISTINCT collection_id, 1, '' FROM kept
  UNION ALL SELECT collection_id, 1 + row_number() OVER (PARTITION BY collection_id ORDER BY pos), formatted_label FROM kept)
""").replace("FROM pairs)\n\n,", "FROM pairs),")
    head = DEFAULT_INSTRUCTIONS.split("\n")
    head_rows = " UNION ALL ".join(f"SELECT {i} AS i, {_q(h)} AS h" for i, h in enumerate(head[:-1]))
    s["export_instructions"] = dedup_sql("url", "first", select=kept + f"""
, head AS ({head_rows}),
numbered AS (SELECT collection_id, {len(head) - 2} + row_number() OVER (PARTITION BY collection_id ORDER BY pos) AS line_no,
                    formatted_label FROM kept)
SELECT collection_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT c.collection_id, h.i AS line_no, h.h AS line FROM (SELECT DISTINCT collection_id FROM kept) c, head h
  UNION ALL SELECT collection_id, line_no,
      CASE WHEN line_no = {len(head) - 1} THEN {_q(head[-1])} || formatted_label ELSE formatted_label END FROM numbered)
""").replace("FROM pairs)\n\n,", "FROM pairs),")
    return s
