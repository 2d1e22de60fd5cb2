"""URL column functions: sanitise (P1), domain (P2), normalise (P4), path label (P5), default URL.

All are built-in Spark expressions.  ``parse_url`` is not used: under ANSI mode it
throws, and ``try_parse_url`` returns null for URLs that Python's ``urllib`` accepts
(spaces, ``|``, underscores or non-ASCII in the host).  Instead the URL is split with
one RFC 3986 style regular expression that follows ``urllib.parse.urlsplit``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import py_title, strip_ws

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference tool's behaviour.
# Schemes rejected outright by the sanitiser (compared case-insensitively, with ':').
DANGEROUS_SCHEMES = ["javascript", "data", "vbscript", "file", "about"]
# Query keys dropped by URL normalisation (exact, after decoding).
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "_ga", "ref", "source", "campaign",
]
# Path pieces ignored when building a label from a URL path.
EXCLUDED_PATH_PARTS = ["index.html", "index.php"]
# A single remaining path piece that still means "home page" (compared lower-cased).
HOMEPAGE_PARTS = ["en", "us", "home", "index"]
# Labels that are replaced by "Homepage" (compared lower-cased).
MEANINGLESS_PARTS = ["en", "us", "index", "home", "main"]
# URL substrings with a fixed label, checked in this order.
SPECIAL_URL_LABELS = [("full-node", "Full Node"), ("calculator", "Calculator")]
# ---------------------------------------------------------------------------

# Schemes for which urllib writes "//" even with an empty host (Python standard library list).
USES_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
]

def _ipv6_pattern(scope: str) -> str:
    """Textual IPv6 addresses as Python's ``ipaddress`` accepts them: at most one ``::``, eight
    16-bit groups in all (an IPv4 dotted quad may stand for the last two), optional ``%scope``."""
    h = "[0-9a-fA-F]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"{octet}(?:\.{octet}){{3}}"

    def run(n: int) -> str:
        return "" if n == 0 else (h if n == 1 else rf"{h}(?::{h}){{{n - 1}}}")

    alts = [rf"(?:{h}:){{7}}{h}", rf"(?:{h}:){{6}}{v4}"]
    alts += [run(left) + "::" + run(right) for left in range(8) for right in range(8 - left)]
    alts += [run(left) + "::" + (rf"(?:{h}:){{{right}}}" if right else "") + v4
             for left in range(6) for right in range(6 - left)]
    return "(?:" + "|".join(alts) + ")" + scope


# The text between the first '[' and the next ']' must be an IPv6 address or an IPvFuture
# literal, or urllib rejects the URL (Python 3.13 rule).
_BRACKET_HOST = rf"(?s)^(?:v[a-fA-F0-9]+\..+|{_ipv6_pattern('(?:%[^%]+)?')})$"


def _delimiter_lookalikes() -> str:
    """A pattern of the characters whose NFKC form holds a URL delimiter; urllib rejects hosts with them."""
    odd = [c for c in map(chr, range(0x80, 0x20000)) if set(unicodedata.normalize("NFKC", c)) & set("/?#@:")]
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in odd) + "]"


_LOOKALIKE = _delimiter_lookalikes()


def _netloc_ok(netloc: Column) -> Column:
    """urlsplit's checks of a network location: its characters, and what stands in '[' and ']'."""
    inner = F.regexp_extract(netloc, r"(?s)^[^\[]*\[([^\]]*)", 1)
    both = netloc.contains("[") & netloc.contains("]")
    return ~netloc.rlike(_LOOKALIKE) & F.when(~both, F.lit(True)).otherwise(inner.rlike(_BRACKET_HOST))


# Schemes whose last path segment may carry ";params" (Python standard library list).
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip",
               "sips", "mms", "sftp", "tel"]

# scheme, netloc, path, query, fragment -- the urlsplit decomposition.
URL_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_DANGER = "(?i)^(" + "|".join(DANGEROUS_SCHEMES) + "):"


def _part(u: Column, i: int) -> Column:
    return F.regexp_extract(u, URL_SPLIT, i)


def _drop_empty_params(path: Column) -> Column:
    """urlparse splits ``;params`` off the last segment and urlunparse drops an empty one."""
    return F.regexp_replace(path, F.lit(r"^(.*/)?([^/;]*);$"), F.lit("$1$2"))


def _unsafe_removed(u: Column) -> Column:
    # urlsplit deletes tab, CR and LF anywhere in the URL.
    return F.regexp_replace(u, F.lit(r"[\t\r\n]"), F.lit(""))


def is_dangerous_url(c: Column) -> Column:
    """the stripped URL starts with a rejected scheme."""
    return F.coalesce(strip_ws(c.cast("string")).rlike(_DANGER), F.lit(False))


def _fix_scheme(s: Column) -> Column:
    low = F.lower(s)
    fixed = (
        F.when(low.startswith("http://") | low.startswith("https://"), s)
        .when(s.startswith("//"), F.concat(F.lit("https:"), s))
        .otherwise(F.concat(F.lit("https://"), s))
    )
    return _unsafe_removed(fixed)


def _sanitized_from_parts(s: Column, scheme: Column, netloc: Column, path: Column, query: Column,
                          frag: Column) -> Column:
    bad_brackets = (netloc.contains("[") != netloc.contains("]")) | ~_netloc_ok(netloc)
    rebuilt = F.concat(
        F.lower(scheme), F.lit("://"), netloc, _drop_empty_params(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )
    return (
        F.when(s.rlike(_DANGER), F.lit(""))
        .when((netloc == "") | bad_brackets, F.lit(""))
        .otherwise(rebuilt)
    )


def sanitize_url(c: Column) -> Column:
    """P1: '' for null, empty, dangerous or host-less URLs; else a re-serialised http(s) URL."""
    s = strip_ws(F.coalesce(c.cast("string"), F.lit("")))
    u = _fix_scheme(s)
    return _sanitized_from_parts(s, *(_part(u, i) for i in range(1, 6)))


def with_sanitized_url(df: DataFrame, src: str, out: str = "url") -> DataFrame:
    """P1 as staged projections: each intermediate is computed once (same result as ``sanitize_url``)."""
    t = f"_{out}_tmp"
    df = df.withColumn(t + "s", strip_ws(F.coalesce(F.col(src).cast("string"), F.lit(""))))
    df = df.withColumn(t + "u", _fix_scheme(F.col(t + "s")))
    df = df.withColumn(t + "p", F.struct(*[_part(F.col(t + "u"), i).alias(f"p{i}") for i in range(1, 6)]))
    parts = [F.col(t + "p")[f"p{i}"] for i in range(1, 6)]
    return df.withColumn(out, _sanitized_from_parts(F.col(t + "s"), *parts)).drop(t + "s", t + "u", t + "p")


def host_of(sanitized: Column) -> Column:
    """Network location of an already sanitised URL."""
    return F.regexp_extract(sanitized, r"(?s)^[^:]+://([^/?#]*)", 1)


def domain_of_sanitized(sanitized: Column) -> Column:
    host = F.regexp_replace(F.lower(host_of(sanitized)), F.lit(r"^www\."), F.lit(""))
    return F.when(sanitized == "", F.lit("unknown.com")).otherwise(host)


def extract_domain(c: Column) -> Column:
    """Lower-cased host without one leading ``www.``; ``unknown.com`` when unusable."""
    return domain_of_sanitized(sanitize_url(c))


def path_of_sanitized(sanitized: Column) -> Column:
    """urlparse(...).path of a sanitised URL (``;params`` of the last segment excluded)."""
    path = _part(sanitized, 3)
    return F.regexp_replace(path, F.lit(r"^((?:.*/)?[^/;]*);[^/]*$"), F.lit("$1"))


def _decode_form(x: Column) -> Column:
    # parse_qsl: '+' is a space, then percent-decoding; a percent sign that begins no escape stays.
    whole = F.regexp_replace(x, F.lit("%(?![0-9A-Fa-f]{2})"), F.lit("%25"))
    return F.coalesce(F.call_function("try_url_decode", whole), F.replace(x, F.lit("+"), F.lit(" ")))


def _encode_form(x: Column) -> Column:
    # urlencode/quote_plus keeps '~' and escapes '*'; java.net.URLEncoder does the opposite.
    enc = F.call_function("url_encode", x)
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _normalize_prep(c: Column) -> Column:
    s = strip_ws(F.lower(F.coalesce(c.cast("string"), F.lit(""))))
    return _unsafe_removed(F.regexp_replace(s, F.lit(r"^[\x00-\x20]+"), F.lit("")))


def _normalized_from_parts(scheme: Column, netloc: Column, rawpath: Column, query: Column,
                           frag: Column) -> Column:
    netloc = (
        F.when((scheme == "http") & netloc.endswith(":80"), F.regexp_replace(netloc, F.lit(r":80$"), F.lit("")))
        .when((scheme == "https") & netloc.endswith(":443"), F.regexp_replace(netloc, F.lit(r":443$"), F.lit("")))
        .otherwise(netloc)
    )
    netloc = F.regexp_replace(netloc, F.lit(r"^www\."), F.lit(""))
    # split ';params' off the last segment, as urlparse does for the schemes that have them
    has_params = scheme.isin(*USES_PARAMS)
    path = F.when(has_params, F.regexp_replace(rawpath, F.lit(r"^((?:.*/)?[^/;]*);[^/]*$"), F.lit("$1"))) \
        .otherwise(rawpath)
    params = F.when(has_params, F.regexp_extract(rawpath, r"(?s)^(?:.*/)?[^/;]*;([^/]*)$", 1)).otherwise(F.lit(""))
    path = F.regexp_replace(path, F.lit(r"/+$"), F.lit(""))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != F.lit("")),
        lambda p: F.struct(
            _decode_form(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            _decode_form(F.regexp_extract(p, r"(?s)^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda kv: ~kv["k"].isin(*TRACKING_PARAMS))
    new_query = F.array_join(
        F.transform(kept, lambda kv: F.concat(_encode_form(kv["k"]), F.lit("="), _encode_form(kv["v"]))), "&"
    )
    body = F.concat(path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")))
    with_host = (
        F.when(netloc != "", F.concat(
            F.lit("//"), netloc,
            F.when((body != "") & ~body.startswith("/"), F.concat(F.lit("/"), body)).otherwise(body)))
        .when(body.startswith("//"), F.concat(F.lit("//"), body))
        .when(scheme.isin(*USES_NETLOC) & (scheme != "") & ((body == "") | body.startswith("/")),
              F.concat(F.lit("//"), body))
        .otherwise(body)
    )
    full = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        with_host,
        F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )
    return F.regexp_replace(full, F.lit(r"/+$"), F.lit(""))


def normalize_url(c: Column) -> Column:
    """Duplicate-detection key (lower-case, default port, www, slashes, tracking keys)."""
    u = _normalize_prep(c)
    return _normalized_from_parts(*(_part(u, i) for i in range(1, 6)))


def with_normalized_url(df: DataFrame, src: str, out: str = "normalized_url") -> DataFrame:
    """P4 as staged projections (same result as ``normalize_url``)."""
    t = f"_{out}_tmp"
    df = df.withColumn(t + "u", _normalize_prep(F.col(src)))
    df = df.withColumn(t + "p", F.struct(*[_part(F.col(t + "u"), i).alias(f"p{i}") for i in range(1, 6)]))
    df = df.withColumn(t + "n", F.col(t + "p")["p2"])
    df = df.withColumn(t + "q", F.col(t + "p")["p4"])
    parts = [F.col(t + "p")["p1"], F.col(t + "n"), F.col(t + "p")["p3"], F.col(t + "q"), F.col(t + "p")["p5"]]
    return df.withColumn(out, _normalized_from_parts(*parts)).drop(t + "u", t + "p", t + "n", t + "q")


def path_identifier(sanitized_url: Column) -> Column:
    """P5: label candidate from the URL path (before the title fallback of the labeller)."""
    path = F.regexp_replace(path_of_sanitized(sanitized_url), F.lit(r"^/+|/+$"), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: (p != F.lit("")) & ~p.isin(*EXCLUDED_PATH_PARTS))
    n = F.size(parts)
    last = F.element_at(parts, -1)
    homepage = (n == 0) | ((n == 1) & F.lower(F.element_at(parts, 1)).isin(*HOMEPAGE_PARTS))
    worded = py_title(F.translate(F.coalesce(last, F.lit("")), "-_", "  "))
    out = F.when(homepage, F.lit("Homepage"))
    for needle, label in SPECIAL_URL_LABELS:
        out = out.when(sanitized_url.contains(needle), F.lit(label))
    out = out.otherwise(worded)
    return F.when(F.lower(out).isin(*MEANINGLESS_PARTS), F.lit("Homepage")).otherwise(out)


def default_url(domain: Column) -> Column:
    """URL used when an outline entry matches no original link."""
    d = F.coalesce(domain, F.lit("unknown.com"))
    return F.when(d.startswith("http"), d).otherwise(F.concat(F.lit("https://"), d))
