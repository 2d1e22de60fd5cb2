"""Title column functions: clean (P3), similarity (P6, P7), label (P9), preview (P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, split_ws, strip_ws

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference tool's behaviour.
DEFAULT_TITLE_MAX = 60
UNTITLED = "Untitled"
# Leading phrases removed from titles, case-insensitively, tried once each in this order.
JUNK_PREFIXES = ["Welcome to", "Official Site", "Official Website", "Home Page", "Homepage", "Main Page", "Index"]
# ---------------------------------------------------------------------------

# Python's re: '.' excludes only '\n' and '$' may match before a final '\n' -> Java flags (?dU).
_CUTS = [
    rf"(?dU){WS}*\|{WS}*.*$",
    rf"(?dU){WS}*-{WS}*.*$",
    rf"(?dU){WS}*:{WS}*.*$",
    rf"(?dU){WS}*\.\.\.$",
]


_JUNK_RE = "(?iU)^" + "".join(
    "(?:" + junk + rf"{WS}*)?" for junk in JUNK_PREFIXES
)


def _sub(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(repl))


def _title_base(raw: Column) -> Column:
    return _sub(_sub(raw, r"<[^>]*>"), r"&[a-zA-Z0-9#]+;", " ")


def _title_cut(base: Column) -> Column:
    cut = base
    for pat in _CUTS:
        cut = _sub(cut, pat)
    return strip_ws(cut)


def _title_restore(base: Column, cut: Column) -> Column:
    return F.when((F.length(cut) < 3) & (F.length(base) > F.length(cut)), strip_ws(base)).otherwise(cut)


def _title_finish(raw: Column, restored: Column, max_length: int) -> Column:
    # The text is stripped here, so "drop each phrase in turn if it leads, then strip" is one
    # anchored pattern of optional groups, tried in order.
    cut = _sub(_sub(restored, _JUNK_RE), r"(?d)[.,;:]+$")
    cut = F.when(
        F.length(cut) > max_length, F.concat(F.substring(cut, 1, max_length - 3), F.lit("..."))
    ).otherwise(cut)
    return F.when(raw.isNull() | (raw == "") | (cut == ""), F.lit(UNTITLED)).otherwise(cut)


def clean_title(c: Column, max_length: int = DEFAULT_TITLE_MAX) -> Column:
    """Strip tags/entities, cut site suffixes, drop junk prefixes, shorten; never empty."""
    raw = c.cast("string")
    base = _title_base(raw)
    return _title_finish(raw, _title_restore(base, _title_cut(base)), max_length)


def with_clean_title(df: DataFrame, src: str, out: str = "clean_title",
                     max_length: int = DEFAULT_TITLE_MAX) -> DataFrame:
    """P3 as staged projections (same result as ``clean_title``)."""
    t = f"_{out}_tmp"
    df = df.withColumn(t + "r", F.col(src).cast("string"))
    df = df.withColumn(t + "b", _title_base(F.col(t + "r")))
    df = df.withColumn(t + "c", _title_cut(F.col(t + "b")))
    df = df.withColumn(t + "d", _title_restore(F.col(t + "b"), F.col(t + "c")))
    df = df.withColumn(t + "e", _sub(_sub(F.col(t + "d"), _JUNK_RE), r"(?d)[.,;:]+$"))
    e = F.col(t + "e")
    short = F.when(F.length(e) > max_length, F.concat(F.substring(e, 1, max_length - 3), F.lit("..."))).otherwise(e)
    raw = F.col(t + "r")
    out_col = F.when(raw.isNull() | (raw == "") | (short == ""), F.lit(UNTITLED)).otherwise(short)
    return df.withColumn(out, out_col).drop(*[t + x for x in "rbcde"])


def token_set(c: Column) -> Column:
    """Distinct lower-cased white-space tokens, sorted (a canonical set)."""
    return F.array_sort(F.array_distinct(split_ws(F.lower(F.coalesce(c, F.lit(""))))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two token arrays; 1.0 when both are empty."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(F.array_union(a, b)).cast("double")
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def title_similarity(a: Column, b: Column) -> Column:
    """1.0 for equal or both blank, 0.0 if one is blank, else Jaccard of word sets."""
    t1 = strip_ws(F.lower(F.coalesce(a, F.lit(""))))
    t2 = strip_ws(F.lower(F.coalesce(b, F.lit(""))))
    return (
        F.when((t1 == "") & (t2 == ""), F.lit(1.0))
        .when((t1 == "") | (t2 == ""), F.lit(0.0))
        .when(t1 == t2, F.lit(1.0))
        .otherwise(jaccard(token_set(t1), token_set(t2)))
    )


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """(max_len - edit distance) / max_len, case-sensitive."""
    a = F.coalesce(a, F.lit(""))
    b = F.coalesce(b, F.lit(""))
    m = F.greatest(F.length(a), F.length(b)).cast("double")
    return (
        F.when((a == "") & (b == ""), F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise((m - F.levenshtein(a, b).cast("double")) / m)
    )


def format_label(domain: Column, part: Column) -> Column:
    """``domain | part``."""
    return F.concat(domain, F.lit(" | "), part)


def preview(c: Column, n: int = 60) -> Column:
    """P10: first ``n`` characters followed by ``...``."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))
