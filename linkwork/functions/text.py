"""String helpers that give Python ``str`` semantics with JVM-side expressions.

Java's ``\\s`` and Spark's ``trim`` differ from Python's ``str.strip``/``split``:
Python treats every Unicode white-space character and U+001C..U+001F as
white space.  The character class below reproduces that under Java's
``(?U)`` flag, so every helper here stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, expressed for java.util.regex with (?U).
WS = r"[\s\x1c-\x1f]"


def lit_str(value: str) -> Column:
    return F.lit(value)


def strip_ws(c: Column) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(c, F.lit(rf"(?U)^{WS}+|{WS}+\z"), F.lit(""))


def rstrip_ws(c: Column) -> Column:
    """``str.rstrip()``."""
    return F.regexp_replace(c, F.lit(rf"(?U){WS}+\z"), F.lit(""))


def leading_ws_len(c: Column) -> Column:
    """``len(s) - len(s.lstrip())``."""
    return F.length(F.regexp_extract(c, rf"(?U)^({WS}*)", 1))


def split_ws(c: Column) -> Column:
    """``str.split()`` with no argument: runs of white space, no empty pieces."""
    return F.filter(F.split(c, rf"(?U){WS}+"), lambda x: x != F.lit(""))


def py_title(c: Column) -> Column:
    """``str.title()``: upper-case the first cased letter after any uncased character.

    Splits into runs of cased letters and runs of anything else; ``initcap`` of a
    run of cased letters is exactly Python's rule for that run.
    """
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def html_unescape_basic(c: Column) -> Column:
    """Decode the five XML entities, ``&amp;`` last so nothing is decoded twice."""
    out = c
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def html_escape(c: Column, quote: bool = True) -> Column:
    """``html.escape``: ``& < >`` and, with ``quote``, both quote characters."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    if quote:
        out = F.replace(out, F.lit('"'), F.lit("&quot;"))
        out = F.replace(out, F.lit("'"), F.lit("&#x27;"))
    return out


def json_string(c: Column) -> Column:
    """``json.dumps`` of a string: quoted, everything but printable ASCII escaped; null for null."""
    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def shown(ch: Column) -> Column:
        n = F.ascii(ch)
        out = F.when((n >= 32) & (n <= 126), ch)
        for plain, escaped in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
            out = out.when(ch == plain, F.lit("\\" + escaped))
        wide = n - 0x10000
        return out.when(n < 0x10000, unit(n)).otherwise(F.concat(
            unit(F.lit(0xD800) + F.shiftright(wide, 10)), unit(F.lit(0xDC00) + wide.bitwiseAND(F.lit(0x3FF)))))

    marked = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = F.when(marked.rlike(r"^[ -~]*\z"), marked).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(marked, F.lit("(?s)."), F.lit(0)), shown), ""))
    return F.concat(F.lit('"'), plain, F.lit('"'))
