"""String column functions (JVM-side regex / string / higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgraph import config as C

# Whitespace as Python's str.isspace() defines it: ASCII whitespace, the
# information separators 0x1c-0x1f, NEL, NBSP and the Unicode space characters.
WHITESPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters by their Unicode property: one look-up per character instead of a chain of ranges.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def normalise_ws(text: Column) -> Column:
    """Collapse whitespace runs to one space, then strip."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))


def chunk_starts(length: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Window starts 0, step, 2*step ... up to the first window reaching the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((length - F.lit(size)) / F.lit(step))).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda j: j * F.lit(step)))


def chunk_texts(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                min_chars: int = C.CHUNK_MIN_CHARS) -> Column:
    """Stripped overlapping windows longer than ``min_chars`` (array, in order)."""
    windows = F.transform(chunk_starts(F.length(text), size, overlap),
                          lambda s: F.trim(F.substring(text, s + 1, size)))
    return F.filter(windows, lambda c: F.length(c) > min_chars)


def substring_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of needle in text (str.count semantics)."""
    return F.when(
        F.length(needle) > 0,
        ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long"),
    ).otherwise(F.length(text) + 1)


def chunk_id(source_id: Column, page: Column, chunk_no: Column) -> Column:
    """``<source>-p001-c01``."""
    return F.format_string("%s-p%03d-c%02d", source_id, page, chunk_no)


def excerpt(text: Column, n: int = C.EXCERPT_CHARS) -> Column:
    """First n characters."""
    return F.substring(text, 1, n)


def mask_id(id_col: Column) -> Column:
    """First two and last two digits, ``12...34``."""
    s = id_col.cast("long").cast("string")
    return F.concat(F.substring(s, 1, 2), F.lit("..."), F.substring(s, -2, 2))


def rule_id_dashed(rule_id: Column) -> Column:
    """``R001`` -> ``R-001`` (every R replaced, as the case export does)."""
    return F.replace(rule_id, F.lit("R"), F.lit("R-"))


def rule_id_plain(rule_id: Column) -> Column:
    """``R-001`` -> ``R001`` (first dash only)."""
    return F.regexp_replace(rule_id, r"^([^-]*)-", "$1")


def clean_review_text(text: Column) -> Column:
    """Field names to words, in the fixed order."""
    out = text
    for old, new in C.REVIEW_TEXT_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def py_float_text(x: Column) -> Column:
    """Number text as Python's ``repr(float)``: positional for 1e-4 <= |x| < 1e16
    (at least one decimal), otherwise ``<mantissa>e<sign><2+ digits>``."""
    d = x.cast("double")
    positional = F.regexp_replace(
        F.regexp_replace(d.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    java = d.cast("string")  # e.g. 1.0E-5, 3.0E16
    mant = F.regexp_replace(F.split(java, "E")[0], r"\.0$", "")
    exp = F.split(java, "E")[1].cast("int")
    sci = F.concat(mant, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.abs(exp).cast("string"), 2, "0"))
    a = F.abs(d)
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), F.lit("nan"))
        .when(a == F.lit(float("inf")), F.when(d > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(d == 0, java)  # "0.0" or "-0.0"
        .when((a >= F.lit(1e-4)) & (a < F.lit(1e16)), positional)
        .otherwise(sci)
    )
