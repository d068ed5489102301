"""Scalar expressions over text: normalising, words, ratios, escapes, dates, identifiers, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[A-Za-z0-9]+"


def fold_case(s: Column) -> Column:
    """ASCII letters in lower case; others stay."""
    return F.translate(s, UPPER, LOWER)


def strip_space(s: Column) -> Column:
    """Without spaces, tabs and line breaks."""
    return F.regexp_replace(s, "[ \\t\\n\\r]", "")


def normalise(s: Column, ignore_case: bool = True, ignore_space: bool = True) -> Column:
    s = fold_case(s) if ignore_case else s
    return strip_space(s) if ignore_space else s


def words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(WORD), F.lit(0))


def byte_pairs(s: Column) -> Column:
    """UTF-8 bytes of a text as two-digit hex strings."""
    return F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit(".."), F.lit(0))


def change_ratio(a: Column, b: Column) -> Column:
    """Share of byte positions that differ, gaps included; 0 for two empty texts."""
    x, y = byte_pairs(F.coalesce(a, F.lit(""))), byte_pairs(F.coalesce(b, F.lit("")))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(1)), F.lit(0), lambda n, v: n + v)
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(longest == 0, F.lit(0.0)).otherwise(differ / longest)


def escape_string(s: Column) -> Column:
    """Backslash, parentheses and line characters escaped for a literal string."""
    for raw, safe in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def unescape_string(s: Column) -> Column:
    """Inverse of escape_string: an escaped backslash is set aside first, so it can't start another escape."""
    s = F.replace(s, F.lit("\\\\"), F.lit("\u0001"))
    for safe, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")")):
        s = F.replace(s, F.lit(safe), F.lit(raw))
    return F.replace(s, F.lit("\u0001"), F.lit("\\"))


def pdf_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmmss")


def parse_pdf_date(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(s, "^D:", ""), "'", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyyMMddHHmmssXX", "yyyyMMddHHmmss", "yyyyMMdd")])


def sanitise_id(s: Column, index: Column | None = None) -> Column:
    """Letters, digits and underscores; space and dash become underscores; never empty or led by a digit."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), "[ -]", "_"), "[^A-Za-z0-9_]", "")
    empty = F.lit("field") if index is None else F.concat(F.lit("field_"), index.cast("string"))
    return F.when(kept == "", empty).when(kept.rlike("^[0-9]"), F.concat(F.lit("field_"), kept)).otherwise(kept)


def value_type(s: Column) -> Column:
    """bool before int before float before string."""
    return (
        F.when(s.isNull() | (s == ""), "empty")
        .when(fold_case(s).isin("true", "false", "1", "0"), "bool")
        .when(s.rlike("^[+-]?[0-9]+$"), "int")
        .when(s.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("string")
    )


def style_type(s: Column) -> Column:
    """float before bool before string."""
    return (
        F.when(s.isNull() | (s == ""), "empty")
        .when(s.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .when(fold_case(s).isin("true", "false"), "bool")
        .otherwise("string")
    )


#: Field types of form templates and the response types they map to.
RESPONSE_TYPES = {"text": "text", "textEdit": "text", "numeric": "number", "numericEdit": "number", "integer": "number", "float": "number", "decimal": "number", "date": "date", "dateTimeEdit": "date", "time": "time", "checkbox": "checkbox", "checkButton": "checkbox", "radio": "radio", "exclGroup": "radio", "choiceList": "select", "select": "select", "dropdown": "select", "listbox": "select", "signature": "signature", "button": "button", "email": "email", "password": "text"}


def response_type(s: Column, table: dict[str, str] = RESPONSE_TYPES, default: str = "text") -> Column:
    lookup = F.create_map(*[F.lit(x.lower() if i % 2 == 0 else x) for kv in table.items() for i, x in enumerate(kv)])
    return F.coalesce(F.try_element_at(lookup, F.lower(F.trim(s))), F.lit(default))


def truthy(s: Column) -> Column:
    return F.lower(F.trim(s)).isin("1", "true", "yes", "required")


def rounded_key(*numbers: Column) -> Column:
    """Numbers to one decimal as an exact integer key: floor(10 x + 0.5)."""
    return F.concat_ws(":", *[F.floor(n * 10 + 0.5).cast("long").cast("string") for n in numbers])
