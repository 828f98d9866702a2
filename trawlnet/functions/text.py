"""Text functions as column expressions: tokens, terms, charset and content-type rules, document paths, code sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nd}]+"
# fixed values: letters of Latin-1 and what they become in a term
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõö÷øùúûüýþÿ"
PLAIN = "aaaaaaaceeeeiiiinooooooouuuuyyy"
#: Characters that strip() removes.
BLANK = " \t\n\x0b\f\r\x00"


def tokens(text: Column) -> Column:
    """FN-TK1: maximal runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def normalize_term(token: Column) -> Column:
    """FN-NM1: lower case, Latin-1 accents dropped."""
    return F.translate(F.lower(token), ACCENTED, PLAIN)


def docid_path(doc_id: Column, prefix: str = "") -> Column:
    """SRC4: the id as eight hex digits in four folders."""
    h = F.lpad(F.hex(doc_id), 8, "0")
    parts = [F.substring(h, i, 2) for i in (1, 3, 5, 7)]
    return F.concat_ws("/", *([F.lit(prefix)] if prefix else []), *parts, F.lit("data.gz"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANK))


def split_max(text: Column, sep: str, maxsplit: int = 0) -> Column:
    """FN-SP1: split at a literal, ``maxsplit`` times at most (0: always); empty parts stay."""
    return F.split(text, r"\Q" + sep + r"\E", maxsplit + 1 if maxsplit else -1)


def join(parts: Column, sep: str) -> Column:
    return F.array_join(parts, sep)


def charset_of(content_type: Column) -> Column:
    """FN-CS1: the charset of a content-type header, lower-cased; empty if none."""
    return F.btrim(F.regexp_extract(F.lower(content_type), r"charset\s*=?([^=;]*)", 1), F.lit(BLANK))


def accepts_content_type(content_type: Column) -> Column:
    """FLT5: HTML or XML, or no header at all."""
    low = F.lower(content_type)
    return content_type.isNull() | low.contains("html") | low.contains("xml")


def robots_allowed(path: Column, rules: Column) -> Column:
    """FLT4: the first rule (prefix, allow) whose prefix fits decides; otherwise allowed."""
    fit = F.filter(rules, lambda r: path.startswith(r["prefix"]))
    return F.coalesce(F.get(fit, F.lit(0))["allow"], F.lit(True))


def vbyte_size(value: Column) -> Column:
    """FN-VB1: bytes of a positive integer in the bijective base-128 code."""
    v = value - 1
    return F.when(v < 128, 1).when(v < 16512, 2).when(v < 2113664, 3).when(v < 270549120, 4).otherwise(5)


def host_of(url: Column) -> Column:
    """URL2: host without userinfo and port, lower-cased, one trailing dot dropped."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def strip_url(url: Column) -> Column:
    """URL8 on clean URLs: without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def to_number(text: Column, kind: str = "bigint") -> Column:
    """FN-CV1: a number in a text; null if there is none."""
    return strip(text).try_cast(kind)


def unichr(code: Column) -> Column:
    """FN-UC1: the character of a code point; empty for 0, the replacement character for what is none."""
    c = code.cast("long")
    byte = lambda lead, shift: F.lpad(F.hex((F.lit(lead) + F.shiftright(c, shift) % 64).cast("long")), 2, "0")
    first = lambda lead, shift: F.hex((F.lit(lead) + F.shiftright(c, shift)).cast("long"))
    coded = (
        F.when(c < 128, F.lpad(F.hex(c), 2, "0"))
        .when(c < 0x800, F.concat(first(0xC0, 6), byte(0x80, 0)))
        .when(c < 0x10000, F.concat(first(0xE0, 12), byte(0x80, 6), byte(0x80, 0)))
        .otherwise(F.concat(first(0xF0, 18), byte(0x80, 12), byte(0x80, 6), byte(0x80, 0)))
    )
    invalid = (c < 0) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF)
    return F.when(c == 0, "").when(invalid, "\ufffd").otherwise(F.unhex(coded).cast("string"))
