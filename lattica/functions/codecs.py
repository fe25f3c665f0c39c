"""Codecs between source values and semantic values, as Column functions.

Blank text decodes to null; text that has no reading raises an error, unless a docstring says
otherwise. The registry at the end names each codec for mappings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of dates and times, and the words of yes and no.

DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyy-MM-dd HH:mm")
YES = ("Y", "YES", "TRUE", "1", "해당")
NO = ("N", "NO", "FALSE", "0", "미해당")


def text(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def _or_raise(value: Column, source: Column, what: str) -> Column:
    return F.when(value.isNotNull() | source.isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"not {what}: "), source)))


#: The shape of a text that each format can read; the parser alone would accept other widths.
_SHAPES = {
    "yyyyMMdd": "^[0-9]{8}$", "yyyy-MM-dd": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy/MM/dd": "^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yy/MM/dd": "^[0-9]{2}/[0-9]{2}/[0-9]{2}$",
}


def try_date(c: Column) -> Column:
    """A date in one of the four formats, else null."""
    t = text(c)
    return F.coalesce(*[F.when(t.rlike(shape), F.to_date(F.try_to_timestamp(t, F.lit(f)))) for f, shape in _SHAPES.items()])


def tolerant_date(c: Column) -> Column:
    """The ISO date that the first ten characters are, else null; what comes after may be anything."""
    head = F.substring(c.cast("string"), 1, 10)
    return F.when(head.rlike(_SHAPES["yyyy-MM-dd"]), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-MM-dd"))))


def parse_date(c: Column) -> Column:
    return _or_raise(try_date(c), text(c), "a date")


def parse_datetime(c: Column, formats: tuple[str, ...] = DATETIME_FORMATS) -> Column:
    t = text(c)
    return _or_raise(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]), t, "a time")


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def format_year(c: Column) -> Column:
    return F.when(c.between(0, 9999), F.lpad(c.cast("string"), 4, "0")).when(c.isNotNull(), F.raise_error(F.lit("year out of range")))


def to_integer(c: Column) -> Column:
    t = F.regexp_replace(text(c), ",", "")
    return _or_raise(t.try_cast("long"), t, "an integer")


def to_number(c: Column) -> Column:
    t = F.regexp_replace(text(c), "[,%]", "")
    return _or_raise(t.try_cast("decimal(38,6)"), t, "a number")


def yes_no(c: Column) -> Column:
    t = F.upper(text(c))
    return F.when(t.isNull(), None).when(t.isin(*YES), True).when(t.isin(*NO), False).otherwise(F.raise_error(F.concat(F.lit("neither yes nor no: "), t)))


def names(*columns: Column) -> Column:
    """Distinct names of comma-separated lists, in order."""
    parts = [F.coalesce(F.split(c, ","), F.array().cast("array<string>")) for c in columns]
    trimmed = F.transform(F.concat(*parts), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def address(*columns: Column) -> Column:
    """The parts that aren't blank, with spaces between; null if none."""
    return F.nullif(F.concat_ws(" ", *[text(c) for c in columns]), F.lit(""))


def period_start(c: Column) -> Column:
    return try_date(F.get(F.split(c, "~"), F.lit(0)))


def period_end(c: Column) -> Column:
    return try_date(F.get(F.split(c, "~"), F.lit(1)))


def coded(c: Column, codes: dict[str, str]) -> Column:
    """The meaning of a code; unknown codes are null. The value is worked out once, not once for each code."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), text(c))


def listing_status(listed: Column, delisted: Column) -> Column:
    return F.when(text(delisted).isNotNull(), "delisted").when(text(listed).isNotNull(), "listed")


def present(c: Column, value: str) -> Column:
    """A constant where there is a value."""
    return F.when(text(c).isNotNull(), value)


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def bracket_list(c: Column, arity: int) -> Column:
    """Records of ``[a^b^c],[d^e^f]``. Only ``],[`` separates, so brackets inside fields stay.

    A record of another number of fields raises an error; blank text has no records.
    """
    t = text(c)
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    records = F.transform(F.split(inner, r"\]\s*,\s*\["), lambda r: F.transform(F.split(r, r"\^", -1), lambda f: F.trim(f)))
    checked = F.transform(records, lambda r: F.when(F.size(r) == arity, r).otherwise(F.raise_error(F.lit(f"a record without {arity} fields"))))
    return F.when(t.isNull(), F.array().cast("array<array<string>>")).otherwise(checked)


def name_code(c: Column) -> Column:
    """``name/code`` as a struct; null where it doesn't fit."""
    fits = text(c).rlike(r"^[^/]+/[^/]+$")
    return F.when(fits, F.struct(F.trim(F.regexp_extract(c, r"^\s*([^/]+)/", 1)).alias("name"), F.trim(F.regexp_extract(c, r"/([^/]+?)\s*$", 1)).alias("code")))


def permitted(c: Column) -> Column:
    """The members of ``[x],[y]``, or of a list with commas."""
    bracketed = F.regexp_extract_all(c, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    parts = F.when(F.size(bracketed) > 0, bracketed).otherwise(F.split(c, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


CODECS: dict[str, Callable[..., Column]] = {
    "text": text, "parse_date": parse_date, "parse_datetime": parse_datetime, "format_date": format_date, "format_year": format_year,
    "to_integer": to_integer, "to_number": to_number, "yes_no": yes_no, "names": names, "address": address,
    "period_start": period_start, "period_end": period_end, "listing_status": listing_status, "digits": digits,
}


# Meanings of codes.
OPERATING_STATUS = {"01": "active", "02": "suspended", "03": "closed"}
TAXATION_TYPE = {
    "01": "general_taxpayer",
    "02": "simplified_taxpayer",
    "03": "special_taxpayer",
    "04": "tax_exempt_business",
    "05": "non_profit_or_public_entity",
    "06": "organization_with_identifier",
    "07": "simplified_taxpayer_invoice_issuer",
    "99": "not_applicable",
}
VERIFICATION_RESULT = {"01": "verified", "02": "not_verified"}


def statement_scope(code: Column, name: Column) -> Column:
    """Whether a financial statement is consolidated or separate, by words of its code and name or by the code itself."""
    words = F.lower(F.concat_ws(" ", F.nullif(code, F.lit("")), F.nullif(name, F.lit(""))))
    return F.when(words.contains("consolidated") | words.contains("연결") | F.coalesce(code == "110", F.lit(False)), "consolidated").when(
        words.contains("separate") | words.contains("별도") | F.coalesce(code == "120", F.lit(False)), "separate"
    )


def disclosure_status(number: Column) -> Column:
    return F.when(number != "", "currently_disclosed")


def industry_reference(c: Column) -> Column:
    """``name/code``, ``code`` or a bare name, in brackets or not, as a struct of name, code and text; null if blank."""
    t = F.trim(F.regexp_replace(F.trim(c), r"^[\[\]]+|[\[\]]+$", ""))
    pattern = r"^(?:(.+?)\s*/\s*)?([0-9]+)$"
    fits = t.rlike(pattern)
    name = F.when(fits, F.nullif(F.trim(F.regexp_extract(t, pattern, 1)), F.lit(""))).otherwise(t)
    return F.when(t != "", F.struct(name.alias("name"), F.when(fits, F.regexp_extract(t, pattern, 2)).alias("code"), t.alias("text")))


def _parts(c: Column) -> Column:
    """What stands in brackets, or else between commas."""
    bracketed = F.regexp_extract_all(c, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    split = F.filter(F.split(F.trim(c), r"\s*,\s*"), lambda p: F.trim(p) != "")
    return F.coalesce(F.when(F.size(bracketed) > 0, bracketed).otherwise(split), F.array().cast("array<string>"))


def permitted_industries(c: Column) -> Column:
    """``[name/code],[name/code]`` or a list with commas as references."""
    return F.filter(F.transform(_parts(c), industry_reference), lambda r: r.isNotNull())


def main_field_groups(c: Column) -> Column:
    """Groups of fields of which all hold (``^``), one bracket being enough: sequence (the first part if it is a number, else the place), operator and fields."""

    def group(part: Column, at: Column) -> Column:
        tokens = F.filter(F.transform(F.split(part, r"\^"), lambda x: F.trim(x)), lambda x: x != "")
        numbered = F.coalesce(F.get(tokens, F.lit(0)).rlike("^[0-9]+$"), F.lit(False))
        fields = F.when(numbered, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))).otherwise(tokens)
        return F.struct(F.when(numbered, F.get(tokens, F.lit(0))).otherwise((at + 1).cast("string")).alias("sequence"), F.lit("all").alias("operator"), fields.alias("fields"))

    return F.filter(F.transform(_parts(c), group), lambda g: F.size(g["fields"]) > 0)


def file_stem(name: Column) -> Column:
    """The last part of a path without its last extension, in lower case; a leading dot begins no extension."""
    base = F.regexp_extract(F.trim(name), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_replace(base, r"^(.+)\.[^.]+$", "$1"))


def safe_file_name(name: Column, checksum: Column, suffix: Column) -> Column:
    """A name that any store takes: no separators or control characters, 200 characters at most; without a usable name the checksum.

    Composition of accents (NFC) has no built-in; ``text.composed`` does it beforehand.
    """
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\\]", "_"), r"[\x00-\x1f\x7f]", "_")
    clean = F.regexp_replace(flat, r"^[ .]+|[ .]+$", "")
    extension = F.regexp_extract(clean, r"^.+(\.[^.]+)$", 1)
    stem = F.regexp_replace(F.left(F.left(clean, F.length(clean) - F.length(extension)), F.lit(160)), r"[ .]+$", "")
    short = F.concat(F.coalesce(F.nullif(stem, F.lit("")), checksum), F.left(extension, F.lit(20)))
    return F.when(clean == "", F.concat(checksum, suffix)).when(F.length(clean) > 200, short).otherwise(clean)


CODECS |= {
    "statement_scope": statement_scope, "disclosure_status": disclosure_status, "industry_reference": industry_reference,
    "permitted_industries": permitted_industries, "main_field_groups": main_field_groups, "file_stem": file_stem,
    "operating_status": lambda c: coded(c, OPERATING_STATUS), "taxation_type": lambda c: coded(c, TAXATION_TYPE), "verification_result": lambda c: coded(c, VERIFICATION_RESULT),
}
