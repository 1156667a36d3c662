"""Field-level cleaning of text-typed raw values.

Each cleaner returns ``(value, reason)``: the typed value, NULL where the raw value cannot be
converted, and the reason to give in that case. Callers evaluate the reason only for NULL
values, so a good record pays for one cast per field.

Raw fields are read as text, so a JSON number 3.7 and the text "3.7" look alike; both truncate
to 3 in an integer field. A missing field and a NULL are both reported as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical sector names by their lower-case spelling.
SECTOR_NAMES = {
    "retail": "Retail",
    "services": "Services",
    "healthcare services": "Healthcare Services",
    "food & beverage": "Food & Beverage",
    "manufacturing": "Manufacturing",
    "wholesale trade": "Wholesale Trade",
}
# Fixed value: GST number of a business without GST registration.
NOT_REGISTERED = "NOT_REGISTERED"

# Reasons given for values that cannot be converted.
BAD_INT = "invalid literal for int() with base 10: '%s'"
BAD_FLOAT = "could not convert string to float: '%s'"
BAD_DATE = "time data '%s' does not match format '%%Y-%%m-%%d'"
BAD_DAY = "day is out of range for month"
NAN_INT = "cannot convert float NaN to integer"
INF_INT = "cannot convert float infinity to integer"

_SPACE = r"(?U)[\s\x1c-\x1f]+"
# What the cast to double takes but a decimal number may not contain: 1.0d, 3f, 0x1p3, Infinity.
_NOT_DECIMAL = r"[dDfFxX]"
_DATE = r"^\d{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9])$"
_MAX_DOUBLE = 1.7976931348623157e308


def squeeze(text: Column) -> Column:
    """Trim and collapse runs of white space to one blank."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def title_case(text: Column) -> Column:
    """Capitalize every letter that does not follow a letter, lower-case the others.

    For plain words that is what initcap does; only other text is taken apart.
    """
    letters = F.split(text, "")

    def cased(ch: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(letters, i - 1)).otherwise(F.lit(" "))
        return F.when(before.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]"), F.lower(ch)).otherwise(F.upper(ch))

    taken_apart = F.array_join(F.transform(letters, cased), "")
    return F.when(text.rlike(r"[^A-Za-z ]"), taken_apart).otherwise(F.initcap(text))


def sector_name(text: Column) -> Column:
    clean = squeeze(text)
    names = F.create_map(*[F.lit(x) for pair in SECTOR_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(clean)), title_case(clean))


def _reason(raw: Column, field: str, unconvertible: Column | None = None) -> Column:
    missing = F.when(raw.isNull(), F.lit(f"'{field}'"))
    return missing if unconvertible is None else missing.otherwise(unconvertible)


def as_text(raw: Column, field: str) -> tuple[Column, Column]:
    return raw, _reason(raw, field)


def as_stripped(raw: Column, field: str) -> tuple[Column, Column]:
    return strip(raw), _reason(raw, field)


def as_code(raw: Column, field: str) -> tuple[Column, Column]:
    return F.upper(strip(raw)), _reason(raw, field)


def as_sector(raw: Column, field: str) -> tuple[Column, Column]:
    return sector_name(raw), _reason(raw, field)


def as_optional(raw: Column, field: str) -> tuple[Column, Column]:
    return raw, F.lit(None).cast("string")


def as_date(raw: Column, field: str) -> tuple[Column, Column]:
    """yyyy-MM-dd by a plain cast; the rarer one-digit months and days by pattern."""
    quick = raw.try_cast("date")
    value = F.when(quick.cast("string") == raw, quick).when(
        raw.rlike(_DATE), F.try_to_date(raw, "yyyy-M-d")
    )
    wrong = F.when(raw.rlike(_DATE), F.lit(BAD_DAY)).otherwise(F.format_string(BAD_DATE, raw))
    return value, _reason(raw, field, wrong)


def _number(raw: Column) -> Column:
    """Finite decimal number as double."""
    parsed = raw.try_cast("double")
    return F.when((F.abs(parsed) <= F.lit(_MAX_DOUBLE)) & ~raw.rlike(_NOT_DECIMAL), parsed)


def _not_a_number(raw: Column, otherwise: str) -> Column:
    parsed = raw.try_cast("double")
    return (
        F.when(F.isnan(parsed), F.lit(NAN_INT))
        .when(F.abs(parsed) > F.lit(_MAX_DOUBLE), F.lit(INF_INT))
        .otherwise(F.format_string(otherwise, raw))
    )


def as_int(raw: Column, field: str) -> tuple[Column, Column]:
    value = F.coalesce(raw.try_cast("int"), _number(raw).try_cast("int"))
    return value, _reason(raw, field, _not_a_number(raw, BAD_INT))


def as_paise(raw: Column, field: str) -> tuple[Column, Column]:
    """Rupee amount to integer paise, half-even."""
    value = F.rint(_number(raw) * F.lit(100)).try_cast("long")
    return value, _reason(raw, field, _not_a_number(raw, BAD_FLOAT))


def as_float(raw: Column, field: str) -> tuple[Column, Column]:
    return _number(raw), _reason(raw, field, F.format_string(BAD_FLOAT, raw))


def as_bool(raw: Column, field: str) -> tuple[Column, Column]:
    wrong = F.format_string("not a boolean: '%s'", raw)
    return raw.try_cast("boolean"), _reason(raw, field, wrong)
