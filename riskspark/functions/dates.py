"""Dates in note headers and on contracts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.values import DEFAULT_NOTE_YEAR, MONTH_NUMBERS

# Fixed patterns. The narrow slash form only knows one-digit months, so 12/05 reads as 2/05.
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
SLASH_DATE = r"(?:1[0-2]|0?[1-9])/\d{1,2}"
SLASH_DATE_NARROW = r"0?[1-9]/\d{1,2}"
WORD_DATE = r"[A-Za-z]+\s+\d{1,2}"


def _extract(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def note_date_token(block: Column, narrow_slash: bool = False) -> Column:
    """Leftmost date-like token in the first line of a note."""
    slash = SLASH_DATE_NARROW if narrow_slash else SLASH_DATE
    first_line = F.substring_index(block, "\n", 1)
    return _extract(first_line, f"({ISO_DATE}|{slash}|{WORD_DATE})", 1)


def parse_note_date(token: Column, default_year: int = DEFAULT_NOTE_YEAR) -> Column:
    """Date of an ISO, m/d[/y] or month-name token; NULL where it is none or impossible."""
    raw = F.regexp_replace(token, r"(?U)^\s+|\s+$", "")
    year_default = F.lit(str(default_year))

    def to_date(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")

    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    slash = r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$"
    word = r"(?i)^([a-z]+)\s+(\d{1,2})(?:\s+(\d{4}))?"
    short_year = _extract(raw, slash, 3).cast("int")
    slash_year = F.when(short_year < 100, short_year + 2000).otherwise(short_year).cast("string")
    months = F.create_map(*[F.lit(str(v)) for pair in MONTH_NUMBERS.items() for v in pair])  # folds to a literal
    month = F.try_element_at(months, F.lower(_extract(raw, word, 1)))
    return (
        F.when(raw.rlike(iso), to_date(_extract(raw, iso, 1), _extract(raw, iso, 2), _extract(raw, iso, 3)))
        .when(raw.rlike(slash), to_date(F.coalesce(slash_year, year_default),
                                        _extract(raw, slash, 1), _extract(raw, slash, 2)))
        .when(month.isNotNull(), to_date(F.coalesce(_extract(raw, word, 3), year_default),
                                         month, _extract(raw, word, 2)))
    )


def days_to(end: Column, ref: Column) -> Column:
    return F.datediff(end, ref)


def renewal_urgency(days_left: Column) -> Column:
    return (F.when(days_left <= 0, 1.0).when(days_left <= 30, 0.9)
            .when(days_left <= 60, 0.6).otherwise(0.3))
