"""Text, array and label expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.dates import ISO_DATE, WORD_DATE
from riskspark.functions.numeric import lookup
from riskspark.functions.values import (
    BAR_LABELS, PLACEHOLDER_FRAGMENTS, SDK_SCORE_LABELS, TOP_SIGNAL_LABELS,
)

EMPTY_STRINGS = "array<string>"


def empty_list() -> Column:
    return F.array().cast(EMPTY_STRINGS)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_header(block: Column) -> Column:
    """First two lines as one, without the first date-like token and the marks behind it."""
    header = F.array_join(F.slice(F.split(block, "\n"), 1, 2), " ")
    date = rf"(?:{ISO_DATE}|\d{{1,2}}/\d{{1,2}}|{WORD_DATE})"
    # the lazy head keeps this a first-match-only replacement
    return strip(F.regexp_replace(header, rf"(?s)^(.*?){date}[\s|\-—]*", "$1"))


def has_non_english(text: Column) -> Column:
    """More than a tenth of the characters are outside ASCII."""
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.coalesce((F.length(text) > 0) & (foreign / F.greatest(F.length(text), F.lit(1)) > 0.1),
                      F.lit(False))


def keep(*items: Column) -> Column:
    """The non-NULL items, in order."""
    return F.array_compact(F.array(*items)).cast(EMPTY_STRINGS)


def _hundredths_of_millions(value: Column) -> Column:
    """value / 1e6 to two digits, rounded as the binary quotient and not as its decimal text.

    They differ only halfway between two results. There the sign of the exact residual
    (quotient * 1e6 - value) decides, computed from the quotient's upper and lower half.
    """
    quotient = value / 1e6
    scaled = quotient * 134217729.0
    high = scaled - (scaled - quotient)
    product = quotient * 1e6
    residual = (product - value) + ((high * 1e6 - product) + (quotient - high) * 1e6)
    below = F.floor(value / 1e4)
    halfway = F.when(residual > 0, below + 1).when(residual < 0, below).otherwise(below + below % 2)
    return F.when(value % 10_000 == 5_000, halfway).otherwise(F.round(value / 1e4)) / 100


def money_short(amount: Column) -> Column:
    value = amount.cast("double")
    return (F.when(value >= 1e6, F.format_string("$%.2fM", _hundredths_of_millions(value)))
            .when(value >= 1e3, F.format_string("$%.0fK", F.bround(value / 1e3, 0)))
            .otherwise(F.format_string("$%.0f", F.bround(value, 0))))


def money_full(amount: Column) -> Column:
    return F.format_string("$%,.0f", F.bround(amount.cast("double"), 0))


def nps_text(score: Column) -> Column:
    return F.coalesce(F.concat(score.cast("int").cast("string"), F.lit("/10")), F.lit("N/A"))


def decline_pct_text(score: Column) -> Column:
    return F.concat(F.lit("-"), (score * 100).cast("int").cast("string"), F.lit("%"))


def percent(score: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(score * 100, 0))


def sdk_score_label(score: Column) -> Column:
    rounded = F.round(score, 2)
    label = None
    for floor, text in SDK_SCORE_LABELS:
        label = F.when(rounded >= floor, text) if label is None else label.when(rounded >= floor, text)
    return label.otherwise("Unknown SDK")


def sdk_exact_label(score: Column) -> Column:
    """Label only for the four listed scores; anything between is 'moderate'."""
    rounded = F.round(score, 2)
    by_score = {1.0: "sunset", 0.6: "upgrade needed", 0.15: "stable", 0.0: "current"}
    return lookup(rounded, by_score, "moderate")


def sdk_display_label(version: Column) -> Column:
    low = F.lower(version)
    return (F.when(F.coalesce(version, F.lit("")) == "", "Unknown")
            .when(low.startswith("v3"), F.concat(version, F.lit(" (SUNSET)")))
            .when(low.isin("v4.0.0", "v4.1.0"), F.concat(version, F.lit(" (upgrade needed)")))
            .otherwise(version))


def top_signal_label(name: Column) -> Column:
    return lookup(name, TOP_SIGNAL_LABELS, name)


def bar_label(name: Column) -> Column:
    return lookup(name, BAR_LABELS, name)


def is_real_narrative(text: Column) -> Column:
    found = F.lit(False)
    for fragment in PLACEHOLDER_FRAGMENTS:
        found = found | F.contains(text, F.lit(fragment))
    return F.coalesce((text != "") & ~found, F.lit(False))


def json_text_to_list(text: Column) -> Column:
    """A JSON list as an array; any other text as a list of itself."""
    return F.when(text.isNotNull(), F.coalesce(F.from_json(text, EMPTY_STRINGS), F.array(text)))
