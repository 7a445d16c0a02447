"""Reply text of an annotator as a typed struct, by expressions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BAD = "_corrupt_record"


def _parse(text: Column, fields: str) -> Column:
    options = {"columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "false"}
    parsed = F.from_json(text, f"{fields}, {_BAD} string", options)
    # text behind the first JSON value is an error, which the parser itself does not report
    whole = F.rtrim(text).endswith("}") & text.startswith("{")
    return F.when(whole & parsed[_BAD].isNull(), parsed)


def reply_to_struct(reply: Column, fields: str) -> Column:
    """First of these that parses, else NULL: the text, its fenced block, its outermost braces,
    and those without commas in front of a closing bracket."""
    text = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, text)
    braces = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    repaired = F.regexp_replace(braces, r",\s*([\]}])", "$1")
    return F.coalesce(*[_parse(t, fields) for t in (text, fenced, braces, repaired)]).dropFields(_BAD)
