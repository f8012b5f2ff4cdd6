"""Numbers, times and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.operators.aggregates import half_up


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def log_size(n: Column, full: float = 16) -> Column:
    """A size on 0..1 by its logarithm."""
    return half_up(clamp(F.log2(n + F.lit(1)) / F.log2(F.lit(full + 1.0))), 3)


def level(x: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def score(x: Column) -> Column:
    """A score from a number or a numeric text, on 0..1; null if it is neither."""
    return clamp(x.try_cast("double"))


def iso_date(x: Column) -> Column:
    """The first ISO date inside a text, if it is one of the calendar."""
    return F.try_to_timestamp(F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")


def recency(ts: Column, as_of: Column, years: float, digits: int = 3) -> Column:
    """1 for now, falling in a line to 0 at an age of some years of 365.25 days."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400.0
    return half_up(clamp(1 - age / (365.25 * years)), digits)


def next_reset(ts: Column, zone: str) -> Column:
    """The next midnight of a time zone, in UTC."""
    local = F.from_utc_timestamp(ts, zone)
    return F.to_utc_timestamp(F.date_add(F.to_date(local), 1).cast("timestamp"), zone)


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def json_payload(x: Column) -> Column:
    """The JSON object inside a reply: from the first opening brace to the last closing one, null if that doesn't parse."""
    body = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def json_list(x: Column) -> Column:
    """A JSON array of strings; an empty one for anything else."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def patched(json: Column, key: str, value: Column) -> Column:
    """A flat JSON object with one value set; what isn't an object counts as empty. The last of equal keys wins."""
    old = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != key), F.create_map(F.lit(key), value.cast("string"))))
