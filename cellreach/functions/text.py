"""Scalar parsing and cleaning of free text, as native Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d+(?:\.\d+)?)"
MILE = 1.60934
#: Text that stands for a missing value.
NULL_TOKENS = ["", "nan", "none", "null", "<na>"]
#: Default speed in km/h by what the highway class contains; a later line wins over an earlier one.
HIGHWAY_KMH = [
    (["motorway"], 100.0),
    (["trunk"], 80.0),
    (["primary"], 65.0),
    (["secondary"], 55.0),
    (["tertiary"], 45.0),
    (["residential", "living_street"], 25.0),
    (["service", "unclassified"], 15.0),
]
DEFAULT_KMH = 40.0
#: Words that labels keep in capitals.
ACRONYMS = ["OSM", "US", "USA", "UK"]


def numbers(text: Column) -> Column:
    """All decimal numbers in the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))


def maxspeed_kmh(text: Column) -> Column:
    """The least number of a speed tag in km/h, miles where 'mph' occurs; null for none or zero."""
    low = F.array_min(numbers(F.lower(text)))
    return F.nullif(F.when(F.lower(text).contains("mph"), low * MILE).otherwise(low), F.lit(0.0))


def highway_kmh(kind: Column) -> Column:
    low = F.coalesce(F.lower(kind), F.lit(""))
    out = F.lit(None).cast("double")
    for words, speed in HIGHWAY_KMH:
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(speed)).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_KMH))


def oneway(value: Column) -> Column:
    """Whether a oneway tag says yes; '-1' and null do not."""
    return F.coalesce(F.lower(value.cast("string")).isin("yes", "true", "1"), F.lit(False))


def voltages(text: Column) -> Column:
    """Volts of each part of a voltage tag; parts under 1000 or in kV are kilovolts."""

    def volts(part: Column) -> Column:
        size = F.regexp_extract(part, NUMBER, 1).cast("double")
        bare = (size >= 1000) & ~F.lower(part).contains("kv")
        return F.when(bare, size).otherwise(size * 1000)

    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda p: p.rlike(NUMBER))
    return F.transform(parts, volts)


def high_voltage(text: Column, threshold: float = 100_000.0) -> Column:
    return F.exists(voltages(text), lambda v: v >= threshold)


def hstore(text: Column, key: str) -> Column:
    """The value of key in `"k"=>"v"` text; null if absent."""
    return F.nullif(F.regexp_extract(text, f'"{key}"=>"([^"]*)"', 1), F.lit(""))


def rate_per(text: Column) -> Column:
    """A number with thousands separators out of text that says 'per'."""
    digits = F.nullif(F.regexp_extract(text, r"([\d,]+(?:\.\d+)?)", 1), F.lit(""))
    return F.when(F.lower(text).contains("per"), F.replace(digits, F.lit(","), F.lit("")).try_cast("double"))


def clean_fips(text: Column) -> Column:
    """Five digits: a trailing '.0' goes, zeros are put in front; longer codes stay."""
    bare = F.replace(text, F.lit(".0"), F.lit(""))
    return F.when(F.length(bare) >= 5, bare).otherwise(F.lpad(bare, 5, "0"))


def coalesce_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def null_tokens(value: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).isin(NULL_TOKENS), value)


def label_of(slug: Column) -> Column:
    """A slug as a label: underscores to spaces, words capitalised."""
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def pretty_label(slug: Column) -> Column:
    """A slug as a label, every run of letters capitalised, with common acronyms in capitals."""
    spaced = F.replace(F.trim(slug), F.lit("_"), F.lit(" "))
    parts = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    out = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")
    for word in ACRONYMS:
        out = F.replace(out, F.lit(word.title()), F.lit(word))
    return out


def sample_value(line: Column, key: str) -> Column:
    """The number that follows `key=` in a line of telemetry; null if there is none."""
    return F.nullif(F.regexp_extract(line, rf"\b{key}=(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def looks_like_coordinates(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*-?\d+(\.\d+)?\s*,\s*-?\d+(\.\d+)?\s*$"), F.lit(False))


def tag_match(tags: Column, wanted: list[tuple[str, str]]) -> Column:
    """Whether a tag map holds one of the (key, value) pairs."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False)) for k, v in wanted])
